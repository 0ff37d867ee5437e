"""Exact fixed-point group statistics and their sources, reports and checks, on Spark."""
