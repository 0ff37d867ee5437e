"""What the tasks of past stages spent their time on, from Spark's own status store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugemill.operators.stats import worker_phases

SPENT = "stage int, task long, worker string, read long, total long, cpu long, read_bytes long, shuffle_read_bytes long, shuffle_write_bytes long, spilled_bytes long"


def task_times(spark: SparkSession, stages: list[int] | None = None, most: int = 100_000) -> DataFrame:
    """A row for each finished task that the driver still remembers (spark.ui.retainedTasks); times in milliseconds.

    read is what a task spent on waiting for shuffled data, total its whole time, cpu that of the processor.
    """
    store, rows = spark.sparkContext._jsc.sc().statusStore(), []
    found = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    for i in range(found.size()):
        stage = found.apply(i)
        if stages is not None and stage.stageId() not in stages:
            continue
        tasks = store.taskList(stage.stageId(), stage.attemptId(), most)
        for k in range(tasks.size()):
            t = tasks.apply(k)
            if t.taskMetrics().isDefined():
                m = t.taskMetrics().get()
                r, w = m.shuffleReadMetrics(), m.shuffleWriteMetrics()
                rows.append((stage.stageId(), t.taskId(), t.executorId(), r.fetchWaitTime(), m.executorRunTime(), m.executorCpuTime() // 1_000_000, m.inputMetrics().bytesRead(), r.remoteBytesRead() + r.localBytesRead(), w.bytesWritten(), m.diskBytesSpilled()))
    return spark.createDataFrame(rows, SPENT)


def phase_report(spent: DataFrame) -> DataFrame:
    """For each stage of task_times(): tasks, mean and greatest total, spread between tasks, CPU's share in tenths of a percent, bytes."""
    sums = [F.sum(c).alias(c) for c in ("read_bytes", "shuffle_read_bytes", "shuffle_write_bytes", "spilled_bytes")]
    share = F.when(F.sum("total") > 0, F.floor(F.sum("cpu") * 1000 / F.sum("total") + 0.5)).cast("long")
    return spent.groupBy("stage").agg(F.count("*").alias("tasks"), F.floor(F.avg("total") + 0.5).cast("long").alias("mean_total"), F.max("total").alias("longest"), (F.max("total") - F.min("total")).alias("spread"), F.sum("read").alias("read"), share.alias("cpu_share"), *sums)


def executor_phases(spent: DataFrame) -> DataFrame:
    """The means and the stragglers' spread over executors."""
    return worker_phases(spent.select("worker", "read", "total"))
