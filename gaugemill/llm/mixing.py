"""Mix sources to target weights by pivotal dependent rounding, with DataFrame operations only.

Every document of a source gets the same fractional number of copies. Its whole part is taken at once; the
fraction is rounded so that the words taken from the source stay at the target: two documents exchange word mass,
at random and without bias, until one of them has all of its words or none. Chunks of about 64 documents are
folded in that way; each leaves at most one document undecided, and these meet in the chunks of the next level, so
the residuals are combined through a reduction tree of about log64(n) levels. Chunks are dealt by hash within the
source, so a source with a third of all rows is spread like any other.

The last undecided document of a source may be a large one, and drawing it leaves the source off its target by as much as its
words. So the source is set right at the end: the decision about one document is turned round, that whose size is nearest to what the source
has too much or too little, if this brings it nearer; and once more. Only documents with a fraction are turned, so none gets more than its whole part and one.

Defined cases: null text has size 0. A null source is a source of its own, after all others. Documents of size 0
take no part in the exchange; they are kept whole-part times, plus once by a hash draw. A source without words has
target 0, and its documents keep one copy each. Repeated rows are documents of their own. No row is ever dropped
from the result of mix(); a document that is not wanted has copies 0. An empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaugemill.llm.common import boxed, materialize, row_key, table, unboxed, word_count

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
CHUNK = 64
CORRECTIONS = 2
SEED = 9


def ranked_sources(sizes: DataFrame) -> DataFrame:
    """sizes(source, source_size, n) with rank from 0, by code point, null last; ranks are made range by range."""
    parts = materialize(
        sizes.withColumn("_nul", F.col("source").isNull()).repartitionByRange("_nul", "source").withColumn("_pid", F.spark_partition_id()),
        "mix-sources",
    )
    per_part = parts.groupBy("_pid").agg(F.count("*").alias("_n"))
    before = per_part.select("_pid", (F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1))).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_pid").orderBy("_nul", "source")) - 1
    return parts.withColumn("_i", within).join(before, "_pid").select("source", "source_size", "n", (F.col("_i") + F.coalesce("_before", F.lit(0))).cast("long").alias("rank"))


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """sizes(source, source_size, n) with rank and target (words, double).

    The driver holds sums only: each round fixes the sources that would pass their stop and shares the rest anew.
    """
    pick = F.element_at(F.array(*(F.lit(int(w)) for w in weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    s = materialize(ranked_sources(sizes).withColumn("weight", pick.cast("long")), "mix-ranked")
    total, cap = (s.agg(F.sum("source_size")).first()[0] or 0), F.col("source_size") * F.lit(most)
    level, fixed = None, -1
    while True:
        stopped = F.lit(False) if level is None else cap.cast("double") <= F.col("weight") * F.lit(level)
        used, open_weight, n = s.agg(F.sum(F.when(stopped, cap)), F.sum(F.when(~stopped, F.col("weight"))), F.count(F.when(stopped, 1))).first()
        if n == fixed or not open_weight:
            break
        level, fixed = (share * total - (used or 0)) / open_weight, n
    target = F.lit(0.0) if level is None else F.least(cap.cast("double"), F.col("weight") * F.lit(float(level)))
    return s.withColumn("target", target)


#: One exchange between the open unit a and the unit x; draw in [0, 1) is x's own. up: a gains what x gives.
_UP = "least(acc.a.size - acc.a.mass, x.mass)"
_DOWN = "least(acc.a.mass, x.size - x.mass)"


def _unit(of: str, mass: str) -> str:
    return f"named_struct('id', {of}.id, 'size', {of}.size, 'mass', cast({mass} as double), 'draw', {of}.draw)"


def _out(of: str, take: int) -> str:
    return f"named_struct('id', {of}.id, 'take', {take})"


def fold_sql(id_type: str) -> str:
    """SQL over array column units(id, size, mass, draw): struct(a: the open unit or null, out: array(id, take))."""
    unit, outs = f"struct<id:{id_type},size:double,mass:double,draw:double>", f"array<struct<id:{id_type},take:int>>"
    opened = lambda of, mass, done: f"named_struct('a', cast({_unit(of, mass)} as {unit}), 'out', concat(acc.out, array({done})))"
    closed = f"named_struct('a', cast(null as {unit}), 'out', concat(acc.out, array(%s)))"
    up = f"""case when acc.a.size - acc.a.mass < x.mass then {opened('x', 'x.mass - (acc.a.size - acc.a.mass)', _out('acc.a', 1))}
        when acc.a.size - acc.a.mass > x.mass then {opened('acc.a', 'acc.a.mass + x.mass', _out('x', 0))}
        else {closed % (_out('acc.a', 1) + ', ' + _out('x', 0))} end"""
    down = f"""case when acc.a.mass < x.size - x.mass then {opened('x', 'x.mass + acc.a.mass', _out('acc.a', 0))}
        when acc.a.mass > x.size - x.mass then {opened('acc.a', 'acc.a.mass - (x.size - x.mass)', _out('x', 1))}
        else {closed % (_out('acc.a', 0) + ', ' + _out('x', 1))} end"""
    return f"""aggregate(units, named_struct('a', cast(null as {unit}), 'out', cast(array() as {outs})),
        (acc, x) -> cast(case when acc.a is null then named_struct('a', cast({_unit('x', 'x.mass')} as {unit}), 'out', acc.out)
        when x.draw * ({_UP} + {_DOWN}) < {_DOWN} then {up} else {down} end as struct<a:{unit},out:{outs}>))"""


def corrected(decided: DataFrame) -> DataFrame:
    """decided(id, take, row) with at most one decision of each source turned round, so that its words come nearer to its target; row tells equal rows apart."""
    words = F.col("id.words")
    off = decided.groupBy(F.col("id.source").alias("_src")).agg((F.sum(words * (F.col("id.whole") + F.col("take"))) - F.max("id.target")).alias("off"))
    fraction = (F.col("id.target") > F.col("id.whole") * F.col("id.source_size")) & (words > 0)
    of = decided.where(fraction).select(F.col("id.source").alias("source"), "id", "take", "row", words.alias("words")).join(off, F.col("source").eqNullSafe(F.col("_src")))
    turns = of.where(((F.col("off") > 0) & (F.col("take") == 1) | (F.col("off") < 0) & (F.col("take") == 0)) & (F.col("words") < 2 * F.abs("off")))
    nearest = F.min(F.struct(F.abs(F.col("words") - F.abs("off")), F.col("id.doc_id"), F.col("id.key"), "row"))
    one = turns.groupBy("source").agg(nearest.alias("n")).select(F.col("n.row").alias("_turned"))
    turned = F.when(F.col("_turned").isNotNull(), 1 - F.col("take")).otherwise(F.col("take"))
    return decided.join(one, F.col("row") == F.col("_turned"), "left").select("id", turned.alias("take"), "row")


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST, seed: int = SEED) -> DataFrame:
    """Per row of docs(doc_id, source, text): doc_id, source, key, size, source_size, target, copies (int), taken."""
    rows = materialize(docs.select("doc_id", "source", row_key(docs).alias("key"), word_count(F.col("text")).alias("size")), "mix-rows")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    t = materialize(targets(sizes, weights, share, most).select(F.col("source").alias("_src"), "rank", "source_size", "n", "target"), "mix-targets")
    f = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(1.0)
    whole = F.floor(f).cast("int")
    draw = lambda *of: F.pmod(F.xxhash64(F.lit(seed), *of), F.lit(1 << 52)) / F.lit(float(1 << 52))
    ids = F.struct("doc_id", "key", "rank", "source_size", "target", "whole")
    units = (
        rows.join(t, F.col("source").eqNullSafe(F.col("_src")))
        .withColumns({"whole": whole, "_p": f - whole})
        .select("rank", "n", F.struct("doc_id", "source", "key", F.col("size").alias("words"), "source_size", "target", "whole").alias("id"), F.col("size").cast("double").alias("size"), "_p", draw(F.lit("u"), "doc_id", "key").alias("draw"))
    )
    open_ = (F.col("size") > 0) & (F.col("_p") > 0)
    sure = units.where(~open_).select("id", ((F.col("_p") > 0) & (F.col("draw") < F.col("_p"))).cast("int").alias("take"))
    rest = units.where(open_).select("rank", "n", F.struct("id", "size", (F.col("size") * F.col("_p")).alias("mass"), "draw").alias("unit"))
    id_type = units.schema["id"].dataType.simpleString()
    most_rows = t.agg(F.max("n")).first()[0] or 0
    levels, decided = max(1, math.ceil(math.log(max(2, most_rows)) / math.log(CHUNK))), [sure]
    for level in range(levels):
        chunks = F.greatest(F.lit(1), F.ceil(F.col("n") / F.lit(float(CHUNK ** (level + 1))))) if level < levels - 1 else F.lit(1)
        chunk = F.pmod(F.xxhash64(F.lit(seed + level), "unit.id.doc_id", "unit.id.key", "unit.draw"), chunks.cast("long"))
        gathered = rest.groupBy("rank", "n", chunk.alias("chunk")).agg(F.array_sort(F.collect_list(F.struct((-F.col("unit.size")).alias("first"), F.col("unit.draw").alias("draw"), F.col("unit.id").alias("id"), F.col("unit.size").alias("size"), F.col("unit.mass").alias("mass")))).alias("units"))
        folded = materialize(gathered.select("rank", "n", F.expr(fold_sql(id_type)).alias("f")), f"mix-level{level}")
        decided.append(folded.select(F.inline("f.out")))
        rest = folded.where("f.a is not null").select("rank", "n", F.col("f.a").alias("unit"))
    decided.append(rest.select("unit.id", (draw(F.lit("last"), "unit.id.doc_id", "unit.id.key") * F.col("unit.size") < F.col("unit.mass")).cast("int").alias("take")))
    out = decided[0]
    for d in decided[1:]:
        out = out.unionByName(d)
    out = out.withColumn("row", F.monotonically_increasing_id())
    for turn in range(CORRECTIONS):
        out = corrected(materialize(out, f"mix-decided{turn}"))
    copies = (F.col("id.whole") + F.col("take")).cast("int")
    return out.select("id.doc_id", "id.source", "id.key", F.col("id.words").alias("size"), "id.source_size", "id.target", copies.alias("copies"), (F.col("id.words") * copies).alias("taken"))


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The rows of docs as the mix takes them: a document with two copies comes twice, one with none goes."""
    wanted = mix(docs, **how).groupBy("key").agg(F.sum("copies").alias("_copies"), F.count("*").alias("_n"))
    wanted = materialize(wanted, "mix-wanted")
    keyed = boxed(docs)
    if wanted.where("_n > 1").limit(1).count():
        keyed = keyed.dropDuplicates(["_key"])
    out = keyed.join(wanted.where("_copies > 0").withColumnRenamed("key", "_key"), "_key")
    return unboxed(out.select("_row", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))).alias("_copy")))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
