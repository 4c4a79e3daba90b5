"""Operator 1: mix sources to target weights by weighted fair queueing.

Every document of a source is shuffled (by a hash of its id) and given a virtual finish time: the words
its source has sent up to its end, divided by the source's target. A source may be sent several times
over (epochs). All sources' documents, sorted by virtual finish time, then form one stream in which each
source progresses in proportion to its target; the stream is truncated at the total budget, which virtual
time 1 reaches.

Scale: documents shrink to a compact row (id, source, size) at the only scan of the texts. Running totals
within a source are taken in ``BUCKETS`` slices of the hash order plus the totals of the slices before,
so a source with a third of all rows is spread over that many groups; the global order likewise runs over
``BUCKETS`` ranges of virtual time, which hold equal shares of the budget. No window spans a source.

Defined cases: null or blank text has size 0 and is never taken; a null source is a source of its own; a
null id shuffles as one value; repeated rows are separate rows of the stream; an empty table gives no rows.
Only ``id_col``, ``source_col`` and ``text_col`` are read, so other columns can have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakescope.llm.shared import frozen, word_count

#: Slices of the hash order and ranges of virtual time: 16 to the power of HEX.
HEX = 3
BUCKETS = 16 ** HEX


def source_key(source: Column) -> Column:
    """A join key that is never null: the source after a mark, or empty for null."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def sized(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """One compact row for each document: row (a number of its own), doc_id, source, source_key, size, key."""
    return frozen(docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
        source_key(F.col(source_col)).alias("source_key"), word_count(F.col(text_col)).alias("size"),
        content_key(id_col, source_col, text_col).alias("key")))


def content_key(id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> Column:
    """Names a document by its contents; equal only for repeated rows."""
    return F.xxhash64(F.col(id_col), F.col(source_col), F.col(text_col))


def source_targets(sizes: DataFrame, weights: DataFrame, repeats: int = 3, budget: int | None = None) -> DataFrame:
    """Targets by weight that no source exceeds ``repeats`` times: (source_key, source_size, target).

    ``sizes``: (source_key, source_size); ``weights``: (source_key, weight). The budget (by default all
    sizes) is shared by weight; what a source can't send is shared again among the others. The share of a
    unit of weight only rises, so a few rounds of one small aggregate find it.
    """
    s = frozen(sizes.join(weights.select("source_key", F.col("weight").cast("decimal(20,6)").alias("weight")), "source_key"))
    cap = F.col("source_size") * F.lit(repeats)
    total, full = s.agg(F.sum("source_size"), F.sum(cap)).first()
    budget = min(int(total or 0) if budget is None else budget, int(full or 0))
    # a source with nothing to send has no part in the sharing
    rows = s.filter("source_size > 0")
    taken, weight, capped = 0, None, -1
    while True:
        above = F.lit(False) if weight is None else (
            cap.cast("double") * F.lit(float(weight)) <= F.lit(float(budget - taken)) * F.col("weight").cast("double"))
        got = rows.agg(F.sum(F.when(above, cap)), F.sum(F.when(~above, F.col("weight"))), F.sum(F.when(above, 1).otherwise(0))).first()
        if got[1] is None or got[2] == capped:
            break
        taken, weight, capped = int(got[0] or 0), got[1], got[2]
    share = F.col("weight").cast("double") * F.lit(float(budget - taken)) / F.lit(float(weight or 1))
    target = F.when(F.col("source_size") > 0, F.least(cap.cast("double"), share)).otherwise(F.lit(0.0))
    if got[1] is None:
        target = cap.cast("double")
    return s.select("source_key", "source_size", target.alias("target"))


def running_total(df: DataFrame, keys: list[str], bucket: str, order: list, value: str, name: str) -> DataFrame:
    """Sum of ``value`` over the rows before, within ``keys``, in the order (bucket, order).

    The sum inside a bucket plus the totals of the buckets before it, so that no group is larger than a
    bucket. There are at most ``BUCKETS`` totals for a key.
    """
    totals = df.groupBy(*keys, bucket).agg(F.sum(value).alias("_sum"))
    prior = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offset = totals.select(*keys, bucket, F.coalesce(F.sum("_sum").over(prior), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0))).join(
        offset, [*keys, bucket]).withColumn(name, F.col("_inside") + F.col("_offset")).drop("_inside", "_offset")


def mix(docs: DataFrame, targets: DataFrame, repeats: int = 3, seed: int = 0, budget: int | None = None) -> DataFrame:
    """The mixed stream: a row for each epoch of each document that is sent, in part or whole.

    ``docs`` from ``sized``, ``targets`` from ``source_targets``. Columns: row, key, doc_id, source, epoch
    (from 0), size, virtual_finish, position (words of the stream before it), taken (words sent; the
    document in service at virtual time 1 or where the budget ends is sent in part). Sort by ``position``
    for the stream itself.
    """
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    d = docs.filter("size > 0").withColumn("_h", order).withColumn("_slice", F.conv(F.substring("_h", 1, HEX), 16, 10).cast("int"))
    d = running_total(d, ["source_key"], "_slice", ["_h", "doc_id", "size", "row"], "size", "_before")
    d = d.join(targets, "source_key").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    d = d.withColumn("_start", F.col("_before") + F.col("epoch") * F.col("source_size"))
    left = F.floor(F.col("target") - F.col("_start") + F.lit(0.5)).cast("long")
    d = d.withColumn("taken", F.least(F.col("size"), left)).filter("taken > 0")
    d = d.withColumn("virtual_finish", (F.col("_start") + F.col("size")) / F.col("target"))
    d = d.withColumn("_range", F.least(F.lit(BUCKETS - 1), F.floor(F.col("virtual_finish") * F.lit(BUCKETS))).cast("int"))
    d = d.withColumn("_all", F.lit(0))
    d = running_total(d, ["_all"], "_range", ["virtual_finish", "source_key", "epoch", "_h", "row"], "taken", "position")
    if budget is None:
        budget = int(targets.agg(F.floor(F.sum(F.col("target").cast("decimal(30,6)")) + F.lit(0.5)).cast("long")).first()[0] or 0)
    return d.filter(F.col("position") < F.lit(budget)).select(
        "row", "key", "doc_id", "source", "epoch", "size", "virtual_finish", "position",
        F.least(F.col("taken"), F.lit(budget) - F.col("position")).cast("long").alias("taken"))


def by_source(docs: DataFrame) -> DataFrame:
    return docs.groupBy("source_key").agg(F.min("source").alias("source"), F.sum("size").alias("source_size"))


def cycling_weights(sources: DataFrame, cycle: tuple = (1, 2, 3)) -> DataFrame:
    """Weights dealt in turn to the sources in code-point order, null last: (source_key, weight)."""
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1  # one row for each source
    return sources.select("source_key", F.element_at(F.array(*[F.lit(w) for w in cycle]), (place % len(cycle) + 1)).alias("weight"))


def mixed_documents(docs: DataFrame, repeats: int = 3, seed: int = 0) -> DataFrame:
    """Whole documents of the mix, with the columns of ``docs``: a document comes once for each epoch of
    which the mix takes half its words or more. Repeated rows share their copies out evenly."""
    d = sized(docs)
    sources = frozen(by_source(d))
    stream = mix(d, source_targets(sources, cycling_weights(sources), repeats), repeats, seed)
    copies = stream.filter(F.col("taken") * 2 >= F.col("size")).groupBy("key").agg(F.count(F.lit(1)).alias("_copies"))
    alike = d.groupBy("key").agg(F.count(F.lit(1)).alias("_alike"))
    plan = copies.join(alike, "key").select("key", "_copies", "_alike")
    # the row as one struct, so that no column's name can clash with one used here
    out = docs.select(F.struct(*docs.columns).alias("doc"), content_key().alias("key")).join(plan, "key")
    nth = F.row_number().over(Window.partitionBy("key").orderBy(F.lit(0))) - 1
    mine = F.floor(F.col("_copies") / F.col("_alike")) + F.when(F.col("nth") < F.col("_copies") % F.col("_alike"), 1).otherwise(0)
    out = out.withColumn("nth", nth).withColumn("mine", mine.cast("int")).filter("mine > 0")
    return out.select("doc", F.explode(F.sequence(F.lit(1), F.col("mine")))).select("doc.*")
