"""Mixing sources to target weights by distributed prefix sums.

Every document gets a hash-random key, which is the hash of its id alone; ties go by
id, size, a digest of the text, and, between rows that are equal in all of these, a
number. All rows are range-sorted by source and this order, so a source or an id of any
share of the rows is spread over many ranges. Sums of ranges give the words before a
range, and a window inside a range the words before a document; only narrow rows are
sorted. A source whose target is above its size is repeated in whole epochs, and the
last one is cut at the exact word.

Edge cases: a null text has size 0 and gives no words; null is a source of its
own, last in order; repeated rows are mixed each; a source without words has target
0; an empty table gives an empty result. The same rows give the same mix, however they
are read: rows that only a number parts are equal in id, source and text. (Columns in
``keep`` may differ in such rows; which of them gets which share is then open.)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import numbered, renamed, stored, word_count, words

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = "mix-1"
KEY_BITS = 60
#: Rows that a range should hold at most.
ROWS_A_RANGE = 50_000


def _lined(df: DataFrame, order: list[Column], name: str) -> tuple[DataFrame, Column, Column]:
    """``df`` in order, by ranges; stored. Also each row's range and its place inside it."""
    lined = df.repartitionByRange(*order).sortWithinPartitions(*order)
    lined = stored(lined.select("*", F.monotonically_increasing_id().alias("_id")), name)
    return lined, F.shiftright("_id", 33), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))


def _sums(df: DataFrame, part: Column, **what: Column) -> DataFrame:
    """What the ranges before each range (``part``) sum up to; one row a range, of which there are as many as tasks."""
    sums = df.groupBy(part.alias("part")).agg(*[c.cast("long").alias(n) for n, c in what.items()]).orderBy("part").collect()
    rows, total = [], [0] * len(what)
    for r in sums:
        rows.append((r["part"], *total))
        total = [t + (r[n] or 0) for t, n in zip(total, what, strict=True)]
    kind = "part long, " + ", ".join(f"{n} long" for n in what)
    return F.broadcast(df.sparkSession.createDataFrame(rows, kind))


def ranked_sources(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """``sizes`` (source, source_size) with the weight of each source's place in order."""
    lined, part, inside = _lined(sizes, [F.col("source").asc_nulls_last()], "sources")
    placed = lined.withColumn("part", part).join(_sums(lined, part, before=F.count("*")), "part")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.col("before") + inside) % len(weights) + 1).cast("int"))
    return placed.select("source", "source_size", weight.alias("weight"))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = MAX_EPOCHS) -> DataFrame:
    """Add weight and target to ``sizes`` (source, source_size), one row a source.

    Sources in code-point order (null last) take the weights in turn. The words
    of all sources are shared by weight; a source stops at ``cap`` times its
    size and what it leaves is shared again. Sources stop in the order of their
    size by weight, so prefix sums in this order tell the first that does not stop, and
    with it the share of all that do not.
    """
    ranked = ranked_sources(sizes, weights)
    ratio = [(F.col("source_size") / F.col("weight")).asc(), F.col("source").asc_nulls_last()]
    lined, part, _ = _lined(ranked, ratio, "source-order")
    most = cap * F.col("source_size")
    total = lined.agg(F.sum("source_size").alias("words"), F.sum("weight").alias("weight")).first()
    before = Window.partitionBy("part").orderBy("_id").rowsBetween(Window.unboundedPreceding, -1)
    told = lined.withColumn("part", part).withColumns({"full": F.coalesce(F.sum(most).over(before), F.lit(0)), "used": F.coalesce(F.sum("weight").over(before), F.lit(0))})
    told = told.join(_sums(lined, part, full_before=F.sum(most), used_before=F.sum("weight")), "part")
    rest = (F.lit(total["words"] or 0) - F.col("full") - F.col("full_before")).cast("double")
    share = rest / (F.lit(total["weight"] or 0) - F.col("used") - F.col("used_before")).cast("double")
    goes_on = told.select("_id", share.alias("share"), most.alias("most"), "weight").filter(~(F.col("most") <= F.col("share") * F.col("weight")))
    first = goes_on.agg(F.min(F.struct("_id", "share")).alias("x")).first()["x"]
    if first is None:
        return ranked.select("*", most.cast("double").alias("target"))
    target = F.when(F.col("_id") < first["_id"], most.cast("double")).otherwise(F.lit(first["share"]) * F.col("weight"))
    return lined.select("source", "source_size", "weight", target.alias("target"))


def mix_sources(
    df: DataFrame,
    key: str = "doc_id",
    source: str = "source",
    text: str = "text",
    keep: tuple[str, ...] = (),
    weights: tuple[int, ...] = WEIGHTS,
    cap: int = MAX_EPOCHS,
) -> DataFrame:
    """``key``, ``source``, the (narrow) columns in ``keep``, size, source_size, target, taken."""
    names = [key, source, *[c for c in keep if c not in (key, source)]]
    hashed = lambda value: F.conv(F.substring(F.md5(value), 1, KEY_BITS // 4), 16, 10).cast("long")
    sized = df.select(
        *names, word_count(F.col(text)).alias("size"), hashed(F.concat(F.lit(SEED), F.coalesce(F.col(key).cast("string"), F.lit("")))).alias("_key"),
        hashed(F.coalesce(F.col(text), F.lit(""))).alias("_text"),
    )
    sized = stored(sized, "mix-sizes").withColumn("_tie", F.monotonically_increasing_id())
    order = [F.col(source).asc_nulls_last(), F.col("_key"), F.col(key), F.col("size"), F.col("_text"), F.col("_tie")]
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-sized.count() // ROWS_A_RANGE))
    placed = stored(sized.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()), "mix-order")
    ranges = stored(placed.groupBy(F.col(source).alias("source"), "_range").agg(F.sum("size").alias("n")), "mix-ranges")
    targets = source_targets(ranges.groupBy("source").agg(F.sum("n").alias("source_size")), weights, cap)
    earlier = Window.partitionBy("source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    bases = ranges.select(F.col("source").alias("_s"), F.col("_range").alias("_r"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_base"))
    bases = bases.join(targets, bases["_s"].eqNullSafe(targets["source"])).drop("source")
    budget = F.floor(F.col("target") + 0.5).cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    bases = bases.select("*", epochs.alias("_epochs"), (budget - epochs * F.col("source_size")).alias("_cut"))
    inside = Window.partitionBy(source, "_range").orderBy("_key", key, "size", "_text", "_tie").rowsBetween(Window.unboundedPreceding, -1)
    running = placed.withColumn("_inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    out = running.join(bases, running[source].eqNullSafe(bases["_s"]) & (running["_range"] == bases["_r"]))
    part = F.greatest(F.lit(0), F.least("size", F.col("_cut") - F.col("_base") - F.col("_inside")))
    return out.select(*names, "size", "source_size", "target", (F.col("_epochs") * F.col("size") + part).alias("taken"))


def mixed_documents(df: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """The mix itself: ``df``'s rows, repeated and cut as ``taken`` says.

    A cut copy holds the first words of its text, joined by single spaces. Only
    narrow rows are placed; the texts are shuffled once, to meet their shares.
    """
    plain, names = renamed(df)
    rows = numbered(plain, names[key])
    mix = stored(mix_sources(rows, "_row", names[source], names[text]).select("_row", "size", "taken"), "mix-shares")
    whole = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size"))).otherwise(0).cast("int")
    rest = (F.col("taken") - whole * F.col("size")).cast("int")
    copies = F.when(whole > 0, F.array_repeat(F.lit(0), whole)).otherwise(F.array().cast("array<int>"))
    copies = F.concat(copies, F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<int>")))
    cut = F.when(F.col("_n") > 0, F.array_join(F.slice(words(F.col(names[text])), F.lit(1), F.greatest(F.col("_n"), F.lit(1))), " ")).otherwise(F.col(names[text]))
    spread = rows.join(mix, "_row").withColumn("_n", F.explode(copies))
    return spread.select(*[(cut if new == names[text] else F.col(new)).alias(old) for old, new in names.items()])
