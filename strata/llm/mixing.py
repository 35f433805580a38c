"""Mixing sources to target weights by Efraimidis-Spirakis sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata.llm.tables import materialize

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
BINS = 4096
WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, target, epochs, rest) from (source, source_size), one row per source.

    Sources take the weights in turn, by code point, null last. Together the targets come to the
    sum of all sizes; a target stops at max_epochs times its source and the excess is dealt to the
    others by weight, until none is above. That is target = min(cap, level * weight) with one
    level for all, found by sorting sources by cap / weight. Sources of size 0 get target 0.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    fill = Window.orderBy("ratio", F.col("source").isNull(), "source")
    before, after = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    table = (
        sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, map(float, weights))), (F.row_number().over(order) - 1) % len(weights) + 1))
        .withColumn("cap", F.col("source_size").cast("double") * max_epochs)
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumns({"total": F.sum("source_size").over(everything.orderBy(F.lit(0))), "capped": F.coalesce(F.sum("cap").over(before), F.lit(0.0)), "open": F.sum("weight").over(after)})
        .withColumn("level_here", (F.col("total") - F.col("capped")) / F.col("open"))
        .withColumn("level", F.max(F.when(F.col("level_here") <= F.col("ratio"), F.col("level_here"))).over(everything.orderBy(F.lit(0))))
    )
    target = F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap")))
    return (
        table.withColumn("target", target)
        .withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
        .withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
        .select("source", "source_size", "target", "epochs", "rest")
    )


def quality_weight(text) -> F.Column:
    """Between 0.05 and 1: the share of letters and spaces, so that debris is drawn later than prose."""
    bare = F.length(F.regexp_replace(text, r"[\p{L} \n]+", ""))
    return F.greatest(F.lit(0.05), F.lit(1.0) - F.coalesce(bare / F.nullif(F.length(text), F.lit(0)), F.lit(0.0)))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = "mix", bins: int = BINS) -> DataFrame:
    """(doc_id, source, print, size, source_size, target, copies, taken): how often the mix takes each row of docs.

    A document's key is Exp(1) / quality weight, from a hash of seed and id. Each source first
    takes all its documents as many times as its target holds it whole; then documents in order of
    key while their running size stays within the rest, the last one if that ends nearer to the
    target. Prefix sums run over bins of the key first, then inside each bin, so that a source of
    any size is spread over its bins. Null ids, texts (size 0) and sources (one source) are rows
    like others; rows that repeat one another share a key and are taken in an arbitrary but fixed order of
    equal rows. Only the id, text and source are read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.xxhash64(text).alias("print"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), quality_weight(text).alias("quality"))
    digest = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))))
    unit = (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)
    rows = rows.withColumn("key", -F.log(unit) / F.col("quality"))
    rows = materialize(rows.withColumn("bin", F.floor(F.col("key") / (1 + F.col("key")) * bins).cast("int")).drop("quality"), "mix-keys")

    per_bin = rows.groupBy("source", "bin").agg(F.sum("size").alias("bin_size"))
    sizes = per_bin.groupBy("source").agg(F.sum("bin_size").alias("source_size"))
    targets = source_targets(sizes, weights, max_epochs)
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    start = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_bin.withColumn("start", F.coalesce(F.sum("bin_size").over(start), F.lit(0)))
    starts = materialize(starts.join(targets, same(starts, targets), "left").drop(targets["source"]), "mix-bins")

    inside = Window.partitionBy("source", "bin").orderBy("key", "doc_id", "print").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("ahead", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = rows.join(starts, same(rows, starts) & (rows["bin"] == starts["bin"])).drop(starts["source"], starts["bin"])
    before = F.col("start") + F.col("ahead")
    drawn = (F.col("rest") > 0) & (before + F.col("size") / 2.0 <= F.col("rest"))
    return placed.withColumn("copies", F.col("epochs") + F.when(drawn, 1).otherwise(0)).select(
        "doc_id", "source", "print", "size", F.col("source_size").cast("long").alias("source_size"), "target", F.col("copies").cast("long").alias("copies"), (F.col("copies") * F.col("size")).cast("long").alias("taken")
    )


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """docs as the mix takes them: each row as many times as mix_sources says, in docs' own columns.

    Rows that repeat id, source and text share their copies, which are dealt to them in turn: their ranks are those
    inside a partition after the counts of the partitions before, so that no number of equal rows is one task.
    """
    plan = mix_sources(docs, id_col, text_col, source_col, **options)
    key = ["__strata_id", "__strata_source", "__strata_print"]
    plan = plan.groupBy(*(F.col(c).alias(k) for c, k in zip(("doc_id", "source", "print"), key, strict=True))).agg(F.sum("copies").alias("__strata_copies"), F.count(F.lit(1)).alias("__strata_rows"))
    marked = docs.withColumn("__strata_key", F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    joined = marked.join(plan, F.col(id_col).eqNullSafe(F.col(key[0])) & F.col(source_col).eqNullSafe(F.col(key[1])) & (F.col("__strata_key") == F.col(key[2])))
    joined = joined.where("__strata_copies > 0").drop("__strata_key")
    dealt = lambda df, n: df.withColumn("__strata_copy", F.explode(F.sequence(F.lit(1), n))).select(*docs.columns)
    single = dealt(joined.where("__strata_rows = 1"), F.col("__strata_copies").cast("int"))

    repeated = materialize(joined.where("__strata_rows > 1").withColumn("__strata_part", F.spark_partition_id()).withColumn("__strata_row", F.monotonically_increasing_id()), "mix-repeated")
    counts = repeated.groupBy(*key, "__strata_part").agg(F.count(F.lit(1)).alias("__strata_n"))
    earlier = Window.partitionBy(*key).orderBy("__strata_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*(F.col(c).alias(f"{c}_") for c in [*key, "__strata_part"]), F.coalesce(F.sum("__strata_n").over(earlier), F.lit(0)).alias("__strata_before"))
    same = F.lit(True)
    for c in [*key, "__strata_part"]:
        same = same & F.col(c).eqNullSafe(F.col(f"{c}_"))
    place = F.row_number().over(Window.partitionBy(*key, "__strata_part").orderBy("__strata_row")) + F.col("__strata_before")
    ranked = repeated.join(counts, same).withColumn("__strata_place", place)
    share = F.floor(F.col("__strata_copies") / F.col("__strata_rows")) + F.when(F.col("__strata_place") <= F.col("__strata_copies") % F.col("__strata_rows"), 1).otherwise(0)
    return single.unionByName(dealt(ranked.withColumn("__strata_share", share.cast("int")).where("__strata_share > 0"), F.col("__strata_share")))
