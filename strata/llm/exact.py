"""Exact deduplication by deterministic block naming, in DataFrame functions only.

Each normalised text is cut into blocks of a fixed size. Distinct blocks are sorted into integer
names; then adjacent pairs of names are named in the same way, level by level, until each document
has one name. Names stand for contents themselves, not for hashes of them, so two documents share
(number of blocks, name) exactly if their normalised texts are equal.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.tables import discard, materialize

SPACE = r"[\x20\x09-\x0D]+"
BLOCK_CHARS = 4096


def _blocks(docs: DataFrame, id_col: str, text_col: str, block_chars: int) -> DataFrame:
    """(id, sha, points, idx, n_blocks, block): a row for each block; an empty text has one empty block."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return (
        docs.select(F.col(id_col).alias("id"), F.length(text).alias("points"), F.regexp_replace(text, SPACE, "").alias("norm"))
        .select("id", "points", F.sha2("norm", 256).alias("sha"), F.regexp_extract_all("norm", F.lit(f"(?s).{{1,{block_chars}}}"), F.lit(0)).alias("blocks"))
        .select("id", "points", "sha", F.greatest(F.size("blocks"), F.lit(1)).alias("n_blocks"), F.posexplode_outer("blocks").alias("idx", "block"))
        .select("id", "points", "sha", "n_blocks", F.coalesce("idx", F.lit(0)).alias("idx"), F.coalesce("block", F.lit("")).alias("block"))
    )


def _named(distinct: DataFrame, by: list[str]) -> DataFrame:
    """An integer name for each row of distinct: its rank in its sorted partition, after the partition's number."""
    return distinct.sortWithinPartitions(*by).withColumn("name", F.monotonically_increasing_id())


def name_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per row of docs: (row_id, id, sha, points, n_blocks, name); equal (n_blocks, name) = equal normalised text.

    Null texts count as empty. Rows that repeat an id stay apart by row_id. Block contents are
    shuffled once, reduced to their distinct values on the map side; afterwards a block travels as
    a 64-bit fingerprint. Should two different blocks share a fingerprint, the blocks concerned
    are matched by their contents instead.
    """
    blocks = _blocks(docs, id_col, text_col, block_chars).withColumn("print", F.xxhash64("block"))
    distinct = _named(blocks.select("print", "block").distinct(), ["block"])
    names = materialize(distinct.select("print", "name"), "block-names")
    slim = blocks.select("id", "sha", "points", "n_blocks", "idx", "print")
    shared = names.groupBy("print").count().where("count > 1").select("print")
    if shared.isEmpty():
        level = slim.join(names, "print").drop("print")
    else:
        shared = materialize(shared, "shared-prints")
        content = blocks.join(F.broadcast(shared), "print")
        again = materialize(_named(content.select("block").distinct(), ["block"]).withColumn("name", -1 - F.col("name")), "block-names")
        level = slim.join(shared, "print", "left_anti").join(names, "print").drop("print").unionByName(content.join(again, "block").drop("print", "block"))
    level = materialize(level.withColumn("row_id", F.monotonically_increasing_id()), "level-0")

    rows = level.where("idx = 0").select("row_id", "id", "sha", "points", "n_blocks", "name")
    left, width, last = level.where("n_blocks > 1").select("id", "sha", "n_blocks", "idx", "name"), 1, level.agg(F.max("n_blocks")).first()[0] or 1
    done: list[DataFrame] = []
    while width < last:
        width *= 2
        even = F.col("idx") % 2 == 0
        pairs = (
            left.groupBy("id", "sha", "n_blocks", F.shiftright("idx", 1).alias("idx"))
            .agg(F.max(F.when(even, F.col("name"))).alias("l"), F.coalesce(F.max(F.when(~even, F.col("name"))), F.lit(-1)).alias("r"))
        )
        pairs = materialize(pairs, "pairs")
        names = materialize(_named(pairs.select("l", "r").distinct(), ["l", "r"]), "pair-names")
        level = materialize(pairs.join(names, ["l", "r"]).drop("l", "r"), "level")
        discard(pairs)
        discard(names)
        done.append(level.where(F.col("n_blocks") <= width).drop("idx"))
        left = level.where(F.col("n_blocks") > width)
    if not done:
        return rows
    whole = done[0]
    for part in done[1:]:
        whole = whole.unionByName(part)
    whole = whole.select(F.col("id").alias("id_"), F.col("sha").alias("sha_"), F.col("name").alias("whole"))
    many = rows.where("n_blocks > 1").join(whole, F.col("id").eqNullSafe(F.col("id_")) & (F.col("sha") == F.col("sha_")))
    return rows.where("n_blocks = 1").unionByName(many.drop("name", "id_", "sha_").withColumnRenamed("whole", "name"))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Groups of equal texts, whitespace aside: (doc_id, keep_id, group_size, kept, text_sha256, n_points), a row per row of docs.

    Of a group, the row of the most code points stays, then the smallest id (null ids last), then
    one of the rows that repeat both. An empty table gives an empty result; null and empty texts
    form one group; other columns of docs are not read.
    """
    rows = materialize(name_documents(docs, id_col, text_col, block_chars), "named")
    key = ["n_blocks", "name"]
    order = F.struct(-F.col("points"), F.col("id").isNull().alias("no_id"), "id", "row_id")
    groups = materialize(rows.groupBy(*key).agg(F.min(order).alias("best"), F.count(F.lit(1)).alias("group_size")).where("group_size > 1"), "groups")
    found = rows.join(groups, key, "left")
    alone = F.col("group_size").isNull()
    return found.select(
        F.col("id").alias("doc_id"),
        F.when(alone, F.col("id")).otherwise(F.col("best.id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("best.row_id") == F.col("row_id"))).alias("kept"),
        F.col("sha").alias("text_sha256"),
        F.col("points").cast("long").alias("n_points"),
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that exact_duplicates drops, in docs' own columns."""
    kept = exact_duplicates(docs, id_col, text_col).where("kept").select(F.col("doc_id").alias("__strata_id"), F.col("text_sha256").alias("__strata_sha"), F.col("n_points").alias("__strata_points"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    marked = docs.withColumns({"__strata_key_sha": F.sha2(F.regexp_replace(text, SPACE, ""), 256), "__strata_key_points": F.length(text).cast("long"), "__strata_key_id": F.col(id_col)})
    same = F.col("__strata_key_id").eqNullSafe(F.col("__strata_id")) & (F.col("__strata_key_sha") == F.col("__strata_sha")) & (F.col("__strata_key_points") == F.col("__strata_points"))
    return marked.join(kept, same, "left_semi").dropDuplicates(["__strata_key_id", "__strata_key_sha", "__strata_key_points"]).select(*docs.columns)
