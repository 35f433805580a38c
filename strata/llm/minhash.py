"""Near-duplicate documents by min-max hashing.

A document's set is its distinct five-word shingles. Each permutation gives two signature values,
the set's smallest and its largest image, so half as many hash evaluations fill the bands. Documents
that share a band are compared on their full sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata.llm.graph import components
from strata.llm.tables import discard, materialize
from strata.llm.words import Words, bytes_of, mixed, portions, run_hashes, signed

SHINGLE = 5
THRESHOLD = 0.8
BANDS = 43
ROWS = 6


def shingle_sets(texts: pa.Array, shingle: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; of fewer words, the one of them all; none without words."""
    words = Words(*bytes_of(texts), lower=True)
    hashes, first = words.hashes(), words.first
    runs = run_hashes(hashes, shingle)
    out = []
    for i in range(len(texts)):
        n = first[i + 1] - first[i]
        if n >= shingle:
            own = np.sort(runs[first[i] : first[i + 1] - shingle + 1])
            own = own[np.concatenate(([True], own[1:] != own[:-1]))]
        else:
            own = run_hashes(hashes[first[i] : first[i + 1]], int(n)) if n else hashes[:0]
        out.append(own)
    return out


def band_keys(sets: list[np.ndarray], bands: int, rows: int) -> np.ndarray:
    """A row of band hashes for each set; sets are not empty."""
    rng = np.random.default_rng(11)
    n = -(-bands * rows // 2)
    factors, shifts = rng.integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, n, dtype=np.uint64)
    values, starts = np.concatenate(sets), np.cumsum([0, *map(len, sets[:-1])])
    signature = np.empty((2 * n, len(sets)), np.uint64)
    for i in range(n):
        image = values * factors[i] + shifts[i]
        signature[2 * i] = np.minimum.reduceat(image, starts)
        signature[2 * i + 1] = np.maximum.reduceat(image, starts)
    keys = np.zeros((bands, len(sets)), np.uint64)
    for j in range(rows):
        keys = mixed(keys * np.uint64(0x9E3779B97F4A7C15) + signature[j : bands * rows : rows])
    return mixed(keys + np.arange(1, bands + 1, dtype=np.uint64)[:, None]).T


def signatures(docs: DataFrame, id_col: str, text_col: str, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, print, node, n_shingles, bands): print is a hash of the text; node names the set itself; null without words."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in portions(whole, 2):
                sets = shingle_sets(batch.column(2), shingle)
                full = [i for i, s in enumerate(sets) if len(s)]
                keys = np.zeros((len(sets), bands), np.uint64)
                if full:
                    keys[full] = band_keys([sets[i] for i in full], bands, rows)
                nodes = [hashlib.blake2b(s.tobytes(), digest_size=16).hexdigest() if len(s) else None for s in sets]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * bands), signed(keys.ravel()))
                sizes = pa.array([len(s) for s in sets], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(nodes, pa.string()), sizes, lists], ["doc_id", "print", "node", "n_shingles", "bands"])

    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col), F.xxhash64(text_col), F.col(text_col).cast("string"))
    return texts.mapInArrow(sign, f"doc_id {kind}, print long, node string, n_shingles long, bands array<long>")


def _sets(docs: DataFrame, id_col: str, text_col: str, wanted: DataFrame, shingle: int) -> DataFrame:
    """(nid, elements) of the wanted (nid, node, rep): the text of a row whose id is rep, shingled again."""

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in portions(whole, 0):
                sets = shingle_sets(batch.column(0), shingle)
                ends = np.cumsum([0, *map(len, sets)], dtype=np.int32)
                nodes = [hashlib.blake2b(s.tobytes(), digest_size=16).hexdigest() if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.string()), pa.ListArray.from_arrays(pa.array(ends), signed(np.concatenate(sets)))], ["node", "elements"])

    ids = wanted.select(F.col("rep").alias("__strata_rep")).distinct()
    texts = docs.join(ids, F.col(id_col).eqNullSafe(F.col("__strata_rep")), "left_semi").select(F.col(text_col).cast("string"))
    found = texts.mapInArrow(shingled, "node string, elements array<long>")
    return found.join(wanted.select("nid", "node"), "node").select("nid", "elements").dropDuplicates(["nid"])


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union."""
    with_b = pairs.join(sets.select(F.col("nid").alias("b"), F.col("elements").alias("set_b")), "b")
    with_both = with_b.join(sets.select(F.col("nid").alias("a"), F.col("elements").alias("set_a")), "a")
    common = F.size(F.array_intersect("set_a", "set_b")).cast("long")
    return with_both.select("a", "b", common.alias("common"), (F.size("set_a") + F.size("set_b") - common).alias("either")).where(F.col("common") * 100 >= F.col("either") * percent).select("a", "b")


def _between(held: DataFrame, first: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Components (a, b) of the first round, by their roots, between which nodes of one bucket are linked.

    Both nodes were compared with their bucket's hub H. Let D(A) be the symmetric difference of A
    and H; then A and B differ by as much as D(A) and D(B) do. Linked sets differ by at most
    share * (|A| + |B|), share = (1 - t) / (1 + t), and |B| <= |A| / t. So all but a few elements
    of D(A) are in D(B), and the two share one among their rarest few: a prefix of D(A), in the order of how
    many nodes of the hub have an element. Its length is the least that holds for A's partners:
    any: share * |A| * (1 + 1/t) + 1. If one of both is not linked with H: they share (1 - share) * |D| / 2
    elements of each D of a partner not linked (and, of one that is linked, of its own D).
    Only nodes that meet in a prefix are compared, on D, and only if from the element where they meet
    on enough elements are left on either side. This is exact: the first element that linked sets
    share passes.
    """
    t = percent / 100
    share = (1 - t) / (1 + t)
    rooted = held.join(first.withColumnRenamed("node", "nid"), "nid", "left").select("key", "hub", "nid", F.coalesce("root", "nid").alias("root"))
    rooted = materialize(rooted, "rooted")
    open_keys = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key")
    members = rooted.join(open_keys, "key").where("nid <> hub").select("hub", "nid", "root").distinct()
    own = sets.select("nid", F.col("elements").alias("own"))
    hub = sets.select(F.col("nid").alias("hub"), F.col("elements").alias("theirs"))
    both = members.join(own, "nid").join(hub, "hub")
    apart = F.concat(F.array_except("own", "theirs"), F.array_except("theirs", "own"))
    apart = both.select("hub", "nid", "root", F.size("own").cast("long").alias("n"), F.size("theirs").cast("long").alias("n_hub"), apart.alias("apart"))
    gap = F.size("apart").cast("long")
    # |A & H| = (|A| + |H| - |D|) / 2 and |A | H| = (|A| + |H| + |D|) / 2
    near = (F.col("n") + F.col("n_hub") - gap) * 100 >= (F.col("n") + F.col("n_hub") + gap) * percent
    any_partner = F.floor(share * F.col("n") * (1 + 1 / t) + 1e-6) + 1
    half = gap - F.ceil((1 - share) * gap / 2 - 1e-6) + 1
    excess = gap - F.greatest(F.ceil((gap - share * (F.col("n") + F.col("n_hub"))) / 2 - 1e-6), F.lit(1)) + 1
    apart = apart.withColumns({"near": near, "short": F.least(any_partner, half), "long": F.when(near, F.lit(0)).otherwise(F.least(any_partner, excess))})
    apart = materialize(apart, "apart")

    entries = apart.select("hub", "nid", "root", "n", "near", "short", "long", F.size("apart").alias("gap"), F.explode("apart").alias("element"))
    often = entries.groupBy("hub", "element").agg(F.count(F.lit(1)).alias("often")).where("often > 1")
    often = materialize(often, "often")
    entries = entries.join(often, ["hub", "element"], "left").withColumn("often", F.coalesce("often", F.lit(1)))
    place = F.row_number().over(Window.partitionBy("hub", "nid").orderBy("often", "element"))
    entries = entries.withColumn("place", place).where((F.col("often") > 1) & (F.col("place") <= F.greatest("short", "long")))
    rest = F.col("gap") - F.col("place") + 1
    entries = entries.withColumns({"in_short": F.col("place") <= F.col("short"), "in_long": F.col("place") <= F.col("long"), "rest": rest})
    entries = materialize(entries.select("hub", "element", "nid", "root", "n", "near", "gap", "in_short", "in_long", "rest"), "prefixes")
    a = entries.where("not near").select("hub", "element", F.col("nid").alias("a"), F.col("root").alias("root_a"), F.col("n").alias("n_a"), F.col("gap").alias("gap_a"), F.col("rest").alias("rest_a"), F.col("in_short").alias("short_a"), F.col("in_long").alias("long_a"))
    b = entries.where("in_short").select("hub", "element", F.col("nid").alias("b"), F.col("root").alias("root_b"), F.col("n").alias("n_b"), F.col("gap").alias("gap_b"), F.col("rest").alias("rest_b"), "near")
    common = (F.col("gap_a") + F.col("gap_b") - share * (F.col("n_a") + F.col("n_b"))) / 2 - 1e-6  # what linked sets share at least
    met = a.join(b, ["hub", "element"]).where(
        (F.col("root_a") != F.col("root_b")) & (F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent)
        & (F.least("rest_a", "rest_b") >= common)
        & F.when(F.col("near"), F.col("long_a")).otherwise(F.col("short_a") & (F.col("a") < F.col("b")))
    )
    met = met.select("hub", "a", "b").distinct()
    of = lambda x: apart.select("hub", F.col("nid").alias(x), F.col("root").alias(f"root_{x}"), F.col("n").alias(f"n_{x}"), F.col("apart").alias(f"apart_{x}"))
    compared = met.join(of("a"), ["hub", "a"]).join(of("b"), ["hub", "b"])
    gap = F.size("apart_a") + F.size("apart_b") - 2 * F.size(F.array_intersect("apart_a", "apart_b"))
    total = F.col("n_a") + F.col("n_b")
    found = compared.select(F.col("root_a").alias("a"), F.col("root_b").alias("b"), total.alias("total"), gap.alias("gap"))
    found = found.where((F.col("total") - F.col("gap")) * 100 >= (F.col("total") + F.col("gap")) * percent)
    found = materialize(found.select("a", "b").distinct(), "links")
    for done in (rooted, apart, often, entries):
        discard(done)
    return found


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), a row for each row of docs.

    Rows of equal sets are one node from the start. Nodes that share a band are first compared with
    the node of their bucket that shares most bands with others; what this links is one
    component, inside which nothing is left to find. Nodes of different components are then compared
    if their differences from that node leave a link possible (see _between), so no link between
    components is lost and groups of copies are never expanded into pairs.

    Texts without words (null, empty, blank) link with nothing. component_id is the smallest id
    of the component; null ids count as larger than all, and a component of only such has null.
    Of rows that repeat the smallest id, each is kept. Only the id and the text are read.
    """
    return _classified(docs, id_col, text_col, threshold, shingle, bands, rows).drop("print")


def _classified(docs: DataFrame, id_col: str, text_col: str, threshold: float = THRESHOLD, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """near_duplicates with the hash of each row's text."""
    percent = round(threshold * 100)
    signed_rows = materialize(signatures(docs, id_col, text_col, shingle, bands, rows), "signatures")
    nodes = signed_rows.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    nodes = materialize(nodes.withColumn("nid", F.monotonically_increasing_id()), "nodes")
    signed_rows, whole = materialize(signed_rows.drop("bands"), "rows"), signed_rows
    discard(whole)
    held = nodes.select("nid", "n", F.explode("bands").alias("key"))
    shared = held.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    held = materialize(held.join(shared, "key"), "buckets")

    degree = held.groupBy("nid").agg(F.sum("size").alias("degree"))
    hubs = held.join(degree, "nid").groupBy("key").agg(F.max(F.struct("degree", "nid")).getField("nid").alias("hub"))
    stars = materialize(held.join(hubs, "key").where("nid <> hub").select(F.col("hub").alias("a"), F.col("nid").alias("b"), F.col("n").alias("n_b")).distinct(), "stars")
    stored, stars = stars, stars.join(nodes.select(F.col("nid").alias("a"), F.col("n").alias("n_a")), "a").where(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent).select("a", "b")
    sets = materialize(_sets(docs, id_col, text_col, held.select("nid").distinct().join(nodes, "nid").select("nid", "node", "rep"), shingle), "sets")
    links = materialize(_linked(stars, sets, percent), "links")
    discard(stored)
    first = components(links)

    more = _between(held.join(hubs, "key"), first, sets, percent)

    discard(held)
    discard(sets)
    joined = components(more).select(F.col("node").alias("own"), "root")  # of components, not of nodes: few where the hubs found most
    owned = nodes.join(first.select(F.col("node").alias("nid"), F.col("root").alias("own")), "nid", "left").select("node", "rep", F.coalesce("own", "nid").alias("own"))
    ids = owned.join(joined, "own", "left").select("node", "rep", F.coalesce("root", "own").alias("root"))
    lowest = ids.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = materialize(ids.join(lowest, "root").select("node", "component_id"), "components")
    for done in (nodes, links, more):
        discard(done)
    return signed_rows.select("doc_id", "print", "node", "n_shingles").join(named, "node", "left").select(
        "doc_id", "print", "n_shingles", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.when(F.col("node").isNull(), True).otherwise(F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("kept"),
    )


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs without the rows that near_duplicates doesn't keep, in docs' own columns; rows that repeat an id are told apart by their texts."""
    kept = _classified(docs, id_col, text_col, **options).where("kept").select(F.col("doc_id").alias("__strata_id"), F.col("print").alias("__strata_print"))
    marked = docs.withColumn("__strata_key", F.xxhash64(text_col))
    return marked.join(kept, F.col(id_col).eqNullSafe(F.col("__strata_id")) & (F.col("__strata_key") == F.col("__strata_print")), "left_semi").select(*docs.columns)
