"""Near-duplicate embeddings by Euclidean p-stable hashing.

Vectors are scaled to length 1. In each of several tables, random Gaussian projections are shifted,
cut into cells of width CELL and joined into a bucket key; vectors that share a bucket of any table
are compared by exact cosine. How many projections and tables there are follows from the number of
vectors: a bucket holds about CROWD unrelated ones at any size, and a pair at the threshold is missed by all
tables with probability MISS.

Pairs are never rows: a pair counts in the first table whose bucket it shares, so each comparison
of a bucket gives the number of links of its vectors, and a forest of links that connects what they connect.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from strata.llm.graph import components
from strata.llm.tables import discard, materialize
from strata.llm.words import mixed, released

THRESHOLD = 0.9
CELL, FILL, MISS = 2.5, 20, 0.002
CROWD = 512  # unrelated vectors of a bucket in near_embeddings: comparing them costs less than the tables that emptier buckets need
TILE = 8192  # vectors of a bucket that one comparison holds on either side
BLOCK = 1024  # of which one matrix product takes this many
ROUND_BYTES = 256 << 20  # rows that the tables of a round send
HELD = 1 << 20  # counts that a task holds before it adds them up


def cell_share(distance: float, cell: float) -> float:
    """The probability that two vectors at a distance share a projection's cell."""
    r = cell / distance
    return math.erf(r / math.sqrt(2)) - math.sqrt(2 / math.pi) / r * (1 - math.exp(-r * r / 2))


def projections_and_tables(n: int, threshold: float = THRESHOLD, cell: float = CELL, fill: float = FILL, miss: float = MISS) -> tuple[int, int]:
    """How many projections a key joins, and how many tables there are, for n vectors."""
    near, far = cell_share(math.sqrt(2 - 2 * threshold), cell), cell_share(math.sqrt(2), cell)
    projections = max(1, math.ceil(math.log(max(n, fill) / fill) / -math.log(far)))
    return projections, math.ceil(math.log(miss) / math.log(1 - near**projections))


def _vectors(batch: pa.RecordBatch, column: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Rows of batch with a usable vector and these vectors."""
    lists = batch.column(column)
    flat = lists.flatten()
    ends = np.cumsum([0, *(len(x) if x.is_valid else 0 for x in lists)])
    values = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)  # nulls become NaN
    sizes = np.diff(ends)
    usable = [i for i in range(len(sizes)) if sizes[i] and np.isfinite(v := values[ends[i] : ends[i + 1]]).all() and v.any()]
    return np.array(usable, np.int64), [values[ends[i] : ends[i + 1]] for i in usable]


def _units(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(1, keepdims=True)  # keeps squares of very large or small components finite
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def with_keys(nodes: DataFrame, vector_col: str, projections: int, tables: int, cell: float = CELL, seed: int = 17) -> DataFrame:
    """nodes with keys array<int>, a key for each table; null where the vector can't be used."""
    column = nodes.columns.index(vector_col)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drawn: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        with released():
            for whole in batches:
                for at in range(0, whole.num_rows, 1024):
                    batch = whole.slice(at, 1024)
                    usable, found = _vectors(batch, column)
                    signed = np.zeros((batch.num_rows, tables), np.int32)
                    for size in sorted({len(v) for v in found}):
                        if size not in drawn:
                            rng = np.random.default_rng([seed, size])
                            drawn[size] = rng.normal(size=(size, tables * projections)), rng.uniform(0, cell, tables * projections)
                        of = [k for k, v in enumerate(found) if len(v) == size]
                        unit = _units(np.stack([found[k] for k in of]))
                        cells = np.floor((unit @ drawn[size][0] + drawn[size][1]) / cell).astype(np.int64).view(np.uint64).reshape(len(of), tables, projections)
                        keys = np.full((len(of), tables), size, np.uint64)
                        for j in range(projections):
                            keys = mixed(keys * np.uint64(0x9E3779B97F4A7C15) + cells[:, :, j])
                        signed[usable[of]] = (keys >> np.uint64(32)).astype(np.uint32).view(np.int32)
                    missing = np.ones(batch.num_rows, bool)
                    missing[usable] = False
                    ends = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * tables)
                    lists = pa.ListArray.from_arrays(ends, pa.array(signed.ravel()), mask=pa.array(missing))
                    yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*batch.schema.names, "keys"])

    return nodes.mapInArrow(sign, StructType([*nodes.schema.fields, StructField("keys", ArrayType(IntegerType()))]))


def _forest(at: np.ndarray, bt: np.ndarray, n: int) -> np.ndarray:
    """For each of n nodes the smallest that the links at - bt lead to."""
    low = np.arange(n)
    while True:
        ends = np.minimum(low[at], low[bt])
        new = low.copy()
        for x in (at, bt, low[at], low[bt]):
            np.minimum.at(new, x, ends)
        new = new[new]
        if (new == low).all():
            return low
        low = new


class _Side:
    """The vectors of one part of a bucket: ids, how many rows each stands for, single-precision units and keys of the tables before."""

    def __init__(self, place: int, width: int, parts: list[pa.RecordBatch]):
        column = lambda k: np.concatenate([p.column(k).to_numpy() for p in parts])
        nested = lambda k, size: np.concatenate([p.column(k).flatten().to_numpy() for p in parts]).reshape(-1, size)
        self.part, self.ids, self.weights = (column(k) for k in (5, 6, 7))
        self.units = _units(nested(8, width).astype(np.float64)).astype(np.float32)
        self.keys = nested(9, place) if place else np.empty((len(self.ids), 0), np.int32)

    def of(self, part: int) -> _Side:
        side, chosen = object.__new__(_Side), self.part == part
        for name, value in vars(self).items():
            setattr(side, name, value[chosen])
        return side


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, list[pa.RecordBatch]]]:
    """The rows of each cell (place, key, width, i, j), from batches sorted by these."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        of = np.stack([batch.column(k).to_numpy() for k in range(5)], 1)
        borders = [0, *(np.flatnonzero((of[1:] != of[:-1]).any(1)) + 1), len(of)]
        for start, end in pairwise(borders):
            if held and (of[start] != last).any():
                yield last, held
                held = []
            held.append(batch.slice(start, end - start))
            last = of[start]
    if held:
        yield last, held


def _compared(cells: DataFrame, threshold: float) -> DataFrame:
    """Rows (a, b, n) from (place, key, width, i, j, part, nid, weight, vector, keys), sorted by the first five: links
    of part i of a bucket with its part j, or inside it where they are one.

    n > 0: vector a has links to n rows, in sum over all rows of a. n = 0: a link, of a forest that connects
    what links connect. n = -1: a pair too near the threshold for single precision.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        rows: list[tuple[np.ndarray, np.ndarray, int]] = []
        size = waiting = 0
        with released():
            for (place, _, width, i, j), parts in _cells(batches):
                if sum(p.num_rows for p in parts) < 2:
                    continue
                a = b = _Side(place, width, parts)
                if i != j:
                    a, b = a.of(i), b.of(j)
                links_a, links_b = np.zeros(len(a.ids)), np.zeros(len(b.ids))
                ids, shift = (a.ids, 0) if i == j else (np.concatenate([a.ids, b.ids]), len(a.ids))
                children, lows = [], []
                for at, bt, sure in _pairs(a, b, threshold):
                    if not sure.all():
                        rows.append((a.ids[at[~sure]], b.ids[bt[~sure]], -1))
                        waiting += len(rows[-1][0])
                        at, bt = at[sure], bt[sure]
                    links_a += np.bincount(at, b.weights[bt], len(a.ids))
                    links_b += np.bincount(bt, a.weights[at], len(b.ids))
                    low = _forest(at, bt + shift, len(ids))
                    children.append(np.flatnonzero(low != np.arange(len(low))))
                    lows.append(low[children[-1]])
                if children:
                    low = _forest(np.concatenate(children), np.concatenate(lows), len(ids))
                    child = np.flatnonzero(low != np.arange(len(low)))
                    rows.append((ids[child], ids[low[child]], 0))
                    waiting += len(child)
                    held += [(a.ids, links_a), (b.ids, links_b)]
                    size += len(a.ids) + len(b.ids)
                if size > HELD:
                    held = [_added(held)]
                    size = len(held[0][0])
                    if size > HELD // 2:
                        yield _row(held[0][0], None, held[0][1])
                        held, size = [], 0
                if waiting > HELD // 16:
                    yield from (_row(*x) for x in _joined(rows))
                    rows, waiting = [], 0
            yield from (_row(*x) for x in _joined(rows))
            if held:
                ids, n = _added(held)
                yield _row(ids, None, n)

    return cells.mapInArrow(compare, "a long, b long, n long")


def _pairs(a: _Side, b: _Side, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places of linked vectors in a and b that share no earlier bucket, and whether single precision is sure of them; block by block."""
    rounding = (a.units.shape[1] + 4) * 2.0**-23
    for s in range(0, len(a.ids), BLOCK):
        for t in range(s if a is b else 0, len(b.ids), BLOCK):
            cosines = a.units[s : s + BLOCK] @ b.units[t : t + BLOCK].T
            at, bt = np.nonzero(cosines >= threshold - rounding)
            sure = cosines[at, bt] >= threshold + rounding
            at, bt = at + s, bt + t
            kept = at < bt if a is b else np.ones(len(at), bool)
            for table in range(a.keys.shape[1]):
                if not kept.any():
                    break
                at, bt, sure = at[kept], bt[kept], sure[kept]
                kept = a.keys[at, table] != b.keys[bt, table]
            if kept.any():
                yield at[kept], bt[kept], sure[kept]


def _joined(rows: list[tuple[np.ndarray, np.ndarray, int]]) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    for sort in (-1, 0):
        if found := [x for x in rows if x[2] == sort]:
            yield np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found]), sort


def _added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    ids, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    found, inverse = np.unique(ids[n > 0], return_inverse=True)
    return found, np.bincount(inverse, n[n > 0], len(found))


def _row(a: np.ndarray, b: np.ndarray | None, n) -> pa.RecordBatch:
    others = pa.nulls(len(a), pa.int64()) if b is None else pa.array(b)
    return pa.RecordBatch.from_arrays([pa.array(a), others, pa.array(np.broadcast_to(n, len(a)).astype(np.int64))], ["a", "b", "n"])


def _decided(pairs: DataFrame, threshold: float) -> DataFrame:
    """(a, b) of (a, b, left, right) where the vectors left and right have a cosine of threshold in double precision."""

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = (_vectors(batch, k)[1] for k in (2, 3))
            near = [bool((_units(x[None]) * _units(y[None])).sum() >= threshold) for x, y in zip(left, right, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    return pairs.select("a", "b", "left", "right").mapInArrow(decide, "a long, b long")


def _round(usable: DataFrame, first: int, last: int, threshold: float, tile: int) -> DataFrame:
    """_compared of the buckets of tables first to last - 1."""
    bucket, cell = ["place", "key", "width"], ["place", "key", "width", "i", "j"]
    placed = usable.withColumn("place", F.explode(F.sequence(F.lit(first), F.lit(last - 1)))).withColumn("key", F.element_at("keys", F.col("place") + 1))
    large = placed.groupBy(*bucket).agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("parts")).where("parts > 1")
    placed = placed.join(F.broadcast(large), bucket, "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    placed = placed.withColumn("part", F.pmod(F.xxhash64("nid"), "parts").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cells = placed.select(*bucket, F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "nid", "weight", "vector", F.slice("keys", 1, F.col("place")).alias("keys"))
    return _compared(cells.repartition(*map(F.col, cell)).sortWithinPartitions(*cell), threshold)


def near_embeddings(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD, tile: int = TILE, miss: float = MISS) -> DataFrame:
    """(vec_id, n_links, component_id, kept), a row for each row of vectors.

    Equal vectors are one node from the start, with their number as its weight, so copies aren't
    compared with one another. Tables are compared in rounds, each of as many as send about ROUND_BYTES or else of
    one, and a round's shuffle files go with it: disk grows with the vectors, not with the tables. A bucket of
    more than `tile` nodes is dealt into parts, and each pair of parts is a cell of its own, so a bucket of any
    size is spread. Pairs within rounding of the threshold are decided in double precision.

    n_links: rows with a link to this one, itself excluded. component_id: the smallest id
    of the component, null ids being larger than all. Rows that repeat an id are vectors of their own,
    with links of their own; those with the component's id are all kept. Vectors that are null, empty, zero or
    hold null or non-finite values link with nothing, as do vectors of other lengths. An empty table gives an
    empty result; other columns aren't read. vectors is read twice and must give the same rows both times.
    """
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("vector"))
    rows = rows.withColumn("same", F.unhex(F.sha2(F.to_json(F.struct("vector")), 256)))
    named_rows = materialize(rows.select("vec_id", "same"), "rows")
    projections, tables = projections_and_tables(named_rows.select("same").distinct().count(), threshold, fill=CROWD, miss=miss)
    nodes = rows.groupBy("same").agg(F.min("vec_id").alias("low"), F.count(F.lit(1)).alias("weight"), F.first("vector").alias("vector"))
    nodes = nodes.withColumns({"nid": F.monotonically_increasing_id(), "width": F.size("vector")})
    nodes = materialize(with_keys(nodes, "vector", projections, tables), "nodes", once=True)
    usable = nodes.where("keys is not null").select("nid", "weight", "width", "vector", "keys")
    component = 8 if nodes.schema["vector"].dataType.elementType.simpleString() == "double" else 4
    sent = usable.agg(F.sum(F.col("width") * component + 2 * tables + 80)).first()[0] or 1  # bytes that a table sends
    together = max(1, min(tables, ROUND_BYTES // sent))
    found = [materialize(_round(usable, at, min(at + together, tables), threshold, tile), "found", once=True) for at in range(0, tables, together)]
    rounds, found = found, reduce(DataFrame.unionByName, found)

    exact = lambda x, name: usable.select(F.col("nid").alias(x), F.col("vector").alias(name))
    unsure = found.where("n = -1").select("a", "b").join(exact("a", "left"), "a").join(exact("b", "right"), "b")
    decided = materialize(_decided(unsure, threshold), "decided", once=True)

    weight = nodes.select("nid", "weight")
    both = decided.unionByName(decided.select(F.col("b").alias("a"), F.col("a").alias("b")))
    few = both.join(weight.withColumnRenamed("nid", "b"), "b").select("a", F.col("weight").alias("n"))
    linked = found.where("n > 0").select("a", "n").unionByName(few).groupBy(F.col("a").alias("nid")).agg(F.sum("n").alias("linked"))
    roots = components(found.where("n = 0").select("a", "b").unionByName(decided)).withColumnRenamed("node", "nid")
    named = nodes.select("nid", "same", "low", "weight", F.col("keys").isNotNull().alias("usable")).join(linked, "nid", "left").join(roots, "nid", "left")
    named = named.withColumn("root", F.coalesce("root", "nid"))
    lowest = named.groupBy("root").agg(F.min("low").alias("component_id"))
    named = materialize(named.join(lowest, "root").select("same", "weight", "usable", "linked", "component_id"), "named")
    for done in (nodes, decided, *rounds):
        discard(done)
    alone = ~F.col("usable")
    return named_rows.join(named, "same").select(
        "vec_id",
        F.when(alone, 0).otherwise(F.coalesce("linked", F.lit(0)) + F.col("weight") - 1).cast("long").alias("n_links"),
        F.when(alone, F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"),
        (alone | F.col("vec_id").eqNullSafe(F.col("component_id"))).alias("kept"),
    )
