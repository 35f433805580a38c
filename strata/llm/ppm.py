"""Scores of texts under a byte-context trie learned from the corpus: prediction by partial matching.

The trie has a node for each context of up to ORDER bytes that occurs in training texts, with the
counts of the bytes that follow. A byte is coded in its longest known context; one not seen there
escapes (method D: half a count of each distinct byte seen goes to escapes) to the context one byte shorter,
where the bytes of the longer context are excluded. The trie is learned first and then used
unchanged for each document, so a code length depends on a byte and its ORDER predecessors alone.

Nothing of the corpus is held in one place: trie levels are tables of (gram, count), code lengths
are found for each distinct gram by joins, and each block of documents gets those of its own grams.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata.llm.tables import discard, materialize
from strata.llm.words import LOWER, SEGMENT, Words, bytes_of, portions, released, signed

ORDER = 5
BLOCK_BYTES = 32 << 20
SORTED = 1 << 20  # keys that are sorted at once
EDGE = 0xFF  # stands before a text and ends it; no UTF-8 text holds it
DELTA = 0.1
SPREAD = np.uint64(0x9E3779B97F4A7C15)


class Stream:
    """The lower-cased bytes of texts with an end after each, read a segment at a time: the last order + 1 bytes up to each, packed."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, order: int):
        self.order, count = order, len(offsets) - 1
        self.begins = offsets + np.arange(count + 1)  # where each text's bytes and end begin, the end last
        self.padded = np.full(self.begins[-1] + order, EDGE, np.uint8)
        for i in range(count):
            self.padded[self.begins[i] + order : self.begins[i + 1] + order - 1] = data[offsets[i] : offsets[i + 1]]

    def segments(self, size: int = SEGMENT // 4) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
        """(grams, first text, where each text begins in the segment): a text longer than a segment is in several."""
        for low in range(0, int(self.begins[-1]), size):
            high = min(low + size, int(self.begins[-1]))
            first, last = np.searchsorted(self.begins, [low, high - 1], "right") - 1
            starts = np.maximum(self.begins[first : last + 1], low) - low
            total = np.zeros(high - low, np.uint64)
            since = np.arange(low, high) - np.repeat(self.begins[first : last + 1], np.diff(starts, append=high - low))
            for j in range(self.order + 1):
                back = self.order - j
                letter = self.padded[low + j : high + j].astype(np.uint64)
                if back:  # the end of the text before stands there; what comes before it counts as edge
                    letter[since < back] = EDGE
                total = total << np.uint64(8) | letter
            yield total, int(first), starts


WORD = np.uint64(1 << 63)  # marks the key of a word; no gram has this bit


def _word_keys(words: Words) -> np.ndarray:
    """63-bit hashes."""
    return words.hashes(31) >> np.uint64(1)


def _packed(docs: DataFrame, block_bytes: int) -> DataFrame:
    """(block, content): consecutive documents (doc_id, text, trained) of a task, about block_bytes of text together, as one compressed Arrow stream."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 24
        held: list[pa.RecordBatch] = []
        size = 0
        for whole in batches:
            for batch in portions(whole, 1, 1 << 20):
                held.append(batch)
                size += bytes_of(batch.column(1))[1][-1]
                if size >= block_bytes:
                    yield _row(number, held)
                    number, held, size = number + 1, [], 0
        if held:
            yield _row(number, held)

    return docs.mapInArrow(pack, "block long, content binary")


def _row(block: int, held: list[pa.RecordBatch]) -> pa.RecordBatch:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 6))) as out:
        for batch in held:
            out.write_batch(batch)
    return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["block", "content"])


def _documents(content) -> Iterator[pa.RecordBatch]:
    with pa.ipc.open_stream(content.as_buffer()) as stream:
        yield from stream


class Counted:
    """Distinct keys of a block and how many of each are of training texts; keys are below 2 ** 63."""

    def __init__(self) -> None:
        self.held: list[np.ndarray] = []
        self.size = 0
        self.keys, self.n = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def add(self, keys: np.ndarray, trained: np.ndarray) -> None:
        self.held.append(keys << np.uint64(1) | trained.astype(np.uint64))
        self.size += len(keys)
        if self.size >= SORTED:
            self._turn()

    def _turn(self) -> None:
        """Sort what is held, which is far faster than finding the order of it, and add it to the sorted distinct keys and counts."""
        marked = np.concatenate(self.held)
        self.held, self.size = [], 0
        marked.sort()
        trained = np.concatenate(([0], np.cumsum(marked & np.uint64(1), dtype=np.uint32)))
        marked >>= np.uint64(1)
        first = np.flatnonzero(np.concatenate(([True], marked[1:] != marked[:-1]))[: len(marked)])
        n = (trained[np.append(first[1:], len(marked))] - trained[first]).astype(np.int64)
        keys = marked[first]
        at = np.searchsorted(self.keys, keys)
        known = np.flatnonzero(at < len(self.keys))
        known = known[self.keys[at[known]] == keys[known]]
        self.n[at[known]] += n[known]
        fresh = np.ones(len(keys), bool)
        fresh[known] = False
        self.n = np.insert(self.n, at[fresh], n[fresh])
        self.keys = np.insert(self.keys, at[fresh], keys[fresh])

    def result(self) -> tuple[np.ndarray, np.ndarray]:
        if self.held:
            self._turn()
        return self.keys, self.n


def _items(blocks: DataFrame) -> DataFrame:
    """(block, key, n): distinct grams and words of each block, and how often training texts have them. Words have negative keys."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for row in range(whole.num_rows):
                with released():
                    found = [counted.result() for counted in counts(whole.column(1)[row])]
                for (keys, n), mark in zip(found, (np.uint64(0), WORD), strict=True):
                    for at in range(0, len(keys), 1 << 16):
                        part = signed(keys[at : at + (1 << 16)] | mark)
                        yield pa.RecordBatch.from_arrays([whole.column(0).take(pa.array(np.full(len(part), row))), part, pa.array(n[at : at + (1 << 16)])], ["block", "key", "n"])

    def counts(content) -> tuple[Counted, Counted]:
        grams, names = Counted(), Counted()
        for batch in _documents(content):
            data, offsets = bytes_of(batch.column(1))
            data = LOWER[data]
            trained = batch.column(2).to_numpy(zero_copy_only=False)
            for found, first, starts in Stream(data, offsets, ORDER).segments():
                grams.add(found, np.repeat(trained[first : first + len(starts)], np.diff(starts, append=len(found))))
            held = Words(data, offsets)
            names.add(_word_keys(held), np.repeat(trained, np.diff(held.first)))
        return grams, names

    return blocks.mapInArrow(count, "block long, key long, n long")


class Values:
    """The value of each key of a block. Keys are spread by an odd factor, so that their first bits lead to them at once."""

    def __init__(self, keys: np.ndarray | pa.ChunkedArray, values: np.ndarray | pa.ChunkedArray):
        spread, at = np.empty(len(keys), np.uint64), 0
        for chunk in getattr(keys, "chunks", [keys]):  # a chunk at a time, since the group stands in memory already
            np.multiply(np.asarray(chunk).view(np.uint64), SPREAD, out=spread[at : at + len(chunk)])
            at += len(chunk)
        order = np.argsort(spread)
        self.keys = spread[order]
        del spread
        self.values = np.asarray(values)[order]
        del order
        bits = max(1, len(keys).bit_length())
        self.shift = np.uint64(64 - bits)
        self.starts = np.empty(1 << bits, np.int32)
        for low in range(0, 1 << bits, SEGMENT):
            first = np.arange(low, min(low + SEGMENT, 1 << bits), dtype=np.uint64) << self.shift
            self.starts[low : low + SEGMENT] = np.searchsorted(self.keys, first)

    def of(self, wanted: np.ndarray) -> np.ndarray:
        """Values of keys that are all there."""
        wanted = wanted * SPREAD
        at = self.starts[(wanted >> self.shift).view(np.int64)]
        further = np.flatnonzero(self.keys[at] != wanted)
        while len(further):
            at[further] += 1
            further = further[self.keys[at[further]] != wanted[further]]
        return self.values[at]


def code_lengths(grams: DataFrame, order: int = ORDER) -> DataFrame:
    """(gram, bits) from (gram, n): packed runs of order + 1 bytes, with counts that may be 0.

    Level k has the runs of k + 1 bytes. A row gets the totals of its context: all counts T, distinct
    bytes d, and X, what the bytes seen here count for one level below. Escaping from it leads to the
    level below with T - X and d' - d of what is left there.
    """
    levels = [None] * order + [grams.select("gram", F.col("n").cast("double").alias("n"))]
    for k in range(order - 1, -1, -1):
        level = levels[k + 1].groupBy(F.col("gram").bitwiseAND((1 << 8 * (k + 1)) - 1).alias("gram")).agg(F.sum("n").alias("n"))
        levels[k] = materialize(level, f"trie-{k}")
    below = None
    for k, level in enumerate(levels):
        own = Window.partitionBy(F.shiftright("gram", 8)) if k else Window.partitionBy(F.lit(0))
        seen = F.col("n") > 0
        if below is None:
            level = level.withColumn("d", F.sum(seen.cast("double")).over(own)).withColumn("low", F.log2(F.greatest(256 - F.col("d"), F.lit(1.0))))
            level = level.withColumn("t", F.sum("n").over(own))
        else:
            down = below.select(F.col("gram").alias("tail"), F.col("n").alias("n1"), F.col("t").alias("t1"), F.col("d").alias("d1"), F.col("low").alias("low1"))
            level = level.withColumn("tail", F.col("gram").bitwiseAND((1 << 8 * k) - 1)).join(down, "tail")
            level = level.withColumns({"t": F.sum("n").over(own), "d": F.sum(seen.cast("double")).over(own), "x": F.sum(F.when(seen, F.col("n1")).otherwise(0.0)).over(own)})
            left, kinds = F.col("t1") - F.col("x"), F.col("d1") - F.col("d")
            escape = F.when(left > 0, -F.log2(F.try_divide(kinds / 2, left))).otherwise(0.0) + F.col("low1")
            level = level.withColumn("low", F.when(F.col("n1") > 0, -F.log2(F.try_divide(F.col("n1") - 0.5, left))).otherwise(escape))
        above, below = below, materialize(level.select("gram", "n", "t", "d", "low"), f"level-{k}")
        for done in (above, levels[k] if k < order else None):
            if done is not None:
                discard(done)
    escape = F.when(F.col("t") > 0, -F.log2(F.try_divide(F.col("d") / 2, F.col("t")))).otherwise(0.0) + F.col("low")
    return below.select("gram", F.when(F.col("n") > 0, -F.log2(F.try_divide(F.col("n") - 0.5, F.col("t")))).otherwise(escape).alias("bits"))


def score_documents(docs: DataFrame, trained: F.Column, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score), a row for each row of docs.

    trained: whether a row of docs is learned from; null is no. score: log10 probability of the lower-cased bytes
    and the end under the trie. base_score: of the words and the end under smoothed word frequencies.
    Words are counted by 63-bit hashes, so n_known and base_score are exact unless two words share one; the
    code length of a byte is rounded to single precision before lengths are summed.

    Nulls and empty texts have the end alone. Rows are scored one by one: null and repeated ids are carried
    through, and each row learned from counts. An empty table gives an empty result. Other columns aren't read.

    Documents are packed into blocks as they are read. A block's distinct grams and words are
    counted; all blocks' counts make the corpus tables; each block then gets the values of its own.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    chosen = F.coalesce(trained, F.lit(False))
    blocks = materialize(_packed(docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), chosen.alias("trained")), block_bytes), "blocks")
    ends = docs.where(chosen).count()

    items = materialize(_items(blocks), "items")
    sums = materialize(items.groupBy("key").agg(F.sum("n").alias("n")), "sums")
    words = sums.where("key < 0")
    n_words, kinds = words.where("n > 0").agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    n_all, kinds = n_words + ends, kinds + (1 if ends else 0)

    bits = code_lengths(sums.where("key >= 0").select(F.col("key").alias("gram"), "n"))
    values = bits.select(F.col("gram").alias("key"), F.col("bits").cast("float").cast("double").alias("value"))
    values = materialize(values.unionByName(words.select("key", F.col("n").cast("double").alias("value"))), "values")
    needed = items.select("block", "key").join(values, "key").select("block", "key", "value")
    log_rest = float(np.log10(n_all + DELTA * (kinds + 1))) if n_all + kinds else 0.0

    def scored(batch: pa.RecordBatch, found: Values) -> pa.RecordBatch:
        data, offsets = bytes_of(batch.column(1))
        data, n = LOWER[data], batch.num_rows
        lengths = np.zeros(n)
        for grams, first, starts in Stream(data, offsets, ORDER).segments():
            lengths[first : first + len(starts)] += np.add.reduceat(found.of(grams), starts)
        held = Words(data, offsets)
        counts = found.of(_word_keys(held) | WORD)
        edges = np.cumsum([0, *(np.diff(held.first) + 1)])
        logs, known = np.full(edges[-1], np.log10(ends + DELTA) - log_rest), np.full(edges[-1], int(ends > 0))
        where = np.arange(len(counts)) + np.repeat(np.arange(n), np.diff(held.first))
        logs[where], known[where] = np.log10(counts + DELTA) - log_rest, counts > 0
        base, n_known = np.add.reduceat(logs, edges[:-1]), np.add.reduceat(known, edges[:-1]).astype(np.int64)
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(np.diff(edges)), pa.array(n_known), pa.array(np.full(n, n_all, np.int64)), pa.array(base), pa.array(-lengths * np.log10(2))],
            ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    def score(blocks: pa.Table, table: pa.Table) -> pa.Table:
        with released():
            return block_scores(blocks, Values(table.column("key"), table.column("value")))

    def block_scores(blocks: pa.Table, found: Values) -> pa.Table:
        return pa.Table.from_batches([scored(x, found) for content in blocks.column("content") for x in _documents(content)])

    kind = docs.schema[id_col].dataType.simpleString()
    shape = f"doc_id {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    result = materialize(blocks.groupBy("block").cogroup(needed.groupBy("block")).applyInArrow(score, shape), "scores")
    for done in (blocks, items, sums, values):
        discard(done)
    return result
