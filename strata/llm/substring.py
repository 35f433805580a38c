"""Removal of passages that an earlier document has, by difference-cover anchors.

A window is WINDOW consecutive words. Words are hashed in runs of ANCHOR words, but only where the
position modulo PERIOD is in a difference cover: for any two positions some shift below PERIOD
brings both into the cover, so two equal windows always have an equal anchor at an equal offset.
Equal anchors are then extended to the left and right.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.tables import materialize
from strata.llm.words import Runs, Words, bytes_of, mixed, portions, signed

WINDOW = 50
PERIOD = 31
COVER = (1, 5, 11, 24, 25, 27)  # each remainder modulo 31 is a difference of two of them
ANCHOR = WINDOW - PERIOD + 1
REACH = WINDOW - ANCHOR


def _rows(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, Words]]:
    for whole in batches:
        for batch in portions(whole, column):
            yield batch, Words(*bytes_of(batch.column(column)))


def _anchors(keyed: DataFrame, kind: str) -> DataFrame:
    """(h, e, doc_id, rid, place): an anchor's hash, that of its surroundings, and position, reach to the left and right packed into place."""
    covered = np.zeros(PERIOD, bool)
    covered[list(COVER)] = True

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, words in _rows(batches, 2):
            counts = np.diff(words.first)
            doc = np.repeat(np.arange(batch.num_rows), counts)
            place = np.arange(len(doc)) - words.first[doc]
            at = np.flatnonzero(covered[place % PERIOD] & (place + ANCHOR <= counts[doc]) & (counts[doc] >= WINDOW))
            if not len(at):
                continue
            doc, place = doc[at], place[at]
            runs = Runs(words.hashes())
            left, right = np.minimum(place, REACH), np.minimum(counts[doc] - place - ANCHOR, REACH)
            around = mixed(runs.of(at - left, at + ANCHOR + right) + left.astype(np.uint64))
            own = [batch.column(i).take(pa.array(doc)) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([signed(runs.of(at, at + ANCHOR)), signed(around), *own, pa.array(place << 12 | left << 6 | right)], ["h", "e", "doc_id", "rid", "place"])

    return keyed.mapInArrow(find, f"h long, e long, doc_id {kind}, rid long, place long")


def _windows(texts: DataFrame, kind: str) -> DataFrame:
    """(h1, h2, doc_id, rid, place) for each window whose start is in the ranges of (doc_id, rid, text, ranges)."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, words in _rows(batches, 2):
            wanted = np.zeros(len(words.starts) + 1, np.int32)
            lists = batch.column(3)
            ends = lists.offsets.to_numpy()
            doc = np.repeat(np.arange(batch.num_rows), np.diff(ends))
            values = lists.values.to_numpy()[ends[0] : ends[-1]]
            left, right, place = values >> 6 & 63, values & 63, values >> 12 & 0xFFFFFFFF
            np.add.at(wanted, words.first[doc] + place - left, 1)
            np.add.at(wanted, words.first[doc] + place + ANCHOR + right - WINDOW + 1, -1)
            at = np.flatnonzero(np.cumsum(wanted) > 0)
            if not len(at):
                continue
            doc = np.searchsorted(words.first, at, "right") - 1
            names = [signed(Runs(words.hashes(a), b).of(at, at + WINDOW)) for a, b in ((5, 7), (6, 8))]
            own = [batch.column(i).take(pa.array(doc)) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*names, *own, pa.array(at - words.first[doc])], ["h1", "h2", "doc_id", "rid", "place"])

    return texts.mapInArrow(find, f"h1 long, h2 long, doc_id {kind}, rid long, place long")


def _cut(texts: DataFrame, kind: str) -> DataFrame:
    """(doc_id, n_words, n_removed, kept, removed) from (doc_id, rid, text, spans of start << 32 | end)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            totals, cuts, kept, removed = [], [], [], []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                words = (text or "").encode().split()  # bytes.split() parts at \x20 and \x09-\x0D
                totals.append(len(words))
                if not spans.is_valid or not len(spans):
                    kept.append(b" ".join(words))
                    cuts.append(0)
                    removed.append([])
                    continue
                packed = spans.values.to_numpy()
                edge = np.zeros(len(words) + 1, np.int32)
                np.add.at(edge, packed >> 32, 1)
                np.add.at(edge, packed & 0xFFFFFFFF, -1)
                gone = np.concatenate(([False], np.cumsum(edge[:-1]) > 0, [False]))
                turns = np.flatnonzero(gone[1:] != gone[:-1])
                removed.append([{"start": int(a), "end": int(b)} for a, b in zip(turns[::2], turns[1::2], strict=True)])
                cuts.append(int(gone.sum()))
                kept.append(b" ".join(compress(words, ~gone[1:-1])))
            spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(totals, pa.int64()), pa.array(cuts, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(removed, spans_type)], ["doc_id", "n_words", "n_removed", "kept", "removed"])

    return texts.select("doc_id", "text", "spans").mapInArrow(cut, f"doc_id {kind}, n_words long, n_removed long, kept string, removed array<struct<start:long,end:long>>")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept, removed), a row for each row of docs.

    A word goes if a window over it also starts in a document of smaller id; windows are judged on
    the input. kept: the words that stay, joined by one space. removed: word ranges.

    Of the anchors with equal hashes, each whose surroundings an earlier document also has is settled
    by that document. The first of each kind of surroundings is not: if an anchor has several
    kinds, the windows over it are named by 128 bits and the first document of each is found. Every
    step is a grouping with map-side minima and a join to it, so a passage of any frequency is spread.

    Texts below 50 words, nulls and blanks lose nothing. Rows without an id are compared with
    nothing; rows that repeat an id are one document with respect to "smaller", told apart by a hash of their texts. Other columns
    aren't read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    text = F.col(text_col).cast("string")
    ids = docs.select(F.col(id_col).alias("doc_id")).where("doc_id is not null")
    unique = ids.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()
    keyed = docs.select(F.col(id_col).alias("doc_id"), (F.lit(0).cast("long") if unique else F.xxhash64(text)).alias("rid"), text.alias("text"))
    anchors = _anchors(keyed.where("doc_id is not null"), kind)
    shared = anchors.groupBy("h").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("h")
    found = materialize(anchors.join(materialize(shared, "shared"), "h"), "anchors")

    kinds = materialize(found.groupBy("h", "e").agg(F.min("doc_id").alias("lead"), F.max("doc_id").alias("high")), "kinds")
    several = kinds.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h")
    left, right = F.shiftright("place", 6).bitwiseAND(63), F.col("place").bitwiseAND(63)
    at = F.shiftright("place", 12)
    whole = F.shiftleft(at - left, 32).bitwiseOR(at + ANCHOR + right)
    settled = found.join(kinds.where("lead < high").select("h", "e", "lead"), ["h", "e"]).where("doc_id > lead").select("doc_id", "rid", whole.alias("span"))

    leads = kinds.join(several, "h", "left_semi").select("h", "e", F.col("lead").alias("doc_id"))
    leads = found.join(leads, ["h", "e", "doc_id"], "left_semi").groupBy("doc_id", "rid").agg(F.collect_set("place").alias("places"))
    windows = materialize(_windows(keyed.join(leads, ["doc_id", "rid"]).select("doc_id", "rid", "text", "places"), kind), "windows")
    firsts = windows.groupBy("h1", "h2").agg(F.min("doc_id").alias("lead"), F.max("doc_id").alias("high")).where("lead < high").select("h1", "h2", "lead")
    span = F.shiftleft("place", 32).bitwiseOR(F.col("place") + WINDOW)
    later = windows.join(materialize(firsts, "firsts"), ["h1", "h2"]).where("doc_id > lead").select("doc_id", "rid", span.alias("span"))

    spans = settled.unionByName(later).groupBy("doc_id", "rid").agg(F.collect_set("span").alias("spans"))
    spans = spans.withColumnsRenamed({"doc_id": "_id", "rid": "_rid"})
    return _cut(keyed.join(spans, (F.col("doc_id") == F.col("_id")) & (F.col("rid") == F.col("_rid")), "left"), kind)
