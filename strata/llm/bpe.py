"""Byte-level BPE by prefix dynamic programming.

For each prefix of a byte string the table stores the one token that ends the prefix's encoding.
A token can end a prefix only if it and the token before it stay as they are when encoded
together, and exactly one token does so for each prefix. The table therefore grows by appends
without change to earlier entries. After an edit, new entries are asked for from the edited byte
on, until as many of them as the longest token has bytes agree with the old ones: from there on
the old entries hold.
"""

from __future__ import annotations

import base64
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.prefix import NEVER, Merges, Recent
from strata.llm.tables import spread
from strata.llm.words import portions, released

CACHE_BYTES = 48  # the longest piece that a worker remembers
PIECES_BYTES = 16 << 20  # about what a generation of remembered pieces may take
PIECE_COST = 160  # about the bytes of a remembered piece besides its characters and ids
LOOK = 3  # characters after its end that a match of the pattern can depend on
STEP = 32


class PrefixTable:
    """Last tokens of all prefixes of a byte string that grows and is edited."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, bytearray(), []
        self.append(data)

    def append(self, more: bytes) -> None:
        """Add bytes at the end; earlier entries stay."""
        self.data += more
        self._grow(len(self.data))

    def _grow(self, until: int) -> None:
        """Add the entries of the prefixes up to until."""
        low = max(0, len(self.last) - self.vocabulary.longest)  # no token reaches further back
        self.vocabulary.extend(self.last, bytes(self.data[low:until]), low)

    def replace(self, at: int, until: int, new: bytes) -> int:
        """Put new in the place of bytes at..until; returns how many entries were found anew.

        An entry depends on the bytes and entries that the longest token spans before it. Once that
        many entries behind the edit are those that stood there before, all further ones are.
        """
        behind, edge, span = self.last[until:], at + len(new), self.vocabulary.longest
        self.data[at:until] = new
        del self.last[at:]
        while len(self.last) < len(self.data):
            self._grow(min(len(self.data), len(self.last) + STEP))
            past = len(self.last) - edge
            if past >= span and self.last[-span:] == behind[past - span : past]:
                found = len(self.last) - at
                self.last += behind[past:]
                return found
        return len(self.last) - at

    def ids(self, end: int | None = None) -> list[int]:
        """The encoding of the prefix that ends at end (the whole by default)."""
        return self.vocabulary.walked(self.last, len(self.data) if end is None else end)


class EncodedText:
    """Ids of a text that grows and is edited, a match of the pattern (a piece) at a time.

    The pattern looks forward only, at most LOOK characters beyond a match. So pieces that end that
    far before an edit stay, and once a new piece starts behind the edit where an old one did, so do all
    that follow. Pieces too long to remember keep their prefix table, which is edited in its turn.
    """

    def __init__(self, vocabulary: Vocabulary, text: str = ""):
        self.vocabulary, self.text = vocabulary, ""
        self.starts: list[int] = []
        self.ends: list[int] = []
        self.packed: list[bytes] = []
        self.tables: list[PrefixTable | None] = []
        self.append(text)

    def append(self, more: str) -> int:
        return self.replace(len(self.text), len(self.text), more)

    def replace(self, at: int, until: int, new: str) -> int:
        """Put new in the place of characters at..until; returns how many pieces were encoded anew."""
        shift, edge = at + len(new) - until, at + len(new)
        before, self.text = self.text, self.text[:at] + new + self.text[until:]
        first = bisect_right(self.ends, at - LOOK)
        rest, found = len(self.starts), []
        for match in self.vocabulary.pattern.finditer(self.text, self.ends[first - 1] if first else 0):
            old = bisect_left(self.starts, match.start() - shift, first) if match.start() >= edge else rest
            if old < rest and self.starts[old] == match.start() - shift:
                rest = old
                break
            found.append(match.span())
        edited = self.tables[first] if len(found) == rest - first == 1 else None
        if edited is not None and found[0] == (self.starts[first], self.ends[first] + shift) and found[0][0] <= at and until <= self.ends[first]:
            head = len(before[found[0][0] : at].encode())
            edited.replace(head, head + len(before[at:until].encode()), new.encode())
            made = [(self.vocabulary.joined(edited), edited)]
        else:
            made = [self._encoded(self.text[a:b]) for a, b in found]
        self.starts[first:] = [a for a, _ in found] + [x + shift for x in self.starts[rest:]]
        self.ends[first:] = [b for _, b in found] + [x + shift for x in self.ends[rest:]]
        self.packed[first:rest] = [ids for ids, _ in made]
        self.tables[first:rest] = [table for _, table in made]
        return len(found)

    def _encoded(self, piece: str) -> tuple[bytes, PrefixTable | None]:
        data = piece.encode()
        if len(data) <= CACHE_BYTES:
            return self.vocabulary.piece(piece), None
        table = PrefixTable(self.vocabulary, data)
        return self.vocabulary.joined(table), table

    def ids(self) -> list[int]:
        return np.frombuffer(b"".join(self.packed), "<u4").tolist()


class Vocabulary(Merges):
    """Ranks of a byte-level BPE and what follows from them. Ids are packed as little-endian unsigned 32-bit integers."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        names = {rank: token for token, rank in ranks.items()}
        size = max(names) + 1
        super().__init__(names, [*range(size)], [*range(size)])
        #: Tokens that their own bytes encode to; no other can occur inside a longer piece.
        self.own: dict[bytes, int] = {}
        self.ending = ahocorasick.Automaton()  # finds the tokens that end at each byte, a byte being a character
        for token, rank in ranks.items():
            parts = self._parts(token)
            if len(parts) <= 2:
                self.own[token] = rank
                self.ending.add_word(token.decode("latin-1"), (len(token), rank))
                self.left[rank], self.right[rank] = ranks[parts[0]], ranks[parts[-1]]
        self.ending.make_automaton()
        self.longest = max(map(len, self.own))
        self.sizes = {rank: len(token) for rank, token in names.items()}
        self.four = {rank: rank.to_bytes(4, "little") for rank in names}
        self.pieces = Recent(PIECES_BYTES)

    def _parts(self, token: bytes) -> list[bytes]:
        """The two parts that a token's last merge joins; more if merges don't reach it."""
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            rank, at = min((self.ranks.get(a + b, NEVER), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == NEVER:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def merged(self, a: int, b: int) -> int:
        return self.ranks.get(self.names[a] + self.names[b], NEVER)

    def extend(self, last: list[int], data: bytes, low: int = 0) -> None:
        """Add to last the entries of all prefixes up to the end of data, which begins at byte low."""
        known, done = self.known.new, len(last)
        for at, (length, token) in self.ending.iter(data.decode("latin-1")):  # the longest first
            end = low + at + 1
            if end <= done:  # has its entry
                continue
            if end > length:
                before = last[end - length - 1]
                fits = known.get(before << 20 | token)
                if not (self.compatible(before, token) if fits is None else fits):
                    continue
            last.append(token)
            done = end
        if done != low + len(data):
            raise ValueError("bytes that no sequence of tokens covers")

    def walked(self, last: list[int], end: int) -> list[int]:
        """The encoding of the prefix that ends at end, from its last token backwards."""
        sizes, out = self.sizes, []
        while end:
            token = last[end - 1]
            out.append(token)
            end -= sizes[token]
        out.reverse()
        return out

    def joined(self, table: PrefixTable) -> bytes:
        """The packed ids of a piece with this table; a piece that is a token itself gets it."""
        whole = self.ranks.get(bytes(table.data))
        return b"".join(map(self.four.__getitem__, table.ids() if whole is None else [whole]))

    def piece(self, piece: str) -> bytes:
        """The packed ids of one piece."""
        found = self.pieces.new.get(piece)
        if found is None:
            data = piece.encode()
            short = len(data) <= CACHE_BYTES
            found = self.pieces.older(piece, PIECE_COST + 4 * len(data)) if short else None
            if found is None:
                whole = self.ranks.get(data)
                if whole is None:
                    last: list[int] = []
                    self.extend(last, data)
                    found = b"".join(map(self.four.__getitem__, self.walked(last, len(data))))
                else:
                    found = self.four[whole]
                if short:
                    self.pieces.put(piece, found, PIECE_COST + 4 * len(data))
        return found

    def packed(self, text: str) -> bytes:
        """The packed ids of a text."""
        known, piece_ids = self.pieces.new.get, self.piece
        return b"".join([known(piece) or piece_ids(piece) for piece in self.pattern.findall(text)])

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.packed(text), "<u4").tolist()

    def decode(self, ids) -> bytes:
        return b"".join(map(self.names.__getitem__, ids))

    def forget(self) -> None:
        """Empty what is remembered between texts."""
        self.pieces.clear()
        self.known.clear()


@lru_cache(maxsize=2)
def load(path: str, pattern: str) -> Vocabulary:
    """Ranks from a file of lines of base64 token and rank; held once per Python worker."""
    with open(path, "rb") as lines:
        return Vocabulary({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}, pattern)


def default_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded), a row for each row of docs.

    ids: the tokens as little-endian unsigned 32-bit integers, one after another; decoded: the
    bytes they stand for. Pieces of the pattern are encoded one by one; a piece that is a token
    itself gets it. Nulls and empty texts have no tokens. Rows are treated one by one, so null and
    repeated ids are carried through, and an empty table gives an empty result. path names a file of
    ranks that every executor has. Only the id and the text are read.
    """
    if path is None:
        path, pattern = default_vocabulary()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = load(path, pattern)
        with released(vocabulary.forget):
            for whole in batches:
                for batch in portions(whole, 1):
                    packed = [vocabulary.packed(text or "") for text in batch.column(1).to_pylist()]
                    decoded = [vocabulary.decode(np.frombuffer(ids, "<u4").tolist()) for ids in packed]
                    counts = pa.array([len(ids) // 4 for ids in packed], pa.int64())
                    columns = [batch.column(0), counts, pa.array(packed, pa.binary()), pa.array(decoded, pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids", "decoded"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = spread(docs.select(F.col(id_col), F.col(text_col).cast("string")))
    return rows.mapInArrow(encode, f"doc_id {kind}, n_tokens long, ids binary, decoded binary")


def digests(encoded: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of encode_documents' rows."""
    return encoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
