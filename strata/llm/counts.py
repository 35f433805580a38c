"""Token counts by prefix dynamic programming.

For each prefix of a piece the table stores the last token of its encoding and the number of
tokens so far, so the count of any prefix, and the longest prefix within a budget, are look-ups.
The vocabulary is that of a JSON file: BPE over byte characters whose words end in a suffix, so a
prefix has two entries: one for when the word goes on, and one for when it ends there.
"""

from __future__ import annotations

import json
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.prefix import NEVER, Merges, Recent
from strata.llm.tables import spread
from strata.llm.words import portions, released

LIMIT = 2048
PIECES_BYTES = 16 << 20  # about what a generation of remembered pieces may take
PIECE_COST, CACHE_CHARS = 160, 48  # about the bytes of a remembered piece, and the longest one


def byte_characters() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    shifted = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(shifted)) for b in range(256)]


class Counter(Merges):
    """Counts of a vocabulary read from its JSON text."""

    def __init__(self, spec: str):
        spec = json.loads(spec)
        model = spec["model"]
        self.end = model.get("end_of_word_suffix") or ""
        self.vocab = model["vocab"]
        size = max(self.vocab.values()) + 1
        super().__init__({i: token for token, i in self.vocab.items()}, [*range(size)], [*range(size)])
        self.pairs: dict[tuple[int, int], int] = {}
        self.plain: dict[str, int] = {}
        self.final: dict[str, int] = {}  # tokens that end a word, without the suffix
        self.ending = ahocorasick.Automaton()  # finds the tokens inside a word that end at each byte character
        for token, i in self.vocab.items():
            if len(token) == 1 or self.end and len(token) == 1 + len(self.end) and token.endswith(self.end):
                self._enter(token, i)
        for merge in model["merges"]:
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            i = self.vocab[a + b]
            self.pairs[self.vocab[a], self.vocab[b]] = i
            self.left[i], self.right[i] = self.vocab[a], self.vocab[b]
            self._enter(a + b, i)
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = regex.compile(split["pattern"]["Regex"])
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None
        self.space = regex.compile(r"\s+")
        self.bytes = byte_characters()
        self.ending.make_automaton()
        self.longest = max(map(len, self.final if self.end else self.plain))
        self.counts = Recent(PIECES_BYTES)

    def _enter(self, token: str, i: int) -> None:
        if self.end and len(token) > len(self.end) and token.endswith(self.end):
            self.final[token[: -len(self.end)]] = i
        else:
            self.plain[token] = i
            self.ending.add_word(token, (len(token), i))

    def merged(self, a: int, b: int) -> int:
        return self.pairs.get((a, b), NEVER)

    def _open(self, symbols: str) -> tuple[list[int], list[int]]:
        """For each prefix of byte characters, as a word that goes on: the last token and the count, after entries for no characters."""
        last, counts, known, done = [0], [0], self.known.new, 0
        for at, (length, token) in self.ending.iter(symbols):  # the longest first
            if at < done:  # has its entry
                continue
            begin = at + 1 - length
            if begin:
                fits = known.get(last[begin] << 20 | token)
                if not (self.compatible(last[begin], token) if fits is None else fits):
                    continue
            last.append(token)
            counts.append(counts[begin] + 1)
            done = at + 1
        if done != len(symbols):
            raise ValueError("bytes that no sequence of tokens covers")
        return last, counts

    def _ended(self, symbols: str, end: int, last: list[int], counts: list[int]) -> int:
        """The count of the first end byte characters as a whole word."""
        if not self.end:
            return counts[end]
        final, known = self.final, self.known.new
        for begin in range(max(0, end - self.longest), end):
            token = final.get(symbols[begin:end])
            if token is None:
                continue
            if begin:
                fits = known.get(last[begin] << 20 | token)
                if not (self.compatible(last[begin], token) if fits is None else fits):
                    continue
            return counts[begin] + 1
        raise ValueError("bytes that no sequence of tokens covers")

    def prefix_counts(self, piece: str) -> list[int]:
        """counts[i]: tokens of the first i characters of piece as a word by themselves."""
        symbols = "".join([self.bytes[b] for b in piece.encode()])
        last, counts = self._open(symbols)
        ends = accumulate(len(c.encode()) for c in piece)
        return [0, *(self._ended(symbols, end, last, counts) for end in ends)]

    def piece_count(self, piece: str) -> int:
        found = self.counts.new.get(piece)
        if found is None and len(piece) <= CACHE_CHARS:
            found = self.counts.older(piece, PIECE_COST)
        if found is None:
            symbols = "".join([self.bytes[b] for b in piece.encode()])
            found = self._ended(symbols, len(symbols), *self._open(symbols[:-1])) if self.end else self._open(symbols)[1][-1]
            if len(piece) <= CACHE_CHARS:
                self.counts.put(piece, found, PIECE_COST)
        return found

    def normal(self, text: str) -> str:
        """NFC, one space for each run of white space, lower case letter by letter."""
        text = self.space.sub(" ", unicodedata.normalize("NFC", text))
        return text.lower() if "Σ" not in text else "".join(c.lower() for c in text)

    def parts(self, text: str) -> Iterator[tuple[str, bool]]:
        """Pieces of the text as (string, whether it is a special token)."""
        cut = self.special.split(text) if self.special else [text]
        for i, part in enumerate(cut):
            if i % 2:
                yield part, True
            elif part:
                for piece in self.pattern.findall(self.normal(part)):
                    yield piece, False

    def table(self, text: str) -> PrefixCounts:
        """The text's pieces with the count of each, found once."""
        if self.special is None or self.special.search(text) is None:
            known, piece_count = self.counts.new.get, self.piece_count
            pieces = self.pattern.findall(self.normal(text))
            return PrefixCounts(self, pieces, [known(piece) or piece_count(piece) for piece in pieces])
        parts = [*self.parts(text)]
        return PrefixCounts(self, [piece for piece, _ in parts], [1 if special else self.piece_count(piece) for piece, special in parts], {i for i, part in enumerate(parts) if part[1]})

    def count(self, text: str) -> int:
        return self.table(text).total

    def running(self, text: str) -> list[int]:
        """Tokens up to the end of each piece of text, from 0 on."""
        return self.table(text).running

    def fitting(self, text: str, budget: int) -> int:
        """How many whole pieces of text come to at most budget tokens."""
        return self.table(text).within(budget)[0]

    def forget(self) -> None:
        """Empty what is remembered between texts."""
        self.counts.clear()
        self.known.clear()


class PrefixCounts:
    """Exact counts of all prefixes of one text, from the counts of its pieces.

    A prefix of the normalised text is given as a number of whole pieces and a number of characters of the next. Pieces are
    what the vocabulary's pattern finds, and special tokens, which have no proper prefix.
    """

    def __init__(self, counter: Counter, pieces: list[str], counts: list[int], special: set[int] = frozenset()):
        self.counter, self.pieces, self.counts, self.special = counter, pieces, counts, special
        self.total = sum(counts)
        self._running: list[int] | None = None
        self._inside: dict[int, list[int]] = {}

    @property
    def running(self) -> list[int]:
        """Tokens up to the end of each piece, from 0 on."""
        if self._running is None:
            self._running = [0, *accumulate(self.counts)]
        return self._running

    def inside(self, piece: int) -> list[int]:
        """Tokens of the first 0, 1, .. characters of a piece."""
        if piece not in self._inside:
            text, counter = self.pieces[piece], self.counter
            found = counter.prefix_counts(text)
            for i in range(1, len(text)):
                parts = counter.pattern.findall(text[:i])
                if parts != [text[:i]]:  # the pattern cuts the prefix otherwise than the piece
                    found[i] = sum(map(counter.piece_count, parts))
            self._inside[piece] = found
        return self._inside[piece]

    def at(self, pieces: int, characters: int = 0) -> int:
        """Tokens of the prefix of so many whole pieces and characters of the next one."""
        if pieces in self.special and characters:
            raise ValueError("a special token has no proper prefix")
        return self.running[pieces] + (self.inside(pieces)[characters] if characters else 0)

    def within(self, budget: int) -> tuple[int, int]:
        """The longest prefix of at most budget tokens, as (whole pieces, characters of the next one)."""
        if budget < 0:
            return 0, 0
        whole = bisect_right(self.running, budget) - 1
        if whole == len(self.pieces) or whole in self.special:
            return whole, 0
        rest = budget - self.running[whole]
        return whole, max(i for i, n in enumerate(self.inside(whole)) if n <= rest)


@lru_cache(maxsize=2)
def load(path: str) -> Counter:
    with open(path, encoding="utf-8") as f:
        return Counter(f.read())


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit, pieces_within, chars_within), a row for each row of docs.

    pieces_within, chars_within: the longest prefix within the limit, as whole pieces and characters of the next
    piece; null where the whole text is within it. Nulls and empty texts count 0. Rows are treated one by one, so null and
    repeated ids are carried through, and an empty table gives an empty result. path names a
    vocabulary file that every executor has. Only the id and the text are read.
    """
    path = path or default_path()
    names = ["doc_id", "n_bytes", "n_tokens", "over_limit", "pieces_within", "chars_within"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = load(path)
        with released(counter.forget):
            for whole in batches:
                for batch in portions(whole, 1):
                    sizes, tokens, within = [], [], []
                    for text in batch.column(1).to_pylist():
                        table = counter.table(text or "")
                        sizes.append(len((text or "").encode()))
                        tokens.append(table.total)
                        within.append(table.within(limit) if table.total > limit else (None, None))
                    over = pa.array([n > limit for n in tokens], pa.bool_())
                    ends = [pa.array([w[i] for w in within], pa.int64()) for i in (0, 1)]
                    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64()), over, *ends], names)

    kind = docs.schema[id_col].dataType.simpleString()
    rows = spread(docs.select(F.col(id_col), F.col(text_col).cast("string")))
    return rows.mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean, pieces_within long, chars_within long")
