"""Personal data: e-mail addresses, IP addresses, card and phone numbers.

Base patterns find what has the plain form. A bidirectional LSTM with CRF transitions, trained in
numpy, adds spans in other forms (an address written with "(at)", a number grouped otherwise). It reads
words as one symbol each and all other characters by themselves.
Every text is tagged in overlapping windows, each decoded by itself; where windows
disagree, the span farther from its window's edges stays, over the whole text.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.tables import spread
from strata.llm.words import portions, released

KINDS = ("email", "ip", "card", "phone")
TAGS = 1 + 2 * len(KINDS)  # outside, then first and further characters of each kind
SPAN = 160  # characters of a snippet in training
WINDOW, STRIDE = 512, 448  # symbols of a text
PORTION = 8 << 20  # bytes of text whose windows are gathered
TOGETHER, STEP = 1024, 64  # windows that are tagged together: of one length, in multiples of STEP
HIDDEN = 16
SAMPLE_ROWS, SAMPLE_SNIPPETS, SNIPPETS_A_TEXT = 300, 2600, 2
EPOCHS, BATCH, RATE = 11, 96, 0.02

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
PLAIN_SIGN = re.compile(r"[0-9@]")  # what a match of a base pattern holds
AT = re.compile(r"@|[(\[{<]\s*at\s*[)\]}>]|\sat\s", re.IGNORECASE)


def luhn(digits: str) -> bool:
    total = sum(int(c) for c in digits[-1::-2]) + sum(sum(divmod(2 * int(c), 10)) for c in digits[-2::-2])
    return total % 10 == 0


def valid(kind: str, text: str) -> bool:
    digits = re.sub("[^0-9]", "", text)
    if kind == "email":
        return len(AT.findall(text)) == 1 and len(text) >= 6 and bool(re.search(r"\.|dot", text, re.IGNORECASE))
    if kind == "ip":
        parts = re.findall("[0-9]+", text)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == "card":
        return 16 <= len(digits) <= 19 and luhn(digits)
    return 8 <= len(digits) <= 15 and not re.search(r"[A-Za-z]", text)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind's place in KINDS, start, end) of the base patterns' matches, by kind and start."""
    if PLAIN_SIGN.search(text) is None:
        return []
    out, free = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            out.append((0, start, found.end()))
            free = found.end()
        at = text.find("@", max(at + 1, free))
    for place, pattern, fits in ((1, IP, lambda m: all(int(p) <= 255 for p in m.split(".") if len(p.lstrip("0")) < 4) and all(len(p.lstrip("0")) < 4 for p in m.split("."))),
                                 (2, CARD, lambda m: 16 <= len(d := m.replace(" ", "").replace("-", "")) <= 19 and luhn(d)),
                                 (3, PHONE, lambda m: 8 <= sum(c.isdigit() for c in m) <= 15)):
        out += [(place, m.start(), m.end()) for m in pattern.finditer(text) if fits(m[0])]
    return out


@cache
def _letters() -> np.ndarray:
    """Whether a code point is a letter."""
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def _packed(word: str) -> int:
    return int.from_bytes(word.encode(), "little")


#: Numbers that words of ASCII letters take, those of letters: by length, case and what they mean, then again for words after a space.
WORDS = np.array([*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)], np.int16)
LENGTHS = np.array([2, 3, 4, 5, 6, 8, 11])  # where the sorts of length begin
MEANINGS = (["at"], ["dot"], ["com", "org", "net", "de", "fr", "es", "io"])
SORTS = 2 * (len(LENGTHS) + 1) + len(MEANINGS)


def symbols(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The symbols of a text, all of it: numbers, starts and ends.

    A word is one symbol (128 if its letters aren't ASCII), and takes in a space before it, though it starts after that; each other character is one: its
    ASCII code, or 129. 0 is no symbol.
    """
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = np.where(_letters()[codes], 1 + (codes > 127), 0)
    new = np.ones(len(codes), bool)
    new[1:] = (kind[1:] == 0) | (kind[1:] != kind[:-1])
    starts = np.flatnonzero(new)
    ends, kind = np.append(starts[1:], len(codes)), kind[starts]
    numbers = np.minimum(codes[starts], 129).astype(np.int16)
    numbers[(kind == 0) & (codes[starts] > 127)] = 129
    spaced = np.zeros(len(starts), bool)
    spaced[1:] = (kind[1:] > 0) & (numbers[:-1] == 32)
    words = np.flatnonzero(kind == 1)
    at, size = starts[words], (ends - starts)[words]
    first = codes[at]
    sort = np.searchsorted(LENGTHS, size, "right") + (len(LENGTHS) + 1) * (first < 97)
    short = np.flatnonzero((size == 2) | (size == 3))
    packed = first[short] | 32
    for k in (1, 2):
        packed = packed | np.where(size[short] > k, codes[np.minimum(at[short] + k, len(codes) - 1)] | 32, 0) << np.uint32(8 * k)
    for k, meant in enumerate(MEANINGS):
        for word in meant:
            sort[short[packed == _packed(word)]] = SORTS - len(MEANINGS) + k
    numbers[words] = WORDS[sort + SORTS * spaced[words]]
    numbers[kind == 2] = np.where(spaced[kind == 2], WORDS[2 * SORTS], 128)
    kept = np.ones(len(starts), bool)
    kept[:-1] = ~spaced[1:]
    return numbers[kept], starts[kept], ends[kept]


@dataclass
class Tagger:
    """Weights: for each direction the input rows (130, 4h) and recurrence (h, 4h); then emissions and the CRF."""

    inputs: list[np.ndarray]
    inner: list[np.ndarray]
    out: np.ndarray
    bias: np.ndarray
    moves: np.ndarray

    def states(self, ids: np.ndarray, keep: bool = False):
        """Hidden states (T, B, 2h) of ids (B, T); with keep also what training needs."""
        size, n, h = ids.shape[1], len(ids), self.inner[0].shape[0]
        hidden, kept = np.zeros((size, n, 2 * h), self.out.dtype), []
        for d in (0, 1):
            state, cell, trace = np.zeros((n, h), self.out.dtype), np.zeros((n, h), self.out.dtype), []
            for t in range(size) if d == 0 else range(size - 1, -1, -1):
                x = self.inputs[d][ids[:, t]]
                x += state @ self.inner[d]
                gates, new = 0.5 * np.tanh(0.5 * x[:, : 3 * h]) + 0.5, np.tanh(x[:, 3 * h :])
                before, cell = cell, gates[:, :h] * cell + gates[:, h : 2 * h] * new
                squashed = np.tanh(cell)
                if keep:
                    trace.append((t, state, before, gates, new, squashed))
                state = gates[:, 2 * h :] * squashed
                hidden[t, :, d * h : (d + 1) * h] = state
            kept.append(trace)
        return (hidden, kept) if keep else hidden

    def emissions(self, ids: np.ndarray) -> np.ndarray:
        """(T, B, TAGS) from ids (B, T): states() @ out + bias, with the halves of the sigmoids taken into the weights."""
        size, n, h = ids.shape[1], len(ids), self.inner[0].shape[0]
        at, hidden = np.ascontiguousarray(ids.T, np.intp), np.empty((size, n, h), self.out.dtype)
        emit = np.zeros((size, n, TAGS), self.out.dtype) + self.bias
        state, cell, into = (np.empty((n, h), self.out.dtype) for _ in range(3))
        gates = [np.empty_like(state) for _ in range(4)]
        for d in (0, 1):
            enter, inner = self.inputs[d].copy(), self.inner[d] * 0.5  # states are held twice as large
            enter[:, : 3 * h] *= 0.5
            inner[:, : 3 * h] *= 0.5
            enter, inner = ([np.ascontiguousarray(w) for w in np.split(x, 4, axis=1)] for x in (enter, inner))
            state[:], cell[:] = 0, 0
            for t in range(size) if d == 0 else range(size - 1, -1, -1):
                for gate, e, i in zip(gates, enter, inner, strict=True):
                    np.matmul(state, i, out=into)
                    np.take(e, at[t], 0, out=gate, mode="clip")
                    gate += into
                    np.tanh(gate, out=gate)
                forget, admit, leave, new = gates
                for gate in (forget, admit, leave):
                    gate += 1
                forget *= cell
                admit *= new
                np.add(forget, admit, out=cell)
                cell *= 0.5
                np.tanh(cell, out=into)
                np.multiply(leave, into, out=state)
                hidden[t] = state
            emit += hidden @ (self.out[d * h : (d + 1) * h] * 0.5)
        return emit

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The best tags (B, T) under emissions and transitions; windows where nothing can beat all outside need no search."""
        emit = self.emissions(ids)
        tags = np.zeros(ids.shape, np.int8)
        open_ = np.flatnonzero(self.may_hold(emit))
        if len(open_):
            tags[open_] = self.best(emit[:, open_])
        return tags

    def may_hold(self, emit: np.ndarray) -> np.ndarray:
        """(B): whether some path may score as much as all outside. Exact but for transitions, of which the best of a sort counts."""
        moves = self.moves - self.moves[0, 0]
        enter, leave = float(np.where(BARRED, -1e4, moves)[:, 1::2].max()), float(moves[1:, 0].max())
        onward = np.array([max(moves[k, k + 1], moves[k + 1, k + 1]) for k in range(1, TAGS, 2)], emit.dtype)
        first, further = emit[:, :, 1::2] - emit[:, :, :1] + enter, emit[:, :, 2::2] - emit[:, :, :1] + onward
        inside = emit[0, :, 1::2] - emit[0, :, :1]  # against all outside, by kind: now in a span
        best = inside.max(1)
        top = best.copy()
        for t in range(1, len(emit)):
            inside += further[t]
            np.maximum(inside, first[t] + np.maximum(best, 0)[:, None], out=inside)
            np.max(inside, 1, out=best)
            np.maximum(top, best, out=top)
        return np.maximum(top + max(leave, 0.0), best) >= 0

    def best(self, emit: np.ndarray) -> np.ndarray:
        """Viterbi: the tags (B, T) of the highest sum of emissions (T, B, TAGS) and transitions."""
        size, n = emit.shape[:2]
        back = np.zeros((size, n, TAGS), np.int8)
        score = emit[0] + START
        for t in range(1, size):
            ways = score[:, :, None] + self.moves
            back[t] = ways.argmax(1)
            score = np.take_along_axis(ways, back[t][:, None, :].astype(np.int64), 1)[:, 0] + emit[t]
        tags = np.empty((n, size), np.int8)
        tags[:, -1] = score.argmax(1)
        for t in range(size - 1, 0, -1):
            tags[:, t - 1] = back[t][np.arange(n), tags[:, t]]
        return tags


#: A tag for further characters can't come first, nor after another kind.
START = np.array([0.0, *(0.0 if i % 2 else -1e4 for i in range(1, TAGS))], np.float32)
BARRED = np.array([[i % 2 == 0 and i > 0 and j not in (i, i - 1) for i in range(TAGS)] for j in range(TAGS)])


def fit(snippets: list[tuple[str, list[tuple[int, int, int]]]], seed: int = 9) -> Tagger:
    """A tagger of snippets and their labelled spans (kind, start, end)."""
    rng = np.random.default_rng(seed)
    h, read = HIDDEN, [symbols(text[:SPAN]) for text, _ in snippets]
    size = max(len(numbers) for numbers, _, _ in read)
    ids, tags = np.zeros((len(snippets), size), np.int16), np.zeros((len(snippets), size), np.int64)
    for k, (numbers, starts, _) in enumerate(read):
        ids[k, : len(numbers)] = numbers
        for kind, start, end in snippets[k][1]:
            first, last = np.searchsorted(starts, (start, end))
            tags[k, first:last] = 2 + 2 * kind
            tags[k, first : first + 1] = 1 + 2 * kind
    draw = lambda *shape: rng.normal(0, 0.15, shape).astype(np.float32)
    model = Tagger([draw(130, 4 * h) for _ in (0, 1)], [draw(h, 4 * h) for _ in (0, 1)], draw(2 * h, TAGS), np.zeros(TAGS, np.float32), np.where(BARRED, -1e4, 0).astype(np.float32))
    for w in model.inputs:
        w[:, :h] += 1  # cells keep their contents at first
    weights = [*model.inputs, *model.inner, model.out, model.bias, model.moves]
    means, squares, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    for epoch in range(EPOCHS):
        for part in np.array_split(rng.permutation(len(snippets)), max(1, len(snippets) // BATCH)):
            slopes = gradients(model, ids[part], tags[part])
            norm = np.sqrt(sum(float((g**2).sum()) for g in slopes))
            step += 1
            rate = RATE * (1 - epoch / EPOCHS) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for w, m, s, g in zip(weights, means, squares, slopes, strict=True):
                g = g * min(1.0, 5.0 / max(norm, 1e-9))
                m += 0.1 * (g - m)
                s += 0.001 * (g**2 - s)
                w -= rate * m / (np.sqrt(s) + 1e-8)
            model.moves[BARRED] = -1e4
    return model


def gradients(model: Tagger, ids: np.ndarray, tags: np.ndarray) -> list[np.ndarray]:
    """Gradients of the mean negative log likelihood of tags, by weight: the CRF's marginals, then back through time."""
    n, size = ids.shape
    h = model.inner[0].shape[0]
    hidden, kept = model.states(ids, keep=True)
    emit = hidden @ model.out + model.bias
    fore, aft = np.empty_like(emit), np.zeros_like(emit)
    total = lambda x, axis: (m := x.max(axis, keepdims=True)).squeeze(axis) + np.log(np.exp(x - m).sum(axis))
    fore[0] = emit[0] + START
    for t in range(1, size):
        fore[t] = total(fore[t - 1][:, :, None] + model.moves, 1) + emit[t]
    for t in range(size - 2, -1, -1):
        aft[t] = total(model.moves + (aft[t + 1] + emit[t + 1])[:, None, :], 2)
    whole = total(fore[-1], 1)
    miss = np.exp(fore + aft - whole[None, :, None])
    pairs = np.zeros_like(model.moves)
    for t in range(1, size):
        pairs += np.exp(fore[t - 1][:, :, None] + model.moves + (emit[t] + aft[t])[:, None, :] - whole[:, None, None]).sum(0)
    np.add.at(pairs, (tags[:, :-1].ravel(), tags[:, 1:].ravel()), -1)
    miss[np.arange(size)[:, None], np.arange(n), tags.T] -= 1
    miss /= n
    down = miss @ model.out.T
    inputs, inner = [np.zeros_like(w) for w in model.inputs], [np.zeros_like(w) for w in model.inner]
    order = np.argsort(ids.T.ravel(), kind="stable")  # places by character
    found, firsts = np.unique(ids.T.ravel()[order], return_index=True)
    for d in (0, 1):
        from_state, from_cell = np.zeros((n, h), down.dtype), np.zeros((n, h), down.dtype)
        entered = np.empty((size, n, 4 * h), down.dtype)
        for t, state, before, gates, new, squashed in reversed(kept[d]):
            forget, enter, leave = gates[:, :h], gates[:, h : 2 * h], gates[:, 2 * h :]
            into = down[t][:, d * h : (d + 1) * h] + from_state
            from_cell = from_cell + into * leave * (1 - squashed**2)
            x = np.concatenate([from_cell * before * forget * (1 - forget), from_cell * new * enter * (1 - enter), into * squashed * leave * (1 - leave), from_cell * enter * (1 - new**2)], axis=1)
            entered[t] = x
            inner[d] += state.T @ x
            from_state, from_cell = x @ model.inner[d].T, from_cell * forget
        inputs[d][found] = np.add.reduceat(entered.reshape(size * n, -1)[order], firsts)
    return [*inputs, *inner, np.einsum("tnh,tnk->hk", hidden, miss), miss.sum((0, 1)), pairs / n]


def added_spans(texts: list[str], base: list[list[tuple[int, int, int]]], model: Tagger) -> list[list[tuple[int, int, int]]]:
    """Spans that the tagger finds beside the base spans, for each text."""
    read = [symbols(text) for text in texts]
    windows: dict[int, list[tuple[int, int]]] = {}
    for k, (numbers, _, _) in enumerate(read):
        for start in range(0, max(len(numbers) - (WINDOW - STRIDE), 1), STRIDE) if len(numbers) else ():
            windows.setdefault(min(WINDOW, -(-(len(numbers) - start) // STEP) * STEP), []).append((k, start))
    found: list[list[tuple[int, int, int, int]]] = [[] for _ in texts]
    for size, part in ((size, of[i : i + TOGETHER]) for size, of in windows.items() for i in range(0, len(of), TOGETHER)):
        ids = np.zeros((len(part), size), np.int16)
        for i, (k, start) in enumerate(part):
            got = read[k][0][start : start + size]
            ids[i, : len(got)] = got
        tags = model.decode(ids)
        for i in np.flatnonzero(tags.any(1)):
            k, start = part[i]
            numbers, starts, ends = read[k]
            row, end = tags[i], min(WINDOW, len(numbers) - start)
            for at in np.flatnonzero(row % 2 == 1):
                until = at + 1
                while until < end and row[until] == row[at] + 1:
                    until += 1
                if at < end:
                    room = min(at if start else WINDOW, WINDOW - until if start + end < len(numbers) else WINDOW)
                    found[k].append((int(room), (int(row[at]) - 1) // 2, int(starts[start + at]), int(ends[start + until - 1])))
    out = []
    for text, own, spans in zip(texts, base, found, strict=True):
        taken, kept = [(s, e) for _, s, e in own], []
        for room, kind, s, e in sorted(spans, key=lambda x: (-x[0], x[2], x[3], x[1])):
            s, e = _trimmed(text, s, e)
            if room > 0 and valid(KINDS[kind], text[s:e]) and all(e <= a or b <= s for a, b in taken):
                taken.append((s, e))
                kept.append((kind, s, e))
        out.append(sorted(kept))
    return out


def _trimmed(text: str, start: int, end: int) -> tuple[int, int]:
    while end > start and text[end - 1] in " .,;:!?\n\t|*#$%&-":
        end -= 1
    while start < end and text[start] in " .,;:!?\n\t|*#$%&-":
        start += 1
    return start, end


def examples(texts: list[str], seed: int = 13, count: int = SAMPLE_SNIPPETS) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Snippets with labelled spans: base spans in texts, and drawn data in plain and other forms put into texts, beside numbers that are none."""
    rng = random.Random(seed)
    out = []
    for text in texts:
        spans = base_spans(text)
        for _, s, e in rng.sample(spans, min(SNIPPETS_A_TEXT, len(spans))):
            low = max(0, s - rng.randrange(10, 90))
            part = text[low : low + SPAN]
            out.append((part, [(k, a - low, b - low) for k, a, b in spans if a >= low and b <= low + len(part)]))
    out = out[: count // 3]
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))

    def card() -> str:
        body = rng.choice("3456") + digits(14)
        return body + next(c for c in "0123456789" if luhn(body + c))

    def name() -> str:
        return "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(3, 9)))

    def drawn() -> tuple[int | None, str]:
        c = card()
        four = [c[i : i + 4] for i in range(0, 16, 4)]
        host, end = name() + rng.choice(["", str(rng.randrange(10))]), rng.choice(["com", "org", "net", "de", "fr", "es", "io"])
        user = rng.choice([name(), f"{name()}.{name()}", f"{name()}{digits(2)}", f"{name()}.{digits(2)}"])
        a, b = rng.choice([("(", ")"), ("[", "]"), (" (", ") "), (" [", "] ")])
        area, country = digits(3), rng.randrange(1, 99)
        emails = [
            f"{user}@{host}.{end}", f"{user}@{host}.{end}", f"{user}@{name()}.{host}.{end}", f"{user}{a}at{b}{host}.{end}",
            f"{user}{a}at{b}{host}{a}dot{b}{end}", f"{user} @ {host}.{end}", f"{user} at {host} dot {end}",
        ]
        cards = [c, "-".join(four), " ".join(four), ".".join(four)]
        phones = [
            f"+{country} ({area}) {digits(3)}-{digits(4)}", f"+{country} {area} {digits(3)} {digits(4)}", f"({area}) {digits(3)}-{digits(4)}",
            f"{area}-{digits(3)}-{digits(4)}", f"{area}.{digits(3)}.{digits(4)}", f"00{rng.randrange(10, 99)} {area} {digits(7)}",
        ]
        none = [
            digits(rng.choice([1, 2, 3, 4, 5, 6, 7, 20, 24])), f"{rng.randrange(1900, 2100)}-{rng.randrange(1, 13):02}-{rng.randrange(1, 29):02}",
            f"{digits(2)}.{digits(2)}", f"{digits(1)}.{digits(1)}.{digits(2)}", "".join(rng.choice("0123456789abcdef") for _ in range(40)),
            f"{digits(2)}:{digits(2)}:{digits(2)}", f"{digits(1)},{digits(3)},{digits(3)}", f"@{name()}", f"{name()} at {name()}", f"{name()} at {name()}. {name()}",
        ]
        kind = rng.choice([0, 0, 0, 1, 2, 2, 3, 3, None, None])
        return kind, rng.choice(none if kind is None else (emails, [".".join(str(rng.randrange(256)) for _ in range(4))], cards, phones)[kind])

    fill = [t for t in texts if len(t) > 40] or ["the of and to in is that it was for on are as with"]
    while len(out) < count:
        text = rng.choice(fill)
        low = rng.randrange(max(1, len(text) - 60))
        before = re.sub("[0-9@]", "", text[low : low + rng.randrange(5, 70)])
        after = re.sub("[0-9@]", "", text[low + 70 : low + 70 + SPAN])
        kind, item = drawn()
        before = before.rstrip("+(.-") + rng.choice([" ", " ", " ", "\n", ": ", ", ", "| "])
        part = (before + item + rng.choice([" ", " ", ", ", ". ", "\n", " | ", "*** "]) + after)[:SPAN]
        out.append((part, [(kind, len(before), len(before) + len(item))] if kind is not None and len(before) + len(item) <= len(part) else []))
    return out


def train(docs: DataFrame, text_col: str = "text", rows: int = SAMPLE_ROWS) -> Tagger:
    """A tagger from at most rows texts that hold a digit or @, at most 20,000 characters long, those of the smallest hash; at most SNIPPETS_A_TEXT snippets of each, a third of SAMPLE_SNIPPETS in all, beside drawn ones. Null texts are left out."""
    marked = docs.where(F.col(text_col).rlike("[0-9@]") & (F.length(text_col) <= 20_000)).select(F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h"))
    lowest = marked.select("h").distinct().orderBy("h").limit(rows).collect()  # hashes alone: each task sends its lowest
    if not lowest:
        return fit(examples([]))
    sample = marked.where(F.col("h") <= lowest[-1]["h"]).dropDuplicates(["h"]).collect()
    return fit(examples([r["text"] for r in sorted(sample, key=lambda r: r["h"])]))


def find_personal_data(docs: DataFrame, model: Tagger, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, base, added: arrays of (kind, start, end)), a row for each row of docs.

    Positions are code points, the end exclusive; nulls and empty texts have no spans. The tagger runs over
    every window of every text. Rows are treated one by one, so null and repeated ids are carried through, and an
    empty table gives an empty result. Only the id and the text are read.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    spans = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        with released():
            for whole in batches:
                for batch in portions(whole, 1, PORTION):
                    texts = [t or "" for t in batch.column(1).to_pylist()]
                    base = [base_spans(t) for t in texts]
                    added = added_spans(texts, base, model)
                    yield pa.RecordBatch.from_arrays([batch.column(0), shown(base), shown(added)], ["doc_id", "base", "added"])

    def shown(found: list) -> pa.Array:
        return pa.array([[{"kind": KINDS[k], "start": s, "end": e} for k, s, e in own] for own in found], spans)

    kind, listed = docs.schema[id_col].dataType.simpleString(), "array<struct<kind:string,start:long,end:long>>"
    return spread(docs.select(F.col(id_col), F.col(text_col).cast("string"))).mapInArrow(find, f"doc_id {kind}, base {listed}, added {listed}")


def digests(found: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of find_personal_data's rows."""
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    place = lambda s: F.array_position(F.array(*map(F.lit, KINDS)), s["kind"])
    joined = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    both = F.array_sort(F.transform(F.concat("base", "added"), lambda s: F.struct(place(s).alias("place"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return found.select("doc_id", *map(count, KINDS), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(both).alias("spans"))
