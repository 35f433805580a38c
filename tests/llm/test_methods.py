"""The methods inside the corpus operators against plain versions: edits, prefixes, gradients, decoding, segments, repeated rows."""

import random
from collections import Counter
from itertools import product

import numpy as np
import pytest

from strata.llm import bpe, counts, embed, minhash, mixing, pii, ppm, toxicity

LETTERS = ["a", "b", "e", " ", "  ", "'s", "'", "r", "1", "é", "\n", "🙂", "ing", " the", "tion", "\t"]


def drawn(rng, n):
    return "".join(rng.choice(LETTERS) for _ in range(rng.randrange(n)))


def test_edited_texts_are_encoded_as_from_scratch():
    vocabulary, rng = bpe.load(*bpe.default_vocabulary()), random.Random(1)
    texts = [drawn(rng, 80) for _ in range(150)] + ["".join(rng.choice("abcdefghijklmnopqrst") for _ in range(3000))]
    for text in texts:
        held = bpe.EncodedText(vocabulary, text)
        for _ in range(4):
            at = rng.randrange(len(text) + 1)
            until, new = min(len(text), at + rng.randrange(6)), drawn(rng, 4)
            text = text[:at] + new + text[until:]
            held.replace(at, until, new)
            assert held.text == text and held.ids() == vocabulary.encode(text)
    data = texts[-1].encode()
    table = bpe.PrefixTable(vocabulary, data)
    for _ in range(30):
        at = rng.randrange(len(data))
        data = data[:at] + b"xy" + data[at + 1 :]
        assert table.replace(at, at + 1, b"xy") < 400 and table.last == bpe.PrefixTable(vocabulary, data).last


def test_counts_of_every_prefix():
    counter, rng = counts.load(counts.default_path()), random.Random(2)
    for _ in range(60):
        text = drawn(rng, 20)
        normal, table = counter.normal(text), counter.table(text)
        spans = [m.span() for m in counter.pattern.finditer(normal)]
        exact = [counter.count(normal[:i]) for i in range(len(normal) + 1)]
        assert all(table.at(j, k) == exact[a + k] for j, (a, b) in enumerate(spans) for k in range(b - a))
        for budget in range(table.total + 2):
            whole, more = table.within(budget)
            end = spans[whole][0] + more if whole < len(spans) else len(normal)
            longest = max(i for i, n in enumerate(exact) if n <= budget)
            assert exact[end] <= budget and not normal[end:longest].strip()


def test_toxicity_gradients_and_forward_pass():
    rng = np.random.default_rng(3)
    model = toxicity.started(rng)
    for part in ("embedding", "out"):
        setattr(model, part, getattr(model, part).astype(np.float64))
    model.filters, model.bias = [f.astype(np.float64) for f in model.filters], [b.astype(np.float64) + 0.05 for b in model.bias]
    texts = [rng.integers(1, 60, (n, 3)).astype(np.int32) for n in (7, 4, 9)]
    ids = np.concatenate([np.concatenate([t, np.zeros((toxicity.PAD, 3), np.int32)]) for t in texts])
    begins, labels = np.cumsum([0, *(len(t) + toxicity.PAD for t in texts)]), np.array([1, 0, 1])
    plain = []
    for t in texts:
        vectors, features = np.concatenate([model.embedding[t].sum(1), np.zeros((3, model.embedding.shape[1]))]), []
        for f, b in zip(model.filters, model.bias, strict=True):
            features += [max(0.0, *(sum(vectors[i + j] @ f[j, :, k] for j in range(len(f))) + b[k] for i in range(len(t)))) for k in range(f.shape[2])]
        plain.append(np.array(features) @ model.out + model.base)
    assert np.allclose(model.logits(ids, begins), plain)

    def loss():
        z = model.logits(ids, begins)
        return float(np.mean(np.log1p(np.exp(z)) - labels * z))

    (rows, table), slopes, _ = toxicity.gradients(model, ids, begins, labels)
    kept = rows > 0
    checked = [(model.embedding, [(r, c) for r in rows[kept][:4] for c in (0, 5)], {(r, c): table[i, c] for i, r in enumerate(rows) for c in (0, 5)})]
    for w, g in zip([*model.filters, *model.bias, model.out], slopes, strict=True):
        places = [tuple(rng.integers(0, n) for n in w.shape) for _ in range(4)]
        checked.append((w, places, {p: g[p] for p in places}))
    for w, places, slope in checked:
        for p in places:
            w[p] += 1e-6
            up = loss()
            w[p] -= 2e-6
            down = loss()
            w[p] += 1e-6
            assert (up - down) / 2e-6 == pytest.approx(slope[p], abs=1e-5)


def tagger(rng, h=3):
    draw = lambda *shape: rng.normal(0, 0.5, shape)
    moves = np.where(pii.BARRED, -1e4, draw(pii.TAGS, pii.TAGS))
    return pii.Tagger([draw(130, 4 * h) for _ in (0, 1)], [draw(h, 4 * h) for _ in (0, 1)], draw(2 * h, pii.TAGS), draw(pii.TAGS), moves)


def score(model, emit, tags):
    return emit[0, tags[0]] + pii.START[tags[0]] + sum(model.moves[a, b] + emit[t + 1, b] for t, (a, b) in enumerate(zip(tags, tags[1:], strict=False)))


def test_viterbi_and_gradients_of_the_tagger():
    rng = np.random.default_rng(4)
    model = tagger(rng)
    ids = rng.integers(1, 130, (3, 4))
    emit = model.states(ids) @ model.out + model.bias
    assert np.allclose(emit, model.emissions(ids))
    paths = [p for p in product(range(pii.TAGS), repeat=4)]
    totals = np.array([[score(model, emit[:, b], p) for p in paths] for b in range(3)])
    best = [paths[i] for i in totals.argmax(1)]
    assert [tuple(x) for x in model.best(emit)] == best and [tuple(x) for x in model.decode(ids)] == best
    for shift in (0.0, 2.0, 4.0, 8.0):  # windows that need no search hold nothing
        raised = emit + np.where(np.arange(pii.TAGS) == 0, shift, 0.0)
        assert not (model.best(raised).any(1) & ~model.may_hold(raised)).any()
    tags = np.array([[0, 1, 2, 0], [0, 0, 3, 4], [5, 0, 7, 8]])

    def loss():
        emit, out = model.states(ids) @ model.out + model.bias, 0.0
        for b in range(3):
            all_paths = np.array([score(model, emit[:, b], p) for p in paths])
            out += all_paths.max() + np.log(np.exp(all_paths - all_paths.max()).sum()) - score(model, emit[:, b], tags[b])
        return out / 3

    slopes = pii.gradients(model, ids, tags)
    for w, g in zip([*model.inputs, *model.inner, model.out, model.bias], slopes, strict=False):
        p = (int(ids[0, 1]), 1) if w.shape[0] == 130 else tuple(rng.integers(0, n) for n in w.shape)
        w[p] += 1e-5
        up = loss()
        w[p] -= 2e-5
        assert (up - loss()) / 2e-5 == pytest.approx(g[p], abs=1e-4)
        w[p] += 1e-5


def test_segments_and_counts_of_grams():
    rng = random.Random(5)
    texts = [bytes(rng.choice(b"abc ") for _ in range(n)) for n in (0, 5, 1300, 1, 0, 40)]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    expected = [[int.from_bytes((b"\xff" * 5 + t + b"\xff")[p : p + 6], "big") for p in range(len(t) + 1)] for t in texts]
    for size in (7, 64, 1 << 20):
        got = [[] for _ in texts]
        for found, first, starts in ppm.Stream(data, offsets, 5).segments(size):
            for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(found)], strict=True)):
                got[first + k] += found[a:b].tolist()
        assert got == expected
    counted = ppm.Counted()
    keys, trained = np.array(rng.choices(range(50), k=900), np.uint64), np.array(rng.choices([False, True], k=900))
    for i in range(0, 900, 100):
        counted.add(keys[i : i + 100], trained[i : i + 100])
        counted._turn()
    found, n = counted.result()
    assert dict(zip(found.tolist(), n.tolist(), strict=True)) == {k: int(trained[keys == k].sum()) for k in set(keys.tolist())}
    values = ppm.Values(found, n)
    assert (values.of(keys) == np.array([trained[keys == k].sum() for k in keys])).all()


def test_tables_follow_from_the_number_of_vectors():
    assert [embed.projections_and_tables(n)[0] for n in (0, 20, 51_282, 5_000_000)] == [1, 1, 14, 22]
    for n in (1000, 10**6):
        k, tables = embed.projections_and_tables(n)
        assert (1 - embed.cell_share(np.sqrt(0.2), embed.CELL) ** k) ** tables <= embed.MISS


def test_rows_that_repeat_an_id(spark):
    from pyspark.sql import functions as F

    equal = spark.createDataFrame([(1, "a b c d e f g", "s")] * 9 + [(2, "x " * 40, "t"), (None, "u v w x y", "s"), (None, None, None)], "doc_id long, text string, source string").repartition(3)
    plan = mixing.mix_sources(equal)
    copies = {r["doc_id"]: r["n"] for r in plan.where("doc_id is not null").groupBy("doc_id").agg(F.sum("copies").alias("n")).collect()}
    got = Counter(r["doc_id"] for r in mixing.mixed(equal).collect())
    assert all(got[i] == n for i, n in copies.items())
    long = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, long), (7, long + " end"), (7, "quite another text of seven words"), (None, "q r s t u v"), (None, long)], "doc_id long, text string")
    kept = sorted(map(str, (tuple(r) for r in minhash.drop_near_duplicates(docs).collect())))
    assert kept == sorted(map(str, [(1, long), (7, "quite another text of seven words"), (None, "q r s t u v")]))
    scored = ppm.score_documents(docs, F.coalesce(F.col("doc_id") == 7, F.lit(True))).collect()
    assert sorted(str(r["doc_id"]) for r in scored) == ["1", "7", "7", "None", "None"] and len({r["score"] for r in scored}) == 4
