"""Each corpus operator against brute force on small tables with nulls, blanks, ties and repeats."""

import hashlib
import math
import os
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from strata.llm import bpe, counts, embed, exact, graph, minhash, mixing, pii, ppm, substring, tables, toxicity, words

SCHEMA = "text string, doc_id long, lang string, source string, name string, size long, block long"
SPLIT = re.compile(rb"[^\x20\x09-\x0d]+")


def prose(rng, n, pool=None):
    pool = pool or [f"w{i}" for i in range(400)]
    return " ".join(rng.choice(pool) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    """(text, doc_id): copies, near copies, shared passages, nulls, blanks, odd letters, one long text."""
    rng = random.Random(4)
    base = [prose(rng, 120) for _ in range(6)]
    shared = prose(rng, 70)
    out = [None, "", " \t\n", "a b", "A  B", "x", "Ünïcode 🙂 words here", "\x0b\x0c", "a\x1cb"]
    for text in base:
        split = text.split()
        out += [text, text.replace(" ", "  "), text.upper()]
        for _ in range(6):
            near = list(split)
            near[rng.randrange(120)] = "changed" + str(rng.random())
            out.append(" ".join(near))
        out.append(prose(rng, 30) + " " + shared + " " + prose(rng, 40))
        out.append(" ".join(split[:55] + [prose(rng, 20)] + split[60:]))
    out.append(prose(rng, 6000))
    return [(t, i) for i, t in enumerate(out)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    full = [(t, i, "en", ["b", "a", None][i % 3], "clash", 1, 2) for t, i in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3).persist()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def low(text):
    return bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())


def test_words_are_those_of_the_pattern(rows):
    texts = [t for t, _ in rows]
    found = words.Words(*words.bytes_of(pa.array(texts)))
    for i, t in enumerate(texts):
        part = slice(found.first[i], found.first[i + 1])
        assert [bytes(found.data[a:b]) for a, b in zip(found.starts[part], found.ends[part], strict=True)] == SPLIT.findall((t or "").encode())
    by_word = defaultdict(set)
    for h, a, b in zip(found.hashes(), found.starts, found.ends, strict=True):
        by_word[bytes(found.data[a:b])].add(int(h))
    assert all(len(x) == 1 for x in by_word.values()) and len({x for v in by_word.values() for x in v}) == len(by_word)
    runs = words.Runs(found.hashes())
    assert (runs.of(np.array([3]), np.array([9])) == runs.of(np.array([3]), np.array([9]))).all()


def test_exact(docs, rows, empty, spark):
    groups = defaultdict(list)
    for t, i in rows:
        groups[re.sub(r"[\x20\x09-\x0d]", "", t or "")].append((-len(t or ""), i))
    expected = {}
    for norm, members in groups.items():
        keep = min(members)[1]
        for _, i in members:
            expected[i] = (keep, len(members), i == keep, hashlib.sha256(norm.encode()).hexdigest())
    for size in (7, 4096):
        got = exact.exact_duplicates(docs, block_chars=size)
        assert {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in got.collect()} == expected
    kept = exact.drop_exact_duplicates(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, x in expected.items() if x[2])
    assert exact.exact_duplicates(empty).count() == 0 and exact.drop_exact_duplicates(empty).count() == 0
    odd = spark.createDataFrame([("a", None), ("a", None), ("a", 5), ("a ", 5), ("b", 5)], "text string, doc_id long")
    got = sorted((r["text_sha256"], r["kept"], r["keep_id"], r["group_size"]) for r in exact.exact_duplicates(odd).collect())
    assert sum(k for _, k, _, _ in got) == 2 and {(i, n) for _, _, i, n in got} == {(5, 4), (5, 1)}
    assert sorted(map(tuple, exact.drop_exact_duplicates(odd).collect())) == [("a ", 5), ("b", 5)]


def test_exact_when_fingerprints_meet(docs, monkeypatch):
    expected = sorted((r["doc_id"], r["keep_id"]) for r in exact.exact_duplicates(docs).collect())
    from pyspark.sql import functions as F

    monkeypatch.setattr(exact.F, "xxhash64", lambda c: (F.length(c) % 3).cast("long"))
    assert sorted((r["doc_id"], r["keep_id"]) for r in exact.exact_duplicates(docs, block_chars=50).collect()) == expected


def shingles(text):
    w = SPLIT.findall(low(text))
    return frozenset(tuple(w[j : j + 5]) for j in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates(docs, rows, empty, percent, spark):
    sets = {i: shingles(t) for t, i in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in sets:
            if j < i and sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(docs, threshold=percent / 100).collect()}
    assert got == {i: (len(sets[i]), find(i), find(i) == i) for i in sets}
    if percent == 80:
        assert minhash.near_duplicates(empty).count() == 0
        odd = spark.createDataFrame([("a b c", None), ("a b c", 3), (None, None), ("", 4)], "text string, doc_id long")
        assert sorted((str(r["doc_id"]), str(r["component_id"]), r["kept"]) for r in minhash.near_duplicates(odd).collect()) == [("3", "3", True), ("4", "4", True), ("None", "3", False), ("None", "None", True)]


def test_links_between_unlinked_members_of_a_bucket_are_found(spark):
    """A hub whose members are linked with one another but not with it, in every bucket."""
    rng = random.Random(8)
    base = prose(rng, 200).split()
    texts = [" ".join(base)]
    for g in range(4):
        parent = list(base)
        for p in rng.sample(range(0, 200, 6), 5):
            parent[p] = f"g{g}x{p}"
        for m in range(5):
            child = list(parent)
            child[rng.randrange(200)] = f"m{g}{m}"
            texts.append(" ".join(child))
    rows = list(zip(texts, range(len(texts)), strict=True))
    sets = {i: shingles(t) for t, i in rows}
    links = {(i, j) for i in sets for j in sets if i < j and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])}
    root = {i: i for i in sets}
    for _ in sets:
        for i, j in links:
            root[i] = root[j] = min(root[i], root[j])
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(rows, "text string, doc_id long"), threshold=0.85).collect()}
    assert got == root and 1 < len(set(root.values())) < len(root)


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5)]
    root = {x: x for e in edges for x in e}
    for _ in range(400):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got.get(x, x) == r for x, r in root.items())


def test_repeats(docs, rows, empty, spark):
    assert {(a - b) % substring.PERIOD for a in substring.COVER for b in substring.COVER} == set(range(substring.PERIOD))
    first, split = {}, {i: (t or "").encode().split() for t, i in rows}
    for i, w in split.items():
        for j in range(len(w) - 49):
            first.setdefault(tuple(w[j : j + 50]), i)
    expected = {}
    for i, w in split.items():
        gone = [False] * len(w)
        for j in range(len(w) - 49):
            if first[tuple(w[j : j + 50])] < i:
                gone[j : j + 50] = [True] * 50
        expected[i] = (len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode())
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in substring.remove_repeats(docs).collect()}
    assert got == expected and sum(x[1] > 0 for x in expected.values()) > 10
    assert substring.remove_repeats(empty).count() == 0
    text = prose(random.Random(1), 80)
    odd = spark.createDataFrame([(text, None), (text, 3), (text, 3), (text, 4), ("other", 3)], "text string, doc_id long")
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_removed"]) for r in substring.remove_repeats(odd).collect()) == [("3", 1, 0), ("3", 80, 0), ("3", 80, 0), ("4", 80, 80), ("None", 80, 0)]


def test_ppm(docs, rows, empty):
    from pyspark.sql import functions as F

    order, count, known = ppm.ORDER, [defaultdict(Counter) for _ in range(ppm.ORDER + 1)], Counter()
    padded = {i: b"\xff" * order + low(t) + b"\xff" for t, i in rows}
    for t, i in rows:
        if zlib.crc32(str(i).encode()) % 10:
            known.update([*SPLIT.findall(low(t)), None])
            for p in range(order, len(padded[i])):
                for k in range(order + 1):
                    count[k][padded[i][p - k : p]][padded[i][p]] += 1

    def bits(context, symbol):
        gone, total = set(), 0.0
        for k in range(order, -1, -1):
            live = {s: n for s, n in count[k].get(context[order - k :], {}).items() if s not in gone}
            whole, kinds = sum(live.values()), len(live)
            if symbol in live:
                return total - math.log2((live[symbol] - 0.5) / whole)
            total -= math.log2(kinds / 2 / whole) if kinds else 0
            gone |= set(live)
        return total + math.log2(max(256 - len(gone), 1))

    n, v = sum(known.values()), len(known)
    scored = ppm.score_documents(docs, F.crc32(F.col("doc_id").cast("string")) % 10 != 0, block_bytes=5000)
    got = {r["doc_id"]: r for r in scored.collect()}
    assert len(got) == len(rows)
    for t, i in rows:
        w = [*SPLIT.findall(low(t)), None]
        assert (got[i]["n_tokens"], got[i]["n_known"], got[i]["train_tokens"]) == (len(w), sum(known[x] > 0 for x in w), n)
        assert got[i]["base_score"] == pytest.approx(sum(math.log10((known[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w))
        assert got[i]["score"] == pytest.approx(-math.log10(2) * sum(bits(padded[i][p - order : p], padded[i][p]) for p in range(order, len(padded[i]))), rel=1e-6)
    assert ppm.score_documents(empty, F.lit(True)).count() == 0


def test_bpe_equals_the_library(docs, rows, empty):
    import public_tokenizers
    import tiktoken

    vocabulary = bpe.load(*bpe.default_vocabulary())
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={})
    for r in bpe.encode_documents(docs).collect():
        text = dict((i, t) for t, i in rows)[r["doc_id"]] or ""
        ids = library.encode_ordinary(text)
        assert r["ids"] == struct.pack(f"<{len(ids)}I", *ids) and r["decoded"] == text.encode() and r["n_tokens"] == len(ids)
    assert bpe.encode_documents(empty).count() == 0
    rng = random.Random(3)
    for _ in range(300):
        text = "".join(rng.choice("abetion '1é\n🙂") for _ in range(rng.randrange(50)))
        assert vocabulary.encode(text) == library.encode_ordinary(text)
    table = bpe.PrefixTable(vocabulary, b"tokenisation")
    table.append(b"alised")
    whole = bpe.PrefixTable(vocabulary, b"tokenisationalised")
    assert table.last == whole.last
    table.replace(3, 5, b"xyz")
    assert table.ids() == bpe.PrefixTable(vocabulary, b"tokxyzisationalised").ids()


def test_token_counts_equal_the_library(docs, rows, empty):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(counts.default_path())
    text_of = dict((i, t or "") for t, i in rows)
    for r in counts.token_counts(docs, limit=100).collect():
        n = len(library.encode(text_of[r["doc_id"]], add_special_tokens=False).ids)
        assert (r["n_tokens"], r["n_bytes"], r["over_limit"]) == (n, len(text_of[r["doc_id"]].encode()), n > 100)
    assert counts.token_counts(empty).count() == 0
    counter, rng = counts.load(counts.default_path()), random.Random(3)
    for _ in range(300):
        text = "".join(rng.choice(["a", "B", "İ", "Σ", " ", "'s", "1", "é", "é", "<|endoftext|>", "\n", "🙂", "ing", "　"]) for _ in range(rng.randrange(30)))
        assert counter.count(text) == len(library.encode(text, add_special_tokens=False).ids), text
    running = counter.running("one two three four")
    assert running[-1] == counter.count("one two three four") and counter.fitting("one two three four", running[2]) == 2


def test_mixing(docs, rows, empty, spark):
    got = mixing.mix_sources(docs, bins=4).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(i for _, i in rows)
    by = defaultdict(list)
    for r in got:
        by[r["source"]].append(r)
    assert sum(rs[0]["target"] for rs in by.values()) == pytest.approx(sum(r["size"] for r in got))
    for rs in by.values():
        assert rs[0]["target"] <= 3 * rs[0]["source_size"] + 1e-9 and all(r["taken"] <= 3 * r["size"] for r in rs)
        assert abs(sum(r["taken"] for r in rs) - rs[0]["target"]) <= max(r["size"] for r in rs)
    assert sorted(map(tuple, mixing.mix_sources(docs.repartition(7)).collect())) == sorted(map(tuple, mixing.mix_sources(docs).collect()))
    copies = Counter(r["doc_id"] for r in mixing.mixed(docs, bins=4).collect())
    assert copies == Counter({r["doc_id"]: r["copies"] for r in got if r["copies"]}) and mixing.mixed(docs).columns == docs.columns
    assert mixing.mix_sources(empty).count() == 0
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 5), (None, 100)], "source string, source_size long")
    targets = {r["source"]: r["target"] for r in mixing.source_targets(sizes).collect()}
    assert targets == pytest.approx({"a": 30, "c": 15, None: 300, "b": 1115 - 345})  # all but b stop at three times their size


def test_embeddings(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(8, 32))
    vectors = [list(map(float, centres[i % 8] + rng.normal(size=32) * (0.1 + 0.05 * (i % 5)))) for i in range(160)]
    rows = [(i, v) for i, v in enumerate(vectors)] + [(200 + i, vectors[3]) for i in range(5)] + [(300, None), (301, []), (302, [0.0] * 32), (303, [float("nan")] * 32), (304, [None] + [1.0] * 31), (305, [1.0, 2.0]), (306, [x * 7 for x in vectors[3]])]
    usable = {i: np.array(v) / np.linalg.norm(v) for i, v in rows if v and None not in v and np.isfinite(v).all() and any(v)}
    links = {i: {j for j in usable if j != i and len(usable[i]) == len(usable[j]) and float(usable[i] @ usable[j]) >= 0.9} for i in usable}
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for tile in (256, 8):
        got = {r["vec_id"]: r for r in embed.near_embeddings(df, tile=tile).collect()}
        assert {i: got[i]["n_links"] for i in got} == {i: len(links.get(i, ())) for i, _ in rows}
        for i in links:
            assert all(got[j]["component_id"] == got[i]["component_id"] for j in links[i])
        assert all(got[i]["kept"] and got[i]["component_id"] == i for i in range(300, 306))
    assert embed.near_embeddings(df.limit(0)).count() == 0


def test_embeddings_table_by_table_write_no_more_than_a_few_times_the_vectors(spark, monkeypatch):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(900, 32))
    vectors = (centres[np.arange(3000) % 900] + rng.normal(size=(3000, 32)) * 0.25).astype(np.float32)
    units = vectors / np.linalg.norm(vectors.astype(float), axis=1, keepdims=True)
    near = units @ units.T >= 0.9
    written, real = [], embed.materialize

    def spied(df, *args, **kwargs):
        table = real(df, *args, **kwargs)
        written.append(sum(os.path.getsize(name.removeprefix("file://")) for name in table.inputFiles()))
        return table

    monkeypatch.setattr(embed, "materialize", spied)
    monkeypatch.setattr(embed, "ROUND_BYTES", 1, raising=False)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>")
    got = {r["vec_id"]: r["n_links"] for r in embed.near_embeddings(df).collect()}
    found, wanted = sum(got.values()), int(near.sum()) - 3000
    assert all(got[i] <= near[i].sum() - 1 for i in got) and 0.99 * wanted < found <= wanted
    assert max(written) < 3 * vectors.nbytes


def test_base_spans_are_those_of_the_patterns():
    patterns = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")
    rng = random.Random(1)
    texts = ["".join(rng.choice("a1@.-+ (9é%") for _ in range(rng.randrange(60))) for _ in range(5000)]
    for text in [*texts, "4111 1111 1111 1111", "1.2.3.256 1.2.3.4.5.6.7.8", "a@b@c.de@f.gh", "+1 (017) 555-7713", "x" * 200_000 + "@", "1" * 200_000]:
        expected = []
        for k, p in enumerate(patterns) if len(text) < 1000 else ():
            for m in re.finditer(p, text):
                d = re.sub("[^0-9]", "", m[0])
                if (k == 1 and any(int(x) > 255 for x in m[0].split("."))) or (k == 2 and not (16 <= len(d) <= 19 and pii.luhn(d))) or (k == 3 and not 8 <= len(d) <= 15):
                    continue
                expected.append((k, m.start(), m.end()))
        assert pii.base_spans(text) == expected


def test_symbols_cover_the_text_in_fewer_steps():
    rng = random.Random(12)
    texts = ["".join(rng.choice(["at", " At", "dot ", "com", "é", "éa", " ", "  ", "1", "@", ".", "\n", "\u3000", "stone", " Rain", "\ud800", "\U0001f600"]) for _ in range(rng.randrange(40))) for _ in range(500)]
    for text in texts:
        numbers, starts, ends = pii.symbols(text)
        covered = [k for s, e in zip(starts, ends, strict=True) for k in range(s, e)]
        assert covered == sorted(set(covered)) and all(text[k] == " " and text[k + 1].isalpha() for k in set(range(len(text))) - set(covered))
        assert all(0 < n < 130 for n in numbers) and all(text[s:e].isalpha() or e == s + 1 for s, e in zip(starts, ends, strict=True))
    of = lambda text: tuple(pii.symbols(text)[0])
    assert of("at") == of("AT") != of("as") == of("is") != of("dot") and of("a at") != of("a as") and of("org") == of("io") and of("1 at")[1] != of("1\nat")[2]
    text = prose(rng, 400, ["the", "and", "rain", "falls", "stone"])
    assert len(pii.symbols(text)[0]) < len(text) / 3


def test_tagger(spark, empty):
    rng = random.Random(5)
    model = pii.fit(pii.examples([prose(rng, 40, ["the", "and", "rain", "falls", "stone"]) for _ in range(40)]))
    held = pii.examples([prose(rng, 40, ["the", "and", "rain", "falls", "stone"]) for _ in range(40)], seed=77, count=200)
    right = made = wanted = 0
    for text, spans in held:
        got = pii.added_spans([text], [[]], model)[0]
        right, made, wanted = right + len(set(got) & set(spans)), made + len(got), wanted + len(spans)
    assert right > 0.7 * wanted and right > 0.7 * made
    text = "the rain " * 60 + "call (212) 555-0187 and write to anna@example.org " + "stone falls " * 40
    docs = spark.createDataFrame([(1, text), (2, None), (3, ""), (None, "10.1.2.3")], "doc_id long, text string")
    found = {r["doc_id"]: r for r in pii.digests(pii.find_personal_data(docs, model)).collect()}
    at = text.index("anna")
    assert f"email:{at}:{at + 16}" in found[1]["spans"].split(",") and found[1]["n_email"] == 1
    assert found[1]["base_sha256"] == hashlib.sha256(f"email:{at}:{at + 16}".encode()).hexdigest()
    assert found[2]["spans"] == found[3]["spans"] == "" and found[None]["spans"] == "ip:0:8" and found[None]["n_ip"] == 1
    assert pii.find_personal_data(empty, model).count() == 0


def test_toxicity(spark, empty):
    rng = random.Random(5)
    clean, bad = [f"word{i}" for i in range(300)], ["vile", "vilest", "vilely", "foulish", "foulness"]

    def text(toxic):
        out = prose(rng, rng.randrange(20, 80), clean).split()
        for _ in range(3 if toxic else 0):
            out.insert(rng.randrange(len(out)), rng.choice(bad))
        return " ".join(out)

    y = [int(i % 5 == 0) for i in range(900)]
    rows = [(i, text(t), ["en", "fr", None][i % 3]) for i, t in enumerate(y)] + [(900, None, None), (901, "", "en"), (None, "vile", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, t) for i, t in enumerate(y)] + [(None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    got = toxicity.score_documents(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    held = [(r["score"] >= 0.7) == (y[r["doc_id"]] == 1) for r in got if r["doc_id"] is not None and r["doc_id"] < 900 and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    assert sum(held) > 0.95 * len(held)
    kept = toxicity.drop_toxic(docs, model)
    assert kept.columns == docs.columns and {900, 901} <= {r["doc_id"] for r in kept.collect()}
    assert toxicity.score_documents(empty, model).count() == 0 and toxicity.drop_toxic(empty, model).count() == 0
    assert toxicity.train(empty, labels).scores(pa.array(["x"]))[0] < 0.5


def test_shared_folder_is_the_cluster_s(spark):
    assert tables.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
