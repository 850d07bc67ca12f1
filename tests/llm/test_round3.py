"""op11, op12 and op13 against brute force."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter, defaultdict
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.llm import exact_dedup, quality_bands, spelling, toxicity_mil, whitening

from .conftest import prose

# --- op11


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def brute_exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[norm(t)].append(i)
    out, seen = [], set()
    for i, t in rows:
        ids = groups[norm(t)]
        keep = min((x for x in ids if x is not None), default=None)
        kept = i == keep and norm(t) not in seen
        if kept:
            seen.add(norm(t))
        out.append((i, keep, len(ids), kept, hashlib.sha256(norm(t).encode()).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_op11_small_and_edges(small, small_rows, edge_docs, edge_rows, no_docs):
    assert got(exact_dedup.report(small)) == brute_exact(small_rows)
    assert got(exact_dedup.report(edge_docs)) == brute_exact([r[:2] for r in edge_rows])
    assert exact_dedup.report(no_docs).collect() == []


def variants(spark):
    """Texts of many chunks that differ in blanks, in one byte, or not at all."""
    rng = random.Random(3)
    long = "".join(rng.choice("abcdé \n\t漢") for _ in range(4000))
    texts = [long, long.replace(" ", " \r\n "), long + " ", " " + long, long[:-1] + "x", long[:1999] + "q" + long[2000:], "", None, " ", "\n\n",
             "\x00", "\x00\x00", "a", "\x00a", "a\x00", "a b", "a\x0bb", "a\x1cb", "a b"]
    rows = [(i, t) for i, t in enumerate(texts * 3)] + [(None, long), (None, long), ("7", None)][:2]
    return rows, spark.createDataFrame(rows, "doc_id long, text string").repartition(5)


@pytest.mark.parametrize("chunk", [1 << 15, 257, 5])
def test_op11_chunks(spark, monkeypatch, chunk):
    monkeypatch.setattr(exact_dedup, "CHUNK", chunk)
    monkeypatch.setattr(exact_dedup, "RANGE", 3 * chunk)
    rows, docs = variants(spark)
    assert got(exact_dedup.report(docs)) == brute_exact(rows)


def test_op11_collisions_are_told_apart(spark, monkeypatch):
    """With bases of 0 and 1 a fingerprint is little more than the length: many
    texts share one, and the comparison by chunks must part them."""
    monkeypatch.setattr(exact_dedup, "BASES", (1, 0, 1, 0))
    monkeypatch.setattr(exact_dedup, "CHUNK", 7)
    monkeypatch.setattr(exact_dedup, "RANGE", 14)
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab") for _ in range(rng.choice([4, 9, 21]))) for _ in range(150)]
    rows = [(i // 2, t) for i, t in enumerate(texts)] + [(None, "abab")] * 2 + [(500, "abab")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    prints = exact_dedup.fingerprints(docs).select("hi", "lo", "n_bytes").distinct().count()
    assert prints < len({t for _, t in rows}) / 2
    assert got(exact_dedup.report(docs)) == brute_exact(rows)


def test_op11_hashes_combine():
    hasher = exact_dedup.Hasher()
    raw = np.frombuffer(bytes(range(256)) * 400, np.uint8)
    cut = np.array([0, 40_000, 102_400])
    size = np.diff(cut)
    for b, base in enumerate(exact_dedup.BASES):
        whole = 0
        for x in raw.tolist():
            whole = (whole * base + x + 1) % exact_dedup.PRIME
        left, right = (sum_of(raw[x:y], base) for x, y in zip(cut, cut[1:]))
        assert exact_dedup.joined(left, right, int(size[1]), base) == whole
        hi, lo = hasher.documents(raw, np.array([0, len(raw)]))
        assert [hi[0] >> 31, hi[0] & exact_dedup.PRIME, lo[0] >> 31, lo[0] & exact_dedup.PRIME][b] == whole


def sum_of(raw, base):
    h = 0
    for x in raw.tolist():
        h = (h * base + x + 1) % exact_dedup.PRIME
    return h


def test_op11_long_text_in_linear_time():
    hasher, took = exact_dedup.Hasher(), []
    for n in (4 << 20, 16 << 20):
        data = np.frombuffer((b"some words \n and  blanks " * (n // 24))[:n], np.uint8)
        t = time.time()
        d, off = exact_dedup.normalised(data, np.array([0, n]))
        hasher.documents(d, off)
        took.append(time.time() - t)
    assert took[1] < 8 * took[0] + 1


def test_op11_kept_rows(edge_docs, edge_rows):
    rows = exact_dedup.kept_rows(edge_docs).collect()
    assert rows[0].asDict().keys() == edge_docs.first().asDict().keys()
    texts = Counter(norm(r["text"]) for r in rows)
    assert set(texts) == {norm(r[1]) for r in edge_rows} and set(texts.values()) == {1}


def test_op11_string_ids(spark):
    docs = spark.createDataFrame([("b", "x  y"), ("a", "x y"), (None, "z")], "name string, body string")
    assert got(exact_dedup.report(docs, "name", "body"))[0][:4] == ("a", "a", 2, True)


# --- op12


def whiten(x):
    x = np.floor(64 * np.asarray(x, np.float64)) + 1_000_000
    c = x - x.mean(0)
    v = c.T @ c / len(x)
    e, a = np.linalg.eigh(v)
    return c, v, e[::-1], a[:, ::-1]


def check_whitened(df, ids, x, components=32):
    rows = df.collect()
    c, v, e, a = whiten(x)
    rank = min(components, int((e > 1e-9 * max(e.max(), 1e-300)).sum()))
    assert len(rows) == rank * len(ids)
    if not rows:
        return
    k = {(r["vec_id"], r["component"]): r for r in rows}
    order = {i: n for n, i in enumerate(ids)}
    n, ints = len(x), (np.floor(64 * np.asarray(x, np.float64))).astype(object)
    dev = ((n * ints - ints.sum(0)) ** 2).sum(1)
    w = np.zeros((len(ids), rank))
    for (i, comp), r in k.items():
        assert r["n"] == n and r["deviation"] == dev[order[i]]
        assert abs(r["explained"] / (e[comp - 1] / np.trace(v)) - 1) < 1e-6
        assert r["identity_error"] < 1e-9
        w[order[i], comp - 1] = r["whitened"]
    gap = [min(abs(e[j] - e[i]) for i in range(len(e)) if i != j) / e[0] for j in range(rank)] if len(e) > 1 else [1.0]
    for j in range(rank):
        if gap[j] > 1e-6:
            expected = c @ a[:, j] / np.sqrt(e[j])
            sign = np.sign(expected @ w[:, j])
            assert np.abs(sign * expected - w[:, j]).max() < 1e-6
    assert np.abs(w.T @ w / n - np.eye(rank)).max() < 1e-8


def test_op12_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = df.collect()
    check_whitened(whitening.report(df), [r["vec_id"] for r in rows], [r["embedding"] for r in rows])


SCHEMA = "vec_id long, embedding array<double>, component string, n string, id int, vector string"


def make(spark, vectors):
    return spark.createDataFrame([(i, v, "x", "y", 1, "z") for i, v in enumerate(vectors)], SCHEMA).repartition(3)


def test_op12_broken_rows_and_ties(spark):
    rng = np.random.default_rng(1)
    good = [rng.normal(size=5).round(3).tolist() for _ in range(60)]
    bad = [None, [], [None, 1.0, 2.0, 3.0, 4.0], [float("nan")] * 5, [1.0, 2.0, float("inf"), 0.0, 0.0], [1.0, 2.0], [1.0, 2.0]]
    df = make(spark, good + bad).union(make(spark, [good[0]] * 40).withColumn("vec_id", F.lit(None).cast("long")))
    rows = whitening.report(df).collect()
    x = good + [good[0]] * 40
    assert len(rows) == 5 * 100 and {r["n"] for r in rows} == {100} and sum(r["vec_id"] is None for r in rows) == 200
    c, v, e, a = whiten(x)
    first = {r["vec_id"]: r["whitened"] for r in rows if r["component"] == 1}
    expected = c[:60] @ a[:, 0] / np.sqrt(e[0])
    found = np.array([first[i] for i in range(60)])
    assert min(np.abs(found - expected).max(), np.abs(found + expected).max()) < 1e-9


def test_op12_degenerate(spark):
    for rows in ([], [None], [[1.0, 2.0]], [[1.0, 2.0]] * 9):
        assert whitening.report(make(spark, rows)).collect() == []
    # one direction only; then equal eigenvalues: corners of a cube and of a box
    line = [[float(t), 2.0 * t, -t + 3.0] for t in range(8)]
    check_whitened(whitening.report(make(spark, line)), range(8), line)
    cube = [[float(a), float(b), float(c)] for a in (0, 1) for b in (0, 1) for c in (0, 2)]
    check_whitened(whitening.report(make(spark, cube)), range(8), cube)
    more = np.random.default_rng(2).normal(size=(20, 40)).tolist()  # fewer vectors than dimensions
    check_whitened(whitening.report(make(spark, more)), range(20), more)


def test_op12_large_entries(spark):
    rng = np.random.default_rng(4)
    x = (rng.normal(size=(30, 3)) * [4e16, 3e16, 1.0]).round().tolist()
    rows = whitening.report(make(spark, x)).collect()
    ints = np.array([[int(64 * v) for v in r] for r in x], object)
    m = whitening.fit(make(spark, x))
    assert m.sums == [int(v) for v in ints.sum(0)] and m.n == 30
    assert {r["deviation"] for r in rows} == {None} and rows[0]["identity_error"] < 1e-4
    one = spark.createDataFrame([(1, [1e300, 0.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<double>")
    assert len(whitening.report(one).collect()) == 2


def test_op12_polynomial(spark):
    rng = np.random.default_rng(7)
    b = rng.integers(-50, 50, (6, 9))
    b[:, 4] = 0
    a = (b.T @ b).astype(object)
    q = whitening.polynomial(spark, a)
    # Faddeev and LeVerrier, in integers
    d, m, c = len(a), np.zeros((len(a), len(a)), object), [1]
    for k in range(1, d + 1):
        m = a.dot(m) + c[-1] * np.eye(d, dtype=int).astype(object)
        c.append(-int(np.trace(a.dot(m))) // k)
    assert q == c[::-1] and q[:3] == [0, 0, 0]
    for n in (2**31 - 1, 2147483629, 91, 25326001):
        assert whitening.is_prime(n) == all(n % f for f in range(2, 1 + int(n**0.5)))


def test_op12_roots():
    q = [1]
    for r in (0, 0, 3, 7, 7, 7, 1000, 1001):
        q = [(q[i - 1] if i else 0) - r * (q[i] if i < len(q) else 0) for i in range(len(q) + 1)]
    assert [whitening.above(q, x) for x in (-1, 0, 6, 7, 1000, 1001)] == [8, 6, 5, 2, 1, 0]
    assert [whitening.root(q, k, 2018) + 1 for k in range(1, 9)] == [1001, 1000, 7, 7, 7, 3, 0, 0]


def test_op12_null_vectors_are_orthonormal():
    a = np.diag([5, 5, 5, 2]).astype(object)
    v = whitening.null_vectors(a, Decimal(5) + Decimal("1e-40"), 3)
    assert np.abs(v @ v.T - np.eye(3)).max() < 1e-15 and np.abs(v[:, 3]).max() < 1e-15


def test_op12_products_are_exact():
    rng = np.random.default_rng(9)
    for most in (50, 10**7, 2**31, 2**62):
        y = rng.integers(-most, most, (200, 4))
        assert (whitening.products(y).astype(object) == y.astype(object).T.dot(y.astype(object))).all()


# --- op13


def brute_words(rows):
    count = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate({c: c + 32 for c in range(65, 91)})
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            count[run] += 1
    return {w: n for w, n in count.items() if len(w) >= 7 and n >= 2}


def near(a, b):
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > 1 or a == b:
        return False
    k = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), len(b))
    return a[k + 1:] == b[k + (len(a) == len(b)):]


def brute_forms(n):
    out = []
    form = {}
    best = {}
    for w in n:
        around = [v for v in n if near(w, v)]
        best[w] = len(around)
        top = min(around, key=lambda v: (-n[v], v), default=None)
        form[w] = top if top is not None and n[top] >= 10 * n[w] else None
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], best[w], None if form[w] is None else n[form[w]]))
    return sorted(out)


def test_op13_edges(edge_docs, edge_rows, no_docs):
    got = sorted(tuple(r) for r in spelling.report(edge_docs).collect())
    assert got == brute_forms(brute_words([r[:2] for r in edge_rows])) and got
    assert spelling.report(no_docs).collect() == []


@pytest.mark.parametrize("pairs_per_key", [spelling.PAIRS, 30, 0])
def test_op13_variants(spark, pairs_per_key):
    """Close words of few letters, long ones, repeated letters, both ends."""
    rng = random.Random(11)
    base = ["abababab", "aaaaaaaa", "bàbébîbõ", "übergrößen", "xyzxyzxyzxyzxyzxyzxyz", "q" * 300]
    words = []
    for b in base:
        for _ in range(40):
            w = list(b)
            for _ in range(rng.randint(0, 2)):
                k = rng.randrange(len(w))
                w[k:k + 1] = rng.choice([[], [rng.choice("abàx")], [w[k], rng.choice("abàx")]])
            words += ["".join(w)] * rng.choice([1, 2, 2, 3, 25, 300])
    rng.shuffle(words)
    rows = [(i, " ".join(words[i::40]) + ("." if i % 2 else " Ab-" + "ABABABAB")) for i in range(40)] + [(3, words[0]), (None, words[1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    expected = brute_forms(brute_words(rows))
    assert len(expected) > 80 and sum(e[1] is not None for e in expected) > 20 and any(e[1] != e[2] for e in expected if e[1])
    assert sorted(tuple(r) for r in spelling.report(docs, pairs_per_key=pairs_per_key).collect()) == expected


def test_op13_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    n = brute_words([(r["doc_id"], r["text"]) for r in df.collect()])
    found = {r["word"]: r for r in spelling.report(df, pairs_per_key=50).collect()}
    assert {w: r["n"] for w, r in found.items()} == n
    for w in sorted(n)[::40]:
        assert found[w]["n_near"] == sum(near(w, v) for v in n)


# --- op2 and op4 by length


def test_op2_junk_in_long_documents(spark):
    import base64
    rng = random.Random(2)
    clean = "\n".join(prose(s, 40) for s in range(330))
    junk = base64.b64encode(rng.randbytes(18_000)).decode()
    line = "The very same line stands here again and again.\n"
    rows = [(1, clean), (2, clean[:92_000] + " " + junk), (3, junk + " " + clean[:92_000]), (4, clean[:90_000] + "\n" + line * 500),
            (5, clean[:60_000] + junk[:4000] + clean[60_000:92_000])]
    assert len(clean) > 92_000
    got = quality_bands.judge(spark.createDataFrame(rows, "doc_id long, text string"), repeat_percent=100).collect()
    assert {r["doc_id"]: r["kept"] for r in got} == {1: True, 2: False, 3: False, 4: False, 5: True}


def labelled(n, size=30):
    rng = random.Random(n)
    clean = [f"{prose(k, 9)}." for k in range(4 * n)]
    rows = []
    for i in range(n):
        text = rng.sample(clean, size)
        if i % 4 == 0:
            text[rng.randrange(size)] = f"{prose(i + 7, 4)} {rng.choice(['rotten', 'filthy'])} {rng.choice(['vile', 'scum'])} {prose(i, 3)}."
        rows.append((i, " ".join(text), int(i % 4 == 0)))
    return rows, clean


def test_op4_length_alone_is_not_toxic(spark):
    rows, clean = labelled(800)
    model = toxicity_mil.train([(y, t) for _, t, y in rows])
    docs = [(k, " ".join((clean * 4)[:k])) for k in (1, 10, 100, 1000, 10_000)] + [(0, " ".join(clean[:2000]) + " You rotten vile thing.")]
    got = {r["doc_id"]: r["score"] for r in toxicity_mil.score(spark.createDataFrame(docs, "doc_id long, text string"), model).collect()}
    assert got.pop(0) > 0.7 and max(got.values()) < 0.3


def test_op4_learns_from_long_documents(spark):
    """A label of which every document is over the byte bound."""
    rows, clean = labelled(400)
    vile = [" ".join(f"{prose(9 * i + k, 5)} rotten filthy vile scum." for k in range(8)) for i, _, _ in rows]
    rows = [(i, t if not y else " ".join([t, vile[i], *random.Random(i).sample(clean, 250)]), y) for i, t, y in rows]
    assert min(len(t) for _, t, y in rows if y) > toxicity_mil.SAMPLE_BYTES
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    truth = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    got = {r["doc_id"]: r["predicted"] for r in toxicity_mil.score(docs, toxicity_mil.fit(docs, truth)).collect()}
    right = sum(got[i] == y for i, _, y in rows)
    assert right > 0.9 * len(rows)


def test_op4_noisy_or_and_its_slope():
    rng = np.random.default_rng(5)
    row = np.array([0, 3, 3, 7, 8])
    y, share = np.array([1.0, 0.0, 0.0, 1.0]), np.array([0.1, 0.2, 0.3, 0.4])
    sentence, feature = np.array([0, 0, 1, 4, 5, 5, 7]), np.array([0, 1, 2, 1, 0, 2, 2])

    def loss(w):
        p = 1 / (1 + np.exp(-w[-1]))
        out = 0.0
        for d in range(4):
            none = 1 - p
            for s in range(row[d], row[d + 1]):
                if s in sentence:
                    none *= 1 - 1 / (1 + np.exp(-(w[-2] + w[:-2][feature[sentence == s]].sum())))
            out -= share[d] * np.log(1 - none if y[d] else none)
        return out
    w = rng.normal(size=5)
    got = toxicity_mil.slope(w, feature, sentence, row, y, share)
    for k in range(5):
        step = np.eye(5)[k] * 1e-6
        assert abs((loss(w + step) - loss(w - step)) / 2e-6 - got[k]) < 1e-6
    z = toxicity_mil.logits(w[:-2], w[-2], feature, sentence, 8)
    assert np.isinf(z).sum() == 3 and toxicity_mil.noisy_or(z, row, -4.0)[1] == pytest.approx(1 / (1 + np.exp(4.0)))
