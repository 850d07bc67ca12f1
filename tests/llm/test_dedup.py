"""op1, op7 and op8 against brute force."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerline.llm import repeated, simhash_dedup, substring_dedup, suffix_dedup, textarrays

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def same(df, expected):
    got = sorted((tuple(r) for r in df.collect()), key=repr)
    assert got == sorted(expected, key=repr)


def brute_words(rows, size):
    words = [WORD.findall(t or "") for _, t in rows]
    count = Counter(tuple(w[k:k + size]) for w in words for k in range(len(w) - size + 1))
    out = []
    for (i, _), w in zip(rows, words):
        gone = {x for k in range(len(w) - size + 1) if count[tuple(w[k:k + size])] > 1 for x in range(k, k + size)}
        out.append((i, len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone))))
    return out


@pytest.mark.parametrize("chunk_bytes", [2 << 20, 20_000])
def test_op1_small(small, small_rows, chunk_bytes):
    same(substring_dedup.report(small, chunk_bytes=chunk_bytes), brute_words(small_rows, 35))


def test_op1_edges(edge_docs, edge_rows, no_docs):
    same(substring_dedup.report(edge_docs, chunk_bytes=9000), brute_words([r[:2] for r in edge_rows], 35))
    assert substring_dedup.report(no_docs).collect() == []


def test_op1_short_window_and_spans(spark):
    docs = spark.createDataFrame([(1, "a b c d x y"), (2, "q a b c z")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in substring_dedup.dedup(docs, window=3).collect()}
    assert got[1]["kept"] == "d x y" and got[2]["kept"] == "q z"
    assert [tuple(s) for s in got[2]["spans"]] == [(1, 4)]


@pytest.mark.parametrize("module,brute,size", [(substring_dedup, brute_words, 35), (suffix_dedup, lambda *x: brute_bytes(*x), 100)])
def test_equal_rows_by_the_third(spark, edge_rows, module, brute, size, monkeypatch):
    """Rows equal in id (or of null id) and text fill no chunk, whatever their
    number; each still counts and comes out."""
    monkeypatch.setattr(repeated, "COPIES", 40)
    alone = " ".join(f"only{k}" for k in range(60))
    rows = [r[:2] for r in edge_rows] + [(777, alone)] * 130 + [(None, alone + " x")] * 90 + [(8, "short")] * 2500 + [(9, None)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    dealt, total, copied = repeated.chunked(docs, "doc_id", "text", 20_000)
    dealt = dealt.collect()
    assert copied and total == sum(len((t or "").encode()) for _, t in rows) and max(r["n"] for r in dealt) == 40
    assert sum(r["n"] for r in dealt) == len(rows) and sum(r["n"] for r in dealt if r["id"] == 777) == 130
    assert Counter(r["id"] for r in dealt)[777] == 4
    same(module.report(docs, chunk_bytes=20_000), brute(rows, size))


def brute_bytes(rows, size):
    raw = [(-10**18 if i is None else i, i, (t or "").encode()) for i, t in rows]
    first = {}
    for key, _, b in raw:
        for k in range(len(b) - size + 1):
            s = b[k:k + size]
            first[s] = min(first.get(s, (key, k)), (key, k))
    out = []
    for key, i, b in raw:
        gone = bytearray(len(b))
        for k in range(len(b) - size + 1):
            if first[b[k:k + size]] < (key, k):
                gone[k:k + size] = b"\1" * size
        runs = sum(1 for x in bytes(gone).split(b"\0") if x)
        out.append((i, len(b), sum(gone), runs, sha(bytes(x for x, g in zip(b, gone) if not g))))
    return out


@pytest.mark.parametrize("options", [{}, {"chunk_bytes": 30_000, "many": 3}])
def test_op7_small(small, small_rows, options):
    same(suffix_dedup.report(small, **options), brute_bytes(small_rows, 100))


def test_op7_edges(edge_docs, edge_rows, no_docs):
    same(suffix_dedup.report(edge_docs, chunk_bytes=9000, many=5), brute_bytes([r[:2] for r in edge_rows], 100))
    assert suffix_dedup.report(no_docs).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab", max_size=24), min_size=1, max_size=6))
def test_op7_columns_agree_with_suffix_sorting(texts):
    """The columns' transform and common prefixes, against sorted suffixes."""
    width = max(map(len, texts))
    order, common = np.arange(len(texts)), np.zeros(len(texts), np.int16)
    for c in range(width - 1, -1, -1):
        symbol = np.array([ord(t[c]) if c < len(t) else 0 for t in texts])
        order, common = suffix_dedup.insert_column(order, common, symbol)
        suffixes = [texts[k][c:] for k in order]
        assert suffixes == sorted(suffixes)
        for k in range(1, len(order)):
            a, b = suffixes[k - 1], suffixes[k]
            n = next((x for x in range(min(len(a), len(b))) if a[x] != b[x]), min(len(a), len(b)))
            assert common[k] == n


def brute_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    shingles = [" ".join(w[k:k + 3]) for k in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(rows, fps):
    n = len(rows)
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a in range(n):
        for b in range(a):
            if bin(fps[a] ^ fps[b]).count("1") <= 3:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    least = {}
    for k in range(n):
        if rows[k][0] is not None:
            least[find(k)] = min(least.get(find(k), 10**18), rows[k][0])
    return [(rows[k][0], f"{fps[k]:016x}", least.get(find(k))) for k in range(n)]


def test_op8_small_and_edges(small, small_rows, edge_docs, edge_rows, no_docs):
    for docs, rows in ((small, small_rows), (edge_docs, [r[:2] for r in edge_rows])):
        expected = brute_components(rows, [brute_fingerprint(t) for _, t in rows])
        same(simhash_dedup.report(docs), expected)
        same(simhash_dedup.report(docs, hot=2), expected)
    assert simhash_dedup.report(no_docs).collect() == []


def test_op8_links_of_planted_fingerprints(spark):
    """Every pair within three bits is connected, by either way of searching."""
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 62, 40, np.uint64)
    fps = {int(b) for b in base}
    for b in base:
        for _ in range(30):
            flips = rng.choice(64, rng.integers(1, 4), replace=False)
            fps.add(int(b) ^ sum(1 << int(f) for f in flips))
    values = np.array(sorted(fps), np.uint64)
    a, b = np.nonzero(np.bitwise_count(values[:, None] ^ values[None]) <= 3)
    expected = simhash_dedup.roots(len(values), a, b)
    nodes = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fp long")
    for hot in (10**9, 4):
        got = [(r["u"], r["v"]) for r in simhash_dedup.links(nodes, 3, hot).collect()]
        pairs = np.array(got, np.int64).view(np.uint64)
        assert (np.bitwise_count(pairs[:, 0] ^ pairs[:, 1]) <= 64).all()
        x, y = np.searchsorted(values, pairs[:, 0]), np.searchsorted(values, pairs[:, 1])
        assert (simhash_dedup.roots(len(values), x, y) == expected).all()
    for block in (64, 10**6):  # flips of few varying bits, and blocks
        near = np.array([sum(1 << k for k in range(14) if m >> k & 1) for m in range(3000)], np.uint64)
        near = near[rng.random(len(near)) < 0.5]
        i, j = simhash_dedup.close_links(near, 2, block)
        a, b = np.nonzero(np.bitwise_count(near[:, None] ^ near[None]) <= 2)
        assert (simhash_dedup.roots(len(near), i, j) == simhash_dedup.roots(len(near), a, b)).all()


@pytest.mark.parametrize("distance", [1, 2, 3, 4])
def test_op8_variants_meet(spark, distance):
    """Fingerprints share a key if they differ in at most distance bits."""
    rng = np.random.default_rng(distance)
    rows = []
    for k in range(200):
        a = int(rng.integers(0, 1 << 62))
        b = a ^ sum(1 << int(f) for f in rng.choice(64, distance, replace=False))
        rows += [(k, x - (1 << 64) if x >= 1 << 63 else x) for x in (a, b)]
    keys = simhash_dedup.variant_keys(spark.createDataFrame(rows, "k long, fp long"), distance).distinct()
    of = {}
    for r in keys.collect():
        of.setdefault(r["fp"], set()).add(r["key"])
    for x, y in zip(rows[::2], rows[1::2]):
        assert of[x[1]] & of[y[1]]


def test_op8_kept_one(spark, edge_docs, edge_rows):
    kept = simhash_dedup.kept_one(edge_docs)
    assert kept.columns == edge_docs.columns
    components = {r[2] for r in brute_components([r[:2] for r in edge_rows], [brute_fingerprint(r[1]) for r in edge_rows])}
    assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == sorted(components, key=repr)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2**64 - 1), st.integers(0, 2**32 - 1)), max_size=50), st.integers(1, 9))
def test_packed_hashes_round_trip(pairs, buckets):
    first = np.array([p[0] >> 8 << 8 for p in pairs], np.uint64)
    second = np.array([p[1] for p in pairs], np.uint32)
    d = repeated.Distinct(first, second)
    seen = []
    for _, _, b, payload in d.messages(0, 0, buckets, d.second % 2 == 1):
        h, count, s, flag = repeated.unpack(payload)
        seen += list(zip(h.tolist(), s.tolist(), count.tolist(), flag.tolist()))
    expected = Counter(zip(first.tolist(), second.tolist()))
    assert sorted(seen) == sorted((a, b, n, b % 2 == 1) for (a, b), n in expected.items())


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text("ab \n.é", max_size=12), max_size=6), st.integers(1, 4))
def test_word_arrays(texts, size):
    import pyarrow as pa
    data, off = textarrays.utf8(pa.array(texts, pa.string()))
    w = textarrays.words(data, off)
    raw = data.tobytes()
    got = [[raw[a:b].decode() for a, b in zip(w.start[x:y], w.end[x:y])] for x, y in zip(w.row[:-1], w.row[1:])]
    expected = [WORD.findall(t) for t in texts]
    assert got == expected
    r = textarrays.Rolling(1)
    h = r.windows(r.of_words(data, w), size)
    ok = textarrays.window_starts(w.row, size)
    flat = [x for ws in expected for x in ws]
    for i in range(len(h)):
        for j in range(i):
            assert (h[i] == h[j]) == (flat[i:i + size] == flat[j:j + size])
    starts = [k for ws, a in zip(expected, w.row) for k in range(a, a + len(ws) - size + 1)]
    assert np.flatnonzero(ok).tolist() == starts
