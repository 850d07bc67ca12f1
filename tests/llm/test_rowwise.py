"""op2, op3, op4, op6, op9 and op10 on edge rows and against brute force."""

import base64
import hashlib
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerline.llm import byte_bpe, decontaminate, langid_crf, pii_deobfuscate, quality_bands, toxicity_mil

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# op2

def brute_quality(text):
    text = text or ""
    w = WORD.findall(text)
    windows = [tuple(w[k:k + 8]) for k in range(len(w) - 7)]
    count = Counter(windows)
    repeat = {x for k, s in enumerate(windows) if count[s] > 1 for x in range(k, k + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeat),
            len(w) < 20 or 100 * len(repeat) > 30 * len(w))


def test_op2(edge_docs, edge_rows, no_docs, small, small_rows):
    for docs, rows in ((edge_docs, edge_rows), (small, small_rows)):
        got = quality_bands.judge(docs)
        base = got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
        assert rows_of(base) == sorted(((r[0], *brute_quality(r[1])) for r in rows), key=repr)
        assert not [r for r in got.collect() if r["base_failed"] and r["kept"]]
    assert quality_bands.judge(no_docs).collect() == []


def test_op2_bands(spark):
    rng = random.Random(5)
    syllables = [a + b for a in "bcdfghjklmnprstvw" for b in "aeiou"]
    prose = " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(6000))
    noise = base64.b64encode(rng.randbytes(30_000)).decode()
    cycle = prose[:700]
    rows = [(1, prose), (2, prose[:300]), (3, " ".join(noise[k:k + 50] for k in range(0, 40_000, 50))),
            (4, "\n".join(cycle[k % 600:k % 600 + 90] for k in range(0, 60_000, 7))), (5, prose[:20_000] + noise[:20_000])]
    kept = {r["doc_id"]: r["kept"] for r in quality_bands.judge(spark.createDataFrame(rows, "doc_id long, text string"), repeat_percent=100).collect()}
    assert kept == {1: True, 2: True, 3: False, 4: False, 5: False}
    assert quality_bands.chunk_edges(10_000) == [(0, 4096), (4096, 8192), (8192, 10_000)]
    assert quality_bands.chunk_edges(8300) == [(0, 4096), (4096, 8300)]


# op3

def test_op3_edges(spark, edge_docs, edge_rows, no_docs, small):
    got = {r["doc_id"]: r for r in langid_crf.report(small.unionByName(edge_docs.select(*small.columns).where("doc_id is not null")
                                                     .selectExpr("doc_id + 900000 as doc_id", "text", "cast(null as string) lang", "source", "n_chars"))).collect()}
    truth = {r["doc_id"]: r for r in small.collect()}
    held = [i for i in truth if got[i]["held_out"]]
    assert held and np.mean([got[i]["lang_pred"] == truth[i]["lang"] for i in held]) > 0.9
    for r in edge_rows:
        if r[0] is not None:
            g = got[r[0] + 900000]
            assert (g["lang_pred"] == "und") == (r[1] is None or not any(c.isalpha() for c in r[1]))
            assert 0 <= g["score"] <= 1
    assert langid_crf.report(no_docs).collect() == []
    assert {r["lang_pred"] for r in langid_crf.predict(edge_docs, None).collect()} == {"und"}


def test_op3_forward_backward_is_exact():
    rng = np.random.default_rng(0)
    emit, trans = rng.normal(size=(5, 1, 3)), rng.normal(size=(3, 3))
    post, log_z, expected = langid_crf.forward_backward(emit, np.array([5]), trans)
    paths = np.array(np.meshgrid(*[range(3)] * 5)).reshape(5, -1)
    score = sum(emit[t, 0, paths[t]] for t in range(5)) + sum(trans[paths[t], paths[t + 1]] for t in range(4))
    p = np.exp(score - score.max())
    assert np.isclose(log_z[0], np.log(p.sum()) + score.max())
    p /= p.sum()
    for t in range(5):
        assert np.allclose(post[t, 0], [p[paths[t] == k].sum() for k in range(3)])
    moves = [[sum(p[(paths[t] == a) & (paths[t + 1] == b)].sum() for t in range(4)) for b in range(3)] for a in range(3)]
    assert np.allclose(expected, moves)


def test_op3_code_switched_words(spark, small):
    rows = [(r["lang"], r["text"]) for r in small.collect()]
    model = langid_crf.train([(lang, text[:3000]) for lang, text in rows])
    of = {lang: next(t for x, t in rows if x == lang and len(t) > 1200) for lang in ("en", "de")}
    docs = spark.createDataFrame([(1, " ".join(of["en"].split()[:30] + of["de"].split()[:40]))], "doc_id long, text string")
    runs = langid_crf.predict(docs, model, runs=True).first()["runs"]
    assert runs[0]["lang"] == "en" and runs[-1]["lang"] == "de"
    assert max(runs, key=lambda r: r["words"])["lang"] == "de"


def test_op3_every_label_is_learned(spark, monkeypatch):
    """More labels than the hundred, rare ones too; a share is never 0."""
    docs = spark.createDataFrame([(1000 * k + i, f"lang{k}", f"{chr(0x4e00 + 40 * k)}{chr(0x4e01 + 40 * k)} zz{chr(97 + k % 26)}{i}")
                                  for k in range(130) for i in range(9 if k else 300)], "doc_id long, lang string, text string")
    options = dict(id_col="doc_id", text_col="text", label_col="lang")
    picked = Counter(x for x, _ in langid_crf.passages_of(docs, docs["doc_id"] >= 0, per_label=500, **options))
    assert len(picked) == 130 and max(picked.values()) == 300
    picked = Counter(x for x, _ in langid_crf.passages_of(docs, docs["doc_id"] >= 0, per_label=25, **options))
    assert len(picked) == 130 and picked["lang129"] == 9 and 5 <= picked["lang0"] <= 50
    model = langid_crf.fit(docs, docs["doc_id"] >= 0)
    assert len(model.labels) == 130 and model.weights.shape == (1 << 17, 130)
    got = langid_crf.predict(docs, model).join(docs, "doc_id").collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in got]) > 0.9
    assert 0 < langid_crf.threshold(500, 10**15) < langid_crf.threshold(500, 10**12)
    assert langid_crf.threshold(500, 10) == langid_crf.threshold(500, 500) == (1 << 63) - 1
    monkeypatch.setattr(langid_crf, "threshold", lambda per_label, n: -1)
    assert len(langid_crf.passages_of(docs, docs["doc_id"] >= 0, per_label=500, **options)) == 130
    copies = spark.range(3000).selectExpr("1L doc_id", "'xx' lang", "'one text' text")
    assert langid_crf.passages_of(copies, copies["doc_id"] >= 0, per_label=500, **options) == [("xx", "one text")]


def test_op3_groups_of_chains(small_rows, monkeypatch):
    model = langid_crf.train([(k, t[:2000]) for k, t in zip("abc" * 5, (t for _, t in small_rows if len(t or "") > 500))])
    v = langid_crf.Vocabulary(pa.array([t for _, t in small_rows[:6]], pa.string()), langid_crf.Rolling(langid_crf.SEED))

    def whole():
        out = np.zeros((len(v.word), 3))
        for word, post in model.posteriors(v):
            out[word] = post
        return out

    one = whole()
    monkeypatch.setattr(langid_crf, "CELLS", 1000)
    assert len(list(model.posteriors(v))) > 1 and np.allclose(one, whole(), atol=1e-5) and np.allclose(one.sum(1), 1, atol=1e-4)


# op4

def test_op4(spark, edge_docs, no_docs):
    rng = random.Random(3)
    plain, bad = [f"w{k}" for k in map(lambda x: "".join(chr(97 + int(c)) for c in str(x)), range(100, 900))], ["vile", "rotten", "filthy"]
    docs, labels = [], []
    for i in range(600):
        toxic = i % 4 == 0
        sentences = [[rng.choice(plain) for _ in range(8)] for _ in range(rng.randint(1, 12))]
        if toxic:
            rng.choice(sentences)[rng.randrange(8)] = rng.choice(bad)
        docs.append((i, ". ".join(" ".join(s) for s in sentences) + "."))
        labels.append((i, 1, int(toxic)))
    labels += [(0, 0, 0), (None, 1, 1), (5, 1, None)]  # a second label, null id, null label
    d = spark.createDataFrame(docs, "doc_id long, text string")
    t = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity_mil.report(d, t).collect()}
    held = [i for i in got if got[i]["held_out"]]
    assert 150 < len(held) < 250
    assert np.mean([got[i]["predicted"] == (i % 4 == 0) for i in held]) > 0.95
    assert all(g["predicted"] == (g["score"] >= 0.7) and 0 <= g["score"] <= 1 for g in got.values())
    model = toxicity_mil.fit(d, t)
    found = toxicity_mil.score(spark.createDataFrame([(1, "waa wab. wac rotten filthy vile. wad")], "doc_id long, text string"), model, locate=True).first()
    assert [s["sentence"] for s in found["sentences"]] == [1]
    edge = toxicity_mil.score(edge_docs, model).collect()
    assert len(edge) == edge_docs.count() and all(r["score"] is not None for r in edge)
    assert toxicity_mil.report(no_docs, t).collect() == []
    assert {r["score"] for r in toxicity_mil.report(d, t.limit(0)).collect()} == {0.0}


# op6

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_pii(text):
    out = []
    for k, (kind, p) in enumerate(PATTERNS.items()):
        for m in re.finditer(p, text):
            digits = re.sub("[^0-9]", "", m[0])
            if (kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m[0].split("."))
                    or kind == "card" and 14 <= len(digits) <= 19 and pii_deobfuscate.luhn(digits)
                    or kind == "phone" and 10 <= len(digits) <= 15):
                out.append((m.start(), k, m.end()))
    return [(pii_deobfuscate.KINDS[k], s, e) for s, k, e in sorted(out)]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["a", "1", "2", "255", ".", "@", "-", " ", "+", "(", ")", "b.c", "4111111111111111", "_%", "é"]), max_size=40))
def test_op6_plain(parts):
    text = "".join(parts)
    assert pii_deobfuscate.plain(text) == brute_pii(text)


@pytest.mark.parametrize("text,expected", [
    ("write john dot doe [at] example (dot) com now", [("email", "john dot doe [at] example (dot) com")]),
    ("mail jane.roe at example dot co dot uk please", [("email", "jane.roe at example dot co dot uk")]),
    ("call plus four four seven nine one one one two three four five six", [("phone", "plus four four seven nine one one one two three four five six")]),
    ("card " + "four " + "one " * 15 + "ok", [("card", "four " + " ".join(["one"] * 15))]),
    ("ip 192[.]168[.]0[.]1 and 10 dot 0 dot 0 dot 1", [("ip", "192[.]168[.]0[.]1"), ("ip", "10 dot 0 dot 0 dot 1")]),
    ("ｄｏｅ@ｅxample．com", [("email", "ｄｏｅ@ｅxample．com")]),
    ("jаne@exаmple.com", [("email", "jаne@exаmple.com")]),
    ("jo​hn@exa​mple.com", [("email", "jo​hn@exa​mple.com")]),
    ("see us at example.com today. The dot is here", []), ("one two three four", []), ("table 1 2 3 4 5 6 7 8 9 10 11", []),
    ("the cat at home dot", []), ("x@y.zz [at] q", [("email", "x@y.zz")]),
])
def test_op6_disguises(text, expected):
    base, spans = pii_deobfuscate.find(text)
    assert [(k, text[s:e]) for k, s, e in spans] == expected
    assert set(base) <= set(spans)


@pytest.mark.parametrize("text,expected", [
    ("call +44 20 seven nine four six 0958 now", [("phone", "+44 20 seven nine four six 0958")]),
    ("call +1 555 eight six seven 5309.", [("phone", "+1 555 eight six seven 5309")]),
    ("call +44 (two zero) seven nine four six 0958 now", [("phone", "+44 (two zero) seven nine four six 0958")]),
    ("call +44 two zero seven nine four six zero nine five eight now", [("phone", "+44 two zero seven nine four six zero nine five eight")]),
    ("call plus four four 20 7946 0958 now", [("phone", "plus four four 20 7946 0958")]),
    ("+4 4 2 0 7 9 4 six 0 9 5 8", [("phone", "+4 4 2 0 7 9 4 six 0 9 5 8")]),
    ("card 4111 1111 1111 one one one one ok", [("card", "4111 1111 1111 one one one one")]),
    ("host one nine two dot one six eight dot zero dot one up", [("ip", "one nine two dot one six eight dot zero dot one")]),
    ("host one nine two [dot] one six eight (dot) zero [.] one up", [("ip", "one nine two [dot] one six eight (dot) zero [.] one")]),
    ("host 192.168.zero.one up", [("ip", "192.168.zero.one")]),
    ("host One Nine Two.one six eight.zero.one up", [("ip", "One Nine Two.one six eight.zero.one")]),
    ("10 dot zero dot 0 dot eins", [("ip", "10 dot zero dot 0 dot eins")]),
    ("in 2 of three or 4 one dot is seven", []), ("One. Two. Three. Four.", []), ("version 3 one, plus one 12", []),
])
def test_op6_part_spelled(text, expected):
    base, spans = pii_deobfuscate.find(text)
    assert [(k, text[s:e]) for k, s, e in spans] == expected and not base


def test_op6_frames(edge_docs, edge_rows, no_docs, small, small_rows):
    def joined(spans):
        return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)

    for docs, rows in ((edge_docs, edge_rows), (small, small_rows)):
        expected = []
        for r in rows:
            base = brute_pii(r[1] or "")
            expected.append((r[0], *[sum(k == kind for k, _, _ in base) for kind in pii_deobfuscate.KINDS], sha(joined(base)),
                             joined(pii_deobfuscate.find(r[1])[1])))
        assert rows_of(pii_deobfuscate.report(docs)) == sorted(expected, key=repr)
    assert pii_deobfuscate.report(no_docs).collect() == []
    text = "a x@y.zz b +1 (555) 123-4567 c"
    assert pii_deobfuscate.redacted(text, pii_deobfuscate.find(text)[1]) == "a [EMAIL] b [PHONE] c"


# op9

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def codec():
    return byte_bpe.Codec(PATH, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def encoding():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(PATH), special_tokens={})


@settings(max_examples=150, deadline=None)
@given(texts=st.lists(st.one_of(st.none(), st.text(max_size=60), st.text("abé' \n12.😀漢", max_size=300)), max_size=8))
def test_op9_as_the_library(codec, encoding, texts):
    ids, off = codec.encode(pa.array(texts, pa.string()))
    data, at = codec.decode(ids, off)
    for k, t in enumerate(texts):
        assert ids[off[k]:off[k + 1]].tolist() == encoding.encode_ordinary(t or "")
        assert data[at[k]:at[k + 1]].tobytes() == (t or "").encode()


def test_op9_long_pieces_and_store(codec, encoding, monkeypatch):
    monkeypatch.setattr(byte_bpe, "STORE", 50)
    for t in ("a" * 5000, "ab" * 3000, "the" * 700, " " * 3000, "x" * 1025, "x" * 1024, " ".join(f"w{k}" for k in range(400))):
        ids, off = codec.encode(pa.array([t, t]))
        assert ids[:off[1]].tolist() == ids[off[1]:].tolist() == encoding.encode_ordinary(t)


def test_op9_frames(edge_docs, edge_rows, no_docs, encoding):
    def expected(r):
        ids = encoding.encode_ordinary(r[1] or "")
        return r[0], len(ids), sha(np.array(ids, "<u4").tobytes()), sha(r[1] or "")
    got = byte_bpe.round_trip(edge_docs, PATH, public_tokenizers.PATTERN)
    assert rows_of(got) == sorted(map(expected, edge_rows), key=repr)
    encoded = byte_bpe.encode(edge_docs, PATH, public_tokenizers.PATTERN)
    decoded = byte_bpe.decode(encoded, PATH, public_tokenizers.PATTERN)
    assert sorted((r["bytes"] for r in decoded.collect())) == sorted((r[1] or "").encode() for r in edge_rows)
    assert byte_bpe.round_trip(no_docs, PATH, public_tokenizers.PATTERN).collect() == []


# op10

LEAK_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def leak_words(text):
    return LEAK_WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute_leaks(rows, items, size=10):
    windows = {}
    for i, t in items:
        w = leak_words(t)
        for k in range(max(1, len(w) - size + 1) if w else 0):
            windows.setdefault(tuple(w[k:k + size]), set()).add(str(i))
    sizes = {len(s) for s in windows}
    out = []
    for r in rows:
        w = leak_words(r[1])
        hit, found = set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if got := windows.get(tuple(w[k:k + n])):
                    hit |= set(range(k, k + n))
                    found |= got
        out.append((r[0], len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)))
    return out


@pytest.mark.parametrize("block_bytes", [4 << 20, 25_000])
def test_op10(spark, edge_docs, edge_rows, no_docs, small, small_rows, block_bytes):
    items = [(1, edge_rows[5][1]), (2, "One"), (3, None), (4, ""), (5, "a b"), (6, edge_rows[5][1]), (7, "word " * 12), (8, edge_rows[13][1][:9000]), (None, "x")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.report(edge_docs, bench, block_bytes=block_bytes)
    assert rows_of(got) == sorted(brute_leaks(edge_rows, [i for i in items if i[0]]), key=repr)
    real = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    expected = brute_leaks(small_rows, [(r["item_id"], r["text"]) for r in real.collect()])
    assert rows_of(decontaminate.report(small, real)) == sorted(expected, key=repr)
    assert decontaminate.report(no_docs, real).collect() == []
    assert not [r for r in decontaminate.report(edge_docs, real.limit(0)).collect() if r["contaminated"]]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=14), min_size=1, max_size=4), st.lists(st.integers(0, 3), max_size=25))
def test_op10_automaton(items, stream):
    a = decontaminate.SuffixAutomaton()
    for s in items:
        a.add(s)
    known = {tuple(s[i:j]) for s in items for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
    for j, (_, n) in enumerate(a.matching(stream)):
        assert n == max([0] + [k for k in range(1, j + 2) if tuple(stream[j + 1 - k:j + 1]) in known])


def test_op10_cleaning(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    docs = spark.createDataFrame([(1, f"Start, {item.title()}! End é."), (2, item), (3, "clean é text")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in decontaminate.annotate(docs, spark.createDataFrame([(1, item)], "item_id long, text string"), max_span=9, max_coverage=0.9).collect()}
    assert got[1]["cleaned"] == "Start, ! End é." and not got[1]["over"]
    assert got[2]["over"] and got[3]["cleaned"] == "clean é text"
    assert [(s["start"], s["end"], s["words"]) for s in got[1]["spans"]] == [(7, 7 + len(item), 12)]


def test_op10_long_items_and_copies(spark):
    """An item longer than a block is cut, each of its windows is found; copies
    of an item change nothing."""
    words = [f"w{i * i % 997}x{i}" for i in range(4000)]
    items = [(1, " ".join(words))] + [(2, "alpha beta gamma")] * 50 + [(3, " ".join(words[100:112]))]
    rows = [(k, " ".join(["pre", *words[a:a + 10], "post"])) for k, a in enumerate(range(0, 3991, 57))]
    rows += [(900, " ".join(words)), (901, "x alpha beta gamma y"), (902, " ".join(words[5:14]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    expected = sorted(brute_leaks(rows, items), key=repr)
    assert all(r[-1] for r in expected if r[0] != 902) and len(expected) == 74
    for block_bytes in (1000, 4 << 20):
        assert rows_of(decontaminate.report(docs, bench, block_bytes=block_bytes)) == expected


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 90), st.integers(1, 8), st.integers(0, 20))
def test_op10_parts_hold_every_window(n, window, more):
    found = decontaminate.parts(n, 2 * window + more, window)
    size = min(n, window)
    assert {k for a, b in found for k in range(a, b - size + 1)} == set(range(n - size + 1)) or not n
    assert all(min(n, window) <= b - a <= 2 * window + more for a, b in found)
