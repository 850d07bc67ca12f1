"""What a large or repetitive input costs, and that results stay the same."""

import re
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerline.llm import pii_deobfuscate as P
from ledgerline.llm import simhash_dedup as S

# --- op6


@pytest.mark.parametrize("text,expected", [
    ("I met him at noon dot com style", []),
    ("we told them at work dot org once", []),
    ("jane at example dot com", [("email", "jane at example dot com")]),
    ("to jane_at_example_dot_com now", [("email", "jane_at_example_dot_com")]),
    ("Jane_Doe_AT_ex-a_DOT_co_dot_uk.", []),
    ("Jane_Doe_AT_ex-a_DOT_co_dot_uk", [("email", "Jane_Doe_AT_ex-a_DOT_co_dot_uk")]),
    ("look_at_me and me_dot_py", []),
    ("host 1 9 2 . 1 6 8 . 0 . 1 up", [("ip", "1 9 2 . 1 6 8 . 0 . 1")]),
    ("0 1 9 2 . 1 6 8 . 0 . 1 2 3 4", []),
    ("a.b dot c @ d.org", [("email", "a.b dot c @ d.org")]),
])
def test_op6_more_disguises(text, expected):
    assert [(k, text[a:b]) for k, a, b in P.find(text)[1]] == expected


#: The addresses' rule as one pattern, tried from every place: quadratic.
WHOLE = re.compile(
    rf"(?<![A-Za-z0-9._%+-])(?P<local>[A-Za-z0-9_%+-]++(?:(?:\.|{P.DOT_MARK}|[ \t]dot[ \t])[A-Za-z0-9_%+-]++)*?){P.AT_DOMAIN.pattern}")


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(["a", "bob", ".", "@", " @ ", " at ", " dot ", " ", P.AT_MARK, P.DOT_MARK, "é", "-", "_", "x" * 70]), max_size=20))
def test_op6_addresses_backwards(parts):
    text = "".join(parts)
    expected = []
    for m in WHOLE.finditer(text):
        hidden = bool(P.DOTS.search(m["domain"]))
        plain = m["at"] == "@" or m["at"].strip() == "at" or m["at"] == " @ " and "." not in m["domain"]
        if hidden or not plain:
            expected.append((m.start(), m.end(), P.DOTS.sub(".", m["local"]) + "@" + P.DOTS.sub(".", m["domain"])))
    assert list(P.addresses(text)) == expected


@pytest.mark.parametrize("unit", ["a dot ", "a at b dot ", "one ", "one two dot ", "1.", "a@", "a_at_b_dot_", "1 . ", "(at) ",
                                  "x [dot] ", "plus one ", "+", "1-", "a", "a" + P.DOT_MARK, "9 9 . ", "а"])
def test_op6_time_follows_length(unit):
    def seconds(n):
        text = (unit * (n // len(unit) + 1))[:n] + " x@ y dot com (at) one two"
        begin = time.perf_counter()
        P.find(text)
        return time.perf_counter() - begin
    assert seconds(200_000) < 12 * seconds(50_000) + 1


# --- op8


def flipped(rng, n, bits, times):
    x = np.zeros(n, np.uint64)
    for _ in range(times):
        x ^= np.uint64(1) << rng.integers(0, bits, n).astype(np.uint64)
    return np.unique(x)


@pytest.mark.parametrize("bits,times", [(64, 5), (33, 6), (20, 4), (11, 5), (64, 3)])
@pytest.mark.parametrize("distance", [1, 2, 3, 5])
def test_op8_cut_sets_connect_as_all_pairs(bits, times, distance):
    fp = flipped(np.random.default_rng(bits + distance), 2500, bits, times)
    a, b = np.nonzero(np.bitwise_count(fp[:, None] ^ fp[None]) <= distance)
    i, j = S.close_links(fp, distance, block=40)
    assert (S.roots(len(fp), i, j) == S.roots(len(fp), a, b)).all()


@pytest.mark.parametrize("bits", [33, 24, 64])
def test_op8_one_key_of_200000(bits):
    fp = np.unique(np.random.default_rng(bits).integers(0, 1 << min(bits, 63), 200_000, np.uint64))
    begin = time.perf_counter()
    S.close_links(fp, 3)
    assert time.perf_counter() - begin < 40


@pytest.mark.parametrize("distance", [2, 3, 5])
def test_op8_second_keys_spread_and_meet(spark, distance):
    """Fingerprints of one hot key meet again if they are linked, and no second
    key holds most of them."""
    rng = np.random.default_rng(distance)
    shift, width = S.widths(64, distance // 2 + 1)[0]
    own = int(rng.integers(0, 1 << width)) << shift
    fps = np.unique(np.array([own | int(x) << width for x in rng.integers(0, 1 << (64 - width - 1), 300)], np.uint64))
    near = fps ^ np.array([sum(1 << int(b) for b in rng.choice(np.arange(width, 64), distance, replace=False)) for _ in fps], np.uint64)
    rows = spark.createDataFrame([(int(v),) for v in np.concatenate([fps, near]).view(np.int64)], "fp long").selectExpr(
        "3 as wild", "7L as key", "fp")
    of, held = {}, {}
    for r in S.second_keys(rows, distance).collect():
        of.setdefault(r["fp"], set()).add(r["key"])
        held[r["key"]] = held.get(r["key"], 0) + 1
    for x, y in zip(fps.view(np.int64).tolist(), near.view(np.int64).tolist()):
        assert of[x] & of[y]
    assert max(held.values()) < 0.4 * 2 * len(fps)
