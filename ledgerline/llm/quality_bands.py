"""Quality rules with compression bands.

A document's zstandard ratio (bytes over compressed bytes) is compared with
limits for its length: above the upper limit it is repetitive, below the lower
one incompressible. The same limits apply to fixed chunks, so that a bad part
of a long document shows although the whole looks normal. Ratios rise with
length, because a frame's header weighs less and matches are easier to find;
hence the limits per length.

Row-wise: no shuffle; memory is a small multiple of the larger of a slice and
the longest document.

Defined cases: null and empty texts have no words, ratio 0 and fail the base
rules; equal rows are judged separately; documents shorter than the first
band's length have no compression limits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from .rowwise import map_texts
from .textarrays import NOT_BLANK, U64, Rolling, byte_class, cover, mix, per_row, utf8, window_starts, words

LEVEL = 3
#: (from this many bytes, lowest ratio, highest ratio). Ordinary prose of such
#: a length lies well inside; base64 text has about 1.3, one repeated word 10.
BANDS = ((0, 0.0, float("inf")), (100, 0.7, 2.6), (400, 1.2, 3.2), (1600, 1.36, 3.8), (6400, 1.4, 4.5), (25600, 1.45, 5.5))
CHUNK = 4096
#: Highest share of chunks outside their limits, and the most of them in a row:
#: a block of junk of that size rejects a document of any length.
BAD_CHUNKS = 0.25
BAD_RUN = 2
MIN_WORDS = 20
REPEAT_WINDOW = 8
REPEAT_PERCENT = 30
SYMBOLS = byte_class(included=b"#*$%&|<>")
SEED = 2


def chunk_edges(n: int, chunk: int = CHUNK) -> list[tuple[int, int]]:
    """Fixed chunks of n bytes; a last one of under a quarter joins the one before."""
    edges = list(range(0, n, chunk)) or [0]
    if len(edges) > 1 and n - edges[-1] < chunk // 4:
        edges.pop()
    return list(zip(edges, [*edges[1:], n]))


def limits(n: int, bands=BANDS) -> tuple[float, float]:
    low, high = 0.0, float("inf")
    for least, lo, hi in bands:
        if n >= least:
            low, high = lo, hi
    return low, high


def repeated_words(values: np.ndarray, row: np.ndarray, rolling: Rolling, size: int = REPEAT_WINDOW) -> np.ndarray:
    """Whether each word lies in a window of ``size`` words that its row has at
    least twice. values: word hashes; row: offsets of rows."""
    ok = np.flatnonzero(window_starts(row, size))
    if not len(ok):
        return np.zeros(len(values), bool)
    of = np.repeat(np.arange(len(row) - 1, dtype=np.uint64), np.diff(row))[ok]
    key = mix(rolling.windows(values, size)[ok] + of * U64(0x9E3779B97F4A7C15))
    ordered = np.sort(key)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(twice, key), len(twice) - 1)
    return cover(ok[twice[at] == key], size, len(values))


def judge(docs: DataFrame, *, bands=BANDS, chunk: int = CHUNK, bad_chunks: float = BAD_CHUNKS, bad_run: int = BAD_RUN,
          level: int = LEVEL,           min_words: int = MIN_WORDS, repeat_percent: int = REPEAT_PERCENT,
          id_col: str = "doc_id", text_col: str = "text", carry: str | None = None) -> DataFrame:
    """One row per document: the base counts, base_failed, kept, ratio,
    n_chunks and n_bad_chunks."""

    def make():
        rolling = Rolling(SEED)
        squeeze = zstandard.ZstdCompressor(level=level).compress

        def fn(column):
            data, off = utf8(column)
            w = words(data, off)
            n_words = w.count
            points = (data & 0xC0) != 0x80
            word_chars = per_row(points & NOT_BLANK[data], off)
            symbols = per_row(SYMBOLS[data], off)
            repeat = per_row(repeated_words(rolling.of_words(data, w), w.row, rolling), w.row)
            raw = data.tobytes()
            dup, ratio, n_chunks, n_bad, in_band = [], [], [], [], []
            for a, b in zip(off[:-1].tolist(), off[1:].tolist()):
                text = raw[a:b]
                lines = [x for x in text.split(b"\n") if x.strip(b" \t\n\v\f\r")]
                dup.append(len(lines) - len(set(lines)))
                r = (b - a) / len(squeeze(text)) if text else 0.0
                lo, hi = limits(b - a, bands)
                good = lo <= r <= hi
                edges = chunk_edges(b - a, chunk)
                bad = run = longest = 0
                if len(edges) > 1:
                    for x, y in edges:
                        lo, hi = limits(y - x, bands)
                        run = 0 if lo <= (y - x) / len(squeeze(text[x:y])) <= hi else run + 1
                        bad, longest = bad + (run > 0), max(longest, run)
                else:
                    bad = int(not good)
                ratio.append(r)
                n_chunks.append(len(edges))
                n_bad.append(bad)
                in_band.append(good and bad <= bad_chunks * len(edges) and longest <= bad_run)
            failed = (n_words < min_words) | (100 * repeat > repeat_percent * n_words)
            return [pa.array(n_words), pa.array(word_chars), pa.array(symbols), pa.array(dup, pa.int64()),
                    pa.array(repeat), pa.array(failed), pa.array(~failed & np.array(in_band, bool)),
                    pa.array(ratio, pa.float64()), pa.array(n_chunks, pa.int64()), pa.array(n_bad, pa.int64())]

        return fn

    return map_texts(docs, make, [
        ("n_words", "bigint"), ("word_chars", "bigint"), ("n_symbols", "bigint"), ("n_dup_lines", "bigint"),
        ("n_repeat_words", "bigint"), ("base_failed", "boolean"), ("kept", "boolean"), ("ratio", "double"),
        ("n_chunks", "bigint"), ("n_bad_chunks", "bigint")], id_col=id_col, text_col=text_col, carry=carry)
