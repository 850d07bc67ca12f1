"""Substring dedup over words with fixed-block anchors.

Every document is cut into non-overlapping blocks of ``block`` words, the
index. Any run of ``window`` >= 2 * block - 1 words holds a whole block, so a
repeated run shows as a block that also occurs at another rolling position.

1. Every rolling window of block words probes the block index. The blocks that
   are found elsewhere too are the anchors.
2. Hits are extended: all windows of ``window`` words around an anchor are
   compared by 96 hash bits. Those that start at least twice are repeats, and
   overlapping ones form the maximal exact repeats.
3. Words in a repeated window go, in all its places.

Both comparisons use ``repeated``: hashes meet in buckets as packed payloads,
answers are bits. Only step 1 sees all windows, with hashes of just enough
bits; it is a filter whose false hits step 2 drops.

Memory: a small multiple of a chunk or of the longest document, which is not
split. Shuffled: the documents once (the exchange is reused), about 4 bytes a
word for step 1 and 10 a window around anchors.

Defined cases: null and empty texts have no words; documents of fewer than
``window`` words lose none; every copy of a repeat loses it, also within a
document and between equal rows; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import repeated as R
from .textarrays import U64, Rolling, cover, per_row, utf8, window_starts, words

WINDOW = 35
SEEDS = (11, 12, 13)


class Texts:
    """Words of a chunk, and hashes of its windows."""

    def __init__(self, table: pa.Table, window: int, block: int, bits: int):
        self.window, self.block, self.drop = window, block, U64(64 - bits)
        self.data, self.off = utf8(table.column("text"))
        self.w = words(self.data, self.off)
        self.word, self.one, self.two = (Rolling(s) for s in SEEDS)
        self.values = self.word.of_words(self.data, self.w)
        n = R.repeats_of(table)
        self.times = np.repeat(n, self.w.count) if (n > 1).any() else None

    def times_at(self, at: np.ndarray) -> np.ndarray | None:
        """How many equal rows the rows of some words stand for."""
        return None if self.times is None else self.times[at]

    def probes(self) -> tuple[np.ndarray, np.ndarray]:
        """(positions, hashes) of rolling block-sized windows. The low bits are
        cleared, so the payloads' differences are short."""
        at = np.flatnonzero(window_starts(self.w.row, self.block))
        h = self.one.windows(self.values, self.block)[at]
        return at, (h >> self.drop) << self.drop

    def is_block(self, at: np.ndarray) -> np.ndarray:
        first = np.repeat(self.w.row[:-1], self.w.count)
        return (at - first[at]) % self.block == 0

    def around(self, anchors: np.ndarray) -> np.ndarray:
        """Starts of the windows that hold an anchor block."""
        ok = window_starts(self.w.row, self.window)
        n = len(self.values)
        first = np.repeat(self.w.row[:-1], self.w.count)
        reach = self.window - self.block
        mark = np.zeros(n + 1, np.int32)
        np.add.at(mark, np.maximum(anchors - reach, first[anchors]), 1)
        np.add.at(mark, anchors + 1, -1)
        return np.flatnonzero(ok & (np.cumsum(mark)[:len(ok)] > 0))

    def long_windows(self, at: np.ndarray) -> R.Distinct:
        one = self.one.windows(self.values, self.window)[at]
        two = (self.two.windows(self.values, self.window)[at] >> U64(32)).astype(np.uint32)
        return R.Distinct(one, two, self.times_at(at))


def index_and_probe(t: Texts, chunk: int, n_buckets: int) -> list[tuple]:
    at, h = t.probes()
    d = R.Distinct(h, times=t.times_at(at))
    blocks = np.unique(h[t.is_block(at)])
    flag = np.zeros(len(d.first), bool)
    flag[np.searchsorted(d.first, blocks)] = True
    return d.messages(chunk, 0, n_buckets, flag)


def anchor_windows(t: Texts, answers: pa.Table, n_buckets: int) -> tuple[np.ndarray, R.Distinct]:
    at, h = t.probes()
    d = R.Distinct(h)
    hot = d.spread(d.read(R.answers_of(answers, 1), n_buckets))
    starts = t.around(at[hot & t.is_block(at)])
    return starts, t.long_windows(starts)


def dedup(docs: DataFrame, *, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text",
          chunk_bytes: int = R.CHUNK_BYTES) -> DataFrame:
    """One row per document: n_words, n_removed, kept (the remaining words,
    joined by one space) and spans (removed runs of words, [start, end))."""
    block = (window + 1) // 2
    rows, total, copied = R.chunked(docs, id_col, text_col, chunk_bytes)
    bits = min(64, max(32, total.bit_length() + 12))  # of a probe: few false hits among total / 5 words
    n_probe = max(1, total // 5 // R.BUCKET_HASHES)

    def texts(table):
        return Texts(table, window, block, bits)

    probes = R.sent(rows, lambda chunk, table: index_and_probe(texts(table), chunk, n_probe))
    anchors = R.answered(probes, 1)
    windows = R.sent_after(rows, anchors, lambda chunk, table, got:
                           anchor_windows(texts(table), got, n_probe)[1].messages(chunk, 2, n_probe))
    repeats = R.answered(windows, 3)

    schema = T.StructType([T.StructField(id_col, rows.schema["id"].dataType)])
    schema = T.StructType(schema.fields + T.DataType.fromDDL(
        "n_words bigint, n_removed bigint, kept string, spans array<struct<start:bigint,end:bigint>>, n bigint").fields)

    def remove(table, got):
        t = texts(table)
        w, n = t.w, len(t.values)
        gone = np.zeros(n, bool)
        if len(got) and n:
            starts, d = anchor_windows(t, got, n_probe)
            gone = cover(starts[d.spread(d.read(R.answers_of(got, 3), n_probe))], window, n)
        kept = np.flatnonzero(~gone)
        size = w.end[kept] - w.start[kept] + 1
        end = np.concatenate([[0], np.cumsum(size)])
        out = np.append(t.data, np.uint8(32))[np.repeat(w.start[kept] - end[:-1], size) + np.arange(end[-1])]
        out[end[1:] - 1] = 32
        raw, of = out.tobytes(), end[np.searchsorted(kept, w.row)].tolist()
        edge = np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8))
        cuts = w.row[1:-1]
        cuts = np.unique(cuts[(cuts > 0) & (cuts < n)])
        cuts = cuts[gone[cuts] & gone[cuts - 1]]
        begin = np.sort(np.concatenate([np.flatnonzero(edge == 1), cuts]))
        stop = np.sort(np.concatenate([np.flatnonzero(edge == -1), cuts]))
        row = np.searchsorted(w.row, begin, "right") - 1
        spans = pa.StructArray.from_arrays([pa.array(begin - w.row[row]), pa.array(stop - w.row[row])], ["start", "end"])
        at = np.searchsorted(row, np.arange(len(table) + 1)).astype(np.int32)
        return pa.table([
            table.column("id"), pa.array(w.count), pa.array(per_row(gone, w.row)),
            pa.array([raw[a:max(a, b - 1)] for a, b in zip(of[:-1], of[1:])], pa.binary()).cast(pa.string()),
            pa.ListArray.from_arrays(pa.array(at), spans), table.column("n")],
            [id_col, "n_words", "n_removed", "kept", "spans", "n"])

    return R.expanded(rows.groupBy("chunk").cogroup(anchors.unionAll(repeats).groupBy("chunk")).applyInArrow(remove, schema), copied)


def report(docs: DataFrame, **options) -> DataFrame:
    return dedup(docs, **options).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
