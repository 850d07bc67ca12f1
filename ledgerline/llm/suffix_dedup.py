"""Suffix-array dedup over bytes, built column by column for many documents.

Strings of ``length`` bytes that also start earlier are found from a collection
Burrows-Wheeler transform and its common prefixes, into which every document
piece inserts one symbol each round. A whole collection would need as many
rounds as its longest document has bytes, each reading all that was built; so
the collection is first dealt into parts that don't touch, with bounded rounds:

1. The minimizer of a string is its ``seed`` bytes of the smallest hash (the
   leftmost of equal ones). Equal strings have it at the same offset. A piece
   is a maximal run of strings with one minimizer: at most 2 * length - seed
   bytes. Minimizers that occur once in the whole table are dropped
   (``repeated``): their strings occur once.
2. The pieces of the rest go to buckets by minimizer, one packed block per
   chunk and bucket. Equal pieces of a chunk are sent once, as the earliest.
   A minimizer of more than ``many`` pieces sends single strings instead, dealt
   by their own hash, so no bucket grows with one key.
3. In a bucket, pieces are aligned at their minimizer. From the last column to
   the first, each piece inserts its symbol before its suffix: the symbols, in
   the order of the suffixes so far, are the transform's column; a stable sort
   by them gives the new order, and the new common prefix of two neighbours is
   one more than the least of those between them. Strings whose common prefix
   reaches ``length`` are equal; all but the earliest are repeats.
4. The bits go back to the chunks, which remove the covered bytes.

A round needs only the column before it, so a bucket holds one order and one
array of common prefixes; the files between the steps are Spark's shuffle
files, written and read in sequence, and a lost one is made again.

Memory: a small multiple of a chunk, of a bucket's pieces, or of the longest
document, which is not split. Order: a string's place is (id, start); null ids
come first; rows of equal id and start are not earlier than one another.

Defined cases: null and empty texts have no bytes; texts shorter than the
length lose none; an empty table gives an empty result.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import repeated as R
from .textarrays import U64, Rolling, cover, mix, per_row, utf8, window_starts

LENGTH = 100
SEED_BYTES = 20
#: Pieces of a minimizer beyond which its strings are dealt one by one.
MANY = 20_000
SEEDS = (71, 72)
LAST = np.iinfo(np.int64).max


def sliding_min(v: np.ndarray, size: int) -> np.ndarray:
    """Minimum of v[i:i+size] for each i, by doubling."""
    done, out = 1, v
    while done * 2 <= size:
        out = np.minimum(out[:-done], out[done:])
        done *= 2
    rest = size - done
    return np.minimum(out[:len(out) - rest], out[rest:]) if rest else out


class Pieces:
    """Pieces of a chunk: first string's start, number of strings, and the
    minimizer's position and hash, in the order of the chunk's bytes."""

    def __init__(self, table: pa.Table, length: int, seed: int, bits: int):
        self.length, self.seed = length, seed
        self.one, self.two = (Rolling(s) for s in SEEDS)
        ids = np.array([-LAST if x is None else x for x in table.column("id").to_pylist()], np.int64)
        data, off = utf8(table.column("text"))
        content = self.one.ranges(self.one.byte[data], off[:-1], off[1:])
        order = np.lexsort((content, ids))  # rows arrive in any order
        self.order, self.ids = order, ids[order]
        size = np.diff(off)[order]
        self.off = np.concatenate([[0], np.cumsum(size)])
        self.data = data[np.repeat(off[order] - self.off[:-1], size) + np.arange(self.off[-1])]
        h = self.one.windows(self.one.byte[self.data], seed)
        n = len(self.data) - length + 1
        ok = window_starts(self.off, length)
        if n <= 0 or not ok.any():
            z = np.zeros(0, np.int64)
            self.start, self.strings, self.at, self.hash = z, z, z, z.astype(np.uint64)
            return
        place = (h >> U64(32) << U64(32)) | np.arange(len(h), dtype=np.uint64)
        at = (sliding_min(place, length - seed + 1)[:n] & U64(0xFFFFFFFF)).astype(np.int64)
        good = np.flatnonzero(ok)
        at = at[good]
        new = np.ones(len(good), bool)
        new[1:] = (at[1:] != at[:-1]) | (good[1:] != good[:-1] + 1)
        begin = np.flatnonzero(new)
        self.start, self.at = good[begin], at[begin]
        self.strings = np.diff(np.append(begin, len(good)))
        self.hash = h[self.at] >> U64(64 - bits) << U64(64 - bits)

    def minimizers(self) -> R.Distinct:
        return R.Distinct(self.hash)

    def only(self, keep: np.ndarray, split: np.ndarray) -> None:
        """Keep some pieces; split those of ``split`` into single strings."""
        key, start, strings, at = self.hash[keep], self.start[keep], self.strings[keep], self.at[keep]
        cut = split[keep]
        n = np.where(cut, strings, 1)
        first = np.cumsum(n) - n
        step = np.arange(int(n.sum())) - np.repeat(first, n)
        self.start = np.repeat(start, n) + step
        self.strings = np.repeat(np.where(cut, 1, strings), n)
        self.at, self.key = np.repeat(at, n), np.repeat(key, n)
        values = self.one.byte[self.data]
        end = self.start + self.strings + self.length - 1
        a, b = self.one.ranges(values, self.start, end), self.two.ranges(self.two.byte[self.data], self.start, end)
        single = np.repeat(cut, n)
        self.key[single] = mix(a[single])
        row = np.searchsorted(self.off, self.start, "right") - 1
        self.row, self.id, self.place = row, self.ids[row], self.at - self.off[row]
        # equal pieces of the chunk: the earliest stands for them
        a = mix(a ^ self.strings.astype(np.uint64))
        self.same = R.Distinct(a, b)
        d = self.same
        group = d.spread(np.arange(len(d.first)))
        by = np.lexsort((np.arange(len(a)), self.place, self.id, group))
        self.chosen = by[np.concatenate([[True], np.diff(group[by]) != 0])] if len(a) else by
        head = np.empty(len(d.first), np.int64)
        head[group[self.chosen]] = self.chosen
        self.head = head[group] if len(a) else group

    def blocks(self, n_buckets: int):
        """(bucket, indexes of chosen pieces), in a fixed order."""
        c = self.chosen
        bucket = ((mix(self.key[c]) >> U64(32)) * U64(n_buckets)) >> U64(32)
        order = np.lexsort((self.start[c], bucket))
        c, bucket = c[order], bucket[order]
        edge = np.flatnonzero(np.diff(bucket)) + 1
        for x, y in zip([0, *edge.tolist()], [*edge.tolist(), len(c)]):
            if y > x:
                yield int(bucket[x]), c[x:y]

    def block(self, which: np.ndarray) -> bytes:
        size = self.strings[which] + self.length - 1
        end = np.cumsum(size)
        body = self.data[np.repeat(self.start[which] - (end - size), size) + np.arange(int(end[-1]))]
        head = struct.pack("<q", len(which))
        parts = (self.strings[which].astype("<u2"), (self.at - self.start)[which].astype("<u2"),
                 self.id[which].astype("<i8"), self.place[which].astype("<i8"))
        return zstandard.ZstdCompressor(level=R.SQUEEZE).compress(
            b"".join([head, *(x.tobytes() for x in parts), body.tobytes()]))


def open_block(payload: bytes):
    raw = zstandard.ZstdDecompressor().decompress(payload)
    n, = struct.unpack_from("<q", raw)
    at, out = 8, []
    for kind, size in (("<u2", 2), ("<u2", 2), ("<i8", 8), ("<i8", 8)):
        out.append(np.frombuffer(raw, kind, n, at).astype(np.int64))
        at += n * size
    return (*out, np.frombuffer(raw, np.uint8, -1, at))


def insert_column(order: np.ndarray, common: np.ndarray, symbol: np.ndarray):
    """One round. order: pieces by their suffix so far; common: common prefix of
    each with the one before; symbol: of each piece, 0 where it has none here.
    Returns the order and common prefixes of the suffixes one symbol longer."""
    column = symbol[order]  # the transform's column: what precedes the sorted suffixes
    by = np.argsort(column, kind="stable")
    sorted_ = column[by]
    between = np.minimum.reduceat(np.append(common, common.dtype.type(0)), by + 1)[:-1]
    new = np.zeros_like(common)
    new[1:] = np.where((sorted_[1:] == sorted_[:-1]) & (sorted_[1:] > 0), between + 1, 0)
    return order[by], new


def later_strings(strings, offset, ids, place, body, length: int, seed: int) -> np.ndarray:
    """For every string of every piece, in their order: whether an equal string
    of these pieces starts earlier."""
    m, reach = len(strings), length - seed
    first = reach - offset                       # column of a piece's first symbol
    size = strings + length - 1
    body_at = np.cumsum(size) - size
    columns = reach + length
    matrix = np.zeros(columns * m, np.uint16)
    # the cell of a piece's k-th byte: (its first column + k) * m + piece
    cell = np.arange(len(body), dtype=np.int64 if max(columns * m, len(body)) >= 1 << 31 else np.int32)
    cell += np.repeat((first - body_at).astype(cell.dtype), size)
    cell *= m
    cell += np.repeat(np.arange(m, dtype=cell.dtype), size)
    matrix[cell] = body
    matrix[cell] += 1
    del cell
    matrix = matrix.reshape(columns, m)
    by = np.lexsort((place, ids))
    moved = np.concatenate([[False], (np.diff(ids[by]) != 0) | (np.diff(place[by]) != 0)])
    rank = np.empty(m, np.int64)
    rank[by] = np.cumsum(moved)
    later = np.zeros((reach + 1, m), bool)
    order, common = np.arange(m), np.zeros(m, np.int16)
    for c in range(columns - 1, -1, -1):
        order, common = insert_column(order, common, matrix[c])
        if c <= reach:
            equal = common >= length
            if equal.any():
                begin = np.flatnonzero(~equal)
                r = rank[order]
                least = np.repeat(np.minimum.reduceat(r, begin), np.diff(np.append(begin, m)))
                later[c, order] = r > least
    string_at = np.cumsum(strings) - strings
    column = np.repeat(first - string_at, strings) + np.arange(int(strings.sum()))
    return later[column, np.repeat(np.arange(m), strings)]


def join_pieces(table: pa.Table, answer_kind: int, length: int, seed: int) -> pa.Table:
    chunk, bucket = table.column("chunk").to_pylist(), table.column("bucket")[0].as_py()
    parts = [open_block(p) for p in table.column("payload").to_pylist()]
    later = later_strings(*(np.concatenate(x) for x in zip(*parts)), length, seed)
    out, at = [], 0
    for c, p in zip(chunk, parts):
        mine = later[at:at + int(p[0].sum())]
        at += len(mine)
        if mine.any():
            out.append((c, answer_kind, bucket, R.bits(mine)))
    return R.batch(out)


def dedup(docs: DataFrame, *, length: int = LENGTH, seed: int = SEED_BYTES, many: int = MANY,
          id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = R.CHUNK_BYTES) -> DataFrame:
    """One row per document: n_bytes, n_removed, n_spans, kept (binary) and
    spans (removed runs of bytes, [start, end))."""
    rows, total, copied = R.chunked(docs, id_col, text_col, chunk_bytes)
    rows = rows.withColumn("id", F.col("id").cast("long"))
    bits = min(64, max(32, total.bit_length() + 12))
    n_hash, n_piece = max(1, total // 16_000_000), max(1, total // 2_000_000)

    def minimizers(chunk, table):
        return Pieces(table, length, seed, bits).minimizers().messages(chunk, 0, n_hash)

    def pieces(table, got) -> Pieces:
        p = Pieces(table, length, seed, bits)
        d = p.minimizers()
        found, hot = (d.spread(d.read(R.answers_of(got, k), n_hash)) for k in (1, 2))
        p.only(found, hot)
        return p

    def send_pieces(chunk, table, got):
        p = pieces(table, got)
        return [(chunk, 3, b, p.block(which)) for b, which in p.blocks(n_piece)]

    def join(table):
        return join_pieces(table, 4, length, seed)

    shared = R.answered(R.sent(rows, minimizers), 1, many)
    repeats = R.sent_after(rows, shared, send_pieces).groupBy("bucket").applyInArrow(join, R.MESSAGE)
    schema = T.StructType([T.StructField(id_col, T.LongType())] + T.DataType.fromDDL(
        "n_bytes bigint, n_removed bigint, n_spans bigint, kept binary, spans array<struct<start:bigint,end:bigint>>, n bigint").fields)

    def remove(table, got):
        if len(got):
            p = pieces(table, got)
            answers = R.answers_of(got, 4)
            n = p.strings
            first = np.cumsum(n) - n
            later = np.zeros(int(n.sum()), bool)  # of each string, piece after piece
            for b, which in p.blocks(n_piece):
                if b in answers:
                    size = n[which]
                    to = np.repeat(first[which] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
                    later[to] = R.from_bits(answers[b], len(to))
            # the other equal pieces: as their chosen one, and later than it where they are
            head = p.head
            step = np.arange(len(later)) - np.repeat(first, n)
            later = later[np.repeat(first[head], n) + step]
            after = (p.id != p.id[head]) | (p.place != p.place[head])
            later |= np.repeat(after, n)
            starts = (np.repeat(p.start, n) + step)[later]
        else:
            p = Pieces(table, length, seed, bits)
            starts = np.zeros(0, np.int64)
        off = p.off
        gone = cover(starts, length, len(p.data))
        left = np.concatenate([[0], np.cumsum(~gone)])
        raw, of = p.data[~gone].tobytes(), left[off].tolist()
        edge = np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8))
        cuts = off[1:-1]
        cuts = np.unique(cuts[(cuts > 0) & (cuts < len(gone))])
        cuts = cuts[gone[cuts] & gone[cuts - 1]]
        begin = np.sort(np.concatenate([np.flatnonzero(edge == 1), cuts]))
        stop = np.sort(np.concatenate([np.flatnonzero(edge == -1), cuts]))
        row = np.searchsorted(off, begin, "right") - 1
        at = np.searchsorted(row, np.arange(len(off)))
        spans = pa.StructArray.from_arrays([pa.array(begin - off[row]), pa.array(stop - off[row])], ["start", "end"])
        return pa.table([
            table.column("id").take(pa.array(p.order)), pa.array(np.diff(off)), pa.array(per_row(gone, off)),
            pa.array(np.diff(at)), pa.array([raw[a:b] for a, b in zip(of[:-1], of[1:])], pa.binary()),
            pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), spans), table.column("n").take(pa.array(p.order))],
            [id_col, "n_bytes", "n_removed", "n_spans", "kept", "spans", "n"])

    return R.expanded(rows.groupBy("chunk").cogroup(shared.unionAll(repeats).groupBy("chunk")).applyInArrow(remove, schema), copied)


def report(docs: DataFrame, **options) -> DataFrame:
    return dedup(docs, **options).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
