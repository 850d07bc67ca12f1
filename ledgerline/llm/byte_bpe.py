"""Byte-level BPE encoding and decoding with padded numpy matrices.

A text is cut by the tokenizer's pattern. The distinct pieces of a slice are
put into matrices of token ids, one row a piece, bucketed by length and padded.
Each round finds, in every row, the leftmost pair of the lowest rank by a
hashed pair lookup, merges it, closes the gap, and drops the rows that have no
pair left (compaction). Ids of pieces are kept for the rest of the task in a
store of bounded size.

Row-wise: no shuffle. A piece over ``LONG`` bytes would make its row's rounds
quadratic; it is merged with a heap instead, in the same order.

Defined cases: null and empty texts have no ids and decode to nothing; equal
rows are encoded separately. A byte that the ranks lack raises ValueError.
"""

from __future__ import annotations

import base64
import hashlib
import heapq

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .rowwise import map_texts
from .textarrays import U64, mix

#: Longest piece, in bytes, that goes into a matrix.
LONG = 1024
#: Pieces kept in a task's store before it starts anew.
STORE = 100_000
NONE = np.int32(2**31 - 1)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}


def gather(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Indexes start[i] .. start[i] + size[i] - 1 of all i, one after the other."""
    total = int(size.sum())
    first = np.cumsum(size) - size
    return np.repeat(start - first, size) + np.arange(total)


class PairTable:
    """Open-addressing table (left id, right id) -> id of the joined token."""

    def __init__(self, left: np.ndarray, right: np.ndarray, joined: np.ndarray):
        bits = max(4, int(np.ceil(np.log2(max(1, len(left)) * 4))))
        self.mask = U64((1 << bits) - 1)
        self.key = np.full(1 << bits, U64(2**64 - 1))
        self.value = np.full(1 << bits, NONE, np.int32)
        key = self.keys(left, right)
        slot, wait, self.probes = mix(key) & self.mask, np.arange(len(key)), 0
        while len(wait):  # each round, one pair of those that want a free slot gets it
            self.probes += 1
            at = slot[wait]
            free = wait[self.key[at] == U64(2**64 - 1)]
            _, first = np.unique(slot[free], return_index=True)
            put = free[first]
            self.key[slot[put]], self.value[slot[put]] = key[put], joined[put]
            wait = np.setdiff1d(wait, put, assume_unique=True)
            slot[wait] = (slot[wait] + U64(1)) & self.mask

    @staticmethod
    def keys(left, right):
        return (left.astype(np.uint64) << U64(32)) | right.astype(np.uint64)

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = self.keys(left, right)
        slot = mix(key) & self.mask
        out = np.full(key.shape, NONE, np.int32)
        at = self.key[slot]
        hit = at == key
        out[hit] = self.value[slot[hit]]
        rest = np.flatnonzero(~hit & (at != U64(2**64 - 1)))
        while len(rest):
            slot[rest] = (slot[rest] + U64(1)) & self.mask
            at = self.key[slot[rest]]
            hit = at == key[rest]
            out[rest[hit]] = self.value[slot[rest[hit]]]
            rest = rest[~hit & (at != U64(2**64 - 1))]
        return out


class Codec:
    def __init__(self, path: str, pattern: str):
        self.ranks = read_ranks(path)
        self.split = regex.compile(pattern).findall
        by_id = sorted((i, t) for t, i in self.ranks.items())
        top = by_id[-1][0] + 1
        size = np.zeros(top, np.int64)
        for i, t in by_id:
            size[i] = len(t)
        self.token_size, self.token_start = size, np.cumsum(size) - size
        self.token_bytes = np.frombuffer(b"".join(t for _, t in by_id), np.uint8)
        self.byte_id = np.array([self.ranks.get(bytes([b]), -1) for b in range(256)], np.int32)
        if (self.byte_id < 0).any():
            raise ValueError("the ranks lack a byte")
        get = self.ranks.get
        pairs = [(a, b, i) for i, t in by_id for k in range(1, len(t))
                 if (a := get(t[:k])) is not None and (b := get(t[k:])) is not None]
        self.pairs = PairTable(*(np.array(x, np.int32) for x in zip(*pairs))) if pairs else PairTable(*[np.zeros(0, np.int32)] * 3)
        self._forget()

    def _forget(self) -> None:
        self.code: dict[str, int] = {}
        self.ids, self.start, self.size = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def merge_rows(self, ids: np.ndarray, size: np.ndarray) -> None:
        """Merge the rows of a padded matrix, in place; ids beyond size are
        undefined afterwards."""
        rows = np.arange(len(ids))
        work, n = ids.copy(), size.copy()
        rank = np.full(work.shape, NONE, np.int32)
        columns = np.arange(work.shape[1])
        if work.shape[1] > 1:
            rank[:, :-1] = self.pairs.get(work[:, :-1].ravel(), work[:, 1:].ravel()).reshape(len(work), -1)
            rank[columns[None, :] >= n[:, None] - 1] = NONE
        while len(work):
            at = rank.argmin(1)  # the leftmost of the lowest
            each = np.arange(len(work))
            least = rank[each, at]
            live = least != NONE
            if not live.all():
                done = ~live
                ids[rows[done], :work.shape[1]], size[rows[done]] = work[done], n[done]
                rows, work, rank, n, at, least = rows[live], work[live], rank[live], n[live], at[live], least[live]
                if not len(work):
                    break
                each = np.arange(len(work))
            width = int(n.max())
            work, rank = work[:, :width], rank[:, :width]
            work[each, at] = least  # a token's id is its rank
            source = np.minimum(columns[None, :width] + (columns[None, :width] > at[:, None]), width - 1)
            work = np.take_along_axis(work, source, 1)
            rank = np.take_along_axis(rank, source, 1)
            n = n - 1
            rank[each, n - 1] = NONE
            for left in (at - 1, at):
                ok = (left >= 0) & (left < n - 1)
                e, x = each[ok], left[ok]
                rank[e, x] = self.pairs.get(work[e, x], work[e, x + 1])

    def merge_long(self, piece: bytes) -> np.ndarray:
        """The same merges of one piece, with a heap."""
        ids = self.byte_id[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        token = [piece[i:i + 1] for i in range(n)]
        get = self.ranks.get
        heap = [(r, i, i + 1, 1, 1) for i in range(n - 1) if (r := get(piece[i:i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, j, a, b = heapq.heappop(heap)
            if ids[i] < 0 or after[i] != j or len(token[i]) != a or len(token[j]) != b:
                continue
            token[i] += token[j]
            ids[i], ids[j] = r, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (r := get(token[x] + token[y])) is not None:
                    heapq.heappush(heap, (r, x, y, len(token[x]), len(token[y])))
        return np.array([x for x in ids if x >= 0], np.int32)

    def encode_pieces(self, pieces: list[bytes]) -> list[np.ndarray]:
        out: list = [None] * len(pieces)
        buckets: dict[int, list[int]] = {}
        for k, p in enumerate(pieces):
            whole = self.ranks.get(p)
            if whole is not None:
                out[k] = np.array([whole], np.int32)
            elif len(p) > LONG:
                out[k] = self.merge_long(p)
            else:
                buckets.setdefault((len(p) - 1).bit_length() if len(p) > 16 else len(p) + 100, []).append(k)
        for which in buckets.values():
            for a in range(0, len(which), 1 << 14):
                part = which[a:a + (1 << 14)]
                size = np.array([len(pieces[k]) for k in part])
                off = np.cumsum(size) - size
                data = self.byte_id[np.frombuffer(b"".join(pieces[k] for k in part), np.uint8)]
                ids = np.zeros((len(part), int(size.max())), np.int32)
                inside = np.arange(ids.shape[1])[None, :] < size[:, None]
                ids[inside] = data[gather(off, size)]
                self.merge_rows(ids, size)
                for k, row, n in zip(part, ids, size.tolist()):
                    out[k] = row[:n].copy()
        return out

    def encode(self, column) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets per text)."""
        split = self.split
        cut = [split(t) if t else [] for t in column.to_pylist()]
        if len(self.code) > STORE:
            self._forget()
        code = self.code
        new = list({p for pieces in cut for p in pieces if p not in code})
        if new:
            ids = self.encode_pieces([p.encode() for p in new])
            size = np.array([len(x) for x in ids], np.int64)
            start = len(self.ids) + np.cumsum(size) - size
            code.update(zip(new, range(len(code), len(code) + len(new))))
            self.ids, self.start, self.size = (np.concatenate(x) for x in (
                [self.ids, *ids], [self.start, start], [self.size, size]))
        n = np.array([len(x) for x in cut], np.int64)
        which = np.fromiter((code[p] for pieces in cut for p in pieces), np.int64, int(n.sum()))
        size = self.size[which]
        end = np.concatenate([[0], np.cumsum(size)])
        return self.ids[gather(self.start[which], size)], end[np.concatenate([[0], np.cumsum(n)])]

    def decode(self, ids: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of all texts, offsets per text)."""
        size = self.token_size[ids]
        end = np.concatenate([[0], np.cumsum(size)])
        return self.token_bytes[gather(self.token_start[ids], size)], end[off]


def encode(docs: DataFrame, path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text",
           carry: str | None = None) -> DataFrame:
    """(id, ids array<int>) per document."""
    def make():
        codec = Codec(path, pattern)

        def fn(column):
            ids, off = codec.encode(column)
            return [pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(ids))]
        return fn
    return map_texts(docs, make, [("ids", "array<int>")], id_col=id_col, text_col=text_col, carry=carry, most=1 << 20)


def decode(encoded: DataFrame, path: str, pattern: str, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, bytes binary) per row of token ids; null: no ids."""
    src = encoded.select(id_col, encoded[ids_col].cast("array<int>").alias("ids"))
    schema = f"{id_col} {src.schema[id_col].dataType.simpleString()}, bytes binary"

    def run(batches):
        codec = Codec(path, pattern)
        for b in batches:
            ids = [np.array(x or [], np.int64) for x in b.column("ids").to_pylist()]
            out = [codec.token_bytes[gather(codec.token_start[x], codec.token_size[x])].tobytes() for x in ids]
            yield pa.RecordBatch.from_arrays([b.column(id_col), pa.array(out, pa.binary())], [id_col, "bytes"])
    return src.mapInArrow(run, schema)


def round_trip(docs: DataFrame, path: str, pattern: str, *, with_ids: bool = False,
               id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: n_tokens, ids_sha256 of its ids (little-endian, 32 bits),
    decoded_sha256 of the bytes that the ids decode to, and perhaps the ids."""
    def make():
        codec = Codec(path, pattern)

        def digest(values: np.ndarray, off: np.ndarray, width: int):
            raw = memoryview(values.tobytes())
            return pa.array([hashlib.sha256(raw[a * width:b * width]).hexdigest()
                             for a, b in zip(off[:-1].tolist(), off[1:].tolist())], pa.string())

        def fn(column):
            ids, off = codec.encode(column)
            out = [pa.array(np.diff(off)), digest(ids.astype("<u4"), off, 4), digest(*codec.decode(ids, off), 1)]
            return out + [pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(ids))] * with_ids
        return fn
    return map_texts(docs, make, [("n_tokens", "bigint"), ("ids_sha256", "string"), ("decoded_sha256", "string")]
                     + [("ids", "array<int>")] * with_ids, id_col=id_col, text_col=text_col, most=1 << 20)
