"""Which hashes occur more than once in a whole table, without shuffling rows
of single hashes.

Documents are dealt into chunks of bounded size by a hash of their content.
Each chunk sorts its distinct hashes, cuts them into buckets by value and sends
every bucket one packed payload: differences of sorted hashes (a few bytes
each), counts, flags. A bucket merges its payloads and answers each chunk with
one bit per hash, in the payload's order; the chunk, which computes its hashes
anew, reads the bits back. What goes over the network is thus a fraction of the
hashes, and an answer is a bit.

Skew: a hash reaches its bucket at most once per chunk, with a count, however
often it occurs, so one key of a third of all rows costs no more than others.
Rows that are equal in id and text and make up a good part of a chunk are
counted before the dealing: a row stands for up to ``COPIES`` of them.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rowwise import quoted
from .textarrays import U64

CHUNK_BYTES = 2 << 20
#: Equal rows that one row of a chunk stands for, at most.
COPIES = 1000
#: Hashes of a bucket, about.
BUCKET_HASHES = 1_000_000
MESSAGE = "chunk bigint, kind int, bucket bigint, payload binary"
MESSAGE_COLUMNS = ["chunk", "kind", "bucket", "payload"]


def chunked(docs: DataFrame, id_col: str, text_col: str, chunk_bytes: int = CHUNK_BYTES) -> tuple[DataFrame, int, bool]:
    """((chunk, id, text, n), total bytes of text, whether some n is over 1): a
    row stands for n equal ones. Equal rows of no more than half a chunk of text
    share one, so the dealing doesn't depend on the order in which rows arrive;
    of more, they are counted, combined by the map tasks, and the counts are
    dealt in parts."""
    src = docs.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).cast("string").alias("text"))
    key = F.xxhash64("id", "text")
    rows = F.count("*").alias("rows")
    # a null or empty text has a row's bytes still
    keys = src.groupBy(key.alias("key")).agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + F.lit(16)).alias("size"), rows)
    heavy = (F.col("rows") > 1) & (F.col("size") > chunk_bytes // 2)
    found = keys.agg(F.sum(F.col("size") - 16 * F.col("rows")).alias("total"), F.count_if(heavy).alias("heavy")).first()
    total = found["total"] or 0
    chunks = max(1, -(-total // chunk_bytes))

    def dealt(rows, *by):
        return rows.select(F.pmod(F.xxhash64("id", "text", *by), F.lit(chunks)).alias("chunk"), "id", "text", "n")

    if not found["heavy"]:
        return dealt(src.withColumn("n", F.lit(1).cast("long"))), total, False
    few = F.broadcast(keys.where(heavy).select("key"))  # about two a chunk at most
    src = src.withColumn("key", key)
    light = src.join(few, "key", "left_anti").withColumn("n", F.lit(1).cast("long"))
    counted = src.join(few, "key", "left_semi").groupBy("id", "text").agg(rows)
    parts = counted.select("id", "text", "rows", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1, F.lit(COPIES).cast("long"))).alias("part"))
    parts = parts.withColumn("n", F.least(F.lit(COPIES).cast("long"), F.col("rows") - F.col("part")))
    return dealt(light).unionAll(dealt(parts, "part")), total, True


def repeats_of(table: pa.Table) -> np.ndarray:
    """How many equal rows each row of a chunk stands for."""
    return table.column("n").to_numpy()


def expanded(rows: DataFrame, copied: bool) -> DataFrame:
    """Each row as often as its column n says, without that column."""
    if copied:
        rows = rows.withColumn("n", F.explode(F.sequence(F.lit(1).cast("long"), "n")))
    return rows.drop("n")


def planes(v: np.ndarray) -> bytes:
    """Bytes of u64 values by significance, without the leading zero planes."""
    most = int(v.max()) if len(v) else 0
    n = (most.bit_length() + 7) // 8
    return bytes([n]) + v.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :n].T.tobytes()


def from_planes(raw: memoryview, n: int) -> tuple[np.ndarray, int]:
    k = raw[0]
    out = np.zeros((n, 8), np.uint8)
    out[:, :k] = np.frombuffer(raw, np.uint8, n * k, 1).reshape(k, n).T
    return out.view("<u8").ravel().astype(np.uint64), 1 + n * k


SQUEEZE = 1


def pack(h: np.ndarray, count: np.ndarray, second: np.ndarray | None = None, flag: np.ndarray | None = None) -> bytes:
    """Sorted hashes with counts, and perhaps 32 more bits and a flag each."""
    parts = [struct.pack("<q??", len(h), second is not None, flag is not None),
             planes(np.diff(h, prepend=U64(0))), np.minimum(count, 65535).astype("<u2").tobytes()]
    if second is not None:
        parts.append(second.astype("<u4").tobytes())
    if flag is not None:
        parts.append(np.packbits(flag).tobytes())
    return zstandard.ZstdCompressor(level=SQUEEZE).compress(b"".join(parts))


def unpack(payload: bytes):
    raw = memoryview(zstandard.ZstdDecompressor().decompress(payload))
    n, has_second, has_flag = struct.unpack_from("<q??", raw)
    at = struct.calcsize("<q??")
    d, used = from_planes(raw[at:], n)
    at += used
    count = np.frombuffer(raw, "<u2", n, at)
    at += 2 * n
    second = np.frombuffer(raw, "<u4", n, at) if has_second else None
    at += 4 * n * has_second
    flag = np.unpackbits(np.frombuffer(raw, np.uint8, -1, at), count=n).astype(bool) if has_flag else None
    return np.cumsum(d, dtype=np.uint64), count, second, flag


def bits(flag: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=SQUEEZE).compress(np.packbits(flag).tobytes())


def from_bits(raw: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8), count=n).astype(bool)


def order_of(first: np.ndarray, second: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(order that sorts the pairs, True where a new pair begins)."""
    order = np.argsort(first)
    a = first[order]
    new = np.ones(len(a), bool)
    new[1:] = a[1:] != a[:-1]
    if second is not None and not new.all():
        b = second[order]
        differ = np.zeros(len(a), bool)
        differ[1:] = b[1:] != b[:-1]
        if (differ & ~new).any():  # equal first parts only: sort by both
            order = np.lexsort((second, first))
            a, b = first[order], second[order]
            differ[1:] = b[1:] != b[:-1]
            new[1:] = a[1:] != a[:-1]
        new |= differ
    return order, new


class Distinct:
    """Distinct pairs (first, second) of a chunk, sorted, with counts; ``times``
    says how often each one given occurs, else once."""

    def __init__(self, first: np.ndarray, second: np.ndarray | None = None, times: np.ndarray | None = None):
        self.order, new = order_of(first, second)
        self.begin = np.flatnonzero(new)
        self.count = np.diff(np.append(self.begin, len(first)))
        self.total = self.count if times is None or not len(first) else np.add.reduceat(times[self.order], self.begin)
        at = self.order[self.begin]
        self.first, self.second = first[at], None if second is None else second[at]

    def spread(self, flag: np.ndarray) -> np.ndarray:
        """A flag of each distinct pair, given back to every occurrence."""
        out = np.empty(len(self.order), flag.dtype)
        out[self.order] = np.repeat(flag, self.count)
        return out

    def buckets(self, n: int):
        """(bucket, slice of the distinct pairs) for each bucket that has some."""
        if len(self.first):
            b = ((self.first >> U64(32)) * U64(n)) >> U64(32)
            edge = np.flatnonzero(np.diff(b)) + 1
            for x, y in zip([0, *edge.tolist()], [*edge.tolist(), len(b)]):
                yield int(b[x]), slice(x, y)

    def messages(self, chunk: int, kind: int, n_buckets: int, flag: np.ndarray | None = None) -> list[tuple]:
        return [(chunk, kind, b, pack(self.first[s], self.total[s], None if self.second is None else self.second[s],
                                      None if flag is None else flag[s])) for b, s in self.buckets(n_buckets)]

    def read(self, answers: dict[int, bytes], n_buckets: int) -> np.ndarray:
        """Bits of a bucket's answers, for all distinct pairs."""
        out = np.zeros(len(self.first), bool)
        for b, s in self.buckets(n_buckets):
            if b in answers:
                out[s] = from_bits(answers[b], s.stop - s.start)
        return out


def batch(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows)) or [(), (), (), ()]
    return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.binary()))],
                    MESSAGE_COLUMNS)


def answers_of(table: pa.Table, kind: int) -> dict[int, bytes]:
    return {b: p for k, b, p in zip(*(table.column(c).to_pylist() for c in MESSAGE_COLUMNS[1:])) if k == kind}


def join_bucket(table: pa.Table, answer_kind: int, many: int | None = None) -> pa.Table:
    """A bucket's answers: for each payload's hash, whether it occurs at least
    twice in all and, where there are flags, is flagged itself or by another;
    only flagged hashes get a set bit. With ``many``, a second answer (of the
    next kind) tells the hashes with at least that many occurrences."""
    chunk = table.column("chunk").to_pylist()
    bucket = table.column("bucket")[0].as_py()
    parts = [unpack(p) for p in table.column("payload").to_pylist()]
    first, count, second, flag = (None if x[0] is None else np.concatenate(x) for x in zip(*parts))
    order, new = order_of(first, second)
    begin = np.flatnonzero(new)
    size = np.diff(np.append(begin, len(order)))
    total = np.add.reduceat(count[order].astype(np.int64), begin)
    found = total >= 2
    if flag is not None:
        found &= np.logical_or.reduceat(flag[order], begin)
    out = []
    for kind, groups in ((answer_kind, found), *([(answer_kind + 1, total >= many)] if many else [])):
        if not groups.any():
            continue
        each = np.empty(len(order), bool)
        each[order] = np.repeat(groups, size)
        if flag is not None:
            each &= flag
        at = 0
        for c, part in zip(chunk, parts):
            mine = each[at:at + len(part[0])]
            at += len(mine)
            if mine.any():
                out.append((c, kind, bucket, bits(mine)))
    return batch(out)


def answered(messages: DataFrame, answer_kind: int, many: int | None = None) -> DataFrame:
    def merge(table):
        return join_bucket(table, answer_kind, many)
    return messages.groupBy("bucket").applyInArrow(merge, MESSAGE)


def sent(docs: DataFrame, make_messages) -> DataFrame:
    """Messages of every chunk: make_messages(chunk, table) -> rows."""
    def send(key, table):
        return batch(make_messages(key[0].as_py(), table))
    return docs.groupBy("chunk").applyInArrow(send, MESSAGE)


def sent_after(docs: DataFrame, answers: DataFrame, make_messages) -> DataFrame:
    """Messages of every chunk that has got answers: make_messages(chunk, table, answers)."""
    def send(key, table, got):
        return batch(make_messages(key[0].as_py(), table, got) if len(table) and len(got) else [])
    return docs.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(send, MESSAGE)
