"""Exact dedup by composable polynomial fingerprints.

Texts are equal when they are identical after each run of blanks is made one
space. The normalised bytes of a text are cut into chunks of ``CHUNK`` bytes.
Every chunk is hashed by itself, all chunks of a slice at once: a polynomial in
the bytes modulo the prime 2**31 - 1, for four bases. Two neighbouring pieces
(h1, n1) and (h2, n2) have the joint hash h1 * base**n2 + h2, so the chunk
hashes of a document are shifted by the bytes that follow them and added up,
whatever its size. With the length, the four sums are the document's fingerprint.

Equal fingerprints prove nothing: the chunks at one position of all documents
of a fingerprint are compared with each other. The comparison is an aggregate
(the least and the greatest chunk must be the same bytes), so copies are
reduced by the map tasks, a group of copies of any size is never in one task,
and what moves is a row for each task and chunk. Only documents whose
fingerprint may occur twice take part: a bitmap of ``BITS`` bits, whatever the
input's size, says which. Where chunks differ, the fingerprint's documents
are told apart by the ranks of their chunks among those at the same position.

Memory: about six times the longest text in a task; hashing works on ranges of
chunks.

Defined cases: null counts as empty, and empty texts are copies of each other.
Ids may repeat or be null: of rows equal in id and text one stays, a null id
counts as the greatest, keep_id is null where all ids of the group are. Other
columns, of any name, are not looked at.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .rowwise import map_texts, quoted
from .textarrays import NOT_BLANK, slices, utf8

#: Bytes of a chunk. A chunk's sum of 2**15 products of 9 and 31 bits fits a long.
CHUNK = 1 << 15
PRIME = (1 << 31) - 1
BASES = (1_313_667_449, 761_234_921, 1_998_244_417, 402_653_189)
#: Bytes of whole chunks that are hashed at once.
RANGE = 2 << 20
#: Bits of the map of repeated fingerprints (8 MB). Beyond some ten million
#: repeated fingerprints it lets more single documents into the comparison.
BITS = 1 << 26
KEY = ["hi", "lo", "n_bytes"]


def normalised(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of the texts with each run of blanks made one space."""
    blank = ~NOT_BLANK[data]
    again = np.zeros(len(data), bool)
    again[1:] = blank[1:] & blank[:-1]
    again[off[:-1][np.diff(off) > 0]] = False
    out = np.where(blank, np.uint8(0x20), data)
    left = np.zeros(len(data) + 1, np.int64)
    np.cumsum(~again, out=left[1:])
    return out[~again], left[off]


def chunk_starts(off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start of every chunk, first chunk of every row); an empty text has one
    empty chunk."""
    count = np.maximum(1, -(-np.diff(off) // CHUNK))
    first = np.concatenate([[0], np.cumsum(count)])
    k = np.arange(first[-1]) - np.repeat(first[:-1], count)
    return np.repeat(off[:-1], count) + k * CHUNK, first


def powers(base: int, exponent: np.ndarray) -> np.ndarray:
    """base ** exponent modulo PRIME, for each exponent."""
    out, square, e = np.ones(len(exponent), np.int64), base, exponent.copy()
    while e.any():
        out = np.where(e & 1, out * square % PRIME, out)
        square, e = square * square % PRIME, e >> 1
    return out


def joined(left: int, right: int, n_right: int, base: int) -> int:
    """Hash of two pieces side by side, of which the right one has n_right bytes."""
    return (left * pow(base, n_right, PRIME) + right) % PRIME


class Hasher:
    """Fingerprints of the texts of a slice."""

    def __init__(self):
        self.table = [powers(b, np.arange(CHUNK)) for b in BASES]

    def chunks(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of every chunk for every base; chunks lie side by side."""
        out = np.zeros((len(BASES), len(start)), np.int64)
        at = 0
        while at < len(start):
            to = max(at + 1, int(np.searchsorted(end, start[at] + RANGE, "right")))
            size = end[at:to] - start[at:to]
            some = np.flatnonzero(size)
            if len(some):
                part = data[start[at]:end[to - 1]].astype(np.int64) + 1
                after = np.repeat(end[at:to], size) - 1 - np.arange(start[at], end[to - 1])
                for row, table in zip(out, self.table):
                    row[at + some] = np.add.reduceat(part * table[after], start[at:to][some] - start[at]) % PRIME
            at = to
        return out

    def documents(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The two halves of each document's fingerprint: chunk hashes, each
        shifted by the bytes that follow in its document, added up."""
        start, first = chunk_starts(off)
        end = np.minimum(start + CHUNK, np.repeat(off[1:], np.diff(first)))
        follow = np.repeat(off[1:], np.diff(first)) - end
        h = [np.add.reduceat(c * powers(b, follow) % PRIME, first[:-1]) % PRIME
             for c, b in zip(self.chunks(data, start, end), BASES)]
        return (h[0] << 31) | h[1], (h[2] << 31) | h[3]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, hi, lo, n_bytes, text_sha256) of every row."""
    def make():
        hasher = Hasher()

        def run(column):
            if not len(column):
                return [pa.array([], pa.int64())] * 3 + [pa.array([], pa.string())]
            data, off = normalised(*utf8(column))
            raw = memoryview(np.ascontiguousarray(data))
            sha = [hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(off[:-1].tolist(), off[1:].tolist())]
            return [*map(pa.array, hasher.documents(data, off)), pa.array(np.diff(off)), pa.array(sha)]
        return run

    return map_texts(docs, make, [("hi", "bigint"), ("lo", "bigint"), ("n_bytes", "bigint"), ("text_sha256", "string")],
                     id_col=id_col, text_col=text_col)


def repeated_bits(rows: DataFrame) -> np.ndarray:
    """Bitmap (by the last bits of lo) of the fingerprints of two rows or more."""
    place = F.col("lo").bitwiseAND(BITS - 1) + 1
    found = rows.groupBy(*KEY).agg(F.count("*").alias("n")).where("n > 1").select(place.alias("place"))
    parts = found.groupBy(F.bitmap_bucket_number("place").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits"))
    out = np.zeros(BITS // 8, np.uint8)
    for bucket, raw in parts.collect():  # at most BITS / 8 bytes in all
        part = np.frombuffer(raw, np.uint8)
        at = (bucket - 1) * len(part)
        out[at:at + len(part)] = part[:len(out) - at]
    return out


def chunk_rows(docs: DataFrame, bits: np.ndarray, id_col: str, text_col: str, with_id: bool = False) -> DataFrame:
    """(hi, lo, n_bytes, k, chunk) of the documents whose fingerprint is in the
    bitmap; ``with_id`` adds (id, text_sha256)."""
    text = F.col(quoted(text_col)).cast("string").alias("text")
    src = docs.select(*[F.col(quoted(id_col)).alias("id")] * with_id, text)
    schema = "hi bigint, lo bigint, n_bytes bigint, k bigint, chunk binary"
    if with_id:
        schema += f", text_sha256 string, id {src.schema['id'].dataType.simpleString()}"

    def run(batches):
        hasher = Hasher()
        for batch in batches:
            for a, b in slices(batch.column("text")):
                data, off = normalised(*utf8(batch.column("text").slice(a, b - a)))
                hi, lo = hasher.documents(data, off)
                place = lo & (BITS - 1)
                taken = np.flatnonzero(bits[place >> 3] >> (place & 7).astype(np.uint8) & 1)
                if not len(taken):
                    continue
                start, first = chunk_starts(off)
                raw = pa.py_buffer(np.ascontiguousarray(data))
                ends = np.append(start, off[-1]).astype(np.int64)
                chunks = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(ends), raw])
                count = np.diff(first)[taken]
                k = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                at, row = np.repeat(first[taken], count) + k, np.repeat(taken, count)
                step = max(1, RANGE // CHUNK)
                for x in range(0, len(at), step):
                    r, c = row[x:x + step], at[x:x + step]
                    columns = [hi[r], lo[r], np.diff(off)[r], k[x:x + step]]
                    columns = [pa.array(v) for v in columns] + [chunks.take(pa.array(c)).cast(pa.binary())]
                    if with_id:
                        sha = {i: hashlib.sha256(data[off[i]:off[i + 1]]).hexdigest() for i in set(r.tolist())}
                        columns += [pa.array([sha[i] for i in r.tolist()]), batch.column("id").slice(a, b - a).take(pa.array(r))]
                    yield pa.RecordBatch.from_arrays(columns, [*KEY, "k", "chunk", *["text_sha256", "id"][:2 * with_id]])

    return src.mapInArrow(run, schema)


def told_apart(docs: DataFrame, bits: np.ndarray, collided: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text_sha256, hi, lo, n_bytes, part) of the documents whose
    fingerprint stands for different texts: part is the ranks of a document's
    chunks among the different chunks at their positions, so equal parts are
    equal texts. Of any number of copies, one chunk is ranked."""
    chunks = chunk_rows(docs, bits, id_col, text_col, with_id=True).join(collided, KEY, "left_semi").distinct()
    place = Window.partitionBy(*KEY, "k").orderBy("chunk")
    ranks = chunks.select(*KEY, "k", "chunk").distinct().withColumn("rank", F.row_number().over(place))
    ranked = chunks.join(ranks, [*KEY, "k", "chunk"]).groupBy("id", "text_sha256", *KEY)
    parts = F.transform(F.array_sort(F.collect_list(F.struct("k", "rank"))), lambda x: x["rank"].cast("string"))
    return ranked.agg(F.array_join(parts, ",").alias("part"))


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every row of docs."""
    ensure_checkpoint_dir(docs.sparkSession)
    rows = fingerprints(docs, id_col, text_col).withColumnRenamed(id_col, "id").checkpoint()
    bits = repeated_bits(rows)
    part = F.lit("").alias("part")
    rows = rows.groupBy("id", "text_sha256", *KEY).agg(F.count("*").alias("times"))
    if bits.any():
        same = chunk_rows(docs, bits, id_col, text_col).groupBy(*KEY, "k").agg(
            F.min("chunk").alias("least"), F.max("chunk").alias("most"))
        collided = same.where("least <> most").select(*KEY).distinct().checkpoint()
        if not collided.isEmpty():
            told = told_apart(docs, bits, collided, id_col, text_col).withColumnRenamed("id", "told_id")
            on = [F.col("id").eqNullSafe(F.col("told_id")), *[rows[c] == told[c] for c in [*KEY, "text_sha256"]]]
            rows = rows.join(told, on, "left").select("id", rows["text_sha256"], *[rows[c] for c in KEY], "times", "part")
            part = F.coalesce("part", F.lit("")).alias("part")
    rows = rows.select("id", "text_sha256", *KEY, "times", part)
    groups = rows.groupBy(*KEY, "part").agg(F.min("id").alias("keep_id"), F.sum("times").alias("group_size")).checkpoint()
    out = rows.join(groups, [*KEY, "part"]).withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), "times")))
    kept = (F.col("i") == 1) & F.col("id").eqNullSafe(F.col("keep_id"))
    return out.select(F.col("id").alias(id_col), "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def kept_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all columns: one of each group of equal
    texts (of rows equal in id and text any one)."""
    found = report(docs, id_col, text_col).where("kept").select(F.col(quoted(id_col)).alias("id"), "text_sha256")
    text = F.regexp_replace(F.coalesce(F.col(quoted(text_col)).cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " ")
    row = docs.select(F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("row"),
                      F.col(quoted(id_col)).alias("row_id"), F.sha2(text, 256).alias("row_sha"))
    on = F.col("row_id").eqNullSafe(F.col("id")) & (F.col("row_sha") == F.col("text_sha256"))
    return row.join(found, on, "left_semi").dropDuplicates(["row_id", "row_sha"]).select("row.*")
