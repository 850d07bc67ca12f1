"""SimHash near-dedup with deletion-variant signatures.

A fingerprint of 64 bits is cut into distance // 2 + 1 segments, fewer than
exact matches would need: if two fingerprints differ in at most
``distance`` bits, one segment differs in at most one. A segment of s bits has
s variants with one bit wild; two segments share a variant exactly if they
differ in no more than one bit. So the variants of all segments, with the
segment's and the wild bit's number, are the keys of an equality join, and the
pairs that meet are verified by their distance.

Only distinct fingerprints take part: equal texts are one node. Keys are dealt
into groups of many keys; a task sorts a group, verifies the fingerprints that
share a key, and keeps per key a spanning forest of the links that hold, never
all pairs. A key with more than ``HOT`` fingerprints first gets a second key,
from the bits outside its segment: cut into distance + 1 parts, one of which two
linked fingerprints have in common; it spreads over many groups that way. Within
a task, a key of many fingerprints is cut in the same way along the bits that
vary in it, again and again; where few bits vary, every flip of them is looked
up. So no large set is compared in pairs.

Components are joined by graph.components over the forests' links.

Defined cases: null, empty and blank texts have fingerprint zero and are linked
like any other; fewer words than a shingle make one shingle of them all; rows
with equal ids keep a row each; a null id gets a component like any other, and
is null only if all ids that it reaches are; an empty table gives no row.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .graph import components
from .rowwise import map_texts, quoted
from .textarrays import lower_ascii, utf8, words

SHINGLE = 3
DISTANCE = 3
SEED = 42
#: Fingerprints of a key beyond which it gets a second key.
HOT = 50_000
#: Keys of a group that a task gets at once, about.
GROUP_ROWS = 500_000


def fingerprints_of(column, shingle: int = SHINGLE) -> np.ndarray:
    """64-bit SimHash (u64) of every text of a column."""
    data, off = utf8(column)
    data = lower_ascii(data)
    w = words(data, off)
    # words joined by one space: each word and the byte after it
    size = w.end - w.start + 1
    end = np.concatenate([[0], np.cumsum(size)])
    joined = np.append(data, np.uint8(32))[np.repeat(w.start - end[:-1], size) + np.arange(end[-1])]
    joined[end[1:] - 1] = 32
    count = w.count
    n = np.where(count > 0, np.maximum(count - shingle + 1, 1), 0)  # shingles of a row
    row_end = np.concatenate([[0], np.cumsum(n)])
    first = np.repeat(w.row[:-1] - row_end[:-1], n) + np.arange(row_end[-1])
    last = np.minimum(first + shingle, np.repeat(w.row[1:], n))
    raw, digest = joined.tobytes(), xxhash.xxh64_intdigest
    h = np.fromiter((digest(raw[a:b], SEED) for a, b in zip(end[first].tolist(), (end[last] - 1).tolist())),
                    np.uint64, len(first))
    out = np.zeros(len(column), np.uint64)
    some = np.flatnonzero(n)
    if len(some):
        bit = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bit, row_end[some], axis=0, dtype=np.int32)
        big = (2 * ones > n[some, None]).astype(np.uint8)
        out[some] = np.packbits(big, axis=1, bitorder="little").view("<u8").ravel()
    return out


def fingerprints(docs: DataFrame, *, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text",
                 carry: str | None = None) -> DataFrame:
    """(id, fp): the fingerprint's 64 bits as a signed long."""
    def make():
        return lambda column: [pa.array(fingerprints_of(column, shingle).view(np.int64))]
    return map_texts(docs, make, [("fp", "bigint")], id_col=id_col, text_col=text_col, carry=carry, most=1 << 20)


def widths(bits: int, parts: int) -> list[tuple[int, int]]:
    """(shift, width) of nearly equal parts of so many bits."""
    edges = [bits * i // parts for i in range(parts + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def variant_keys(nodes: DataFrame, distance: int) -> DataFrame:
    """(wild, key, fp): one key for each segment and wild bit (its place in the
    fingerprint)."""
    keys = []
    for shift, width in widths(64, distance // 2 + 1):
        segment = F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit((1 << width) - 1 if width < 64 else -1))
        for wild in range(width):
            low = segment.bitwiseAND(F.lit((1 << wild) - 1))
            high = F.shiftleft(F.shiftrightunsigned(segment, wild + 1), wild) if wild < width - 1 else F.lit(0)
            keys.append(F.xxhash64(F.lit(shift + wild), low.bitwiseOR(high)) if width > 57 else
                        low.bitwiseOR(high).bitwiseOR(F.lit((shift + wild) << (width - 1))))
    return nodes.select(F.posexplode(F.array(*keys)).alias("wild", "key"), "fp")


def second_keys(rows: DataFrame, distance: int) -> DataFrame:
    """(key, fp): for rows of hot keys, one key for each part of the bits outside
    the key's segment; fingerprints that differ there in at most distance bits
    agree in one part. (One segment of all bits: its key holds two fingerprints
    at most and is never hot, but for equal hashes.)"""
    keys = []
    for shift, width in widths(64, distance // 2 + 1):
        low = F.col("fp").bitwiseAND(F.lit((1 << shift) - 1))
        rest = low.bitwiseOR(F.shiftleft(F.shiftrightunsigned("fp", shift + width), shift)) if shift + width < 64 else low
        mine = F.col("wild").between(shift, shift + width - 1)
        keys += [F.when(mine, F.xxhash64("key", F.lit(i), F.shiftrightunsigned(rest, s).bitwiseAND(F.lit((1 << w) - 1))))
                 for i, (s, w) in enumerate(widths(64 - width, distance + 1))]
    return rows.select(F.explode(F.filter(F.array(*keys), lambda x: x.isNotNull())).alias("key"), "fp")


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index of each node's component, for links a[i] - b[i]."""
    root = np.arange(n)
    while True:
        least = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], least)
        np.minimum.at(new, root[b], least)
        while True:
            jump = new[new]
            if (jump == new).all():
                break
            new = jump
        if (new == root).all():
            return root
        root = new


def flips(bits: int, distance: int) -> np.ndarray:
    return np.array([sum(1 << x for x in c) for d in range(1, distance + 1) for c in combinations(range(bits), d)], np.uint64)


def picked(fp: np.ndarray, places: list[int]) -> np.ndarray:
    """The bits at some places, of every fingerprint."""
    return fp & np.uint64(sum(1 << p for p in places))


def close_links(fp: np.ndarray, distance: int, block: int = 2048) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of sorted distinct fingerprints within the distance, enough
    to connect all that are. More than a block of them are cut along the bits in
    which they differ at all: two within the distance agree in one of distance +
    1 parts of those, so for each part the sets that agree in it are searched in
    the same way. Where those bits are few, or cutting would not halve the pairs,
    every flip is looked up or all are compared, whichever is less."""
    n = len(fp)
    if n < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    varies = int(np.bitwise_or.reduce(fp ^ fp[0]))
    places = [i for i in range(64) if varies >> i & 1]
    few = len(places) < 3 * (distance + 1)
    masks = sum(comb(len(places), d) for d in range(1, distance + 1))
    sets = []
    if n > block and not few:
        for shift, width in widths(len(places), distance + 1):
            part = picked(fp, places[shift:shift + width])
            order = np.argsort(part, kind="stable")  # each set stays sorted
            part = part[order]
            begin = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
            sets.append((part, order, begin, np.diff(np.append(begin, n))))
    # cutting must halve the pairs at least, or it would not end up cheaper
    cut = sets and 2 * sum(int((size * size).sum()) for *_, size in sets) <= n * n
    if n <= block or not cut and n <= 32 * masks:
        root = np.arange(n)
        step = max(1, (1 << 20) // n)  # rows compared at once
        for x in range(0, n, step):
            i, j = np.nonzero(distances(fp[x:x + step, None], fp[None, x:]) <= distance)
            i, j = i + x, j + x
            keep = (i < j) & (root[i] != root[j])  # links within a component add nothing
            if keep.any():
                root = roots(n, np.concatenate([np.arange(n), i[keep]]), np.concatenate([root, j[keep]]))
        return np.arange(n), root
    links = []
    if not cut:
        for flip in flips(len(places), distance).tolist():
            other = fp ^ np.uint64(sum(1 << p for k, p in enumerate(places) if flip >> k & 1))
            at = np.minimum(np.searchsorted(fp, other), n - 1)
            hit = np.flatnonzero((fp[at] == other) & (at > np.arange(n)))
            links.append((hit, at[hit]))
    else:
        for part, order, begin, size in sets:
            small = np.repeat(size, size) <= 32
            for lag in range(1, 32):  # sets of a few: neighbours at each distance in the order
                i = np.flatnonzero(small[:-lag] & small[lag:] & (part[:-lag] == part[lag:]))
                if not len(i):
                    break
                i = i[distances(fp[order[i]], fp[order[i + lag]]) <= distance]
                links.append((order[i], order[i + lag]))
            for b, s in zip(begin[size > 32].tolist(), size[size > 32].tolist()):
                mine = order[b:b + s]
                links.append(tuple(mine[x] for x in close_links(fp[mine], distance, block)))
    i, j = (np.concatenate(x) for x in zip(*links))
    return np.arange(n), roots(n, i, j)


def forest(key: np.ndarray, fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (fp, smaller fp) that connect, per key, what is within the distance."""
    order = np.lexsort((fp, key))
    key, fp = key[order], fp[order]
    n = len(key)
    begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if n else np.zeros(0, int)
    size = np.diff(np.append(begin, n))
    small = np.repeat(size, size) <= 32
    left, right = [], []
    for lag in range(1, 32):  # keys of a few: neighbours at each distance in the order
        i = np.flatnonzero(small[:-lag] & small[lag:] & (key[:-lag] == key[lag:])) if n > lag else np.zeros(0, int)
        if not len(i):
            break
        i = i[distances(fp[i], fp[i + lag]) <= distance]
        left.append(i + lag)
        right.append(i)
    for b, s in zip(begin[size > 32].tolist(), size[size > 32].tolist()):
        i, j = close_links(fp[b:b + s], distance)
        left.append(i + b)
        right.append(j + b)
    if not left:
        return fp[:0], fp[:0]
    a, b = np.concatenate(left), np.concatenate(right)
    root = roots(n, a, b)
    i = np.flatnonzero(root != np.arange(n))
    return fp[i], fp[root[i]]


def links(nodes: DataFrame, distance: int = DISTANCE, hot: int = HOT) -> DataFrame:
    """(u, v): links between distinct fingerprints (column fp) within the
    distance, enough to connect all that are."""
    n_keys = nodes.count() * 64
    groups = max(1, -(-n_keys // GROUP_ROWS))
    # a fingerprint becomes many rows: deal the few bytes of nodes to as many tasks as the rows need
    keys = variant_keys(nodes.repartition(groups, "fp"), distance)
    many = keys.groupBy("key").count().where(F.col("count") > hot).select("key").checkpoint()
    if not many.isEmpty():
        keys = keys.join(many, "key", "left_anti").select("key", "fp").unionAll(second_keys(keys.join(many, "key", "left_semi"), distance))

    def verify(table):
        a, b = forest(table.column("key").to_numpy(), table.column("fp").to_numpy().view(np.uint64), distance)
        pairs = np.unique(np.stack([a, b], 1), axis=0) if len(a) else np.zeros((0, 2), np.uint64)
        return pa.table([pa.array(np.ascontiguousarray(pairs[:, k]).view(np.int64)) for k in (0, 1)], ["u", "v"])

    return (keys.withColumn("group", F.pmod(F.xxhash64("key"), F.lit(groups)))
            .groupBy("group").applyInArrow(verify, "u bigint, v bigint").distinct())


def near_duplicates(docs: DataFrame, *, shingle: int = SHINGLE, distance: int = DISTANCE, hot: int = HOT,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, fp, component_id (the smallest id reachable
    over links, its own included)."""
    ensure_checkpoint_dir(docs.sparkSession)
    rows = fingerprints(docs, shingle=shingle, id_col=id_col, text_col=text_col).withColumnRenamed(id_col, "id").checkpoint()
    nodes = rows.groupBy("fp").agg(F.min("id").alias("least"))
    root = components(links(nodes.select("fp"), distance, hot))
    of = nodes.join(root, nodes.fp == root.u, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = of.groupBy("root").agg(F.min("least").alias("component_id"))
    of = of.select("fp", "root").join(least, "root").select(F.col("fp").alias("fp2"), "component_id")
    return rows.join(of, rows.fp == F.col("fp2")).select(F.col("id").alias(id_col), "fp", "component_id")


def kept_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs, one of each component: that of the smallest id (of
    equal ids, of the smallest hash), whatever its other columns hold."""
    taken = {c.lower() for c in docs.columns}
    key, pick = (next(n for n in (f"{base}{i}" for i in range(len(taken) + 1)) if n not in taken) for base in ("key_", "pick_"))
    keyed = docs.withColumn(key, F.xxhash64(F.col(quoted(id_col)), F.col(quoted(text_col))))
    node = keyed.select(F.struct(F.col(quoted(id_col)).alias("id"), F.col(key).alias("key")).alias("id"), F.col(quoted(text_col)).alias("text"))
    found = near_duplicates(node, id_col="id", text_col="text", **options)
    chosen = found.where(F.col("id") == F.col("component_id")).select(F.col("id.key").alias(key)).distinct()
    # rows equal in id and text: one of them; the join has them together already
    first = F.row_number().over(Window.partitionBy(key, F.col(quoted(id_col))).orderBy(key))
    return keyed.join(chosen, key, "left_semi").withColumn(pick, first).where(F.col(pick) == 1).select(*[F.col(quoted(c)) for c in docs.columns])


def report(docs: DataFrame, **options) -> DataFrame:
    d = near_duplicates(docs, **options)
    return d.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
