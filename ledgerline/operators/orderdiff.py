"""Ordered line diff of two versions of documents, with hunks.

Both versions of a document meet in one join of whole texts, so its lines are
never rows: shuffles hold each text once, and all else is done for one document
after the other, in memory of its size.

Lines are matched in two steps: first the lines that occur once in either
version, then, between the matches that hold, the k-th occurrences of equal
lines. Matches may cross (a moved line), so of each step's matches the longest
run that ascends in both versions is kept, for one document (or one gap of it)
in n log n steps. The pairs of a document are at most its lines, also where a
line repeats.

Keys are not null and stand once in a version; a null text has no lines.
"""

from __future__ import annotations

import sys
from bisect import bisect_left
from itertools import pairwise

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.functions.text import split_lines

# functions reach the workers by value, which need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Equal lines around a change, fixed value.
CONTEXT = 3
#: Rows of a batch that is returned, about.
ROWS_OUT = 20_000


def longest_run(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A longest run of (i, j), sorted by i, that ascends in both; no i or j
    occurs twice. Piles by the least last j of a run of their length; a pair
    follows the one on top of the pile before."""
    tops, last, before = [], [], []
    for n, (_, j) in enumerate(pairs):
        at = bisect_left(tops, j)
        before.append(last[at - 1] if at else None)
        tops[at:at + 1], last[at:at + 1] = [j], [n]
    out, n = [], last[-1] if last else None
    while n is not None:
        out.append(pairs[n])
        n = before[n]
    return out[::-1]


def ascending(pairs: DataFrame) -> DataFrame:
    """(key, i, j): of the pairs of each key and gap, the ``longest_run``."""
    grouped = pairs.groupBy("key", "gap").agg(F.array_sort(F.collect_list(F.struct("i", "j"))).alias("pairs"))

    def run(batches):
        for batch in batches:
            kept = [[{"i": i, "j": j} for i, j in longest_run([(p["i"], p["j"]) for p in found])]
                    for found in batch.column("pairs").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(kept, batch.schema.field("pairs").type)], ["key", "pairs"])

    key = grouped.schema["key"].dataType.simpleString()
    runs = grouped.select("key", "pairs").mapInArrow(run, f"key {key}, pairs array<struct<i: int, j: int>>")
    return runs.select("key", F.explode("pairs").alias("p")).select("key", "p.i", "p.j")


def matched_lines(a: list[bytes], b: list[bytes]) -> list[tuple[int, int]]:
    """(i, j), ascending and counted from 0: line i of one version is line j of the other."""
    def once(lines: list[bytes]) -> dict[bytes, int]:
        places: dict[bytes, int] = {}
        for n, line in enumerate(lines):
            places[line] = -1 if line in places else n
        return places
    in_b = once(b)
    anchors = longest_run([(i, j) for line, i in once(a).items() if i >= 0 and (j := in_b.get(line, -1)) >= 0])
    out = []
    # between two anchors neither version has a line that is matched yet
    for (i0, j0), (i1, j1) in pairwise([(-1, -1), *anchors, (len(a), len(b))]):
        if i0 + 1 < i1 and j0 + 1 < j1:
            places: dict[bytes, list[int]] = {}
            for j in range(j1 - 1, j0, -1):
                places.setdefault(b[j], []).append(j)
            out += longest_run([(i, found.pop()) for i in range(i0 + 1, i1) if (found := places.get(a[i]))])
        if i1 < len(a):
            out.append((i1, j1))
    return out


def hunk_rows(a: list[bytes], b: list[bytes], context: int) -> list[tuple[int, str, int | None, int | None, bytes]]:
    """(hunk, op, before_line, after_line, line) of two versions' hunks, in order."""
    matches = matched_lines(a, b)
    out, hunk, until = [], 0, 0
    after_last = None  # equal lines since the last change; None: there was none
    i = j = 0
    for n, (i1, j1) in enumerate([*matches, (len(a), len(b))]):
        if i < i1 or j < j1:
            # equal lines before this change that did not follow the last one
            first = max(until, n - context)
            if after_last is None or first > until:
                hunk += 1
            out += [(hunk, " ", x + 1, y + 1, a[x]) for x, y in matches[first:n]]
            out += [(hunk, "-", x + 1, None, a[x]) for x in range(i, i1)]
            out += [(hunk, "+", None, y + 1, b[y]) for y in range(j, j1)]
            after_last, until = 0, n
        if n < len(matches) and after_last is not None and after_last < context:
            out.append((hunk, " ", i1 + 1, j1 + 1, a[i1]))
            after_last, until = after_last + 1, n + 1
        i, j = i1 + 1, j1 + 1
    return out


def ordered_diff(before: DataFrame, after: DataFrame, key: str = "doc_id", text: str = "text", context: int = CONTEXT) -> DataFrame:
    """(key, hunk, position, op, before_line, after_line, line): the lines of
    each document's hunks in order; op is ``-``, ``+`` or a blank for the
    ``context`` equal lines around a change. Line numbers count from 1;
    before_line is null for ``+``, after_line for ``-``."""
    def version(df: DataFrame, name: str) -> DataFrame:
        return df.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias(name))

    def lines(name: str):
        # as bytes: lines are only compared, and a text may hold what is no character
        found = F.transform(split_lines(F.col(name)), lambda x: x.cast("binary"))
        return F.coalesce(found, F.array().cast("array<binary>")).alias(name)
    # a text that is as it was has no hunk; split behind the join, so that texts are moved and not their lines
    changed = version(before, "a").join(version(after, "b"), "key", "full").where(~F.col("a").eqNullSafe(F.col("b")))
    both = changed.select("key", lines("a"), lines("b"))
    schema = T.StructType([T.StructField(key, both.schema["key"].dataType), T.StructField("hunk", T.IntegerType()),
                           T.StructField("position", T.IntegerType()), T.StructField("op", T.StringType()),
                           T.StructField("before_line", T.IntegerType()), T.StructField("after_line", T.IntegerType()),
                           T.StructField("line", T.BinaryType())])

    def run(batches):
        def made(keys, of, positions, rows):
            hunk, op, old, new, line = zip(*rows)
            return pa.RecordBatch.from_arrays([
                keys.take(pa.array(of, pa.int32())), pa.array(hunk, pa.int32()), pa.array(positions, pa.int32()), pa.array(op, pa.string()),
                pa.array(old, pa.int32()), pa.array(new, pa.int32()), pa.array(line, pa.binary())], schema.names)
        for batch in batches:
            of, positions, rows = [], [], []
            for n in range(batch.num_rows):
                found = hunk_rows(batch.column("a")[n].as_py(), batch.column("b")[n].as_py(), context)
                for at in range(0, len(found), ROWS_OUT):
                    part = found[at:at + ROWS_OUT]
                    rows += part
                    of += [n] * len(part)
                    positions += range(at + 1, at + 1 + len(part))
                    if len(rows) >= ROWS_OUT:
                        yield made(batch.column("key"), of, positions, rows)
                        of, positions, rows = [], [], []
            if rows:
                yield made(batch.column("key"), of, positions, rows)

    return both.mapInArrow(run, schema).withColumn("line", F.col("line").cast("string"))


def hunk_headers(diff: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, hunk, before_start, before_lines, after_start, after_lines) as in a
    hunk's head; a start is null where the hunk has no line of that version."""
    return diff.groupBy(key, "hunk").agg(
        F.min("before_line").alias("before_start"), F.count("before_line").alias("before_lines"),
        F.min("after_line").alias("after_start"), F.count("after_line").alias("after_lines"))
