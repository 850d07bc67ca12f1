"""Benchmark decontamination with a generalised suffix automaton.

The normalised words of all benchmark items go into one suffix automaton.
Training words are streamed through it; after each word the automaton tells the
longest suffix that occurs in some item. A window (``window`` consecutive item
words; a shorter item is one window) occurs where that length reaches the
window's, and the state reached by suffix links says which items hold it.

A word that no item has takes the automaton back to its root, so the maximal
runs of benchmark words are independent streams, and a run shorter than the
shortest window holds none. Words are hashed and looked up as numpy arrays;
only the remaining runs are streamed.

Scale: documents are never shuffled. Distinct items are dealt into blocks of
about half of ``block_bytes`` of text; a longer item is cut into parts that
overlap by a window less one word, so each window is whole in one of them.
Spark tasks build the blocks' automata and write them to the checkpoint folder;
a scanning task reads one block at a time, so a larger benchmark costs time and
disk, not memory. The driver sees the blocks' paths only.

Defined cases: null or empty text has no words and no hits; null, empty and
wordless items, and items without an id, give no window; items with equal texts
each count; rows with equal ids are judged separately; an empty benchmark hits
nothing.
"""

from __future__ import annotations

import pickle
import uuid

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path
from .rowwise import map_texts, quoted
from .textarrays import (Rolling, byte_class, cover, lower_ascii, per_row, slices, utf8, words)

WINDOW = 10
BLOCK_BYTES = 4 << 20
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F] after A-Z are lower-cased.
WORD_BYTES = byte_class(included=[*range(48, 58), *range(97, 123), *range(128, 256)])
SEED = 10


def normalised_words(column, rolling: Rolling):
    """(lower-cased bytes, Words, word hashes) of a text column."""
    data, off = utf8(column)
    data = lower_ascii(data)
    w = words(data, off, WORD_BYTES)
    return data, w, rolling.of_words(data, w)


class SuffixAutomaton:
    """Generalised suffix automaton over word sequences."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]

    def _clone(self, p: int, q: int, c: int) -> int:
        new = len(self.next)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        self.link[q] = new
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = new
            p = self.link[p]
        return new

    def _extend(self, last: int, c: int) -> int:
        q = self.next[last].get(c)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, q, c)
        new = len(self.next)
        self.next.append({})
        self.link.append(0)
        self.length.append(self.length[last] + 1)
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, q, c)
        return new

    def add(self, sequence) -> None:
        last = 0
        for c in sequence:
            last = self._extend(last, c)

    def matching(self, sequence):
        """(state, length) of the longest known suffix after each symbol."""
        nxt, link, length = self.next, self.link, self.length
        v = n = 0
        for c in sequence:
            to = nxt[v].get(c)
            while to is None and v:
                v = link[v]
                n = length[v]
                to = nxt[v].get(c)
            if to is not None:
                v, n = to, n + 1
            yield v, n

    def holding(self, v: int, n: int) -> int:
        """The state of the last n symbols, given a state of at least n."""
        while self.length[self.link[v]] >= n:
            v = self.link[v]
        return v


class Index:
    """Automaton of a block of items, with the items of each window. hashes: of
    each item's words, or of a part's of an item."""

    def __init__(self, item_ids: list[str], hashes: list[np.ndarray], window: int = WINDOW):
        vocabulary, code = np.unique(np.concatenate([np.zeros(0, np.uint64), *hashes]), return_inverse=True)
        self.vocabulary = vocabulary
        self.automaton = a = SuffixAutomaton()
        sequences = [x.tolist() for x in np.split(code, np.cumsum([len(h) for h in hashes])[:-1])]
        for s in sequences:
            a.add(s)
        self.items: dict[tuple[int, int], list[str]] = {}
        for item, s in zip(item_ids, sequences):
            size = min(window, len(s))
            if size:
                for v, n in a.matching(s):
                    if n >= size:
                        held = self.items.setdefault((size, a.holding(v, size)), [])
                        if not held or held[-1] != item:
                            held.append(item)
        self.sizes = sorted({size for size, _ in self.items})

    def dumps(self) -> bytes:
        """Plain values, which a worker without this module can load."""
        a = self.automaton
        return pickle.dumps((self.vocabulary, a.next, a.link, a.length, self.items, self.sizes), pickle.HIGHEST_PROTOCOL)

    @classmethod
    def loads(cls, raw) -> Index:
        self, a = cls.__new__(cls), SuffixAutomaton()
        self.vocabulary, a.next, a.link, a.length, self.items, self.sizes = pickle.loads(raw)
        self.automaton = a
        return self

    def hits(self, h: np.ndarray, row: np.ndarray):
        """(word is hit, [(row, item), ...]) for word hashes h of rows."""
        n = len(h)
        hit, found = np.zeros(n, bool), set()
        if not n or not self.sizes:
            return hit, found
        at = np.minimum(np.searchsorted(self.vocabulary, h), len(self.vocabulary) - 1)
        known = self.vocabulary[at] == h
        edge = np.diff(np.concatenate([[False], known, [False]]).astype(np.int8))
        begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        cuts = row[1:-1][(row[1:-1] > 0) & (row[1:-1] < n)]
        cuts = np.unique(cuts)
        cuts = cuts[known[cuts] & known[cuts - 1]]
        begin, end = np.sort(np.concatenate([begin, cuts])), np.sort(np.concatenate([end, cuts]))
        least, a, items = self.sizes[0], self.automaton, self.items
        long = end - begin >= least
        starts: dict[int, list[int]] = {size: [] for size in self.sizes}
        for b, e in zip(begin[long].tolist(), end[long].tolist()):
            r = -1
            for j, (v, n_) in enumerate(a.matching(at[b:e].tolist()), b):
                if n_ < least:
                    continue
                for size in self.sizes:
                    if n_ < size:
                        break
                    if held := items.get((size, a.holding(v, size))):
                        starts[size].append(j - size + 1)
                        if r < 0:
                            r = int(np.searchsorted(row, j, "right")) - 1
                        found.update((r, x) for x in held)
        for size, s in starts.items():
            if s:
                hit |= cover(np.asarray(s), size, n)
        return hit, found


def parts(n: int, most: int, window: int) -> list[tuple[int, int]]:
    """Ranges of n words, of at most ``most`` (and not under ``window`` unless n
    is), so that every window lies in one."""
    return [(a, min(n, a + most)) for a in range(0, max(1, n - window + 1), most - window + 1)] if n else []


def written_blocks(items: DataFrame, id_col: str, text_col: str, window: int, block_bytes: int) -> list[str]:
    """Paths of the written indexes of the items' blocks."""
    src = items.select(F.col(quoted(id_col)).cast("string").alias("id"), F.col(quoted(text_col)).cast("string").alias("text"))
    src = src.where("id is not null and text is not null").distinct()
    total = src.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if not total:
        return []
    n_blocks = max(1, -(-total // max(1, block_bytes // 2)))
    most = max(2 * window, block_bytes // 16)

    def cut(batches):
        rolling = Rolling(SEED)
        for batch in batches:
            for a, b in slices(batch.column("text")):
                _, w, h = normalised_words(batch.column("text").slice(a, b - a), rolling)
                for r, item in enumerate(batch.column("id").slice(a, b - a).to_pylist()):
                    x, y = int(w.row[r]), int(w.row[r + 1])
                    for k, (i, j) in enumerate(parts(y - x, most, window)):
                        yield pa.RecordBatch.from_pydict({
                            "id": pa.array([item], pa.string()), "part": pa.array([k], pa.int64()),
                            "words": pa.array([h[x + i:x + j].astype("<u8").tobytes()], pa.binary())})

    cuts = src.mapInArrow(cut, "id string, part bigint, words binary")
    cuts = cuts.withColumn("block", F.pmod(F.xxhash64("id", "part", "words"), F.lit(n_blocks)))
    folder = f"{scratch_path(items.sparkSession, 'decontaminate')}/{uuid.uuid4().hex}"

    def build(key, table):
        index = Index(table.column("id").to_pylist(), [np.frombuffer(x, "<u8") for x in table.column("words").to_pylist()], window)
        store, path = fs.FileSystem.from_uri(folder)
        path = f"{path}/{key[0].as_py()}"
        store.create_dir(path.rsplit("/", 1)[0])
        trial = f"{path}.{uuid.uuid4().hex}"  # a task may run twice
        with store.open_output_stream(trial) as out:
            out.write(index.dumps())
        store.move(trial, path)
        return pa.table({"block": pa.array([key[0].as_py()], pa.int64())})

    made = cuts.groupBy("block").applyInArrow(build, "block bigint").collect()
    return [f"{folder}/{r['block']}" for r in sorted(made)]


def read_index(path: str) -> Index:
    store, path = fs.FileSystem.from_uri(path)
    with store.open_input_stream(path) as raw:
        return Index.loads(raw.read())


def annotate(docs: DataFrame, items: DataFrame, *, window: int = WINDOW, block_bytes: int = BLOCK_BYTES,
             id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
             carry: str | None = None, max_span: int | None = None, max_coverage: float = 1.0) -> DataFrame:
    """Per document: n_words, n_hit, items (ids, sorted as strings), spans (hit
    runs as character ranges [start, end) from first word's to last word's
    characters), coverage (hit share of words), and if ``max_span`` is given:
    cleaned, the text without the spans of more than that many words, and over,
    whether the coverage exceeds ``max_coverage``. With ``carry`` the cleaned
    text replaces the carried one."""
    limited = max_span is not None
    blocks = written_blocks(items, item_id, item_text, window, block_bytes)

    def make():
        rolling = Rolling(SEED)
        only = read_index(blocks[0]) if len(blocks) == 1 else None

        def fn(column):
            data, w, h = normalised_words(column, rolling)
            rows = len(column)
            hit, found = np.zeros(len(h), bool), set()
            for b in blocks:  # several blocks: one in memory at a time
                one, more = (only or read_index(b)).hits(h, w.row)
                hit |= one
                found |= more
            n_hit = per_row(hit, w.row)
            items: list[list[str]] = [[] for _ in range(rows)]
            for r, item in found:
                items[r].append(item)
            spans: list[list[dict]] = [[] for _ in range(rows)]
            cleaned = column.to_pylist() if limited else []
            _, off = utf8(column)
            for r in np.flatnonzero(n_hit).tolist():
                lo, hi = int(w.row[r]), int(w.row[r + 1])
                edge = np.diff(np.concatenate([[False], hit[lo:hi], [False]]).astype(np.int8))
                raw, out, at = column[r].as_py().encode(), [], 0
                for x, y in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()):
                    s, e = int(w.start[lo + x] - off[r]), int(w.end[lo + y - 1] - off[r])
                    a = len(raw[:s].decode())
                    spans[r].append({"start": a, "end": a + len(raw[s:e].decode()), "words": y - x})
                    if limited and y - x > max_span:
                        out.append(raw[at:s])
                        at = e
                if limited:
                    cleaned[r] = b"".join([*out, raw[at:]]).decode()
            n_words = w.count
            share = n_hit / np.maximum(n_words, 1)
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("words", pa.int64())]))
            return [pa.array(n_words), pa.array(n_hit), pa.array([sorted(x) for x in items], pa.list_(pa.string())),
                    pa.array(spans, span), pa.array(share)] + (
                        [pa.array(cleaned, pa.string()), pa.array(share > max_coverage)] if limited else [])

        return fn

    return map_texts(docs, make, [
        ("n_words", "bigint"), ("n_hit", "bigint"), ("items", "array<string>"),
        ("spans", "array<struct<start:bigint,end:bigint,words:bigint>>"), ("coverage", "double"),
        *([("cleaned", "string"), ("over", "boolean")] if limited else [])],
        id_col=id_col, text_col=text_col, carry=carry, new_text="cleaned" if limited and carry else None)


def report(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """One row per document for the whole table, from annotate()."""
    d = annotate(docs, items, **options)
    return d.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
