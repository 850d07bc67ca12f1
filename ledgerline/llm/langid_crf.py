"""Language identification of words with a linear-chain conditional random field.

Every word gets a label score from hashed features (affixes, character n-grams
inside word boundaries, and the word itself as lexicon entry); labels of
neighbours are tied by learned transitions. Forward-backward gives each word's
posterior; a document's language is the one with most posterior mass, weighted
by the words' bytes, and its score that share.

A chain is at most ``CHAIN`` consecutive words of a document; a longer document
is a sequence of chains, so all its words are labelled and a step works on all
chains of a slice at once.

Training: stochastic gradient of the chains' log-likelihood on the driver, from
a bounded sample: at most about ``per_label`` passages of ``PASSAGE`` words (and
``PASSAGE_CHARS`` characters) for each label, chosen by a hash of id and text.
Every label is learned; beyond ``MANY_LABELS`` of them, passages a label,
features, batches and slices shrink, so that sample, weights and a step's arrays
stay bounded (the transitions are the square of the labels). Half of the
training chains join passages of different labels, so that switches are learned
too. The model (a few MB for a few labels, whatever the input) is broadcast;
prediction is row-wise, without a shuffle.

Defined cases: null text and text without a letter is ``und`` with score 0;
without labelled rows everything is; a null id is never held out and never
learned from; ties go to the smallest label.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rowwise import map_texts, quoted
from .textarrays import U64, Rolling, byte_class, mix, utf8, words

CHAIN = 128
PASSAGE = 192
PASSAGE_CHARS = 4000
PER_LABEL = 500
#: Labels up to which each gets all of its passages and features.
MANY_LABELS = 100
#: Passages a label has at least, however many labels there are.
LEAST_PER_LABEL = 20
TABLE_BITS = 18
#: Cells (words or features by labels) of an array that is made at once.
CELLS = 1 << 25
UND = "und"
SEED = 3
#: Bytes of words after lower-casing: letters and every multi-byte character.
LETTERS = byte_class(included=[*range(97, 123), *range(128, 256)])
GRAMS = (2, 3, 4)
PREFIXES = (1, 2, 3)
SUFFIXES = (2, 3, 4)


def bucket(codes: np.ndarray, space: int) -> np.ndarray:
    return (mix(codes + U64((space + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) >> U64(64 - TABLE_BITS)).astype(np.int64)


class Vocabulary:
    """Distinct words of a slice and their hashed features, word after word."""

    def __init__(self, column, rolling: Rolling):
        data, off = utf8(pc.utf8_lower(column.fill_null("") if column.null_count else column))
        w = words(data, off, LETTERS)
        h = rolling.of_words(data, w)
        self.row = w.row
        known, first, self.word = np.unique(h, return_index=True, return_inverse=True)
        start, end = w.start[first], w.end[first]
        self.bytes = (end - start)
        size = self.bytes + 2                       # with a blank on either side
        to = np.concatenate([[0], np.cumsum(size)])
        body = np.full(int(to[-1]), 32, np.uint8)
        inner = np.repeat(start - (np.cumsum(self.bytes) - self.bytes), self.bytes) + np.arange(int(self.bytes.sum()))
        at = np.repeat(to[:-1] + 1 - (np.cumsum(self.bytes) - self.bytes), self.bytes) + np.arange(len(inner))
        body[at] = data[inner]
        wide = body.astype(np.uint64)
        codes, owners = [bucket(known, 0)], [np.arange(len(known))]
        owner = np.repeat(np.arange(len(known)), size)
        code = wide
        for n in range(2, max(GRAMS) + 1):
            code = (code[:-1] << U64(8)) | wide[n - 1:]
            ok = owner[:len(code)] == owner[n - 1:]
            if n in GRAMS:
                codes.append(bucket(code[ok], n))
                owners.append(owner[:len(code)][ok])
            for fixed, place in ((PREFIXES, to[:-1] + 1), (SUFFIXES, to[1:] - 1 - n)):
                if n in fixed and len(code):
                    some = np.flatnonzero(self.bytes >= n)
                    codes.append(bucket(code[place[some]], 10 * (fixed is SUFFIXES) + 20 + n))
                    owners.append(some)
        codes.append(bucket(wide[to[:-1] + 1], 21) if len(known) else np.zeros(0, np.int64))
        owners.append(np.arange(len(known)))
        feature, owner = np.concatenate(codes), np.concatenate(owners)
        order = np.argsort(owner, kind="stable")
        self.feature, self.count = feature[order], np.bincount(owner, minlength=len(known))
        self.lexicon = np.concatenate([np.ones(len(known), bool), np.zeros(len(feature) - len(known), bool)])[order]

    def scores(self, weights: np.ndarray) -> np.ndarray:
        """(distinct words, labels); a word's features weigh alike in sum."""
        if not len(self.count):
            return np.zeros((0, weights.shape[1]), np.float32)
        begin = np.cumsum(self.count) - self.count
        out = np.empty((len(self.count), weights.shape[1]), np.float32)
        step = max(1, CELLS // weights.shape[1])  # features at once
        cuts = np.unique(np.searchsorted(begin, np.arange(0, len(self.feature), step)))
        fold = TABLE_BITS - (len(weights).bit_length() - 1)
        for a, b in zip(cuts, [*cuts[1:], len(begin)]):
            x, y = begin[a], begin[b] if b < len(begin) else len(self.feature)
            out[a:b] = np.add.reduceat(weights[self.feature[x:y] >> fold], begin[a:b] - x, axis=0)
        return out / np.sqrt(self.count)[:, None].astype(np.float32)


def chains(row: np.ndarray, most: int = CHAIN) -> tuple[np.ndarray, np.ndarray]:
    """(start, size) of chains of rows' words, the longest first."""
    n = np.diff(row)
    k = -(-n // most)
    of = np.repeat(np.arange(len(n)), k)
    step = np.arange(int(k.sum())) - np.repeat(np.cumsum(k) - k, k)
    start = row[:-1][of] + step * most
    size = np.minimum(most, row[1:][of] - start)
    order = np.argsort(-size, kind="stable")
    return start[order], size[order]


def forward_backward(emit: np.ndarray, size: np.ndarray, trans: np.ndarray):
    """Posteriors (steps, chains, labels), the chains' log partition, and the
    expected transitions. emit: (steps, chains, labels), chains by falling size."""
    steps, n, labels = emit.shape
    top = emit.max(2, keepdims=True)
    e = np.exp(emit - top)
    move = np.exp(trans - trans.max())
    live = [int(np.searchsorted(-size, -t, "left")) for t in range(steps)]  # chains with more than t words
    alpha, log_z = np.zeros_like(e), np.zeros(n)
    for t in range(steps):
        k = live[t]
        a = e[t, :k] if t == 0 else (alpha[t - 1, :k] @ move) * e[t, :k]
        s = a.sum(1, keepdims=True)
        alpha[t, :k] = a / s
        log_z[:k] += np.log(s[:, 0]) + top[t, :k, 0] + (trans.max() if t else 0)
    beta = np.ones_like(e)
    expected = np.zeros((labels, labels))
    for t in range(steps - 2, -1, -1):
        k = live[t + 1]
        right = e[t + 1, :k] * beta[t + 1, :k]
        pair = alpha[t, :k].T @ (right / np.maximum(((alpha[t, :k] @ move) * right).sum(1, keepdims=True), 1e-300))
        expected += pair * move
        b = right @ move.T
        beta[t, :k] = b / b.sum(1, keepdims=True)
    post = alpha * beta
    post /= np.maximum(post.sum(2, keepdims=True), 1e-30)
    return post, log_z, expected


def padded(values: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values by (step, chain), and the steps and chains of each word)."""
    steps = int(size[0]) if len(size) else 0
    chain = np.repeat(np.arange(len(size)), size)
    step = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    out = np.zeros((steps, len(size), values.shape[1]), values.dtype)
    out[step, chain] = values[np.repeat(start, size) + step]
    return out, step, chain


class Model:
    def __init__(self, labels: list[str], weights: np.ndarray, trans: np.ndarray):
        self.labels, self.weights, self.trans = labels, weights, trans

    def posteriors(self, v: Vocabulary):
        """(words, their posteriors) of all words of the slice, in groups of
        bounded size; words in ascending order within a chain."""
        scores = v.scores(self.weights)
        start, size = chains(v.row)
        most = max(1, CELLS // max(1, len(self.labels) * CHAIN))
        for a in range(0, len(size), most):
            begin, n = start[a:a + most], size[a:a + most]
            word = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            grid, step, chain = padded(scores[v.word[word]], np.cumsum(n) - n, n)
            post, _, _ = forward_backward(grid, n, self.trans)
            yield word, post[step, chain]


def table_bits(n_labels: int) -> int:
    """So many that the weights of all labels stay bounded."""
    return max(8, TABLE_BITS - max(0, -(-n_labels // MANY_LABELS) - 1).bit_length())


def train(passages: list[tuple[str, str]], *, epochs: int = 4, rate: float = 0.3, decay: float = 1e-4, seed: int = SEED) -> Model | None:
    """passages: (label, text)."""
    labels = sorted({label for label, _ in passages})
    if not labels:
        return None
    passages = sorted(passages)
    rng = np.random.Generator(np.random.PCG64(seed))
    v = Vocabulary(pa.array([t for _, t in passages], pa.string()), Rolling(SEED))
    number = {label: k for k, label in enumerate(labels)}
    gold_of = np.array([number[label] for label, _ in passages])
    n_labels = len(labels)
    bits = table_bits(n_labels)
    v.feature = v.feature >> (TABLE_BITS - bits)
    at_once = max(1, 64 * MANY_LABELS // max(MANY_LABELS, n_labels))
    weights = np.zeros((1 << bits, n_labels), np.float32)
    trans = np.zeros((n_labels, n_labels))
    seen, seen_trans = np.full(weights.shape, 1e-3, np.float32), np.full(trans.shape, 1e-3)
    begin = np.cumsum(v.count) - v.count
    counts = np.diff(v.row)
    for _ in range(epochs):
        # chains of word numbers: whole passages, or parts of several joined
        made, gold = [], []
        order = rng.permutation(len(passages))
        for i, j, k in zip(order, rng.permutation(order), rng.permutation(order)):
            parts = [i] if rng.random() < 0.5 else [i, j, k]
            ws, gs = [], []
            for p in parts:
                n = int(counts[p])
                take = n if len(parts) == 1 else int(rng.integers(2, CHAIN // 3))
                a = int(rng.integers(0, max(1, n - take + 1)))
                x = v.word[v.row[p] + a:v.row[p] + min(n, a + take)]
                ws.append(x)
                gs.append(np.full(len(x), gold_of[p]))
            w, g = np.concatenate(ws)[:CHAIN], np.concatenate(gs)[:CHAIN]
            if len(w):
                made.append(w)
                gold.append(g)
        for a in range(0, len(made), at_once):
            part = sorted(range(a, min(a + at_once, len(made))), key=lambda x: -len(made[x]))
            size = np.array([len(made[x]) for x in part])
            word, y = np.concatenate([made[x] for x in part]), np.concatenate([gold[x] for x in part])
            kinds, where = np.unique(word, return_inverse=True)
            n = v.count[kinds]
            at = np.repeat(begin[kinds] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            # the lexicon is left out now and then, so the other features learn too
            use = ~(v.lexicon[at] & np.repeat(rng.random(len(kinds)) < 0.5, n))
            owner = np.repeat(np.arange(len(kinds)), n)[use]
            feature, scale = v.feature[at][use], (1 / np.sqrt(n)).astype(np.float32)[owner]
            emit = np.zeros((len(kinds), n_labels), np.float32)
            np.add.at(emit, owner, weights[feature] * scale[:, None])
            grid, step, chain = padded(emit[where], np.cumsum(size) - size, size)
            post, _, expected = forward_backward(grid, size, trans)
            slope = post[step, chain]
            slope[np.arange(len(y)), y] -= 1
            by_kind = np.zeros((len(kinds), n_labels), np.float32)
            np.add.at(by_kind, where, slope)
            gold_moves = np.zeros_like(trans)
            same = chain[1:] == chain[:-1]
            np.add.at(gold_moves, (y[:-1][same], y[1:][same]), 1)
            touched, inverse = np.unique(feature, return_inverse=True)
            grad = np.zeros((len(touched), n_labels), np.float32)
            np.add.at(grad, inverse, by_kind[owner] * scale[:, None])
            grad = grad / len(part) + decay * weights[touched]
            seen[touched] += grad ** 2
            weights[touched] -= rate * grad / np.sqrt(seen[touched])
            g = (expected - gold_moves) / len(part) + decay * trans
            seen_trans += g ** 2
            trans -= 0.1 * g / np.sqrt(seen_trans)
    return Model(labels, weights, trans)


def remainder(id_column, modulus: int):
    return F.crc32(id_column.cast("string").cast("binary")) % modulus


def passages_of(docs: DataFrame, learn, *, per_label: int, id_col: str, text_col: str, label_col: str):
    """The training sample: (label, a passage of consecutive words)."""
    src = docs.where(learn).select(F.col(quoted(label_col)).cast("string").alias("label"),
                                   F.col(quoted(text_col)).cast("string").alias("text"),
                                   F.col(quoted(id_col)).alias("id"))
    src = src.where("label is not null and text is not null")
    src = src.select("label", "text", F.shiftrightunsigned(F.xxhash64("id", "text", F.lit(SEED)), 1).alias("h"))
    counts = src.groupBy("label").agg(F.count("*").alias("n"), F.min("h").alias("least")).collect()
    if not counts:
        return []
    per_label = min(per_label, max(LEAST_PER_LABEL, per_label * MANY_LABELS // len(counts)))
    # a label's row of the least hash is always in
    limits = docs.sparkSession.createDataFrame(
        [(r["label"], max(r["least"], threshold(per_label, r["n"]))) for r in counts], "label string, most long")
    word = F.split("text", r"[ \t\n\r\f\x0B]+")
    picked = src.join(F.broadcast(limits), "label").where("h <= most")
    at = F.pmod(F.xxhash64("h"), F.greatest(F.lit(1), F.size("w") - PASSAGE + 1)).cast("int") + 1
    picked = picked.select("label", "h", word.alias("w")).select(
        "label", "h", F.substring(F.concat_ws(" ", F.slice("w", at, F.lit(PASSAGE))), 1, PASSAGE_CHARS).alias("text"))
    # equal rows have one hash and count once, so each label has about per_label at most
    return [(r["label"], r["text"]) for r in picked.distinct().collect()]


def threshold(per_label: int, n: int) -> int:
    """Hashes of 63 bits up to this one are per_label of n, about."""
    return (1 << 63) * min(per_label, n) // n - 1


def fit(docs: DataFrame, learn, *, per_label: int = PER_LABEL,
        id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> Model | None:
    """learn: boolean column; only its rows are learned from."""
    return train(passages_of(docs, learn, per_label=per_label, id_col=id_col, text_col=text_col, label_col=label_col))


def predict(docs: DataFrame, model: Model | None, *, runs: bool = False, id_col: str = "doc_id", text_col: str = "text",
            carry: str | None = None) -> DataFrame:
    """One row per document: lang_pred, score, and with ``runs`` the labelled
    runs of its words (lang, first word, words)."""
    packed = docs.sparkSession.sparkContext.broadcast(cloudpickle.dumps(model))
    run_type = pa.list_(pa.struct([("lang", pa.string()), ("first", pa.int64()), ("words", pa.int64())]))

    def make():
        model, rolling = pickle.loads(packed.value), Rolling(SEED)

        def fn(column):
            n = len(column)
            if model is None:
                return [pa.array([UND] * n), pa.array(np.zeros(n))] + ([pa.array([[]] * n, run_type)] if runs else [])
            v = Vocabulary(column, rolling)
            mass = np.zeros((n, len(model.labels)))
            label = np.zeros(len(v.word), np.int32)
            row_of = np.repeat(np.arange(n), np.diff(v.row))
            for word, post in model.posteriors(v):
                edge = np.flatnonzero(np.diff(row_of[word], prepend=-1))
                np.add.at(mass, row_of[word[edge]], np.add.reduceat(post * v.bytes[v.word[word]][:, None], edge, axis=0, dtype=np.float64))
                label[word] = post.argmax(1)
            best = mass.argmax(1)
            share = mass[np.arange(n), best] / np.maximum(mass.sum(1), 1e-12)
            some = pc.match_substring_regex(column, r"\p{L}").fill_null(False).to_numpy(zero_copy_only=False)
            some &= np.diff(v.row) > 0
            out = [pa.array(np.where(some, np.array(model.labels, object)[best], UND), pa.string()),
                   pa.array(np.where(some, np.clip(share, 0, 1), 0.0))]
            if runs:
                found = []
                for a, b in zip(v.row[:-1].tolist(), v.row[1:].tolist()):
                    cut = [0, *(np.flatnonzero(np.diff(label[a:b])) + 1).tolist(), b - a]
                    found.append([{"lang": model.labels[label[a + x]], "first": x, "words": y - x}
                                  for x, y in zip(cut, cut[1:]) if y > x])
                out.append(pa.array(found, run_type))
            return out
        return fn

    fields = [("lang_pred", "string"), ("score", "double")]
    if runs:
        fields.append(("runs", "array<struct<lang:string,first:bigint,words:bigint>>"))
    return map_texts(docs, make, fields, id_col=id_col, text_col=text_col, carry=carry,
                     most=(1 << 20) * MANY_LABELS // max(MANY_LABELS, len(model.labels) if model else 0) or 1)


def report(docs: DataFrame) -> DataFrame:
    """Learn from rows whose remainder isn't 0, predict all."""
    fold = remainder(F.col("doc_id"), 5)
    model = fit(docs, fold != 0)
    return predict(docs, model).select(
        "doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")
