"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's score is a logistic function of
its hashed words and
their stems; a document's is the noisy-or of its sentences and of one leak,
1 - (1 - leak) * prod(1 - p). A sentence without a feature that the model knows
says nothing and is left out, so length alone makes no document toxic. Only
documents are labelled; the gradient of the noisy-or gives the blame to the
sentences that explain the label, so the model also tells which sentences
offend.

Training: on the driver, from a bounded sample of labelled documents: at most
about ``per_class`` of each label, chosen by a hash of the id, of at most
``SAMPLE_BYTES`` bytes each. Of a label that has fewer than ``LEAST`` among
them, its shortest documents are taken, whatever their size, up to ``LONG_BYTES``
bytes together. Only features whose share of distinct sentences differs
between the labels by ``TELLING`` standard errors get a weight; as copies of a
sentence count once, the words of a copied document don't. The model is a short list of
features and weights and is broadcast;
prediction is row-wise, without a shuffle.

Defined cases: null and empty texts have no sentence; their score is that of a
sentence without known words (low, not null); several labels of one id count as
toxic if one does; null labels and ids are not learned from; without labels of
both kinds the score is 0 everywhere.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .langid_crf import LETTERS, remainder
from .rowwise import map_texts, quoted
from .textarrays import U64, Rolling, byte_class, mix, utf8, words

PER_CLASS = 1200
SAMPLE_BYTES = 1 << 14
#: Documents of a label that are looked for among longer ones too, and their bytes.
LEAST = 50
LONG_BYTES = 16 << 20
#: Bytes of a longer word's beginning that are a feature of their own.
STEM = 5
THRESHOLD = 0.7
#: Standard errors by which a feature's share of distinct sentences must differ
#: between the labels.
TELLING = 5.0
SEED = 4
ENDS = byte_class(included=b".!?\n")


class Bags:
    """Sentences of a slice and their features. A sentence ends after . ! ? or
    a line break, or with its row; only sentences with a word count."""

    def __init__(self, column, rolling: Rolling):
        column = column.fill_null("") if column.null_count else column
        data, off = utf8(pc.utf8_lower(column))
        w = words(data, off, LETTERS)
        h = rolling.of_words(data, w)
        row = w.row_of()
        breaks = np.concatenate([[0], np.cumsum(ENDS[data])])[w.start] if len(h) else np.zeros(0, np.int64)
        new = np.ones(len(h), bool)
        new[1:] = (breaks[1:] != breaks[:-1]) | (row[1:] != row[:-1])
        self.begin = np.flatnonzero(new)                     # first words of sentences
        sentence = np.cumsum(new) - 1
        self.rows = len(column)
        self.row = np.searchsorted(row[self.begin], np.arange(self.rows + 1))  # offsets of rows' sentences
        long = np.flatnonzero(w.end - w.start > STEM)
        stem = rolling.ranges(rolling.byte[data], w.start[long], w.start[long] + STEM)
        self.feature = np.concatenate([h, mix(stem + U64(STEM))])
        self.sentence = np.concatenate([sentence, sentence[long]])
        self.start, self.end = w.start, w.end                # of words, in lower-cased bytes

    def known(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of the features among sorted keys, their sentences)."""
        if not len(keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(keys, self.feature), len(keys) - 1)
        use = keys[at] == self.feature
        return at[use], self.sentence[use]


def noisy_or(z: np.ndarray, row: np.ndarray, leak: float) -> np.ndarray:
    """1 - (1 - sigmoid(leak)) * prod(1 - sigmoid(z)) per row; a z of minus
    infinity is a sentence that says nothing."""
    total = np.concatenate([[0.0], np.cumsum(np.logaddexp(0, z))])
    return -np.expm1(-(total[row[1:]] - total[row[:-1]] + np.logaddexp(0, leak)))


def logits(weights: np.ndarray, bias: float, feature: np.ndarray, sentence: np.ndarray, n: int) -> np.ndarray:
    """Of n sentences: bias and weights of their known features, minus infinity
    without one."""
    z = bias + np.bincount(sentence, weights[feature], n)
    return np.where(np.bincount(sentence, minlength=n) > 0, z, -np.inf)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


class Model:
    def __init__(self, keys: np.ndarray, weights: np.ndarray, bias: float, leak: float):
        self.keys, self.weights, self.bias, self.leak = keys, weights, bias, leak

    def scores(self, bags: Bags) -> tuple[np.ndarray, np.ndarray]:
        """(document scores, sentence scores)."""
        z = logits(self.weights, self.bias, *bags.known(self.keys), len(bags.begin))
        return noisy_or(z, bags.row, self.leak), sigmoid(z)


def slope(w: np.ndarray, feature: np.ndarray, sentence: np.ndarray, row: np.ndarray, y: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Slope of the log loss (each document's weighed by ``share``) at w: the
    weights, the sentences' bias, the leak."""
    rows = np.repeat(np.arange(len(y)), np.diff(row))
    z = logits(w[:-2], w[-2], feature, sentence, len(rows))
    doc = np.clip(noisy_or(z, row, w[-1]), 1e-9, 1 - 1e-9)
    blame = np.where(y > 0, -(1 - doc) / doc, 1.0) * share
    s = blame[rows] * np.where(np.isfinite(z), sigmoid(z), 0.0)
    return np.append(np.bincount(feature, s[sentence], len(w) - 2), [s.sum(), blame.sum() * sigmoid(w[-1])])


def telling(bags: Bags, y: np.ndarray) -> np.ndarray:
    """Features whose share of distinct sentences differs between the labels;
    y: the label of each sentence's document."""
    n = len(bags.begin)
    code = np.zeros(n, np.uint64)
    np.add.at(code, bags.sentence, mix(bags.feature))
    _, first, of = np.unique(code, return_index=True, return_inverse=True)
    # copies with both labels are half of either
    label = (np.bincount(of, y) / np.bincount(of))[of]
    once = np.zeros(n, bool)
    once[first] = True
    use = once[bags.sentence]
    keys, number = np.unique(bags.feature[use], return_inverse=True)
    pair = np.unique(bags.sentence[use] * len(keys) + number)
    sentence, number = pair // len(keys), pair % len(keys)
    ones, total = label[first].sum(), float(len(first))
    with_ones = np.bincount(number, label[sentence], len(keys))
    both = np.bincount(number, minlength=len(keys))
    p = both / total
    difference = with_ones / max(ones, 1) - (both - with_ones) / max(total - ones, 1)
    error = np.sqrt(np.maximum(p * (1 - p), 1e-12) * (1 / max(ones, 1) + 1 / max(total - ones, 1)))
    return keys[(np.abs(difference) > TELLING * error) & (both >= 5)]


def train(sample: list[tuple[int, str]], *, rounds: int = 300, rate: float = 1.0, decay: float = 1e-5) -> Model | None:
    """sample: (label 0 or 1, text). Gradient descent, with a step size per
    weight, on the class-balanced log loss of the noisy-or."""
    sample = sorted(set(sample))
    y = np.array([label for label, _ in sample], float)
    if not 0 < y.sum() < len(y):
        return None
    bags = Bags(pa.array([t for _, t in sample], pa.string()), Rolling(SEED))
    rows = np.repeat(np.arange(len(y)), np.diff(bags.row))
    kept = telling(bags, y[rows])
    feature, sentence = bags.known(kept)
    share = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean())) / len(y)  # both labels weigh alike
    w = np.zeros(len(kept) + 2)
    w[-2:] = -4.0
    seen = np.full(len(w), 1e-8)
    for _ in range(rounds):
        g = slope(w, feature, sentence, bags.row, y, share)
        g[:-2] += decay * w[:-2]
        seen += g ** 2
        w -= rate * g / np.sqrt(seen)
    return Model(kept, w[:-2], float(w[-2]), float(w[-1]))


def longer(text: DataFrame, truth: DataFrame, label: int) -> list[tuple[int, str]]:
    """The shortest documents of a label, of any size, within LONG_BYTES."""
    sizes = text.select("id", F.octet_length("text").alias("size")).where("size > 0")
    found = sizes.join(truth.where(F.col("y") == label), "id").orderBy("size", "h", "id").select("id", "size").limit(LEAST).collect()
    total = np.cumsum([r["size"] for r in found])
    ids = [r["id"] for r, t in zip(found, total) if t <= LONG_BYTES]
    rows = text.where(F.col("id").isin(ids) & (F.octet_length("text") <= LONG_BYTES)).select("text").limit(LEAST).collect() if ids else []
    return [(label, r["text"]) for r in rows]


def fit(docs: DataFrame, labels: DataFrame, *, modulus: int | None = None, held_out: int | None = None,
        per_class: int = PER_CLASS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model | None:
    """Learn from labelled ids, without those whose remainder is held out."""
    truth = labels.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(label_col)).cast("int").alias("y"))
    truth = truth.where("id is not null and y is not null").groupBy("id").agg(F.max(F.when(F.col("y") > 0, 1).otherwise(0)).alias("y"))
    if modulus:
        truth = truth.where(remainder(F.col("id"), modulus) != held_out)
    truth = truth.withColumn("h", F.xxhash64("id", F.lit(SEED)))
    counts = {r["y"]: r["count"] for r in truth.groupBy("y").count().collect()}
    if len(counts) < 2:
        return None
    share = F.when(F.col("y") == 1, min(1.0, 1.2 * per_class / counts[1])).otherwise(min(1.0, 1.2 * per_class / counts[0]))
    chosen = truth.where(F.pmod("h", F.lit(1_000_000)) < share * 1_000_000)
    chosen = chosen.orderBy("h", "id").limit(3 * per_class)  # bounded: at most this many ids are joined
    text = docs.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).cast("string").alias("text"))
    got = text.where(F.octet_length("text") <= SAMPLE_BYTES).join(F.broadcast(chosen), "id")
    sample = [(r["y"], r["text"]) for r in got.orderBy("h", "id").select("y", "text").limit(3 * per_class).collect()]
    for label in (0, 1):
        if sum(y == label for y, _ in sample) < min(LEAST, counts[label]):
            sample += longer(text, truth, label)
    return train(sample)


def score(docs: DataFrame, model: Model | None, *, locate: bool = False, threshold: float = THRESHOLD,
          id_col: str = "doc_id", text_col: str = "text", carry: str | None = None) -> DataFrame:
    """One row per document: score, predicted, and with ``locate`` the
    sentences whose own score reaches one half (number, first words, score)."""
    packed = docs.sparkSession.sparkContext.broadcast(cloudpickle.dumps(model))
    found_type = pa.list_(pa.struct([("sentence", pa.int64()), ("score", pa.float64())]))

    def make():
        model, rolling = pickle.loads(packed.value), Rolling(SEED)

        def fn(column):
            n = len(column)
            if model is None:
                s, out = np.zeros(n), [[]] * n
            else:
                bags = Bags(column, rolling)
                s, each = model.scores(bags)
                out = [[{"sentence": k, "score": float(each[a + k])} for k in np.flatnonzero(each[a:b] >= 0.5).tolist()]
                       for a, b in zip(bags.row[:-1].tolist(), bags.row[1:].tolist())] if locate else []
            s = np.clip(s, 0, 1)
            return [pa.array(s), pa.array((s >= threshold).astype(np.int32))] + ([pa.array(out, found_type)] if locate else [])
        return fn

    fields = [("score", "double"), ("predicted", "int")]
    if locate:
        fields.append(("sentences", "array<struct<sentence:bigint,score:double>>"))
    return map_texts(docs, make, fields, id_col=id_col, text_col=text_col, carry=carry)


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn from rows whose remainder modulo 3 isn't 1, score all."""
    model = fit(docs, labels, modulus=3, held_out=1)
    held = F.coalesce(remainder(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out")
    return score(docs, model).select("doc_id", held, "score", "predicted")
