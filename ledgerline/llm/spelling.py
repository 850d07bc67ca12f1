"""Spelling variants grouped by asymmetric q-chunks.

Words are near if one inserted, deleted or replaced code point makes them
equal. Of two near words A and B (B not the longer one), A contributes two
disjoint chunks, its halves, and B its positional grams. The one edit lies in
one half, so the other half of A is a gram of B, at the same position or, after
the edit, shifted by one if B is shorter. Of B's grams only those are joined
that fit a word of its own length or of one more: shift and length of the gram
follow from the partner's length, and the key has them. A pair is verified by
its edit distance, and counted under one key: that whose open part (what the
chunk leaves) holds the pair's first difference.

A chunk that many words share would pair them all. A key with more than
``PAIRS`` pairs therefore joins nothing: its words are cut again, within the
open part, into two chunks each, of which the edit preserves one; key by key
until no key is too large. An open part of one code point ends this by itself,
since its key has at most one word for each letter.

All steps are DataFrame functions: joins, aggregations, and a checkpoint for each
round of cutting. Counts are combined before the shuffle, so frequent words
cost no more than others.

Defined cases: null and empty texts have no words; a null id is written as
nothing before the colon; rows count as often as they occur; an empty table
has no words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .rowwise import quoted

LETTERS = "[A-Za-zÀ-ÿ]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SHORTEST = 7
LEAST = 2
FACTOR = 10
#: Pairs that one key may verify. More than an open part of one letter can have.
PAIRS = 10_000
#: A form has FACTOR times the count, so a chain of forms has at most 18 steps.
DOUBLINGS = 5


def tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = SHORTEST,
           one_in: int = 31) -> DataFrame:
    """(word) for every run of at least ``shortest`` letters, one in about
    ``one_in`` with a code point deleted. Shorter runs never make a word."""
    runs = F.regexp_extract_all(F.col(quoted(text_col)).cast("string"), F.lit(f"({LETTERS}{{{shortest},}})"), 1)
    src = docs.select(F.coalesce(F.col(quoted(id_col)).cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    src = src.select("id", F.translate("run", UPPER, LOWER).alias("run"))
    h = F.crc32(F.encode(F.concat("id", F.lit(":"), "run"), "UTF-8"))
    at = (h % F.length("run")).cast("int")
    cut = F.concat(F.col("run").substr(F.lit(1), at), F.col("run").substr(at + 2, F.length("run")))
    return src.select(F.when(h % one_in == 0, cut).otherwise(F.col("run")).alias("word"))


def vocabulary(words: DataFrame, shortest: int = SHORTEST, least: int = LEAST) -> DataFrame:
    """(word, n) of the words of at least that many code points and occurrences."""
    return words.where(F.length("word") >= shortest).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def _parts(rows: DataFrame, start: Column, stop: Column) -> DataFrame:
    """Both halves of start .. stop as the open parts of a new round's rows: the
    other half is the chunk that must be equal."""
    middle = F.floor((start + stop) / 2).cast("int")
    open_ = F.explode(F.array(F.struct(middle.alias("a"), stop.alias("b")), F.struct(start.alias("a"), middle.alias("b"))))
    rows = rows.select("word", "n", "indexed", "length", open_.alias("open")).select("word", "n", "indexed", "length", "open.*")
    # in a word that is one shorter than its partner, what follows the open part stands one earlier
    end = F.col("b") - (F.col("length") - F.length("word"))
    known = [F.col("word").substr(F.lit(1), F.col("a")), F.col("word").substr(end + 1, F.col("length"))]
    return rows.withColumn("key", F.xxhash64("length", "a", "b", *known))


def _first_round(vocabulary: DataFrame) -> DataFrame:
    """Chunks of every word, and the grams that fit a partner of its length or one more."""
    size = F.length("word")
    role = F.explode(F.array(*[F.struct(F.lit(i).alias("indexed"), (size + d).alias("length"))
                               for i, d in ((True, 0), (False, 0), (False, 1))]))
    rows = vocabulary.select("word", "n", role.alias("role")).select("word", "n", "role.*")
    return _parts(rows, F.lit(0), F.col("length"))


def _verified(rows: DataFrame) -> DataFrame:
    """(word, n, near, near_n), both ways, for the pairs under the rows' keys."""
    left = rows.where("indexed").select("key", "length", "a", "b", "word", "n")
    right = rows.where("not indexed").select("key", "length", "a", "b", F.col("word").alias("near"), F.col("n").alias("near_n"))
    one = F.levenshtein("word", "near", 1) == 1
    here = F.col("word").substr(F.lit(1), left["b"]) != F.col("near").substr(F.lit(1), left["b"])
    on = [left[c] == right[c] for c in ("key", "length", "a", "b")]
    pairs = left.join(right, [*on, one, here]).select("word", "n", "near", "near_n")
    there = F.struct("word", "n", "near", "near_n")
    back = F.struct(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    # of equally long words each one is indexed, and the pair is found from both
    both = F.when(F.length("word") == F.length("near"), F.array(there)).otherwise(F.array(there, back))
    return pairs.select(F.explode(both).alias("p")).select("p.*")


def near_pairs(vocabulary: DataFrame, pairs_per_key: int = PAIRS) -> DataFrame:
    """(word, n, near, near_n): every near word of every word, once."""
    ensure_checkpoint_dir(vocabulary.sparkSession)
    rows, found = _first_round(vocabulary), []
    while True:
        sizes = rows.groupBy("key").agg(F.count_if("indexed").alias("x"), F.count_if(~F.col("indexed")).alias("y"),
                                        F.max(F.col("b") - F.col("a")).alias("open"))
        large = sizes.where((F.col("x") * F.col("y") > pairs_per_key) & (F.col("open") > 1)).select("key").checkpoint()
        if large.isEmpty():
            found.append(_verified(rows))
            break
        found.append(_verified(rows.join(large, "key", "left_anti")))
        rows = _parts(rows.join(large, "key", "left_semi"), F.col("a"), F.col("b")).checkpoint()
    out = found[0]
    for more in found[1:]:
        out = out.unionAll(more)
    return out


def forms(vocabulary: DataFrame, pairs_per_key: int = PAIRS, factor: int = FACTOR) -> DataFrame:
    """(word, n, n_near, form, form_n) for every word."""
    best = near_pairs(vocabulary, pairs_per_key).groupBy(F.col("word").alias("near_word")).agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), F.col("near").alias("form"))).alias("best"))
    rows = vocabulary.join(best, F.col("word") == F.col("near_word"), "left")
    large = -F.col("best.minus") >= factor * F.col("n")
    return rows.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
                       F.when(large, F.col("best.form")).alias("form"), F.when(large, -F.col("best.minus")).alias("form_n"))


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", pairs_per_key: int = PAIRS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word of the texts."""
    ensure_checkpoint_dir(docs.sparkSession)
    words = vocabulary(tokens(docs, id_col, text_col)).checkpoint()
    rows = forms(words, pairs_per_key).checkpoint()
    links = rows.where("form is not null").select("word", "form")
    roots = links.select("word", F.col("form").alias("root"))
    for _ in range(DOUBLINGS):  # each doubles the steps that root stands for
        further = roots.select(F.col("word").alias("via"), F.col("root").alias("last"))
        roots = roots.join(further, F.col("root") == F.col("via"), "left").select("word", F.coalesce("last", "root").alias("root")).checkpoint()
    roots = roots.select(F.col("word").alias("rooted"), "root")
    return rows.join(roots, F.col("word") == F.col("rooted"), "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
