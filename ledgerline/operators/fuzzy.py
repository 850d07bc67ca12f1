"""Approximate matches of values with a table of targets.

A value matches a target that it contains, or whose characters it has at the
same places but for one at most. Neither needs a comparison of all pairs:

* one different place leaves a half of the target as it is, at its place, so
  values and targets meet in a join on (length, half, its text);
* a target that is contained has all its grams of ``GRAM`` characters in the
  value, so they meet in a join on the target's rarest gram (counted over the
  values), which keeps the common ones out; shorter targets are grams
  themselves.

The pairs that meet are verified by the rule itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAM = 3


def _plain(c: str) -> Column:
    return F.lower(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))))


def _pieces(text: Column, size) -> Column:
    """All substrings of that many characters."""
    last = F.length(text) - size + 1
    return F.when(last > 0, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substring(text, i, F.lit(size))))


def _same_places(a: Column, b: Column) -> Column:
    n = F.least(F.length(a), F.length(b))
    places = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(a, i, F.lit(1)) == F.substring(b, i, F.lit(1)))
    return F.when(n > 0, F.size(places)).otherwise(0)


def approx_join(values: DataFrame, value_col: str, targets: DataFrame, target_col: str) -> DataFrame:
    """(value, target): every pair of different texts that matches, both as
    lower-cased, trimmed texts. Blank targets match nothing."""
    v = values.select(_plain(value_col).alias("value")).distinct()
    t = targets.select(_plain(target_col).alias("target")).where("target <> ''").distinct()
    lengths = sorted(r[0] for r in t.select(F.length("target")).distinct().collect())  # not the targets, their lengths
    if not lengths:
        return v.select("value", F.lit("").alias("target")).where(F.lit(False))

    # halves: of a target of length n, places 1 .. n / 2 and the rest
    def halves(text: Column, n: Column) -> Column:
        half = F.floor(n / 2).cast("int")
        return F.explode(F.array(F.struct(F.lit(0).alias("side"), text.substr(F.lit(1), half).alias("part")),
                                 F.struct(F.lit(1).alias("side"), text.substr(half + 1, n - half).alias("part"))))
    t_halves = t.select("target", F.length("target").alias("length"), halves(F.col("target"), F.length("target")).alias("h"))
    # a value of one character less can still have all other places
    near = F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: F.length("value") >= n - 1)
    fitting = v.select("value", F.explode(near).alias("length"))
    v_halves = fitting.select("value", "length", halves(F.col("value"), F.col("length")).alias("h"))
    by_place = v_halves.join(t_halves, ["length", "h"]).where(
        _same_places(F.col("value"), F.col("target")) >= F.col("length") - 1).select("value", "target")

    sizes = [*range(1, GRAM + 1)]
    v_grams = v.select("value", F.explode(F.array_distinct(F.concat(*[F.coalesce(_pieces(F.col("value"), k), F.array().cast("array<string>"))
                                                                      for k in sizes]))).alias("gram"))
    own = F.when(F.length("target") >= GRAM, _pieces(F.col("target"), GRAM)).otherwise(F.array("target"))
    t_grams = t.select("target", F.explode(F.array_distinct(own)).alias("gram"))
    wanted = t_grams.select("gram").distinct()
    often = v_grams.join(wanted, "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("n"))
    rarest = t_grams.join(often, "gram").groupBy("target").agg(F.count("*").alias("found"), F.min_by("gram", F.struct("n", "gram")).alias("gram"))
    # a target of which a gram is in no value is contained in none
    all_grams = t_grams.groupBy("target").agg(F.count("*").alias("all"))
    rarest = rarest.join(all_grams, "target").where(F.col("found") == F.col("all")).select("target", "gram")
    by_gram = v_grams.join(rarest, "gram").where(F.col("value").contains(F.col("target"))).select("value", "target")
    return by_place.unionAll(by_gram).distinct()


def approx_matches(values: DataFrame, value_col: str, targets: DataFrame, target_col: str) -> DataFrame:
    """B9 for many targets: the rows of ``values`` with the ``target`` that
    they match, a row for each."""
    pairs = approx_join(values, value_col, targets, target_col)
    return values.join(pairs, _plain(value_col) == F.col("value")).select(*[values[c] for c in values.columns], "target")
