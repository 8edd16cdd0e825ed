"""Measurements: rates with intervals, quantiles, thresholds, agreement, splits, samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilworks.operators.running import running

Z = 1.96


def wilson(k: Column, n: Column) -> tuple[Column, Column]:
    """The bounds of the 95 per cent score interval of k in n, in per cent (A1); 0 and 0 without trials."""
    p, d = k / n, 1 + Z * Z / n
    mid, half = (p + Z * Z / (2 * n)) / d, Z * F.sqrt(p * (1 - p) / n + Z * Z / (4 * n * n)) / d
    return F.when(n == 0, 0.0).otherwise(F.greatest(F.lit(0.0), 100 * (mid - half))), F.when(n == 0, 0.0).otherwise(F.least(F.lit(100.0), 100 * (mid + half)))


def rates(rows: DataFrame, by: list[str], hit: Column) -> DataFrame:
    """by, k, n, rate, low, high of the rows of each group that are hits (A3, A5)."""
    of = rows.groupBy(*by).agg(F.count_if(hit).alias("k"), F.count(F.lit(1)).alias("n"))
    low, high = wilson(F.col("k"), F.col("n"))
    return of.select(*by, "k", "n", F.round(100 * F.col("k") / F.col("n"), 6).alias("rate"), F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


def nearest_rank(rows: DataFrame, by: list[str], value: str, q: float, inner: bool = False) -> DataFrame:
    """by, q, quantile (A2): the value at place floor(q n), or floor(q (n - 1)) with inner, of the ascending values.

    Values are counted first, so a group's window holds its distinct values.
    """
    counted = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("c"))
    up, all_ = Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*by)
    placed = counted.withColumns({"upto": F.sum("c").over(up), "n": F.sum("c").over(all_)})
    at = F.floor(q * (F.col("n") - 1)) if inner else F.least(F.col("n") - 1, F.floor(q * F.col("n")))
    return placed.where((at < F.col("upto")) & (at >= F.col("upto") - F.col("c"))).select(*by, F.lit(q).alias("q"), F.col(value).alias("quantile"))


def half(key: Column) -> Column:
    """0 or 1, by the parity of the key's SHA-256 (A10)."""
    return F.pmod(F.conv(F.substring(F.sha2(key.cast("string"), 256), 64, 1), 16, 10).cast("int"), F.lit(2))


def share(key: Column) -> Column:
    """train, dev or test (80, 10, 10), by the key's SHA-256 modulo 100."""
    digest = F.sha2(key.cast("string"), 256)
    rest = F.aggregate(F.sequence(F.lit(1), F.lit(64)), F.lit(0).cast("bigint"), lambda a, i: F.pmod(a * 16 + F.conv(F.substring(digest, i, F.lit(1)), 16, 10).cast("bigint"), F.lit(100)))
    return F.when(rest < 80, "train").when(rest < 90, "dev").otherwise("test")


def capped(rows: DataFrame, by: list[str], key: str, size: str, cap: int, seed: str) -> DataFrame:
    """The rows of each group that come, in an order drawn by seed, before their sizes reach the cap (A12). A group of any size is summed by many tasks."""
    order = F.sha2(F.concat_ws(":", F.lit(seed), *[F.col(b).cast("string") for b in by], F.col(key).cast("string")), 256)
    summed = running(rows.withColumn("__order", order), by, ["__order", key], size)
    return summed.where(F.col("running") - F.coalesce(F.col(size), F.lit(0)) < cap).drop("running", "__order")


def first_copies(rows: DataFrame, by: str, key: str, text: str, least: int = 4) -> DataFrame:
    """(by, key): the first row of each text within each group, blanks around it aside, of those of `least` characters or more."""
    said = F.trim(text)
    return rows.where(F.length(said) >= least).groupBy(by, F.sha2(said, 256).alias("sha")).agg(F.min(key).alias(key)).select(by, key)


def numbered(rows: DataFrame, by: str, key: str) -> DataFrame:
    """(by, key, uid): rows numbered from 1 within each group by key (A13), which names a row; a group of any size is numbered by many tasks."""
    return running(rows.select(by, key, F.lit(1).alias("__one")), [by], [key], "__one").select(by, key, F.col("running").alias("uid"))


def disagreements(pairs: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """(key, verdict): rows that two judges label differently, and those that one of them or both left out, `missing`."""
    missing = F.col(a).isNull() | F.col(b).isNull()
    return pairs.where(missing | (F.col(a) != F.col(b))).select(key, F.when(missing, "missing").otherwise("differs").alias("verdict"))


def chosen(runs: DataFrame, config: str, score: str, size: str, floor: Column) -> DataFrame:
    """(config, mean, sd, size, differs) of the best configuration (A17): of those whose runs all meet `floor`, that of the highest mean, of equal ones the smaller and then the first by name; and whether it differs from the next, by more than twice the larger deviation.

    A row for each configuration is ranked. Without a second one, differs is null.
    """
    of = runs.groupBy(config).agg(F.round(F.avg(score), 9).alias("mean"), F.round(F.stddev_samp(score), 9).alias("sd"), F.max(size).alias("size"), F.bool_and(F.coalesce(floor, F.lit(False))).alias("__fit")).where("__fit")
    order = Window.orderBy(F.desc("mean"), "size", config)
    second = lambda c: F.lead(c).over(order)
    apart = F.abs(F.col("mean") - second("mean")) > 2 * F.greatest(F.col("sd"), second("sd"))
    return of.withColumns({"differs": apart, "__r": F.row_number().over(order)}).where("__r = 1").select(config, "mean", "sd", "size", "differs")


def overlap(rows: DataFrame, other: DataFrame, text: str = "text") -> DataFrame:
    """rows whose text, white space collapsed, is one of other's (A14, J7): found by a hash, confirmed by the text."""
    flat = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    known = other.select(flat(F.col(text)).alias("__t")).where(F.col("__t") != "").distinct().withColumn("__h", F.xxhash64("__t"))
    own = rows.withColumns({"__t": flat(F.col(text))}).withColumn("__h", F.xxhash64("__t"))
    return own.join(known, ["__h", "__t"], "left_semi").drop("__h", "__t")


def kappa(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """(n, agree, kappa): Cohen's kappa of two labels (A16); 1 where chance alone agrees."""
    joint = pairs.groupBy(a, b).agg(F.count(F.lit(1)).alias("c"))
    side = lambda c: joint.groupBy(F.col(c).alias("label")).agg(F.sum("c").alias(f"n_{c}"))
    chance = side(a).join(side(b), "label").agg(F.coalesce(F.sum(F.col(f"n_{a}") * F.col(f"n_{b}")), F.lit(0)).alias("both"))
    seen = joint.agg(F.sum("c").alias("n"), F.coalesce(F.sum(F.when(F.col(a) == F.col(b), F.col("c"))), F.lit(0)).alias("same"))
    # One row each.
    both = seen.join(F.broadcast(chance), F.lit(True))
    p, e = F.col("same") / F.col("n"), F.col("both") / (F.col("n") * F.col("n"))
    return both.select("n", F.round(p, 9).alias("agree"), F.round(F.when(e == 1, 1.0).otherwise((p - e) / (1 - e)), 9).alias("kappa"))


def thresholds(rows: DataFrame, by: str, score: str, alpha: float) -> DataFrame:
    """(by, threshold): the benign score at place ceil((1 - alpha) n), or just above the highest.

    Scores are counted first, so a group's window holds its distinct scores.
    """
    counted = rows.where(F.col(score).isNotNull()).groupBy(by, score).agg(F.count(F.lit(1)).alias("c"))
    up, all_ = Window.partitionBy(by).orderBy(score).rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(by)
    placed = counted.withColumns({"upto": F.sum("c").over(up), "n": F.sum("c").over(all_), "most": F.max(score).over(all_)})
    k = F.ceil((1 - alpha) * F.col("n"))
    found = placed.where(F.when(k >= F.col("n"), F.col("upto") == F.col("n")).otherwise((k < F.col("upto")) & (k >= F.col("upto") - F.col("c"))))
    return found.select(by, F.when(k >= F.col("n"), F.col("most") + 1e-6).otherwise(F.col(score)).alias("threshold"))


def precision_recall(k: Column, n: Column) -> Column:
    """k / n, 1 without trials."""
    return F.when(n == 0, 1.0).otherwise(k / n)
