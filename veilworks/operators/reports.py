"""Measurements over verdicts, samples, pairs and requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rule_verdicts(samples: DataFrame, spans: DataFrame) -> DataFrame:
    """(doc_id, own, blocked, other): whether each sample (doc_id, own) is caught (A4). One that is to be caught counts only by its own type, one that isn't (own is null) by any."""
    types = spans.groupBy("doc_id").agg(F.collect_set("type").alias("types"))
    both = samples.join(types, "doc_id", "left").withColumn("types", F.coalesce("types", F.array().cast("array<string>")))
    hit = F.when(F.col("own").isNull(), F.size("types") > 0).otherwise(F.array_contains("types", F.col("own")))
    return both.select("doc_id", "own", hit.alias("blocked"), (F.col("own").isNotNull() & ~hit & (F.size("types") > 0)).alias("other"))


def flips(pairs: DataFrame) -> DataFrame:
    """(axis, n, flipped, added, flip_rate) of pairs (axis, before, after) of verdicts (A9): how many change, and how many are new."""
    changed, new = F.count_if(F.col("before") != F.col("after")), F.count_if(~F.col("before") & F.col("after"))
    return pairs.groupBy("axis").agg(F.count(F.lit(1)).alias("n"), changed.alias("flipped"), new.alias("added"), F.round(changed / F.count(F.lit(1)), 9).alias("flip_rate"))


def criteria(rates: DataFrame, wanted: DataFrame, on: str) -> DataFrame:
    """rates (on, rate) against wanted (on, least, most) (A8): a row for each, whether it holds, and whether all do. What wasn't measured doesn't hold."""
    each = wanted.join(rates, on, "left").withColumn("holds", F.coalesce(F.col("rate").between(F.col("least"), F.col("most")), F.lit(False)))
    all_ = each.agg(F.bool_and("holds").alias("all_hold"))
    return each.select(on, "rate", "holds").crossJoin(F.broadcast(all_))  # one row


def poisson_weight(key: Column, replicate: Column, seed: str) -> Column:
    """How often a row is drawn in one bootstrap replicate (A22): Poisson with mean 1, from a hash of row and replicate, so that no row moves and a replicate can be told again."""
    u = F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(seed), replicate.cast("string"), key.cast("string")), 256), 1, 12), 16, 10).cast("double") / float(1 << 48)
    # Distribution function of Poisson(1) at 0 to 7.
    below = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119, 0.9999897508033253)
    return sum(((u >= p).cast("int") for p in below), F.lit(0))


def bootstrap(rows: DataFrame, key: str, hit: Column, replicates: int, seed: str) -> DataFrame:
    """(replicate, n, rate) of each replicate: one pass, pre-aggregated."""
    each = rows.select(F.col(key).alias("k"), hit.cast("int").alias("hit")).withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    w = each.withColumn("w", poisson_weight(F.col("k"), F.col("replicate"), seed)).where("w > 0")
    return w.groupBy("replicate").agg(F.sum("w").alias("n"), F.round(F.sum(F.col("w") * F.col("hit")) / F.sum("w"), 9).alias("rate"))


def multiset_scores(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """(type, matched, predicted, gold, precision, recall) of spans by (doc_id, type, value), each as often as it is there on both sides (A26, A35, J10); 1 where there was nothing to find."""
    key = ["doc_id", "type", "value"]
    p, g = (x.groupBy(*key).agg(F.count(F.lit(1)).alias(n)) for x, n in ((predicted, "p"), (gold, "g")))
    both = p.join(g, key, "full_outer").fillna(0, ["p", "g"])
    out = both.groupBy("type").agg(F.sum(F.least("p", "g")).alias("matched"), F.sum("p").alias("predicted"), F.sum("g").alias("gold"))
    share = lambda n: F.when(F.col(n) == 0, 1.0).otherwise(F.round(F.col("matched") / F.col(n), 9))
    return out.withColumns({"precision": share("predicted"), "recall": share("gold")})


def regrouped(rows: DataFrame, request: str, kinds: list[str]) -> DataFrame:
    """One record a request (A31) of rows (request, kind, at, id, value): for each kind how many rows, and the last one's value."""
    of = [c for k in kinds for c in (F.count_if(F.col("kind") == k).alias(f"n_{k}"), F.max_by("value", F.when(F.col("kind") == k, F.struct("at", "id"))).alias(f"last_{k}"))]
    return rows.groupBy(request).agg(F.min("at").alias("since"), *of)


def waits(rows: DataFrame, by: str, at: str, id_: str) -> DataFrame:
    """rows with `seconds` since the row before of the same `by` (A34); the first of each has none."""
    order = Window.partitionBy(by).orderBy(at, id_)
    return rows.withColumn("seconds", F.unix_micros(F.col(at).cast("timestamp")) / 1e6 - F.unix_micros(F.lag(F.col(at).cast("timestamp")).over(order)) / 1e6).where(F.col("seconds").isNotNull())


def swept(scores: DataFrame, score: str, hit: Column, grid: list[float]) -> DataFrame:
    """(threshold, n, caught, wrong) for each threshold of a grid (A36): one pass, pre-aggregated."""
    each = scores.select(F.col(score).alias("s"), hit.alias("hit")).withColumn("threshold", F.explode(F.array(*map(F.lit, grid))))
    over = F.col("s") >= F.col("threshold")
    return each.groupBy("threshold").agg(F.count(F.lit(1)).alias("n"), F.count_if(over & F.col("hit")).alias("caught"), F.count_if(over & ~F.col("hit")).alias("wrong"))


def masked_persons(docs: DataFrame, spans: DataFrame, mark: str = "OOO") -> DataFrame:
    """(doc_id, text): spans replaced by a mark (P11); of spans that overlap, the first, and of those the longest."""
    spots = spans.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("cs", (-F.col("ce")).alias("end")))).alias("spots"))
    cursor = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    done = docs.join(spots, "doc_id", "left").withColumn("spots", F.coalesce("spots", F.array().cast("array<struct<cs:int,end:int>>")))
    step = lambda a, s: F.when(s.cs < a.at, a).otherwise(F.struct(F.concat(a.out, F.substring(F.col("text"), a.at + 1, s.cs - a.at), F.lit(mark)).alias("out"), (-s.end).alias("at")))
    folded = done.withColumn("f", F.aggregate("spots", cursor, step))
    return folded.select("doc_id", F.concat("f.out", F.substring(F.col("text"), F.col("f.at") + 1, F.length("text"))).alias("text"))
