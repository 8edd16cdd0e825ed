"""Mixing sources to target weights: temperature by bisection, then budgeted block permutations. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilworks.llm.common import cut, let, table

#: A plan of more rows than this is joined by a shuffle, not broadcast (about 100 bytes a row).
BROADCAST_ROWS = 200_000
#: Parts into which the documents of a source are hashed; a source's budget is met to within half a part.
BLOCKS = 1024
STEPS = 60


def tokens_of(text: Column) -> Column:
    """Words of a text; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x09-\x0D\x20]+")), F.lit(0)).cast("long")


def number_from(*parts: Column) -> Column:
    """A number below 2**60 that depends on the parts only: the head of an MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("-")) for p in parts])), 1, 15), 16, 10).cast("long")


def source_key(source: Column) -> Column:
    """A null source is a source of its own."""
    return F.when(source.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), source.cast("string")))


def powers(shares: Column, alpha: Column) -> Column:
    """shares ** alpha, normalised."""
    raised = F.transform(shares, lambda p: F.pow(p, alpha))
    return let(raised, lambda r: let(F.aggregate(r, F.lit(0.0), lambda a, x: a + x), lambda total: F.transform(r, lambda x: x / total)))


def entropy(weights: Column) -> Column:
    return F.aggregate(weights, F.lit(0.0), lambda a, w: a - F.when(w > 0, w * F.ln(w)).otherwise(F.lit(0.0)))


def most_repeats(shares: Column, weights: Column, keep_all: bool, budget_share: Column) -> Column:
    """Epochs of the most repeated source. keep_all: the least repeated has one; else the budget is budget_share of the corpus."""
    epochs = F.transform(F.arrays_zip(shares.alias("p"), weights.alias("w")), lambda z: z["w"] / z["p"])
    return F.array_max(epochs) / F.array_min(epochs) if keep_all else F.array_max(epochs) * budget_share


def exponent(shares: Column, target_entropy: float | None, repeat_limit: float | None, keep_all: bool, budget_share: Column) -> Column:
    """The exponent in [0, 1]: by entropy the largest whose weights have that share of the greatest entropy; by repetition the least that keeps the limit."""
    start = F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"))

    def halve(s: Column, _: Column) -> Column:
        mid = (s.lo + s.hi) / 2
        up, down = F.struct(mid.alias("lo"), s.hi.alias("hi")), F.struct(s.lo.alias("lo"), mid.alias("hi"))
        weights = powers(shares, mid)
        if target_entropy is not None:
            return F.when(entropy(weights) >= F.ln(F.size(shares)) * target_entropy, up).otherwise(down)
        return F.when(most_repeats(shares, weights, keep_all, budget_share) > F.lit(float(repeat_limit)), up).otherwise(down)

    return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, halve, lambda s: s.lo if target_entropy is not None else s.hi)


def source_weights(blocks: DataFrame, *, target_entropy: float | None, repeat_limit: float | None, budget: int | None) -> DataFrame:
    """A row for each source with tokens: key, tokens, alpha, weight, goal (tokens to spend). The sources, not their documents, meet in one row."""
    totals = blocks.groupBy("key").agg(F.sum("tokens").alias("tokens")).where("tokens > 0")
    one = totals.agg(F.sort_array(F.collect_list(F.struct("key", "tokens"))).alias("s"), F.sum("tokens").alias("total"))
    one = one.withColumn("shares", F.transform("s", lambda s: s["tokens"] / F.col("total")))
    share = F.lit(float(budget or 0)) / F.col("total")
    one = one.withColumn("alpha", exponent(F.col("shares"), target_entropy, repeat_limit, budget is None, share))
    one = one.withColumn("weights", powers(F.col("shares"), F.col("alpha")))
    spend = F.lit(float(budget)) if budget is not None else F.array_max(F.transform(F.arrays_zip("s", "weights"), lambda z: z["s"]["tokens"] / z["weights"]))
    one = one.withColumn("spend", spend)
    each = one.select("alpha", "spend", F.explode(F.arrays_zip("s", "weights")).alias("z"))
    return each.select(F.col("z.s.key").alias("key"), F.col("z.s.tokens").alias("of"), "alpha", F.col("z.weights").alias("weight"), F.round(F.col("spend") * F.col("z.weights")).cast("long").alias("goal"))


def block_plan(docs: DataFrame, seed: int, **targets) -> DataFrame:
    """docs (key, block, tokens) -> a row for each block and epoch it is spent in: key, block, epoch, block_rank, alpha, weight.

    In each epoch the blocks of a source are permuted; full epochs take all, the last those whose
    middle lies within what is left of the budget. Blocks of sources without tokens cost nothing and
    are spent once.
    """
    blocks = cut(docs.groupBy("key", "block").agg(F.sum("tokens").alias("tokens")))
    each = blocks.join(source_weights(blocks, **targets), "key", "left")
    full, rest = F.call_function("div", F.col("goal"), F.col("of")), F.pmod("goal", "of")
    each = each.withColumns({"full": F.when(F.col("of").isNull(), F.lit(1)).otherwise(full), "rest": F.coalesce(rest, F.lit(0))})
    order = number_from(F.lit(seed), F.col("full") + 1, F.col("key"), F.col("block"))
    in_last = Window.partitionBy("key").orderBy(order, "block").rowsBetween(Window.unboundedPreceding, -1)
    each = each.withColumn("before", F.coalesce(F.sum("tokens").over(in_last), F.lit(0)))
    epochs = F.col("full") + F.when((F.col("rest") > 0) & (2 * F.col("before") + F.col("tokens") < 2 * F.col("rest")), 1).otherwise(0)
    spent = each.withColumn("n", epochs).where("n > 0").withColumn("epoch", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    ranked = Window.partitionBy("key", "epoch").orderBy(number_from(F.lit(seed), F.col("epoch"), F.col("key"), F.col("block")), "block")
    return spent.select("key", "block", "epoch", F.row_number().over(ranked).alias("block_rank"), "alpha", "weight")


def mix(df: DataFrame, *, key: str = "doc_id", source: str = "source", text: str = "text", seed: int = 4, target_entropy: float | None = None, repeat_limit: float | None = 2.0, budget: int | None = None) -> DataFrame:
    """df's rows, each as often as its source's weight asks, with columns mix_epoch, mix_block, mix_block_rank, mix_weight and mix_alpha.

    Weights are the sources' shares of all words raised to an exponent in [0, 1] and normalised; the
    exponent meets target_entropy (a share of the greatest entropy), if given, or keeps every source
    within repeat_limit epochs. budget is the number of words to spend; without one it is the least
    that spends every document at least once. Within a source the budget is met to half a block
    (1/1024 of its documents). Null sources form a source; null keys share a block; empty texts cost
    nothing; repeated rows go to the same block, and are spent as often as they are there; an empty
    table stays empty. Columns of those names in df are replaced.
    """
    own = ["mix_epoch", "mix_block", "mix_block_rank", "mix_weight", "mix_alpha"]
    keyed = df.drop(*own).withColumns({"__mix_key": source_key(F.col(source)), "mix_block": F.pmod(number_from(F.lit(seed), F.col(key)), F.lit(BLOCKS)).cast("int")})
    plan = cut(block_plan(keyed.select(F.col("__mix_key").alias("key"), F.col("mix_block").alias("block"), tokens_of(F.col(text)).alias("tokens")), seed, target_entropy=target_entropy, repeat_limit=repeat_limit, budget=budget))
    plan = plan.select(F.col("key").alias("__mix_key"), F.col("block").alias("mix_block"), F.col("epoch").cast("int").alias("mix_epoch"), F.col("block_rank").alias("mix_block_rank"), F.col("weight").alias("mix_weight"), F.col("alpha").alias("mix_alpha"))
    if plan.count() <= BROADCAST_ROWS:
        plan = F.broadcast(plan)
    return keyed.join(plan, ["__mix_key", "mix_block"]).drop("__mix_key")


def op4_temperature_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed with at most two epochs of any source and at least one of each."""
    mixed = mix(table(spark, sf_dir, "documents"))
    within = Window.partitionBy("source", "mix_epoch", "mix_block").orderBy(number_from(F.col("mix_epoch"), F.col("doc_id")), "doc_id")
    return mixed.select(
        "doc_id", "source", F.round("mix_weight", 9).alias("weight"), F.round("mix_alpha", 9).alias("alpha"), F.col("mix_epoch").alias("epoch"), F.col("mix_block").alias("block"),
        F.col("mix_block_rank").alias("block_rank"), F.row_number().over(within).alias("slot"),
    )


OP4_SQL = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, source, CASE WHEN source IS NULL THEN '-' ELSE '+' || source END AS key,
    CAST(('0x' || substr(md5('4:' || coalesce(CAST(doc_id AS VARCHAR), '-')), 1, 15)) AS BIGINT) % 1024 AS block,
    coalesce(len(regexp_extract_all(text, '[^\x09-\x0D\x20]+')), 0) AS tokens
  FROM documents),
blocks AS (SELECT key, block, CAST(sum(tokens) AS BIGINT) AS tokens FROM docs GROUP BY ALL),
totals AS (SELECT key, CAST(sum(tokens) AS BIGINT) AS tokens FROM blocks GROUP BY key HAVING sum(tokens) > 0),
shares AS (SELECT key, tokens, tokens / (SELECT sum(tokens) FROM totals) AS p FROM totals),
halving AS (
  SELECT 0 AS step, CAST(0 AS DOUBLE) AS lo, CAST(1 AS DOUBLE) AS hi
  UNION ALL
  SELECT step + 1,
    CASE WHEN (SELECT max(pow(p, (lo + hi) / 2) / p) / min(pow(p, (lo + hi) / 2) / p) FROM shares) > 2 THEN (lo + hi) / 2 ELSE lo END,
    CASE WHEN (SELECT max(pow(p, (lo + hi) / 2) / p) / min(pow(p, (lo + hi) / 2) / p) FROM shares) > 2 THEN hi ELSE (lo + hi) / 2 END
  FROM halving WHERE step < 60),
chosen AS (SELECT hi AS alpha FROM halving WHERE step = 60),
weights AS (SELECT key, tokens, alpha, pow(p, alpha) / sum(pow(p, alpha)) OVER () AS weight FROM shares, chosen),
goals AS (SELECT key, tokens AS total, alpha, weight, CAST(round((SELECT max(tokens / weight) FROM weights) * weight) AS BIGINT) AS goal FROM weights),
filled AS (
  SELECT b.key, b.block, b.tokens, alpha, weight, coalesce(goal // total, 1) AS whole, coalesce(goal % total, 0) AS rest
  FROM blocks b LEFT JOIN goals g ON b.key = g.key),
ordered AS (
  SELECT *, coalesce(sum(tokens) OVER (PARTITION BY key ORDER BY CAST(('0x' || substr(md5('4:' || (whole + 1) || ':' || key || ':' || block), 1, 15)) AS BIGINT), block
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM filled),
spent AS (
  SELECT key, block, alpha, weight, unnest(range(1, 1 + whole + CASE WHEN rest > 0 AND 2 * before + tokens < 2 * rest THEN 1 ELSE 0 END)) AS epoch FROM ordered),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY key, epoch ORDER BY CAST(('0x' || substr(md5('4:' || epoch || ':' || key || ':' || block), 1, 15)) AS BIGINT), block) AS block_rank
  FROM spent)
SELECT d.doc_id, d.source, round(r.weight, 9) AS weight, round(r.alpha, 9) AS alpha, CAST(r.epoch AS INTEGER) AS epoch, CAST(d.block AS INTEGER) AS block, CAST(r.block_rank AS INTEGER) AS block_rank,
  CAST(row_number() OVER (PARTITION BY d.source, r.epoch, d.block ORDER BY CAST(('0x' || substr(md5(r.epoch || ':' || coalesce(CAST(d.doc_id AS VARCHAR), '-')), 1, 15)) AS BIGINT), d.doc_id) AS INTEGER) AS slot
FROM docs d JOIN ranked r ON d.key = r.key AND d.block = r.block
"""
