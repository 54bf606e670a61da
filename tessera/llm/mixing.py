"""Mixing sources: temperature weights for a target, realised as block permutations under a budget."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scratch import materialize, packed, settled

GRID = 2**20  # the exponent is a multiple of 1 / GRID
POINTS = 15  # exponents that one pass over the sources' totals evaluates: four bisections
BUCKET_DOCS = 4096  # documents ordered together, about
BLOCK_TOKENS = 1 << 20
BROADCAST_SOURCES = 50_000  # a plan of more sources is joined by shuffling

WORDS = r"[^\x20\x09-\x0D]+"


def token_count() -> Column:
    """Words of text; null and empty texts have none."""
    return F.regexp_count(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(WORDS)).cast("long")


def _draw(seed: int, number: Column) -> Column:
    """The place of a document in the permutation of a pass: 60 bits of md5, the same in any engine."""
    name = F.concat_ws(":", F.lit(seed), number, F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(name), 1, 15), 16, 10).cast("long")


def find_exponent(totals: DataFrame, max_repeats: float | None, target_entropy: float | None) -> float:
    """The exponent in [0, 1] for the token shares of totals (tokens), by bisection.

    max_repeats: the smallest exponent (the flattest mix) at which no source is passed over more
    than so many times while another is passed over once. target_entropy: the largest exponent (the
    mix nearest to the sources' own shares) whose weights have that entropy in nats; 0 if none has.
    Repeats and entropy are monotone in the exponent. Each pass evaluates POINTS exponents as one
    row of aggregates, which is all that reaches the driver.
    """
    t = F.col("tokens").cast("double")
    exponent = (lambda j: j / GRID) if target_entropy is None else (lambda j: (GRID - j) / GRID)
    low, high = 0, GRID  # the first j that meets the target is in here
    while low < high:
        points = sorted({low + (high - low) * k // (POINTS + 1) for k in range(POINTS + 1)})
        values = []
        for k, j in enumerate(points):
            a = exponent(j)
            w, passes = F.pow(t, F.lit(a)), F.pow(t, F.lit(a - 1))
            values += [F.sum(w).alias(f"z{k}"), F.sum(w * F.log(t)).alias(f"e{k}"), (F.max(passes) / F.min(passes)).alias(f"r{k}")]
        row = totals.where("tokens > 0").agg(*values).first()
        if row["z0"] is None:
            return 1.0
        for k, j in enumerate(points):
            if target_entropy is None:
                meets = row[f"r{k}"] <= max_repeats
            else:
                meets = math.log(row[f"z{k}"]) - exponent(j) * row[f"e{k}"] / row[f"z{k}"] >= target_entropy
            if meets:
                high = j
                break
            low = j + 1
    return exponent(high)


def source_plan(counted: DataFrame, max_repeats: float | None, target_entropy: float | None, budget: int | None) -> DataFrame:
    """For each source of counted (source, tokens): tokens, n_docs, weight, budget, full passes, and
    the tokens of a partial pass (rest). Without a budget: the least at which each source is passed
    over once. A source without tokens has weight 0 and one full pass, which costs nothing."""
    totals = materialize(counted.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n_docs")), "totals")
    alpha = find_exponent(totals, max_repeats, target_entropy)
    power = F.when(F.col("tokens") > 0, F.pow(F.col("tokens").cast("double"), F.lit(alpha))).otherwise(F.lit(0.0))
    z, scale = totals.agg(F.sum(power), F.max(F.col("tokens") / F.when(power > 0, power))).first()
    z, scale = z or 1.0, (budget / z if budget is not None and z else scale or 0.0)
    share = F.round(power * F.lit(scale)).cast("long")
    return materialize(
        totals.select(
            "source",
            "tokens",
            "n_docs",
            (power / F.lit(z)).alias("weight"),
            share.alias("budget"),
            F.when(F.col("tokens") > 0, F.floor(share / F.col("tokens"))).otherwise(F.lit(1)).cast("long").alias("full"),
            F.when(F.col("tokens") > 0, share % F.col("tokens")).otherwise(F.lit(0)).cast("long").alias("rest"),
        ),
        "plan",
    )


def _with_plan(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """docs joined to their source's plan; a plan of few sources is broadcast, after counting it."""
    plan = plan.select(F.col("source").alias("_source"), *[F.col(c).alias(f"_{c}") for c in plan.columns if c != "source"])
    few = plan.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    return docs.join(F.broadcast(plan) if few else plan, F.col("source").eqNullSafe(F.col("_source")))


def _passes(counted: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    """A row for each doc_id of a source and pass: tokens, the tokens before it in that pass's permutation,
    and chosen.

    Rows that share a doc_id (null is one) have one draw and one fate, and are one row here, added up
    before they meet, however many they are. A permutation is the order of draws. It is dealt to buckets by
    draw, some thousand documents each, so a source with a third of all rows is many buckets; sums of
    whole buckets are added up first, then the documents of a bucket.
    """
    number = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_full") - 1 + (F.col("_rest") > 0).cast("long")))
    some = (F.col("_full") > 0) | (F.col("_rest") > 0)
    keyed = counted.groupBy("source", "doc_id").agg(F.sum("tokens").alias("tokens"))
    rows = _with_plan(keyed, plan).where(some).withColumn("pass", number).withColumn("draw", _draw(seed, F.col("pass")))
    buckets = F.floor(F.col("_n_docs") / BUCKET_DOCS) + 1
    rows = rows.withColumn("bucket", F.floor(F.col("draw").cast("double") / float(1 << 60) * buckets))
    sums = rows.groupBy("source", "pass", "bucket").agg(F.sum("tokens").alias("sum"))
    ahead = W.partitionBy("source", "pass").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("s"), F.col("pass").alias("p"), F.col("bucket").alias("b"), F.coalesce(F.sum("sum").over(ahead), F.lit(0)).alias("ahead"))
    within = W.partitionBy("source", "pass", "bucket").orderBy("draw").rangeBetween(W.unboundedPreceding, -1)
    rows = rows.join(sums, F.col("source").eqNullSafe(F.col("s")) & (F.col("pass") == F.col("p")) & (F.col("bucket") == F.col("b")))
    before = F.col("ahead") + F.coalesce(F.sum("tokens").over(within), F.lit(0))
    return rows.withColumn("before", before).withColumn("chosen", (F.col("pass") < F.col("_full")) | (F.col("before") < F.col("_rest")))


def _counted(docs: DataFrame) -> DataFrame:
    return materialize(docs.select("doc_id", F.col("source").cast("string").alias("source"), token_count().alias("tokens")), "counted")


@settled
def mix_schedule(
    docs: DataFrame, max_repeats: float | None = 2.0, target_entropy: float | None = None, budget: int | None = None, seed: int = 1
) -> DataFrame:
    """The mix as rows: doc_id, source, pass, block, draw, tokens for each time a row of docs
    (doc_id, text, source; others are ignored) is used.

    Weights are the sources' token shares raised to the exponent that meets the target, normalised.
    A source's budget buys full passes over its documents, each in an order of its own, and the
    beginning of one more. All passes of a source are laid out evenly over the blocks of about
    BLOCK_TOKENS tokens, so that each block has the weights of the whole; within a block, documents
    follow by draw. Null sources are one source; null and empty texts have no tokens and are used
    once a pass; rows that share an id within a source are used alike. Empty table: no rows.
    """
    counted = _counted(docs)
    plan = source_plan(counted, max_repeats, target_entropy, budget)
    blocks = F.greatest(F.ceil(F.lit((plan.agg(F.sum("budget")).first()[0] or 0) / BLOCK_TOKENS)), F.lit(1))
    at = (F.col("pass") * F.col("_tokens") + F.col("before")).cast("double") / F.greatest("_budget", F.lit(1)).cast("double")
    block = F.least(F.floor(at * blocks), blocks - 1).cast("long")
    chosen = _passes(counted, plan, seed).where("chosen").select(F.col("doc_id").alias("d"), F.col("source").alias("s"), "pass", block.alias("block"), "draw")
    same = F.col("doc_id").eqNullSafe(F.col("d")) & F.col("source").eqNullSafe(F.col("s"))
    return counted.join(chosen, same).select("doc_id", "source", "pass", "block", "draw", "tokens")


@settled
def _cuts(docs: DataFrame, max_repeats: float | None, target_entropy: float | None, budget: int | None, seed: int) -> DataFrame:
    """The plan with cut: the last draw that a source's partial pass takes."""
    counted = _counted(docs)
    plan = source_plan(counted, max_repeats, target_entropy, budget)
    cuts = _passes(counted, plan, seed).where(F.col("pass") == F.col("_full")).where("chosen")
    cuts = cuts.groupBy("source").agg(F.max("draw").alias("cut"))
    return plan.join(cuts.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left").drop("s")


def mix_sources(
    docs: DataFrame, max_repeats: float | None = 2.0, target_entropy: float | None = None, budget: int | None = None, seed: int = 1
) -> DataFrame:
    """docs with each row as often as mix_schedule uses it. The schedule's cut in each source's last
    pass is a draw, so the rows themselves are never shuffled: each looks up its source's plan."""
    plan = _cuts(docs, max_repeats, target_entropy, budget, seed)
    times = F.col("_full") + F.coalesce(_draw(seed, F.col("_full")) <= F.col("_cut"), F.lit(False)).cast("long")
    rows = packed(docs).select("row", F.col("row.doc_id").alias("doc_id"), F.col("row.source").cast("string").alias("source"))
    rows = _with_plan(rows, plan).where(times > 0)
    return rows.select("row", F.explode(F.sequence(F.lit(1).cast("long"), times))).select("row.*")


ORACLE_SQL = rf"""
    WITH RECURSIVE counted AS (
        SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORDS}'))::BIGINT AS tokens FROM documents),
    totals AS (SELECT source, sum(tokens)::BIGINT AS tokens, count(*) AS n_docs FROM counted GROUP BY source),
    ends AS (SELECT max(tokens)::DOUBLE AS t1, min(tokens)::DOUBLE AS t0 FROM totals WHERE tokens > 0),
    search(low, high) AS (
        SELECT 0, {GRID} UNION ALL
        SELECT CASE WHEN pow(t0, ((low + high) // 2) / {GRID}.0 - 1) / pow(t1, ((low + high) // 2) / {GRID}.0 - 1) <= 2.0 THEN low ELSE (low + high) // 2 + 1 END,
               CASE WHEN pow(t0, ((low + high) // 2) / {GRID}.0 - 1) / pow(t1, ((low + high) // 2) / {GRID}.0 - 1) <= 2.0 THEN (low + high) // 2 ELSE high END
        FROM search, ends WHERE low < high),
    alpha AS (SELECT max(high) / {GRID}.0::DOUBLE AS a FROM search WHERE low = high),
    scaled AS (SELECT *, CASE WHEN tokens > 0 THEN pow(tokens::DOUBLE, a) ELSE 0 END AS power FROM totals, alpha),
    plan AS (
        SELECT *, round(power * (SELECT max(tokens / power) FILTER (power > 0) FROM scaled))::BIGINT AS budget FROM scaled),
    whole AS (SELECT greatest(ceil(sum(budget) / {BLOCK_TOKENS}.0), 1) AS blocks FROM plan),
    passes AS (
        SELECT c.doc_id, c.source, c.tokens, p.tokens AS total, budget, unnest(range(0, CASE WHEN p.tokens > 0 THEN ceil(budget / p.tokens)::BIGINT ELSE 1 END)) AS pass
        FROM counted c JOIN plan p ON c.source IS NOT DISTINCT FROM p.source),
    drawn AS (SELECT *, ('0x' || substr(md5('1:' || pass || ':' || doc_id), 1, 15))::BIGINT AS draw FROM passes),
    placed AS (
        SELECT *, coalesce(sum(tokens) OVER (PARTITION BY source, pass ORDER BY draw RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM drawn)
    SELECT doc_id, source, pass, least(floor((pass * total + before)::DOUBLE / greatest(budget, 1) * blocks), blocks - 1)::BIGINT AS block, draw, tokens
    FROM placed, whole WHERE total = 0 OR pass * total + before < budget"""
