"""Cross-sectional ranking with explained contributions and rejection reasons."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import clip, finite
from tidemark.operators.ranks import mid_rank_percentile

# Factor weights by profile, component weights and gates.
GENERAL_WEIGHTS = {
    "revenue_growth": 0.125, "eps_growth": 0.125, "operating_margin": 0.125, "net_margin": 0.075, "operating_margin_change": 0.05,
    "fcf_margin": 0.10, "cash_conversion": 0.05, "net_debt_to_fcf": 0.10, "earnings_yield": 0.125, "fcf_yield": 0.125,
}
FINANCIAL_WEIGHTS = {"revenue_growth": 0.15, "eps_growth": 0.20, "net_margin": 0.15, "net_margin_change": 0.10, "earnings_yield": 0.40}
BANK_WEIGHTS = {
    "revenue_growth": 0.10, "eps_growth": 0.15, "net_margin": 0.10, "earnings_yield": 0.25, "return_on_equity": 0.25, "cet1_ratio": 0.15,
}
PROFILE_WEIGHTS = {"general": GENERAL_WEIGHTS, "financial": FINANCIAL_WEIGHTS, "bank": BANK_WEIGHTS}
LOWER_IS_BETTER = ("net_debt_to_fcf",)
COMPONENT_WEIGHTS = {"financial": 0.45, "technical": 0.35, "analyst": 0.10, "earnings": 0.10}
MIN_FACTOR_COVERAGE, MIN_PEERS, MIN_FINANCIAL_SCORE, MIN_TOTAL_SCORE = 0.80, 5, 50.0, 55.0


def factor_long(df: DataFrame, keys: list[str], profile: str = "profile") -> DataFrame:
    """One row per (candidate, factor of its profile): value (nullable) and weight."""
    per_profile = [
        F.when(F.col(profile) == name, F.array(*[F.struct(F.lit(k).alias("factor"), finite(k).alias("value") if k in df.columns else F.lit(None).cast("double").alias("value"), F.lit(w).alias("weight")) for k, w in weights.items()]))
        for name, weights in PROFILE_WEIGHTS.items()
    ]
    return df.withColumn("_f", F.coalesce(*per_profile)).select(*keys, profile, F.inline("_f"))


def peer_scores(long: DataFrame, group: list[str], min_peers: int = MIN_PEERS) -> DataFrame:
    """Score each factor 0-100 against its peers and add its contribution.

    Factors without a value, or in a group with too few peers, keep their
    weight and contribute nothing.
    """
    scored = mid_rank_percentile(long, [*group, "factor"], "value")
    directed = F.when(F.col("factor").isin(*LOWER_IS_BETTER), 100 - F.col("percentile")).otherwise(F.col("percentile"))
    score = F.when(F.col("peers") >= min_peers, directed)
    return scored.withColumn("score", score).withColumn("contribution", F.coalesce(F.col("score") * F.col("weight"), F.lit(0.0))).drop("percentile")


def value_coverage(long: DataFrame, keys: list[str]) -> DataFrame:
    """Weight of the known factors of each candidate."""
    return long.groupBy(*keys).agg(F.sum(F.when(F.col("value").isNotNull(), F.col("weight")).otherwise(0.0)).alias("value_coverage"))


def financial_score(scored: DataFrame, keys: list[str]) -> DataFrame:
    """Total of the contributions, the weight actually scored and the unscored factors."""
    return scored.groupBy(*keys).agg(
        F.sum("contribution").alias("financial_score"),
        F.sum(F.when(F.col("score").isNotNull(), F.col("weight")).otherwise(0.0)).alias("peer_coverage"),
        F.sort_array(F.collect_list(F.when(F.col("score").isNull(), F.col("factor")))).alias("missing_factors"),
    )


def first_reason(*rules: tuple[Column, str]) -> Column:
    """The first rule that fires names the rejection; null means eligible."""
    return F.coalesce(*[F.when(F.coalesce(cond, F.lit(False)), F.lit(reason)) for cond, reason in rules])


def catalyst_adjustment(eps_surprise: str, revenue_surprise: str) -> Column:
    """Surprises clipped to +-20 each, a fifth of their sum clipped to +-8, zero without any."""
    parts = [clip(c, -20.0, 20.0) for c in (eps_surprise, revenue_surprise)]
    total = reduce(lambda a, b: a + b, [F.coalesce(p, F.lit(0.0)) for p in parts])
    return F.least(F.lit(8.0), F.greatest(F.lit(-8.0), total / 5))


def priority(df: DataFrame) -> DataFrame:
    """Weighted total of the four components with each contribution kept."""
    w = COMPONENT_WEIGHTS
    parts = {
        "contribution_financial": F.col("financial_score") * w["financial"],
        "contribution_technical": F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.col("technical_score"))) * w["technical"],
        "contribution_earnings": F.col("earnings_score") * w["earnings"],
        "contribution_analyst": F.col("analyst_score") * w["analyst"],
    }
    df = df.withColumns(parts)
    return df.withColumn("total_score", reduce(lambda a, b: a + b, [F.col(c) for c in parts]))


def top_n(df: DataFrame, n: int, score: str, by: list[str] | None = None, tie: str = "entity_id", out: str = "rank") -> DataFrame:
    """The best n by score, ties by the id as text.

    Per group the row limit is pushed below the shuffle.  Without groups a
    sorted limit runs first, so only n rows are ever numbered.
    """
    order = [F.col(score).desc(), F.col(tie).cast("string").asc()]
    known = df.where(F.col(score).isNotNull())
    if by:
        return known.withColumn(out, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(out) <= n)
    return known.orderBy(*order).limit(n).withColumn(out, F.row_number().over(Window.orderBy(*order)))


def top_ladder(ranked: DataFrame, by: list[str], sizes: tuple[int, ...], outcome: str, rank: str = "rank") -> DataFrame:
    """Outcome of the top 5, 10, 20 … of one ranking, from a single numbering."""
    steps = ranked.withColumn("k", F.explode(F.array(*[F.lit(s) for s in sizes]))).where(F.col(rank) <= F.col("k"))
    return steps.groupBy(*by, "k").agg(F.avg(outcome).alias("mean_outcome"), F.count("*").alias("picks"))


def sector_capped(df: DataFrame, score: str, cap: int, n: int, by: list[str], sector: str = "sector", tie: str = "entity_id") -> DataFrame:
    """Best n per group with at most ``cap`` per sector."""
    within = top_n(df, cap, score, [*by, sector], tie, "sector_rank")
    return top_n(within, n, score, by, tie)


def ranking_score(excess: Column, downside: Column, variant: str) -> Column:
    if variant == "expected_excess":
        return excess
    if variant == "downside_aware":
        return excess - F.greatest(F.lit(0.0), -downside) * 0.25
    raise ValueError(f"unknown variant {variant}")


def select_predictions(df: DataFrame, variant: str, top: int, by: list[str], min_coverage: float = 0.8, cost: float = 0.002) -> DataFrame:
    """Predictions worth acting on; a group may end up with fewer than ``top`` or none."""
    score = ranking_score(F.col("expected_excess"), F.col("downside_p10"), variant)
    fit = (
        (F.col("feature_coverage") >= min_coverage)
        & (F.col("expected_excess") > 0)
        & (F.col("expected_return") > cost)
        & F.col("downside_p10").isNotNull()
        & (score > 0)
    )
    return top_n(df.where(fit).withColumn("rank_score", score), top, "rank_score", by)


def setup_score_v2(unit_terms: list[tuple[Column, float]]) -> Column:
    """Sum of terms clamped to [0, 1] and weighted to 100."""
    clamp = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    return reduce(lambda a, b: a + b, [clamp(c) * w for c, w in unit_terms]) * 100
