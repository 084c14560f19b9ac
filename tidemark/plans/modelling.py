"""Training panel, splits, models, calibration, ablation and publication."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import r4, r6
from tidemark.operators import audit as U
from tidemark.operators import features as X
from tidemark.operators import models as M
from tidemark.operators import opinions as O
from tidemark.operators import rank as K
from tidemark.plans.ctes import cte, rnd
from tidemark.plans.earnings_plan import CONSENSUS_SQL
from tidemark.plans.registry import query
from tidemark.plans.statements import fundamentals_asof
from tidemark.plans.tables import Tables

FAMILY = {
    "momentum": ("return_1", "momentum_5", "momentum_20", "relative_momentum_5", "relative_momentum_20"),
    "range": ("range_pct", "volatility_20", "close_vs_sma20", "drawdown_20", "rebound_potential_20"),
    "context": ("sector_momentum_5", "sector_momentum_20", "breadth_positive_20", "market_regime_score"),
}
ALL = tuple(f for fam in FAMILY.values() for f in fam)


def panel(t: Tables) -> DataFrame:
    """Context features with the delayed 5-session outcome, its excess over the market and the end of its label."""
    px = t.panel.select("entity_id", F.col("session_no").alias("_no"), F.col("close").alias("_px"))
    b = t.benchmark_panel.select(F.col("session_no").alias("_no"), F.col("close").alias("_px"))
    d = t.context.withColumn("label_end_no", F.col("session_no") + 6)
    for name, off in (("entry", 1), ("exit", 6)):
        d = d.withColumn("_at", F.col("session_no") + off)
        d = d.join(px.withColumnsRenamed({"_px": f"_{name}", "_no": "_at"}), ["entity_id", "_at"], "left")
        d = d.join(F.broadcast(b.withColumnsRenamed({"_px": f"_b{name}", "_no": "_at"})), "_at", "left")
    out = d.withColumn("actual_return", F.col("_exit") / F.col("_entry") - 1).withColumn("target", F.col("actual_return") - (F.col("_bexit") / F.col("_bentry") - 1))
    out = out.drop("_at", "_entry", "_exit", "_bentry", "_bexit").withColumn("up", (F.col("actual_return") > 0).cast("double")).withColumn("feature_coverage", X.feature_coverage(ALL))
    return t.shared("model_panel", out)


cte(
    "model_panel",
    """SELECT c.*, c.session_no + 6 AS label_end_no, x.close / e.close - 1 AS actual_return, (x.close / e.close - 1) - (xb.close / eb.close - 1) AS target FROM context c
LEFT JOIN panel e ON e.entity_id = c.entity_id AND e.session_no = c.session_no + 1 LEFT JOIN panel x ON x.entity_id = c.entity_id AND x.session_no = c.session_no + 6
LEFT JOIN panel eb ON eb.entity_id = -1 AND eb.session_no = c.session_no + 1 LEFT JOIN panel xb ON xb.entity_id = -1 AND xb.session_no = c.session_no + 6""",
)
_FOLD_SQL = """labelled AS (SELECT * FROM model_panel WHERE target IS NOT NULL), dts AS (SELECT session_no, row_number() OVER (ORDER BY session_no) - 1 AS position, count(*) OVER () AS dates FROM (SELECT DISTINCT session_no FROM labelled)),
folded AS (SELECT *, CAST(position >= floor(dates * 0.58) AS INT) + CAST(position >= floor(dates * 0.7) AS INT) + CAST(position >= floor(dates * 0.82) AS INT) - 1 AS fold FROM dts)"""


@query(
    "purged_folds",
    "M1",
    f"WITH {_FOLD_SQL}, starts AS (SELECT fold - 1 AS fold, min(session_no) AS next_start FROM folded GROUP BY 1) SELECT CAST(f.fold AS INTEGER) AS fold, count(*) AS n, count(*) FILTER (WHERE l.session_no >= next_start - 6) AS crossing FROM labelled l JOIN folded f USING (session_no) LEFT JOIN starts s ON s.fold = f.fold GROUP BY 1",
)
def purged_folds(t: Tables) -> DataFrame:
    d = M.purged_folds(panel(t).where(F.col("target").isNotNull()), 6)
    return d.groupBy("fold").agg(F.count("*").alias("n"), F.count_if("crosses").alias("crossing"))


@query("training_before", "M2", "SELECT sector, count(*) AS n FROM model_panel WHERE target IS NOT NULL AND label_end_no < 200 GROUP BY 1")
def training_before(t: Tables) -> DataFrame:
    return M.training_before(panel(t), 200).groupBy("sector").agg(F.count("*").alias("n"))


@query(
    "family_rows",
    "M8 M9",
    " UNION ALL ".join(f"SELECT '{k}' AS family, count(*) AS n FROM model_panel WHERE {' + '.join(f'CAST({f} IS NOT NULL AS INT)' for f in v)} >= {max(1, len(v) // 2)}" for k, v in FAMILY.items()),
)
def family_rows(t: Tables) -> DataFrame:
    parts = [M.family_rows(panel(t), v).agg(F.count("*").alias("n")).select(F.lit(k).alias("family"), "n") for k, v in FAMILY.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "model_periods",
    "M10",
    f"WITH {_FOLD_SQL} SELECT CASE WHEN position < floor(dates * 0.6) THEN 'train' WHEN position < floor(dates * 0.8) THEN 'selection' ELSE 'holdout' END AS period, count(*) AS n, {rnd('avg(target)')} AS mean_target FROM labelled JOIN dts USING (session_no) GROUP BY 1",
)
def model_periods(t: Tables) -> DataFrame:
    d = panel(t).where(F.col("target").isNotNull())
    p = M.period_of("session_no", M.sample_dates(d))
    return d.join(F.broadcast(p), "session_no").groupBy("period").agg(F.count("*").alias("n"), r6(F.avg("target")).alias("mean_target"))


@query(
    "training_panel",
    "M12",
    f"""WITH {CONSENSUS_SQL}, fnd AS (SELECT d.entity_id, d.session_date, v.period_end, v.revenue FROM decisions d JOIN LATERAL (SELECT * FROM ttm_versions v WHERE v.entity_id = d.entity_id AND greatest(v.observed_at, CAST(v.filed_date AS TIMESTAMP)) <= d.decision_at ORDER BY v.period_end DESC, v.observed_at DESC LIMIT 1) v ON true)
SELECT p.entity_id, p.session_date, {rnd('p.momentum_20')} AS momentum_20, {rnd('p.market_regime_score')} AS market_regime_score, {rnd('f.revenue', 2)} AS revenue, s.analyst_score, {rnd('p.target')} AS target
FROM model_panel p LEFT JOIN fnd f USING (entity_id, session_date) LEFT JOIN scored s USING (entity_id, session_date) WHERE p.session_no % 5 = 1""",
)
def training_panel(t: Tables) -> DataFrame:
    base = panel(t).where(F.col("session_no") % 5 == 1)
    f = fundamentals_asof(t).select("entity_id", "session_date", "revenue")
    c = O.consensus_asof(t.decisions, t.analyst_snapshots, "decision_at").select("entity_id", "session_date", "analyst_score")
    d = base.join(f, ["entity_id", "session_date"], "left").join(c, ["entity_id", "session_date"], "left")
    return d.select("entity_id", "session_date", r6("momentum_20").alias("momentum_20"), r6("market_regime_score").alias("market_regime_score"), (F.floor(F.col("revenue") * 100 + 0.5) / 100).alias("revenue"), "analyst_score", r6("target").alias("target"))


def _usable(t: Tables) -> DataFrame:
    return panel(t).where(F.col("target").isNotNull() & (F.col("feature_coverage") >= 0.8))


@query("calibrated_classifier", "M4 M5 A28", None)
def calibrated_classifier(t: Tables) -> DataFrame:
    """Raw and calibrated Brier scores on the last fold; each fold is used for one purpose only."""
    d = M.purged_folds(_usable(t), 6).where("not crosses")
    clf = M.fit_classifier(d.where("fold = -1"), ALL, "up", rounds=10)
    s = M.raw_probability(clf, d.where("fold >= 0").select("entity_id", "session_no", "fold", "up", *ALL), ALL)
    cal = M.calibrate(s.where("fold < 2"), "up")
    base = s.where("fold < 2").agg(F.avg("up")).scalar()
    h = M.calibrated(cal, s.where("fold = 2")).withColumn("base", base)
    sq = lambda c: r6(F.avg((F.col(c) - F.col("up")) * (F.col(c) - F.col("up"))))
    return h.agg(F.count("*").alias("n"), sq("raw").alias("raw_brier"), sq("probability_up").alias("brier"), sq("base").alias("baseline_brier"))


@query("walk_forward_ranker", "M3 M6 P13 F19", None)
def walk_forward_ranker(t: Tables) -> DataFrame:
    """Predictions of three spans, refitted before each, and the selections made from them."""
    d = _usable(t).select("entity_id", "session_no", "sector", "label_end_no", "target", "actual_return", "feature_coverage", *ALL)
    last = d.agg(F.max("session_no")).first()[0]
    cuts = [int(last * s) for s in (0.6, 0.73, 0.86)]
    p = M.walk_forward(d, ALL, cuts, "target", "actual_return", rounds=8)
    picks = K.select_predictions(p, "downside_aware", 5, ["session_no"])
    return picks.select("session_no", "entity_id", "rank", "refit_no", r4("expected_excess").alias("expected_excess"), r4("expected_return").alias("expected_return"), r4("downside_p10").alias("downside_p10"))


@query("family_ablation", "M7 A30", None)
def family_ablation(t: Tables) -> DataFrame:
    """Error of each feature family on the last fold against the training mean."""
    d = M.purged_folds(_usable(t), 6).where("not crosses").select("session_no", "fold", "target", *ALL)
    train, test = d.where("fold < 2"), d.where("fold = 2")
    mean = train.agg(F.avg("target")).scalar()
    rows = []
    for name, cols in FAMILY.items():
        m = M.fit_regressor(M.family_rows(train, cols), cols, "target", rounds=6)
        p = M.predict(m, M.family_rows(test, cols), cols, "p").withColumn("mean", mean)
        rows.append(p.agg(F.count("*").alias("n"), r6(F.avg(F.abs(F.col("target") - F.col("p")))).alias("mae"), r6(F.avg(F.abs(F.col("target") - F.col("mean")))).alias("baseline_mae")).select(F.lit(name).alias("family"), "n", "mae", "baseline_mae"))
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query("pooled_logistic", "M15 A29", None)
def pooled_logistic(t: Tables) -> DataFrame:
    """One logistic model over features standardised against each entity's own past."""
    names = ("momentum_5", "momentum_20", "range_pct")
    d = M.standardized(_usable(t).select("entity_id", "session_no", "up", *names), names, "entity_id", "session_no").na.drop()
    d = VectorAssembler(inputCols=[f"z_{n}" for n in names], outputCol="v").transform(d)
    last = d.agg(F.max("session_no")).first()[0]
    model = LogisticRegression(featuresCol="v", labelCol="up").fit(d.where(F.col("session_no") + 6 < int(last * 0.7)))
    p = model.transform(d.where(F.col("session_no") >= int(last * 0.7))).withColumn("p", vector_to_array("probability")[1])
    return p.groupBy(F.floor(F.col("p") * 10).alias("bucket")).agg(F.count("*").alias("n"), r4(F.avg("p")).alias("predicted"), r4(F.avg("up")).alias("realised"))


@query("learned_ranker_ladder", "M13 M14", None)
def learned_ranker_ladder(t: Tables) -> DataFrame:
    """Median-imputed boosted ranking of later years and the outcome of its top 5, 10 and 20."""
    d = _usable(t).select("entity_id", "session_no", "session_date", "target", "actual_return", "label_end_no", *ALL)
    years = d.agg(F.max(F.year("session_date"))).first()[0]
    d = d.withColumn("year", F.year("session_date"))
    held = F.col("year") >= years - 1
    first = d.where(held).agg(F.min("session_no")).first()[0]
    # A label that ends in the held-out years would show them to the fit.
    model = M.fit_regressor(d.where(~held & (F.col("label_end_no") < first)), ALL, "actual_return")
    p = M.predict(model, d.where(held), ALL, "score")
    ladder = K.top_ladder(K.top_n(p, 20, "score", ["session_no"]), ["year"], (5, 10, 20), "actual_return")
    return ladder.select("year", "k", r6("mean_outcome").alias("mean_outcome"), "picks")


_VAL_SQL = """horizon_scores AS (SELECT horizon, CASE WHEN session_no < 250 THEN 'selection' ELSE 'holdout' END AS part, least(0.9, greatest(0.1, 0.5 - momentum_20)) AS p, CAST(y AS DOUBLE) AS y FROM (
  SELECT session_no, momentum_20, unnest([5, 10, 20]) AS horizon, unnest([forward_up_5, forward_up_10, forward_up_20]) AS y FROM features) WHERE y IS NOT NULL AND momentum_20 IS NOT NULL),
scores AS (SELECT horizon, avg((p - y) * (p - y)) FILTER (WHERE part = 'selection') AS selection_brier, avg((0.5 - y) * (0.5 - y)) FILTER (WHERE part = 'selection') AS selection_baseline_brier, avg((p - y) * (p - y)) FILTER (WHERE part = 'holdout') AS brier,
  avg((0.5 - y) * (0.5 - y)) FILTER (WHERE part = 'holdout') AS baseline_brier, count(*) FILTER (WHERE part = 'holdout') AS oof_rows FROM horizon_scores GROUP BY 1),
good AS (SELECT * FROM scores WHERE selection_brier < selection_baseline_brier AND brier < baseline_brier AND oof_rows >= 1000)"""


def horizon_scores(t: Tables) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"forward_up_{h}").cast("double").alias("y")) for h in X.HORIZONS])
    d = t.features.where(F.col("momentum_20").isNotNull()).select("session_no", F.least(F.lit(0.9), F.greatest(F.lit(0.1), F.lit(0.5) - F.col("momentum_20"))).alias("p"), F.inline(pairs)).where("y is not null")
    sel = F.col("session_no") < 250
    err, base = (F.col("p") - F.col("y")) * (F.col("p") - F.col("y")), (F.lit(0.5) - F.col("y")) * (F.lit(0.5) - F.col("y"))
    return d.groupBy(F.lit(1).alias("model"), "horizon").agg(
        F.avg(F.when(sel, err)).alias("selection_brier"), F.avg(F.when(sel, base)).alias("selection_baseline_brier"), F.avg(F.when(~sel, err)).alias("brier"), F.avg(F.when(~sel, base)).alias("baseline_brier"), F.count_if(~sel).alias("oof_rows")
    )


@query("validated_horizons", "P17", f"WITH {_VAL_SQL} SELECT CAST(s.horizon AS INTEGER) AS horizon, {rnd('brier')} AS brier, {rnd('baseline_brier')} AS baseline_brier, oof_rows, s.horizon IN (SELECT horizon FROM good) AND (SELECT count(*) FROM good) >= 2 AS validated FROM scores s")
def validated_horizons(t: Tables) -> DataFrame:
    s = horizon_scores(t)
    ok = U.validated_horizons(s, ["model"]).select("horizon", F.lit(True).alias("v"))
    return s.join(ok, "horizon", "left").select("horizon", r6("brier").alias("brier"), r6("baseline_brier").alias("baseline_brier"), "oof_rows", F.coalesce("v", F.lit(False)).alias("validated"))


@query(
    "published_forecasts",
    "M11",
    f"WITH f AS (SELECT * FROM model_panel WHERE session_no = (SELECT max(session_no) FROM model_panel)) SELECT entity_id, session_date, {rnd('cov')} AS feature_coverage FROM (SELECT *, ({' + '.join(f'CAST({c} IS NOT NULL AS INT)' for c in ALL)}) / {len(ALL)}.0 AS cov FROM f) WHERE cov >= 0.8",
)
def published_forecasts(t: Tables) -> DataFrame:
    p = panel(t)
    now = p.where(F.col("session_no") == p.agg(F.max("session_no")).scalar())
    return now.where(F.col("feature_coverage") >= 0.8).select("entity_id", "session_date", r6("feature_coverage").alias("feature_coverage"))
