"""Bars, calendar, session features, labels and setup scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import r2, r6
from tidemark.functions import tables as TF
from tidemark.operators import bars as B
from tidemark.operators import calendar as C
from tidemark.operators import features as X
from tidemark.plans.ctes import rnd
from tidemark.plans.registry import query
from tidemark.plans.tables import Tables


def _rounded(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    return df.select(*keys, *[r6(v).alias(v) for v in values])


def _sql_rounded(values: list[str]) -> str:
    return ", ".join(f"{rnd(v)} AS {v}" for v in values)


@query(
    "canonical_bars",
    "W8 S1 P6 J1",
    f"SELECT entity_id, session_date, source, volume, {_sql_rounded(['close', 'high', 'low'])} FROM canonical",
)
def canonical_bars(t: Tables) -> DataFrame:
    return _rounded(t.canonical.where(B.valid_bar("close", "high", "low", "close", "volume")), ["entity_id", "session_date", "source", "volume"], ["close", "high", "low"])


@query("bar_validity", "P1 P2 P6", """SELECT source, count(*) AS bars, CAST(sum(CASE WHEN close > 0 AND high >= close AND low <= close AND low > 0 AND volume >= 0 THEN 1 ELSE 0 END) AS BIGINT) AS valid_bars,
  CAST(sum(CASE WHEN NOT (high > close AND low < close) THEN 1 ELSE 0 END) AS BIGINT) AS one_price_bars FROM daily_bars GROUP BY source""")
def bar_validity(t: Tables) -> DataFrame:
    bars = t.daily_bars.withColumn("open", F.lit(None).cast("double"))
    return bars.groupBy("source").agg(
        F.count("*").alias("bars"),
        F.count_if(B.valid_bar()).alias("valid_bars"),
        F.count_if(~((F.col("high") > F.col("close")) & (F.col("low") < F.col("close")))).alias("one_price_bars"),
    )


@query("session_calendar", "W30 F3", "SELECT session_date, session_no, lead(session_date, 5) OVER (ORDER BY session_date) AS after_5 FROM calendar")
def session_calendar(t: Tables) -> DataFrame:
    return C.shift_sessions(t.calendar, t.calendar, "session_date", 5, "after_5")


@query(
    "session_targets",
    "W9 J5",
    """SELECT session_date, horizon, target_date FROM (
  SELECT session_date, unnest([5, 10, 20]) AS horizon, unnest([lead(session_date, 5) OVER w, lead(session_date, 10) OVER w, lead(session_date, 20) OVER w]) AS target_date
  FROM calendar WINDOW w AS (ORDER BY session_date))""",
)
def session_targets(t: Tables) -> DataFrame:
    return C.session_targets(t.calendar, X.HORIZONS)


_BASE = list(X.BASE_FEATURES)


@query("session_features", "W1 W3 W4 W5 W6 J3", f"SELECT entity_id, session_date, {_sql_rounded(_BASE)} FROM features")
def session_features(t: Tables) -> DataFrame:
    return _rounded(t.features, ["entity_id", "session_date"], _BASE)


@query(
    "row_momentum",
    "W2",
    f"""SELECT entity_id, session_date, {rnd('close / lag(close, 60) OVER w - 1')} AS momentum_60, {rnd('close / lag(close, 120) OVER w - 1')} AS momentum_120,
  {rnd('close / lag(close, 250) OVER w - 1')} AS momentum_250 FROM panel WINDOW w AS (PARTITION BY entity_id ORDER BY session_no)""",
)
def row_momentum(t: Tables) -> DataFrame:
    both = t.panel.unionByName(t.benchmark_panel)
    return both.select("entity_id", "session_date", *[r6(X.row_momentum(n)).alias(f"momentum_{n}") for n in (60, 120, 250)])


_LABELS = [f"forward_return_{h}" for h in X.HORIZONS]


@query(
    "forward_labels",
    "W10",
    f"SELECT entity_id, session_date, {_sql_rounded(_LABELS)}, forward_up_5, forward_up_10, forward_up_20 FROM features",
)
def forward_labels(t: Tables) -> DataFrame:
    return t.features.select("entity_id", "session_date", *[r6(x).alias(x) for x in _LABELS], *[f"forward_up_{h}" for h in X.HORIZONS])


_LABEL_SQL = """label_checks AS (
  SELECT f.entity_id, f.session_date, t.horizon, t.target_date, CASE WHEN b.close > 0 AND f.close > 0 THEN b.close / f.close - 1 END AS expected
  FROM features f JOIN (SELECT session_date, unnest([5, 10, 20]) AS horizon,
    unnest([lead(session_date, 5) OVER w, lead(session_date, 10) OVER w, lead(session_date, 20) OVER w]) AS target_date FROM calendar WINDOW w AS (ORDER BY session_date)) t USING (session_date)
  LEFT JOIN canonical b ON b.entity_id = f.entity_id AND b.session_date = t.target_date)"""


@query("exact_session_labels", "J4", f"WITH {_LABEL_SQL} SELECT entity_id, session_date, horizon, target_date, {rnd('expected')} AS expected FROM label_checks")
def exact_session_labels(t: Tables) -> DataFrame:
    labels = X.session_labels(t.features, C.session_targets(t.calendar, X.HORIZONS), t.canonical)
    return labels.select("entity_id", "session_date", "horizon", "target_date", r6("expected").alias("expected"))


@query(
    "market_breadth",
    "A1",
    f"SELECT DISTINCT session_date, {rnd('breadth_positive_20')} AS breadth_positive_20, {rnd('breadth_above_sma20')} AS breadth_above_sma20 FROM context",
)
def market_breadth(t: Tables) -> DataFrame:
    return _rounded(X.market_breadth(t.features), ["session_date"], ["breadth_positive_20", "breadth_above_sma20"])


_SECTOR = ["sector_momentum_5", "sector_momentum_20", "sector_breadth_positive_20"]


@query("sector_context", "A2", f"SELECT DISTINCT session_date, sector, {_sql_rounded(_SECTOR)} FROM context")
def sector_context(t: Tables) -> DataFrame:
    return _rounded(X.sector_context(t.features), ["session_date", "sector"], _SECTOR)


_CONTEXT = ["relative_sector_momentum_5", "relative_sector_momentum_20", "market_regime_score"]


@query("price_context", "A3", f"SELECT entity_id, session_date, {_sql_rounded(_CONTEXT)} FROM context")
def price_context(t: Tables) -> DataFrame:
    return _rounded(t.context, ["entity_id", "session_date"], _CONTEXT)


@query(
    "trailing_sessions",
    "W11",
    f"""SELECT entity_id, session_date, recency, {rnd('close')} AS close FROM (
  SELECT *, dense_rank() OVER (PARTITION BY entity_id ORDER BY session_date DESC) AS recency FROM canonical) WHERE recency <= 100""",
)
def trailing_sessions(t: Tables) -> DataFrame:
    return B.trailing_sessions(t.canonical, 100).select("entity_id", "session_date", "recency", r6("close").alias("close"))


_GAPS = """gaps AS (SELECT b.entity_id, min(c.session_date) AS first_missing, max(c.session_date) AS last_missing, count(*) AS missing_sessions
  FROM (SELECT entity_id, min(session_date) AS lo, max(session_date) AS hi FROM daily_bars GROUP BY 1) b
  JOIN daily_calendar c ON c.session_date BETWEEN b.lo AND b.hi
  WHERE NOT EXISTS (SELECT 1 FROM daily_bars d WHERE d.entity_id = b.entity_id AND d.session_date = c.session_date) GROUP BY 1)"""


@query("price_history_gaps", "J23", f"WITH {_GAPS} SELECT * FROM gaps")
def price_history_gaps(t: Tables) -> DataFrame:
    return B.gap_audit(t.daily_bars, t.daily_calendar)


@query(
    "missing_session_list",
    "J23 U7",
    """SELECT b.entity_id, c.session_date, c.session_no FROM (SELECT entity_id, min(session_date) AS lo, max(session_date) AS hi FROM daily_bars GROUP BY 1) b
  JOIN daily_calendar c ON c.session_date BETWEEN b.lo AND b.hi
  WHERE NOT EXISTS (SELECT 1 FROM daily_bars d WHERE d.entity_id = b.entity_id AND d.session_date = c.session_date)""",
)
def missing_session_list(t: Tables) -> DataFrame:
    return B.missing_sessions(t.daily_bars, t.daily_calendar)


@query(
    "fetch_plan",
    "J36",
    f"""WITH {_GAPS} SELECT l.entity_id, last_date, first_missing, CASE WHEN first_missing IS NULL THEN last_date + 1 ELSE least(first_missing, last_date + 1) END AS fetch_from
FROM (SELECT entity_id, max(session_date) AS last_date FROM daily_bars GROUP BY 1) l LEFT JOIN gaps USING (entity_id)""",
)
def fetch_plan(t: Tables) -> DataFrame:
    return B.fetch_plan(t.daily_bars, t.daily_calendar)


_SETUP = ["setup_up", "setup_median"]


@query("setup_match", "J33 W27 F12", f"SELECT entity_id, session_date, sample_size, ups, {_sql_rounded(_SETUP)}, {rnd('setup_score', 2)} AS setup_score FROM setups")
def setup_match(t: Tables) -> DataFrame:
    return t.setups.select(
        "entity_id", "session_date", F.col("sample_size").cast("long").alias("sample_size"), F.col("ups").cast("long").alias("ups"),
        *[r6(c).alias(c) for c in _SETUP], r2("setup_score").alias("setup_score"),
    )


@query(
    "session_labels_in_sql",
    "D2 W10",
    f"""SELECT b.entity_id, b.session_date, CAST(h.horizon AS INTEGER) AS horizon, e.session_date AS target_date, {rnd('CASE WHEN e.close > 0 AND b.close > 0 THEN e.close / b.close - 1 END')} AS expected
FROM panel b CROSS JOIN (VALUES (5), (10), (20)) h(horizon) LEFT JOIN panel e ON e.entity_id = b.entity_id AND e.session_no = b.session_no + h.horizon WHERE b.entity_id >= 0""",
)
def session_labels_in_sql(t: Tables) -> DataFrame:
    """Labels by the table function, as SQL calls it."""
    TF.register(t.spark)
    out = t.spark.sql("SELECT * FROM session_labels(TABLE(SELECT entity_id, session_date, session_no, close FROM {bars}) PARTITION BY entity_id ORDER BY session_no)", bars=t.panel)
    return out.withColumn("expected", r6("expected"))


@query("week_anchors", "W19", "SELECT CAST(date_part('isoyear', session_date) AS INTEGER) AS iso_year, CAST(date_part('week', session_date) AS INTEGER) AS iso_week, max(session_date) AS session_date FROM daily_calendar GROUP BY 1, 2")
def week_anchors(t: Tables) -> DataFrame:
    return C.last_session_of_weeks(t.daily_calendar)


@query("sampled_sessions", "W18", "SELECT session_date, session_no FROM calendar WHERE session_no % 5 = 1 OR session_no = (SELECT max(session_no) FROM calendar)")
def sampled_sessions(t: Tables) -> DataFrame:
    return C.every_nth_session(t.calendar, 5)


@query(
    "top_relative_momentum",
    "T1",
    f"""SELECT session_date, rk, entity_id, {rnd('relative_sector_momentum_20')} AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY session_date ORDER BY relative_sector_momentum_20 DESC, CAST(entity_id AS VARCHAR)) AS rk
  FROM context WHERE relative_sector_momentum_20 IS NOT NULL) WHERE rk <= 5""",
)
def top_relative_momentum(t: Tables) -> DataFrame:
    w = Window.partitionBy("session_date").orderBy(F.col("relative_sector_momentum_20").desc(), F.col("entity_id").cast("string"))
    ranked = t.context.where(F.col("relative_sector_momentum_20").isNotNull()).withColumn("rk", F.row_number().over(w))
    return ranked.where(F.col("rk") <= 5).select("session_date", "rk", "entity_id", r6("relative_sector_momentum_20").alias("score"))
