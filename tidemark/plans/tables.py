"""Binds the operators' concepts to a folder of parquet tables.

Market data is stood in for by the order tables: an entity is a nation, a
session an ISO week of ship dates, a provider a return flag, a statement a
quarter of a nation's orders.  Every frame here derives from the whole tables.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import bars as B
from tidemark.operators import calendar as C
from tidemark.operators import features as X
from tidemark.session import exists, new_folder, snapshot

BENCHMARK = -1
PREFERRED_SOURCE = "R"
NAMES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


#: Staged tables by application, table states, name and plan: paths and schemas only.
_STAGED: dict[tuple, tuple] = {}


def cents(c: str):
    """Money as whole cents, so that sums do not depend on the order of rows."""
    return F.floor(F.col(c) * 100 + 0.5)


class Tables:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._shared: dict[str, DataFrame] = {}

    def raw(self, name: str) -> DataFrame:
        if name not in NAMES:
            raise KeyError(name)
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")

    @cached_property
    def state(self) -> tuple:
        """Which application reads which state of which tables."""
        return (self.spark.sparkContext.applicationId, self.path, *(snapshot(self.spark, f"{self.path}/{n}.parquet") for n in NAMES))

    def shared(self, name: str, df: DataFrame) -> DataFrame:
        """A reduced table that several branches read, staged on first use; queries over the same tables share it.

        It is written anew when a table has changed or the staged files are gone.
        """
        if name not in self._shared:
            key = (*self.state, name, df.semanticHash())
            known = _STAGED.get(key)
            if known is None or not exists(self.spark, known[0]):
                path = new_folder(self.spark, name)
                df.write.parquet(path)
                known = _STAGED[key] = (path, df.schema)
            self._shared[name] = self.spark.read.schema(known[1]).parquet(known[0])
        return self._shared[name]

    # --- entities and bars -------------------------------------------------

    @cached_property
    def entities(self) -> DataFrame:
        n, r = self.raw("nation"), self.raw("region")
        return n.join(r, n.n_regionkey == r.r_regionkey).select(
            F.col("n_nationkey").cast("long").alias("entity_id"),
            F.concat(F.lit("N"), F.col("n_nationkey")).alias("ticker"),
            F.col("n_name").alias("name"),
            F.col("r_name").alias("sector"),
        )

    def _line_bars(self, session) -> DataFrame:
        """Per (entity, session, source) sums.

        Suppliers are broadcast while Spark finds them small enough, and the
        lines then never shuffle: only the combined sums do.  Beyond that size
        both sides shuffle and adaptive execution splits a hot supplier.
        """
        line, price = self.raw("lineitem"), F.col("l_extendedprice") / F.col("l_quantity")
        supplier = self.raw("supplier").select("s_suppkey", F.col("s_nationkey").cast("long").alias("entity_id"))
        rows = line.select("l_suppkey", session.alias("session_date"), F.col("l_returnflag").alias("source"), cents("l_extendedprice").alias("c"), F.col("l_quantity").cast("long").alias("q"), price.alias("p"))
        return (
            rows.join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
            .groupBy("entity_id", "session_date", "source")
            .agg(F.sum("c").alias("notional_cents"), F.sum("q").alias("volume"), F.max("p").alias("high"), F.min("p").alias("low"))
        )

    @cached_property
    def bars_by_source(self) -> DataFrame:
        return self.shared("bars_by_source", self._priced(self._line_bars(F.trunc("l_shipdate", "week"))))

    @cached_property
    def daily_bars(self) -> DataFrame:
        return self.shared("daily_bars", self._priced(self._line_bars(F.to_date("l_shipdate"))))

    @staticmethod
    def _priced(bars: DataFrame) -> DataFrame:
        return bars.withColumn("close", F.col("notional_cents").cast("double") / 100.0 / F.col("volume").cast("double"))

    def _whole_market(self, bars: DataFrame) -> DataFrame:
        total = bars.groupBy("session_date").agg(
            F.sum("notional_cents").alias("notional_cents"), F.sum("volume").alias("volume"), F.max("high").alias("high"), F.min("low").alias("low")
        )
        return self._priced(total.withColumn("entity_id", F.lit(BENCHMARK).cast("long")).withColumn("source", F.lit("ALL")))

    @cached_property
    def benchmark_bars(self) -> DataFrame:
        return self._whole_market(self.bars_by_source)

    @cached_property
    def daily_benchmark(self) -> DataFrame:
        return self._whole_market(self.daily_bars)

    @cached_property
    def canonical(self) -> DataFrame:
        return B.canonical_bars(self.bars_by_source, PREFERRED_SOURCE)

    @cached_property
    def calendar(self) -> DataFrame:
        return C.sessions_of(self.benchmark_bars)

    @cached_property
    def daily_calendar(self) -> DataFrame:
        return C.sessions_of(self.daily_benchmark)

    @cached_property
    def panel(self) -> DataFrame:
        return self._numbered(self.canonical)

    @cached_property
    def benchmark_panel(self) -> DataFrame:
        return self._numbered(self.benchmark_bars)

    def _numbered(self, bars: DataFrame) -> DataFrame:
        return C.attach_session_no(bars, self.calendar).select(
            "entity_id", "session_date", "session_no", "close", "high", "low", "volume"
        )

    @cached_property
    def features(self) -> DataFrame:
        f = X.session_features(self.panel, self.benchmark_panel)
        return self.shared("features", f.join(self.entities.select("entity_id", "sector"), "entity_id"))

    @cached_property
    def context(self) -> DataFrame:
        return X.price_context(self.features)

    @cached_property
    def setups(self) -> DataFrame:
        h = X.setup_history(self.features)
        return self.shared("setups", h.withColumn("setup_score", X.setup_score(F.col("sample_size"), F.col("ups"), F.col("setup_median"), F.col("rebound_potential_60"))))

    # --- statements --------------------------------------------------------

    @cached_property
    def order_flows(self) -> DataFrame:
        """Cents ordered per (entity, quarter) by status."""
        part = lambda s: F.sum(F.when(F.col("o_orderstatus") == s, F.col("c")).otherwise(0))
        flows = self.entity_orders.groupBy("entity_id", F.trunc("o_orderdate", "quarter").alias("quarter")).agg(
            part("F").alias("f"), part("O").alias("o"), part("P").alias("p"), F.count("*").alias("n")
        )
        return self.shared("order_flows", flows)

    @property
    def entity_orders(self) -> DataFrame:
        """Orders with the entity of their customer; see ``_line_bars`` on the join."""
        customer = self.raw("customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("entity_id"))
        o = self.raw("orders").select("o_custkey", "o_orderdate", "o_orderstatus", "o_orderpriority", cents("o_totalprice").alias("c"))
        return o.join(customer, F.col("o_custkey") == F.col("c_custkey"))

    @staticmethod
    def _statement(flows: DataFrame, filing_days: int) -> DataFrame:
        f, o, p, n = (F.col(x).cast("double") for x in "fopn")
        net = (f * 5 - p * 4) / 500.0
        cash_flow, capex = (f + o) / 400.0, F.when(F.col("n") % 7 != 0, o / 800.0)
        tag = F.when((F.col("entity_id") % 4 == 0) & (F.year("period_end") >= 1998), "RevenueFromContractWithCustomerExcludingAssessedTax").otherwise("Revenues")
        return flows.select(
            "entity_id",
            "period_end",
            F.date_add("period_end", filing_days).alias("filed_date"),
            tag.alias("revenue_tag"),
            ((f + o + p) / 100.0).alias("revenue"),
            (f / 200.0).alias("operating_income"),
            net.alias("net_income"),
            F.when(F.col("n") % 11 != 0, net / (n * 1000.0)).alias("eps_diluted"),
            (cash_flow - F.abs(capex)).alias("free_cash_flow"),
            capex.alias("capex"),
            (p / 400.0).alias("cash"),
            (o / 300.0).alias("total_debt"),
            (n * 1000.0).alias("shares_outstanding"),
            ((f + p) / 300.0).alias("equity"),
        )

    @cached_property
    def quarter_statements(self) -> DataFrame:
        end = F.date_sub(F.add_months("quarter", 3), 1)
        return self._statement(self.order_flows.withColumn("period_end", end), 40)

    @cached_property
    def reported_quarters(self) -> DataFrame:
        """Quarterly filings: every second entity files no fourth quarter."""
        return self.quarter_statements.where((F.month("period_end") != 12) | (F.col("entity_id") % 2 == 1))

    @cached_property
    def annual_statements(self) -> DataFrame:
        years = self.order_flows.groupBy("entity_id", F.year("quarter").alias("year")).agg(
            *[F.sum(x).alias(x) for x in "fopn"], F.count("*").alias("quarters")
        )
        full = years.where(F.col("quarters") == 4).withColumn("period_end", F.make_date("year", F.lit(12), F.lit(31)))
        return self._statement(full, 60)

    @cached_property
    def ttm(self) -> DataFrame:
        from tidemark.operators.fundamentals import build_ttm

        return self.shared("ttm", build_ttm(self.annual_statements, self.reported_quarters))

    @cached_property
    def ttm_versions(self) -> DataFrame:
        """Each statement as first observed, and for every third entity a restatement 120 days later."""
        t = self.ttm.withColumn("observed_at", (F.col("filed_date").cast("timestamp_ntz") + F.expr("make_dt_interval(cast(entity_id % 5 as int), 12)")))
        again = t.where(F.col("entity_id") % 3 == 0).withColumn("observed_at", F.col("observed_at") + F.expr("interval 120 days"))
        again = again.withColumn("revenue", F.col("revenue") * 1.01).withColumn("net_income", F.col("net_income") * 0.98)
        return t.withColumn("version", F.lit(1)).unionByName(again.withColumn("version", F.lit(2)))

    @cached_property
    def decisions(self) -> DataFrame:
        """Every bar with its decision time: the close of the session's last day, 21:00 UTC."""
        p = self.panel.select("entity_id", "session_date", "session_no", "close")
        return p.withColumn("decision_at", F.col("session_date").cast("timestamp_ntz") + F.expr("interval 21 hours"))

    # --- reports and opinions ----------------------------------------------

    @cached_property
    def earnings_versions(self) -> DataFrame:
        """Quarterly reports against the previous quarter, some of them revised ten days later."""
        w = Window.partitionBy("entity_id").orderBy("period_end")
        est, rev = F.lag("eps_diluted").over(w), F.lag("revenue").over(w)
        q = self.quarter_statements.select(
            "entity_id",
            "period_end",
            (F.col("entity_id") * 100000 + F.year("period_end") * 10 + F.quarter("period_end")).alias("event_id"),
            F.expr("date_add(period_end, cast(25 + entity_id % 7 as int))").alias("reported_date"),
            F.when(F.col("entity_id") % 3 == 0, "07:30").when(F.col("entity_id") % 3 == 1, "16:15").alias("event_time"),
            F.col("eps_diluted").alias("reported_eps"),
            est.alias("estimated_eps"),
            F.when(est != 0, (F.col("eps_diluted") - est) / F.abs(est) * 100).alias("surprise_percent"),
            F.when(rev > 0, (F.col("revenue") / rev - 1) * 100).alias("revenue_surprise_percent"),
        )
        first = q.withColumn("observed_at", F.col("reported_date").cast("timestamp_ntz") + F.expr("interval 25 hours"))
        again = first.where((F.col("entity_id") + F.quarter("period_end")) % 4 == 0)
        again = again.withColumn("observed_at", F.col("observed_at") + F.expr("interval 10 days")).withColumn("surprise_percent", F.col("surprise_percent") + 1.0)
        return first.unionByName(again)

    @cached_property
    def report_calendar(self) -> DataFrame:
        """Expected report dates, observed the day after the period ends; every fifth is set too late at first and corrected twelve days on."""
        q = self.earnings_versions.select("entity_id", "event_id", "period_end", "reported_date").distinct()
        late = (F.col("entity_id") + F.quarter("period_end")) % 5 == 0
        first = q.select("entity_id", "event_id", F.when(late, F.date_add("reported_date", 6)).otherwise(F.col("reported_date")).alias("expected_date"), (F.col("period_end").cast("timestamp_ntz") + F.expr("interval 1 day")).alias("observed_at"))
        again = q.where(late).select("entity_id", "event_id", F.col("reported_date").alias("expected_date"), (F.col("period_end").cast("timestamp_ntz") + F.expr("interval 13 days")).alias("observed_at"))
        return first.unionByName(again)

    @cached_property
    def analyst_snapshots(self) -> DataFrame:
        """Monthly counts of five ordered opinions per entity, captured at the end of the month."""
        count = lambda p: F.count_if(F.col("o_orderpriority") == p)
        names = {"strong_buy": "1-URGENT", "buy": "2-HIGH", "hold": "3-MEDIUM", "sell": "4-NOT SPECIFIED", "strong_sell": "5-LOW"}
        monthly = self.entity_orders.groupBy("entity_id", F.trunc("o_orderdate", "month").alias("period_date")).agg(*[count(p).alias(k) for k, p in names.items()])
        month_end = F.last_day("period_date").cast("timestamp_ntz") + F.expr("interval 20 hours")
        return monthly.withColumn("observed_at", month_end).withColumn("source", F.lit("orders"))

    @cached_property
    def quarter_decisions(self) -> DataFrame:
        """One decision per entity and quarter: its first session of the quarter."""
        first = F.min_by(F.struct("session_date", "session_no", "close", "decision_at"), "session_no")
        return self.decisions.groupBy("entity_id", F.trunc("session_date", "quarter").alias("q")).agg(first.alias("r")).select("entity_id", "r.*")
