"""Statement arithmetic: fourth quarters, trailing twelve months, factors, quality.

Statements are one row per (entity, period end), so the windows per entity are
bounded by the number of reporting periods.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import finite, growth, ratio, relative_change
from tidemark.operators.asof import asof_best, window_join
from tidemark.session import stage

ENTITY, PERIOD = "entity_id", "period_end"
FLOW_FIELDS = ("revenue", "operating_income", "net_income", "eps_diluted", "free_cash_flow", "capex")
STOCK_FIELDS = ("cash", "total_debt", "shares_outstanding", "equity")
CORE_FIELDS = ("revenue", "operating_income", "net_income", "eps_diluted")
QUALITY_FIELDS = ("revenue", "net_income", "eps_diluted", "operating_income", "free_cash_flow", "cash", "total_debt", "shares_outstanding")
MAX_STATEMENT_AGE = 180

# Which reported revenue concept belongs to which family.
REVENUE_FAMILIES = {
    "Revenues": "total",
    "SalesRevenueNet": "total",
    "RevenuesNetOfInterestExpense": "total",
    "BankNetRevenueFromReportedComponents": "total",
    "LeaseAndContractRevenueFromReportedComponents": "total",
    "RevenueFromContractWithCustomerExcludingAssessedTax": "contract",
    "RevenueFromContractWithCustomerIncludingAssessedTax": "contract",
}


def revenue_family(tag: Column) -> Column:
    """Family of a revenue concept; an unlisted concept is its own family."""
    members = lambda name: [t for t, f in REVENUE_FAMILIES.items() if f == name]
    return F.when(tag.isin(members("total")), "total").when(tag.isin(members("contract")), "contract").otherwise(tag)


def compatible_basis(*tags: Column) -> Column:
    """Known revenue concepts all belong to one family; unknown ones do not object."""
    return F.size(F.array_distinct(F.array_compact(F.array(*[revenue_family(t) for t in tags])))) <= 1


def anomalies(prefix: str = "") -> Column:
    """Names of incomes whose size exceeds a positive revenue."""
    revenue = finite(f"{prefix}revenue")
    checks = [
        F.when((revenue > 0) & (F.abs(finite(f"{prefix}{k}")) > revenue), F.lit(f"{k}_exceeds_revenue"))
        for k in ("net_income", "operating_income")
    ]
    return F.array_compact(F.array(*checks))


def _known(*cols: Column) -> Column:
    return reduce(lambda a, b: a & b, [c.isNotNull() for c in cols])


def derive_fourth_quarters(annual: DataFrame, quarters: DataFrame) -> DataFrame:
    """Quarter list with the fourth quarter filled in as the year minus its first three quarters.

    Needs three quarters after the previous year end, 60-120 days apart and
    60-120 days before the year end.  A reported fourth quarter keeps its own
    values and only its missing fields are filled.
    """
    w = Window.partitionBy(ENTITY).orderBy(PERIOD)
    cols = [PERIOD, "revenue_tag", *FLOW_FIELDS]
    me = F.struct(*cols)
    chain = quarters.withColumn("_q", F.array(me, F.lag(me, 1).over(w), F.lag(me, 2).over(w))).select(ENTITY, PERIOD, "_q")
    years = annual.withColumn("_prev_end", F.lag(PERIOD).over(w))
    at = asof_best(years, chain, [ENTITY], PERIOD, PERIOD, ["_q"], best=[PERIOD], strict=True)
    q = [F.col("_q")[i] for i in range(3)]
    gap = lambda a, b: F.datediff(a, b).between(60, 120)
    whole = (
        gap(F.col(PERIOD), q[0][PERIOD])
        & gap(q[0][PERIOD], q[1][PERIOD])
        & gap(q[1][PERIOD], q[2][PERIOD])
        & (F.datediff(F.col(PERIOD), q[2][PERIOD]) <= 330)
        & (F.col("_prev_end").isNull() | (q[2][PERIOD] > F.col("_prev_end")))
    )
    flows = []
    for f in FLOW_FIELDS:
        ok = _known(*[x[f] for x in q])
        if f == "revenue":
            ok = ok & compatible_basis(F.col("revenue_tag"), *[x["revenue_tag"] for x in q])
        flows.append(F.when(ok, F.col(f) - (q[2][f] + q[1][f] + q[0][f])).alias(f))
    fourth = at.where(whole).select(ENTITY, PERIOD, "filed_date", "revenue_tag", *flows, *STOCK_FIELDS)

    names = ["revenue_tag", *FLOW_FIELDS, *STOCK_FIELDS]
    a, b = quarters.alias("q"), fourth.alias("d")
    return a.join(b, [ENTITY, PERIOD], "full").select(
        ENTITY, PERIOD, F.greatest("q.filed_date", "d.filed_date").alias("filed_date"), *[F.coalesce(f"q.{c}", f"d.{c}").alias(c) for c in names]
    )


def rolling_ttm(quarters: DataFrame) -> DataFrame:
    """Four-quarter sums over quarters 60-120 days apart; a field needs all four values."""
    w = Window.partitionBy(ENTITY).orderBy(PERIOD)
    last4 = w.rowsBetween(-3, 0)
    gap = F.datediff(PERIOD, F.lag(PERIOD).over(w))
    q = quarters.withColumn("_gap", gap).withColumn("_family", revenue_family(F.col("revenue_tag")))
    gaps = w.rowsBetween(-2, 0)
    one_basis = F.size(F.collect_set("_family").over(last4)) <= 1
    sums = []
    for f in FLOW_FIELDS:
        ok = F.count(f).over(last4) == 4
        if f == "revenue":
            ok = ok & one_basis
        sums.append(F.when(ok, F.sum(f).over(last4)).alias(f))
    out = q.select(
        ENTITY,
        PERIOD,
        F.max("filed_date").over(last4).alias("filed_date"),
        "revenue_tag",
        *sums,
        *STOCK_FIELDS,
        (F.count("*").over(last4) == 4).alias("_four"),
        F.min("_gap").over(gaps).alias("_min_gap"),
        F.max("_gap").over(gaps).alias("_max_gap"),
    )
    return out.where(F.col("_four") & (F.col("_min_gap") >= 60) & (F.col("_max_gap") <= 120)).drop("_four", "_min_gap", "_max_gap")


def enough_core() -> Column:
    """At least two of the four core fields are reported."""
    return reduce(lambda a, b: a + b, [F.col(c).isNotNull().cast("int") for c in CORE_FIELDS]) >= 2


def year_to_date(annual: DataFrame, quarters: DataFrame) -> DataFrame:
    """Cumulative sums of the 1st to 3rd quarter after each year end, with their alignment checks."""
    ends = annual.select(ENTITY, F.col(PERIOD).alias("_anchor"))
    q = asof_best(quarters, ends, [ENTITY], PERIOD, "_anchor", ["_anchor"], strict=True).where(
        F.col("_anchor").isNotNull() & (F.datediff(PERIOD, "_anchor") <= 310)
    )
    w = Window.partitionBy(ENTITY, "_anchor").orderBy(PERIOD)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    gap = F.datediff(PERIOD, F.coalesce(F.lag(PERIOD).over(w), F.col("_anchor")))
    q = q.withColumn("_gap_ok", gap.between(60, 120)).withColumn("k", F.row_number().over(w))
    family = F.collect_set(revenue_family(F.col("revenue_tag"))).over(upto)
    return q.select(
        ENTITY,
        F.col("_anchor").alias("anchor"),
        "k",
        PERIOD,
        F.max("filed_date").over(upto).alias("filed_date"),
        "revenue_tag",
        *STOCK_FIELDS,
        F.datediff(PERIOD, "_anchor").alias("offset_days"),
        F.bool_and("_gap_ok").over(upto).alias("gaps_ok"),
        family.alias("families"),
        *[F.when(F.count(f).over(upto) == F.col("k"), F.sum(f).over(upto)).alias(f) for f in FLOW_FIELDS],
    ).where(F.col("k") <= 3)


def bridged_ttm(annual: DataFrame, quarters: DataFrame) -> DataFrame:
    """Year + current year-to-date - same prior year-to-date, where both sequences align."""
    w = Window.partitionBy(ENTITY).orderBy(PERIOD)
    years = annual.withColumn("_prev_end", F.lag(PERIOD).over(w)).where(F.datediff(PERIOD, "_prev_end").between(330, 400))
    ytd = year_to_date(annual, quarters).where("gaps_ok")
    now, before = ytd.alias("n"), ytd.alias("b")
    pairs = (
        years.alias("a")
        .join(now, (F.col(f"a.{ENTITY}") == F.col(f"n.{ENTITY}")) & (F.col(f"a.{PERIOD}") == F.col("n.anchor")))
        .join(before, (F.col(f"a.{ENTITY}") == F.col(f"b.{ENTITY}")) & (F.col("a._prev_end") == F.col("b.anchor")) & (F.col("n.k") == F.col("b.k")))
    )
    upto = Window.partitionBy(F.col(f"a.{ENTITY}"), F.col(f"a.{PERIOD}")).orderBy("n.k").rowsBetween(Window.unboundedPreceding, 0)
    aligned = F.max(F.abs(F.col("n.offset_days") - F.col("b.offset_days"))).over(upto) <= 14
    one_basis = F.size(F.array_distinct(F.array_compact(F.concat(F.array(revenue_family(F.col("a.revenue_tag"))), F.col("n.families"), F.col("b.families"))))) <= 1
    flows = []
    for f in FLOW_FIELDS:
        ok = _known(F.col(f"a.{f}"), F.col(f"n.{f}"), F.col(f"b.{f}"))
        if f == "revenue":
            ok = ok & one_basis
        flows.append(F.when(ok, F.col(f"a.{f}") + F.col(f"n.{f}") - F.col(f"b.{f}")).alias(f))
    return pairs.withColumn("_aligned", aligned).where("_aligned").select(
        F.col(f"n.{ENTITY}"),
        F.col(f"n.{PERIOD}"),
        F.greatest("a.filed_date", "n.filed_date", "b.filed_date").alias("filed_date"),
        F.col("n.revenue_tag"),
        *flows,
        *[F.col(f"n.{c}") for c in STOCK_FIELDS],
    )


def build_ttm(annual: DataFrame, quarters: DataFrame) -> DataFrame:
    """Trailing twelve months: the reported year, else four quarters, gaps bridged through the year."""
    full = derive_fourth_quarters(annual, quarters)
    cols = [ENTITY, PERIOD, "filed_date", "revenue_tag", *FLOW_FIELDS, *STOCK_FIELDS]
    rolled = rolling_ttm(full).where(enough_core()).join(annual.select(ENTITY, PERIOD), [ENTITY, PERIOD], "left_anti")
    base = annual.select(*cols, F.lit("annual").alias("method")).unionByName(rolled.select(*cols, F.lit("four_quarter_sum").alias("method")))
    b, x = base.alias("b"), bridged_ttm(annual, full).alias("x")
    fills = reduce(lambda p, q: p | q, [F.col(f"b.{f}").isNull() & F.col(f"x.{f}").isNotNull() for f in FLOW_FIELDS])
    used = F.coalesce(fills, F.lit(False))
    out = b.join(x, [ENTITY, PERIOD], "full").select(
        ENTITY,
        PERIOD,
        F.when(used, F.greatest("b.filed_date", "x.filed_date")).otherwise(F.col("b.filed_date")).alias("filed_date"),
        F.coalesce("b.revenue_tag", "x.revenue_tag").alias("revenue_tag"),
        *[F.coalesce(f"b.{c}", f"x.{c}").alias(c) for c in (*FLOW_FIELDS, *STOCK_FIELDS)],
        F.when(used, F.lit("bridged")).otherwise(F.col("b.method")).alias("method"),
    )
    return out.where(enough_core())


def prior_year(latest: DataFrame, history: DataFrame, cutoff: str, usable_at: str, payload: list[str], tie: str) -> DataFrame:
    """Add ``prev``: among the statements usable by the cutoff the one 300-450 days older, closest to a year.

    Equal distances go to the version observed last.  Latest rows look up a
    fixed window of older periods, so the fan-out is a few statements each.
    """
    older = history.select(ENTITY, F.col(PERIOD).alias("_period"), F.col(usable_at).alias("_usable"), F.col(tie).alias("_tie"), F.struct(PERIOD, *payload).alias("_row"))
    pairs = window_join(latest.select(ENTITY, PERIOD, cutoff).distinct(), older, [ENTITY], PERIOD, "_period", -450, -300).where(F.col("_usable") <= F.col(cutoff))
    distance = F.abs(F.datediff(PERIOD, "_period") - 365)
    best = pairs.groupBy(ENTITY, PERIOD, cutoff).agg(F.max_by("_row", F.struct(-distance, "_tie")).alias("prev"))
    return latest.join(best, [ENTITY, PERIOD, cutoff], "left")


def with_factors(df: DataFrame, price: str, prev: str = "prev") -> DataFrame:
    """Add the factor vector of a statement against its prior year (a struct column) and a price.

    Questionable statements give no factors, and a prior year that is
    questionable or reports revenue on another basis is not compared.
    """
    fields = ("revenue", "net_income", "operating_income", "eps_diluted", "equity")
    old = lambda f: F.col(f"{prev}.{f}")
    comparable = (F.size(anomalies(f"{prev}.")) == 0) & compatible_basis(F.col("revenue_tag"), old("revenue_tag"))
    cur = (*fields, "free_cash_flow", "shares_outstanding", "total_debt", "cash")
    df = df.withColumns({"_sound": F.size(anomalies()) == 0, "_same": comparable})
    df = df.withColumns({**{f"_c_{f}": F.when(F.col("_sound"), finite(f)) for f in cur}, **{f"_p_{f}": F.when(F.col("_same"), finite(old(f))) for f in fields}})
    c, p = (lambda f: F.col(f"_c_{f}")), (lambda f: F.col(f"_p_{f}"))
    op, net = ratio(c("operating_income"), c("revenue")), ratio(c("net_income"), c("revenue"))
    fcf, price_col = c("free_cash_flow"), F.col(price)
    mean_equity = F.when((c("equity") > 0) & (p("equity") > 0), (c("equity") + p("equity")) / 2)
    df = df.withColumns(
        {
            "revenue_growth": growth(c("revenue"), p("revenue")),
            "eps_growth": relative_change(c("eps_diluted"), p("eps_diluted")),
            "operating_margin": op,
            "net_margin": net,
            "operating_margin_change": op - ratio(p("operating_income"), p("revenue")),
            "net_margin_change": net - ratio(p("net_income"), p("revenue")),
            "fcf_margin": ratio(fcf, c("revenue")),
            "cash_conversion": ratio(fcf, c("net_income")),
            "net_debt_to_fcf": F.when(fcf > 0, (c("total_debt") - c("cash")) / fcf),
            "earnings_yield": ratio(c("eps_diluted"), price_col),
            "fcf_yield": ratio(fcf, F.when(c("shares_outstanding") > 0, price_col * c("shares_outstanding"))),
            "return_on_equity": ratio(c("net_income"), mean_equity),
        }
    )
    return df.drop("_sound", "_same", *[f"_c_{f}" for f in cur], *[f"_p_{f}" for f in fields])


def finance_profile(sector: Column, industry: Column | None = None, profile: Column | None = None) -> Column:
    """bank, financial or general, which decides the factors that apply."""
    bank = F.lit(False)
    if profile is not None:
        bank = bank | F.coalesce(profile == "bank", F.lit(False))
    if industry is not None:
        bank = bank | F.coalesce(industry.isin("Diversified Banks", "Regional Banks"), F.lit(False))
    return F.when(bank, "bank").when(F.lower(sector).contains("financial"), "financial").otherwise("general")


def reported_debt(prefix: str = "") -> tuple[Column, Column]:
    """Total debt and its basis from overlapping reported parts, never adding one part twice."""
    every, short, current, non, total = (
        F.col(prefix + c) for c in ("debt_all_current", "debt_short_term", "debt_current", "debt_noncurrent", "debt_total")
    )
    debt = F.coalesce(every + non, total + short, current + non + short, total, current + non)
    basis = (
        F.when(_known(every, non), "reported_current_plus_noncurrent")
        .when(_known(short, total), "reported_long_term_total_plus_short_term_borrowings")
        .when(_known(short, current, non), "reported_current_maturities_plus_noncurrent_plus_short_term")
        .when(debt.isNotNull(), "long_term_debt_proxy")
        .otherwise("unknown")
    )
    return debt, basis


def discrete_flows(cumulative: DataFrame, value: str = "value") -> DataFrame:
    """Year-to-date amounts to single-period ones.

    From each cumulative amount of 130 days or more the latest earlier one with
    the same start is taken off, if it was filed no later and ends 60-120 days
    before.
    """
    c = cumulative.select(ENTITY, "tag", "start", "end", "filed", F.col(value).alias("value"))
    days = F.datediff("end", "start")
    now = c.where(days >= 130)
    old = c.select(ENTITY, "tag", "start", F.col("end").alias("_end"), F.col("filed").alias("_filed"), F.col("value").alias("_value"))
    pairs = now.join(old, [ENTITY, "tag", "start"]).where(F.datediff("end", "_end").between(60, 120) & (F.col("_filed") <= F.col("filed")))
    best = pairs.groupBy(ENTITY, "tag", "start", "end", "filed", "value").agg(
        F.max_by("_value", F.struct("_end", "_filed")).alias("_earlier"), F.max_by("_end", F.struct("_end", "_filed")).alias("flow_start")
    )
    return best.select(ENTITY, "tag", "flow_start", "end", "filed", (F.col("value") - F.col("_earlier")).alias("value"))


def resolve_aliases(facts: DataFrame, aliases: DataFrame) -> DataFrame:
    """One fact per (entity, period, field): total concepts first, then the latest filing, then alias order.

    ``aliases``: field, tag, alias_index, total_priority (a short reference table).
    """
    ranked = facts.join(aliases, "tag")
    order = F.struct("total_priority", F.coalesce("filed", F.lit("0001-01-01").cast("date")), -F.col("alias_index"))
    return ranked.groupBy(ENTITY, PERIOD, "field").agg(F.max_by(F.struct("value", "tag", "filed"), order).alias("r")).select(ENTITY, PERIOD, "field", "r.*")


def component_sum(facts: DataFrame, left: str, right: str, target: str) -> DataFrame:
    """Sum of two disjoint concepts reported in the same filing for the same interval.

    A side with more than one distinct value for the interval is ambiguous and
    drops out.
    """
    keys = [ENTITY, "start", "end", "filed", "accession", "form"]

    def side(tag: str, name: str) -> DataFrame:
        f = facts.where((F.col("tag") == tag) & F.col("value").isNotNull()).groupBy(*keys)
        # Equal extremes mean a single distinct value, without a distinct count.
        f = f.agg(F.min("value").alias(name), F.max("value").alias("_max"))
        return f.where(F.col(name) == F.col("_max")).drop("_max")

    both = side(left, "_left").join(side(right, "_right"), keys)
    return both.select(*keys, F.lit(target).alias("tag"), (F.col("_left") + F.col("_right")).alias("value"))


def shares_asof(statements: DataFrame, shares: DataFrame, days: int = 180) -> DataFrame:
    """Share count dated within ``days`` of the period end and filed no later than the statement."""
    s = shares.select(ENTITY, F.col("as_of").alias("_day"), F.col("filed").alias("_filed"), F.col("shares").alias("_shares"))
    key = [ENTITY, PERIOD, "filed_date"]
    pairs = window_join(statements.select(*key).distinct(), s, [ENTITY], PERIOD, "_day", -days, days).where(F.col("_filed") <= F.col("filed_date"))
    best = pairs.groupBy(*key).agg(F.max_by("_shares", F.struct("_day", "_filed")).alias("shares_asof"))
    return statements.join(best, key, "left")


def day_totals(edges: DataFrame) -> DataFrame:
    """(entity, day, head, total): days joined by intervals, with the amount from their group's first day to each.

    ``edges``: entity, left, right, value, one fixed distance between two days
    each.  Large-star and small-star rounds, every link carrying its signed
    amount: a link that is moved to a nearer day gets the sum of the two that it
    replaces.  A round is a few joins on (entity, day), so an entity's intervals
    are spread like any others, and the rounds grow with the logarithm of the
    longest path.  Where paths disagree, one of them is kept.
    """
    left, right, value = F.col("left"), F.col("right"), F.col("value").cast("double")
    known = edges.where(F.col(ENTITY).isNotNull() & left.isNotNull() & right.isNotNull() & value.isNotNull() & (left != right))
    nearest = lambda d: d.groupBy(ENTITY, "a", "b").agg(F.min("w").alias("w"))
    e = stage(nearest(known.select(ENTITY, F.greatest(left, right).alias("a"), F.least(left, right).alias("b"), F.when(left < right, value).otherwise(-value).alias("w"))), "links")
    seen = None
    while not e.isEmpty():
        both = e.unionByName(e.select(ENTITY, F.col("b").alias("a"), F.col("a").alias("b"), (-F.col("w")).alias("w")))
        low = both.groupBy(ENTITY, "a").agg(F.min(F.struct("b", "w")).alias("m"))
        low = low.select(ENTITY, "a", F.when(F.col("m.b") < F.col("a"), F.col("m")).otherwise(F.struct(F.col("a").alias("b"), F.lit(0.0).alias("w"))).alias("m"))
        far = both.join(low, [ENTITY, "a"]).where("b > a").select(ENTITY, F.col("b").alias("a"), F.col("m.b").alias("b"), (F.col("m.w") - F.col("w")).alias("w"))
        large = stage(nearest(far.where("a <> b")), "large")
        low = large.groupBy(ENTITY, "a").agg(F.min(F.struct("b", "w")).alias("m"))
        moved = F.array(F.struct(F.col("b").alias("a"), F.col("m.b").alias("b"), (F.col("m.w") - F.col("w")).alias("w")), F.struct("a", "m.b", "m.w"))
        near = large.join(low, [ENTITY, "a"]).select(ENTITY, F.explode(moved).alias("x")).select(ENTITY, "x.*")
        e = stage(nearest(near.where("a <> b")), "small")
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64(ENTITY, "a", "b").cast("decimal(38,0)"))).first())
        if now == seen:
            break
        seen = now
    heads = e.select(ENTITY, F.col("b").alias("day"), F.col("b").alias("head"), F.lit(0.0).alias("total")).distinct()
    return e.select(ENTITY, F.col("a").alias("day"), F.col("b").alias("head"), F.col("w").alias("total")).unionByName(heads)


def interval_totals(edges: DataFrame, asks: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Amount between two days as a signed path, of any length, over reported intervals.

    ``edges``: entity, left, right, value; ``asks``: entity, start, end.  Days
    joined by intervals form groups with one running total each, and an ask is
    the difference of two totals, null between groups and for days that no
    interval names.  Every interval is held against the totals of its two days:
    a group with one that differs by more than ``tolerance`` answers nothing.
    """
    totals = stage(day_totals(edges), "day_totals")
    at = lambda day, name: totals.select(ENTITY, F.col("day").alias(day), F.col("head").alias(f"_{name}"), F.col("total").alias(f"_{name}_total"))
    value = edges.select(ENTITY, "left", "right", F.col("value").cast("double").alias("value")).where(F.col("value").isNotNull())
    held = value.join(at("left", "a"), [ENTITY, "left"]).join(at("right", "b"), [ENTITY, "right"])
    torn = held.where(F.abs(F.col("_b_total") - F.col("_a_total") - F.col("value")) > tolerance).select(ENTITY, F.col("_a").alias("_s")).distinct()
    out = asks.join(at("start", "s"), [ENTITY, "start"], "left").join(at("end", "e"), [ENTITY, "end"], "left")
    out = out.join(torn.withColumn("_bad", F.lit(True)), [ENTITY, "_s"], "left")
    total = F.when((F.col("_s") == F.col("_e")) & F.col("_bad").isNull(), F.col("_e_total") - F.col("_s_total"))
    return out.select(*[c for c in asks.columns], total.alias("total"))
