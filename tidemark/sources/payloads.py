"""Raw payload columns (JSON, XML, CSV lines, calendar text) to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import finite, positive
from tidemark.functions.text import normalize_ticker, table_rows, visible_text

_FACT = "struct<start:date,end:date,val:double,filed:date,form:string,accn:string>"
FACTS_SCHEMA = f"struct<facts:map<string,map<string,struct<units:map<string,array<{_FACT}>>>>>>"


def company_facts(df: DataFrame, keys: list[str], payload: str) -> DataFrame:
    """Nested facts (namespace, concept, unit, rows) to one row per fact."""
    d = df.select(*keys, F.from_json(payload, FACTS_SCHEMA)["facts"].alias("f"))
    d = d.select(*keys, F.explode("f").alias("namespace", "tags"))
    d = d.select(*keys, "namespace", F.explode("tags").alias("tag", "node"))
    d = d.select(*keys, "namespace", "tag", F.explode("node.units").alias("unit", "rows"))
    d = d.select(*keys, "namespace", "tag", "unit", F.inline("rows"))
    return d.withColumn("val", finite("val")).where(F.col("val").isNotNull())


def filing_index(df: DataFrame, keys: list[str], payload: str, forms: list[str], since: Column | None = None) -> DataFrame:
    """Parallel arrays of a filing index to rows of the wanted forms."""
    schema = "struct<form:array<string>,reportDate:array<string>,filingDate:array<string>,accessionNumber:array<string>>"
    d = df.select(*keys, F.from_json(payload, schema).alias("p")).select(*keys, "p.*")
    d = d.select(*keys, F.inline(F.arrays_zip("form", "reportDate", "filingDate", "accessionNumber")))
    d = d.where(F.col("form").isin(*forms) & (F.col("reportDate") != "")).select(
        *keys, "form", F.col("reportDate").cast("date").alias("period_end"), F.col("filingDate").cast("date").alias("filed_date"), F.col("accessionNumber").alias("accession")
    )
    return d.where(F.col("filed_date") >= since) if since is not None else d


def instance_facts(df: DataFrame, keys: list[str], payload: str, concepts: list[str], entity: str) -> DataFrame:
    """Consolidated facts of the matching entity from filing instances.

    Contexts with a segment or of another entity are left out, and so are
    facts in units other than plain dollars, shares or pure numbers.
    """
    text = T.StringType()
    fact = T.ArrayType(T.StructType([T.StructField("_VALUE", text), T.StructField("_contextRef", text), T.StructField("_unitRef", text)]))
    period = T.StructType([T.StructField(n, text) for n in ("startDate", "endDate", "instant")])
    who = T.StructType([T.StructField("identifier", text), T.StructField("segment", text)])
    context = T.ArrayType(T.StructType([T.StructField("_id", text), T.StructField("entity", who), T.StructField("period", period)]))
    unit = T.ArrayType(T.StructType([T.StructField("_id", text), T.StructField("measure", text)]))
    schema = T.StructType([T.StructField("context", context), T.StructField("unit", unit), *[T.StructField(c, fact) for c in concepts]])
    d = df.select(*keys, F.col(entity).cast("string").alias("_entity"), F.from_xml(payload, schema.simpleString()).alias("x"))
    def tagged(c: str) -> Column:
        found = F.coalesce(F.col(f"x.{c}"), F.array().cast(fact))
        return F.transform(found, lambda r: F.struct(F.lit(c).alias("tag"), r["_VALUE"].alias("text"), r["_contextRef"].alias("c"), r["_unitRef"].alias("u")))

    rows = F.concat(*[tagged(c) for c in concepts])
    contexts = F.map_from_entries(F.transform("x.context", lambda c: F.struct(c["_id"], F.struct(c["entity"].alias("entity"), c["period"].alias("period")))))
    units = F.map_from_entries(F.transform("x.unit", lambda u: F.struct(u["_id"], F.element_at(F.split(u["measure"], ":"), -1))))
    d = d.select(*keys, "_entity", contexts.alias("cs"), units.alias("us"), F.inline(rows))
    d = d.withColumn("ctx", F.try_element_at("cs", F.col("c"))).withColumn("unit", F.try_element_at("us", F.col("u"))).withColumn("val", finite("text"))
    own = F.ltrim(F.col("ctx.entity.identifier"), F.lit("0")) == F.col("_entity")
    keep = own & F.col("ctx.entity.segment").isNull() & F.col("unit").isin("USD", "shares", "pure") & F.col("val").isNotNull()
    end = F.coalesce("ctx.period.endDate", "ctx.period.instant").cast("date")
    return d.where(keep).select(*keys, "tag", "unit", F.col("ctx.period.startDate").cast("date").alias("start"), end.alias("end"), "val")


# Element names of ownership filings.
_V = "struct<value:string>"
_AMOUNTS = f"struct<transactionShares:{_V},transactionPricePerShare:{_V},transactionAcquiredDisposedCode:{_V}>"
_TRANSACTION = f"struct<securityTitle:{_V},transactionDate:{_V},transactionCoding:struct<transactionCode:string>,transactionAmounts:{_AMOUNTS}>"
OWNERSHIP = f"issuer struct<issuerCik:string>, nonDerivativeTable struct<nonDerivativeTransaction:array<{_TRANSACTION}>>"


def ownership_transactions(df: DataFrame, keys: list[str], payload: str, issuer: str) -> DataFrame:
    """Transactions of ownership filings whose issuer matches; joint owners stay one transaction."""
    d = df.select(*keys, F.col(issuer).cast("string").alias("_want"), F.from_xml(payload, OWNERSHIP).alias("x"))
    d = d.where(F.ltrim("x.issuer.issuerCik", F.lit("0")) == F.col("_want"))
    return transactions(d.select(*keys, F.col("x.nonDerivativeTable").alias("nonDerivativeTable")), keys)


def transactions(filings: DataFrame, keys: list[str]) -> DataFrame:
    """One row per transaction of parsed ownership filings."""
    d = filings.select(*keys, F.posexplode("nonDerivativeTable.nonDerivativeTransaction").alias("position", "t"))
    shares, price = finite("t.transactionAmounts.transactionShares.value"), finite("t.transactionAmounts.transactionPricePerShare.value")
    code = F.col("t.transactionCoding.transactionCode")
    return d.select(
        *keys, "position", F.col("t.transactionDate.value").cast("date").alias("event_date"), code.alias("code"), (code == "P").alias("purchase"),
        F.col("t.transactionAmounts.transactionAcquiredDisposedCode.value").alias("direction"), shares.alias("shares"), price.alias("price"), (shares * price).alias("reported_value"),
    )


def calendar_events(df: DataFrame, keys: list[str], payload: str) -> DataFrame:
    """Events of calendar text: folded lines joined, stamps with a zone brought to UTC."""
    unfolded = F.regexp_replace(F.regexp_replace(F.col(payload), "\r\n", "\n"), "\n[ \t]", "")
    blocks = F.regexp_extract_all(unfolded, F.lit(r"(?s)BEGIN:VEVENT\n(.*?)\nEND:VEVENT"), F.lit(1))
    d = df.select(*keys, F.explode(blocks).alias("b"))
    field = lambda name: F.regexp_extract("b", rf"(?m)^{name}(?:;[^:\n]*)?:(.*)$", 1)
    stamp, zone = field("DTSTART"), F.regexp_extract("b", r"(?m)^DTSTART;[^:\n]*TZID=([^;:\n]+)", 1)
    local = F.try_to_timestamp(F.regexp_replace(stamp, "Z$", ""), F.lit("yyyyMMdd'T'HHmmss")).cast("timestamp_ntz")
    zone = F.when(stamp.endswith("Z"), "UTC").when(zone != "", zone).otherwise("America/New_York")
    title = F.replace(F.replace(field("SUMMARY"), F.lit("\\,"), F.lit(",")), F.lit("\\n"), F.lit(" "))
    out = d.select(*keys, field("UID").alias("uid"), title.alias("title"), F.convert_timezone(zone, F.lit("UTC"), local).alias("event_at"))
    return out.where((F.col("uid") != "") & (F.col("title") != "") & F.col("event_at").isNotNull())


def series_csv(df: DataFrame, series: list[str], day: str, observed: str) -> DataFrame:
    """Wide series columns to long observations; unusable values and future days are left out."""
    long = df.unpivot([day, observed], series, "series_id", "_text").withColumn("value", finite("_text"))
    when = F.col(day).try_cast("date")
    return long.where(F.col("value").isNotNull() & when.isNotNull() & (when <= F.to_date(observed))).select("series_id", when.alias("observation_date"), "value", F.col(observed).alias("observed_at"))


def vintage_json(df: DataFrame, keys: list[str], payload: str, observed: str) -> DataFrame:
    """Dated vintages of a series; entries without value, day or vintage, or from the future, are left out."""
    d = df.select(*keys, observed, F.inline(F.from_json(payload, "array<struct<date:string,realtime_start:string,value:string>>")))
    day, vintage, value = F.col("date").try_cast("date"), F.col("realtime_start").try_cast("date"), finite("value")
    today = F.to_date(observed)
    ok = day.isNotNull() & vintage.isNotNull() & value.isNotNull() & (day <= today) & (vintage <= today)
    return d.where(ok).select(*keys, day.alias("observation_date"), vintage.alias("vintage_date"), value.alias("value"), F.col(observed).alias("observed_at"))


def agency_months(df: DataFrame, keys: list[str], payload: str) -> DataFrame:
    """Monthly agency data: month codes M01-M12 only, dated to the first of the month."""
    d = df.select(*keys, F.inline(F.from_json(payload, "array<struct<year:string,period:string,value:string>>")))
    month = F.regexp_extract("period", r"^M(0[1-9]|1[0-2])$", 1)
    day = F.when(month != "", F.make_date(F.col("year").try_cast("int"), month.try_cast("int"), F.lit(1)))
    return d.select(*keys, day.alias("observation_date"), finite("value").alias("value")).where("observation_date is not null and value is not null")


def corporate_actions(df: DataFrame, keys: list[str], payload: str) -> DataFrame:
    """Dividends and splits of a nested payload; a negative amount or a ratio of zero or less is left out."""
    p = F.from_json(payload, "struct<dividends:array<struct<ex_date:string,amount:string>>,splits:array<struct<date:string,ratio:string>>>")
    d = df.select(*keys, p.alias("p"))
    div = d.select(*keys, F.inline("p.dividends")).select(*keys, F.lit("dividend").alias("kind"), F.col("ex_date").try_cast("date").alias("event_date"), finite("amount").alias("amount")).where("amount >= 0")
    spl = d.select(*keys, F.inline("p.splits")).select(*keys, F.lit("split").alias("kind"), F.col("date").try_cast("date").alias("event_date"), positive("ratio").alias("amount")).where("amount > 0")
    return div.unionByName(spl).where(F.col("event_date").isNotNull())


def article_rows(df: DataFrame, directory: DataFrame) -> DataFrame:
    """Articles to one row per known entity with the sentiment stated for that very entity.

    ``df``: id, title, url, published_at, observed_at, tickers, insights
    (array of ticker, sentiment).  Sentiment nobody stated stays null.
    """
    # Stated sentiments.
    score = lambda s: F.when(s == "positive", 1.0).when(s == "negative", -1.0).when(s == "neutral", 0.0)
    ok = F.col("url").rlike("^https?://") & F.col("title").isNotNull() & F.col("published_at").isNotNull() & (F.col("published_at") <= F.col("observed_at"))
    d = df.where(ok).withColumn("ticker", F.explode(F.array_distinct(F.transform("tickers", normalize_ticker))))
    stated = F.element_at(F.filter("insights", lambda x: normalize_ticker(x["ticker"]) == F.col("ticker")), -1)
    d = d.withColumn("sentiment", F.when(F.size(F.filter("insights", lambda x: normalize_ticker(x["ticker"]) == F.col("ticker"))) > 0, score(stated["sentiment"])))
    return d.join(directory.select("entity_id", "ticker"), "ticker").select("entity_id", "id", "published_at", "observed_at", F.col("title").alias("headline"), "sentiment")


def constituents(df: DataFrame, current: DataFrame, low: int = 490, high: int = 550, churn: int = 10) -> DataFrame:
    """One-row report of a constituent list: count, duplicates, churn, and whether it may be used."""
    d = df.select(normalize_ticker(F.col("symbol")).alias("ticker"))
    n = d.agg(F.count("*").alias("members"), (F.count("*") - F.countDistinct("ticker")).alias("duplicates"), F.count_if(F.coalesce(F.col("ticker") == "", F.lit(True))).alias("blank"))
    change = d.join(current, "ticker", "left_anti").agg(F.count("*")).scalar()
    ok = F.col("members").between(low, high) & (F.col("duplicates") == 0) & (F.col("blank") == 0) & (F.col("added") <= churn)
    return n.withColumn("added", change).withColumn("usable", ok)


def report_dates(df: DataFrame, required: list[str]) -> DataFrame:
    """Bulk report-date rows to a sorted array of dates per symbol; a short, fixed number each."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"report-date file lacks {missing}")
    d = df.select(normalize_ticker(F.col("symbol")).alias("ticker"), F.col("reportDate").try_cast("date").alias("d")).where("d is not null").distinct()
    return d.groupBy("ticker").agg(F.sort_array(F.collect_list("d")).alias("dates"))


def holding_rows(df: DataFrame, keys: list[str]) -> DataFrame:
    """Institutional holdings: a positive whole number of shares, reported on a day that the observation does not precede."""
    day, shares = F.col("report_date").try_cast("date"), F.floor(positive("shares")).cast("long")
    d = df.select(*keys, day.alias("report_date"), shares.alias("shares"), "observed_at")
    return d.where((F.col("shares") > 0) & (F.col("report_date") <= F.to_date("observed_at")))


def timed_rows(df: DataFrame, keys: list[str], html: str, zone: str = "America/New_York") -> DataFrame:
    """Table rows that state a day and a clock time of ``zone``, as UTC; the third cell is the title."""
    cells = df.select(*keys, F.explode(table_rows(F.col(html))).alias("c")).where(F.size("c") >= 2)
    at = F.try_to_timestamp(F.concat_ws(" ", F.col("c")[0], F.upper(F.col("c")[1])), F.lit("MMMM d, yyyy h:mm a")).cast("timestamp_ntz")
    utc = F.convert_timezone(F.lit(zone), F.lit("UTC"), at)
    return cells.select(*keys, utc.alias("event_at"), F.get("c", 2).alias("title")).where(F.col("event_at").isNotNull())


def exhibits(df: DataFrame, keys: list[str], html: str, kind: str = r"(?i)^\s*EX-99(\.\d+)?\s*$") -> DataFrame:
    """Links of the index rows that have a cell of this kind."""
    rows = F.regexp_extract_all(html, F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr>"), F.lit(1))
    d = df.select(*keys, F.explode(rows).alias("_row"))
    cells = F.transform(F.regexp_extract_all("_row", F.lit(r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]>"), F.lit(1)), visible_text)
    href = F.regexp_extract("_row", r"""(?is)<a\b[^>]*href=["']([^"']+)["']""", 1)
    return d.where(F.exists(cells, lambda c: c.rlike(kind))).select(*keys, href.alias("href")).where("href <> ''")
