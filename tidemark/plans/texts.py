"""Pages, releases, filings and payload queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import r2, r4
from tidemark.functions import text as X
from tidemark.operators import fundamentals as S
from tidemark.operators import releases as L
from tidemark.plans.ctes import cte, rnd
from tidemark.plans.registry import query
from tidemark.plans.tables import Tables
from tidemark.session import new_folder
from tidemark.sources import files as SF
from tidemark.sources import payloads as P


def _visible(col: str) -> str:
    """SQL twin of ``functions.text.visible_text``."""
    e = f"regexp_replace({col}, '(?is)<(script|style)\\b[^>]*>.*?</(script|style)>|<!--.*?-->', '', 'g')"
    e = f"regexp_replace({e}, '(?i)</?(p|div|tr|li|h1|h2|h3|br)\\b[^>]*>', chr(10), 'g')"
    e = f"regexp_replace({e}, '<[^>]*>', '', 'g')"
    # The tables' pages hold no other references; the rest is held against stated answers in the tests.
    for ref, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&copy;", "\u00a9"), ("&middot;", "\u00b7"), ("&amp;", "&")):
        e = f"replace({e}, '{ref}', '{char.replace(chr(39), chr(39) * 2)}')"
    e = f"regexp_replace({e}, '[ \\t\\f\\r]+', ' ', 'g')"
    e = f"regexp_replace({e}, ' ?\\n[ \\n]*', chr(10), 'g')"
    return f"regexp_replace(regexp_replace({e}, '^[ \\n]+', ''), '[ \\n]+$', '')"


@query(
    "page_text",
    "S10 D1 S19",
    f"SELECT page_id, title, CAST(length(body) AS INTEGER) AS chars, CAST(length(body) - length(replace(body, chr(10), '')) + 1 AS INTEGER) AS lines, sha256(body) AS content_hash FROM (SELECT page_id, {_visible('html')} AS body, {_visible(chr(39).join(['regexp_extract(html, ', '(?is)<title[^>]*>(.*?)</title>', ', 1)']))} AS title FROM pages)",
)
def page_text(t: Tables) -> DataFrame:
    d = t.raw("pages").select("page_id", X.visible_text(F.col("html")).alias("body"), X.page_title(F.col("html")).alias("title"))
    return d.select("page_id", "title", F.length("body").alias("chars"), F.size(F.split("body", "\n")).alias("lines"), X.content_hash(F.col("body")).alias("content_hash"))


@query(
    "page_links",
    "S28",
    """SELECT page_id, CAST(i - 1 AS INTEGER) AS position, href[i] AS href FROM (SELECT page_id, regexp_extract_all(html, '(?is)<a\\b[^>]*href="([^"]*)"[^>]*>(.*?)</a>', 1) AS href FROM pages), LATERAL (SELECT unnest(range(1, len(href) + 1)) AS i)""",
)
def page_links(t: Tables) -> DataFrame:
    return L.discovered_links(t.raw("pages"), "page_id", "html").select("page_id", "position", "href")


@query("page_hosts", "S28", "SELECT lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)) AS host, count(*) AS pages FROM pages GROUP BY 1")
def page_hosts(t: Tables) -> DataFrame:
    return t.raw("pages").groupBy(X.host(F.col("url")).alias("host")).agg(F.count("*").alias("pages"))


_LEAD = "CASE WHEN doc_id % 3 = 0 THEN 'Transcript of the earnings call. ' WHEN doc_id % 3 = 1 THEN 'Financial results. ' ELSE '' END || text"


@query(
    "document_kinds",
    "F33 S19",
    f"""WITH scored AS (SELECT body, {", ".join(" + ".join(f"CASE WHEN contains(lower(body), '{term}') THEN {points} ELSE 0 END" for term, points in terms) + " AS " + kind for kind, terms in X.KIND_TERMS.items())} FROM (SELECT {_LEAD} AS body FROM documents))
SELECT CASE WHEN transcript >= 3 AND transcript >= greatest(presentation, earnings_release) THEN 'transcript' WHEN presentation >= 2 AND presentation >= earnings_release THEN 'presentation' WHEN earnings_release >= 2 THEN 'earnings_release' ELSE 'official_release' END AS kind,
  count(*) AS documents, count(*) FILTER (WHERE length(body) > 2000) AS truncated FROM scored GROUP BY 1""",
)
def document_kinds(t: Tables) -> DataFrame:
    lead = F.when(F.col("doc_id") % 3 == 0, "Transcript of the earnings call. ").when(F.col("doc_id") % 3 == 1, "Financial results. ").otherwise("")
    d = t.raw("documents").select(F.concat(lead, "text").alias("body"))
    return d.groupBy(X.document_kind(F.col("body")).alias("kind")).agg(F.count("*").alias("documents"), F.count_if(F.length("body") > 2000).alias("truncated"))


@query("content_duplicates", "S12 F39 X2", "SELECT content_hash, min(doc_id) AS first_doc, count(*) AS copies FROM (SELECT doc_id, sha256(text) AS content_hash FROM documents) GROUP BY 1 HAVING count(*) > 1")
def content_duplicates(t: Tables) -> DataFrame:
    d = t.raw("documents").select("doc_id", X.content_hash(F.col("text")).alias("content_hash"))
    return d.groupBy("content_hash").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("copies")).where("copies > 1")


def release_pages(t: Tables) -> DataFrame:
    """Release pages written from the annual statements; every fifth entity contradicts itself."""
    a = t.annual_statements.withColumn("y", F.year("period_end") + 1)
    money = lambda f: F.format_string("%.2f", F.floor(F.col("revenue") * f / 1e4 + 0.5) / 100)
    line = lambda lo, hi: F.concat(F.lit("<p>We expect full year "), F.col("y"), F.lit(" <b>revenue</b> of $"), money(lo), F.lit(" million to $"), money(hi), F.lit(" million, ending December 31, "), F.col("y"), F.lit(" in U.S. dollars.</p>"))
    share = F.concat(F.lit("<p>Adjusted diluted EPS for fiscal year "), F.col("y"), F.lit(" is forecast in the range of $"), F.format_string("%.2f", 1.25 + F.col("entity_id") / 4), F.lit(" &#8211; $"), F.format_string("%.2f", 1.5 + F.col("entity_id") / 4), F.lit(".</p>"))
    second = F.when(F.col("entity_id") % 5 == 0, line(1.10, 1.20)).otherwise(F.lit("<p>No guidance was withdrawn &amp; nothing else.</p>"))
    html = F.concat(F.lit("<html><script>var revenue = '1 million to 2 million';</script><h1>Results</h1>"), line(1.02, 1.08), second, share, F.lit("</html>"))
    return a.select("entity_id", F.col("filed_date").alias("filing_date"), html.alias("html"))


@query(
    "guidance_ranges",
    "F31 F43",
    """SELECT entity_id, CAST(year(period_end) + 1 AS INTEGER) AS fiscal_year, 'revenue' AS metric, 'reported' AS method, floor(revenue * 1.02 / 1e4 + 0.5) / 100 * 1e6 AS low, floor(revenue * 1.08 / 1e4 + 0.5) / 100 * 1e6 AS high FROM annual_statements WHERE entity_id % 5 <> 0
UNION ALL SELECT entity_id, CAST(year(period_end) + 1 AS INTEGER), 'eps', 'adjusted', 1.25 + entity_id / 4.0, 1.5 + entity_id / 4.0 FROM annual_statements""",
)
def guidance_ranges(t: Tables) -> DataFrame:
    g = L.guidance_ranges(release_pages(t), ["entity_id", "filing_date"])
    return g.select("entity_id", "fiscal_year", "metric", "method", r4("low").alias("low"), r4("high").alias("high"))


@query("fiscal_targets", "F32", "SELECT entity_id, make_date(year(period_end) + 1, 12, 31) AS target, 'USD' AS currency, count(*) AS lines FROM annual_statements, range(CASE WHEN entity_id % 5 = 0 THEN 2 ELSE 1 END) GROUP BY ALL UNION ALL SELECT entity_id, NULL, NULL, count(*) FROM annual_statements GROUP BY entity_id")
def fiscal_targets(t: Tables) -> DataFrame:
    d = L.guidance_lines(release_pages(t))
    day, currency = L.explicit_target(F.col("line"))
    return d.withColumn("target", day).withColumn("currency", currency).groupBy("entity_id", "target", "currency").agg(F.count("*").alias("lines"))


@query("html_table_rows", "S11", f"SELECT entity_id, period_end, {rnd('revenue', 2)} AS revenue FROM quarter_statements")
def html_table_rows(t: Tables) -> DataFrame:
    row = F.concat(F.lit("<tr class='x'><td>"), F.col("period_end").cast("string"), F.lit("</td><td> <b>"), F.format_string("%.2f", r2("revenue")), F.lit("</b></td></tr>"))
    # One short page per entity and year.
    pages = t.quarter_statements.groupBy("entity_id", F.year("period_end").alias("y")).agg(F.concat(F.lit("<table><tr><th>Date</th></tr>"), F.array_join(F.collect_list(row), "\n"), F.lit("</table>")).alias("html"))
    cells = pages.select("entity_id", F.explode(X.table_rows(F.col("html"))).alias("c")).where(F.size("c") == 2)
    return cells.select("entity_id", F.col("c")[0].try_cast("date").alias("period_end"), r2(F.col("c")[1].try_cast("double")).alias("revenue"))


_FACT_TAGS = {"Revenues": "revenue", "OperatingIncomeLoss": "operating_income", "NetIncomeLoss": "net_income"}


def facts_payload(t: Tables) -> DataFrame:
    """One nested JSON document of reported facts per entity."""
    q = t.quarter_statements.select("entity_id", F.date_add(F.add_months("period_end", -3), 1).alias("start"), F.col("period_end").alias("end"), F.col("filed_date").alias("filed"), *_FACT_TAGS.values())
    fact = lambda v: F.struct(F.col("start"), F.col("end"), F.col(v).alias("val"), F.col("filed"), F.lit("10-Q").alias("form"), F.concat_ws("-", "entity_id", "end").alias("accn"))
    # One entry per reporting period.
    g = q.groupBy("entity_id").agg(*[F.collect_list(fact(v)).alias(v) for v in _FACT_TAGS.values()])
    node = lambda v: F.struct(F.struct(F.col(v).alias("USD")).alias("units"))
    gaap = F.struct(*[node(v).alias(tag) for tag, v in _FACT_TAGS.items()])
    return g.select("entity_id", F.to_json(F.struct(F.struct(gaap.alias("us-gaap")).alias("facts"))).alias("payload"))


@query(
    "company_facts",
    "S6",
    f"SELECT entity_id, period_end, tag, {rnd('val', 2)} AS val FROM (" + " UNION ALL ".join(f"SELECT entity_id, period_end, '{tag}' AS tag, {v} AS val FROM quarter_statements" for tag, v in _FACT_TAGS.items()) + ")",
)
def company_facts(t: Tables) -> DataFrame:
    f = P.company_facts(facts_payload(t), ["entity_id"], "payload")
    return f.select("entity_id", F.col("end").alias("period_end"), "tag", r2("val").alias("val"))


@query(
    "fact_aliases",
    "W24 W25",
    f"SELECT entity_id, period_end, field, tag, {rnd('value', 2)} AS value FROM (SELECT entity_id, period_end, 'revenue' AS field, CASE WHEN entity_id % 2 = 0 THEN 'Revenues' ELSE 'RevenueFromContractWithCustomerExcludingAssessedTax' END AS tag, CASE WHEN entity_id % 2 = 0 THEN revenue ELSE revenue * 0.9 END AS value FROM quarter_statements UNION ALL SELECT entity_id, period_end, 'net_income', 'ProfitLoss', net_income + 1 FROM quarter_statements)",
)
def fact_aliases(t: Tables) -> DataFrame:
    """Contract revenue is always filed later, and still loses to a reported total."""
    q = t.quarter_statements
    base = lambda tag, v, late: q.select("entity_id", "period_end", F.lit(tag).alias("tag"), v.alias("value"), F.date_add("filed_date", late).alias("filed"))
    facts = base("Revenues", F.col("revenue"), 0).where(F.col("entity_id") % 2 == 0)
    facts = facts.unionByName(base("RevenueFromContractWithCustomerExcludingAssessedTax", F.col("revenue") * 0.9, 30)).unionByName(base("NetIncomeLoss", F.col("net_income"), 0)).unionByName(base("ProfitLoss", F.col("net_income") + 1, 5))
    rows = [("revenue", "RevenueFromContractWithCustomerExcludingAssessedTax", 1, 0), ("revenue", "Revenues", 3, 3), ("net_income", "NetIncomeLoss", 0, 0), ("net_income", "ProfitLoss", 1, 0)]
    aliases = t.spark.createDataFrame(rows, "field string, tag string, alias_index int, total_priority int")
    return S.resolve_aliases(facts, aliases).select("entity_id", "period_end", "field", "tag", r2("value").alias("value"))


@query("component_sums", "J32 U1", f"SELECT entity_id, period_end, {rnd('operating_income + net_income', 2)} AS value FROM quarter_statements WHERE entity_id % 3 <> 0")
def component_sums(t: Tables) -> DataFrame:
    q = t.quarter_statements
    keys = ["entity_id", F.date_add(F.add_months("period_end", -3), 1).alias("start"), F.col("period_end").alias("end"), F.col("filed_date").alias("filed"), F.concat_ws("-", "entity_id", "period_end").alias("accession"), F.lit("10-Q").alias("form")]
    side = lambda tag, v: q.select(*keys, F.lit(tag).alias("tag"), v.alias("value"))
    facts = side("InterestIncomeExpenseNet", F.col("operating_income")).unionByName(side("NoninterestIncome", F.col("net_income"))).unionByName(side("NoninterestIncome", F.col("net_income") + 5).where(F.col("entity_id") % 3 == 0))
    out = S.component_sum(facts, "InterestIncomeExpenseNet", "NoninterestIncome", "BankNetRevenueFromReportedComponents")
    return out.select("entity_id", F.col("end").alias("period_end"), r2("value").alias("value"))


@query(
    "discrete_flows",
    "W23",
    f"SELECT entity_id, period_end, {rnd('revenue', 2)} AS value FROM quarter_statements q WHERE month(period_end) IN (6, 9) AND (SELECT count(*) FROM quarter_statements p WHERE p.entity_id = q.entity_id AND year(p.period_end) = year(q.period_end) AND p.period_end <= q.period_end) = month(period_end) / 3",
)
def discrete_flows(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    q = t.quarter_statements.where(F.month("period_end") < 12)
    w = Window.partitionBy("entity_id", F.year("period_end")).orderBy("period_end")
    c = q.select("entity_id", F.lit("Revenues").alias("tag"), F.make_date(F.year("period_end"), F.lit(1), F.lit(1)).alias("start"), F.col("period_end").alias("end"), F.col("filed_date").alias("filed"), F.sum("revenue").over(w).alias("value"), (F.count("*").over(w) == F.month("period_end") / 3).alias("ok"))
    return S.discrete_flows(c.where("ok")).select("entity_id", F.col("end").alias("period_end"), r2("value").alias("value"))


@query("shares_asof", "W26", f"SELECT entity_id, period_end, {rnd('shares_outstanding', 2)} AS shares_asof FROM quarter_statements")
def shares_asof(t: Tables) -> DataFrame:
    q = t.quarter_statements.select("entity_id", "period_end", "filed_date")
    s = t.quarter_statements.select("entity_id", F.date_add("period_end", 20).alias("as_of"), F.col("filed_date").alias("filed"), F.col("shares_outstanding").alias("shares"))
    return S.shares_asof(q, s).select("entity_id", "period_end", r2("shares_asof").alias("shares_asof"))


@query(
    "interval_identity",
    "F28",
    f"SELECT a.entity_id, a.period_end, {rnd('sum(q.revenue)', 2)} AS total FROM quarter_statements a JOIN quarter_statements q ON q.entity_id = a.entity_id AND q.period_end > a.period_end - 360 AND q.period_end <= a.period_end WHERE month(a.period_end) = 6 GROUP BY 1, 2 HAVING count(*) = 4",
)
def interval_identity(t: Tables) -> DataFrame:
    """Twelve months to June as a signed path over reported quarters."""
    q = t.quarter_statements
    start = F.add_months(F.date_add("period_end", 1), -3)
    edges = q.select("entity_id", start.alias("left"), F.date_add("period_end", 1).alias("right"), F.col("revenue").alias("value"))
    asks = q.where(F.month("period_end") == 6).select("entity_id", "period_end", F.add_months(F.date_add("period_end", 1), -12).alias("start"), F.date_add("period_end", 1).alias("end"))
    out = S.interval_totals(edges, asks, tolerance=0.05)
    return out.where(F.col("total").isNotNull()).select("entity_id", "period_end", r2("total").alias("total"))


@query(
    "reported_debt",
    "F21",
    f"SELECT entity_id, period_end, {rnd('CASE entity_id % 4 WHEN 0 THEN total_debt + cash WHEN 1 THEN (cash + total_debt) + total_debt WHEN 2 THEN cash END', 2)} AS debt, CASE entity_id % 4 WHEN 0 THEN 'reported_current_plus_noncurrent' WHEN 1 THEN 'reported_long_term_total_plus_short_term_borrowings' WHEN 2 THEN 'long_term_debt_proxy' ELSE 'unknown' END AS basis FROM quarter_statements",
)
def reported_debt(t: Tables) -> DataFrame:
    k = F.col("entity_id") % 4
    q = t.quarter_statements.withColumns(
        {
            "debt_all_current": F.when(k == 0, F.col("cash")), "debt_noncurrent": F.when(k == 0, F.col("total_debt")), "debt_total": F.when(k == 1, F.col("cash") + F.col("total_debt")).when(k == 2, F.col("cash")),
            "debt_short_term": F.when(k == 1, F.col("total_debt")), "debt_current": F.when(k == 3, F.col("cash")),
        }
    )
    debt, basis = S.reported_debt()
    return q.select("entity_id", "period_end", r2(debt).alias("debt"), basis.alias("basis"))


@query("filing_index", "S9", "SELECT entity_id, '10-Q' AS form, period_end, filed_date FROM quarter_statements WHERE month(period_end) <> 12 AND filed_date >= DATE '1997-01-01'")
def filing_index(t: Tables) -> DataFrame:
    q = t.quarter_statements.withColumn("form", F.when(F.month("period_end") == 12, "8-K").otherwise("10-Q"))
    rows = F.sort_array(F.collect_list(F.struct("period_end", "form", "filed_date")))
    arrays = q.groupBy("entity_id").agg(rows.alias("r")).select(
        "entity_id", F.to_json(F.struct(F.col("r.form").alias("form"), F.col("r.period_end").alias("reportDate"), F.col("r.filed_date").alias("filingDate"), F.transform("r", lambda x: F.md5(x["period_end"].cast("string").cast("binary"))).alias("accessionNumber"))).alias("payload")
    )
    return P.filing_index(arrays, ["entity_id"], "payload", ["10-Q", "10-K"], F.lit("1997-01-01").cast("date")).select("entity_id", "form", "period_end", "filed_date")


@query("instance_facts", "S7", f"SELECT entity_id, period_end, 'Revenues' AS tag, {rnd('revenue', 2)} AS val FROM quarter_statements WHERE entity_id % 2 = 1")
def instance_facts(t: Tables) -> DataFrame:
    """Filing instances with a consolidated and a segmented context; even entities file under another identity."""
    q = t.quarter_statements
    cik = F.lpad(F.when(F.col("entity_id") % 2 == 1, F.col("entity_id")).otherwise(F.col("entity_id") + 7000).cast("string"), 10, "0")
    end = F.col("period_end").cast("string")
    ctx = lambda i, seg: F.concat(F.lit(f'<context id="{i}"><entity><identifier scheme="x">'), cik, F.lit(f"</identifier>{seg}</entity><period><startDate>1990-01-01</startDate><endDate>"), end, F.lit("</endDate></period></context>"))
    value = F.format_string("%.2f", r2("revenue"))
    xml = F.concat(
        F.lit("<xbrl>"), ctx("c1", ""), ctx("c2", "<segment>part</segment>"), F.lit('<unit id="u1"><measure>iso4217:USD</measure></unit><Revenues contextRef="c1" unitRef="u1">'), value,
        F.lit('</Revenues><Revenues contextRef="c2" unitRef="u1">1</Revenues></xbrl>'),
    )
    d = q.select("entity_id", "period_end", xml.alias("xml"))
    f = P.instance_facts(d, ["entity_id", "period_end"], "xml", ["Revenues"], "entity_id")
    return f.select("entity_id", F.col("end").alias("period_end"), "tag", r2("val").alias("val"))


@query("ownership_transactions", "S8 F40", f"SELECT entity_id, period_end, 'P' AS code, {rnd('shares_outstanding * eps_diluted', 2)} AS reported_value FROM quarter_statements WHERE entity_id % 3 <> 0 AND eps_diluted IS NOT NULL")
def ownership_transactions(t: Tables) -> DataFrame:
    o = P.ownership_transactions(ownership_filings(t), ["entity_id"], "xml", "entity_id")
    return o.select("entity_id", F.col("event_date").alias("period_end"), "code", r2("reported_value").alias("reported_value"))


def ownership_filings(t: Tables) -> DataFrame:
    """A filing per quarter; every third entity's names another issuer."""
    q = t.quarter_statements.where(F.col("eps_diluted").isNotNull())
    issuer = F.when(F.col("entity_id") % 3 == 0, F.lit("999")).otherwise(F.concat(F.lit("00"), F.col("entity_id")))
    v = lambda tag, c: F.concat(F.lit(f"<{tag}><value>"), c.cast("string"), F.lit(f"</value></{tag}>"))
    xml = F.concat(
        F.lit("<ownershipDocument><issuer><issuerCik>"), issuer, F.lit("</issuerCik></issuer><nonDerivativeTable><nonDerivativeTransaction>"), v("transactionDate", F.col("period_end")),
        F.lit("<transactionCoding><transactionCode>P</transactionCode></transactionCoding><transactionAmounts>"), v("transactionShares", F.col("shares_outstanding")), v("transactionPricePerShare", F.col("eps_diluted")),
        F.lit("</transactionAmounts></nonDerivativeTransaction></nonDerivativeTable></ownershipDocument>"),
    )
    return q.select("entity_id", "period_end", xml.alias("xml"))


@query(
    "ownership_files",
    "S8 S7 F40",
    f"""WITH q AS (SELECT *, month(period_end) = 3 AND entity_id % 4 = 1 AS bad FROM quarter_statements WHERE eps_diluted IS NOT NULL)
SELECT CAST(year(period_end) AS INTEGER) AS year, count(*) AS records, count(*) FILTER (WHERE bad) AS malformed, count(*) FILTER (WHERE NOT bad) AS transactions, {rnd('sum(floor(shares_outstanding * eps_diluted * 100 + 0.5)) FILTER (WHERE NOT bad) / 100', 2)} AS reported_value FROM q GROUP BY 1""",
)
def ownership_files(t: Tables) -> DataFrame:
    """Filings written to files by year and read back record by record; some close another element than they opened."""
    path = new_folder(t.spark, "filings")
    bad = (F.month("period_end") == 3) & (F.col("entity_id") % 4 == 1)
    torn = F.when(bad, F.replace("xml", F.lit("</transactionShares>"), F.lit("</transactionShare>"))).otherwise(F.col("xml"))
    ownership_filings(t).select(F.year("period_end").alias("year"), torn.alias("value")).write.partitionBy("year").text(path)
    rows = SF.xml_records(t.spark, path, "ownershipDocument", P.OWNERSHIP)
    paid = P.transactions(SF.sound(rows), ["year"]).groupBy("year").agg(F.count("*").alias("transactions"), (F.sum(F.floor(F.col("reported_value") * 100 + 0.5)) / 100).alias("v"))
    return SF.quarantine(rows, ["year"]).join(paid, "year").select("year", "records", "malformed", "transactions", r2("v").alias("reported_value"))


@query(
    "calendar_files",
    "S23",
    "SELECT CAST(ts AS DATE) AS day, 1 AS records, CASE WHEN day(ts) = 13 THEN 1 ELSE 0 END AS malformed, CASE WHEN day(ts) = 13 THEN 0 ELSE count(*) END AS events FROM events GROUP BY 1, day(ts)",
)
def calendar_files(t: Tables) -> DataFrame:
    """A calendar file per day, read whole; that of the thirteenth ends inside an event and is set aside."""
    path = new_folder(t.spark, "calendars")
    e = t.raw("events").withColumn("day", F.to_date("ts"))
    event = F.concat(F.lit("BEGIN:VEVENT\r\nUID:"), F.col("event_id"), F.lit("\r\nDTSTART:"), F.date_format("ts", "yyyyMMdd'T'HHmmss"), F.lit("Z\r\nSUMMARY:"), F.col("event_type"), F.lit("\r\nEND:VEVENT\r"))
    torn = e.where(F.dayofmonth("day") == 13).select("day").distinct().select("day", F.lit("BEGIN:VEVENT\r\nUID:x\r").alias("value"))
    e.select("day", event.alias("value")).unionByName(torn).repartition("day").write.partitionBy("day").text(path)
    rows = SF.whole_texts(t.spark, path, "BEGIN:VEVENT", "END:VEVENT").withColumn("day", F.regexp_extract("file", "day=([0-9-]+)", 1).cast("date"))
    found = P.calendar_events(SF.sound(rows), ["day"], "body").groupBy("day").agg(F.count("*").alias("events"))
    counts = SF.quarantine(rows, ["day"]).join(found, "day", "left")
    return counts.select("day", F.col("records").cast("int").alias("records"), F.col("malformed").cast("int").alias("malformed"), F.coalesce("events", F.lit(0)).alias("events"))


@query("calendar_text", "S23", "SELECT event_id, 'Release, ' || event_type AS title, date_trunc('second', ts) AS event_at FROM events")
def calendar_text(t: Tables) -> DataFrame:
    """Calendar text with folded lines written from events and read back."""
    e = t.raw("events")
    body = F.concat(
        F.lit("BEGIN:VCALENDAR\r\nBEGIN:VEVENT\r\nUID:"), F.col("event_id"), F.lit("\r\nDTSTART:"), F.date_format("ts", "yyyyMMdd'T'HHmmss"), F.lit("Z\r\nSUMMARY:Release\\, "), F.substring("event_type", 1, 3), F.lit("\r\n "), F.expr("substring(event_type, 4)"), F.lit("\r\nEND:VEVENT\r\nEND:VCALENDAR"),
    )
    c = P.calendar_events(e.select("event_id", body.alias("body")), ["event_id"], "body")
    return c.select("event_id", "title", "event_at")


@query(
    "article_sentiment",
    "F30",
    "SELECT n.n_nationkey AS entity_id, count(*) AS articles, count(*) FILTER (WHERE e.event_id % 5 IN (0, 1)) AS with_sentiment FROM events e JOIN nation n ON n.n_nationkey = e.user_id % 30 GROUP BY 1",
)
def article_sentiment(t: Tables) -> DataFrame:
    e = t.raw("events")
    ticker = F.concat(F.lit("n"), F.col("user_id") % 30)
    mood = F.when(F.col("event_id") % 5 == 0, "positive").when(F.col("event_id") % 5 == 1, "negative").otherwise("mixed")
    a = e.select(F.col("event_id").alias("id"), F.lit("Headline").alias("title"), F.lit("https://example.com/a").alias("url"), F.col("ts").alias("published_at"), F.col("ts").alias("observed_at"), F.array(ticker, ticker).alias("tickers"), F.array(F.struct(ticker.alias("ticker"), mood.alias("sentiment"))).alias("insights"))
    r = P.article_rows(a, t.entities)
    return r.groupBy("entity_id").agg(F.count("*").alias("articles"), F.count("sentiment").alias("with_sentiment"))


@query("vintage_observations", "S5 S24", f"SELECT series_id, observation_date, vintage_date, {rnd('value', 4)} AS value FROM macro_obs WHERE vintage_date IS NOT NULL")
def vintage_observations(t: Tables) -> DataFrame:
    from tidemark.plans.observations import macro_obs

    o = macro_obs(t).where(F.col("vintage_date").isNotNull())
    item = F.array(F.struct(F.col("observation_date").cast("string").alias("date"), F.col("vintage_date").cast("string").alias("realtime_start"), F.col("value").cast("string").alias("value")), F.struct(F.lit("2030-01-01").alias("date"), F.lit("2030-01-01").alias("realtime_start"), F.lit("NaN").alias("value")))
    d = o.select("series_id", F.lit("2020-01-01").cast("timestamp_ntz").alias("observed_at"), F.to_json(item).alias("payload"))
    return P.vintage_json(d, ["series_id"], "payload", "observed_at").select("series_id", "observation_date", "vintage_date", r4("value").alias("value"))


@query("corporate_actions", "S21", "SELECT c_custkey, 'dividend' AS kind, DATE '2020-01-02' AS event_date, floor(c_acctbal * 100 + 0.5) / 100 AS amount FROM customer WHERE c_acctbal >= 0 UNION ALL SELECT c_custkey, 'split', DATE '2020-02-03', 2.0 FROM customer WHERE c_custkey % 7 = 0")
def corporate_actions(t: Tables) -> DataFrame:
    c = t.raw("customer")
    ratio = F.when(F.col("c_custkey") % 7 == 0, "2.0").otherwise("0")
    body = F.struct(F.array(F.struct(F.lit("2020-01-02").alias("ex_date"), F.col("c_acctbal").cast("string").alias("amount"))).alias("dividends"), F.array(F.struct(F.lit("2020-02-03").alias("date"), ratio.alias("ratio"))).alias("splits"))
    return P.corporate_actions(c.select("c_custkey", F.to_json(body).alias("payload")), ["c_custkey"], "payload").select("c_custkey", "kind", "event_date", r2("amount").alias("amount"))
