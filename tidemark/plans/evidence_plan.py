"""Evidence queries: events, guidance revisions and documents with canonical digests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.operators import evidence as V
from tidemark.plans.registry import query
from tidemark.plans.tables import Tables
from tidemark.plans.texts import _visible


def event_payloads(t: Tables) -> DataFrame:
    """Every event as a source states it and states it again: other key order, spaces and number forms; every 40th is cut off."""
    e = t.raw("events").withColumn("cents", F.floor(F.col("value") * 100 + 0.5).cast("long").cast("string"))
    k = F.get_json_object("props", "$.k")
    first = F.concat(F.lit('{"type":"'), F.col("event_type"), F.lit('","cents":'), F.col("cents"), F.lit(',"props":'), F.col("props"), F.lit("}"))
    again = F.concat(F.lit('{ "props" : {"k": '), k, F.lit('.0},\n "cents": '), F.col("cents"), F.lit('.00, "type": "'), F.col("event_type"), F.lit('" }'))
    both = e.select("event_id", "user_id", "event_type", F.col("ts").alias("observed_at"), F.explode(F.array(first, again)).alias("payload"))
    return both.withColumn("payload", F.when(F.col("event_id") % 40 == 7, F.expr("substring(payload, 1, length(payload) - 3)")).otherwise(F.col("payload")))


_EVENT_FORM = """'{"cents":' || CAST(floor(value * 100 + 0.5) AS BIGINT) || ',"props":{"k":' || CAST(json_extract(props, '$.k') AS VARCHAR) || '},"type":"' || event_type || '"}'"""


@query(
    "evidence_events",
    "S20 F34 F39",
    f"""SELECT user_id, fingerprint, CAST(json_extract(form, '$.props.k') AS BIGINT) AS k, event_id, n AS observations FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, form ORDER BY ts, event_id) AS i, 2 * count(*) OVER (PARTITION BY user_id, form) AS n, sha256(form) AS fingerprint FROM (SELECT *, {_EVENT_FORM} AS form FROM events WHERE event_id % 40 <> 7)) WHERE i = 1""",
)
def evidence_events(t: Tables) -> DataFrame:
    kept = V.first_evidence(V.evidence_events(event_payloads(t)), ["user_id"], ["observed_at", "event_id"], "observations")
    return kept.select("user_id", "fingerprint", *V.fields(F.col("payload"), {"k": ("$.props.k", "long")}), "event_id", "observations")


@query("malformed_evidence", "S20", "SELECT event_type, 2 * count(*) AS observations, 2 * count(*) FILTER (WHERE event_id % 40 = 7) AS malformed FROM events GROUP BY 1")
def malformed_evidence(t: Tables) -> DataFrame:
    return V.evidence_events(event_payloads(t)).groupBy("event_type").agg(F.count("*").alias("observations"), F.count_if("malformed").alias("malformed"))


_REVISED = {"fiscal_year": "text", "eps_method": "method", "revenue_low": "amount"}


@query(
    "guidance_revisions",
    "F43",
    """WITH g AS (SELECT entity_id, period_end, CAST(floor(revenue) AS BIGINT) AS low, CAST(year(period_end) AS INTEGER) AS y, CASE WHEN entity_id % 2 = 0 THEN 'adjusted' ELSE 'gaap' END AS m FROM quarter_statements),
c AS (SELECT entity_id, period_end, y, m, CASE WHEN i = 2 AND entity_id % 3 = 0 THEN low + 1 ELSE low END AS low, i FROM g, range(3) r(i))
SELECT entity_id || '-' || period_end || ':' || left(sha256('{"eps_method":"' || m || '","event_date":"' || period_end || '","fiscal_year":' || y || ',"revenue_low":' || low || '}'), 24) AS source_record_id, count(*) AS captures, CAST(min(i) AS INTEGER) AS first_capture FROM c GROUP BY 1""",
)
def guidance_revisions(t: Tables) -> DataFrame:
    """Each quarter's guidance is captured three times; every third entity's last capture says something else."""
    low = F.floor("revenue").cast("long") + F.when((F.col("capture") == 2) & (F.col("entity_id") % 3 == 0), 1).otherwise(0)
    raw = t.quarter_statements.select("*", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("capture")).select(
        F.concat_ws("-", "entity_id", "period_end").alias("id"), F.col("period_end").alias("event_date"), F.year("period_end").alias("fiscal_year"),
        F.when(F.col("entity_id") % 2 == 0, F.when(F.col("capture") == 1, "adjusted").otherwise("adj")).otherwise("gaap").alias("eps_method"), low.cast("string").alias("revenue_low"), F.col("capture").alias("captured_at"),
    )
    rows = V.guidance_rows(raw, _REVISED)
    return rows.groupBy("source_record_id").agg(F.count("*").alias("captures"), F.min("captured_at").alias("first_capture"))


_SCORES = ", ".join(" + ".join(f"CASE WHEN contains(lower(body), '{term}') THEN {points} ELSE 0 END" for term, points in terms) + " AS " + kind for kind, terms in X.KIND_TERMS.items())


@query(
    "evidence_documents",
    "S19 F33",
    f"""WITH p AS (SELECT page_id, url, html, {_visible('html')} AS body, {_visible("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")} AS titled FROM pages), s AS (SELECT *, {_SCORES} FROM p)
SELECT page_id, CASE WHEN transcript >= 3 AND transcript >= greatest(presentation, earnings_release) THEN 'transcript' WHEN presentation >= 2 AND presentation >= earnings_release THEN 'presentation' WHEN earnings_release >= 2 THEN 'earnings_release' ELSE 'official_release' END AS kind,
  CASE WHEN page_id % 2 = 0 THEN 'filing' ELSE 'issuer' END AS source, CASE WHEN page_id % 2 = 0 THEN 'acc-' || page_id ELSE url END AS source_record_id, left(CASE WHEN regexp_matches(html, '(?is)<title[^>]*>.*?</title>') THEN titled ELSE split_part(body, chr(10), 1) END, 200) AS title,
  sha256(body) AS content_hash, CAST(least(length(body), 2000) AS INTEGER) AS kept, length(body) > 2000 AS truncated, CASE WHEN body = '' THEN 'no_content' WHEN page_id % 11 = 3 THEN 'published_after_observed' END AS rejected FROM s""",
)
def evidence_documents(t: Tables) -> DataFrame:
    """Pages as documents: even ones are filings, every eleventh claims to be published after it was seen."""
    seen = F.lit("2024-03-01").cast("date")
    d = t.raw("pages").select("page_id", "url", "html", seen.alias("observed_at"), F.when(F.col("page_id") % 11 == 3, F.date_add(seen, 1)).when(F.col("page_id") % 11 < 3, seen).alias("published_at"), F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("acc-"), "page_id")).alias("accession"))
    out = V.evidence_documents(d, ["page_id"], kept=2000)
    return out.select("page_id", "kind", "source", "source_record_id", "title", "content_hash", F.length("content").alias("kept"), "truncated", "rejected")
