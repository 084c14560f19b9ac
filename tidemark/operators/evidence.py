"""Source documents and events as evidence: what was seen, when, and a digest that only a change of content changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text as X

#: Characters of a document that are kept, of its title, and of a digest in a record id.
KEPT, TITLE, SHORT = 200_000, 200, 24
_STRING_OR_REST = r'"(?:[^"\\]|\\.)*"|[^"]+'
_NUMBER_OR_REST = r"-?[0-9][0-9.eE+-]*|[^0-9-]+|-"
#: What every number has that is not in its one form already, and some texts of strings.
_NUMBER_TO_FORM = r"[0-9][.eE]|-0"


def _number(x: Column) -> Column:
    """One form for equal numbers: plain digits without idle zeros where 38 digits hold the value, else as it is."""
    exact = lambda scale: F.when(x.try_cast(f"decimal(38,{scale})").cast("double") == x.cast("double"), x.try_cast(f"decimal(38,{scale})").cast("string"))
    plain = F.when(x.rlike("[eE]"), F.coalesce(exact(18), exact(0), exact(37), x)).otherwise(x)
    short = F.when(plain.contains("."), F.regexp_replace(plain, r"\.?0+$", "")).otherwise(plain)
    return F.when(plain.rlike("[eE]"), plain).when(short == "-0", "0").otherwise(short)


def canonical(payload: Column) -> Column:
    """The text of a nested payload that all its equal spellings share: keys in order at every level, no spaces, numbers by value.

    ``payload`` is JSON text or a variant.  Text that is no JSON gives null, an
    explicit null the text ``null``; what follows the first value is left out.
    The order of arrays counts.  Numbers with an exponent are read as doubles.
    Only texts with a fraction, an exponent or a negative zero are cut into
    numbers and strings; the others are in their form once they are sorted.
    """
    sorted_text = F.to_json(F.try_parse_json(payload.cast("string")))
    parts = F.regexp_extract_all(sorted_text, F.lit(f"({_STRING_OR_REST})"), F.lit(1))
    numbers = lambda p: F.array_join(F.transform(F.regexp_extract_all(p, F.lit(f"({_NUMBER_OR_REST})"), F.lit(1)), lambda x: F.when(x.rlike("[0-9]"), _number(x)).otherwise(x)), "")
    formed = F.array_join(F.transform(parts, lambda p: F.when(p.startswith('"') | ~p.rlike("[0-9]"), p).otherwise(numbers(p))), "")
    return F.when(sorted_text.rlike(_NUMBER_TO_FORM), formed).otherwise(sorted_text)


def fingerprint(payload: Column) -> Column:
    """SHA-256 of the canonical text."""
    return F.sha2(canonical(payload), 256)


def fields(payload: Column, paths: dict[str, tuple[str, str]]) -> list[Column]:
    """Typed columns from JSON paths of a payload, name: (path, type); absent, and unlike the type: null."""
    v = F.try_parse_json(payload.cast("string"))
    return [F.try_variant_get(v, path, kind).alias(name) for name, (path, kind) in paths.items()]


def evidence_events(observed: DataFrame, payload: str = "payload") -> DataFrame:
    """Each row with its payload in canonical form and its ``fingerprint``; ``malformed`` where the payload is no JSON.

    A malformed payload stays as it came and has no fingerprint, so it can be
    counted and set aside; a null payload is not malformed and has none either.
    """
    form = canonical(F.col(payload))
    d = observed.withColumn("_form", form)
    return d.withColumns({
        "malformed": F.col(payload).isNotNull() & F.col("_form").isNull(), "fingerprint": F.sha2("_form", 256), payload: F.coalesce("_form", F.col(payload).cast("string")),
    }).drop("_form")


def first_evidence(events: DataFrame, keys: list[str], order: list[str], observations: str | None = None) -> DataFrame:
    """The first observation of each content of a record: a payload that comes again, however spelled, is no new evidence.

    ``observations`` names a column for the number of rows that state the
    content.  Malformed rows and those without payload are left out; they are
    dropped as one group per key, since a filter of rows would be moved below
    the canonical form and compute it twice.
    """
    names = [*keys, "fingerprint"]
    row = F.struct(*[F.col(c) for c in events.columns if c not in names])
    first = events.groupBy(*names).agg(F.min_by(row, F.struct(*order)).alias("_row"), F.count("fingerprint").alias("_n")).where("_n > 0")
    return first.select(*names, "_row.*", *([F.col("_n").alias(observations)] if observations else [])).select(*events.columns, *([observations] if observations else []))


def revision_id(source_id: Column, payload: Column) -> Column:
    """A source's record id with the digest of what it said, so that each revision is a record of its own."""
    return F.concat_ws(":", F.coalesce(source_id.cast("string"), F.lit("event")), F.substring(fingerprint(payload), 1, SHORT))


def guidance_rows(raw: DataFrame, fields_of: dict[str, str], source_id: str = "id", captured: str = "captured_at") -> DataFrame:
    """Guidance rows with a record id per revision: the methods' short forms spelled out, amounts finite or null, rows without an event date dropped.

    ``fields_of`` names the columns that make up a revision and their kinds,
    ``amount``, ``method`` or ``text``; the time of capture is no part of it.
    """
    clean = {"amount": lambda c: F.when(~F.isnan(F.col(c).try_cast("double")) & (F.abs(F.col(c).try_cast("double")) < float("inf")), F.col(c).try_cast("double")), "method": lambda c: F.when(F.col(c) == "adj", "adjusted").otherwise(F.col(c)), "text": F.col}
    d = raw.where(F.col("event_date").isNotNull()).withColumns({c: clean[kind](c) for c, kind in fields_of.items()})
    said = F.to_json(F.struct("event_date", *fields_of), {"ignoreNullFields": "false"})
    return d.withColumn("source_record_id", revision_id(F.col(source_id), said)).select("source_record_id", "event_date", *fields_of, captured)


def evidence_documents(pages: DataFrame, keys: list[str], url: str = "url", html: str = "html", observed: str = "observed_at", published: str = "published_at", accession: str = "accession", kind: str | None = None, kept: int = KEPT) -> DataFrame:
    """One record per page: kind, source, source id, title, content, content_hash, truncated, rejected.

    The hash is that of the whole visible text, of which ``kept`` characters
    stay.  Without a title element the first line is the title.  ``rejected``
    names what makes the page no evidence: no visible content, or published
    after it was observed; else null.
    """
    d = pages.withColumn("_text", X.visible_text(F.coalesce(html, F.lit(""))))
    titled = F.col(html).rlike(r"(?is)<title[^>]*>.*?</title>")
    return d.select(
        *keys, (F.col(kind) if kind else X.document_kind(F.col("_text"))).alias("kind"), F.when(F.col(accession).isNotNull(), "filing").otherwise("issuer").alias("source"), F.col(url).alias("source_url"),
        F.coalesce(F.col(accession), F.col(url)).alias("source_record_id"), published, observed, F.left(F.when(titled, X.page_title(F.col(html))).otherwise(F.substring_index("_text", "\n", 1)), F.lit(TITLE)).alias("title"),
        F.left("_text", F.lit(kept)).alias("content"), X.content_hash(F.col("_text")).alias("content_hash"), (F.length("_text") > kept).alias("truncated"),
        F.when(F.col("_text") == "", "no_content").when(F.col(published) > F.col(observed), "published_after_observed").alias("rejected"),
    )
