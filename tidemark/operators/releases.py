"""Guidance ranges and fiscal targets from the text of releases."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import links, visible_text

# Word lists: a line is read by the words it holds, then clause by clause.
OUTLOOK_NOUNS = ("guidance", "outlook", "forecast", "forecasts", "projection", "projections")
OUTLOOK_VERBS = ("expect", "expects", "expected", "expecting", "anticipate", "anticipates", "forecasting", "project", "projects", "projected")
NEGATIONS = ("no", "not", "without", "neither")
WITHDRAWALS = ("withdraw", "withdraws", "withdrew", "withdrawn", "withdrawing", "suspend", "suspends", "suspended", "suspending")
ORDINALS = ("first", "second", "third", "fourth")
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
SCALES = {"thousand": 1e3, "million": 1e6, "billion": 1e9, "trillion": 1e12}
CURRENCIES = {"USD": ("usd", "us$", "u.s. dollars", "us dollars"), "EUR": ("eur", "euro", "euros"), "GBP": ("gbp", "pounds sterling")}
#: Words between a negation or a withdrawal and the noun it takes back.
REACH = 6

_CLAUSE = r"(?i)(?=\b(?:revenues?|sales|eps|earnings per (?:diluted )?share)\b)"
_AMOUNT = r"\$?\s?(-?\d[\d,]*(?:\.\d+)?)(?:\s(" + "|".join(SCALES) + r")\b)?"
_RANGE = rf"(?i){_AMOUNT}\s?(?:to|and|through|[-\x{{2013}}\x{{2014}}])\s?{_AMOUNT}"


def _any(words: Column, of: tuple[str, ...]) -> Column:
    return F.arrays_overlap(words, F.array(*[F.lit(x) for x in of]))


def _words(line: Column) -> Column:
    return F.regexp_extract_all(F.lower(line), F.lit(r"([a-z]+)"), F.lit(1))


def withdrawn(words: Column) -> Column:
    """A noun of outlook follows a negation, or stands near a withdrawal, within a few words."""
    def spoils(w: Column, i: Column) -> Column:
        after = F.slice(words, i + 2, REACH)
        around = F.slice(words, F.greatest(i + 1 - REACH, F.lit(1)), 2 * REACH + 1)
        return F.when(w.isin(*NEGATIONS), _any(after, OUTLOOK_NOUNS)).when(w.isin(*WITHDRAWALS), _any(around, OUTLOOK_NOUNS)).otherwise(False)

    return F.exists(F.transform(words, spoils), lambda x: x)


def _group(text: Column, pattern: str, n: int = 1) -> Column:
    g = F.regexp_extract(text, pattern, n)
    return F.when(g != "", g)


def fiscal_period(line: Column) -> tuple[Column, Column]:
    """Period (Q1 to Q4 or FY) and year; null where a line names both, several years next to such words, or none.

    A quarter is Q and a digit or an ordinal and the word; the year stands after
    a period word with at most two words between, or right before one.
    """
    low = F.lower(line)
    spelled = F.array_position(F.array(*[F.lit(x) for x in ORDINALS]), F.regexp_extract(low, r"\b(" + "|".join(ORDINALS) + r")[ -](?:fiscal[ -])?quarter\b", 1))
    quarter = F.coalesce(_group(low, r"\bq([1-4])\b").cast("int"), F.when(spelled > 0, spelled.cast("int")))
    mentions = low.rlike(r"\bquarter(?:ly)?\b|\bq[1-4]\b")
    whole = low.rlike(r"\bfull[ -](?:fiscal[ -])?year\b")
    after = F.regexp_extract_all(low, F.lit(r"\b(?:fiscal|fy|year|quarter|q[1-4])\W{1,3}(?:[a-z]+\W{1,3}){0,2}?((?:19|20)\d\d)\b"), F.lit(1))
    joined = F.regexp_extract_all(low, F.lit(r"\bfy((?:19|20)\d\d)\b"), F.lit(1))
    before = F.regexp_extract_all(low, F.lit(r"\b((?:19|20)\d\d)\W{1,2}(?:full[ -]year|fiscal|guidance|outlook)\b"), F.lit(1))
    years = F.array_distinct(F.concat(after, joined, before))
    period = F.when(mentions & ~whole, F.concat(F.lit("Q"), quarter.cast("string"))).when(~mentions, F.lit("FY"))
    return period, F.when(F.size(years) == 1, years[0].cast("int"))


def guidance_lines(releases: DataFrame, html: str = "html") -> DataFrame:
    """Outlook lines, whatever their length, with an explicit fiscal period."""
    d = releases.withColumn("line", F.explode(F.split(visible_text(F.col(html)), "\n"))).drop(html)
    d = d.withColumn("_words", _words(F.col("line"))).where(_any(F.col("_words"), OUTLOOK_NOUNS + OUTLOOK_VERBS) & ~withdrawn(F.col("_words"))).drop("_words")
    period, year = fiscal_period(F.col("line"))
    return d.withColumns({"fiscal_period": period, "fiscal_year": year}).dropna(subset=["fiscal_period", "fiscal_year"])


def _number(text: Column) -> Column:
    return F.replace(text, F.lit(","), F.lit("")).try_cast("double")


def stated_ranges(line: Column) -> Column:
    """(metric, method, low, high) of each clause: a line is cut before its metric words, and a clause's last range is the one in force.

    Amounts of revenue need a scale, on the high end at least and alike on both;
    per-share amounts need none.  The word before a per-share metric is its method.
    """
    clauses = F.split(line, _CLAUSE)

    def read(clause: Column, i: Column) -> Column:
        part = lambda n: F.try_element_at(F.regexp_extract_all(clause, F.lit(_RANGE), F.lit(n)), F.lit(-1))
        low_scale, high_scale = F.lower(part(2)), F.lower(part(4))
        factor = F.element_at(F.create_map(*[F.lit(x) for kv in SCALES.items() for x in kv]), F.nullif(high_scale, F.lit("")))
        same = (F.coalesce(low_scale, F.lit("")) == "") | (low_scale == high_scale)
        per_share = F.lower(clause).rlike(r"^(?:eps|earnings per)\b")
        lead = F.lower(F.coalesce(F.get(clauses, i - 1), F.lit("")))
        method = F.when(per_share, F.coalesce(_group(lead, r"\b(adjusted|non-gaap|gaap|diluted)\W+(?:diluted\W+)?$"), F.lit("unspecified"))).otherwise("reported")
        unit = F.when(per_share & (F.coalesce(high_scale, F.lit("")) == ""), 1.0).when(~per_share & same, factor)
        metric = F.when(per_share, "eps").when(F.lower(clause).rlike(r"^(?:revenue|sales)"), "revenue")
        return F.struct(metric.alias("metric"), method.alias("method"), (_number(part(1)) * unit).alias("low"), (_number(part(3)) * unit).alias("high"))

    return F.filter(F.transform(clauses, read), lambda x: x["metric"].isNotNull() & (x["low"] <= x["high"]))


def guidance_ranges(releases: DataFrame, keys: list[str], filed: str = "filing_date", html: str = "html") -> DataFrame:
    """Explicit ranges per release, fiscal period, metric and method.

    The year must be near the filing.  Ranges of the same period and method that
    contradict each other are all left out.  The excerpt is the whole line.
    """
    d = guidance_lines(releases, html)
    d = d.where(F.col("fiscal_year").between(F.year(filed) - 1, F.year(filed) + 2))
    found = d.select(*keys, "fiscal_year", "fiscal_period", F.col("line").alias("excerpt"), F.inline(stated_ranges(F.col("line"))))
    one = F.col("_lo").eqNullSafe(F.col("_lo2")) & F.col("_hi").eqNullSafe(F.col("_hi2"))
    return (
        found.groupBy(*keys, "fiscal_year", "fiscal_period", "metric", "method")
        .agg(F.min("low").alias("_lo"), F.max("low").alias("_lo2"), F.min("high").alias("_hi"), F.max("high").alias("_hi2"), F.min("excerpt").alias("excerpt"))
        .where(one)
        .select(*keys, "fiscal_year", "fiscal_period", "metric", "method", F.col("_lo").alias("low"), F.col("_hi").alias("high"), "excerpt")
    )


def explicit_target(text: Column) -> tuple[Column, Column]:
    """The first date after a form of the verb end, ISO or by month name, and the one currency a sentence names."""
    low = F.lower(text)
    tail = F.try_element_at(F.split(low, r"\bend(?:s|ed|ing)?\b", 2), F.lit(2))
    iso = F.try_to_date(F.regexp_extract(tail, r"^\D*(\d{4}-\d\d-\d\d)\b", 1), "yyyy-MM-dd")
    named = r"\b(" + "|".join(MONTHS) + r")\W+(\d{1,2})\W+(\d{4})\b"
    month = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.regexp_extract(tail, named, 1))
    text_date = F.concat_ws("-", F.regexp_extract(tail, named, 3), month.cast("string"), F.regexp_extract(tail, named, 2))
    day = F.coalesce(iso, F.when(month > 0, F.try_to_date(text_date, "yyyy-M-d")))
    named_ones = [F.when(reduce(lambda a, b: a | b, [F.concat(F.lit(" "), low, F.lit(" ")).rlike(rf"[^a-z]{w.replace(".", chr(92) + ".").replace("$", chr(92) + "$")}[^a-z]") for w in words]), code) for code, words in CURRENCIES.items()]
    currencies = F.array_compact(F.array(*named_ones))
    return day, F.when(F.size(currencies) == 1, currencies[0])


def discovered_links(pages: DataFrame, key: str, html: str, kinds: str | None = None, hosts: tuple[str, ...] | None = None, url: str | None = None, per_page: int | None = None) -> DataFrame:
    """Links of each page with their position, made absolute against ``url`` where that is given, each target once.

    ``kinds`` is a pattern that target or label must meet, ``hosts`` those that
    a target may be on, with their subdomains; only links that pass count
    towards ``per_page``, which is no limit by default.
    """
    found = F.transform(links(F.col(html)), lambda x, i: F.struct(i.alias("position"), x["href"].alias("href"), visible_text(x["label"]).alias("label")))
    if url is not None:
        base = F.col(url)
        origin, folder = F.regexp_extract(base, r"^([^:/?#]+://[^/?#]*)", 1), F.regexp_extract(base, r"^([^:/?#]+://[^?#]*/)", 1)
        scheme = F.regexp_extract(base, r"^([^:/?#]+:)", 1)

        def absolute(x: Column) -> Column:
            h = F.trim(x["href"])
            whole = F.when(h.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), h).when(h.startswith("//"), F.concat(scheme, h)).when(h.startswith("/"), F.concat(origin, h)).otherwise(F.concat(F.when(folder == "", F.concat(origin, F.lit("/"))).otherwise(folder), h))
            return F.struct(x["position"].alias("position"), F.regexp_replace(whole, "#.*$", "").alias("href"), x["label"].alias("label"))

        found = F.transform(found, absolute)
    if kinds is not None:
        found = F.filter(found, lambda x: x["href"].rlike(kinds) | x["label"].rlike(kinds))
    if hosts is not None:
        allowed = "|".join(h.replace(".", r"\.") for h in hosts)
        found = F.filter(found, lambda x: x["href"].rlike(rf"(?i)^https?://(?:[^/?#:]*\.)?(?:{allowed})(?:[:/?#]|$)"))
    if url is not None:  # a target keeps its first place
        found = F.filter(found, lambda x: F.array_position(F.transform(found, lambda y: y["href"]), x["href"]) == F.array_position(F.transform(found, lambda y: y["position"]), x["position"]))
    return pages.select(key, F.inline(found if per_page is None else F.slice(found, 1, per_page)))
