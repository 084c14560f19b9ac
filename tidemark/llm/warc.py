"""WARC archives: written and read by Spark's text source, record bounds verified by following the chain of records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import shared_folder, stage

MAGIC = "WARC/1.0\r\n"
_END = "\r\n\r\n"
#: Records of one file at most: bounds a chain, and so the rounds of pointer jumping.
RECORDS_PER_FILE = 2048
_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"


def sha1_base32(data: Column) -> Column:
    """Bare upper-case base32 of the SHA-1 of a UTF-8 text: five hex digits make four letters."""
    digest = F.sha1(data.cast("binary"))
    groups = [F.lpad(F.conv(F.substring(digest, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def with_keepers(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Adds payload, payload_bytes, payload_digest and refers_to (null for a response).

    Of equal payloads of at least ``min_bytes`` bytes the one with the largest
    page_id is the response.  Repeats are found on digests, aggregated before
    the shuffle; only digests that repeat are joined back, so pages are moved
    only where Spark finds that list too long to send to every task.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    base = pages.select("page_id", F.col("url").cast("string").alias("url"), payload.alias("payload")).withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": sha1_base32(F.col("payload"))})
    keepers = base.where(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest").agg(F.count("*").alias("n"), F.max("page_id").alias("keeper")).where("n > 1").drop("n")
    keepers = stage(keepers, "keepers")
    return base.join(keepers, "payload_digest", "left").withColumn("refers_to", F.when(F.col("page_id") != F.col("keeper"), F.col("keeper"))).drop("keeper")


def record(date: str = "2024-01-01T00:00:00Z") -> Column:
    """One WARC record without its closing blank lines; a revisit has an empty block."""
    revisit = F.col("refers_to").isNotNull()
    line = lambda name, value: F.concat(F.lit(name + ": "), value, F.lit("\r\n"))
    block = F.when(revisit, "").otherwise(F.col("payload"))
    return F.concat(
        F.lit(MAGIC),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">"))),
        F.coalesce(line("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]", "%0A")), F.lit("")),
        line("WARC-Date", F.lit(date)),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        F.when(revisit, F.concat(line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))), line("WARC-Profile", F.lit(_PROFILE)), line("X-Payload-Length", F.col("payload_bytes").cast("string")))).otherwise(""),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
        block,
    )


def write_warc(pages: DataFrame, path: str, min_bytes: int = 0, records_per_file: int = RECORDS_PER_FILE) -> None:
    """A record per row, in files of a bounded number of records, by Spark's committed text writer."""
    with_keepers(pages, min_bytes).select(record().alias("value")).write.option("lineSep", _END).option("maxRecordsPerFile", records_per_file).text(path)


def segments(spark: SparkSession, path: str) -> DataFrame:
    """What lies between two magics, with its place: (file, offset, segment).

    The text source splits files at any byte and cuts at the magic, so a task
    holds one segment at a time.  Offsets are running sums, first inside a
    split and then over a file's few splits.
    """
    raw = spark.read.option("lineSep", MAGIC).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"), (F.octet_length("value") + len(MAGIC)).cast("long").alias("taken"), "value")
    return raw


def _placed(raw: DataFrame, *columns: str) -> DataFrame:
    """Adds ``offset``, the byte at which a segment's magic starts (a file's empty first segment ends at its first magic)."""
    inside = Window.partitionBy("file", "block").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    blocks = raw.groupBy("file", "block").agg(F.sum("taken").alias("all"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = blocks.select("file", "block", F.coalesce(F.sum("all").over(before), F.lit(0)).alias("base"))
    local = raw.withColumn("local", F.coalesce(F.sum("taken").over(inside), F.lit(0)))
    return local.join(base, ["file", "block"]).select("file", (F.col("base") + F.col("local") - len(MAGIC)).alias("offset"), *columns)


def _header(name: str) -> Column:
    return F.regexp_extract("head", rf"(?i)(?:^|\r\n){name}:[ \t]*([^\r\n]*)", 1)


def _described(raw: DataFrame) -> DataFrame:
    """Header fields of each segment, taken as a record: its size, and its payload's length and digest if the segment holds all of it."""
    head = F.substring_index("value", _END, 1)
    whole = raw.withColumn("head", head).withColumn("length", F.expr("try_cast(regexp_extract(head, '(?i)(?:^|\\r\\n)Content-Length:[ \\t]*([0-9]+)', 1) AS bigint)"))
    body = F.col("taken") - len(MAGIC) - F.octet_length("head") - len(_END)  # bytes after the header
    block = F.expr("substring(value, length(head) + 5, length(value) - length(head) - 8)")
    return whole.withColumns({"body": body, "size": len(MAGIC) + F.octet_length("head") + len(_END) + F.col("length") + len(_END)}).withColumns({
        "complete": F.coalesce((F.col("body") == F.col("length") + len(_END)) & F.col("value").endswith(_END), F.lit(False)),
        "kind": F.lower(_header("WARC-Type")),
        "record_id": _header("WARC-Record-ID"),
        "uri": _header("WARC-Target-URI"),
        "stated_digest": F.regexp_replace(_header("WARC-Payload-Digest"), "^sha1:", ""),
        "refers": _header("WARC-Refers-To"),
        "stated_bytes": F.expr("try_cast(regexp_extract(head, '(?i)(?:^|\\r\\n)X-Payload-Length:[ \\t]*([0-9]+)', 1) AS bigint)"),
    }).withColumn("digest", F.when(F.col("complete"), sha1_base32(block)))


def reachable(candidates: DataFrame) -> DataFrame:
    """Of (file, offset, next), those that a chain from the file's start reaches: (file, offset).

    Pointer jumping: each round every candidate's successor becomes its
    successor's successor, and what reached ones point at is reached, so the
    reached part of a chain doubles; one staged job a round.
    """
    nodes = stage(candidates.select("file", "offset", "next", (F.col("offset") == 0).alias("reached")), "chain")
    known = nodes.where("reached").count()
    while known:
        far = nodes.select("file", F.col("offset").alias("next"), F.col("next").alias("far"))
        hop = nodes.join(far, ["file", "next"], "left")
        rows = F.array(
            F.struct("offset", F.col("far").alias("next"), "reached", F.lit(True).alias("own")),
            F.struct(F.col("next").alias("offset"), F.lit(None).cast("long").alias("next"), F.lit(True).alias("reached"), F.lit(False).alias("own")),
        )
        rows = F.when(F.col("reached") & F.col("next").isNotNull(), rows).otherwise(F.slice(rows, 1, 1))
        moved = hop.select("file", F.explode(rows).alias("x")).select("file", "x.*").groupBy("file", "offset").agg(F.max("next").alias("next"), F.max("reached").alias("reached"), F.max("own").alias("own"))
        nodes = stage(moved.where("own").drop("own"), "chain")
        now = nodes.where("reached").count()
        if now == known:
            break
        known = now
    return nodes.where("reached").select("file", "offset")


def _rejoined(spark: SparkSession, path: str, cut: DataFrame) -> DataFrame:
    """Payloads of records that magics inside them cut into several segments: (file, offset, payload)."""
    files = cut.select("file").distinct()
    parts = _placed(segments(spark, path).join(files, "file", "left_semi"), "value").withColumnRenamed("offset", "at")
    span = F.explode(F.sequence(F.floor(F.col("offset") / 65536), F.floor((F.col("end") - 1) / 65536)))
    cut = cut.select("file", "offset", "end", span.alias("bucket"))
    inside = parts.withColumn("bucket", F.floor(F.col("at") / 65536)).join(cut, ["file", "bucket"]).where("at >= offset AND at < end")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "value"))), lambda x: x["value"]), MAGIC)
    whole = inside.groupBy("file", "offset").agg(text.alias("value")).withColumn("head", F.substring_index("value", _END, 1))
    return whole.select("file", "offset", F.expr("substring(value, length(head) + 5, length(value) - length(head) - 8)").alias("payload"))


def read_warc(spark: SparkSession, path: str, payload: bool = False) -> DataFrame:
    """(file, offset, kind, record_id, uri, refers, payload_bytes, payload_digest, intact[, payload]) of the true records.

    Every magic gives a candidate with the offset of its successor; only those
    that the chain from a file's start reaches are records, so a magic inside a
    payload is none.  Length and digest are those of the bytes read, for a
    revisit the stated ones; ``intact`` says whether the digest is the stated.
    Files without a record give none.  ``payload`` adds the block as text.
    """
    found = stage(_placed(_described(segments(spark, path)), "length", "size", "complete", "kind", "record_id", "uri", "stated_digest", "refers", "stated_bytes", "digest").where("offset >= 0"), "candidates")
    kept = reachable(found.where(F.col("size").isNotNull()).select("file", "offset", (F.col("offset") + F.col("size")).alias("next")))
    records = found.join(kept, ["file", "offset"], "left_semi")
    cut = stage(records.where("NOT complete").select("file", "offset", (F.col("offset") + F.col("size")).alias("end")), "cut")
    joined = _rejoined(spark, path, cut)
    if payload:
        block = F.expr("substring(value, length(substring_index(value, '\r\n\r\n', 1)) + 5, length(value) - length(substring_index(value, '\r\n\r\n', 1)) - 8)")
        single = _placed(segments(spark, path), "value").join(records.where("complete").select("file", "offset"), ["file", "offset"], "left_semi").select("file", "offset", block.alias("payload"))
        joined = single.unionByName(joined)
    joined = joined.withColumn("whole_digest", sha1_base32(F.col("payload")))
    out = records.join(joined if payload else joined.drop("payload"), ["file", "offset"], "left")
    revisit = F.col("kind") == "revisit"
    digest = F.when(revisit, F.col("stated_digest")).otherwise(F.coalesce("whole_digest", "digest"))
    return out.select("file", "offset", "kind", "record_id", "uri", F.when(revisit, F.col("refers")).alias("refers"), F.when(revisit, F.col("stated_bytes")).otherwise(F.col("length")).alias("payload_bytes"), digest.alias("payload_digest"), (digest == F.col("stated_digest")).alias("intact"), *["payload"] * payload)


def _page(record_id: Column) -> Column:
    return F.regexp_extract(record_id, r"<urn:page:(-?\d+)>", 1).try_cast("long")


def archived(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Writes the pages as archives in the shared folder and reads them back: a row per page.

    Null html is an empty payload, null page_id comes back null, a null url has
    no header line.  Rows that repeat both page_id and payload are all
    responses.  No rows give none; other columns are not written.
    """
    path = shared_folder(pages.sparkSession, "warc")
    write_warc(pages, path, min_bytes)
    back = read_warc(pages.sparkSession, path)
    return back.select(_page(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", F.col("kind").alias("record_type"), _page(F.col("refers")).alias("refers_to"))


_GROUPS = " || ".join(f"translate(chr(x // 32768 % 32 + 65) || chr(x // 1024 % 32 + 65) || chr(x // 32 % 32 + 65) || chr(x % 32 + 65), '[\\]^_`', '234567')".replace("x ", f"('0x' || substr(h, {5 * i + 1}, 5))::INTEGER ") for i in range(8))
ORACLE = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
d AS (SELECT page_id, payload, CAST(octet_length(encode(payload)) AS BIGINT) AS payload_bytes, sha1(payload) AS h, max(page_id) OVER (PARTITION BY payload) AS keeper FROM p)
SELECT page_id, payload_bytes, {_GROUPS} AS payload_digest, CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> keeper THEN keeper END AS refers_to FROM d
"""
