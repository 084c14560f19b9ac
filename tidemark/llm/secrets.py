"""Secret scans: plain patterns, and credentials in several parts that are linked within a scope."""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import frugal, slices

#: Plain kinds, then the linked ones, in the order in which spans of one start are listed.
KINDS = ("assign", "access", "hex", "part_id", "part_secret", "part_endpoint")
#: Characters between two parts of one credential, at most.
SCOPE = 160

_VALUE = r"""["']?\x20*[:=]\x20*["']?"""
_ASSIGN = re.compile(rf"(password|passwd|secret|token|api_?key){_VALUE}([A-Za-z0-9+/_.=-]+)", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
#: Weak parts: none is reported alone.
_ID = re.compile(rf"(?:access[_-]?(?:key[_-]?)?id|client[_-]?id|account[_-]?(?:id|name)|user[_-]?(?:id|name)|login){_VALUE}([A-Za-z0-9@._+-]{{3,}})", re.I | re.A)
_SECRET = re.compile(rf"(?:pwd|passphrase|credential|auth|private[_-]?key|secret[_-]?key){_VALUE}([A-Za-z0-9+/_.=!@#$%^&*-]{{4,}})", re.I | re.A)
_RANDOM = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_=-])")
_ENDPOINT = re.compile(rf"\b[a-z][a-z0-9+.-]{{1,15}}://[A-Za-z0-9._~:@-]{{3,}}|(?:endpoint|hostname|host|server|bucket){_VALUE}([A-Za-z0-9._:/-]{{3,}})", re.I | re.A)

Span = tuple[int, int, int]


def plain_spans(text: str) -> list[Span]:
    """(start, kind, end) of assignments, access identifiers and hex strings, leftmost and non-overlapping in each kind."""
    found = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


def _looks_random(word: str) -> bool:
    """Letters and digits mixed, with at least 3.5 bits a character."""
    if not re.search(r"\d", word) or not re.search(r"[A-Za-z]", word):
        return False
    n = len(word)
    return -sum(c / n * math.log2(c / n) for c in Counter(word).values()) >= 3.5


def linked_spans(text: str, base: list[Span], scope: int = SCOPE) -> list[Span]:
    """Weak parts that lie within ``scope`` characters of a complementary part.

    A secret part needs an identifier or an endpoint near it, either of those a
    secret.  Parts are sorted by start, so each asks for one interval of the
    other kind; no pairs are listed.  Plain finds serve as parts but are not
    repeated.
    """
    ids = [(m.start(), m.end()) for m in _ID.finditer(text)]
    ends = [(m.start(), m.end()) for m in _ENDPOINT.finditer(text)]
    secrets = [(m.start(), m.end()) for m in _SECRET.finditer(text)]
    secrets += [(m.start(), m.end()) for m in _RANDOM.finditer(text) if _looks_random(m.group())]
    taken = [(s, e) for s, _, e in base]
    starts, reach = [s for s, _ in taken], []
    for _, e in taken:
        reach.append(max(e, reach[-1]) if reach else e)

    def free(x: tuple[int, int]) -> bool:
        i = bisect_left(starts, x[1]) - 1
        return i < 0 or reach[i] <= x[0]

    weak = {3: sorted(filter(free, ids)), 4: sorted(filter(free, secrets)), 5: sorted(filter(free, ends))}
    parts = {
        3: sorted(weak[3] + [(s, e) for s, k, e in base if k == 1]),
        4: sorted(weak[4] + [(s, e) for s, k, e in base if k != 1]),
        5: weak[5],
    }

    def near(kind: int):
        begin = [s for s, _ in parts[kind]]
        far: list[int] = []
        for _, e in parts[kind]:
            far.append(max(e, far[-1]) if far else e)

        def met(x: tuple[int, int]) -> bool:
            i = bisect_right(begin, x[1] + scope) - 1
            return i >= 0 and far[i] >= x[0] - scope

        return met

    to_id, to_secret, to_end = near(3), near(4), near(5)
    out = {(s, 4, e) for s, e in weak[4] if to_id((s, e)) or to_end((s, e))}
    out |= {(s, k, e) for k in (3, 5) for s, e in weak[k] if to_secret((s, e))}
    return sorted(out)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """(id, kinds, starts, ends) per row: the spans of the whole text by start, then kind; ends exclusive, in code points.

    Null and empty texts have empty lists; repeated rows and ids keep a row each; no rows give none.
    """
    ints = T.ArrayType(T.IntegerType())
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("kinds", ints), T.StructField("starts", ints), T.StructField("ends", ints)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = pa.list_(pa.int32())
        for batch in slices(batches):
            spans = []
            for text in batch.column(1).to_pylist():
                base = plain_spans(text or "")
                spans.append(sorted(base + linked_spans(text or "", base, scope)))
            columns = [pa.array([[x[i] for x in s] for s in spans], lists) for i in (1, 0, 2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "kinds", "starts", "ends"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(frugal(run), schema)


def joined(first_kind: int = 0, last_kind: int = len(KINDS) - 1):
    """The spans of these kinds as ``kind:start:end``, comma-joined."""
    spans = F.arrays_zip("kinds", "starts", "ends")
    names = F.array(*[F.lit(k) for k in KINDS])
    kept = F.filter(spans, lambda x: x["kinds"].between(first_kind, last_kind))
    return F.array_join(F.transform(kept, lambda x: F.concat_ws(":", F.element_at(names, x["kinds"] + 1), x["starts"].cast("string"), x["ends"].cast("string"))), ",")


def secret_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of the plain kinds, the SHA-256 of the plain spans, and all spans as text."""
    count = lambda kind: F.size(F.filter("kinds", lambda x: x == kind)).cast("long")
    found = find_secrets(docs, id_col, text_col)
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(joined(0, 2), 256).alias("base_sha256"), joined().alias("spans"))


def redacted(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]", scope: int = SCOPE) -> DataFrame:
    """The same rows and columns, each found span (overlapping ones as one) replaced by ``mark``; null texts stay null."""
    schema, at = docs.schema, docs.columns.index(text_col)

    def clean(text: str | None) -> str | None:
        if not text:
            return text
        base = plain_spans(text)
        out, done = [], 0
        for s, _, e in sorted(base + linked_spans(text, base, scope)):
            if s >= done:
                out += [text[done:s], mark]
            done = max(done, e)
        return "".join([*out, text[done:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            columns = list(batch.columns)
            columns[at] = pa.array([clean(x) for x in columns[at].to_pylist()], columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(frugal(run), schema)


def digest_of(spans: list[tuple[str, int, int]]) -> str:
    """What base_sha256 holds for these spans; for tests."""
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()
