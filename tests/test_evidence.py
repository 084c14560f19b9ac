"""Canonical payloads, revisions and documents as evidence."""

import datetime as dt
import hashlib
import json
import random

from pyspark.sql import functions as F

from tidemark.operators import evidence as V

TS = dt.datetime(2024, 1, 1)


def _forms(spark, texts):
    return [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, p string").orderBy("i").select(V.canonical(F.col("p"))).collect()]


def test_spellings_of_one_payload_share_a_form(spark):
    same = ['{"b": 1.0, "a": [1, 2.50, 1e2, null, true], "c": {"z": "1.0, 2e1", "y": {}}}', ' {"c":{"y":{},"z":"1.0, 2e1"},"a":[1.0,2.5,100,null,true],"b":1}', '{"c":{"z":"1.0, 2e1","y":{}},"b":10E-1,"a":[1,25e-1,1.0e+2,null,true]}']
    assert set(_forms(spark, same)) == {'{"a":[1,2.5,100,null,true],"b":1,"c":{"y":{},"z":"1.0, 2e1"}}'}
    assert _forms(spark, ["-0.0", "0", "1.5e-7", "0.00000015", "1e22", "10000000000000000000000", "null", '"\\"a\\" 1.0"']) == ["0", "0", "0.00000015", "0.00000015", "1" + "0" * 22, "1" + "0" * 22, "null", '"\\"a\\" 1.0"']
    others = ['{"a":[1,2]}', '{"a":[2,1]}', '{"a":[1,2.0000001]}', '{"a":["1",2]}', '{"a":[1,2,null]}', '{"b":[1,2]}', '{"a":[[1,2]]}']
    assert len(set(_forms(spark, others))) == len(others)
    assert _forms(spark, ["{bad", "", None, "{} x"]) == [None, None, None, "{}"]


def test_forms_equal_sorted_json(spark):
    rng = random.Random(3)

    def value(depth):
        kind = rng.randrange(7 if depth < 3 else 5)
        if kind == 5:
            return [value(depth + 1) for _ in range(rng.randrange(4))]
        if kind == 6:
            return {rng.choice("abcdeé") + str(rng.randrange(9)): value(depth + 1) for _ in range(rng.randrange(5))}
        return [None, True, rng.randrange(-99, 10**12), rng.choice(["", "x", '1.50"', "é\\", "{1.0}"]), rng.randrange(-999, 999) + 0.5][kind]

    def mixed(v):
        if isinstance(v, dict):
            items = list(v.items())
            rng.shuffle(items)
            return {k: mixed(x) for k, x in items}
        return [mixed(x) for x in v] if isinstance(v, list) else v

    values = [value(0) for _ in range(120)]
    got = _forms(spark, [json.dumps(mixed(v), ensure_ascii=False, indent=rng.choice([None, 1])) for v in values])
    assert got == [json.dumps(v, sort_keys=True, separators=(",", ":"), ensure_ascii=False) for v in values]


def test_events_keep_first_contents_and_set_malformed_aside(spark):
    rows = [(1, '{"a":1,"b":2}', 3), (1, '{"b":2.0, "a":1}', 1), (1, '{"a":1,"b":3}', 2), (1, '{"a":1,"b":2}', 5), (2, "{oops", 1), (2, None, 1)]
    events = V.evidence_events(spark.createDataFrame([(k, p, TS + dt.timedelta(hours=h)) for k, p, h in rows], "record int, payload string, observed_at timestamp_ntz"))
    assert {(r.record, r.malformed, r.payload, r.fingerprint is None) for r in events.where("record = 2").collect()} == {(2, True, "{oops", True), (2, False, None, True)}
    kept = V.first_evidence(events, ["record"], ["observed_at"]).collect()
    assert sorted((r.observed_at.hour, r.payload) for r in kept) == [(1, '{"a":1,"b":2}'), (2, '{"a":1,"b":3}')]
    assert {r.fingerprint for r in kept} == {hashlib.sha256(p.encode()).hexdigest() for p in ('{"a":1,"b":2}', '{"a":1,"b":3}')}


def test_contents_are_counted_and_formed_once(spark):
    rows = [(1, '{"a":1,"b":"1.0 -0"}', 3), (1, '{"b":"1.0 -0", "a":1.0}', 1), (1, '{"a":-0.0,"b":3}', 2), (1, '{"b":3,"a":0}', 5), (1, '{"a":7}', 5), (2, "{oops", 1), (2, None, 1)]
    observed = spark.createDataFrame(rows, "record int, payload string, hour int").repartition(3)
    kept = V.first_evidence(V.evidence_events(observed), ["record"], ["hour"], "observations")
    assert sorted((r.record, r.hour, r.payload, r.observations) for r in kept.collect()) == [(1, 1, '{"a":1,"b":"1.0 -0"}', 2), (1, 2, '{"a":0,"b":3}', 2), (1, 5, '{"a":7}', 1)]
    # Only one operator of the plan computes forms, and rows are not filtered by them.
    forms = [x for x in kept._jdf.queryExecution().optimizedPlan().toString().splitlines() if "regexp_extract_all" in x]
    assert len(forms) == 1 and "Project" in forms[0]


def test_guidance_revisions_have_ids_of_their_own(spark):
    kind = "id string, event_date date, eps_method string, eps_guidance_low string, notes string, captured_at timestamp_ntz"
    day = dt.date(2024, 2, 1)
    rows = [("g1", day, "adj", "1.50", "n", TS), ("g1", day, "adjusted", "1.5", "n", TS + dt.timedelta(days=1)), ("g1", day, "adj", "1.6", "n", TS), (None, day, None, "NaN", None, TS), ("g2", None, "adj", "1", "n", TS)]
    got = V.guidance_rows(spark.createDataFrame(rows, kind), {"eps_method": "method", "eps_guidance_low": "amount", "notes": "text"}).collect()
    ids = [r.source_record_id for r in got]
    assert len(got) == 4 and ids[0] == ids[1] != ids[2] and all(i.startswith("g1:") and len(i) == 3 + V.SHORT for i in ids[:3])
    assert ids[3].startswith("event:") and got[3].eps_guidance_low is None and got[0].eps_method == "adjusted"


def test_documents_are_records_with_reasons(spark):
    later = TS + dt.timedelta(days=1)
    rows = [
        (1, "u1", "<title>Q &amp; A</title><p>Transcript of the conference call</p>" + "<p>x</p>" * 40, TS, None, None),
        (2, "u2", "<p>Quarterly results</p><p>up</p>", TS, TS, "acc-2"), (3, "u3", "<script>1</script>", TS, None, None), (4, "u4", None, TS, None, None), (5, "u5", "<p>soon</p>", TS, later, None),
    ]
    d = spark.createDataFrame(rows, "k int, url string, html string, observed_at timestamp_ntz, published_at timestamp_ntz, accession string")
    got = {r.k: r for r in V.evidence_documents(d, ["k"], kept=60).collect()}
    assert (got[1].kind, got[1].title, got[1].truncated, len(got[1].content), got[1].source, got[1].source_record_id) == ("transcript", "Q & A", True, 60, "issuer", "u1")
    assert (got[2].kind, got[2].title, got[2].source, got[2].source_record_id, got[2].rejected, got[2].truncated) == ("earnings_release", "Quarterly results", "filing", "acc-2", None, False)
    assert got[2].content_hash == hashlib.sha256(b"Quarterly results\nup").hexdigest()
    assert {k: got[k].rejected for k in (3, 4, 5)} == {3: "no_content", 4: "no_content", 5: "published_after_observed"}


def test_fields_by_path(spark):
    d = spark.createDataFrame([('{"audit": {"scope": "all", "n": "x"}}',), ("no",)], "p string")
    paths = {"scope": ("$.audit.scope", "string"), "n": ("$.audit.n", "int")}
    assert [tuple(r) for r in d.select(*V.fields(F.col("p"), paths)).collect()] == [("all", None), (None, None)]
