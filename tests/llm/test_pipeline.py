import os

import pytest

import corpus_pipeline
from tidemark.llm import minhash, packing
from tidemark.llm.queries import QUERIES, SQL
from tools.compare import compare, connect

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, name):
    assert not compare(QUERIES[name](spark, SF), connect(SF), SQL[name])


def test_queries_without_sql_return_a_row_per_document(spark):
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    for name in ("op4_toxicity", "op6_language_model", "op9_minhash_near_dedup", "op10_secret_scans"):
        got = QUERIES[name](spark, SF)
        assert got.count() == n and got.select("doc_id").distinct().count() == n


def test_stages_decide_and_keep_the_rest(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, rows = docs.columns, {r.doc_id: r for r in docs.collect()}
    toxic = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 1").collect()}
    seen = rows
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), docs.schema)
        assert docs.columns == columns
        now = {r.doc_id: r for r in docs.collect()}
        gone = seen.keys() - now.keys()
        if name == "toxicity":
            assert len(gone & toxic) >= 0.9 * len(toxic & seen.keys()) and len(gone) < 0.4 * len(seen)
        elif name == "minhash_near_dedup":
            groups = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(list(seen.values()), docs.schema), 80).collect()}
            assert gone == {i for i, c in groups.items() if i != c}
        elif name == "benchmark_decontamination":
            texts = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            assert gone == {i for i, r in seen.items() if any(" ".join(t.split()) in " ".join(r.text.split()) for t in texts)}
        else:
            assert not gone and all(now[i].text == r.text for i, r in seen.items() if "[SECRET]" not in now[i].text)
            assert all(len(r.text) == r.n_chars for r in now.values())
        seen = now
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id for r in packed} == seen.keys() and max(r.length for r in packed) <= packing.CAPACITY


def test_stages_of_odd_rows(spark):
    docs = spark.createDataFrame(
        [(None, None, None, None, None, 1.0), (1, "", "en", "s", 0, 2.0), (1, "", "en", "s", 0, 2.0), (2, "password: abcdefghijk", None, "s", 3, None), (3, "same five words in here", "en", None, 5, 1.0), (4, "same five words in here", "en", "s", 5, 1.0)],
        "doc_id long, text string, lang string, source string, n_chars long, toxic_score double")
    for some in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, some, SF)
            assert out.columns == docs.columns
            kept = [r.doc_id for r in out.collect()]
            if some is docs:
                assert sorted(kept, key=str) == ([1, 1, 2, 3, None] if name == "minhash_near_dedup" else [1, 1, 2, 3, 4, None])
        assert corpus_pipeline.STAGES[-1][1](spark, some, SF).count() == (6 if some is docs else 0)


def test_stages_judge_rows_whatever_their_ids(spark, tmp_path):
    copy, passage = "one text that stands here several times over " * 4, "how many stones lie there and why has nobody counted them so far"
    schema = "doc_id long, text string, source string"
    docs = spark.createDataFrame([(None, copy, "a"), (None, copy, "b"), (7, copy, "c"), (7, copy, "d"), (9, copy, "e"), (8, "another text under one id, and nothing like it", "f"), (8, "a third one that shares no five words with any", "g"), (None, "a lone text of a row without an id of its own", "h"), (None, "a text twice there under no id at all", "i"), (None, "a text twice there under no id at all", "j")], schema)
    kept = [tuple(r) for r in corpus_pipeline.minhash_near_dedup(spark, docs, SF).collect()]
    sources = sorted(r[2] for r in kept)
    assert len(sources) == 5 and sources[0] in "cd" and sources[1:4] == ["f", "g", "h"] and sources[4] in "ij"
    spark.createDataFrame([(None, passage), (1, "words that stand nowhere else in all of this")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([(None, f"so {passage} then", "a"), (None, "clean", "b"), (3, passage, "c"), (3, "clean under the same id", "d"), (None, None, "e")], schema)
    assert sorted(r.source for r in corpus_pipeline.benchmark_decontamination(spark, docs, str(tmp_path)).collect()) == ["b", "d", "e"]


def test_run_applies_all_stages(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
