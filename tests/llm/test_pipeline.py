"""The pipeline's stages, each on its predecessor's rows, and the SQL of the queries that have one."""

import os

import corpus_pipeline
import pyarrow as pa
from pyspark.sql import functions as F

import oracle_harness
from llm_cases import docs, rows  # noqa: F401  (fixtures)
from pitchside.llm import queries

SF = "/root/testdata/sf0.001"


def test_stages_take_effect_and_keep_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "line_dedup", "near_dedup", "decontamination", "bpe_encoding"]
    first = docs
    for name, step in corpus_pipeline.STAGES[:-1]:
        docs = step(spark, docs, SF).cache()
        assert docs.columns == columns, name
        counts.append(docs.count())
        assert docs.select("doc_id").distinct().count() == counts[-1]
    assert counts == sorted(counts, reverse=True) and counts[1] < counts[0] and counts[3] < counts[1] and counts[-1] > 0.3 * counts[0]
    # Line dedup cut texts, and n_chars follows.
    assert docs.join(first.select("doc_id", F.col("text").alias("before")), "doc_id").filter("text <> before").count() > 0
    assert docs.filter(F.char_length("text") != F.col("n_chars")).count() == 0
    found = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert found.count() == counts[-1] and found.filter("n_tokens <> length(ids) / 4").count() == 0


def test_run_gives_the_last_stage(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "n_tokens", "ids", "decoded"] and out.count() > 50


def test_stages_make_no_frames_from_rows(spark, monkeypatch):
    """Rows of a list are made into a frame by a second set of Python workers, which stay beside those of the next stages."""
    made, make = [], type(spark).createDataFrame
    monkeypatch.setattr(type(spark), "createDataFrame", lambda self, data, *a, **k: made.append(type(data)) or make(self, data, *a, **k))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, step in corpus_pipeline.STAGES:
        step(spark, docs, SF).count()
    assert set(made) <= {pa.Table}


def test_stages_on_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, step in corpus_pipeline.STAGES[:-1]:
        docs = step(spark, docs, SF)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == 0


def test_stages_on_awkward_documents(spark, docs, rows):
    real = spark.read.parquet(f"{SF}/documents.parquet")
    extra = docs.withColumn("n_removed", F.lit("clash"))  # the awkward rows have clashing columns, n_lines among them
    good = dict(corpus_pipeline.STAGES)
    cut = good["line_dedup"](spark, extra, SF).cache()
    assert cut.columns == extra.columns and {(r.n_removed, r.n_lines) for r in cut.select("n_removed", "n_lines").distinct().collect()} == {("clash", "x")}
    left = lambda df, i: sorted(str(r.text) for r in df.filter(F.col("doc_id").eqNullSafe(i)).collect())
    assert left(cut, None) == ["A row without an id, but with a text of some words.", "None"] and left(cut, 9000) == ["None"] and left(cut, 9001) == [""]
    one = good["near_dedup"](spark, extra, SF)
    assert len(left(one, 9013)) == 1 and not left(one, 9005 if left(one, 9004) else 9004) and len(left(one, None)) == 2 and left(one, 9000) == ["None"]
    clean = good["decontamination"](spark, extra, SF)
    assert len(left(clean, 9013)) == 2 and left(clean, 9000) == ["None"] and clean.columns == extra.columns
    coded = good["bpe_encoding"](spark, extra, SF)
    assert coded.count() == len(rows) and {r.n_tokens for r in coded.filter("doc_id IN (9000, 9001)").collect()} == {0}
    judged = good["quality_classifier"](spark, extra.drop("n_removed").unionByName(real.select("doc_id", "text"), allowMissingColumns=True), SF)
    assert len(left(judged, 9013)) in (0, 2)


def test_sql_of_the_queries(spark):
    con = oracle_harness.duck(SF)
    for name, sql in queries.ORACLE_SQL.items():
        r = oracle_harness.compare(spark, con, name, SF, queries.QUERIES[name], sql)
        assert r["cols_match"] and r["values_match"], r


def test_every_operator_has_its_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
    assert os.path.exists(queries.TOKENIZER)
