"""The registered queries: their SQL, their columns, and the pipeline against a plain version."""

import re

import corpus_pipeline
import pytest
from oracle import check
from pyspark.sql import functions as F

from arcflow.llm import queries

QUERIES, SQL = queries.queries(), queries.oracle_sql()


@pytest.mark.parametrize("name", SQL)
def test_against_sql(spark, small, name):
    check(spark, small, QUERIES[name], SQL[name])


COLUMNS = {
    "op1_language": ("doc_id", "held_out", "lang_pred", "score"),
    "op2_fingerprints": ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"),
    "op3_sentencepiece": ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256"),
    "op7_language_model": ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"),
    "op8_html_text": ("page_id", "url", "text", "n_chars"),
    "op10_toxicity": ("doc_id", "held_out", "score", "predicted"),
}


@pytest.mark.parametrize("name", COLUMNS)
def test_columns_and_rows(spark, small, name):
    got = QUERIES[name](spark, small)
    assert set(COLUMNS[name]) <= set(got.columns)
    source = "pages" if name.startswith("op8") else "documents"
    assert got.count() == spark.read.parquet(f"{small}/{source}.parquet").count()


def test_pipeline(spark, tmp_path):
    """Planted cases go, clean documents stay, and what each stage decides holds for the next."""
    words = lambda name, n: " ".join(f"{name}{k}" for k in range(n))
    rows = [(k, words(f"clean{k}w", 60)) for k in range(12)]
    rows += [(20, words("copy", 60)), (21, words("copy", 60)), (22, words("copy", 60) + " more")]
    rows += [(30, words("start", 30) + " " + words("shared", 55)), (31, words("other", 30) + " " + words("shared", 55) + " tail end")]
    rows += [(40, words("before", 20) + " " + words("exam", 12) + " " + words("after", 20)), (41, None), (42, "")]
    rows += [(k, words(f"bad{k}w", 40) + " vile insult") for k in range(50, 80)]
    rows += [(k, words(f"good{k}w", 40) + " fine day") for k in range(80, 200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 1, int(k < 80)) for k in range(50, 200)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, words("exam", 12))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "substrings", "decontamination", "pieces"]
    ids = lambda d: {r["doc_id"] for r in d.select("doc_id").collect()}
    state, left = docs, []
    for _, stage in corpus_pipeline.STAGES:
        state = stage(spark, state, str(tmp_path))
        left.append(ids(state))
        if len(left) < 5:
            assert state.columns == list(corpus_pipeline.COLUMNS)
        if len(left) == 3:
            kept = {r["doc_id"]: r for r in state.collect()}
    every = {k for k, _ in rows}
    assert left[0] == every - set(range(50, 80))
    assert left[1] == left[0] - {21, 22} and left[2] == left[1]
    assert kept[31]["text"] == words("other", 30) + " tail end" and kept[31]["n_chars"] == len(kept[31]["text"])
    assert kept[30]["text"] == dict(rows)[30]
    assert left[3] == left[2] - {40} and left[4] == left[3]
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in got} == left[4]
    texts = {k: (kept[k]["text"] or "") for k in left[4]}
    assert all(r["decoded"] == texts[r["doc_id"]] and r["n_tokens"] == len(r["ids"]) and re.fullmatch(r"\d+", str(r["ids"][-1])) for r in got)
