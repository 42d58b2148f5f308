"""A training-data pipeline: what each stage decides takes effect in the next one's documents.

`STAGES` lists (name, function); each function takes (spark, docs, sf_dir) and returns a
DataFrame, written as Parquet and read again as the next one's `docs`. All but the last
return the columns of `documents` (doc_id, text, lang, source, n_chars).

Each stage decides row by row: nothing is joined back by id, so that a row without an id or
with another one's id has its own result. A null text is empty and stays, except that a
row repeated whole stays once; columns other than the named are left out; an empty
table gives an empty table.
"""

from __future__ import annotations

import atexit
import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcflow.llm import decontaminate, neardup, pieces, substrings, toxicity
from arcflow.plans.cut import ensure_folder

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the factorization machine, learned from `labels`, doesn't call toxic."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.select(*COLUMNS).where(toxicity.scorer(spark, model)(F.col("text"))["predicted"] == 0)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates, that with the smallest id; of repeated rows one.
    Rows without an id, and different texts of one id, are documents of their own, after all others."""
    keys = [F.coalesce("doc_id", F.lit(-(1 << 63))).alias("row_id"), F.xxhash64("text").alias("row_hash")]
    gone = neardup.near_duplicates(docs, rows_apart=True).where("not kept").select(keys[0], F.col("text_hash").alias("row_hash"))
    left = docs.select(*COLUMNS, *keys).join(gone, ["row_id", "row_hash"], "left_anti")
    return left.dropDuplicates(["row_id", "row_hash"]).select(*COLUMNS)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words that a passage of 20 words or more repeats. Texts that lose none stay as they are; texts that lose all go."""
    found = substrings.remove_repeats(docs, carry=("doc_id", "lang", "source")).where("n_removed = 0 or n_removed < n_words")
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    return found.select("doc_id", text.alias("text"), "lang", "source", F.length(text).cast("long").alias("n_chars"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a window of a benchmark item."""
    found = decontaminate.find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), carry=COLUMNS)
    return found.where("n_hit = 0").select(*COLUMNS)


def to_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each text, with an end id, and the text that they decode to."""
    found = pieces.encode_texts(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("substrings", drop_repeated_passages),
    ("decontamination", drop_contaminated),
    ("pieces", to_pieces),
]

#: SQL can express neither the learned scores of the first stage nor the last stage's encoding.
ORACLE_SQL = None


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _delete_if_alive(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is not None:
        _delete(spark, path)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each one's rows lie in the checkpoint folder until the next one's are written, and the last one's until the session ends."""
    ensure_folder(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    try:
        for k, (_, stage) in enumerate(STAGES):
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
            if k:
                _delete(spark, f"{folder}/{k - 1}")
    except BaseException:
        _delete(spark, folder)
        raise
    atexit.register(_delete_if_alive, spark, folder)
    return docs
