"""Corpus pipeline: stages over documents, each one operator of briskbi.llm.

A stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next stage's docs; all but the last return the
columns of documents.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from briskbi.llm import decontaminate, ngram_join, packing, substring, toxicity
from briskbi.llm.shared import keep, read
from briskbi.session import ensure_checkpoint_dir


def _named_apart(docs: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """Docs whose further columns have names no operator gives its own, and the way back to their names."""
    names = [c if c in ("doc_id", "text") else f"_column{i}" for i, c in enumerate(docs.columns)]
    return docs.toDF(*names), lambda df: df.select(*names).toDF(*docs.columns)


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    own, back = _named_apart(docs)
    model = toxicity.fit(own, read(spark, sf_dir, "labels"))
    return back(toxicity.score(own, model, carry=tuple(own.columns)).where("predicted = 0"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked document rows one stays: the smallest id (null last), then the smallest hash of the row.

    Rows go by id and hash of the whole row, so ids may repeat, be shared by other texts or be null;
    of rows alike in all columns one stays.
    """
    own, back = _named_apart(docs)
    columns = [f.name for f in own.schema if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    rows = own.withColumn("_row", F.xxhash64(*columns, *[F.col(c).isNull() for c in columns]))
    groups = ngram_join.jaccard_components(rows, tie="_row").where("leads is not null")
    fate = keep(groups.groupBy("doc_id", "_row").agg(F.max("leads").alias("leads"), F.count("*").alias("n")).where("not leads or n > 1").select(F.col("doc_id").alias("_id"), F.col("_row").alias("_other"), "leads"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_row") == F.col("_other"))
    out = rows.join(fate, same, "left_anti")
    repeated = fate.where("leads")
    if not repeated.isEmpty():
        out = out.unionByName(rows.join(repeated, same, "left_semi").dropDuplicates(["doc_id", "_row"]))
    return back(out)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that repeat anywhere are cut out; every document stays."""
    own, back = _named_apart(docs)
    spans = substring.duplicate_spans(own, carry=tuple(own.columns))
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    length = own.columns[docs.columns.index("n_chars")]
    return back(spans.withColumn("text", text).withColumn(length, F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col(length))))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    own, back = _named_apart(docs)
    hits = decontaminate.decontaminate(own, read(spark, sf_dir, "benchmark"), carry=tuple(own.columns))
    return back(hits.where("n_hit = 0"))


def packed_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's tokens, in sequences: one row per piece."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity_filter),
    ("ngram_jaccard", near_duplicates),
    ("substring_dedup", substring_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("packing", packed_pieces),
]

#: The scores of the first stage and the cuts of the last cannot be stated in SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is written to the shared folder and read again."""
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = read(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return out
        out.write.parquet(f"{folder}/{i}-{name}")
        docs = spark.read.parquet(f"{folder}/{i}-{name}")
    return docs
