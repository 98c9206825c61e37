"""The corpus pipeline: five stages, each over all rows that the one before it kept.

Cases that all stages share: documents may hold nulls in any column, repeated rows and further columns, which stay as they are;
an empty table gives an empty table. Null and empty texts are never toxic, contaminated or near copies, and stay. Rows with a null
doc_id take part in toxicity and decontamination; line dedup and near dedup leave them alone. Equal rows have one fate: line
dedup and near dedup take rows that repeat a doc_id with the same text as one document, so all of them stay or go.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from basewright.llm import common, decontaminate, linededup, minhash, packing, toxicity


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the lexicon fitted on the labelled ones rejects go."""
    lexicon = toxicity.fit(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs, lexicon)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated runs of lines go; a document of which nothing stays goes as well. n_chars is that of the text that stays."""
    return linededup.without_repeats(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the least doc_id. Of a doc_id that stands on several texts only the copies go."""
    return minhash.without_near_duplicates(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontaminate.without_contaminated(docs, common.table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of what stays, packed into sequences."""
    return packing.pack_documents(docs, packing.tokenizer_path())


STAGES = [("toxicity", toxic), ("line_dedup", lines), ("near_dedup", near), ("decontamination", benchmark), ("packing", packed)]

#: None: the learned lexicon, the components and the packing have no plain SQL; tests/llm/test_pipeline.py compares run() with plain Python stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet in the shared folder and read again. Only the last stage's folder stays."""
    docs = common.table(spark, sf_dir, "documents")
    base = f"{common.shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{i}-{name}")
        docs = spark.read.parquet(f"{base}/{i}-{name}")
        if i:
            common.removed(spark, f"{base}/{i - 1}-{STAGES[i - 1][0]}")
        common.swept(spark)
    return docs
