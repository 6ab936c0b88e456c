"""A training-data pipeline over the documents table, in stages that are written and read again.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the columns of documents.

Defined cases, stage by stage: a null text is empty; it is not toxic, one of several empty texts stays, it resembles
nothing, is mixed in once and encodes to no ids. A null doc_id is kept by the first stage, last among equal texts, and
never dropped as a near copy. Repeated rows are equal texts, so one stays. Texts of any length are read whole. An empty
table, or labels that teach nothing, pass through every stage. Further columns, whatever their names, are kept by all
but the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hunkmill.llm import exact_dedup, jaccard_join, mixing, sentence_pieces, toxicity
from hunkmill.llm.common import arrow_rows, materialise, table, tidy
from hunkmill.llm.queries import tokenizer_path


#: Rows of an Arrow batch: whole texts are large, and a stage's memory grows with what is under way.
BATCH_ROWS = 500


def small_batches(stage):
    """The stage with small Arrow batches; they hold for the job that writes its result, and run() restores them."""

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
        return stage(spark, docs, sf_dir)

    return run


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.repeat_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sentence_pieces.report(docs, tokenizer_path("piece_bpe_32k.model"))


STAGES = [
    ("toxicity", small_batches(drop_toxic)),
    ("exact dedup", drop_copies),
    ("n-gram jaccard join", small_batches(drop_near_copies)),
    ("mixing sources", mix_sources),
    ("sentencepiece", small_batches(encode)),
]

#: The classifier's scores have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


@tidy
def _run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows, written; the tables between the stages are deleted."""
    with arrow_rows(spark, BATCH_ROWS):
        return _run(spark, sf_dir)
