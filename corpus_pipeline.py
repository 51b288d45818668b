"""Documents to token ids: toxic documents go, one of each group of near copies stays, documents that hold benchmark items go, secrets are masked, and what is left is cut into pieces."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opsgraph.llm import decontaminate, pieces, secretscan, simhash, toxicity
from opsgraph.llm.common import packed, saved, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


#: Rows that a Python worker gets at once: bounds what it holds of texts.
BATCH = 500


#: Shuffle files go when the action that made them ends. A stage has hundreds of small actions whose results are written; their files would stay until the driver's garbage is collected.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def bounded(stage: Stage) -> Stage:
    """The stage, in a session whose Arrow batches have at most BATCH rows and that keeps no shuffle files of what is done."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        name = "spark.sql.execution.arrow.maxRecordsPerBatch"
        if not 0 < int(spark.conf.get(name, "0")) <= BATCH:
            spark.conf.set(name, str(BATCH))
        spark.conf.set(CLEANUP, "true")
        return stage(spark, docs, sf_dir)

    return run


@bounded
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below the threshold by a model fitted on labels outside the held-out fold.

    Null and empty texts have the score of no evidence and stay; repeated rows are scored alike. Without
    labels of both classes nothing is told apart: with none, or clean ones only, all stay.
    """
    model = toxicity.learn(docs, toxicity.learnable(table(spark, sf_dir, "labels")))
    return toxicity.score(packed(docs, text=F.col("text")), model).where(F.col("toxicity") < toxicity.THRESHOLD).select(*(F.col("_row").getField(c).alias(c) for c in docs.columns))


@bounded
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document of least doc_id (simhash.deduplicated): texts whose sets of five-word shingles are 0.8 alike, or whose fingerprints link.

    Null and empty texts are copies of each other. Of equal rows one stays; rows that repeat a doc_id
    with another text are documents of their own; rows with a null doc_id stay. An empty table stays empty.
    """
    return simhash.deduplicated(docs)


@bounded
def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item leaks (decontaminate.leaks). Null and empty texts stay, as do repeated rows; with an empty benchmark all stay."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


@bounded
def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets (secretscan.find) masked and n_chars counted anew where a text changed. Null texts stay null; no row goes."""
    return secretscan.redact(docs)


@bounded
def to_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_pieces and piece_ids; the ids decode to the masked text. Other columns go.

    A null text has null ids and an n_pieces of 0, an empty one no ids. Repeated rows are cut alike.
    """
    found = pieces.encode(docs.select("doc_id", "lang", "source", "text"))
    return found.select("doc_id", "lang", "source", F.coalesce(F.size("piece_ids"), F.lit(0)).alias("n_pieces"), "piece_ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("near copies", drop_near_copies),
    ("decontamination", drop_leaks),
    ("secrets", mask_secrets),
    ("pieces", to_pieces),
]

#: Fitted models and sampled pieces are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over all documents, each one's result written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
