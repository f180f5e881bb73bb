"""The corpus pipeline: classify, dedup lines, dedup documents, mix, encode.

Every stage takes the columns of ``documents`` (more may be there and stay) and follows its operator's
rules for odd rows, which its docstring sums up. An empty table stays empty through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioquery.llm.cluster import discard, materialise
from folioquery.llm.line_dedup import drop_repeated_lines
from folioquery.llm.mixing import mix_sources
from folioquery.llm.pieces import encode_documents
from folioquery.llm.quality import fit_quality, score_quality
from folioquery.llm.queries import piece_model
from folioquery.llm.simhash import drop_near_duplicates


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on the labels of ``sf_dir``, gives a score of 0.5 or more.

    Null and empty texts have the score of a text of no bytes; repeated rows and rows without id are judged one by one.
    Without labels of both kinds every score is the share of good labels, so all rows stay or all go. A column
    ``quality_score`` of the input stays as it is.
    """
    labelled = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = fit_quality(labelled, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    own = docs.withColumnRenamed("quality_score", "__own_score")
    kept = score_quality(own, model).where(F.col("quality_score") >= 0.5).select(*own.columns)
    return kept.withColumnRenamed("__own_score", "quality_score")


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that five or more of them repeat; ``n_chars`` is counted anew.

    A null text becomes the empty one. Of equal lines the largest doc_id keeps its own; rows without id keep none and count for none.
    Columns ``n_lines`` and ``n_dropped`` of the input stay as they are.
    """
    clash = {c: f"__own_{c}" for c in ("n_lines", "n_dropped") if c in docs.columns}
    out = drop_repeated_lines(docs.withColumnsRenamed(clash)).drop("n_lines", "n_dropped")
    out = out.withColumnsRenamed({v: k for k, v in clash.items()}).select(*docs.columns)
    return out.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else out


def dedup_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8.

    The smallest doc_id of a group stays; rows without id only where none of the group has one; of repeated rows one. Null and
    empty texts are copies of each other.
    """
    return drop_near_duplicates(docs, width=5, similarity=0.8)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many tokens as 80 % of the input's, at the target weights; a document taken in several epochs stands several times.

    A null language or source is a leaf of its own, "(none)"; rows that share an id are drawn together, ties by id.
    """
    return mix_sources(docs, budget_percent=80)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document: doc_id, lang, source, n_tokens, piece_ids. Null and empty texts have the end id alone."""
    return encode_documents(docs.select("doc_id", "lang", "source", "text"), piece_model()).select(
        "doc_id", "lang", "source", F.size("piece_ids").cast("long").alias("n_tokens"), "piece_ids"
    )


STAGES = [
    ("quality", keep_quality),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_near_copies),
    ("mix", mix),
    ("encode", encode),
]

#: SQL can express neither the classifier nor the codes.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder, reread by the next and deleted after it."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
