"""The corpus pipeline over ``documents``: stages applied in order, each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tickweave.llm.common import documents, saved
from tickweave.llm.line_dedup import dedup_lines
from tickweave.llm.ngram_join import keep_one
from tickweave.llm.packing import pack_documents
from tickweave.llm.quality import quality_rules
from tickweave.llm.secrets import mask_secrets


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality rules: rejected documents go, the others stay as they are."""
    return quality_rules(docs, keep_columns=True)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line dedup: later repeated runs go out of the texts; a document that loses every line goes."""
    return dedup_lines(docs, drop_emptied=True).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: one document of each group of linked ones stays, that with the least doc_id."""
    return keep_one(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secret scans: every secret is masked in the text; no document goes."""
    return mask_secrets(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packing: every token of every kept document lies in one piece of one sequence."""
    return pack_documents(docs)


#: (name, function); each function takes (spark, docs, sf_dir).
STAGES = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_copies),
    ("secret scans", secrets),
    ("packing", pack),
]

#: Tokenisation and packing have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the ``documents`` of ``sf_dir``; what a stage returns is written to the shared
    folder and read again as the next stage's documents."""
    docs = documents(spark, sf_dir)
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = saved(docs, f"pipeline-{i}-{name.replace(' ', '_')}")
    return docs
