"""A corpus pipeline: toxic texts and copies go, sources are mixed, documents are packed.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next stage's documents.  All but the
last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerweave.llm import exact_dedup, mixing, ngram_join, packing, toxicity
from ledgerweave.llm.common import table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that score 0.5 or more go.

    Null text counts as empty and is scored as such; without labels of both kinds
    all rows have one score; rows that repeat an id are scored each by its text.
    """
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for blanks, one row with the smallest id stays; null and empty texts are equal."""
    return exact_dedup.drop_exact_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents (five-word shingles, Jaccard 0.8), the smallest id stays.

    Rows that share an id are one document, which stays or goes as a whole; so are
    those without an id, which go where they are linked with one that has an id.
    Texts without words are linked with nothing.
    """
    groups = ngram_join.jaccard_components(docs, width=5, percent=80)
    gone = groups.filter(~F.col("component_id").eqNullSafe(F.col("doc_id"))).select(F.col("doc_id").alias("gone")).distinct()
    named = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    own = named[f"c{docs.columns.index('doc_id')}"].cast("long")
    return named.join(gone, own.eqNullSafe(gone["gone"]), "left_anti").toDF(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it, twice at most.

    Null is a source of its own; a text without words counts no words and comes
    as often as its source's whole copies, or once more; an id in two sources is
    two documents.
    """
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 2048 ids: one row a piece; null and empty texts hold the end id alone, copies of an id are packed each by itself."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("ngram_jaccard_join", drop_near_copies),
    ("mixing", mix),
    ("best_fit_packing", pack),
]

#: The first stage is a trained model, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
