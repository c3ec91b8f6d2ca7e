"""From raw documents to packed training sequences, stage by stage.

Every stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept and returns
a DataFrame, which ``run`` writes as Parquet to the shared folder and reads again as the
next stage's documents. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from fusewright.functions.storage import discard, materialize, scope
from fusewright.llm import decontamination, line_dedup, packing, quality_rules, simhash
from fusewright.llm.common import table

#: Shingles of five words, similarity of 0.8 or more.
NEAR_WORDS, NEAR_SIMILARITY = 5, 0.8
TOKENIZER = "word_bpe_49k.json"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the adaptive rules keep. A null or empty text fails the base rule; repeated rows share a verdict; an empty table stays empty."""
    return quality_rules.filter_documents(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that are alike an earlier one. A null text stays null; a document that loses all its lines stays with an empty text."""
    return line_dedup.dedup_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates. Texts without words are one group; of rows equal in doc_id and text one stays; a null doc_id comes first."""
    return simhash.remove_near_duplicates(docs, NEAR_WORDS, NEAR_SIMILARITY)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Null and empty texts hold none; an empty benchmark removes none."""
    return decontamination.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all documents' pieces in sequences of 4096 tokens. A null or empty text is one piece, a very long one many; no documents give no rows."""
    return packing.pack_documents(docs, public_tokenizers.path(TOKENIZER))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("simhash near-dedup", near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("best-fit packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage writes on its way is deleted once its result is written, and that once the next one's is."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        with scope(spark) as keep:
            result = keep(materialize(stage(spark, docs, sf_dir), name.replace(" ", "-")))
        if k:
            discard(spark, docs)
        docs = result
    return docs


#: Tokenisation and min-wise bands are beyond SQL; tests compare ``run`` with a brute-force version.
ORACLE_SQL = None
