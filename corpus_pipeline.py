"""Training-data pipeline over the ``documents`` table: quality, exact copies, near copies,
mix of sources, packing. Each stage takes ``(spark, docs, sf_dir)`` and works on all rows
the stage before kept; all but the last return the columns of ``documents``.

* ``quality``: documents that the scorer rejects go.
* ``exact_dedup``: of equal texts the row with the largest identifier stays.
* ``near_dedup``: of a group of near duplicates the row with the smallest identifier stays.
* ``mixing``: sources that fall short of their target weight get more copies of their
  documents (rows repeat, under their identifier); none is lost.
* ``packing``: the copies as pieces of sequences.

Empty tables pass through every stage; see the operators for nulls and ties.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pagemill.llm.common import documents, read_back
from pagemill.llm.exact_dedup import without_duplicates
from pagemill.llm.jaccard_join import one_of_each
from pagemill.llm.mixing import mixed
from pagemill.llm.packing import pack
from pagemill.llm.quality import good_documents

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return good_documents(docs.select(*COLUMNS))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs)


STAGES = [
    ("quality", quality), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("packing", packing),
]

#: The fitted scorer and the tokeniser have no form in SQL; tests compare each stage with its brute-force result.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read back for the next."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = read_back(stage(spark, docs, sf_dir), name)
    return docs
