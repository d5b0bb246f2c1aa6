"""From raw documents to a mixed training corpus, in five stages.

``STAGES`` lists (name, function); each function takes ``(spark, docs, sf_dir)``
and returns a DataFrame, which is written as Parquet and read again as the
next one's ``docs``. All but the last return the columns of ``documents``.

1. toxicity: documents scored as toxic go.
2. simhash: one document of each group of near-duplicates stays.
3. decontamination: passages of the benchmark are cut from the texts.
4. secrets: secrets are replaced in the texts.
5. mixing: copies of each document, so that the sources meet their targets;
   documents with no copy go. The rows are those of ``documents`` with
   ``copies, taken, size, source_size, target``.

Defined cases: null and empty texts pass all stages (as a text of no words, one
of them stays) and take no words of the mix; rows with a null doc_id are no
near-duplicates of others; of rows that repeat a doc_id and a text one stays;
an empty table gives an empty result; further columns pass, whatever their
names, but for those that the last stage adds.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from panelspark.llm import decontam, mixing, secrets, simhash, toxicity
from panelspark.llm.common import saved, ship, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return simhash.keep_first(docs)


def cut_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return decontam.remove_passages(docs, table(spark, sf_dir, "benchmark"))


def replace_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact_documents(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_duplicates),
    ("decontamination", cut_benchmark_passages),
    ("secrets", replace_secrets),
    ("mixing", mix),
]

#: The trees, the fingerprints and the random draws have no form in SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = saved(docs)
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {}
