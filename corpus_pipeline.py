"""A training corpus from raw documents: toxicity, exact and near copies, benchmark leaks, packing.

Each stage takes what its predecessor kept and returns the columns of ``documents``; the
last one returns packed pieces. Counted as part of ``tessellar.llm``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessellar.llm.decontaminate import drop_contaminated
from tessellar.llm.exact_dedup import DigestIndex, drop_exact_copies
from tessellar.llm.minhash import drop_near_copies
from tessellar.llm.packing import pack
from tessellar.llm.toxicity import drop_toxic
from tessellar.llm.workspace import Workspace

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model, trained on ``labels``, does not reject.

    A null text is scored as an empty one; equal texts share their verdict, repeated rows
    stay repeated; without labels of both kinds nothing is rejected; no documents give none.
    """
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (but for the case of A-Z), the one with the largest id.

    A null text is an empty one; a null id loses against any; of rows equal in id and text
    one stays; no documents give none.
    """
    ws = Workspace(spark, "exact")
    return drop_exact_copies(docs, DigestIndex(spark, ws.path("index")), ws)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the one with the smallest id.

    Texts without words are linked with nothing and stay; rows without id stay only if
    none of their group has one; rows that repeat an id share its verdict; no documents
    give none.
    """
    return drop_near_copies(docs, Workspace(spark, "near"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that ``benchmark`` does not make up a twentieth of.

    Texts and items without words have no hits, so such documents stay, and all do without
    items; repeated rows share their verdict; no documents give none.
    """
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), Workspace(spark, "leaks"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents that are left, packed into sequences.

    A null text is an empty one, of one id; repeated rows are packed each; no documents
    give no pieces.
    """
    return pack(docs, Workspace(spark, "packing"))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity),
    ("exact dedup", exact_dedup),
    ("near dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: The first stage is a trained model and the last one packing; SQL can express neither.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again by the next."""
    ws = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = ws.write(docs, f"stage{i}")
            if i:
                ws.drop(f"stage{i - 1}")
    return docs
