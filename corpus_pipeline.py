"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept
and returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from prismora.cluster import kept_folder
from prismora.llm import jaccard_join, line_dedup, packing, quality_fm, source_mixing
from prismora.llm._names import fresh
from prismora.llm._shared import local_path, written


def _model_folder(spark: SparkSession, sf_dir: str) -> str:
    return local_path(kept_folder(spark, "quality-model", sf_dir))


def _is_input(spark: SparkSession, docs: DataFrame, sf_dir: str) -> bool:
    """Whether docs is the table of documents in sf_dir, or there is no such table."""
    try:
        return docs.sameSemantics(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    except AnalysisException:
        return True


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine finds of low quality or toxic go.

    Null and empty texts are judged by their statistics and metadata; null
    labels count as good; the order of rows doesn't matter.  The model is kept
    in the shared folder for mixing_stage.
    """
    model = quality_fm.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    if _is_input(spark, docs, sf_dir):
        quality_fm.keep_model(model, _model_folder(spark, sf_dir))
    return quality_fm.drop_rejected(docs, model)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that occurred earlier in the corpus go, and documents of which nothing is left.

    Documents with null or empty text stay, as do blank lines; a null id is an
    id; of rows that repeat id and text one stays; an empty table stays empty.
    """
    return line_dedup.drop_repeated_lines(docs)


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of the least id.

    Documents with a null id, or with null or empty text, stay; of rows that
    repeat id and text one stays; rows of one id with different texts are
    different documents; an empty table stays empty.
    """
    return jaccard_join.drop_near_copies(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture of sources asks, weighted by the quality model; rows without tokens go.

    The model is that of the first stage, fitted on the documents of sf_dir,
    as that stage kept it; where it kept none (other documents, another shared
    folder) the model is fitted on them here.  Null ids, sources and languages are values like others, rows that repeat
    are sampled as rows, and an empty table stays empty.
    """
    model = quality_fm.kept_model(_model_folder(spark, sf_dir))
    if model is None:
        model = quality_fm.train(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    name = fresh(docs, "mix_weight")
    weighted = written(quality_fm.with_quality(docs, model, name), "mix-weights")  # scored once, read twice
    return source_mixing.mix(weighted, weight_col=name).drop(name)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the training sequences.

    Null, empty and white texts get a row without a bin; rows and ids that
    repeat are packed as often as they occur; an empty table gives no rows.
    """
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_stage),
    ("line_dedup", line_stage),
    ("ngram_jaccard_join", near_copy_stage),
    ("source_mixing", mixing_stage),
    ("best_fit_packing", packing_stage),
]

#: The stages from the first on are not expressible in SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; what each keeps is written before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
