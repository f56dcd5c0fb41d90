"""From documents to training sequences: language ID, line dedup, n-gram Jaccard join, mixing, packing.

Each stage works on all rows of the one before and its decisions take effect.
All but the last return the columns of documents; ``n_chars`` is kept right.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymix.llm import jaccard_join, language, line_dedup, mixing, packing
from tallymix.llm.common import shared_folder, small_batches, stored


def _as_documents(df: DataFrame, columns: list[str]) -> DataFrame:
    """Those columns, with n_chars (where there is one) as the text's code points."""
    if "n_chars" in columns and "text" in columns:
        df = df.withColumn("n_chars", F.coalesce(F.char_length("text"), F.lit(0)).cast(df.schema["n_chars"].dataType))
    return df.select(*columns)


def _shielded(docs: DataFrame, made: tuple[str, ...], step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The step's rows with the documents' own columns, also where the step makes columns of the same names."""
    names = {c: f"own_{c}_" for c in docs.columns if c in made}
    out = step(docs.withColumnsRenamed(names))
    return out.select(*(F.col(names.get(c, c)).alias(c) for c in docs.columns))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language models reject go: without a letter, or coded worse than any language's held-back texts allow."""
    small_batches(spark)
    model = language.fit(docs.select("doc_id", "text", "lang"))
    return _shielded(docs, ("lang_pred", "score", "rejected"), lambda d: language.identify(d, model).where(~F.col("rejected")))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go, but for the largest doc_id that holds them."""
    small_batches(spark)
    return _as_documents(_shielded(docs, ("n_lines", "n_dropped", "id_", "keys_"), line_dedup.dedup_lines), docs.columns)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates stays: the one with the least doc_id, a null one only if there is no other.

    Of a component's rows that share that doc_id the first by text stays.  Rows
    of one doc_id, null included, in different components don't touch each
    other; a document without a word is in no component and stays.
    """
    small_batches(spark)
    return _shielded(docs, ("set_id_", "set_", "first_id_", "component_", "n_rows_"), _one_of_each)


def _one_of_each(docs: DataFrame) -> DataFrame:
    keep = jaccard_join.survivors(docs.select("doc_id", "text")).select(*(F.col(c).alias(f"{n}_") for c, n in (("set_id", "set"), ("first_id", "first_id"), ("component", "component"), ("n_rows", "n_rows"))))
    rows = jaccard_join.with_set_id(docs, "set_id_")
    same = (F.col("set_id_") == F.col("set_")) & F.col("doc_id").cast("long").eqNullSafe(F.col("first_id_"))
    again = keep.where("n_rows_ > 1")
    if again.isEmpty():
        return rows.join(keep, same, "left").where("set_id_ is null or set_ is not null").select(*docs.columns)
    alone = rows.join(keep.where("n_rows_ = 1"), same, "left").where("set_id_ is null or set_ is not null").select(*docs.columns)
    others = [c for c in docs.columns if c != "text"]
    first = rows.join(again, same).groupBy("component_").agg(F.min(F.struct("text", *others)).alias("r"))
    return alone.unionByName(first.select("r.*").select(*docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as systematic sampling takes it."""
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows with their sequence and place."""
    small_batches(spark)
    return packing.pack(docs.select("doc_id", "text"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("jaccard_join", dedup_near),
    ("mix_sources", mix_sources),
    ("packing", pack_sequences),
]

#: Language models and tokens are beyond SQL; tests/llm holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), shared_folder(spark)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), folder, name)
    return STAGES[-1][1](spark, docs, sf_dir)
