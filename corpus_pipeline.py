"""The corpus pipeline: documents -> language ID -> toxicity -> near duplicates -> decontamination -> mix.

Each stage takes (spark, docs, sf_dir) and returns what it keeps of docs, whole rows with all columns, whatever their names;
the last adds size, source_size, target and taken (replacing columns of these names). No documents give none. How nulls,
empty texts and repeated rows are judged is told at each stage; very long texts are read whole by all.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabspark.llm import decontaminate, language, lm, mixing, ngram_join, toxicity
from tabspark.llm.queries import quality
from tabspark.llm.store import BROADCAST_KEYS, by_keys, materialize

#: A language less sure than this is no language that the model knows.
LEAST_SURE = 0.3


def _wrapped(docs: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """docs as two columns, text and a row of all others, so that no name can clash and texts travel once; and what makes rows of docs of such again."""
    others = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns) if c != "text"]
    row = F.struct(*others or [F.lit(None).cast("int").alias("none")]).alias("row")
    columns = [F.col("text") if c == "text" else F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns)]
    return docs.select("text", row), lambda found: found.select(*columns)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without a letter (or null, or empty) and those that fit none of the learned languages.

    Only the text decides: null ids, nulls in other columns and repeated rows are judged like any other.
    """
    labelled = docs.select("doc_id", "text", "lang").where(language.learnable(F.col("doc_id")))
    rows, restore = _wrapped(docs)
    found = language.identify(rows, labelled)
    return restore(found.where((F.col("lang_pred") != language.UNDETERMINED) & (F.col("score") >= LEAST_SURE)))


def toxic_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that the toxicity model takes for toxic.

    Null and empty texts stay. Only the text decides: null ids and repeated rows are judged like any other.
    """
    lessons = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic").where(~lm.held_out(F.col("doc_id"), 5))
    rows, restore = _wrapped(docs)
    return restore(toxicity.score(rows, toxicity.fit(docs.select("doc_id", "text"), lessons)).where("predicted = 0"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by similarity 0.8 of their five-word shingles, keeps that of the smallest doc_id.

    A repeated doc_id keeps one row, its smallest by source, lang and text; rows without doc_id are in no group and all stay.
    """
    found = materialize(ngram_join.similar_documents(docs.select("doc_id", "text"), k=5, percent=80).select("doc_id", "component_id"), "groups")
    dropped = materialize(found.where("doc_id <> component_id").select("doc_id").distinct(), "dropped")
    kept = by_keys(docs, dropped, "doc_id", "left_anti").select(*docs.columns)
    repeated = materialize(found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    if repeated.isEmpty():
        return kept
    few = repeated.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    again = F.broadcast(repeated) if few else repeated
    order = Window.partitionBy("doc_id").orderBy("source", "lang", "text")
    one = kept.join(again, "doc_id", "left_semi").withColumn("_n", F.row_number().over(order)).where("_n = 1")
    return kept.join(again, "doc_id", "left_anti").select(*docs.columns).unionByName(one.select(*docs.columns))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that hold at least 0.8 of a benchmark item's five-word shingles, each row by its own text, with or without doc_id."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    row = next(x for x in ("_row" + "_" * i for i in range(len(docs.columns) + 1)) if x not in docs.columns)
    rows = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    found = decontaminate.contaminated(rows.select(F.col(row).alias("doc_id"), "text"), items)
    found = materialize(found.select(F.col("doc_id").alias(row)).distinct(), "leaks")
    return by_keys(rows, found, row, "left_anti").select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixes the sources; keeps what the mix takes, whole rows with all columns, and how many words of each (repeats counted).

    A null source is a source, a null or empty text has no words and is never taken, repeated rows are rows like any other.
    """
    return mixing.mix(docs, quality(), (5, 2, 1), 1.5, 2.0, carry=True).where("taken > 0")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("toxicity", toxic_text),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontaminated),
    ("mixing", mixed),
]

#: The stages learn models, which SQL doesn't.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each one's rows are written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs, name)
    return docs
