"""A training corpus from raw documents, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; between stages the documents are
written as Parquet to the shared folder and read again.  All stages but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seekframe.llm import decontam, langid, ngram_join, secrets, sentencepiece
from seekframe.llm.blocks import read, written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language: those without a letter or a clear language go. Learnt outside fold 2 of 4.

    What is clear follows from the number of languages learnt and the scores of the labelled documents in fold 2.
    """
    held_out = langid.fold("doc_id", 4) == 2
    net = langid.fit(docs.where(~held_out))
    rest = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text"))  # whatever their names
    row = docs.select("text", rest.alias("row"), (held_out & F.col("lang").isin(net.languages)).alias("known"))
    scored = written(langid.predict(row, net), "languages")
    least = langid.least_score(scored.where("known"), len(net.languages))
    return scored.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= least)).select(*("text" if c == "text" else f"row.`{c}`" for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: that of the smallest id. Documents without words or id all stay.

    Rows that repeat an id are documents of their own by their texts; of equal ones the first by the other columns stays
    (those that have no order, maps, count as their JSON).  Further columns stay, whatever their names.
    """
    words = F.coalesce("text", F.lit("")).rlike("[^\\x20\\x09-\\x0D]")
    lone = F.col("doc_id").isNull() | ~words
    joined = ngram_join.join(docs, detail=True).where("n_shingles > 0 and doc_id = component_id")
    rows_of = joined.groupBy("grp", "doc_id", "print").agg(F.count("*").alias("n"))
    keep = rows_of.groupBy("grp").agg(F.min(F.struct("doc_id", "print", "n")).alias("first")).select("first.*")
    row = docs.where(~lone).select("doc_id", ngram_join.text_print(F.col("text")).alias("print"), F.struct(*(docs[c] for c in docs.columns)).alias("row"))
    once = row.join(keep.where("n = 1"), ["doc_id", "print"], "left_semi").select("row.*")
    # only rows that repeat id and text meet; they differ in the other columns at most
    place = F.struct(F.lit(0), *(F.to_json(F.struct(f"row.`{c}`")) if "map<" in kind else F.col(f"row.`{c}`") for c, kind in docs.dtypes if c not in ("doc_id", "text")))
    again = row.join(keep.where("n > 1"), ["doc_id", "print"], "left_semi").groupBy("doc_id", "print").agg(F.min_by("row", place).alias("row")).select("row.*")
    return once.unionByName(again).unionByName(docs.where(lone))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontam.clean(docs, read(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mark."""
    return secrets.redact(docs, secrets.fit(docs))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their piece ids."""
    return sentencepiece.encode(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secret_scan),
    ("pieces", pieces),
]
#: No SQL for a trained network or piece merges: the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the documents of sf_dir."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
