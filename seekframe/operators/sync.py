"""Keeping an index up to date: classification by size and time, merging, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .extract import KEYS, SIZE_CAP, within


def classify(existing: DataFrame, scan: DataFrame, cap: int | None = SIZE_CAP) -> DataFrame:
    """Keys and action of each file: preserved, updated, added, removed or dropped (in the scan, but over the cap; with None no file is).

    One full outer join on the keys; existing and scan have size and mtime_ms.
    """
    old = existing.select(*KEYS, F.col("size").alias("old_size"), F.col("mtime_ms").alias("old_mtime"))
    new = scan.select(*KEYS, F.col("size").alias("new_size"), F.col("mtime_ms").alias("new_mtime"))
    action = (
        F.when(F.col("new_size").isNull(), "removed")
        .when(~within(F.col("new_size"), cap), "dropped")
        .when(F.col("old_size").isNull(), "added")
        .when((F.col("old_size") == F.col("new_size")) & (F.col("old_mtime") == F.col("new_mtime")), "preserved")
        .otherwise("updated")
    )
    return old.join(new, KEYS, "full_outer").withColumn("action", action).select(*KEYS, "action", "old_size", "new_size")


def counters(classified: DataFrame) -> DataFrame:
    """scanned, added, updated, removed; a file over the cap was scanned, and counts as nothing else."""
    is_ = lambda a: F.count_if(F.col("action") == a).alias(a)
    return classified.agg(F.count_if(F.col("action") != "removed").alias("scanned"), is_("added"), is_("updated"), is_("removed"))


def removed(existing: DataFrame, scan: DataFrame) -> DataFrame:
    return existing.join(scan, KEYS, "left_anti").select(*KEYS)


def merge(existing: DataFrame, scan: DataFrame, cap: int | None = SIZE_CAP) -> DataFrame:
    """The new files: preserved ones as they were (in old order), then changed and added ones from the scan (in its order)."""
    actions = classify(existing, scan, cap).select(*KEYS, "action")
    kept = existing.join(actions.where("action = 'preserved'"), KEYS, "left_semi").withColumn("fresh", F.lit(0))
    again = scan.join(actions.where("action in ('updated', 'added')"), KEYS, "left_semi").withColumn("fresh", F.lit(1))
    return kept.unionByName(again.select(kept.columns))


def replace_rows(rows: DataFrame, replaced: DataFrame, fresh: DataFrame) -> DataFrame:
    """Rows of other files, then the fresh ones: an upsert, or a delete where fresh has none."""
    return rows.join(replaced.select(*KEYS).distinct(), KEYS, "left_anti").unionByName(fresh)


def upsert(files: DataFrame, changed: DataFrame, keep) -> DataFrame:
    """Files with changed ones re-indexed; those that ``keep`` (a column of the path) refuses are deleted, which is nothing where they are unknown."""
    return replace_rows(files, changed, changed.where(keep).select(files.columns))


def dedupe(files: DataFrame, order: str = "ord") -> DataFrame:
    """The first file of each key."""
    return files.withColumn("_n", F.row_number().over(Window.partitionBy(*KEYS).orderBy(order))).where("_n = 1").drop("_n")


def language_counts(files: DataFrame, order: str = "ord") -> DataFrame:
    """Files of each language, most first; ties in order of first appearance."""
    return files.groupBy("language").agg(F.count("*").alias("files"), F.min(order).alias("first")).orderBy(F.desc("files"), "first")


def summary(files: DataFrame, symbols: DataFrame, created_at: str, text_lines: DataFrame | None = None) -> DataFrame:
    """One row: counts (of text lines only if they are given), languages as a map, folders, creation time."""
    langs = files.groupBy("language").count().agg(F.map_from_entries(F.collect_list(F.struct("language", "count"))).alias("language_counts"))
    folders = files.agg(F.count("*").alias("file_count"), F.sort_array(F.collect_set("workspace_folder")).alias("workspace_folders"))
    if text_lines is not None:
        folders = folders.join(text_lines.agg(F.count("*").alias("text_line_count")))
    return folders.join(symbols.agg(F.count("*").alias("symbol_count"))).join(langs).withColumn("created_at", F.lit(created_at)).withColumn("version", F.lit(1))


def printed_summary(row, storage: str = "", seconds: float | None = None) -> str:
    """The summary as text, languages by count."""
    out = [f"Files: {row['file_count']}", f"Symbols: {row['symbol_count']}", f"Created: {row['created_at']}", f"Storage: {storage}"]
    if seconds is not None:
        out.append(f"Duration: {round(seconds * 1000)} ms")
    langs = sorted(row["language_counts"].items(), key=lambda x: -x[1])
    return "\n".join([*out, "Languages: " + ", ".join(f"{k}={n}" for k, n in langs)])
