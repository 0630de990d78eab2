"""Reading trees, and reading and writing indexes.

An index is a folder of snapshots: each holds meta (one row), files, symbols and text_lines (partitioned by shard), and
``current`` names the one to read.  A writer fills a new snapshot and then moves the name, so nothing that is being read
is overwritten.  JSON exports and imports have a row of metadata and one nested row for each file.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.languages import language
from ..functions.text import slashes
from ..operators import extract
from ..operators.extract import KEYS, SIZE_CAP, within
from ..operators.ignore import indexed
from ..operators.sync import classify

VERSION = 1
_SYMBOL = "struct<kind:string,name:string,containerName:string,location:struct<workspaceFolder:string,relativePath:string,line:int,character:int>,signature:string>"
FILE_JSON = f"workspaceFolder string, relativePath string, absolutePath string, language string, size bigint, mtimeMs double, symbols array<{_SYMBOL}>, textLines array<struct<text:string,line:int>>"
TEXT_LINES = "workspace_folder string, relative_path string, line int, text string, ord bigint, shard int"
META_JSON = "version int, storage string, createdAt string, workspaceFolders array<string>, fileCount bigint, symbolCount bigint"


@dataclass
class Index:
    meta: DataFrame
    files: DataFrame
    symbols: DataFrame
    text_lines: DataFrame
    created_at: Column


def scan(spark: SparkSession, root: str, profile: str = "full", ignore: list[str] | None = None, cap: int = SIZE_CAP) -> DataFrame:
    """Files of a tree that are indexed: keys, absolute_path, size, mtime_ms, content. Size and path are tested before content is read."""
    if ignore is None:
        ignore = ignore_lines(spark, root)
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("ignoreCorruptFiles", True).load(root)
    plain = root.removeprefix("file://")
    path = slashes(F.col("path"), plain)
    rows = raw.where(F.col("length") <= cap).withColumn("relative_path", path).where(indexed(F.col("relative_path"), profile, ignore))
    return rows.select(
        F.lit(plain).alias("workspace_folder"), "relative_path", F.col("path").alias("absolute_path"), F.col("length").alias("size"),
        (F.unix_micros("modificationTime") / 1000.0).alias("mtime_ms"), F.make_valid_utf8(F.col("content").cast("string")).alias("content"),
    )


def ignore_lines(spark: SparkSession, root: str, name: str = ".seekframeignore") -> list[str]:
    """Lines of the ignore file at the root; none if there is no such file."""
    if not exists(spark, f"{root}/{name}"):
        return []
    return [r["value"] for r in spark.read.text(f"{root}/{name}").collect()]


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def build(scanned: DataFrame, profile: str = "full", total: int | None = None, limit: int = extract.MOST_LINES, created_at: str | None = None) -> Index:
    """The four tables of a scan (keys, absolute_path, size, mtime_ms, content). ``total``: the budget of text lines of all files."""
    from pyspark.sql import Window

    files = scanned.withColumn("language", language(F.col("relative_path"), profile))
    # ordinals come from paths alone, once, and are joined back to the files; rows of files carry them
    order = files.select(*KEYS).distinct().withColumn("file_ord", (F.row_number().over(Window.orderBy(*KEYS)) - 1).cast("long"))
    files = files.join(order, KEYS)
    symbols = extract.symbols(files, profile, ["file_ord"]).withColumn("ord", F.col("file_ord") * (1 << 32) + F.col("line")).drop("file_ord")
    lines = extract.text_lines(files, limit, ["file_ord"]) if total is None else extract.budgeted_text_lines(files, total, limit).join(order, KEYS)
    lines = lines.withColumn("ord", F.col("file_ord") * (1 << 32) + F.col("line")).drop("file_ord")
    return _index(files.drop("content"), symbols, lines, created_at)


def _index(kept: DataFrame, symbols: DataFrame, lines: DataFrame, created_at: str | None) -> Index:
    stamp = F.lit(created_at) if created_at else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return Index(_meta(kept, symbols, lines, stamp), kept, symbols, lines, stamp)


def _meta(kept: DataFrame, symbols: DataFrame, lines: DataFrame, stamp: Column) -> DataFrame:
    meta = kept.agg(F.count("*").alias("file_count"), F.sort_array(F.collect_set("workspace_folder")).alias("workspace_folders")).join(symbols.agg(F.count("*").alias("symbol_count")))
    meta = meta.join(lines.agg(F.count("*").alias("text_line_count")))
    return meta.select(F.lit(VERSION).alias("version"), F.lit("tables").alias("storage"), stamp.alias("created_at"), "workspace_folders", "file_count", "symbol_count", "text_line_count")


def _with(index: Index, gone: DataFrame, changed: DataFrame, profile: str, limit: int, created_at: str | None) -> Index:
    """The index without the files of ``gone``, and with changed ones extracted anew, after the others in order."""
    fresh = build(changed, profile, limit=limit, created_at=created_at)
    base = (index.files.agg(F.max("file_ord")).first()[0] or 0) + 1
    after = {"files": ("file_ord", base), "symbols": ("ord", base << 32), "text_lines": ("ord", base << 32)}
    keys = gone.select(*KEYS).distinct()
    tables = []
    for name, (order, shift) in after.items():
        old, new = getattr(index, name), getattr(fresh, name).withColumn(order, F.col(order) + shift)
        tables.append(old.join(keys, KEYS, "left_anti").select(old.columns).unionByName(new.select(old.columns)))
    return _index(*tables, created_at)


def synced(index: Index, scanned: DataFrame, profile: str = "full", cap: int | None = SIZE_CAP, limit: int = extract.MOST_LINES, created_at: str | None = None) -> Index:
    """The index brought up to a scan: only files of another size or time, and new ones, are extracted. Files over the cap go; with None none do."""
    actions = classify(index.files, scanned, cap).select(*KEYS, "action")
    changed = scanned.join(actions.where("action in ('updated', 'added')"), KEYS, "left_semi")
    return _with(index, actions.where("action <> 'preserved'"), changed, profile, limit, created_at)


def updated(index: Index, changed: DataFrame, deleted: DataFrame, profile: str = "full", ignore: list[str] | None = None, cap: int | None = SIZE_CAP, limit: int = extract.MOST_LINES, created_at: str | None = None) -> Index:
    """The index after changes of single files: changed (a scan of them) are extracted anew, deleted ones, and those now ignored or over the cap, go.

    A file that is ignored and unknown changes nothing.
    """
    keep = indexed(F.col("relative_path"), profile, ignore or []) & within(F.col("size"), cap)
    return _with(index, changed.select(*KEYS).unionByName(deleted.select(*KEYS)), changed.where(keep), profile, limit, created_at)


def sync_index(spark: SparkSession, path: str, scanned: DataFrame, cap: int | None = SIZE_CAP, **options) -> str:
    """Brings the index at ``path`` up to a scan, as a new snapshot; one that is missing is built, under the same cap."""
    index = read_index(spark, path)
    return write_index(build(scanned.where(within(F.col("size"), cap)), **options) if index is None else synced(index, scanned, cap=cap, **options), path)


def write_index(index: Index, path: str, with_text: bool = True) -> str:
    """Writes a new snapshot and makes it the current one; returns its name."""
    spark = index.files.sparkSession
    name = f"snapshot-{uuid.uuid4().hex}"
    base = f"{path}/{name}"
    for table in ("files", "symbols"):
        getattr(index, table).write.parquet(f"{base}/{table}")
    if with_text:
        index.text_lines.write.partitionBy("shard").parquet(f"{base}/text_lines")
    # counts come from what is written: nothing is extracted again for them
    lines = _text_lines(spark, base) if with_text else index.text_lines
    _meta(spark.read.parquet(f"{base}/files"), spark.read.parquet(f"{base}/symbols"), lines, index.created_at).write.parquet(f"{base}/meta")
    _move_name(spark, path, name)
    return name


def _move_name(spark: SparkSession, path: str, name: str) -> None:
    """Writes the snapshot's name beside ``current`` and renames it over: a reader finds the old name or the new one."""
    fs, p = _fs(spark, f"{path}/current-{name}")
    out = fs.create(p, True)
    out.write(bytearray(name.encode()))
    out.close()
    jvm = spark.sparkContext._jvm
    kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(kind, 1)
    how[0] = kind.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(p).toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    context.rename(fs.makeQualified(p), fs.makeQualified(_fs(spark, f"{path}/current")[1]), how)


def read_index(spark: SparkSession, path: str) -> Index | None:
    """The current snapshot; None if there is none or its version is another."""
    if not exists(spark, f"{path}/current"):
        return None
    base = f"{path}/{spark.read.text(f'{path}/current').first()[0]}"
    meta = spark.read.parquet(f"{base}/meta")
    first = meta.first()
    if first["version"] != VERSION:
        return None
    return Index(meta, spark.read.parquet(f"{base}/files"), spark.read.parquet(f"{base}/symbols"), _text_lines(spark, base), F.lit(first["created_at"]))


def _text_lines(spark: SparkSession, base: str) -> DataFrame:
    # without a line there is no file to take the columns from
    return spark.read.schema(TEXT_LINES).parquet(f"{base}/text_lines") if exists(spark, f"{base}/text_lines") else spark.createDataFrame([], TEXT_LINES)


def clear_index(spark: SparkSession, path: str, text_only: bool = False) -> None:
    """Deletes an index, or the text lines of its current snapshot."""
    if text_only:
        if exists(spark, f"{path}/current"):
            path = f"{path}/{spark.read.text(f'{path}/current').first()[0]}/text_lines"
        else:
            return
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def nested(index: Index, with_text: bool = True) -> DataFrame:
    """One row for each file with its symbols and text lines as arrays, named as in JSON."""
    location = F.struct(F.col("workspace_folder").alias("workspaceFolder"), F.col("relative_path").alias("relativePath"), "line", "character")
    symbol = F.struct("ord", "kind", "name", F.col("container_name").alias("containerName"), location.alias("location"), "signature")
    symbols = index.symbols.groupBy(*KEYS).agg(F.transform(F.sort_array(F.collect_list(symbol)), lambda x: x.dropFields("ord")).alias("symbols"))
    out = index.files.join(symbols, KEYS, "left")
    if with_text:
        lines = index.text_lines.groupBy(*KEYS).agg(F.transform(F.sort_array(F.collect_list(F.struct("line", "text"))), lambda x: F.struct(x["text"].alias("text"), x["line"].alias("line"))).alias("textLines"))
        out = out.join(lines, KEYS, "left")
    else:
        out = out.withColumn("textLines", F.lit(None).cast("array<struct<text:string,line:int>>"))
    empty = lambda c, t: F.coalesce(F.col(c), F.array().cast(t)).alias(c)
    return out.orderBy("file_ord").select(
        F.col("workspace_folder").alias("workspaceFolder"), F.col("relative_path").alias("relativePath"), F.col("absolute_path").alias("absolutePath"), "language", "size",
        F.col("mtime_ms").alias("mtimeMs"), empty("symbols", f"array<{_SYMBOL}>"), empty("textLines", "array<struct<text:string,line:int>>"),
    )


def write_json(index: Index, path: str, with_text: bool = True) -> None:
    """meta.json (one row) and files.jsonl (a row for each file)."""
    names = {"created_at": "createdAt", "workspace_folders": "workspaceFolders", "file_count": "fileCount", "symbol_count": "symbolCount"}
    index.meta.withColumnsRenamed(names).withColumn("storage", F.lit("jsonl")).coalesce(1).write.mode("overwrite").json(f"{path}/meta.json")
    nested(index, with_text).write.mode("overwrite").json(f"{path}/files.jsonl")


def read_json(spark: SparkSession, path: str, strict: bool = False, with_text: bool = True) -> DataFrame | None:
    """Nested file rows of a JSON index. None if there is none or its metadata is another version's.

    A malformed row is skipped, or with ``strict`` there is no index at all.
    """
    if not exists(spark, f"{path}/meta.json"):
        return None
    meta = spark.read.schema(META_JSON).json(f"{path}/meta.json").first()
    if meta is None or meta["version"] != VERSION or meta["storage"] != "jsonl":
        return None
    reader = spark.read.schema(StructType.fromDDL(FILE_JSON + ", _bad string")).option("columnNameOfCorruptRecord", "_bad")
    rows = reader.json(f"{path}/files.jsonl")
    if strict:
        lines = spark.read.text(f"{path}/files.jsonl").where("trim(value) <> ''")
        if not lines.where(F.from_json("value", f"struct<{_ddl(FILE_JSON)}>", {"mode": "PERMISSIVE"})["relativePath"].isNull()).isEmpty():
            return None
    good = rows.where("relativePath is not null").drop("_bad")
    return good if with_text else without_text(good)


def _ddl(columns: str) -> str:
    return StructType.fromDDL(columns).simpleString().removeprefix("struct<").removesuffix(">")


def read_legacy(spark: SparkSession, path: str) -> DataFrame | None:
    """Nested file rows of an index in one JSON document, without text lines; None if it is missing or of another version."""
    if not exists(spark, path):
        return None
    whole = spark.read.schema(f"version int, createdAt string, workspaceFolders array<string>, files array<struct<{_ddl(FILE_JSON)}>>").option("multiLine", True).json(path)
    if (first := whole.select("version").first()) is None or first["version"] != VERSION:
        return None
    return without_text(whole.select(F.inline("files")))


def read_any(spark: SparkSession, folder: str) -> DataFrame | None:
    """Nested file rows from whatever the folder has: a snapshot, JSON rows, or one JSON document."""
    if (index := read_index(spark, folder)) is not None:
        return nested(index, False)
    rows = read_json(spark, folder, with_text=False)
    return rows if rows is not None else read_legacy(spark, f"{folder}/index.json")


def without_text(rows: DataFrame) -> DataFrame:
    return rows.withColumn("textLines", F.array().cast("array<struct<text:string,line:int>>"))


def unnested(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """files and symbols tables of nested file rows."""
    files = rows.select(F.col("workspaceFolder").alias("workspace_folder"), F.col("relativePath").alias("relative_path"), F.col("absolutePath").alias("absolute_path"), "language", "size", F.col("mtimeMs").alias("mtime_ms"))
    each = rows.select(F.explode("symbols").alias("s"))
    symbols = each.select("s.location.workspaceFolder", "s.location.relativePath", "s.location.line", "s.location.character", "s.kind", "s.name", "s.containerName", "s.signature").toDF("workspace_folder", "relative_path", "line", "character", "kind", "name", "container_name", "signature")
    return files, symbols


def rewrite_shards(spark: SparkSession, path: str, replaced: DataFrame, fresh: DataFrame, staging: str) -> None:
    """Replaces the text lines of some files: only their shards are rewritten, by way of a staging folder."""
    from ..functions.text import shard
    from ..operators.sync import replace_rows

    touched = replaced.select(shard(F.col("relative_path")).alias("shard")).distinct()
    old = spark.read.schema(TEXT_LINES).parquet(path)
    rows = old.join(touched, "shard", "left_semi")
    replace_rows(rows.select(old.columns), replaced, fresh.select(old.columns)).write.mode("overwrite").partitionBy("shard").parquet(staging)
    new = spark.read.schema(old.schema).parquet(staging)
    emptied = [r["shard"] for r in touched.join(new.select("shard").distinct(), "shard", "left_anti").collect()]  # at most 64
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(path)
    for s in emptied:
        fs, p = _fs(spark, f"{path}/shard={s}")
        fs.delete(p, True)


def kind_icon(kind: Column) -> Column:
    """The letter that stands for a kind in lists."""
    return F.when(kind == "text", "x").otherwise(F.substring(kind, 1, 1))
