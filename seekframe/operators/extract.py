"""From files to lines, symbols and text lines, as generators over columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.languages import language
from ..functions.text import SIGNATURE, indent, shard, trim
from .grammar import COMMENT, PYTHON_CLASS, PYTHON_DEF, declaration

MOST_LINES, MOST_TOTAL, LONGEST, BATCH, SIZE_CAP = 200, 1_000_000, 500, 64, 1_048_576
KEYS = ["workspace_folder", "relative_path"]


def physical_lines(content: Column) -> Column:
    return F.split(content, "\r?\n", -1)


def lines(files: DataFrame) -> DataFrame:
    """Keys, line (from 0) and raw of every physical line."""
    return files.select(*KEYS, F.posexplode(physical_lines(F.col("content"))).alias("line", "raw"))


def symbols(files: DataFrame, profile: str = "full", carry: Sequence[str] = ()) -> DataFrame:
    """Declarations of all files: keys, the columns to carry, line, character, kind, name, container_name, signature."""
    typed = files.withColumn("language", language(F.col("relative_path"), profile)) if "language" not in files.columns else files
    plain = typed.where("language <> 'python'")
    each = plain.select(*KEYS, *carry, "language", F.posexplode(physical_lines(F.col("content"))).alias("line", "raw")).withColumn("text", trim(F.col("raw"))).where("text <> ''")
    found = each.withColumn("d", declaration(F.col("text"), F.col("language"), profile)).where("d is not null")
    out = found.select(*KEYS, *carry, "line", indent(F.col("raw")).alias("character"), "d.kind", "d.name", F.lit(None).cast("string").alias("container_name"), F.substring("text", 1, SIGNATURE).alias("signature"))
    return out.unionByName(python_symbols(typed.where("language = 'python'"), carry))


def python_symbols(files: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """Classes and functions of Python files, functions named after the class that holds them.

    One fold over a file's active lines: a line closes all classes that are indented as far or further; what is left
    ascends, so closing is a filter and the holder is the last.
    """
    frame = "array<struct<indent:int,name:string>>"
    active = F.filter(
        F.transform(physical_lines(F.col("content")), lambda x, i: F.struct(i.alias("line"), indent(x).alias("indent"), trim(x).alias("text"))),
        lambda x: (x["text"] != "") & ~x["text"].rlike(COMMENT),
    )
    nothing = F.lit(None).cast("struct<line:int,character:int,kind:string,name:string,container_name:string,signature:string>")
    start = F.struct(F.array().cast(frame).alias("stack"), F.array().cast("array<struct<line:int,character:int,kind:string,name:string,container_name:string,signature:string>>").alias("out"))

    def symbol(x: Column, kind: str, name: Column, holder: Column) -> Column:
        return F.struct(x["line"].alias("line"), x["indent"].alias("character"), F.lit(kind).alias("kind"), name.alias("name"), holder.alias("container_name"), F.substr(x["text"], F.lit(1), F.lit(SIGNATURE)).alias("signature"))

    def step(a: Column, x: Column) -> Column:
        stack = F.filter(a["stack"], lambda c: c["indent"] < x["indent"])
        cls, fn = F.regexp_extract(x["text"], PYTHON_CLASS, 1), F.regexp_extract(x["text"], PYTHON_DEF, 1)
        holder = F.get(stack, F.size(stack) - 1)["name"]
        found = F.when(cls != "", symbol(x, "class", cls, F.lit(None).cast("string"))).when(fn != "", symbol(x, "function", F.concat_ws(".", holder, fn), holder)).otherwise(nothing)
        pushed = F.when(cls != "", F.concat(stack, F.array(F.struct(x["indent"].alias("indent"), cls.alias("name"))))).otherwise(stack)
        return F.struct(pushed.alias("stack"), F.when(found.isNull(), a["out"]).otherwise(F.concat(a["out"], F.array(found))).alias("out"))

    # only lines that can open or close a class matter to the fold; all active ones can close
    folded = files.select(*KEYS, *carry, active.alias("active")).select(*KEYS, *carry, F.aggregate("active", start, step, lambda a: a["out"]).alias("out"))
    return folded.select(*KEYS, *carry, F.inline("out"))


def text_lines(files: DataFrame, limit: int | Column = MOST_LINES, carry: Sequence[str] = ()) -> DataFrame:
    """Trimmed lines of 1 to 500 characters among each file's first ``limit`` physical ones, with their shard and the columns to carry."""
    most = F.greatest(F.lit(limit) if isinstance(limit, int) else limit, F.lit(0))
    each = files.select(*KEYS, *carry, shard(F.col("relative_path")).alias("shard"), F.posexplode(F.slice(physical_lines(F.col("content")), F.lit(1), most)).alias("line", "raw"))
    return each.select(*KEYS, *carry, "line", trim(F.col("raw")).alias("text"), "shard").where(F.length("text").between(1, LONGEST))


def budgeted_text_lines(files: DataFrame, total: int = MOST_TOTAL, limit: int = MOST_LINES, batch: int = BATCH) -> DataFrame:
    """``text_lines`` under a budget for all files, which files of a batch see as it was when their batch began.

    files: with file_ord (from 0).  Batches before the budget falls under ``limit`` keep ``limit``; from there on a batch's
    limit depends on the counts before it, so the driver walks over the few batches that are left, by their line counts.
    """
    numbered = files.withColumn("batch", F.floor(F.col("file_ord") / batch).cast("long"))
    emitted = text_lines(files, limit).groupBy(*KEYS).count()
    counts = numbered.select(*KEYS, "batch").join(emitted, KEYS, "left").groupBy("batch").agg(F.sum(F.coalesce("count", F.lit(0))).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("batch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    run = counts.withColumn("left", F.lit(total) - before)
    full = run.where(F.col("left") >= limit).agg(F.max("batch").alias("last")).first()["last"]
    if full is None:
        first, left = 0, total
    else:
        first = full + 1
        left = total - run.where(F.col("batch") <= full).agg(F.sum("n")).first()[0]
    limits = []
    while left > 0:
        rows = numbered.where(F.col("batch") == first)
        if rows.isEmpty():
            break
        limits.append((first, left))
        left -= text_lines(rows, min(limit, left)).count()
        first += 1
    most = F.when(F.col("batch") <= (full if full is not None else -1), limit)
    for b, n in limits:
        most = most.when(F.col("batch") == b, min(limit, n))
    return text_lines(numbered.withColumn("most", most.otherwise(0)), F.col("most"))


def within(size: Column, cap: int | None) -> Column:
    """Whether a size is at most ``cap`` bytes; with None all are."""
    return F.lit(True) if cap is None else size <= cap


def size_capped(files: DataFrame, cap: int = SIZE_CAP) -> DataFrame:
    """Files of at most ``cap`` bytes; the test is on the size column, before content is read."""
    return files.where(within(F.col("size"), max(cap, 0)))


def first_of_each(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where("_n = 1").drop("_n")
