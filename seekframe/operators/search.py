"""Ranked look-ups over symbols, files and text lines.

Candidates carry their search forms (built once, stored with the index), a family order and an ordinal, so that ranking,
de-duplication and caps don't depend on partitions.  One query is literals in a projection; many queries are a table
that every candidate meets (the score is the join condition, so that is what a batch costs).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.languages import KIND_ORDER, scope, weight
from ..functions.score import Query, matches, normalise, normalise_column, score
from ..functions.text import basename, preview

RESULT = ["kind", "label", "description", "detail", "score", "workspace_folder", "relative_path", "line", "character", "preview"]
KEY = ["kind", "workspace_folder", "relative_path", "line", "label"]
MOST_RESULTS, MOST_TEXT, TEXT_WEIGHT = 150, 80, 120
PANEL_CAPS, PICK_CAPS = {"text": 50, None: 80}, {"text": 30, None: 40}


def _forms(prefix: str, c: Column) -> dict[str, Column]:
    from ..functions.text import prepared

    return {f"{prefix}{k}": v for k, v in prepared(c).items()}


def _of(prefix: str) -> dict[str, Column]:
    return {k: F.col(f"{prefix}{k}") for k in ("normalized", "separated", "compact", "base", "stem", "sep_base")}


def file_candidates(files: DataFrame) -> DataFrame:
    """files (workspace_folder, relative_path, ord) with the forms of name and path."""
    path = F.col("relative_path")
    return files.select("workspace_folder", "relative_path", "ord", basename(path).alias("label")).withColumns(_forms("n_", F.col("label")) | _forms("p_", path))


def symbol_candidates(symbols: DataFrame) -> DataFrame:
    """symbols (kind, name, keys, line, character, signature, ord) with the forms of the name."""
    return symbols.select("workspace_folder", "relative_path", "ord", "kind", F.col("name").alias("label"), "line", "character", "signature").withColumns(_forms("n_", F.col("label")))


def text_candidates(lines: DataFrame) -> DataFrame:
    """text lines (text, keys, line, ord); the few that a query lets through get their forms then."""
    return lines.select("workspace_folder", "relative_path", "ord", "line", "text")


def _symbol_rows(c: DataFrame, q: Query, kinds: list[str]) -> DataFrame:
    near = c.where(F.col("kind").isin([k for k in kinds if k not in ("file", "text")]))
    if (test := matches(F.col("n_normalized"), q)) is not None:
        near = near.where(test)
    hit = near.withColumn("s", score(_of("n_"), q)).where("s > 0")
    return hit.select(
        "kind", "label", F.col("relative_path").alias("description"), F.col("signature").alias("detail"), (weight(F.col("kind")) + F.col("s")).alias("score"),
        "workspace_folder", "relative_path", "line", "character", F.col("signature").alias("preview"), F.lit(1).alias("fam"), "ord", *_extra(c),
    )


def _file_rows(c: DataFrame, q: Query, least: int) -> DataFrame:
    name, path = score(_of("n_"), q), score(_of("p_"), q)
    hit = c.withColumn("s", name).withColumn("t", path)
    if least:
        hit = hit.where(F.greatest("s", "t") >= least)
    return hit.select(
        F.lit("file").alias("kind"), "label", F.col("relative_path").alias("description"), F.lit(None).cast("string").alias("detail"), (420 + F.greatest(F.col("s") + 25, F.col("t"))).alias("score"),
        "workspace_folder", "relative_path", F.lit(0).alias("line"), F.lit(0).alias("character"), F.lit(None).cast("string").alias("preview"), F.lit(0).alias("fam"), "ord", *_extra(c),
    )


def _text_rows(c: DataFrame, q: Query, most: int) -> DataFrame:
    """The first ``most`` matches in corpus order, whatever their scores: what matches is known before any form, and only those rows are scored."""
    forms = _forms("n_", F.col("text"))
    test = matches(F.lower("text"), q)
    near = c.where(test) if test is not None else c.withColumns(forms).where(score(_of("n_"), q) > 0).select(c.columns)
    # one partition, and a node that keeps the forms from moving below the limit
    hit = near.orderBy("ord").limit(max(most, 0)).coalesce(1).withColumns(forms).withColumn("s", score(_of("n_"), q))
    place = F.col("relative_path")
    return hit.select(
        F.lit("text").alias("kind"), preview(F.col("text")).alias("label"), F.concat(place, F.lit(":"), F.col("line") + 1).alias("description"), place.alias("detail"), (TEXT_WEIGHT + F.least("s", F.lit(120))).alias("score"),
        "workspace_folder", "relative_path", "line", F.greatest(F.call_function("locate", q.compact, F.col("n_normalized")) - 1, F.lit(0)).alias("character"), F.col("text").alias("preview"), F.lit(2).alias("fam"), "ord",
    )


def _extra(c: DataFrame) -> list[str]:
    return ["query_id"] if "query_id" in c.columns else []


def _best(rows: DataFrame) -> DataFrame:
    """One row a result key: the highest score, then the first; its place in order is that of the key's first row."""
    extra = _extra(rows)
    w = Window.partitionBy(*extra, *KEY)
    # rows of a key are few: the shuffle is on the whole key
    return rows.withColumn("_n", F.row_number().over(w.orderBy(F.desc("score"), "fam", "ord"))).withColumn("ord", F.min("ord").over(w)).where("_n = 1").drop("_n")


def _order() -> list[Column]:
    return [F.desc("score"), F.collate(F.col("label"), "UNICODE"), F.col("fam"), F.col("ord")]


def ranked(rows: DataFrame, limit: int | None) -> DataFrame:
    """The top ``limit`` distinct results, None for all: score, then label in the locale's order, then corpus order."""
    if limit is not None and limit < 0:
        raise ValueError("limit is negative")
    best = _best(rows).orderBy(*_order())
    return best if limit is None else best.limit(limit)


def _empty(any_rows: DataFrame) -> DataFrame:
    return any_rows.where(F.lit(False))


def search(query: str, symbols: DataFrame | None = None, files: DataFrame | None = None, text: DataFrame | None = None, where: str = "all", most_text: int = MOST_TEXT, limit: int | None = MOST_RESULTS, least_file_score: int = 0) -> DataFrame:
    """Ranked results of one query over the given candidates; a blank query has none."""
    q, kinds = normalise(query), scope(where)
    parts = []
    if files is not None and "file" in kinds:
        parts.append(_file_rows(files, q, least_file_score))
    if symbols is not None and {"class", "interface", "type", "function"} & set(kinds):
        parts.append(_symbol_rows(symbols, q, kinds))
    if text is not None and "text" in kinds:
        parts.append(_text_rows(text, q, most_text))
    if not parts:
        raise ValueError(f"no candidates for {where}")
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return (_empty(rows) if q.blank else ranked(rows, limit)).select(*RESULT)


def search_many(queries: DataFrame, symbols: DataFrame, limit: int = MOST_RESULTS) -> DataFrame:
    """query_id and the ranked symbols of each query of a table (query_id, query).

    The table of queries is the inner side of a nested loop over the candidates; Spark broadcasts it while its size, which
    it knows from the plan, allows.
    """
    q = normalise_column(F.col("query"))
    forms = queries.where(q.lower != "").select("query_id", q.lower.alias("q_lower"), q.separated.alias("q_separated"), q.compact.alias("q_compact"), q.tokens.alias("q_tokens"))
    columns = Query(*(F.col(f"q_{c}") for c in ("lower", "separated", "compact", "tokens")))
    # letters as bits: a candidate without one of the query's has no score, which is a test of two numbers
    forms = forms.withColumn("q_bits", _bits(F.col("q_compact")))
    met = symbols.withColumn("n_bits", _bits(F.col("n_compact"))).join(forms, (F.col("q_bits").bitwiseAND(F.col("n_bits")) == F.col("q_bits")) & (score(_of("n_"), columns) > 0))
    rows = _best(_symbol_rows(met, columns, KIND_ORDER))
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy("query_id").orderBy(*_order()))).where(F.col("_n") <= limit).select("query_id", *RESULT)


def _bits(c: Column) -> Column:
    each = F.transform(F.filter(F.split(c, ""), lambda x: x != ""), lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), F.ascii(x) % 64))
    return F.aggregate(each, F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x))


def text_search(query: str, lines: DataFrame, limit: int = MOST_TEXT) -> DataFrame:
    """Substring hits in lines (shard, ord, line, text): the first ``limit`` in shard order, then the earliest in the line first."""
    q = query.strip().lower()
    at = F.call_function("locate", F.lit(q), F.lower("text")) - 1
    hit = lines.withColumn("at", at).where(F.col("at") >= 0) if q else _empty(lines.withColumn("at", at))
    some = hit.orderBy("shard", "ord", "line").limit(max(limit, 0)).coalesce(1)
    return _text_hits(some).orderBy(F.desc("score"), F.collate(F.col("description"), "UNICODE"))


def _text_hits(rows: DataFrame) -> DataFrame:
    return rows.select(
        F.lit("text").alias("kind"), preview(F.col("text")).alias("label"), F.concat("relative_path", F.lit(":"), F.col("line") + 1).alias("description"), F.col("relative_path").alias("detail"),
        (TEXT_WEIGHT + F.greatest(F.lit(0), 120 - F.col("at"))).alias("score"), "workspace_folder", "relative_path", "line", F.col("at").alias("character"), F.col("text").alias("preview"),
    )


def search_with_text(query: str, lines: DataFrame, symbols: DataFrame | None = None, files: DataFrame | None = None, where: str = "all", most_text: int = MOST_TEXT, limit: int = MOST_RESULTS) -> DataFrame:
    """Results of one query, text hits from the shards: the best symbols and files and the first hits, ranked together.

    Only the widest scope has both; the text scope has hits alone, at most ``limit``, the others none.
    """
    q, kinds = normalise(query), scope(where)
    if kinds == ["text"]:
        return text_search(query, lines, min(most_text, limit))
    parts = [_file_rows(files, q, 0)] if files is not None and "file" in kinds else []
    parts += [_symbol_rows(symbols, q, kinds)] if symbols is not None else []
    if not parts:
        raise ValueError(f"no candidates for {where}")
    best = ranked(reduce(DataFrame.unionByName, parts), limit)
    if "text" in kinds and most_text > 0:
        best = best.select(*RESULT, "fam", "ord").unionByName(text_search(query, lines, most_text).withColumns({"fam": F.lit(2), "ord": F.lit(0).cast("long")}))
    best = best.orderBy(*_order(), F.collate(F.col("description"), "UNICODE")).limit(limit)
    return (_empty(best) if q.blank else best).select(*RESULT)


def refine(results: DataFrame, query: str) -> DataFrame:
    """Earlier results whose label holds a longer query, with the scores that they had."""
    return results.where(F.contains(F.lower("label"), F.lit(query.strip().lower())))


def refine_text(results: DataFrame, query: str, limit: int = MOST_TEXT) -> DataFrame:
    """Earlier text hits that hold a longer query, scored anew."""
    at = F.call_function("locate", F.lit(query.strip().lower()), F.lower(F.coalesce("preview", "label"))) - 1
    again = results.withColumn("at", at).where(F.col("at") >= 0).withColumn("text", F.coalesce("preview", "label"))
    return _text_hits(again).orderBy(F.desc("score"), F.collate(F.col("description"), "UNICODE")).limit(limit)


def grouped(results: DataFrame, caps: dict) -> DataFrame:
    """Results by kind in the kinds' order, each capped; group_ord and rank say where."""
    w = Window.partitionBy("kind").orderBy(F.desc("score"), F.collate(F.col("label"), "UNICODE"), "relative_path", "line")
    cap = F.when(F.col("kind") == "text", caps["text"]).otherwise(caps[None])
    place = F.array_position(F.array(*map(F.lit, KIND_ORDER)), F.col("kind")).cast("int") - 1
    return results.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= cap).withColumn("group_ord", place)


def printed(results: DataFrame) -> DataFrame:
    """A line of text for each result: kind padded to nine, label, place from line 1. Without results one line says so."""
    rows = results.select(F.concat(F.rpad("kind", 9, " "), F.lit(" "), F.col("label"), F.lit("  "), F.col("relative_path"), F.lit(":"), F.col("line") + 1).alias("row"))
    return rows.unionByName(rows.agg(F.count("*").alias("n")).where("n = 0").select(F.lit("No results.").alias("row")))


def as_json(results: DataFrame) -> DataFrame:
    """A JSON object for each result, with a nested location."""
    location = F.struct(F.col("workspace_folder").alias("workspaceFolder"), F.col("relative_path").alias("relativePath"), "line", "character")
    return results.select(F.to_json(F.struct("kind", "label", "description", "score", location.alias("location"), "preview")).alias("row"))
