"""The engine's inputs, made from the tables at hand: files, symbols, scans and changes. Each view has its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.languages import INCLUDED

EXTENSIONS = [f".{e}" for e in INCLUDED] + [".png", ""]
KINDS = ["class", "interface", "type", "function"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: list[str], index) -> object:
    return F.element_at(F.array(*map(F.lit, values)), index.cast("int") + 1)


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as symbols: kind by size, place by brand and type."""
    return table(spark, sf_dir, "part").select(
        F.lit("w").alias("workspace_folder"), F.concat("p_brand", F.lit("/"), "p_type").alias("relative_path"), F.col("p_partkey").alias("ord"),
        _pick(KINDS, F.col("p_size") % 4).alias("kind"), F.col("p_name").alias("name"), F.col("p_partkey").cast("int").alias("line"), F.lit(0).alias("character"), F.col("p_type").alias("signature"),
    )


SYMBOLS = """SELECT 'w' AS workspace_folder, p_brand || '/' || p_type AS relative_path, p_partkey AS ord,
  ['class', 'interface', 'type', 'function'][CAST(p_size % 4 AS INTEGER) + 1] AS kind, p_name AS label, CAST(p_partkey AS INTEGER) AS line, 0 AS "character", p_type AS signature FROM part"""


def doc_path() -> object:
    d = F.col("doc_id")
    top = F.when(d % 11 == 0, "vendor/").when(d % 13 == 0, "assets/").otherwise("")
    return F.concat(top, F.col("lang"), F.lit("/"), d.cast("string"), _pick(EXTENSIONS, d % len(EXTENSIONS)))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files."""
    return table(spark, sf_dir, "documents").select(F.col("source").alias("workspace_folder"), doc_path().alias("relative_path"), F.col("text").alias("content"), F.col("n_chars").alias("size"), F.col("doc_id").cast("double").alias("mtime_ms"), F.col("doc_id").alias("ord"))


_LIST = "[" + ", ".join(f"'{e}'" for e in EXTENSIONS) + "]"
FILES = f"""SELECT source AS workspace_folder, CASE WHEN doc_id % 11 = 0 THEN 'vendor/' WHEN doc_id % 13 = 0 THEN 'assets/' ELSE '' END || lang || '/' || doc_id || {_LIST}[CAST(doc_id % {len(EXTENSIONS)} AS INTEGER) + 1] AS relative_path,
  text AS content, n_chars AS size, CAST(doc_id AS DOUBLE) AS mtime_ms, doc_id AS ord FROM documents"""

TEMPLATES = {
    "java": ["public final class {n} extends Base {{", "interface {n}<T> {{", "  private List<String> {n}(int a) throws IOException {{", "void {n}();", "else if ({n}) {{", "// class {n} {{", "public static enum {n} {{ A }}"],
    "kotlin": ["data class {n}(val a: Int)", "enum class {n} {{ R }}", "object {n} {{", "override suspend fun String.{n}(id: Int) {{", "val {n} = 1", "internal interface {n}"],
    "go": ["type {n} struct {{", "type {n} interface {{", "type {n} string", "func (s *Server) {n}(w W) error {{", "type {n}[T any] struct {{", "func {n}() {{"],
    "rust": ["pub struct {n} {{", "trait {n} {{", "pub enum {n} {{", "pub async fn {n}<T>(x: T) {{", "pub(crate) fn {n}() {{", "#[derive({n})]", "fn {n} <T>(x: T) {{", "fn {n}<>(x) {{"],
    "csharp": ["public sealed partial class {n} : Base", "public readonly struct {n}", "public override async Task<int> {n}(int a) =>", "int {n} {{ get; }}", "internal interface {n}"],
    "cpp": ["template <typename T> class {n} {{", "using {n} = std::vector<char>;", "typedef unsigned long {n};", "int {n}::size() const {{", "else if ({n}) {{", "int {n}(int a);", "#define {n} 1", "template <template <class> class T> class {n} {{", "template<> class {n}<int> {{", "template <class A, class B = X<A>> struct {n} {{"],
    "php": ["final class {n} {{", "trait {n} {{", "  public static function {n}($a) {{", "<?php {n}", "interface {n} {{"],
    "ruby": ["class {n} < Base", "module {n}", "  def self.{n}?(x)", "def {n}=(v)", "# def {n}"],
    "swift": ["public final class {n}: Base {{", "protocol {n} {{", "struct {n} {{", "override func {n}() {{", "class func {n}() {{"],
    "dart": ["abstract class {n} {{", "mixin {n} {{", "void {n}() {{", "{n}() {{", "Future<int> {n}() async {{", "if ({n}) {{"],
    "shell": ["{n}() {{", "function {n} {{", "echo {n}"],
    "powershell": ["Function {n} {{", "CLASS {n} {{", "# function {n}"],
    "lua": ["---@class app.{n}", "--- @alias {n} string", "local {n} = {{}}", "function M:{n}()", "M.{n} = function()", 'M["{n}"] = function()', "local {n} = setmetatable({{}}, M)", "-- local {n} = {{}}"],
    "javascript": ["export default abstract class {n} {{", "export interface {n} {{", "export type {n} = string", "export default async function {n}() {{", "export const {n} = async (a) => {{", "const {n} = 5", "  let {n} = x => x"],
    "python": ["class {n}(A):", "    def {n}(self):", "        pass", "    class {n}B:", "        async def {n}(self):", "            def inner_{n}(): pass", "    def k_{n}(self): pass", "# def {n}", "def {n}():", "x = 1"],
}
#: What each line declares, written out by hand: kind and name ({last}: the last letter of the name), or nothing.
DECLARED = {
    "java": ["class {n}", "interface {n}", "function {n}", "", "function if", "", "type {n}"],
    "kotlin": ["class {n}", "type {n}", "type {n}", "function {n}", "", "interface {n}"],
    "go": ["class {n}", "interface {n}", "type {n}", "function {n}", "", "function {n}"],
    "rust": ["class {n}", "interface {n}", "type {n}", "function {n}", "", "", "function {n}", ""],
    "csharp": ["class {n}", "type {n}", "function {n}", "", "interface {n}"],
    "cpp": ["class {n}", "type {n}", "type {n}", "function {n}::size", "function if", "", "", "class T", "", ""],
    "php": ["class {n}", "type {n}", "function {n}", "", "interface {n}"],
    "ruby": ["class {n}", "type {n}", "function {n}?", "function {n}=", ""],
    "swift": ["class {n}", "interface {n}", "type {n}", "function {n}", "class func"],
    "dart": ["class {n}", "type {n}", "function {n}", "function {last}", "function {n}", "function f"],
    "shell": ["function {n}", "function {n}", ""],
    "powershell": ["function {n}", "class {n}", ""],
    "lua": ["class app.{n}", "type {n}", "class {n}", "function M:{n}", "function M.{n}", "function {n}", "class {n}", ""],
    "javascript": ["class {n}", "interface {n}", "type {n}", "function {n}", "function {n}", "", "function {n}"],
    # the lite profile knows only the default rules, here over the lines of java
    "lite": ["", "interface {n}", "", "", "", "", ""],
}
FILE_EXTENSION = {"java": "java", "kotlin": "kt", "go": "go", "rust": "rs", "csharp": "cs", "cpp": "cpp", "php": "php", "ruby": "rb", "swift": "swift", "dart": "dart", "shell": "sh", "powershell": "ps1", "lua": "lua", "javascript": "js", "python": "py"}


def code(spark: SparkSession, sf_dir: str, language: str) -> DataFrame:
    """A file of code for each brand, a line for each part."""
    lines = [t.format(n="\0") for t in TEMPLATES[language]]
    raw = F.replace(_pick(lines, F.col("p_partkey") % len(lines)), F.lit("\0"), F.replace("p_name", F.lit(" "), F.lit("_")))
    each = table(spark, sf_dir, "part").select("p_brand", F.struct("p_partkey", raw.alias("raw")).alias("x"))
    whole = each.groupBy("p_brand").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["raw"]), "\n").alias("content"))
    return whole.select(F.lit("w").alias("workspace_folder"), F.concat("p_brand", F.lit(f".{FILE_EXTENSION[language]}")).alias("relative_path"), "content")


def code_sql(language: str) -> str:
    lines = [t.format(n="\x01") for t in TEMPLATES[language]]
    listed = "[" + ", ".join("'" + x.replace("'", "''").replace("\x01", "{n}") + "'" for x in lines) + "]"
    raw = f"replace({listed}[CAST(p_partkey % {len(lines)} AS INTEGER) + 1], '{{n}}', replace(p_name, ' ', '_'))"
    return f"SELECT 'w' AS workspace_folder, p_brand || '.{FILE_EXTENSION[language]}' AS relative_path, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS INTEGER) AS line, {raw} AS raw, p_partkey, replace(p_name, ' ', '_') AS n FROM part"


def declared_sql(language: str, profile: str = "full") -> str:
    """The declarations that the written-out list tells, line by line."""
    told = [x.split(" ", 1) if x else ["", ""] for x in DECLARED[language if profile == "full" else profile]]
    listed = lambda k: "[" + ", ".join(f"'{x[k]}'" for x in told) + f"][CAST(p_partkey % {len(told)} AS INTEGER) + 1]"
    return f"""SELECT relative_path, line, CAST(length(raw) - length(ltrim(raw)) AS INTEGER) AS "character", {listed(0)} AS kind,
  replace(replace({listed(1)}, '{{n}}', n), '{{last}}', right(n, 1)) AS name, CAST(NULL AS VARCHAR) AS container_name, substr(trim(raw), 1, 240) AS signature FROM ({code_sql(language)}) WHERE {listed(0)} <> ''"""


def scans(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Documents as an index and as a later scan: some added, some removed, some of another size or time."""
    d = files(spark, sf_dir).select("workspace_folder", "relative_path", "size", "mtime_ms", "ord")
    old = d.where("ord % 10 <> 0")
    new = d.where("ord % 17 <> 0").withColumn("size", F.col("size") + F.when(F.col("ord") % 7 == 0, 1).otherwise(0)).withColumn("mtime_ms", F.col("mtime_ms") + F.when(F.col("ord") % 9 == 0, 0.5).otherwise(0.0))
    return old, new


SCANS = f"""d AS ({FILES}), old AS (SELECT workspace_folder, relative_path, size, mtime_ms, ord FROM d WHERE ord % 10 <> 0),
  new AS (SELECT workspace_folder, relative_path, size + CASE WHEN ord % 7 = 0 THEN 1 ELSE 0 END AS size, mtime_ms + CASE WHEN ord % 9 = 0 THEN 0.5 ELSE 0 END AS mtime_ms, ord FROM d WHERE ord % 17 <> 0)"""


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a change feed."""
    path = F.concat(F.when(F.col("user_id") % 7 == 0, "vendor/").otherwise("src/"), F.lit("u"), F.col("user_id").cast("string"), F.when(F.col("user_id") % 5 == 0, ".md").otherwise(".go"))
    return table(spark, sf_dir, "events").select(path.alias("path"), F.when(F.col("event_type") == "error", "del").otherwise("up").alias("action"), "ts", F.col("event_id").alias("seq"))


CHANGES = "SELECT CASE WHEN user_id % 7 = 0 THEN 'vendor/' ELSE 'src/' END || 'u' || user_id || CASE WHEN user_id % 5 = 0 THEN '.md' ELSE '.go' END AS path, CASE WHEN event_type = 'error' THEN 'del' ELSE 'up' END AS action, ts, event_id AS seq FROM events"
