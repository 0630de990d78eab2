"""Golden values and invariants of the search engine."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from seekframe.functions import languages, text
from seekframe.functions.score import normalise, normalise_column, score
from seekframe.operators import extract, grammar, ignore, search, sync
from seekframe.sources import store
from seekframe.streaming import watch

SCORES = [
    ("UserService", "UserService", 720), ("user_service", "user-service", 680), ("user.service", "userservice", 560), ("UserServiceImpl", "UserService", 466),
    ("src/user-service.ts", "user_service", 463), ("MyUserService", "userservice", 328), ("blue bolt", "bolt", 325), ("get_user_by_id", "userby", 237),
    ("service_of_user", "user service", 210), ("blue bolt", "bolt blue", 210), ("AuthController", "authctl", 144), ("UserService", "usrsvc", 85), ("abc", "-", 467), ("xyz", "q", 0),
    ("createkubeproxyconfig", "create-kubeconfig", 483), ("createkubeapiserverconfig", "create-kubeconfig", 479), ("a" + "b" * 130, "a", 350), ("a" + "b" * 119, "a", 351), ("a" + "b" * 120, "a", 350), ("axxxxxxxxxb", "ab", 35),
]


@pytest.mark.parametrize("as_column", [False, True])
def test_scores(spark, as_column):
    df = spark.createDataFrame(SCORES, "candidate string, query string, expected int")
    forms = text.prepared(F.col("candidate"))
    if as_column:
        rows = df.withColumn("s", score(forms, normalise_column(F.col("query")))).collect()
    else:
        rows = [r for _, q, _ in SCORES for r in df.where(F.col("query") == q).withColumn("s", score(forms, normalise(q))).collect()]
    assert [(r["candidate"], r["query"], r["s"]) for r in rows if r["s"] != r["expected"]] == []


def test_paths(spark):
    rows = spark.createDataFrame([("a.tar.gz",), (".bashrc",), ("foo.",), ("..",), ("x/y/",)], "p string")
    got = rows.select(text.basename(F.col("p")).alias("b"), text.stem(text.basename(F.col("p"))).alias("s"), text.extension(F.col("p")).alias("e")).collect()
    assert [tuple(r) for r in got] == [("a.tar.gz", "a.tar", ".gz"), (".bashrc", ".bashrc", ""), ("foo.", "foo", "."), ("..", "..", ""), ("y", "y", "")]


def test_shards(spark):
    rows = spark.createDataFrame([("src/a.ts", -463440777, 9), ("cmd/create-kubeconfig.go", -224930517, 21), ("README.md", 1685611991, 23)], "p string, h long, s int")
    assert rows.where((text.string_hash(F.col("p")) != F.col("h")) | (text.shard(F.col("p")) != F.col("s"))).count() == 0


def test_trim_and_preview(spark):
    row = spark.createDataFrame([(" ﻿ x  ", "y" * 97, "z" * 96)], "a string, b string, c string")
    a, b, c = row.select(text.trim(F.col("a")), text.preview(F.col("b")), text.preview(F.col("c"))).first()
    assert (a, b, c) == ("x", "y" * 93 + "...", "z" * 96)


def test_preview_of_whole_texts(spark, tmp_path):
    from seekframe.plans import catalogue

    texts = [" " * 200 + "late", "a" * 96 + " " * 30 + "b", "short"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["preview"] for r in catalogue.QUERIES["preview_trim"](spark, str(tmp_path)).collect()}
    assert got == {0: "late", 1: "a" * 93 + "...", 2: "short"}


def _candidates(spark):
    files = spark.createDataFrame([("w", "cmd/create-kubeconfig.go", 0), ("w", "cmd/createkubeproxyconfig.go", 1)], "workspace_folder string, relative_path string, ord long")
    rows = [("w", "cmd/create-kubeconfig.go", 4, "create-kubeconfig"), ("w", "cmd/create-kubeconfig.go", 12, "createkubeproxyconfig"), ("w", "cmd/create-kubeconfig.go", 20, "createkubeapiserverconfig"), ("w", "cmd/createkubeproxyconfig.go", 4, "createkubeproxyconfig")]
    symbols = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "workspace_folder string, relative_path string, line int, name string, ord long")
    symbols = symbols.withColumns({"kind": F.lit("function"), "character": F.lit(0), "signature": F.col("name")})
    return search.file_candidates(files), search.symbol_candidates(symbols)


def test_ranking(spark):
    files, symbols = _candidates(spark)
    got = search.search("create-kubeconfig", symbols=symbols, files=files).collect()
    assert [(r["kind"], r["label"], r["score"]) for r in got] == [
        ("function", "create-kubeconfig", 1220), ("file", "create-kubeconfig.go", 1165), ("function", "createkubeproxyconfig", 983), ("function", "createkubeproxyconfig", 983),
        ("function", "createkubeapiserverconfig", 979), ("file", "createkubeproxyconfig.go", 926),
    ]
    again = search.search("create-kubeconfig", symbols=symbols.repartition(7), files=files.repartition(3)).collect()
    assert again == got
    assert search.search(" ", symbols=symbols, files=files).count() == 0
    assert search.search("x", files=files, limit=1).count() == 1
    with pytest.raises(ValueError):
        search.search("x", files=files, limit=-1)
    assert "create-kubeconfig" in search.printed(search.search("create-kubeconfig", symbols=symbols)).first()["row"]
    assert '"relativePath":"cmd/create-kubeconfig.go"' in search.as_json(search.search("create-kubeconfig", symbols=symbols)).first()["row"]


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").is_dir(), reason="no tables")
@pytest.mark.parametrize("name", ["file_floor", "kind_weighting", "group_panel", "group_pick"])
def test_whole_results(spark, name):
    from seekframe.plans import catalogue

    plan = catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "GlobalLimit" not in plan


def test_label_order(spark):
    labels = ["_a", "1", "a", "A", "a b", "a-b", "ab", "b", "B", "é", "Z"]
    df = spark.createDataFrame([(x,) for x in reversed(labels)], "x string")
    assert [r["x"] for r in df.orderBy(F.collate("x", "UNICODE")).collect()] == sorted(labels, key=["_a", "1", "a", "A", "a b", "a-b", "ab", "b", "B", "é", "Z"].index)


LINES = [
    ("java", "public final class Ledger extends Base {", "class", "Ledger"), ("java", "interface Store<T> {", "interface", "Store"), ("java", "public static enum Mode { A }", "type", "Mode"),
    ("java", "private List<String> names(int a) throws IOException {", "function", "names"), ("java", "void run();", None, None), ("java", "else if (x) {", "function", "if"), ("java", "return make(x) {", "function", "make"),
    ("java", "// class Hidden {", None, None), ("java", "@Override", None, None), ("kotlin", "data class Row(val a: Int)", "class", "Row"), ("kotlin", "enum class Color { R }", "type", "Color"),
    ("kotlin", "object Registry {", "type", "Registry"), ("kotlin", "override suspend fun String.load(id: Int) {", "function", "load"), ("kotlin", "val x = 1", None, None), ("go", "type Server struct {", "class", "Server"),
    ("go", "type Reader interface {", "interface", "Reader"), ("go", "type ID string", "type", "ID"), ("go", "func (s *Server) Serve(w W) error {", "function", "Serve"), ("go", "func main() {", "function", "main"),
    ("go", "type Box[T any] struct {", None, None), ("rust", "pub struct Grid {", "class", "Grid"), ("rust", "trait Draw {", "interface", "Draw"), ("rust", "pub enum Kind {", "type", "Kind"),
    ("rust", "pub async fn load<T>(x: T) {", "function", "load"), ("rust", "pub(crate) fn hidden() {", None, None), ("rust", "#[derive(Debug)]", None, None), ("csharp", "public sealed partial class Unit : Base", "class", "Unit"),
    ("csharp", "public readonly struct Point", "type", "Point"), ("csharp", "public record Person(string Name);", "type", "Person"), ("csharp", "public override async Task<int> Go(int a) =>", "function", "Go"),
    ("csharp", "int Count { get; }", None, None), ("cpp", "template <typename T> class Pool {", "class", "Pool"), ("cpp", "using Bytes = std::vector<char>;", "type", "Bytes"), ("cpp", "typedef unsigned long word_t;", "type", "word_t"),
    ("cpp", "int Pool::size() const {", "function", "Pool::size"), ("cpp", "int main(int argc, char** argv)", "function", "main"), ("cpp", "else if (x) {", "function", "if"), ("cpp", "int f(int a);", None, None),
    ("cpp", "#define X 1", None, None), ("cpp", "*ptr = 3;", None, None), ("php", "final class Cart {", "class", "Cart"), ("php", "trait Logs {", "type", "Logs"), ("php", "public static function make($a) {", "function", "make"),
    ("php", "<?php", None, None), ("ruby", "class App::Main < Base", "class", "App::Main"), ("ruby", "module Util", "type", "Util"), ("ruby", "def self.valid?(x)", "function", "valid?"), ("ruby", "def name=(v)", "function", "name="),
    ("swift", "public final class View: Base {", "class", "View"), ("swift", "protocol Drawable {", "interface", "Drawable"), ("swift", "struct Size {", "type", "Size"), ("swift", "override func draw() {", "function", "draw"),
    ("swift", "class func make() {", "class", "func"), ("dart", "abstract class Shape {", "class", "Shape"), ("dart", "mixin Walks {", "type", "Walks"), ("dart", "void main() {", "function", "main"), ("dart", "main() {", "function", "n"),
    ("dart", "Future<int> load() async {", "function", "load"), ("dart", "if (x) {", "function", "f"), ("shell", "deploy-all() {", "function", "deploy-all"), ("shell", "function clean_up {", "function", "clean_up"),
    ("shell", "echo hi", None, None), ("powershell", "Function Get-Item2 {", "function", "Get-Item2"), ("powershell", "CLASS Node {", "class", "Node"), ("lua", "---@class app.Server", "class", "app.Server"),
    ("lua", "---@alias Id string", "type", "Id"), ("lua", "--- @enum Mode", "type", "Mode"), ("lua", "local M = {}", "class", "M"), ("lua", "function M:run()", "function", "M:run"), ("lua", "M.stop = function()", "function", "M.stop"),
    ("lua", 'M["load-user"] = function()', "function", "load-user"), ("lua", "local P = setmetatable({}, M)", "class", "P"), ("lua", "-- local X = {}", None, None),
    ("javascript", "export default abstract class App {", "class", "App"), ("javascript", "export interface Props {", "interface", "Props"), ("vue", "export type Id = string", "type", "Id"),
    ("javascript", "export default async function load() {", "function", "load"), ("typescript", "export const go = async (a) => {", "function", "go"), ("javascript", "const id = x => x", "function", "id"),
    ("rust", "fn foo <T>(x: T) {", "function", "foo"), ("rust", "fn foo<>(x) {", None, None), ("cpp", "template <template <class> class T> class Foo {", "class", "T"), ("cpp", "template<> class Foo<int> {", None, None),
    ("cpp", "template <class A, class B = X<A>> struct Foo {", None, None),
    ("javascript", "const n = 5", None, None), ("javascript", "export default class {", None, None), ("javascript", "enum Mode { A }", None, None),
]


def test_declarations(spark):
    rows = spark.createDataFrame(LINES, "language string, line string, kind string, name string").withColumn("d", grammar.declaration(F.col("line"), F.col("language"))).collect()
    assert [tuple(r) for r in rows if (r["d"] or {"kind": None})["kind"] != r["kind"] or (r["d"] and r["d"]["name"] != r["name"])] == []


PYTHON = """class A:
    def m(self):
        pass
    class B(A):
        def n(self):
            def inner(): pass
    def k(self): pass
# c
async def top():
    pass
class C[T]:
  def q(self): pass"""


def test_python_symbols(spark):
    files = spark.createDataFrame([("w", "a.py", PYTHON), ("w", "b.py", ""), ("w", "c.py", None)], "workspace_folder string, relative_path string, content string")
    got = extract.symbols(files).where("relative_path = 'a.py'").orderBy("line").collect()
    assert [(r["kind"], r["name"], r["container_name"], r["line"], r["character"]) for r in got] == [
        ("class", "A", None, 0, 0), ("function", "A.m", "A", 1, 4), ("class", "B", None, 3, 4), ("function", "B.n", "B", 4, 8),
        ("function", "B.inner", "B", 5, 12), ("function", "A.k", "A", 6, 4), ("function", "top", None, 8, 0), ("function", "q", None, 11, 2),
    ]


def test_ignore(spark):
    def holds(path, test):
        return spark.createDataFrame([(path,)], "p string").select(test(F.col("p"))).first()[0]

    full = lambda *lines: lambda p: ignore.matches_globs(p, ignore.to_globs(list(lines)))
    lite = lambda *lines: lambda p: ignore.lite_ignored(p, list(lines))
    assert holds("game/assets/a.lua", full("assets/")) and not holds("game/assets/a.lua", lite("assets/")) and holds("game/assets/a.lua", ignore.lite_excluded)
    assert holds("x/Y.SNAP", full("*.snap")) and not holds("x/y.snap", lite("*.snap"))
    assert not holds("src/gen/a.ts", full("src/gen")) and holds("src/gen/a.ts", lite("src/gen"))
    assert holds("src/a/b/x1.ts", full("src/**/x?.ts")) and holds("src/x1.ts", full("src/**/x?.ts"))
    assert holds("a/legacy.ts", full("legacy.ts")) and holds("A/Build/x.ts", ignore.watch_excluded)
    assert ignore.to_globs(["!keep/", "# note"]) == []
    assert languages.scope("class") == languages.SCOPES["classes"] and languages.scope("what") == languages.SCOPES["all"]


def test_sync(spark):
    ddl = "workspace_folder string, relative_path string, size long, mtime_ms double"
    old = spark.createDataFrame([("w", x, 10, 1.0) for x in "abcd"], ddl)
    new = spark.createDataFrame([("w", "a", 10, 1.0), ("w", "b", 11, 1.0), ("w", "c", 10, 2.0), ("w", "e", 5, 1.0), ("w", "d", extract.SIZE_CAP + 1, 2.0)], ddl)
    assert tuple(sync.counters(sync.classify(old, new)).first()) == (5, 1, 2, 0)
    assert sorted((r["relative_path"], r["fresh"]) for r in sync.merge(old, new).collect()) == [("a", 0), ("b", 1), ("c", 1), ("e", 1)]
    assert tuple(sync.counters(sync.classify(old, new.where("relative_path <> 'd'"))).first()) == (4, 1, 2, 1)
    assert sync.counters(sync.classify(old, old)).first()["updated"] == 0
    assert sync.classify(old.where("false"), new.where("false")).count() == 0


def test_tree_round_trip(spark, tmp_path):
    root = tmp_path / "tree"
    (root / "src").mkdir(parents=True)
    (root / "node_modules").mkdir()
    (root / "src" / "service.py").write_text("class UserService:\n    def create_user(self):\n        pass\n\nasync def load_user():\n    pass\n")
    (root / "module.lua").write_text('local M = {}\nfunction M:run()\nend\nM["load-user"] = function()\nend\n')
    (root / "node_modules" / "x.js").write_text("class X {}")
    (root / "big.py").write_text("x" * (extract.SIZE_CAP + 1))
    (root / "notes.md").write_text("# no")
    index = store.build(store.scan(spark, str(root)), created_at="t")
    names = {r["name"] for r in index.symbols.collect()}
    assert {"UserService", "UserService.create_user", "load_user", "M", "M:run", "load-user"} <= names and "X" not in names
    at = str(tmp_path / "index")
    assert store.read_index(spark, at) is None
    store.write_index(index, at)
    back = store.read_index(spark, at)
    assert back.meta.first()["file_count"] == 2 and back.symbols.count() == index.symbols.count() and back.text_lines.count() == index.text_lines.count()
    js = str(tmp_path / "json")
    store.write_json(index, js)
    rows = store.read_json(spark, js, strict=True)
    assert rows.count() == 2 and store.unnested(rows)[1].count() == index.symbols.count()
    (tmp_path / "json" / "files.jsonl" / "part-bad.json").write_text("{not json\n")
    assert store.read_json(spark, js).count() == 2 and store.read_json(spark, js, strict=True) is None
    lines = str(tmp_path / "lines")
    index.text_lines.write.partitionBy("shard").parquet(lines)
    gone = index.files.where("relative_path = 'module.lua'").select("workspace_folder", "relative_path")
    store.rewrite_shards(spark, lines, gone, spark.read.parquet(lines).where("false"), str(tmp_path / "stage"))
    assert {r["relative_path"] for r in spark.read.parquet(lines).collect()} == {"src/service.py"}
    store.clear_index(spark, at)
    assert store.read_index(spark, at) is None
    summary = sync.summary(index.files, index.symbols, "t").first()
    assert "Files: 2" in sync.printed_summary(summary, at, 0.5)


def test_budget(spark):
    files = spark.createDataFrame([("w", f"{i:03}", "\n".join("abcdefgh"), i) for i in range(20)], "workspace_folder string, relative_path string, content string, file_ord long")
    got = extract.budgeted_text_lines(files, 60, 5, 4).groupBy("relative_path").count().collect()
    by = {r["relative_path"]: r["count"] for r in got}
    assert [by.get(f"{i:03}", 0) for i in range(20)] == [5] * 12 + [0] * 8
    assert extract.budgeted_text_lines(files, 1000, 5, 4).count() == 100


def test_stream_equals_batch(spark, tmp_path):
    src = str(tmp_path / "feed")
    rows = [(f"src/{i % 7}.go", "del" if i % 5 == 0 else "up", 1000 + i, i) for i in range(60)] + [("src/x.md", "up", 5000, 99), ("build/y.go", "up", 5001, 100)]
    df = spark.createDataFrame(rows, "path string, action string, t long, seq long").select("path", "action", F.timestamp_seconds("t").alias("ts"), "seq")
    df.write.parquet(src)
    seen = {}

    def handler(batch, _):
        for r in batch.collect():
            seen[r["path"]] = r["action"]

    q = watch.start_watch(spark.readStream.schema(df.schema).parquet(src), str(tmp_path / "ck"), handler, handler, once=True)
    q.awaitTermination(120)
    assert seen == {r["path"]: r["action"] for r in watch.coalesced(watch.guarded(df)).collect()}
    assert watch.route(df) == "single" and watch.route(df, 3) == "sync"


def test_index_without_lines(spark, tmp_path):
    at, ddl = str(tmp_path / "index"), "workspace_folder string, relative_path string, absolute_path string, size long, mtime_ms double, content string"
    files = spark.createDataFrame([("w", "a.go", "a.go", 600, 1.0, "func " + "a" * 590 + "() {"), ("w", "b.go", "b.go", 0, 1.0, "")], ddl)
    store.sync_index(spark, at, files, created_at="t")
    back = store.read_index(spark, at)
    assert (back.files.count(), back.symbols.count(), back.text_lines.count()) == (2, 1, 0)
    one = files.where("relative_path = 'b.go'").withColumns({"content": F.lit("func b() {"), "size": F.lit(10).cast("long")})
    store.sync_index(spark, at, files.where("false").unionByName(one), created_at="u")
    assert [tuple(r) for r in store.read_index(spark, at).text_lines.select("relative_path", "line", "text").collect()] == [("b.go", 0, "func b() {")]
    name = store.sync_index(spark, at, files.where("false"), created_at="v")
    back = store.read_index(spark, at)
    assert (back.files.count(), back.symbols.count(), back.text_lines.count()) == (0, 0, 0)
    fresh = store.build(one).text_lines
    store.rewrite_shards(spark, f"{at}/{name}/text_lines", one, fresh, f"{at}/staging")
    assert back.text_lines.columns == store.read_index(spark, at).text_lines.columns and store.read_index(spark, at).text_lines.count() == 1


def test_sync_by_size(spark, tmp_path):
    ddl = "workspace_folder string, relative_path string, absolute_path string, size long, mtime_ms double, content string"
    files = spark.createDataFrame([("w", f"{n}.go", "", n, 1.0, f"func f{n}() {{") for n in (5, 6, extract.SIZE_CAP + 1)], ddl)
    for i, (options, kept) in enumerate([({}, 2), ({"cap": 5}, 1), ({"cap": None}, 3)]):
        at = str(tmp_path / f"index{i}")
        for t in (1.0, 2.0):  # built, then synced: the same files
            store.sync_index(spark, at, files.withColumn("mtime_ms", F.lit(t)), created_at="t", **options)
            assert store.read_index(spark, at).symbols.count() == store.read_index(spark, at).meta.first()["file_count"] == kept


def _large_files(spark, folder, name):
    """Rows of a query and of its SQL over parts whose files are larger than SIZE_CAP, lines too long for text lines."""
    from seekframe.plans import catalogue

    duckdb = pytest.importorskip("duckdb")
    parts = spark.range(1300).select(F.col("id").alias("p_partkey"), F.concat(F.lit("Brand#1"), (F.col("id") % 5 + 1).cast("string")).alias("p_brand"), F.concat(F.lit("p "), F.lpad(F.col("id").cast("string"), 5000, "x")).alias("p_name"))
    parts.write.parquet(f"{folder}/part.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW part AS SELECT * FROM read_parquet('{folder}/part.parquet/*.parquet')")
    df = catalogue.QUERIES[name](spark, str(folder))
    found = con.sql(catalogue.ORACLE_SQL[name])
    assert df.columns == found.columns
    return sorted(map(tuple, df.collect())), sorted(found.fetchall())


def test_sync_snapshot_of_large_files(spark, tmp_path):
    got, told = _large_files(spark, tmp_path, "sync_snapshot")
    assert got == told and len(got) > 700


def test_update_snapshot_of_large_files(spark, tmp_path):
    got, told = _large_files(spark, tmp_path, "update_snapshot")
    assert got == told and len(got) > 600


def test_ordinals(spark):
    ddl = "workspace_folder string, relative_path string, absolute_path string, size long, mtime_ms double, content string"
    files = spark.createDataFrame([("w", "b.py", "", 1, 1.0, "\nclass A:\n  def m(self): pass"), ("w", "a.go", "", 1, 1.0, "func f() {\n\ntype T string")], ddl)
    for total in (None, 100):
        index = store.build(files, total=total, created_at="t")
        assert [(r["name"], r["ord"]) for r in index.symbols.orderBy("ord").collect()] == [("f", 0), ("T", 2), ("A", (1 << 32) + 1), ("A.m", (1 << 32) + 2)]
        assert [(r["relative_path"], r["ord"]) for r in index.text_lines.orderBy("ord").collect()] == [("a.go", 0), ("a.go", 2), ("b.py", (1 << 32) + 1), ("b.py", (1 << 32) + 2)]
        assert index.symbols.columns == ["workspace_folder", "relative_path", "line", "character", "kind", "name", "container_name", "signature", "ord"]
        assert index.text_lines.columns == ["workspace_folder", "relative_path", "line", "text", "shard", "ord"]
