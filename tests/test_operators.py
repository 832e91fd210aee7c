import datetime as dt

import numpy as np

from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import chunks, report, search, state, structure, verify
from lodestone.sources import corpus
from lodestone.sources.corpus import files_from_rows


def test_directory_source(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "src/a.py").write_text("x = 1\n")
    (tmp_path / "src/latin.py").write_bytes("é = 1".encode("latin-1"))
    (tmp_path / "src/empty.py").write_text("")
    (tmp_path / "src/big.py").write_text("y" * 2000)
    (tmp_path / "src/a.bin").write_bytes(b"\0\1")
    (tmp_path / "node_modules/x.js").write_text("1")
    files, skipped = corpus.read_directory(spark, str(tmp_path), max_bytes=1000)
    assert {(r.path, r.content) for r in files.collect()} == {("src/a.py", "x = 1\n"), ("src/latin.py", "é = 1")}
    assert {(r.path, r.reason) for r in skipped.collect()} == {("src/big.py", "too large")}


def test_lines_and_corpus_text(spark):
    f = files_from_rows(spark, [("a.py", ""), ("b.py", "x\n"), ("c.PY", "\n")])
    assert [(r.path, r.line_no, r.line) for r in corpus.lines(f).collect()] == [("a.py", 1, ""), ("b.py", 1, "x"), ("b.py", 2, ""), ("c.PY", 1, ""), ("c.PY", 2, "")]
    assert [r.extension for r in f.collect()] == [".py", ".py", ".py"]
    text = "### File: a.py\n```py\nold\n```\n\n### File: b.md\n```md\n# T\n```\n\n### File: a.py\n```py\nx = 1\ny = 2\n```\n"
    got = corpus.parse_corpus(spark.createDataFrame([(text,)], "t string"), F.col("t"))
    assert {(r.path, r.content) for r in got.collect()} == {("a.py", "x = 1\ny = 2"), ("b.md", "# T")}


def test_budget_is_first_fit(spark):
    f = files_from_rows(spark, [("a", "x" * 40), ("b", "x" * 80), ("c", "x" * 20), ("d", "x" * 4000)])
    assert sorted(r.path for r in corpus.within_budget(f, 20).collect()) == ["a", "c"]


def test_search_options(spark):
    f = files_from_rows(spark, [("a.py", "Alpha a.b\nalphabet\nalpha # skip"), ("b.js", "ALPHA")])
    assert search.search(f, "alpha").count() == 4 and search.search(f, "alpha", ignore_case=False).count() == 2
    assert search.search(f, "alpha", word=True).count() == 3 and search.search(f, "alpha", suffix=".py", exclude="skip").count() == 2
    assert [r.match for r in search.search(f, "a.b", fixed=True).collect()] == ["a.b"] and search.search(f, "a.+b").count() == 2
    assert search.search(f, "alpha", per_file=1).count() == 2
    assert [r.n_matches for r in search.grep(f, "alpha", "count").orderBy("path").collect()] == [3, 1]
    assert search.find_file(f, "b").first().path == "b.js" and search.suggestions(f, "A.PY").first().path == "a.py"
    c = search.custom_search(f, "alpha", confidence="HIGH", max_results=2)
    assert [r.confidence for r in c.collect()] == ["HIGH", "HIGH"]


def test_context_at_the_ends(spark):
    r = search.with_context(files_from_rows(spark, [("a", "hit\nb\nc\nd\nhit")]), "hit", 2, 2).orderBy("line_no").collect()
    assert [(x.line_no, list(x.context_before), list(x.context_after)) for x in r] == [(1, [], ["b", "c"]), (5, ["c", "d"], [])]


def test_packing(spark):
    df = spark.createDataFrame([(["aaaa", "bb", "cccccccccc", "", "d", "e"],)], "p array<string>")
    assert df.select(chunks.pack(F.col("p"), 8, "-")).first()[0] == ["aaaa-bb", "cccccccccc", "d-e"]
    f = files_from_rows(spark, [("a.md", "# One\ntext\n## Two\nmore"), ("b.txt", "A b. C d! E f"), ("c.txt", "")])
    md = chunks.markdown_chunks(f.where("path = 'a.md'"), 12).orderBy("chunk_id").collect()
    assert [x.section_title for x in md] == ["One", "Two"]
    assert [x.content for x in chunks.sentence_chunks(f.where("path = 'b.txt'"), 10).orderBy("chunk_id").collect()] == ["A b. C d!", "E f"]
    assert chunks.fixed_chunks(f.where("path = 'c.txt'")).count() == 0
    assert max(len(x.content) for x in chunks.section_chunks(files_from_rows(spark, [("a", "x" * 100)]), 30).collect()) == 30


def test_function_chunks_and_lengths(spark):
    f = files_from_rows(spark, [("a.py", "import x\ndef one():\n    a\n    b\ndef two():\n    c")])
    got = structure.functions(f).orderBy("start_line").collect()
    assert [(r.name, r.start_line, r.end_line, r.length) for r in got] == [("one", 2, 4, 3), ("two", 5, 6, 2)]
    assert [(r.name, r.content) for r in chunks.function_chunks(f).orderBy("start_line").collect()] == [("one", "def one():\n    a\n    b"), ("two", "def two():\n    c")]


def test_json_chunks(spark):
    f = files_from_rows(spark, [("a.json", '[{"x": 1}, 2]'), ("b.json", '{"k": [1], "m": "t"}'), ("c.json", "no json {")])
    got = {(r.path, r.key, r.content) for r in chunks.json_chunks(f).collect()}
    assert got == {("a.json", None, '{"x":1}'), ("a.json", None, "2"), ("b.json", "k", "[1]"), ("b.json", "m", '"t"')}


def test_summary_tree(spark):
    c = spark.createDataFrame([("a", k) for k in range(9)] + [("b", 0)], "path string, chunk_id int")
    got = {(r.path, r.level, r.node, r.first_chunk, r.last_chunk) for r in chunks.summary_tree(c).where("level > 0").collect()}
    assert got == {("a", 1, 0, 0, 2), ("a", 1, 1, 3, 5), ("a", 1, 2, 6, 8), ("a", 2, 0, 0, 8)}


def test_summary_tree_joins_no_levels(spark):
    ids = {"a": list(range(30)), "gaps": [0, 3, 3, 50, 51, 99], "below": [-3, -2, 0, 4], "one": [7]}
    c = spark.createDataFrame([(p, k) for p, of in ids.items() for k in of] + [(None, 1)], "path string, chunk_id int")
    tree = chunks.summary_tree(c)
    want = []
    for p, of in ids.items():
        level, group = [(k, k, k) for k in of], int(np.ceil(np.sqrt(len(of))))
        want += [(p, 0, *x) for x in level]
        for n in (1, 2, 3):
            if len(level) > 1:
                parents = sorted({x[0] // group for x in level})
                level = [(q, min(x[1] for x in level if x[0] // group == q), max(x[2] for x in level if x[0] // group == q)) for q in parents]
                want += [(p, n, *x) for x in level]
                group = max(group, 2)
    assert sorted(map(tuple, tree.collect())) == sorted(want)
    assert "Join" not in tree._jdf.queryExecution().executedPlan().toString()


def test_regions_nest(spark):
    f = files_from_rows(spark, [("a.swift", "#if false\n#if DEBUG\n#endif\nx\n#endif\n#if DEBUG\n#if false\ny\n#endif\n#endif\n#if 0")])
    assert [(r.start_line, r.end_line) for r in structure.dead_regions(f).orderBy("start_line").collect()] == [(1, 5), (7, 9), (11, 11)]


def test_call_graph(spark):
    f = files_from_rows(spark, [("a.py", "def a():\n    b()\n    ext()\ndef b():\n    if c(1):\n        pass\ndef c(x):\n    return x")])
    e = structure.call_edges(f)
    assert {(r.caller, r.callee, r.internal) for r in e.collect()} == {("a", "b", True), ("a", "ext", False), ("b", "c", True)}
    assert {(r.name, r.depth) for r in structure.reachable(e, "a").collect()} == {("a", 0), ("b", 1), ("ext", 1), ("c", 2)}


def test_imports_and_architecture(spark):
    f = files_from_rows(spark, [("src/views/test_view.py", "from os import path\nimport re\nimport re\nclass A:\n    def f(self):\n"), ("main.ts", "import {a, b} from './x'\nimport y from 'z'\nexport const q = 1"), ("conf.yaml", "a: 1")])
    assert {(r.kind, r.imported, r.module) for r in structure.import_edges(f).collect()} == {("named", "a, b", "./x"), ("default", "y", "z")}
    assert {(r.kind, r.exported) for r in structure.exports(f).collect()} == {("declaration", "q")}
    assert structure.import_frequency(f).first().module == "re"
    assert {(r.category, r.n_files, r.n_classes) for r in structure.architecture(f).collect()} == {("views", 1, 1), ("entry", 1, 0), ("config", 1, 0)}


def test_resolution_and_verification(spark):
    f = files_from_rows(spark, [("src/auth.py", "a\nb"), ("lib/auth.py", "c"), ("web/Main.swift", "x")])
    t = spark.createDataFrame([("See `src/auth.py:2`, auth.py:9 and other/Main.swift:1; gone.py:3, src/auth.py:2.",)], "text string")
    refs = verify.references(t).select("file", "line")
    got = {(r.file, r.line): (r.resolved, r.match_rank, r.in_range, r.text) for r in verify.verify_lines(refs, f).collect()}
    assert got == {("src/auth.py", 2): ("src/auth.py", 0, True, "b"), ("auth.py", 9): ("src/auth.py", 1, False, None), ("other/Main.swift", 1): ("web/Main.swift", 2, True, "x"), ("gone.py", 3): (None, None, False, None)}
    stats = verify.verification_stats(verify.verify_lines(refs, f)).first()
    assert (stats.files, stats.files_found, stats.refs, stats.lines_ok) == (4, 3, 4, 2) and stats.level in ("LOW", "MEDIUM")
    none = verify.verification_stats(verify.verify_lines(refs.where("false"), f)).first()
    assert none.level == "HIGH"


def test_clamping_and_stubs(spark):
    f = files_from_rows(spark, [("a.py", "def f():\n    pass\ndef g():\n    return 1 + 1\n")])
    x = spark.createDataFrame([("a.py", 99, "c", "HIGH"), ("b.py", 99, "c", "HIGH")], "file string, line int, code string, confidence string")
    assert [(r.line, r.confidence) for r in verify.clamp_lines(x, f).orderBy("file").collect()] == [(5, "LOW"), (99, "HIGH")]
    assert verify.implementation_status(f, "f").first().is_stub and not verify.implementation_status(f, "g").first().is_stub


def test_similarities(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([1.0], [1.0, 0.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    assert [r[0] for r in df.select(T.cosine(df.a, df.b)).collect()] == [1.0, 0.0, 0.0]
    cache = spark.createDataFrame([(1, "a b c d e f g h i j"), (2, "a b c d e f g x y z"), (3, "one")], "key int, text string")
    q = spark.createDataFrame([(7, "a b c d e f g h i k"), (8, "q r"), (9, "one")], "query_id int, text string")
    assert [(r.query_id, r.key) for r in state.nearest_by_words(q, cache).collect()] == [(7, 1)]


def test_expiry_boundaries(spark):
    now = dt.datetime(2026, 1, 1, 1)
    c = spark.createDataFrame([(now - dt.timedelta(seconds=60), 1), (now - dt.timedelta(seconds=61), 2)], "ts timestamp, k int")
    assert [r.k for r in state.not_expired(c, F.lit(now), 60).collect()] == [1] and state.not_expired(c, F.lit(now), 60, inclusive=False).count() == 0


def test_memory(spark):
    t = lambda s: dt.datetime(2026, 1, 1, 0, 0, s)
    m = spark.createDataFrame([("a", "va", ["x"], 1, 10, t(1)), ("b", "vb", ["y", "x"], 1, 20, t(2)), ("c", "Vc", [], 1, 30, t(3))], state.MEMORY)
    assert state.upsert(m, m.where("key = 'a'").withColumn("value", F.lit("new")).withColumn("stored_at", F.lit(t(9)))).where("key = 'a'").first().value == "new"
    assert {r.key for r in state.by_tags(m, ["x"]).collect()} == {"a", "b"} and state.recall(m, part="VC").first().key == "c" and state.recall(m, key="b").first().value == "vb"
    assert {r.key for r in state.evict_by_size(m, 15).collect()} == {"c"} and {r.key for r in state.evict_oldest(m, 3, 1).collect()} == {"b", "c"} and state.evict_oldest(m, 4, 1).count() == 3
    assert state.memory_stats(m).first().total_bytes == 60 and state.delete(m, ["a"]).count() == 2


def test_metrics_and_breaker(spark):
    df = spark.createDataFrame([("f", float(k)) for k in range(10)], "n string, v double")
    r = report.metrics(df, "n", "v").first()
    assert (r.p50, r.p95, r.p99) == (5.0, 9.0, 9.0)
    t = lambda s: dt.datetime(2026, 1, 1, 0, s // 60, s % 60)
    calls = spark.createDataFrame([(1, k, t(s), f) for k, (s, f) in enumerate([(0, True), (1, True), (2, False), (70, False), (71, True)])], "user_id int, event_id int, ts timestamp, failed boolean")
    b = state.breaker(calls, "user_id", 2, 60).first()
    assert (b.n_calls, b.n_refused, b.open_at_end) == (5, 1, False)


def test_routing(spark):
    q = ["find all issues", 'search "abc"', "explain 'abc'", "xss", "review the auth module, the cache, and the database layer in depth please now"]
    r = spark.createDataFrame([(x,) for x in q], "q string").select(T.query_mode(F.col("q")).alias("m"), T.query_type(F.col("q")).alias("t"), T.is_broad_query(F.col("q")).alias("b")).collect()
    assert [x.m for x in r] == ["scanner", "literal", "scanner", "scanner", "semantic"] and r[3].t == "security" and [x.b for x in r[:1]] == [True]


def test_report(spark):
    from lodestone.operators import scanners
    from lodestone.plans import sample

    found = scanners.scan(sample.files(spark), ["secrets", "todos"])
    text = report.markdown(found, 2)
    assert text.startswith("# Findings") and "more" in text and "src/app.py" in text
    assert report.ranked(found).first().severity == "CRITICAL"


def test_map_reduce(spark):
    c = spark.createDataFrame([(1, "a", 0, "token " * 100), (1, "a", 1, "other " * 100), (1, "a", 2, "short")], "file_seq long, path string, chunk_id int, content string")
    got = chunks.map_chunks(c, "token")
    assert {r.chunk_id: r.relevance for r in got.collect()} == {0: 1.0, 2: 0.5}
    assert [r.chunk_id for r in chunks.merge_results(got, 200).collect()] == [0]
