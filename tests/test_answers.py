import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodestone.operators import answers, chunks, scanners, search, state, verify
from lodestone.plans import sample
from lodestone.sources import corpus
from lodestone.sources.corpus import files_from_rows


def test_sanitized(spark):
    df = spark.createDataFrame([("**a** *b* __c__ _d_ `e` {f}\n\n\n\n## g\n```py\nh",), (None,)], "q string")
    assert [r[0] for r in df.select(answers.sanitized(F.col("q"))).collect()] == ["a b c d e {{f}}\n\ng\nh", None]


def test_numbered_items(spark):
    df = spark.createDataFrame([(1, "Find (1) race conditions in table_remove (2) missing validation before assignAgent."), (2, "leaks in swift, slow loops and x"), (3, '(1) "Ab C" D (2) (3) Z')], "id int, query string")
    got = {(r.id, r.number): (r.description, r.pattern, r.file_filter) for r in answers.numbered_items(df).collect()}
    assert got[1, 1] == ("race conditions in table_remove", "table_remove", None)
    assert got[1, 2] == ("missing validation before assignAgent", "assignAgent", None)
    assert got[2, 1] == ("leaks in swift", "leaks|swift", ".swift") and (2, 3) not in got and (3, 2) not in got
    assert got[3, 3][1] == ".*" and got[3, 1][1] == "Ab\\ C"


@pytest.mark.parametrize("context,valid,reason", [("x = 1 # os.system(cmd)", False, "in a comment"), ('"""\nuse OS.SYSTEM(CMD)\n"""', False, "in a docstring"), ("/* os.system(cmd) */", False, "in a block comment"), ("/* os.system(cmd)", True, "verified"), ("os.system(cmd) # note", True, "verified"), ("assert os.system(cmd)", True, "near tests")])
def test_context_check(spark, context, valid, reason):
    df = spark.createDataFrame([("os.system(cmd)", context)], "code string, context string")
    assert tuple(df.select(answers.context_check(F.col("code"), F.col("context")).alias("c")).select("c.*").first()) == (valid, reason)


def test_numbered_and_marked_texts(spark):
    f = files_from_rows(spark, [("a/b.swift", "one\n#if false\n#if DEBUG\ntwo\n#endif\n#endif\nthree"), ("c.py", "x"), ("d.swift", "#if 0\nopen")])
    assert answers.numbered_text(f, "b.swift", 2).first().text == "1: one\n2: #if false\n... (5 more lines)"
    got = {r.path: r.content for r in answers.marked_dead_code(f).collect()}
    assert got["a/b.swift"] == "one\n[DEAD CODE START: #if false]\n#if false\n#if DEBUG\ntwo\n#endif\n#endif\n[DEAD CODE END]\nthree"
    assert got["c.py"] == "x" and got["d.swift"] == "[DEAD CODE START: #if 0]\n#if 0\n[DEAD CODE END]\nopen"


def test_enhanced_and_subquestions(spark):
    df = spark.createDataFrame([("look", "ios"), ("look", "cooking")], "q string, type string")
    texts = [r[0] for r in df.select(answers.enhanced(F.col("q"), F.col("type"))).collect()]
    assert texts[0].startswith("look\n\nLook at: memory") and texts[1].startswith("look\nGive file")
    n = {r.type: r["count"] for r in answers.subquestions(spark, df).groupBy("type").count().collect()}
    assert n == {"ios": len(answers.SUBQUESTIONS["ios"]), "cooking": 4}


def test_caches(spark):
    rows = [("k1", "old", 1), ("k2", "b", 2), ("k3", "c", 3)]
    cache = spark.createDataFrame(rows, "key string, response string, at int").withColumn("ts", F.timestamp_seconds("at")).drop("at")
    new = spark.createDataFrame([("k1", "new", 9)], "key string, response string, at int").withColumn("ts", F.timestamp_seconds("at")).drop("at")
    assert {(r.key, r.response) for r in state.cache_put(cache, new, 2).collect()} == {("k1", "new"), ("k3", "c")}
    assert state.clear(cache).count() == 0


def test_cache_load_keeps_valid_entries(spark, tmp_path):
    cache = spark.createDataFrame([("a", 1), ("b", 50), ("c", 100)], "key string, at int").withColumn("ts", F.timestamp_seconds("at")).drop("at")
    cache.write.parquet(str(tmp_path / "cache"))
    got = state.cache_load(spark, str(tmp_path / "cache"), F.timestamp_seconds(F.lit(100)), 50)
    assert [r.key for r in got.collect()] == ["c"]


def test_nearest_by_vector_equals_brute_force(spark):
    rng = np.random.default_rng(0)
    q, c = rng.normal(size=(30, 8)), rng.normal(size=(200, 8))
    c[5] = c[9]
    q[3] = c[9]
    asked = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(q)] + [(99, None), (98, [0.0] * 8)], "query_id int, embedding array<double>")
    cached = spark.createDataFrame([(f"key{k:03}", v.tolist()) for k, v in enumerate(c)] + [("short", [1.0]), ("zero", [0.0] * 8), ("none", None)], "key string, embedding array<double>")
    cos = (q @ c.T) / np.linalg.norm(q, axis=1)[:, None] / np.linalg.norm(c, axis=1)
    want = {k: (f"key{int(row.argmax()):03}", round(float(row.max()), 9)) for k, row in enumerate(cos) if row.max() >= 0.3}
    for pass_bytes in (64 << 20, 2000):
        got = {r.query_id: (r.key, round(r.similarity, 9)) for r in state.nearest_by_vector(asked, cached, 0.3, pass_bytes).collect()}
        assert got == want and got[3][0] == "key005"
    words = spark.createDataFrame([(1, "alpha beta gamma")], "query_id int, text string")
    texts = spark.createDataFrame([("b", "alpha beta gamma"), ("a", "gamma beta alpha")], "key string, text string")
    assert state.nearest_by_words(words, texts).first().key == "a"


def test_nearest_by_vector_keeps_no_side_in_one_place(spark, monkeypatch):
    asked = spark.createDataFrame([(k, [float(k % 3), 1.0]) for k in range(40)], "query_id int, embedding array<double>")
    held = spark.createDataFrame([(100 + k, [float(k % 5), 1.0]) for k in range(90)], "key int, embedding array<double>")

    def refuse(*_):
        raise AssertionError("a side was collected or sent")

    monkeypatch.setattr(type(spark.sparkContext), "broadcast", refuse)
    monkeypatch.setattr(type(asked), "toArrow", refuse)
    for pass_bytes in (64 << 20, 300):
        got = {r.query_id: (r.key, r.similarity) for r in state.nearest_by_vector(asked, held, 0.5, pass_bytes).collect()}
        assert got == {k: (100 + k % 3, 1.0) for k in range(40)}
    assert state.nearest_by_vector(asked, held.where("false"), -1.0).count() == 0


def test_best_of_equal_products_is_the_first_key_of_any_tile():
    held = np.array([[1.0, 0.0], [0.0, 1.0], [0.6, 0.8], [0.0, 1.0], [1.0, 0.0]])
    asked = np.array([[0.0, 1.0], [1.0, 0.0], [np.nan, 1.0]])
    for tile in (1, 2, 5):
        got = state._best(asked, held, pd.Series([7, 8, 9]), pd.Series(list("abcde")), tile)
        assert got[:2] == [(7, "b", 1.0), (8, "a", 1.0)] and got[2][:2] == (9, "a") and np.isnan(got[2][2])


def test_nearest_by_words_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = []
    for k in range(300):
        base = rows[int(rng.integers(k))][1].split() if k % 3 else []
        own = [w for w in base if rng.random() > 0.1] + [f"w{int(x)}" for x in rng.zipf(1.3, int(rng.integers(1, 4 if base else 30))) % 400]
        rows.append((k, " ".join(own)))
    df = spark.createDataFrame(rows, "id int, text string")
    q, c = df.where("id % 4 = 0").withColumnRenamed("id", "query_id"), df.where("id % 4 <> 0").withColumnRenamed("id", "key")
    sets = {k: set(t.split()) for k, t in rows if len(set(t.split())) >= 2}
    for least in (0.5, 0.7, 0.8):
        want = {}
        for k in [k for k in sets if k % 4 == 0]:
            scored = [(-len(sets[k] & v) / len(sets[k] | v), j) for j, v in sets.items() if j % 4]
            if -min(scored)[0] >= least:
                want[k] = (min(scored)[1], -min(scored)[0])
        got = {r.query_id: (r.key, r.similarity) for r in state.nearest_by_words(q, c, least).collect()}
        assert got == want and len(want) > 9


def test_nearest_by_words_of_an_id_that_repeats(spark):
    words = [" ".join(f"{x}{k}" for k in range(10)) for x in "ab"]
    asked = spark.createDataFrame([(1, words[0]), (1, words[1])], "query_id int, text string")
    held = spark.createDataFrame([(5, words[1] + " z"), (6, words[1] + " z"), (4, "c d"), (None, words[1])], "key int, text string")
    assert [(r.key, round(r.similarity, 6)) for r in state.nearest_by_words(asked, held).collect()] == [(5, round(10 / 11, 6))]


def test_context_stats_collects_no_row_a_document(spark):
    c = spark.createDataFrame([(f"p{k % 9}", k // 9, 2) for k in range(40)] + [("one", 0, None), (None, 0, 5)], "path string, chunk_id int, token_count int")
    stats = answers.context_stats(c, chunks.summary_tree(c))
    assert tuple(stats.first()) == (10, 85, 42, [0] + [2] * 9)
    assert "collect_list(depth#" not in stats._jdf.queryExecution().optimizedPlan().toString()
    none = c.where("false")
    assert tuple(answers.context_stats(none, chunks.summary_tree(none)).first()) == (0, 0, 0, [])


def test_null_contents_and_summary(spark):
    f = files_from_rows(spark, [("a.js", "a(function(e) { b(function(e) {\nc(function(e) { d(function(e) {"), ("b.js", "x")]).unionByName(spark.createDataFrame([(9, "n.js", ".js", None, None, None)], files_from_rows(spark, [("x", "y")]).schema))
    assert [r.file for r in scanners.callback_hell(f).collect()] == ["a.js"]
    for batch in ("node", "all"):
        scanners.run_batch(f, batch).count()
    rows = {r.tool: (r.n_found, r.n_kept) for r in scanners.scan_summary(files_from_rows(spark, [("test_a.py", "x = eval(y)"), ("a.js", "// TODO x")]), ["todos", "secrets", "callback_hell"], "HIGH").collect()}
    assert rows["secrets"] == (0, 0) and rows["callback_hell"] == (0, 0)


def test_batch_is_one_line_pass_and_one_python_pass(spark, tmp_path):
    sample.files(spark).write.parquet(str(tmp_path / "f"))
    f = spark.read.parquet(str(tmp_path / "f"))
    tools = [t for t in dict.fromkeys(scanners.BATCHES["all"]) if t != "long_functions"]
    plan = scanners.scan(f, tools)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 2 and plan.count("MapInPandas") == 1 and "Exchange" not in plan and "Window [" not in plan


def test_first_fit_equals_a_fold(spark):
    rng = np.random.default_rng(3)
    for budget in (0, 50, 400, 10_000):
        sizes = rng.integers(0, 40, 60).tolist()
        f = spark.createDataFrame([(k, f"p{k}", n) for k, n in enumerate(sizes)], "file_seq long, path string, token_count int")
        total, want = 0, []
        for k, n in enumerate(sizes):
            if total + n <= budget:
                total += n
                want.append(k)
        assert sorted(r.file_seq for r in corpus.within_budget(f, budget).collect()) == want


def test_evict_by_size_equals_a_fold(spark):
    rng = np.random.default_rng(4)
    rows = [(f"k{k:02}", int(rng.integers(0, 20)), int(rng.integers(0, 30_000))) for k in range(60)]
    m = spark.createDataFrame(rows, "key string, size_bytes int, at int").withColumn("stored_at", F.timestamp_seconds("at")).drop("at")
    for free in (0, 1, 100, 10_000):
        freed, left = 0, set()
        for key, size, _ in sorted(rows, key=lambda r: (r[2], r[0])):
            if freed >= free:
                left.add(key)
            freed += size
        assert {r.key for r in state.evict_by_size(m, free).collect()} == left


def test_literal_passes_give_the_same(spark):
    f = files_from_rows(spark, [("a", "Alpha beta\nGAMMA"), ("b", "beta beta"), ("c", "")])
    terms = spark.createDataFrame([("alpha",), ("BETA",), ("gam",), ("zeta",), ("",)], "term string")
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(search.literal_search(f, terms)) == key(search.literal_search(f, terms, pass_bytes=4)) and search.literal_search(f, terms).count() == 4


def test_invalid_patterns_are_told(spark):
    f = files_from_rows(spark, [("src/a.py", "x = 1\ny = Eval(z)")])
    refs = spark.createDataFrame([("src/a.py", 2, "eval\\("), ("a.py", 1, "eval("), ("a.py", 7, "x"), ("lost.py", 1, None)], "file string, line int, pattern string")
    got = {(r.file, r.line): (r.matches, r.in_range, r.pattern_error, r.n_lines) for r in verify.verify_lines(refs, f).collect()}
    assert got["src/a.py", 2] == (True, True, None, 2) and got["a.py", 7] == (False, False, None, 2) and got["lost.py", 1] == (False, False, None, None)
    assert got["a.py", 1][0] is False and got["a.py", 1][2].startswith("invalid pattern")


def test_clamped_by_a_part_of_the_path(spark):
    f = files_from_rows(spark, [("src/deep/a.py", "1\n2\n3")])
    found = spark.createDataFrame([("a.py", 9, "x", "HIGH"), ("deep/a.py", 3, "y", "HIGH"), ("b.py", 9, "z", "HIGH")], "file string, line int, code string, confidence string")
    got = {r.file: (r.line, r.confidence) for r in verify.clamp_lines(found, f).collect()}
    assert got == {"a.py": (3, "LOW"), "deep/a.py": (3, "HIGH"), "b.py": (9, "HIGH")}


def test_code_and_size_chunks(spark):
    code = "import x\n" + "\n".join(f"function f{k}() {{\n  return {k}\n}}" for k in range(6)) + "\nclass A {}\n"
    f = files_from_rows(spark, [("a.js", code), ("b.js", ""), ("c.js", "w " * 50)])
    got = chunks.code_chunks(f, 80).orderBy("file_seq", "chunk_id").collect()
    mine = [r for r in got if r.path == "a.js"]
    assert all(code[r.start : r.end] == r.content and len(r.content) <= 80 for r in mine) and [r.section_title for r in mine if r.content.startswith("function")][0] is not None
    assert "".join(r.content for r in mine).replace("\n", "") == code.replace("\n", "") and not [r for r in got if r.path == "b.js"]
    words = [r.content for r in chunks.size_chunks(files_from_rows(spark, [("t", "aa bb  cc\ndd eee " + "f" * 12 + " gg")]), 8, 1).orderBy("chunk_id").collect()]
    assert words[0] == "aa bb cc" and words[1] == "cc dd" and any("f" * 12 in w for w in words)


def test_timed_calls_are_metrics(spark):
    from lodestone.operators import report

    log = report.CallLog()

    @log.timed
    def half(x):
        return 1 / x

    half(2)
    with pytest.raises(ZeroDivisionError):
        half(0)
    got = report.metrics(log.table(spark), "function_name", "elapsed_ms", "success").first()
    assert got.function_name == "half" and got.n == 2 and got.success_rate == 0.5


def test_markdown(spark):
    from lodestone.operators import report

    f = sample.files(spark)
    found = scanners.scan(f, ["secrets", "todos"])
    assert report.totals_markdown(found).startswith(f"**{found.count()} findings** in")
    refs = spark.createDataFrame([("src/app.py", 1), ("app.py", 999), ("lost|a.py", 1)], "file string, line int")
    text = report.verification_markdown(verify.verify_lines(refs, f))
    assert "lines in range: 1 of 3" in text and "| app.py | 999 | src/app.py |" in text and "lost\\|a.py" in text
    judged = answers.judged_answers(spark.createDataFrame([(1, "find secrets", "")], "id int, query string, answer string"), f)
    assert report.answers_markdown(judged) == "- answer 1: **FAILED** (0.00), security, off the question; lacks references, lines, code, confidence"
    some = chunks.map_chunks(chunks.fixed_chunks(f, 100, 0), "import password", threshold=0.5)
    assert report.results_markdown(some).startswith("### ") and report.table_markdown(some, 1).endswith("... more than 1 rows")


def test_sqlite_and_json(spark, tmp_path):
    from lodestone.sources import store

    rows = [(f"k{k}", f"v{k}", k) for k in range(25)] + [(None, "", 99)]
    path = str(tmp_path / "m.db")
    df = spark.createDataFrame(rows, "key string, value string, size int")
    assert store.write_sqlite(df, path, "memo ries") == 26 and store.write_sqlite(df.where("false"), path, "none") == 0
    got = store.read_sqlite(spark, path, "memo ries", "key string, value string, size int", 4)
    assert sorted(map(str, got.collect())) == sorted(map(str, df.collect()))
    assert store.read_sqlite(spark, path, "none", "key string").count() == 0
    f = files_from_rows(spark, [("a.py", "x\ny"), ("b.py", "")])
    corpus.write_files(f.select("path", "content"), str(tmp_path / "j"), "json")
    assert sorted((r.path, r.content, r.extension) for r in store.read_json_files(spark, str(tmp_path / "j")).collect()) == [("a.py", "x\ny", ".py"), ("b.py", "", ".py")]
