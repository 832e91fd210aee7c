from pyspark.sql import functions as F

from lodestone.functions.register import register
from lodestone.operators import chunks, project
from lodestone.plans import sample
from lodestone.sources.corpus import files_from_rows


def test_facts(spark):
    f = files_from_rows(spark, [("README.md", "# P\n## Fast\n- Small\nsee lib/x.py"), ("main.py", "import flask"), ("lib/x.py", ""), ("a.js", ""), ("package.json", '{"dependencies": {"vue": "3"}}'), ("bad/package.json", "{")])
    r = project.project_facts(f).first()
    assert (r.project_type, list(r.features), list(r.entry_points), list(r.tech_stack)) == ("python", ["Fast", "Small"], ["main.py"], ["vue", "flask"])
    assert [(x.name, x.version) for x in project.package_dependencies(f).collect()] == [("vue", "3")]
    assert [(x.path, x.band) for x in project.priority_files(f, 4).collect()] == [("README.md", 0), ("package.json", 0), ("bad/package.json", 0), ("main.py", 1)]
    assert project.priority_files(f).where("band = 2").first().path == "lib/x.py"


def test_offline(spark):
    f = sample.files(spark)
    got = project.offline_analysis(f, "any sql problems?")
    assert {r.tool for r in got.collect()} == {"sql_injection"}
    rows = project.offline_analysis(f, "hello").collect()
    assert rows[0].severity == "CRITICAL" and {r.tool for r in rows} <= {"hardcoded_secrets", "sql_injection", "command_injection", "path_traversal"}
    assert {r.category: r.n for r in project.quick_scan(f).collect()}["todo"] == 3


def test_ingest_and_tree(spark, tmp_path):
    f = files_from_rows(spark, [("a", "\n\n".join(("needle " if k == 7 else "straw ") * 30 for k in range(9))), ("b", "needle")])
    project.ingest(f, str(tmp_path), 250)
    nodes, cut = spark.read.parquet(f"{tmp_path}/nodes"), spark.read.parquet(f"{tmp_path}/chunks")
    assert cut.where("path = 'a'").count() == 9
    assert [(r.path, r.chunk_id) for r in project.query_tree(nodes, cut, "needle").collect()] == [("a", 7), ("b", 0)]


def test_answers(spark):
    text = "Intro\n1. **High**: src/a.py:3 - Bad thing\n   It breaks.\n```\nx.py:9\n```\n- b.py:70000 low risk\n"
    a = spark.createDataFrame([(1, text), (2, "nothing")], "id int, text string")
    got = project.answer_findings(a).orderBy("line").collect()
    assert [(r.id, r.file, r.line, r.severity) for r in got] == [(1, "src/a.py", 3, "HIGH"), (1, "b.py", 70000, "LOW")] and "breaks" in got[0].description
    assert [list(r.doubt) for r in project.doubtful_lines(a).orderBy("id").collect()] == [["line number"], []]


def test_requests(spark):
    df = spark.createDataFrame([("q", ["a"]), (" ", ["../x"]), (None, None), ("q", ["a/..b"])], "query string, paths array<string>")
    assert [list(r.errors) for r in project.request_errors(df).collect()] == [[], ["empty query", "path climbs"], ["empty query", "no path"], []]


def test_registered_functions(spark):
    names = register(spark)
    assert len(names) == 5
    r = spark.sql("SELECT lode_in_string('a \"b', 3) AS x, lode_tokens('12345678') AS t, lode_comment('  // x') AS c").first()
    assert (r.x, r.t, r.c) == (True, 2, True)
    assert [tuple(r) for r in spark.sql("SELECT * FROM lode_chunks('abcdef', 4, 1)").collect()] == [(0, 0, "abcd"), (1, 3, "def")]
    assert spark.sql("SELECT path FROM lode_corpus('### File: a.py\n```py\nx\n```')").first().path == "a.py"
    assert chunks.SIZE > 0 and F is not None
