"""Named queries over the driver tables, each with its SQL twin.

documents are files (source/doc_id.lang), pages are web files, events are
calls and requests, embeddings are cached vectors, benchmark holds literal
terms.  Code scanners also read the sample corpus.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions import text as T
from ..operators import answers, chunks, report, rules, scanners, search, state, structure, verify
from ..operators.rulesets import BATCHES
from ..sources import corpus
from . import sample

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return corpus.spread(df) if name in ("documents", "embeddings", "pages") else df


def doc_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.documents_as_files(table(spark, sf_dir, "documents"))


DOC_FILES = "files AS (SELECT doc_id AS file_seq, concat(source, '/', doc_id, '.', lang) AS path, text AS content FROM documents)"
DOC_LINES = DOC_FILES + ", lines AS (SELECT file_seq, path, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1)::INT AS line_no FROM files)"
STRIP = r"regexp_replace(line, '^\s+|\s+$', '', 'g')"


@query(rf"WITH {DOC_LINES} SELECT count(*) AS n_lines, count(DISTINCT path) AS n_files, max(line_no) AS longest_file, count(*) FILTER (WHERE line = '') AS n_empty, sum(length(line))::BIGINT AS n_chars FROM lines")
def corpus_lines_stats(spark, sf_dir):
    ls = corpus.lines(doc_files(spark, sf_dir))
    return ls.agg(F.count("*").alias("n_lines"), F.count_distinct("path").alias("n_files"), F.max("line_no").alias("longest_file"), F.count_if(F.col("line") == "").alias("n_empty"), F.sum(F.length("line")).alias("n_chars"))


@query(rf"WITH {DOC_LINES} SELECT split_part(path, '/', 1) AS source, CASE WHEN regexp_matches(lower(path), 'test|spec|mock|fixture') THEN 'MEDIUM' ELSE 'HIGH' END AS confidence, count(*) AS n FROM lines WHERE regexp_matches(line, 'license|copyright', 'i') GROUP BY ALL")
def scan_license_lines(spark, sf_dir):
    hit = search.search(doc_files(spark, sf_dir), "license|copyright")
    confidence = P.confidence_of(P.confidence_score(test=P.is_test_path(F.col("path")), pattern_only=F.lit(True)))
    return hit.groupBy(F.substring_index("path", "/", 1).alias("source"), confidence.alias("confidence")).agg(F.count("*").alias("n"))


@query(rf"WITH {DOC_LINES} SELECT path, count(*) AS n_matches FROM lines WHERE regexp_matches(line, '\d{{4,}}|@', 'i') GROUP BY path")
def grep_count_per_doc(spark, sf_dir):
    return search.grep(doc_files(spark, sf_dir), r"\d{4,}|@", "count")


@query(rf"WITH {DOC_LINES} SELECT DISTINCT path FROM lines WHERE contains(lower(line), 'token =')")
def grep_files_with_matches(spark, sf_dir):
    return search.grep(doc_files(spark, sf_dir), "token =", "files_with_matches")


@query(rf"WITH {DOC_LINES} SELECT file_seq, path, line_no, {STRIP} AS line, regexp_extract(line, '[A-Z]{{3,}}!!', 0) AS match FROM lines WHERE regexp_matches(line, '[A-Z]{{3,}}!!') AND NOT regexp_matches(line, 'THE') ORDER BY file_seq, path, line_no LIMIT 1000")
def grep_content_first(spark, sf_dir):
    return search.grep(doc_files(spark, sf_dir), "[A-Z]{3,}!!", "content", ignore_case=False, exclude="THE")


@query(rf"""WITH {DOC_LINES}, t AS (SELECT DISTINCT split_part(text, ' ', 1) AS term FROM benchmark)
SELECT term, file_seq, path, line_no, line FROM lines JOIN t ON contains(lower(line), lower(term)) WHERE length(term) > 6""")
def literal_terms_benchmark(spark, sf_dir):
    terms = table(spark, sf_dir, "benchmark").select(F.substring_index("text", " ", 1).alias("term")).where(F.length("term") > 6)
    return search.literal_search(doc_files(spark, sf_dir), terms)


_SEARCHES = [("license", "license"), (r"\d{3}-\d{4}", "phone"), ("token|license", "token")]


@query(rf"""WITH {DOC_LINES}, hits AS (SELECT 1 AS search_no, 'license' AS description, * FROM lines WHERE regexp_matches(line, 'license', 'i') UNION ALL SELECT 2, 'phone', * FROM lines WHERE regexp_matches(line, '\d{{3}}-\d{{4}}', 'i') UNION ALL SELECT 3, 'token', * FROM lines WHERE regexp_matches(line, 'token|license', 'i')),
capped AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY search_no ORDER BY file_seq, path, line_no) AS n FROM hits) WHERE n <= 50)
SELECT search_no, description, file_seq, path AS file, line_no AS line, {STRIP} AS code FROM (SELECT *, row_number() OVER (PARTITION BY file_seq, path, line_no ORDER BY search_no) AS k FROM capped) WHERE k = 1""")
def multi_search_dedupe(spark, sf_dir):
    return search.multi_search(doc_files(spark, sf_dir), _SEARCHES)


@query(rf"""WITH {DOC_LINES}, w AS (SELECT file_seq, path, line_no, line, coalesce(list(line) OVER (PARTITION BY file_seq, path ORDER BY line_no ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), []) AS context_before, coalesce(list(line) OVER (PARTITION BY file_seq, path ORDER BY line_no ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING), []) AS context_after FROM lines)
SELECT * FROM w WHERE regexp_matches(line, 'license|copyright', 'i')""")
def context_window(spark, sf_dir):
    return search.with_context(doc_files(spark, sf_dir), "license|copyright")


@query(rf"""WITH {DOC_LINES}, m AS (SELECT *, contains(lower(line), 'license') OR contains(lower(line), '@mail') AS hit FROM lines),
n AS (SELECT *, bool_or(hit) OVER (PARTITION BY file_seq, path ORDER BY line_no ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING) AS near, bool_or(hit) OVER (PARTITION BY file_seq, path) AS present FROM m),
k AS (SELECT * FROM n WHERE near OR (NOT present AND line_no <= 50))
SELECT file_seq, path, line_no, line, coalesce(line_no - lag(line_no) OVER (PARTITION BY file_seq, path ORDER BY line_no) > 1, false) AS gap FROM k""")
def smart_chunk_filter(spark, sf_dir):
    return search.smart_filter(doc_files(spark, sf_dir), ["license", "@mail"])


@query(rf"""WITH {DOC_FILES}, s AS (SELECT file_seq, path, ((length(lower(content)) - length(replace(lower(content), 'the', ''))) // 3 + (length(lower(content)) - length(replace(lower(content), 'tion', ''))) // 4)::INT AS score, substr(content, 1, 200) AS excerpt FROM files)
SELECT * FROM s WHERE score > 0 ORDER BY score DESC, file_seq LIMIT 10""")
def keyword_topk_docs(spark, sf_dir):
    return search.semantic_search(doc_files(spark, sf_dir), ["the", "tion"], cut=200)


@query(rf"WITH {DOC_FILES} SELECT concat('.', regexp_extract(path, '\.([^./]+)$', 1)) AS extension, count(*) AS n_files, sum(strlen(content))::BIGINT AS total_bytes FROM files WHERE contains(lower(path), 'src1') GROUP BY 1")
def list_files_by_ext(spark, sf_dir):
    return search.list_files(doc_files(spark, sf_dir), "src1")


@query(rf"WITH {DOC_FILES} SELECT file_seq, path, concat('.', regexp_extract(path, '\.([^./]+)$', 1)) AS extension, length(content) AS n_chars, len(string_split(content, chr(10)))::INT AS n_lines, string_split(content, chr(10))[1] AS first_line FROM files")
def file_info(spark, sf_dir):
    return search.file_info(doc_files(spark, sf_dir))


@query(rf"WITH {DOC_FILES} SELECT line_no, line FROM (SELECT unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1)::INT AS line_no FROM files WHERE file_seq = 7) WHERE line_no > 1 AND line_no <= 6")
def read_file_window(spark, sf_dir):
    f = doc_files(spark, sf_dir).where("file_seq = 7")
    return corpus.lines(f).where("line_no > 1 and line_no <= 6").select("line_no", "line")


@query(rf"WITH {DOC_FILES}, h AS (SELECT file_seq, path FROM files WHERE regexp_matches(path, '^src1[^/]*/[^/]*\.de$')) SELECT file_seq, path, (SELECT count(*) FROM h) AS total FROM h ORDER BY file_seq LIMIT 20")
def glob_with_total(spark, sf_dir):
    return search.glob_files(doc_files(spark, sf_dir), "src1*/*.de", 20)


@query(rf"WITH {DOC_FILES} SELECT file_seq, path, min(length(content) // 4)::INT AS token_count FROM files WHERE length(content) // 4 <= 2000 GROUP BY ALL ORDER BY file_seq LIMIT 30")
def small_files_first(spark, sf_dir):
    return doc_files(spark, sf_dir).where("token_count <= 2000").orderBy("file_seq").limit(30).select("file_seq", "path", "token_count")


@query(rf"""WITH RECURSIVE {DOC_FILES}, f AS (SELECT file_seq, path, (length(content) // 4)::INT AS token_count, row_number() OVER (ORDER BY file_seq) AS n FROM files),
w AS (SELECT 0::BIGINT AS n, 0::BIGINT AS total, false AS kept UNION ALL SELECT f.n, CASE WHEN w.total + f.token_count <= 50000 THEN w.total + f.token_count ELSE w.total END, w.total + f.token_count <= 50000 FROM w JOIN f ON f.n = w.n + 1)
SELECT file_seq, path, token_count FROM f JOIN w USING (n) WHERE kept""")
def token_budget_first_fit(spark, sf_dir):
    return corpus.within_budget(doc_files(spark, sf_dir), 50_000).select("file_seq", "path", "token_count")


# chunking


@query(rf"""WITH {DOC_FILES}, s AS (SELECT file_seq, path, content, unnest(range(0, length(content), 1800)) AS start FROM files)
SELECT file_seq, path, (start // 1800)::INT AS chunk_id, start::INT AS start, substr(content, start + 1, 2000) AS content FROM s""")
def fixed_chunks_overlap(spark, sf_dir):
    return chunks.fixed_chunks(doc_files(spark, sf_dir), 2000, 200)


@query(rf"""WITH {DOC_FILES}, s AS (SELECT file_seq, path, content, unnest(range(0, length(content), 3600)) AS start FROM files)
SELECT file_seq, path, count(*) AS n_chunks, sum(length(substr(content, start + 1, 4000)) // 4)::BIGINT AS tokens FROM s GROUP BY ALL""")
def chunk_token_estimate(spark, sf_dir):
    return chunks.token_chunks(doc_files(spark, sf_dir), 1000, 100).groupBy("file_seq", "path").agg(F.count("*").alias("n_chunks"), F.sum(F.floor(F.length("content") / 4)).alias("tokens"))


@query()
def paragraph_packing(spark, sf_dir):
    return chunks.paragraph_chunks(doc_files(spark, sf_dir), 2000)


@query()
def sentence_packing(spark, sf_dir):
    return chunks.sentence_chunks(doc_files(spark, sf_dir), 2000)


@query()
def section_cascade(spark, sf_dir):
    return chunks.section_chunks(doc_files(spark, sf_dir), 2000)


@query()
def summary_tree_levels(spark, sf_dir):
    return chunks.summary_tree(chunks.fixed_chunks(doc_files(spark, sf_dir), 500, 50))


@query()
def chunk_map_reduce(spark, sf_dir):
    found = chunks.map_chunks(chunks.fixed_chunks(doc_files(spark, sf_dir), 4000, 0), "license token mail")
    return chunks.merge_results(found, 20_000)


# scans over the sample corpus and the documents


def scan_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample.files(spark).unionByName(doc_files(spark, sf_dir))


SCAN_SQL = sample.sql() + " UNION ALL SELECT doc_id, concat(source, '/', doc_id, '.', lang), text FROM documents"


def _add_scan(tool: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return scanners.rule_scan(scan_files(spark, sf_dir), tool)

    QUERIES[f"scan_{tool}"] = run
    ORACLES[f"scan_{tool}"] = rules.sql_scan(rules.TOOLS[tool], SCAN_SQL)


for _tool in rules.TOOLS:
    if _tool != "xss_vulnerabilities":
        _add_scan(_tool)


def _add_procedural(tool: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return scanners.SCANS[tool](scan_files(spark, sf_dir))

    QUERIES[f"scan_{tool}"] = run


ORACLES["scan_missing_jailbreak_detection"] = f"SELECT 'missing_jailbreak_detection' AS tool, 1 AS rule_seq, NULL::BIGINT AS file_seq, '(project-wide)' AS file, 0 AS line, 'No jailbreak detection' AS code, 'Finance app without jailbreak detection' AS issue, 'MEDIUM' AS confidence, 'MEDIUM' AS severity, 'Look for common traces' AS fix, 'jailbreak' AS category FROM (SELECT bool_or(ends_with(path, '.swift') AND regexp_matches(content, '/Library/MobileSubstrate|/bin/bash|/usr/sbin/sshd|cydia|jailbr(?:eak|oken)', 'i')) AS looks, bool_or(regexp_matches(content, 'banking|finance|money|payment|transaction|wallet', 'i')) AS money FROM ({SCAN_SQL})) WHERE money AND NOT looks"
for _tool in ("force_unwraps", "weak_self_issues", "cloudkit_issues", "task_cancellation_issues", "mainactor_issues", "callback_hell", "code_smells", "missing_jailbreak_detection"):
    _add_procedural(_tool)


def _xss_sql() -> str:
    safe = f"regexp_matches(line, {rules.sql_text(rules.SANITIZER)}, 'i')"
    quiet = rules.sql_text(r"""\.innerHTML\s*=\s*(?:["'][^"']*["']|["']<|["']$|``)""")
    body = rules.sql_scan(rules.TOOLS["xss_vulnerabilities"], SCAN_SQL)
    body = body.replace("lines AS (", "all_lines AS (", 1)
    head, tail = body.split(" FROM files) SELECT", 1)
    marked = f" FROM files), marked AS (SELECT *, bool_or({safe}) OVER (PARTITION BY file_seq, path ORDER BY line_no ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS safe FROM all_lines), lines AS (SELECT * FROM marked WHERE NOT safe), found AS (SELECT"
    low = f"regexp_matches(code, {quiet}) OR regexp_matches(lower(file), '{P.TEST_PATH}')"
    return head + marked + tail + f") SELECT * REPLACE (CASE WHEN {low} THEN 'LOW' ELSE 'HIGH' END AS confidence, CASE WHEN {low} THEN concat(issue, ' (verify, may be sanitised)') ELSE issue END AS issue) FROM found"


@query(_xss_sql())
def scan_xss_vulnerabilities(spark, sf_dir):
    return scanners.xss_vulnerabilities(scan_files(spark, sf_dir))


_PLAIN_SECURITY = [t for t in BATCHES["security"] if t != "xss_vulnerabilities"]
_SECURITY_SQL = rules.sql_scan([r for t in _PLAIN_SECURITY for r in rules.TOOLS[t]], SCAN_SQL)


@query(f"SELECT severity, confidence, count(*) AS n FROM ({_SECURITY_SQL}) GROUP BY ALL")
def confidence_histogram(spark, sf_dir):
    return report.histogram(scanners.scan(scan_files(spark, sf_dir), _PLAIN_SECURITY))


@query(f"SELECT * FROM ({_SECURITY_SQL}) WHERE confidence IN ('HIGH', 'MEDIUM')")
def security_batch_filtered(spark, sf_dir):
    return scanners.filter_by_confidence(scanners.scan(scan_files(spark, sf_dir), _PLAIN_SECURITY))


@query(f"SELECT severity, confidence, category, count(*) AS n, grouping_id(severity, confidence, category) AS grouping_id FROM ({_SECURITY_SQL}) GROUP BY CUBE (severity, confidence, category)")
def severity_cube(spark, sf_dir):
    return report.severity_cube(scanners.scan(scan_files(spark, sf_dir), _PLAIN_SECURITY))


@query(f"SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY file, line ORDER BY tool, rule_seq) AS k FROM ({_SECURITY_SQL})) WHERE k = 1")
def findings_dedupe(spark, sf_dir):
    return report.dedupe(scanners.scan(scan_files(spark, sf_dir), _PLAIN_SECURITY))


@query(f"SELECT count(*) AS total, {', '.join(f'count(*) FILTER (WHERE severity = {s!r}) AS {s.lower()}' for s in ('CRITICAL', 'HIGH', 'MEDIUM', 'LOW', 'INFO'))}, count(*) FILTER (WHERE confidence = 'HIGH') AS high_confidence, count(DISTINCT file) AS n_files FROM ({_SECURITY_SQL})")
def scanner_totals(spark, sf_dir):
    return report.scanner_totals(scanners.scan(scan_files(spark, sf_dir), _PLAIN_SECURITY))


#: What the whole-file scans must find in the sample, read off its texts: (tool, rule_seq, file, line, code, issue, confidence, severity, fix, category).
_EXPECTED = [
    ("force_unwraps", 1, "app/Main.swift", 7, "let name = value!", "Value is force-unwrapped (constant)", "MEDIUM", "MEDIUM", "Bind the value or give a default", "force_unwrap"),
    ("force_unwraps", 2, "app/Main.swift", 10, "items = try! decode(data)", "Value is force-unwrapped", "HIGH", "MEDIUM", "Bind the value or give a default", "force_unwrap"),
    ("force_unwraps", 3, "app/Main.swift", 11, "let x = y as! Item", "Value is force-unwrapped (constant)", "MEDIUM", "MEDIUM", "Bind the value or give a default", "force_unwrap"),
    ("force_unwraps", 4, "app/Main.swift", 39, "print(other!)", "Value is force-unwrapped (appears guarded)", "HIGH", "MEDIUM", "Bind the value or give a default", "force_unwrap"),
    ("force_unwraps", 5, "app/Main.swift", 10, "items = try! decode(data)", "Forced try", "HIGH", "HIGH", "Bind the value or give a default", "force_unwrap"),
    ("force_unwraps", 6, "app/Main.swift", 11, "let x = y as! Item", "Forced cast (constant)", "MEDIUM", "MEDIUM", "Bind the value or give a default", "force_unwrap"),
    ("weak_self_issues", 1, "app/Main.swift", 16, "timer = Timer.scheduledTimer(withTimeInterval: 1, repeats: true) { _ in", "Timer closure holds self strongly", "HIGH", "HIGH", "Capture self weakly", "weak_self"),
    ("cloudkit_issues", 1, "app/Main.swift", 22, "database.save(record)", "Cloud operation without error handling", "LOW", "MEDIUM", "Check the handling of errors", "cloudkit"),
    ("task_cancellation_issues", 1, "app/Main.swift", 23, "Task {", "Task never checks for cancellation", "MEDIUM", "MEDIUM", "Check for cancellation in the loop", "task_cancellation"),
    ("mainactor_issues", 1, "app/Main.swift", 3, "class MainViewModel: ObservableObject {", "Observable object off the main actor", "MEDIUM", "MEDIUM", "Mark the class with the main actor", "mainactor"),
    ("mainactor_issues", 2, "app/Main.swift", 10, "items = try! decode(data)", "Published value items changed off the main actor", "HIGH", "HIGH", "Change it on the main actor", "mainactor"),
    ("callback_hell", 1, "web/view.js", 17, "a(function(e) { b(function(e) { c(function(e) { d(function(e) {", "Callbacks nested 4 deep", "HIGH", "HIGH", "Flatten with async and await", "callback_hell"),
]


def _expected_sql(tool: str) -> str:
    seq = {path: k for k, (path, _) in enumerate(sample.FILES)}
    t = rules.sql_text
    rows = [f"({t(r[0])}, {r[1]}, {seq[r[2]]}::BIGINT, {t(r[2])}, {r[3]}, {', '.join(map(t, r[4:]))})" for r in _EXPECTED if r[0] == tool]
    return f"SELECT * FROM (VALUES {', '.join(rows)}) AS v(tool, rule_seq, file_seq, file, line, code, issue, confidence, severity, fix, category)"


for _tool in dict.fromkeys(r[0] for r in _EXPECTED):
    ORACLES[f"scan_{_tool}"] = _expected_sql(_tool)


def _tool_sql(tool: str) -> str:
    if tool == "xss_vulnerabilities":
        return _xss_sql()
    if tool == "long_functions":
        return f"WITH e AS ({_FUNCTIONS_SQL}) SELECT 'long_functions' AS tool, 1 AS rule_seq, file_seq, path AS file, start_line AS line, concat(name, '(): ', length, ' lines') AS code, concat('Function of ', length, ' lines, more than 30') AS issue, 'HIGH' AS confidence, CASE WHEN length > 100 THEN 'HIGH' WHEN length > 60 THEN 'MEDIUM' ELSE 'LOW' END AS severity, 'Split the function' AS fix, 'long_functions' AS category FROM e WHERE length > 30"
    return rules.sql_scan(rules.TOOLS[tool], SCAN_SQL) if tool in rules.TOOLS else _expected_sql(tool)


def _add_batch(batch: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return scanners.run_batch(scan_files(spark, sf_dir), batch)

    QUERIES[f"batch_{batch}"] = run
    tools = BATCHES[batch]
    if batch != "quality_all":  # its smells and unreachable lines need look-around
        keep = "" if batch == "persistence" else " WHERE confidence IN ('HIGH', 'MEDIUM')"
        found = " UNION ALL ".join(f"SELECT * FROM ({_tool_sql(t)})" for t in tools)
        ORACLES[f"batch_{batch}"] = f"SELECT * FROM ({found}){keep}"


_SAMPLE_LINES = f"files AS ({sample.sql()}), lines AS (SELECT file_seq, path, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1)::INT AS line_no, len(string_split(content, chr(10)))::INT AS n_lines FROM files)"


def _name_sql(starts: dict[str, str]) -> str:
    return "CASE " + " ".join(f"WHEN ends_with(path, '{s}') THEN regexp_extract(line, {rules.sql_text(p)}, 1)" for s, p in reversed(starts.items())) + " ELSE '' END"


_FUNCTIONS_SQL = rf"""WITH {_SAMPLE_LINES}, heads AS (SELECT file_seq, path, n_lines, {_name_sql(structure.STARTS)} AS name, line_no AS start_line FROM lines),
e AS (SELECT file_seq, path, name, start_line, coalesce(lead(start_line) OVER (PARTITION BY file_seq, path ORDER BY start_line) - 1, n_lines) AS end_line FROM heads WHERE name <> '')
SELECT *, end_line - start_line + 1 AS length FROM e"""


for _batch in BATCHES:
    _add_batch(_batch)


@query(_FUNCTIONS_SQL)
def function_length(spark, sf_dir):
    return structure.functions(sample.files(spark))


_BRANCH_SQL = " + ".join(f"len(regexp_extract_all(line, {rules.sql_text(p.replace('(?iu)', '(?i)'))}))" for p in structure.BRANCHES)


_COMPLEXITY_SQL = rf"""WITH {_SAMPLE_LINES}, named AS (SELECT *, {_name_sql(structure._COMPLEX_STARTS)} AS name FROM lines WHERE regexp_matches(path, '\.(?:py|swift|js|ts)$')),
f AS (SELECT *, sum((name <> '')::INT) OVER (PARTITION BY file_seq, path ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS func FROM named)
SELECT file_seq, path, max(CASE WHEN name <> '' THEN name END) AS name, min(line_no) AS start_line, sum({_BRANCH_SQL})::BIGINT + 1 AS complexity FROM f WHERE func > 0 GROUP BY file_seq, path, func"""


@query(_COMPLEXITY_SQL)
def complexity(spark, sf_dir):
    return structure.complexity(sample.files(spark))


@query(rf"""WITH e AS ({_FUNCTIONS_SQL}) SELECT 'long_functions' AS tool, 1 AS rule_seq, file_seq, path AS file, start_line AS line, concat(name, '(): ', length, ' lines') AS code, concat('Function of ', length, ' lines, more than 10') AS issue, 'HIGH' AS confidence, CASE WHEN length > 100 THEN 'HIGH' WHEN length > 60 THEN 'MEDIUM' ELSE 'LOW' END AS severity, 'Split the function' AS fix, 'long_functions' AS category FROM e WHERE length > 10""")
def scan_long_functions(spark, sf_dir):
    return structure.long_functions(sample.files(spark), 10)


@query(rf"""WITH e AS ({_COMPLEXITY_SQL}) SELECT 'complex_functions' AS tool, 1 AS rule_seq, file_seq, path AS file, start_line AS line, concat(name, '(): complexity ', complexity) AS code, concat('Complexity ', complexity, ', more than 5') AS issue, 'MEDIUM' AS confidence, CASE WHEN complexity < 20 THEN 'MEDIUM' ELSE 'HIGH' END AS severity, 'Split the decisions' AS fix, 'complex_functions' AS category FROM e WHERE complexity > 5""")
def scan_complex_functions(spark, sf_dir):
    return structure.complex_functions(sample.files(spark), 5)


@query(rf"""WITH {_SAMPLE_LINES}, named AS (SELECT *, nullif({_name_sql(structure.STARTS)}, '') AS name FROM lines WHERE regexp_matches(path, '\.(?:py|swift|js|ts|rs|go)$')),
c AS (SELECT *, last_value(name IGNORE NULLS) OVER (PARTITION BY file_seq, path ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS caller FROM named),
x AS (SELECT path, caller, line_no, name, unnest(list_distinct(regexp_extract_all(line, '\b([A-Za-z_]\w*)\s*\(', 1))) AS callee FROM c WHERE caller IS NOT NULL),
e AS (SELECT path, caller, callee, min(line_no) AS line_no FROM x WHERE callee NOT IN ({", ".join(repr(w) for w in structure._NOT_FUNCTIONS)}) AND (name IS NULL OR name <> callee) GROUP BY ALL)
SELECT path, caller, callee, line_no, callee IN (SELECT name FROM named WHERE name IS NOT NULL) AS internal FROM e""")
def call_edges(spark, sf_dir):
    return structure.call_edges(sample.files(spark))


@query()
def call_graph_reach(spark, sf_dir):
    return structure.reachable(structure.call_edges(sample.files(spark)), "load")


@query(" UNION ALL ".join(f"SELECT path, {k!r} AS kind, trim(unnest(regexp_extract_all(content, {rules.sql_text(p)}, 1))) AS imported, unnest(regexp_extract_all(content, {rules.sql_text(p)}, 2)) AS module FROM ({sample.sql()}) WHERE regexp_matches(path, '\\.(?:cjs|js|jsx|mjs|ts|tsx)$')" for k, p in structure.IMPORTS.items()))
def import_edges(spark, sf_dir):
    return structure.import_edges(sample.files(spark))


@query(" UNION ALL ".join(f"SELECT path, {k!r} AS kind, trim(unnest(regexp_extract_all(content, {rules.sql_text(p)}, 1))) AS exported FROM ({sample.sql()}) WHERE regexp_matches(path, '\\.(?:cjs|js|jsx|mjs|ts|tsx)$')" for k, p in structure.EXPORTS.items()))
def module_exports(spark, sf_dir):
    return structure.exports(sample.files(spark))


@query()
def import_frequency(spark, sf_dir):
    return structure.import_frequency(sample.files(spark))


@query(rf"""WITH {_SAMPLE_LINES}, r AS (SELECT * FROM (VALUES (1, 'import statement', 'import\s+react'), (2, 'from import', 'from\s+react'), (3, 'require call', 'require\(["'']react["'']')) AS v(rule_seq, issue, p))
SELECT 'imports' AS tool, rule_seq, file_seq, path AS file, line_no AS line, substr({STRIP}, 1, 200) AS code, issue, 'HIGH' AS confidence, 'INFO' AS severity, '' AS fix, 'imports' AS category FROM lines JOIN r ON regexp_matches(line, p, 'i')""")
def find_imports_react(spark, sf_dir):
    return scanners.find_imports(sample.files(spark), "react")


@query(rf"""WITH f AS ({sample.sql()}), c AS (SELECT CASE WHEN regexp_matches(lower(path), '(?:^|/)(?:__main__|app|index|main|server)\.\w+$|appdelegate') THEN 'entry' WHEN regexp_matches(lower(path), 'component|page|screen|view') THEN 'views' WHEN regexp_matches(lower(path), 'entit|model|schema') THEN 'models' WHEN regexp_matches(lower(path), 'api|client|manager|service') THEN 'services' WHEN regexp_matches(lower(path), 'helper|util|extension') THEN 'utilities' WHEN regexp_matches(lower(path), 'spec|test') THEN 'tests' WHEN regexp_matches(lower(path), 'config|setting|\.(?:ini|json|toml|yaml|yml)$') THEN 'config' ELSE 'other' END AS category, len(string_split(content, chr(10))) AS l, len(regexp_extract_all(content, '(?m)^\s*(?:async\s+)?(?:pub\s+)?(?:def|fn|func|function)\s+\w+')) AS f, len(regexp_extract_all(content, '(?m)^\s*(?:export\s+)?(?:class|enum|interface|protocol|struct|trait)\s+\w+')) AS c FROM f)
SELECT category, count(*) AS n_files, sum(l)::BIGINT AS n_lines, sum(f)::BIGINT AS n_functions, sum(c)::BIGINT AS n_classes FROM c GROUP BY category""")
def architecture_map(spark, sf_dir):
    return structure.architecture(sample.files(spark))


@query(rf"WITH f AS ({sample.sql()}), s AS (SELECT file_seq, path, regexp_extract_all(content, '(?m)^\s*((?:export\s+|pub\s+|public\s+|private\s+|async\s+)*(?:class|def|enum|fn|func|function|interface|protocol|struct|trait)\s+\w+[^\n{{:]*)', 1)[1:20] AS signatures FROM f) SELECT * FROM s WHERE len(signatures) > 0")
def file_signatures(spark, sf_dir):
    return structure.signatures(sample.files(spark))


@query(rf"""WITH f AS ({rules.sql_scan(rules.TOOLS['websocket_flow'], sample.sql())}) SELECT 'websocket_flow' AS tool, 0 AS rule_seq, -1::BIGINT AS file_seq, '(summary)' AS file, 0 AS line, concat(count(*), ' places in ', count(DISTINCT file), ' files') AS code, 'Websocket use' AS issue, 'HIGH' AS confidence, 'INFO' AS severity, '' AS fix, 'websocket' AS category FROM f HAVING count(*) > 0 UNION ALL SELECT * FROM f""")
def websocket_summary(spark, sf_dir):
    return structure.websocket_flow(sample.files(spark))


@query()
def dead_code_next_line(spark, sf_dir):
    return scanners.dead_code_with_next_line(sample.files(spark))


@query("WITH r AS (SELECT * FROM (VALUES ('app/Main.swift', 31, 33), ('web/view.js', 1, 5), ('web/view.js', 3, 9)) AS v(path, start_line, end_line)), q AS (SELECT * FROM (VALUES ('app/Main.swift', 32), ('app/Main.swift', 40), ('web/view.js', 4), ('web/view.js', 9)) AS v(path, line)) SELECT path, line, start_line, end_line FROM (SELECT q.path, q.line, r.start_line, r.end_line, row_number() OVER (PARTITION BY q.path, q.line ORDER BY r.start_line, r.end_line) AS k FROM q JOIN r ON q.path = r.path AND q.line BETWEEN r.start_line AND r.end_line) WHERE k = 1")
def dead_region_range_join(spark, sf_dir):
    regions = spark.createDataFrame([("app/Main.swift", 31, 33), ("web/view.js", 1, 5), ("web/view.js", 3, 9)], "path string, start_line int, end_line int")
    refs = spark.createDataFrame([("app/Main.swift", 32), ("app/Main.swift", 40), ("web/view.js", 4), ("web/view.js", 9)], "path string, line int")
    return structure.lines_in_regions(refs, regions)


@query(rf"""WITH {_SAMPLE_LINES}, m AS (SELECT file_seq, path, line_no, regexp_matches(line, '^\s*#if\b') AS opens, regexp_matches(line, '^\s*#if\s+(?:false|0)\b') AS dead FROM lines WHERE regexp_matches(line, '^\s*#(?:if|endif)\b')),
d AS (SELECT *, sum(CASE WHEN opens THEN 1 ELSE -1 END) OVER (PARTITION BY file_seq, path ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS depth FROM m),
p AS (SELECT *, lead(line_no) OVER (PARTITION BY file_seq, path, CASE WHEN opens THEN depth ELSE depth + 1 END ORDER BY line_no) AS nxt FROM d)
SELECT file_seq, path, line_no AS start_line, coalesce(nxt, line_no) AS end_line FROM p WHERE opens AND dead""")
def dead_code_regions(spark, sf_dir):
    return structure.dead_regions(sample.files(spark))


# verification


@query(rf"""WITH {DOC_LINES}, refs AS (SELECT path AS file, (CASE WHEN file_seq % 3 = 0 THEN 1 WHEN file_seq % 3 = 1 THEN 10000 ELSE 2 END)::INT AS line FROM files),
n AS (SELECT path, count(*)::INT AS n_lines FROM lines GROUP BY path)
SELECT r.file, r.line, n.path AS resolved, 0 AS match_rank, n.n_lines, l.line AS text, r.line BETWEEN 1 AND n.n_lines AS in_range, l.line IS NOT NULL AS matches FROM refs r JOIN n ON n.path = r.file LEFT JOIN lines l ON l.path = r.file AND l.line_no = r.line""")
def verify_lines(spark, sf_dir):
    f = doc_files(spark, sf_dir)
    refs = f.select(F.col("path").alias("file"), F.when(F.col("file_seq") % 3 == 0, 1).when(F.col("file_seq") % 3 == 1, 10000).otherwise(2).alias("line"))
    return verify.verify_lines(refs, f)


@query()
def verify_answer(spark, sf_dir):
    answers = spark.createDataFrame([("See src/app.py:10, `web/view.js:99`, Main.swift:3 and lost.py:1.",)], "text string")
    return verify.verification_stats(verify.verify_lines(verify.references(answers).select("file", "line"), sample.files(spark)))


@query(rf"""WITH {_SAMPLE_LINES}, n AS (SELECT DISTINCT path, n_lines FROM lines), f AS (SELECT * FROM (VALUES ('src/app.py', 5, 'x', 'HIGH'), ('src/app.py', 999, 'y', 'HIGH'), ('gone.py', 7, 'z', 'HIGH')) AS v(file, line, code, confidence))
SELECT file, CASE WHEN line > n_lines THEN n_lines ELSE line END AS line, CASE WHEN line > n_lines THEN concat(code, ' [line adjusted]') ELSE code END AS code, CASE WHEN line > n_lines THEN 'LOW' ELSE confidence END AS confidence FROM f LEFT JOIN n ON n.path = f.file""")
def findings_clamped(spark, sf_dir):
    found = spark.createDataFrame([("src/app.py", 5, "x", "HIGH"), ("src/app.py", 999, "y", "HIGH"), ("gone.py", 7, "z", "HIGH")], "file string, line int, code string, confidence string")
    return verify.clamp_lines(found, sample.files(spark))


@query("SELECT doc_id, CASE WHEN score >= 0.9 THEN 'HIGH' WHEN score >= 0.7 THEN 'MEDIUM' WHEN score >= 0.5 THEN 'LOW' ELSE 'VERY LOW' END AS level, score FROM (SELECT doc_id, round(greatest(0, least(1, 0.4 * fa + 0.4 * la + 0.1 - least(0.02 * (doc_id % 7), 0.1) + 0.1 - least(0.01 * (doc_id % 13), 0.1))), 6) AS score FROM (SELECT doc_id, (doc_id % 11) / 10.0 AS fa, (doc_id % 6) / 5.0 AS la FROM documents))")
def verification_levels(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", ((F.col("doc_id") % 11) / 10.0).alias("fa"), ((F.col("doc_id") % 6) / 5.0).alias("la"))
    score = F.round(verify.verification_score(F.col("fa"), F.col("la"), F.col("doc_id") % 7, F.col("doc_id") % 13), 6)
    return d.withColumn("score", score).select("doc_id", verify.verification_level(F.col("score")).alias("level"), "score")


# caches and fingerprints


@query(rf"WITH {DOC_FILES} SELECT path, sha256(content) AS content_hash, strlen(content) AS size_bytes FROM files")
def fingerprint_sha256(spark, sf_dir):
    return state.fingerprints(doc_files(spark, sf_dir))


def _versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    f = doc_files(spark, sf_dir)
    edited = f.where("file_seq % 7 <> 0").withColumn("content", F.when(F.col("file_seq") % 5 == 0, F.concat("content", F.lit("."))).otherwise(F.col("content")))
    return state.fingerprints(f), state.fingerprints(edited)


_VERSIONS = rf"{DOC_FILES}, now AS (SELECT path, sha256(content) AS content_hash, strlen(content) AS size_bytes FROM files), before AS (SELECT path, sha256(CASE WHEN file_seq % 5 = 0 THEN concat(content, '.') ELSE content END) AS content_hash FROM files WHERE file_seq % 7 <> 0)"


@query(f"WITH {_VERSIONS} SELECT * FROM now WHERE NOT EXISTS (SELECT 1 FROM before b WHERE b.path = now.path AND b.content_hash = now.content_hash)")
def changed_files_anti(spark, sf_dir):
    return state.changed_files(*_versions(spark, sf_dir))


@query(f"WITH {_VERSIONS} SELECT * FROM now WHERE EXISTS (SELECT 1 FROM before b WHERE b.path = now.path AND b.content_hash = now.content_hash)")
def unchanged_files_semi(spark, sf_dir):
    return state.unchanged_files(*_versions(spark, sf_dir))


@query(r"""WITH p AS (SELECT q.vec_id AS query_id, c.vec_id AS key, CASE WHEN n > 0 THEN d / n ELSE 0.0 END AS similarity FROM embeddings q, embeddings c, LATERAL (SELECT list_dot_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) AS d, sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])) * sqrt(list_dot_product(c.embedding::DOUBLE[], c.embedding::DOUBLE[])) AS n) WHERE q.vec_id % 10 = 0 AND c.vec_id % 10 <> 0)
SELECT query_id, key, round(similarity, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, key) AS k FROM p WHERE similarity >= 0.3) WHERE k = 1""")
def cosine_top1(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    found = state.nearest_by_vector(e.where("vec_id % 10 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), e.where("vec_id % 10 <> 0").select(F.col("vec_id").alias("key"), "embedding"), 0.3)
    return found.withColumn("similarity", F.round("similarity", 6))


@query(r"""WITH w AS (SELECT doc_id, list_distinct(list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> '')) AS w FROM documents WHERE n_chars < 1500),
p AS (SELECT q.doc_id AS query_id, c.doc_id AS key, len(list_intersect(q.w, c.w)) / len(list_distinct(list_concat(q.w, c.w))) AS similarity FROM w q, w c WHERE q.doc_id % 4 = 0 AND c.doc_id % 4 <> 0 AND len(q.w) >= 2 AND len(c.w) >= 2)
SELECT query_id, key, round(similarity, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, key) AS k FROM p WHERE similarity >= 0.7) WHERE k = 1""")
def jaccard_top1(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("n_chars < 1500")
    found = state.nearest_by_words(d.where("doc_id % 4 = 0").select(F.col("doc_id").alias("query_id"), "text"), d.where("doc_id % 4 <> 0").select(F.col("doc_id").alias("key"), "text"))
    return found.withColumn("similarity", F.round("similarity", 6))


# memory, from events: a user is a key, its events are stores


def _memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    value = F.concat(F.col("event_type"), F.lit(":"), F.col("event_id").cast("string"))
    return e.select(F.col("user_id").cast("string").alias("key"), value.alias("value"), F.array(F.col("event_type"), F.concat(F.lit("u"), (F.col("user_id") % 5).cast("string"))).alias("tags"), *state.entry(value), F.col("ts").alias("stored_at"))


_LOG = "log AS (SELECT user_id::VARCHAR AS key, concat(event_type, ':', event_id) AS value, [event_type, concat('u', user_id % 5)] AS tags, (length(concat(event_type, ':', event_id)) // 4)::INT AS token_count, strlen(concat(event_type, ':', event_id)) AS size_bytes, ts AS stored_at FROM events)"
_MEM = _LOG + ", mem AS (SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY stored_at DESC, value DESC) AS k FROM log) WHERE k = 1)"


@query(f"WITH {_MEM} SELECT * FROM mem")
def memory_latest_upsert(spark, sf_dir):
    return state.latest(_memory(spark, sf_dir))


@query(f"WITH {_MEM} SELECT * FROM mem WHERE list_has_any(tags, ['error', 'u3'])")
def tag_search(spark, sf_dir):
    return state.by_tags(state.latest(_memory(spark, sf_dir)), ["error", "u3"])


@query(f"WITH {_MEM}, t AS (SELECT key, unnest(list_distinct(tags)) AS tag FROM mem) SELECT tag, count(*) AS n_keys FROM t GROUP BY tag")
def tag_index(spark, sf_dir):
    return state.tag_index(state.latest(_memory(spark, sf_dir)))


@query(f"WITH {_MEM} SELECT key, substr(value, 1, 200) AS value, tags FROM mem WHERE contains(lower(value), 'view:')")
def memory_recall_text(spark, sf_dir):
    return state.recall(state.latest(_memory(spark, sf_dir)), part="VIEW:")


@query(f"WITH {_MEM} SELECT * FROM mem ORDER BY stored_at DESC, key LIMIT 20 OFFSET 5")
def memory_list_page(spark, sf_dir):
    return state.list_entries(state.latest(_memory(spark, sf_dir)), 20, 5)


@query(f"WITH {_MEM} SELECT * EXCLUDE (r, n) FROM (SELECT *, row_number() OVER (ORDER BY stored_at, key) AS r, count(*) OVER () AS n FROM mem) WHERE n < 50 OR r > 10")
def evict_oldest(spark, sf_dir):
    return state.evict_oldest(state.latest(_memory(spark, sf_dir)), 50, 10)


@query(f"WITH {_MEM} SELECT * EXCLUDE (freed) FROM (SELECT *, coalesce(sum(size_bytes) OVER (ORDER BY stored_at, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS freed FROM mem) WHERE freed >= 200")
def evict_by_size(spark, sf_dir):
    return state.evict_by_size(state.latest(_memory(spark, sf_dir)), 200)


@query(f"WITH {_MEM} SELECT count(*) AS n_entries, sum(size_bytes)::BIGINT AS total_bytes, sum(token_count)::BIGINT AS total_tokens, min(stored_at) AS oldest, max(stored_at) AS newest, (SELECT count(DISTINCT x) FROM (SELECT unnest(tags) AS x FROM mem)) AS n_tags FROM mem")
def memory_stats(spark, sf_dir):
    return state.memory_stats(state.latest(_memory(spark, sf_dir)))


@query("SELECT event_id, ts FROM events WHERE epoch_us((SELECT max(ts) FROM events)) - epoch_us(ts) <= 86400000000")
def ttl_valid(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    now = e.agg(F.max("ts").alias("_now"))
    return state.not_expired(e.crossJoin(now), F.col("_now"), 86_400).select("event_id", "ts")


# metrics and limits, from events


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, count(*) AS n, round(avg((user_id % 10 <> 0)::INT), 6) AS success_rate, round(avg(value), 6) AS avg_value, min(value) AS min_value, max(value) AS max_value, max(value) FILTER (WHERE r = floor(n * 0.5)) AS p50, max(value) FILTER (WHERE r = CASE WHEN n < 20 THEN n - 1 ELSE floor(n * 0.95) END) AS p95, max(value) FILTER (WHERE r = CASE WHEN n < 100 THEN n - 1 ELSE floor(n * 0.99) END) AS p99 FROM r GROUP BY event_type""")
def metrics_percentiles(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("ok", F.col("user_id") % 10 != 0)
    return report.metrics(e, "event_type", "value", "ok")


@query("SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k <= 100")
def recent_metrics(spark, sf_dir):
    return report.recent_metrics(table(spark, sf_dir, "events"), "event_type", keep=100)


@query("SELECT event_id, user_id, recent, recent <= 2 AS allowed FROM (SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 59999999 PRECEDING AND CURRENT ROW) AS recent FROM events)")
def rate_limit_60s(spark, sf_dir):
    return state.rate_limit(table(spark, sf_dir, "events"), per_minute=2).select("event_id", "user_id", "recent", "allowed")


@query()
def circuit_breaker(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("failed", F.col("event_type") == "error")
    return state.breaker(e, "user_id", 2, 3600)


@query("SELECT time_bucket(INTERVAL 1 hour, ts) AS start, time_bucket(INTERVAL 1 hour, ts) + INTERVAL 1 hour AS end, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def hourly_windows(spark, sf_dir):
    from ..streaming import flows

    return flows.windowed_counts(table(spark, sf_dir, "events")).withColumn("total", F.round("total", 4))


@query("""WITH e AS (SELECT user_id, ts, coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) >= 1800000000, true) AS new FROM events WHERE event_type = 'error'),
s AS (SELECT *, sum(new::INT) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM e)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 minute AS end, count(*) AS n FROM s GROUP BY user_id, sid""")
def error_sessions(spark, sf_dir):
    from ..streaming import flows

    return flows.error_sessions(table(spark, sf_dir, "events"))


@query("SELECT user_id, max_by(event_type, (ts, event_id)) AS event_type, max(ts) AS ts FROM events GROUP BY user_id")
def latest_progress(spark, sf_dir):
    from ..streaming import flows

    return flows.latest_progress(table(spark, sf_dir, "events"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE json_extract(props, '$.k') IS NOT NULL")
def props_json(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k")).where("k is not null")


# web pages


def _pages(spark: SparkSession, sf_dir: str, content: str = "html") -> DataFrame:
    p = table(spark, sf_dir, "pages").withColumn("html", F.expr(content))
    return corpus.as_files(p, F.concat(F.lit("page/"), F.col("page_id").cast("string"), F.lit(".html")), F.col("html"), F.col("page_id"))


_PAGES_SQL = "SELECT page_id AS file_seq, concat('page/', page_id, '.html') AS path, html AS content FROM pages"


@query(rules.sql_scan(rules.TOOLS["a11y_issues"], _PAGES_SQL))
def html_accessibility(spark, sf_dir):
    return scanners.rule_scan(_pages(spark, sf_dir), "a11y_issues")


#: Pages followed by a line of code, by page: a sink, a timer with text, a message to any origin, or none of these.
_SCRIPTED = "concat(html, chr(10), CASE page_id % 4 WHEN 0 THEN 'box.innerHTML = text' WHEN 1 THEN 'setTimeout(\"go()\", 5)' WHEN 2 THEN 'top.postMessage(x, \"*\")' ELSE 'box.textContent = text' END)"


@query(rules.sql_scan(rules.TOOLS["dom_security"], _PAGES_SQL.replace("html AS content", _SCRIPTED + " AS content")))
def html_dom_security(spark, sf_dir):
    return scanners.rule_scan(_pages(spark, sf_dir, _SCRIPTED), "dom_security")


@query(r"WITH t AS (SELECT page_id, unnest(regexp_extract_all(concat(html, CASE page_id % 3 WHEN 0 THEN '<img src=a.png><IMG ALT=b>' WHEN 1 THEN '<img alt=c>' ELSE '' END), '(?i)<img[^>]*>')) AS tag FROM pages) SELECT page_id, count(*) AS n_images, count(*) FILTER (WHERE NOT regexp_matches(tag, '(?i)\salt\s*=')) AS n_without_alt FROM t GROUP BY page_id")
def html_img_without_alt(spark, sf_dir):
    more = F.expr("concat(html, CASE page_id % 3 WHEN 0 THEN '<img src=a.png><IMG ALT=b>' WHEN 1 THEN '<img alt=c>' ELSE '' END)")
    tags = table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all(more, F.lit(r"(?i)(<img[^>]*>)"), F.lit(1))).alias("tag"))
    return tags.groupBy("page_id").agg(F.count("*").alias("n_images"), F.count_if(~F.col("tag").rlike(r"(?i)\salt\s*=")).alias("n_without_alt"))


@query(r"SELECT page_id, len(regexp_extract_all(html, '(?i)\son[a-z]+\s*='))::INT AS n_handlers, len(regexp_extract_all(html, '(?i)<script'))::INT AS n_scripts FROM pages")
def html_inline_handlers(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_count("html", F.lit(r"(?i)\son[a-z]+\s*=")).alias("n_handlers"), F.regexp_count("html", F.lit("(?i)<script")).alias("n_scripts"))


# routing and text functions


_ASKED = ["find all bugs", "where is \"token\" used", "explain how 'auth' works", "security review of the swift keychain code, the network layer, and tests", "list unsafe rust blocks", "todo", "react and vue accessibility: check", "what (exactly) does the cache do when it is full and the disk is slow and nobody reads the metrics for a while"]


@query()
def query_routing(spark, sf_dir):
    q = F.col("q")
    return spark.createDataFrame([(x,) for x in _ASKED], "q string").select("q", T.query_type(q).alias("type"), T.query_mode(q).alias("mode"), T.is_broad_query(q).alias("broad"), T.is_literal_query(q).alias("literal"), T.scan_mode(T.query_type(q)).alias("scan_mode"), T.query_keywords(q).alias("keywords"), T.relevance_threshold(q).alias("threshold"), T.quoted_strings(q).alias("quoted"))


@query(r"SELECT doc_id, regexp_replace(regexp_replace(text, '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g') AS compressed, length(text) // 4 AS tokens, CASE WHEN length(text) > 400 THEN substr(text, 1, 400) ELSE text END AS cut, substr(sha256(concat('q', substr(text, 1, 500))), 1, 16) AS cache_key FROM documents")
def text_functions(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", T.compress_whitespace(t).alias("compressed"), T.estimate_tokens(t).alias("tokens"), T.truncate_to_tokens(t, 100).alias("cut"), T.cache_key(F.lit("q"), t).alias("cache_key"))


@query()
def project_facts(spark, sf_dir):
    from ..operators import project

    return project.project_facts(sample.files(spark))


@query()
def offline_analysis(spark, sf_dir):
    from ..operators import project

    return project.offline_analysis(scan_files(spark, sf_dir), "security of secrets and sql")


@query()
def offline_quick_scan(spark, sf_dir):
    from ..operators import project

    return project.quick_scan(scan_files(spark, sf_dir))


@query()
def priority_files(spark, sf_dir):
    from ..operators import project

    return project.priority_files(scan_files(spark, sf_dir))


@query()
def answer_findings(spark, sf_dir):
    from ..operators import project

    answers = spark.createDataFrame([(1, "1. HIGH: src/app.py:5 - password in code\n   Move it.\n2. low: web/view.js:8 - markup\n"), (2, "none")], "id int, text string")
    return project.answer_findings(answers)


# questions, answers, annotated texts, tokens and cost


_QUESTION = "concat('**Find** _', lang, '_ `', substr(text, 1, 40), '` {', doc_id, '}', chr(10), chr(10), chr(10), chr(10), '# Head *', source, '*')"


@query(rf"""WITH q AS (SELECT doc_id, replace(replace({_QUESTION}, '{{', '{{{{'), '}}', '}}}}') AS q FROM documents)
SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(q, '\*\*([^*]+)\*\*', '\1', 'g'), '\*([^*]+)\*', '\1', 'g'), '__([^_]+)__', '\1', 'g'), '_([^_]+)_', '\1', 'g'), '(?m)^#+\s*', '', 'g'), '`([^`]+)`', '\1', 'g'), '```[^\n]*\n?', '', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS query FROM q""")
def sanitized_questions(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", answers.sanitized(F.expr(_QUESTION)).alias("query"))


_NUMBERED = "concat('Find (1) ', source, ' in table_remove ( 2 ) missing check before assignAgent. (3) what (now)', CASE WHEN doc_id % 2 = 0 THEN ' (4) \"Quoted Text\" A' ELSE '' END)"


@query(rf"""WITH q AS (SELECT doc_id, {_NUMBERED} AS query FROM documents UNION ALL SELECT -1, 'slow loops in swift views, memory that is never freed and tests'),
h AS (SELECT doc_id, query, unnest(string_split(regexp_replace(query, '\(\s*(\d+)\s*\)\s*', chr(1) || '\1' || chr(2), 'g'), chr(1))[2:]) AS h FROM q),
i AS (SELECT doc_id, split_part(h, chr(2), 1)::INT AS number, regexp_replace(regexp_replace(split_part(h, chr(2), 2), '^\s+|\s+$', '', 'g'), '\.+$', '') AS description FROM h WHERE trim(split_part(h, chr(2), 2)) <> '' AND NOT contains(split_part(h, chr(2), 2), '(')),
p AS (SELECT doc_id, k::INT AS number, trim(part) AS description FROM (SELECT doc_id, unnest(string_split_regex(query, '\s*(?:,|\band\b|\bor\b)\s*')) AS part, generate_subscripts(string_split_regex(query, '\s*(?:,|\band\b|\bor\b)\s*'), 1) AS k FROM q WHERE doc_id NOT IN (SELECT doc_id FROM i)) WHERE length(trim(part)) > 10),
a AS (SELECT * FROM i UNION ALL SELECT * FROM p),
t AS (SELECT *, list_filter(regexp_extract_all(description, '\b([a-z_][a-z0-9_]*(?:[A-Z][a-zA-Z0-9_]*)?)\b', 1), lambda w: lower(w) NOT IN ({", ".join(f"'{w}'" for w in answers.PLAIN_WORDS)}) AND length(w) > 2) AS named, regexp_extract_all(description, '"([^"]+)"', 1) AS quoted, list_slice(list_filter(string_split_regex(description, '\s+'), lambda w: length(w) > 4), 1, 3) AS long FROM a)
SELECT doc_id, number, description, CASE WHEN len(named) > 0 THEN array_to_string(named[:5], '|') WHEN len(quoted) > 0 THEN array_to_string(list_transform(quoted, lambda w: regexp_replace(w, '([^A-Za-z0-9_])', '\\\1', 'g')), '|') WHEN len(long) > 0 THEN array_to_string(list_transform(long, lambda w: regexp_replace(w, '([^A-Za-z0-9_])', '\\\1', 'g')), '|') ELSE '.*' END AS pattern,
  CASE WHEN regexp_matches(lower(description), 'swift|ios|xcode') THEN '.swift' WHEN contains(lower(description), 'ts') OR contains(lower(description), 'typescript') THEN '.ts' WHEN regexp_matches(lower(description), 'js|javascript|react|phaser') THEN '.js' WHEN contains(lower(description), 'py') THEN '.py' END AS file_filter FROM t""")
def numbered_questions(spark, sf_dir):
    q = table(spark, sf_dir, "documents").select("doc_id", F.expr(_NUMBERED).alias("query"))
    more = spark.createDataFrame([(-1, "slow loops in swift views, memory that is never freed and tests")], "doc_id long, query string")
    return answers.numbered_items(q.unionByName(more)).drop("query")


@query("WITH q AS (SELECT doc_id, ['security', 'quality', 'ios', 'other'][doc_id % 4 + 1] AS type FROM documents), s AS (SELECT * FROM (VALUES " + ", ".join(f"({rules.sql_text(k)}, {n}, {rules.sql_text(t)})" for k, n, t in [(k, n, t) for k, ts in answers.SUBQUESTIONS.items() for n, t in enumerate(ts, 1)] + [("other", n, t) for n, t in enumerate(answers.SUBQUESTIONS["security"][:2] + answers.SUBQUESTIONS["quality"][:2], 1)]) + ") AS v(type, part, subquestion)) SELECT doc_id, type, part, subquestion FROM q JOIN s USING (type)")
def subquestions_by_kind(spark, sf_dir):
    kind = F.element_at(F.array(*[F.lit(x) for x in ("security", "quality", "ios", "other")]), (F.col("doc_id") % 4 + 1).cast("int"))
    return answers.subquestions(spark, table(spark, sf_dir, "documents").select("doc_id", kind.alias("type")))


_CODE = "substr(text, 3, 24)"
_CONTEXT = f"CASE doc_id % 8 WHEN 0 THEN concat('# note', chr(10), {_CODE}) WHEN 1 THEN concat(repeat(chr(34), 3), chr(10), {_CODE}, ' ', repeat(chr(34), 3)) WHEN 2 THEN concat('x // ', {_CODE}) WHEN 3 THEN concat('/* ', {_CODE}, ' */') WHEN 4 THEN concat('def test_it() ', {_CODE}) WHEN 5 THEN concat({_CODE}, ' # after') WHEN 6 THEN concat('/* ', {_CODE}) ELSE {_CODE} END"


def _between_sql(name: str) -> str:
    return f"coalesce(strpos({name}, part) > 0 AND strpos(substr({name}, strpos({name}, part) + length(part)), CASE '{name}' WHEN 'block' THEN '*/' WHEN 'double' THEN repeat(chr(34), 3) ELSE repeat(chr(39), 3) END) > 0, false)"


def _after_sql(mark: str, length: int) -> str:
    return f"CASE WHEN strpos(low, {mark}) > 0 THEN substr(low, strpos(low, {mark}) + {length}) END"


@query(rf"""WITH c AS (SELECT doc_id, lower(substr({_CODE}, 1, 20)) AS part, lower({_CONTEXT}) AS low FROM documents),
m AS (SELECT *, {_after_sql("'#'", 1)} AS hash, {_after_sql("'//'", 2)} AS slash, {_after_sql("'/*'", 2)} AS block, {_after_sql("repeat(chr(34), 3)", 3)} AS double, {_after_sql("repeat(chr(39), 3)", 3)} AS single FROM c),
f AS (SELECT *, coalesce(strpos(hash, part) > 0, false) OR coalesce(strpos(slash, part) > 0, false) AS in_comment, {_between_sql("block")} AS in_block, {_between_sql("double")} OR {_between_sql("single")} AS in_doc, coalesce(strpos(hash, part) > 0, false) AS in_hash FROM m)
SELECT doc_id, NOT (in_comment OR in_doc OR in_block) AS valid, CASE WHEN in_hash THEN 'in a comment' WHEN in_doc THEN 'in a docstring' WHEN in_comment THEN 'in a comment' WHEN in_block THEN 'in a block comment'
  WHEN regexp_matches(low, 'test_|_test\.|spec\.|mock|fixture|assert') THEN 'near tests' ELSE 'verified' END AS reason FROM f""")
def findings_in_context(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.expr(_CODE).alias("code"), F.expr(_CONTEXT).alias("context"))
    return d.select("doc_id", answers.context_check(F.col("code"), F.col("context")).alias("c")).select("doc_id", "c.valid", "c.reason")


_ANSWERS = [
    (1, "find secrets and tokens", "[HIGH] src/app.py:5 holds a secret, confidence HIGH: `password = 'x1'`; an injection in web/view.js:11, vulnerable to auth bypass"),
    (2, "find secrets", "There might be something, possibly a secret."), (3, "refactor this", "No issues."), (4, "slow loops", "gone/nowhere.py:7 is slow and uses memory: `for x in xs()` [LOW]"),
    (5, "anything", ""), (6, "memory leak", "src/app.py:99999 is slow, confidence low HIGH `a = call(b)` confidence"), (7, "what is this", "a finding in app.py:2 `import pickle.x`"),
]


@query("""SELECT * FROM (VALUES (1, 'security', true, 2::BIGINT, ['references', 'lines', 'code', 'confidence', 'files_exist', 'lines_exist'], 1.0::DOUBLE, 'PASSED'), (2, 'security', false, 0, ['files_exist', 'lines_exist'], 0.26, 'FAILED'),
(3, 'quality', true, 0, ['files_exist', 'lines_exist'], 0.48, 'FAILED'), (4, 'performance', true, 1, ['references', 'lines', 'code', 'confidence', 'lines_exist'], 0.846667, 'PASSED'), (5, 'general', false, 0, ['files_exist', 'lines_exist'], 0.0, 'FAILED'),
(6, 'performance', true, 1, ['references', 'lines', 'code', 'confidence', 'files_exist'], 0.793333, 'PASSED'), (7, 'general', true, 1, ['references', 'lines', 'code', 'files_exist', 'lines_exist'], 0.9, 'PASSED')) AS v(id, intent, aligned, n_references, checks, score, status)""")
def answers_judged(spark, sf_dir):
    return answers.judged_answers(spark.createDataFrame(_ANSWERS, "id int, query string, answer string"), sample.files(spark))


@query(rf"""WITH {_SAMPLE_LINES}, m AS (SELECT file_seq, path, line_no, regexp_matches(line, '^\s*#if\b') AS opens, regexp_matches(line, '^\s*#if\s+(?:false|0)\b') AS dead FROM lines WHERE regexp_matches(line, '^\s*#(?:if|endif)\b')),
d AS (SELECT *, sum(CASE WHEN opens THEN 1 ELSE -1 END) OVER (PARTITION BY file_seq, path ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS depth FROM m),
p AS (SELECT *, lead(line_no) OVER (PARTITION BY file_seq, path, CASE WHEN opens THEN depth ELSE depth + 1 END ORDER BY line_no) AS nxt FROM d),
r AS (SELECT file_seq, line_no AS s, coalesce(nxt, line_no) AS e FROM p WHERE opens AND dead)
SELECT l.file_seq, l.path, string_agg(concat(CASE WHEN a.s IS NOT NULL THEN concat('[DEAD CODE START: ', trim(line), ']', chr(10)) ELSE '' END, line, CASE WHEN z.e IS NOT NULL THEN chr(10) || '[DEAD CODE END]' ELSE '' END), chr(10) ORDER BY line_no) AS content
FROM lines l LEFT JOIN (SELECT DISTINCT file_seq, s FROM r) a ON a.file_seq = l.file_seq AND a.s = l.line_no LEFT JOIN (SELECT DISTINCT file_seq, e FROM r) z ON z.file_seq = l.file_seq AND z.e = l.line_no GROUP BY ALL""")
def dead_code_marked(spark, sf_dir):
    return answers.marked_dead_code(sample.files(spark))


@query(rf"WITH {DOC_LINES}, f AS (SELECT path FROM files WHERE contains(path, '/1') ORDER BY file_seq LIMIT 1), n AS (SELECT path, line, line_no, count(*) OVER (PARTITION BY path) AS n FROM lines WHERE path = (SELECT path FROM f)) SELECT path, concat(string_agg(concat(line_no, ': ', line), chr(10) ORDER BY line_no) FILTER (WHERE line_no <= 3), CASE WHEN max(n) > 3 THEN concat(chr(10), '... (', max(n) - 3, ' more lines)') ELSE '' END) AS text FROM n GROUP BY path")
def numbered_file_text(spark, sf_dir):
    return answers.numbered_text(doc_files(spark, sf_dir), "/1", 3)


@query("SELECT doc_id, length(text) // 4 AS total_tokens, length(text) AS characters, CASE WHEN length(text) > 0 THEN round((length(text) // 4) / length(text), 6) ELSE 0.0 END AS tokens_per_char, round((length(text) // 4) / 1000000 * 3.0, 9) AS input_cost, round((length(text) // 4) / 1000000 * 0.3, 9) AS cached_read_cost, round((length(text) // 4) / 1000000 * 3.75, 9) AS cached_write_cost, length(text) // 4 >= 1024 AS worth_caching FROM documents")
def token_costs(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", answers.token_stats(F.col("text")).alias("s"))
    return d.select("doc_id", "s.*", answers.worth_caching(F.col("s.total_tokens")).alias("worth_caching"))


@query("WITH m AS (SELECT conv_id, turn, length(coalesce(text, '')) // 4 + 4 AS tokens FROM conversations) SELECT conv_id, turn, tokens, (sum(tokens) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) + 3)::BIGINT AS prefix_tokens, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) IS NULL AND sum(tokens) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) + 3 >= 1024 AS breakpoint FROM m")
def prompt_cache_plan(spark, sf_dir):
    return answers.cache_plan(table(spark, sf_dir, "conversations"))


_USAGE = "CASE WHEN user_id % 3 = 0 THEN CAST(floor(value * 100) AS BIGINT) ELSE 0 END AS read_tokens, CASE WHEN user_id % 3 = 1 THEN CAST(floor(value * 10) AS BIGINT) ELSE 0 END AS write_tokens"


@query(f"WITH r AS (SELECT {_USAGE} FROM events), c AS (SELECT count(*) AS requests, count(*) FILTER (WHERE read_tokens > 0) AS hits, count(*) FILTER (WHERE read_tokens = 0 AND write_tokens = 0) AS misses, count(*) FILTER (WHERE write_tokens > 0) AS writes, sum(read_tokens)::BIGINT AS tokens_saved FROM r) SELECT *, round(hits / requests, 6) AS hit_rate, round(tokens_saved / 1000000 * (3.0 - 0.3)::DOUBLE, 6) AS cost_saved FROM c")
def prompt_cache_usage(spark, sf_dir):
    return answers.cache_usage(table(spark, sf_dir, "events").selectExpr(*_USAGE.split(", CASE")[:1], "CASE" + _USAGE.split(", CASE")[1]))


@query(f"WITH {_VERSIONS}, j AS (SELECT now.path, now.content_hash = b.content_hash AS same, b.path IS NULL AS fresh FROM now LEFT JOIN before b ON b.path = now.path) SELECT count(*) AS files, count(*) FILTER (WHERE same) AS hits, count(*) FILTER (WHERE NOT same AND NOT fresh) AS changed, count(*) FILTER (WHERE fresh) AS new, round(count(*) FILTER (WHERE same) / count(*), 6) AS hit_rate FROM j")
def incremental_reuse(spark, sf_dir):
    now, before = _versions(spark, sf_dir)
    return state.reuse_stats(doc_files(spark, sf_dir), before)


@query("SELECT key, event_type AS response, ts FROM (SELECT *, user_id::VARCHAR AS key, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS k FROM events) WHERE k = 1 ORDER BY ts DESC, key DESC LIMIT 40")
def response_cache_put(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("key"), F.col("event_type").alias("response"), "ts", "event_id")
    return state.cache_put(e.where("event_id % 2 = 0").drop("event_id"), e.where("event_id % 2 = 1").drop("event_id"), 40)


@query(rf"""WITH {DOC_FILES}, n AS (SELECT path, greatest(ceil(length(content) / 1800), 0) AS n FROM files WHERE length(content) > 0), g AS (SELECT n, greatest(ceil(sqrt(n)), 1) AS g FROM n), c AS (SELECT n, ceil(n / g) AS c1, greatest(g, 2) AS h FROM g),
d AS (SELECT CASE WHEN n = 1 THEN 0 WHEN c1 = 1 THEN 1 WHEN ceil(c1 / h) = 1 THEN 2 ELSE 3 END AS depth FROM c), s AS (SELECT path, content, unnest(range(0, length(content), 1800)) AS start FROM files)
SELECT (SELECT count(DISTINCT path) FROM s) AS documents, (SELECT sum(length(substr(content, start + 1, 2000)) // 4)::BIGINT FROM s) AS total_tokens, (SELECT count(*) FROM s) AS chunks, (SELECT list(depth ORDER BY depth)::INT[] FROM d) AS depths""")
def context_statistics(spark, sf_dir):
    c = chunks.fixed_chunks(doc_files(spark, sf_dir), 2000, 200).withColumn("token_count", F.floor(F.length("content") / 4))
    return answers.context_stats(c, chunks.summary_tree(c))


@query(f"WITH found AS (SELECT tool, count(*) AS n_found, count(*) FILTER (WHERE confidence IN ('HIGH', 'MEDIUM')) AS n_kept FROM ({_SECURITY_SQL}) GROUP BY tool) SELECT t.tool, coalesce(n_found, 0) AS n_found, coalesce(n_kept, 0) AS n_kept FROM (VALUES {', '.join(f'({t!r})' for t in [*_PLAIN_SECURITY, 'stateobject_issues'] if t != 'stateobject_issues')}) AS t(tool) LEFT JOIN found f ON f.tool = t.tool WHERE coalesce(n_kept, 0) > 0 OR coalesce(n_found, 0) = 0")
def scan_summary(spark, sf_dir):
    return scanners.scan_summary(scan_files(spark, sf_dir), _PLAIN_SECURITY)


@query()
def code_chunks(spark, sf_dir):
    return chunks.code_chunks(sample.files(spark), 200, 3)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
