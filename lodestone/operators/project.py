"""Facts about a project, the offline analyser, ingestion and answers in a fixed form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..sources.corpus import extension_of, lines
from . import chunks
from .rules import Rule, expanded, rule_hits

_KINDS = (("ios", (".swift", ".m", ".mm")), ("python", (".py",)), ("node", (".js", ".jsx", ".ts", ".tsx", ".vue")), ("rust", (".rs",)), ("go", (".go",)), ("java", (".java", ".kt")))
_KEY_FILES = r"(?i)(?:^|/)(?:readme\.md|package\.json|pyproject\.toml|setup\.py|cargo\.toml|go\.mod|package\.swift|podfile|info\.plist|dockerfile|makefile)$"
_ENTRIES = r"(?i)(?:^|/)(?:main|app|index|server|__main__)\.(?:py|js|ts|tsx|swift|rs|go)$|(?:App|AppDelegate)\.swift$"
_STACK = {"react": r"(?i)[\"']react[\"']", "vue": r"(?i)[\"']vue[\"']", "angular": r"@angular/core", "express": r"[\"']express[\"']", "django": r"\bdjango\b", "flask": r"\bflask\b", "fastapi": r"\bfastapi\b", "swiftui": r"\bimport SwiftUI\b", "swiftdata": r"\bimport SwiftData\b", "cloudkit": r"\bimport CloudKit\b", "spark": r"\bpyspark\b", "tokio": r"\btokio\b"}


def project_facts(files: DataFrame) -> DataFrame:
    """One row: project_type (most files; of equals the first kind), key_files, entry_points, tech_stack, features, n_files.

    Features are the list items and second-level headings of README files.
    """
    ext = extension_of(F.col("path"))
    counts = [F.count_if(ext.isin(*s)).alias(f"_{k}") for k, s in _KINDS]
    names = lambda cond: F.array_sort(F.collect_set(F.when(cond, F.col("path"))))
    stack = [F.bool_or(F.col("content").rlike(p)).alias(f"_s_{k}") for k, p in _STACK.items()]
    readme = F.when(F.lower("path").rlike(r"(?:^|/)readme\.md$"), F.regexp_extract_all("content", F.lit(r"(?m)^(?:[-*] +|## +)([^\n]+)"), F.lit(1)))
    one = files.agg(F.count("*").alias("n_files"), *counts, names(F.col("path").rlike(_KEY_FILES)).alias("key_files"), names(F.col("path").rlike(_ENTRIES)).alias("entry_points"), F.array_distinct(F.flatten(F.collect_list(readme))).alias("features"), *stack)
    best = F.array_max(F.array(*[F.struct(F.col(f"_{k}").alias("n"), F.lit(-i).alias("o"), F.lit(k).alias("k")) for i, (k, _) in enumerate(_KINDS)]))
    kind = F.when(best["n"] > 0, best["k"]).otherwise("unknown")
    tech = F.array_compact(F.array(*[F.when(F.col(f"_s_{k}"), F.lit(k)) for k in _STACK]))
    return one.select("n_files", kind.alias("project_type"), "key_files", "entry_points", tech.alias("tech_stack"), F.slice("features", 1, 20).alias("features"))


def package_dependencies(files: DataFrame) -> DataFrame:
    """(path, name, version) of package.json files; others and broken ones give nothing."""
    parsed = files.where(F.col("path").rlike(r"(?:^|/)package\.json$")).select("path", F.from_json("content", "dependencies map<string,string>, devDependencies map<string,string>").alias("p"))
    return parsed.select("path", F.explode(F.map_concat(F.coalesce("p.dependencies", F.create_map().cast("map<string,string>")), F.coalesce("p.devDependencies", F.create_map().cast("map<string,string>")))).alias("name", "version"))


def priority_files(files: DataFrame, most: int = 50) -> DataFrame:
    """(path, band): key files, entry points, files that a README names, then sources; ties in file order."""
    readme = files.where(F.lower("path").rlike(r"(?:^|/)readme\.md$")).select(F.explode(F.regexp_extract_all("content", F.lit(r"([\w./-]+\.[A-Za-z]\w*)"), F.lit(1))).alias("_m")).distinct()
    base = F.substring_index("path", "/", -1)
    named = files.withColumn("_b", base).join(readme.withColumn("_b", F.substring_index("_m", "/", -1)), "_b").where(F.col("path").endswith(F.col("_m"))).select("path").distinct().withColumn("_named", F.lit(True))
    band = F.when(F.col("path").rlike(_KEY_FILES), 0).when(F.col("path").rlike(_ENTRIES), 1).when(F.col("_named"), 2).when(P.is_code_path(F.col("path")) & ~P.is_test_path(F.col("path")), 3).otherwise(4)
    return files.join(named, "path", "left").select("file_seq", "path", band.alias("band")).orderBy("band", "file_seq").limit(most)


#: category -> (question words that select it, suffixes or none, severity, rules as (pattern, description)).
OFFLINE = {
    "hardcoded_secrets": (("secur", "secret", "password", "credential", "key"), (), "CRITICAL", [(r"(?:api_?key|passw(?:or)?d|secret|token)\s*[:=]\s*[\"'][^\"']{6,}[\"']", "Sensitive value in a literal"), (r"AKIA[0-9A-Z]{16}", "Cloud key id"), (r"-----BEGIN [A-Z ]*PRIVATE KEY-----", "Private key"), (r"gh[pousr]_[A-Za-z0-9]{30,}", "Code host token"), (r"sk-[A-Za-z0-9]{20,}", "Service key")]),
    "sql_injection": (("secur", "sql", "inject", "database"), (".go", ".java", ".js", ".php", ".py", ".rb", ".ts"), "HIGH", [(r"(?:execute|query)~\(~f<q>", "Interpolated statement"), (r"(?:DELETE|INSERT|SELECT|UPDATE)\s.*[\"']\s*\+", "Concatenated statement"), (r"(?:DELETE|INSERT|SELECT|UPDATE)\s.*\$\{", "Template statement"), (r"(?:execute|query)\s*\(.*%\s*\(?\w", "Formatted statement")]),
    "command_injection": (("secur", "command", "shell", "inject"), (".js", ".py", ".rb", ".ts"), "HIGH", [(r"os\.(?:popen|system)\s*\(", "Shell command"), (r"shell\s*=\s*True", "Subprocess in a shell"), (r"child_process", "Child process"), (r"\beval\s*\(", "eval")]),
    "path_traversal": (("secur", "path", "travers"), (), "MEDIUM", [(r"\.\./\.\./", "Relative path upwards"), (r"open\s*\(.*(?:input|request|argv)", "File named by input")]),
    "force_unwrap": (("crash", "ios", "swift", "unwrap"), (".swift",), "MEDIUM", [(r"\btry!", "Forced try"), (r"\bas!\s", "Forced cast"), (r"\w![.\[)]", "Forced unwrap"), (r"\.first!|\.last!", "Forced element"), (r"URL\(string:[^)]*\)!", "Forced address")]),
    "retain_cycles": (("ios", "leak", "memory", "retain", "swift"), (".swift",), "MEDIUM", [(r"\.sink\s*\{[^\[]*self\.", "Sink holds self"), (r"delegate\s*:\s*\w+\??\s*$", "Strong delegate"), (r"Timer\.scheduledTimer", "Timer may hold self")]),
    "actor_isolation": (("actor", "concurren", "ios", "swift", "thread"), (".swift",), "MEDIUM", [(r"nonisolated\(unsafe\)", "Isolation bypassed"), (r"DispatchQueue\.main\.sync", "Synchronous dispatch to main")]),
    "sendable": (("concurren", "sendable", "swift"), (".swift",), "MEDIUM", [(r"@unchecked\s+Sendable", "Unchecked Sendable"), (r"@preconcurrency", "Checks silenced")]),
    "swiftui_lifecycle": (("ios", "swiftui", "view"), (".swift",), "LOW", [(r"@ObservedObject~~var~~<w>~=", "Observed object built where it is observed"), (r"\.onAppear\s*\{.*Task", "Task on appearance")]),
    "urls": (("config", "http", "network", "url"), (), "LOW", [(r"http://[\w.-]+", "Plain address")]),
    "prints": (("debug", "log", "print", "quality"), (".js", ".py", ".swift", ".ts"), "LOW", [(r"^\s*print\s*\(", "Print"), (r"console\.log\s*\(", "Console log")]),
    "swiftdata": (("data", "ios", "persist", "swiftdata"), (".swift",), "MEDIUM", [(r"@Model\s+(?:final\s+)?class", "Model class"), (r"@Relationship", "Relationship"), (r"VersionedSchema|SchemaMigrationPlan", "Migration"), (r"FetchDescriptor<", "Fetch")]),
    "cloud_sync": (("cloud", "ios", "sync"), (".swift",), "MEDIUM", [(r"CK(?:Database|ModifyRecords)\w*", "Cloud operation")]),
    "core_data": (("core data", "ios", "thread"), (".swift",), "MEDIUM", [(r"viewContext", "Main context"), (r"performAndWait", "Blocking context call")]),
    "todo": (("quality", "task", "todo"), (), "INFO", [(r"\bTODO\b", "To do"), (r"\bFIXME\b", "To fix"), (r"\bHACK\b", "Workaround"), (r"\bXXX\b", "Doubt"), (r"\bTEMP\b", "Temporary")]),
    "debug_code": (("debug", "quality"), (), "LOW", [(r"\bdebugger\b", "Debugger statement"), (r"\bpdb\.set_trace\b|\bbreakpoint\(\)", "Breakpoint"), (r"#if DEBUG", "Debug block")]),
    "empty_catch": (("error", "exception", "quality"), (), "MEDIUM", [(r"catch\s*(?:\([^)]*\))?\s*\{\s*\}", "Empty catch"), (r"except[^:]*:\s*pass\b", "Swallowed exception"), (r"except\s*:\s*$", "Bare except")]),
}


def offline_analysis(files: DataFrame, question: str) -> DataFrame:
    """Findings of the categories that the question's words select (the security ones without any), most severe first.

    Categories are restricted to their suffixes; everything is one pass.
    """
    low = question.lower()
    chosen = [c for c, (w, *_) in OFFLINE.items() if any(x in low for x in w)] or ["hardcoded_secrets", "sql_injection", "command_injection", "path_traversal"]
    rules = [Rule(c, k + 1, OFFLINE[c][2], expanded(p), d, c, suffixes=OFFLINE[c][1], skip=("comment",) if c not in ("todo", "debug_code") else ()) for c in chosen for k, (p, d) in enumerate(OFFLINE[c][3])]
    found = rule_hits(lines(files), rules)
    return found.orderBy(F.desc(P.rank(F.col("severity"), P.SEVERITY_RANK)), "file_seq", "line", "tool", "rule_seq")


def quick_scan(files: DataFrame) -> DataFrame:
    """(category, n): all matches over whole contents, every category."""
    counts = [F.sum(sum((F.regexp_count("content", F.lit("(?im)" + expanded(p))) for p, _ in r), F.lit(0))).alias(c) for c, (_, _, _, r) in OFFLINE.items()]
    wide = files.agg(*counts)
    return wide.select(F.explode(F.map_filter(F.create_map(*[x for c in OFFLINE for x in (F.lit(c), F.col(c))]), lambda k, v: v > 0)).alias("category", "n"))


def ingest(files: DataFrame, path: str, limit: int = chunks.SIZE) -> None:
    """Write a corpus as tables: documents, chunks (by sections) and the summary tree's nodes."""
    cut = chunks.section_chunks(files, limit)
    files.write.mode("overwrite").parquet(f"{path}/documents")
    cut.write.mode("overwrite").parquet(f"{path}/chunks")
    chunks.summary_tree(files.sparkSession.read.parquet(f"{path}/chunks").select("path", "chunk_id")).write.mode("overwrite").parquet(f"{path}/nodes")


def query_tree(nodes: DataFrame, chunk_table: DataFrame, query: str, threshold: float = 0.3, depth: int = 2, top: int = 5) -> DataFrame:
    """The most relevant chunks by a walk down the tree.

    A node is as relevant as the share of the query's words in the first 1,000
    characters of its chunks; a level keeps only children of nodes that reach
    the threshold.
    """
    words = sorted({w for w in query.lower().split() if len(w) > 2})

    def relevance(text: Column) -> Column:
        n = F.lit(0)
        for w in words:
            n = n + F.lower(text).contains(w).cast("int")
        return n / max(1, len(words))

    head = chunk_table.select(F.col("path").alias("_p"), F.col("chunk_id").alias("_c"), F.substring("content", 1, 1000).alias("_t"))
    scored = nodes.join(head, (F.col("path") == F.col("_p")) & F.col("_c").between(F.col("first_chunk"), F.col("last_chunk"))).groupBy("path", "level", "node", "first_chunk", "last_chunk").agg(F.max(relevance(F.col("_t"))).alias("relevance"))
    kept = scored.where(F.col("level") == depth)
    for level in range(depth - 1, -1, -1):
        below = scored.where(F.col("level") == level)
        passed = kept.where(F.col("relevance") >= threshold).select(F.col("path").alias("_p"), F.col("first_chunk").alias("_a"), F.col("last_chunk").alias("_b"))
        tall = scored.where(F.col("level") == level + 1).select(F.col("path").alias("_q")).distinct()
        inside = below.join(passed, (F.col("path") == F.col("_p")) & (F.col("first_chunk") >= F.col("_a")) & (F.col("last_chunk") <= F.col("_b")), "left_semi")
        alone = below.join(tall, F.col("path") == F.col("_q"), "left_anti")
        kept = inside.unionByName(alone)
    return kept.where(F.col("relevance") >= threshold).orderBy(F.desc("relevance"), "path", "first_chunk").limit(top).select("path", F.col("first_chunk").alias("chunk_id"), "relevance")


def answer_findings(answers: DataFrame, text_col: str = "text") -> DataFrame:
    """(answer columns, file, line, severity, title, description): findings of answers that name file:line.

    A line with a reference outside code fences starts a finding; the lines up
    to the next one describe it.  Fences are a running count modulo two.
    """
    numbered = answers.withColumn("_id", F.monotonically_increasing_id()).select("*", F.posexplode(F.split(F.col(text_col), "\n", -1)).alias("_k", "_line"))
    order = Window.partitionBy("_id").orderBy("_k").rowsBetween(Window.unboundedPreceding, 0)
    ref = r"([\w./-]+\.[A-Za-z]\w*):(\d+)"
    fenced = numbered.withColumn("_fence", F.sum(F.col("_line").rlike(r"^\s*```").cast("int")).over(order) % 2)
    starts = fenced.withColumn("_start", (F.col("_fence") == 0) & F.col("_line").rlike(ref)).withColumn("_f", F.sum(F.col("_start").cast("int")).over(order)).where("_f > 0")
    keys = [c for c in answers.columns if c != text_col]
    head = F.max(F.when(F.col("_start"), F.col("_line")))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("_start") & (F.trim("_line") != ""), F.struct("_k", "_line")))), lambda x: x["_line"]), "\n")
    one = starts.groupBy("_id", "_f", *keys).agg(head.alias("_head"), body.alias("description"))
    severity = F.coalesce(F.nullif(F.upper(F.regexp_extract("_head", r"(?i)\b(critical|high|medium|low|info)\b", 1)), F.lit("")), F.lit("MEDIUM"))
    title = F.regexp_replace(F.regexp_replace("_head", ref, ""), r"^[\s#*\-\d.`:]+|[\s*`:\-]+$", "")
    return one.select(*keys, F.regexp_extract("_head", ref, 1).alias("file"), F.regexp_extract("_head", ref, 2).cast("int").alias("line"), severity.alias("severity"), title.alias("title"), "description")


def doubtful_lines(answers: DataFrame, text_col: str = "text", high_line: int = 10_000) -> DataFrame:
    """answers with ``doubt``: phrases of a made-up example, or a line number beyond any usual file."""
    t = F.col(text_col)
    phrase = t.rlike(r"(?i)\b(?:for example, (?:a|the) file|hypothetical|as an example|let'?s (?:assume|say)|might look like|typical(?:ly)? (?:a|the) project)\b")
    number = F.exists(F.regexp_extract_all(t, F.lit(r":(\d{1,9})\b"), F.lit(1)), lambda x: x.cast("int") > high_line)
    return answers.withColumn("doubt", F.array_compact(F.array(F.when(phrase, F.lit("example")), F.when(number, F.lit("line number")))))


def request_errors(requests: DataFrame) -> DataFrame:
    """requests (query, paths) with ``errors``: empty or over 50,000 characters, no path or over 100, a path that climbs."""
    q, p = F.col("query"), F.col("paths")
    checks = [(F.coalesce(F.trim(q) == "", F.lit(True)), "empty query"), (F.length(q) > 50_000, "query too long"), (F.coalesce(F.size(p) < 1, F.lit(True)), "no path"), (F.size(p) > 100, "too many paths"), (F.exists(p, lambda x: x.rlike(r"(?:^|/)\.\.(?:/|$)")), "path climbs")]
    return requests.withColumn("errors", F.array_compact(F.array(*[F.when(c, F.lit(e)) for c, e in checks])))
