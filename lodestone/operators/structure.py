"""Functions, complexity, regions, imports, call graph and architecture."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.corpus import lines
from .rules import expanded

_BOUND = "^~(?:const|let|var)~~(<w>)~=~(?:async~)?\\("
#: suffix -> how a function starts there; group 1 is its name.
STARTS = {
    suffix: expanded(pattern)
    for suffix, pattern in {
        ".py": "^~def~~(<w>)~\\(", ".go": "^~func~~(<w>)", ".rs": "^~(?:pub~~)?(?:async~~)?fn~~(<w>)", ".ts": _BOUND,
        ".swift": "^~(?:async~~)?func~~(<w>)~\\(", ".js": "^~(?:async~~)?function~~(<w>)~\\(",
        ".java": "^~(?:private|protected|public)?~(?:static~~)?(?:<w>~~)+(<w>)~\\(",
    }.items()
}
_COMPLEX_STARTS = {k: STARTS[k] for k in (".py", ".swift", ".js")} | {".ts": STARTS[".js"]}
#: Each match adds one; boolean operators count between word characters only.
BRANCHES = [rf"(?iu)\b{w}\b" for w in ("if", "elif", "else", "for", "while", "try", "except", "catch", "case", "guard", "switch")] + [r"(?iu)\b(?:&&|\|\||and|or)\b", r"\?.*:"]


def _name(starts: dict[str, str]) -> Column:
    out = F.lit("")
    for suffix, pattern in starts.items():
        out = F.when(F.col("path").endswith(suffix), F.regexp_extract("line", pattern, 1)).otherwise(out)
    return out


def functions(files: DataFrame, starts: dict[str, str] = STARTS) -> DataFrame:
    """(file_seq, path, name, start_line, end_line, length): up to the next start, the last one to the end of file."""
    known = F.lit(False)
    for s in starts:
        known = known | F.col("path").endswith(s)
    counted = files.where(known).withColumn("n_lines", F.size(F.split("content", "\n", -1)))
    ls = counted.select("file_seq", "path", "n_lines", F.posexplode(F.split("content", "\n", -1)).alias("k", "line"))
    heads = ls.withColumn("name", _name(starts)).where("name <> ''").select("file_seq", "path", "n_lines", "name", (F.col("k") + 1).alias("start_line"))
    order = Window.partitionBy("file_seq", "path").orderBy("start_line")
    ends = F.lead("start_line").over(order)
    return heads.withColumn("end_line", F.coalesce(ends - 1, F.col("n_lines"))).select("file_seq", "path", "name", "start_line", "end_line", (F.col("end_line") - F.col("start_line") + 1).alias("length"))


def _finding(df: DataFrame, tool: str, code: Column, issue: Column, conf: str, severity: Column, fix: str) -> DataFrame:
    return df.select(F.lit(tool).alias("tool"), F.lit(1).alias("rule_seq"), "file_seq", F.col("path").alias("file"), F.col("start_line").alias("line"), code.alias("code"), issue.alias("issue"), F.lit(conf).alias("confidence"), severity.alias("severity"), F.lit(fix).alias("fix"), F.lit(tool).alias("category"))


def long_functions(files: DataFrame, max_lines: int = 30) -> DataFrame:
    found = functions(files).where(F.col("length") > max_lines)
    severity = F.when(F.col("length") > 100, "HIGH").when(F.col("length") > 60, "MEDIUM").otherwise("LOW")
    return _finding(found, "long_functions", F.concat(F.col("name"), F.lit("(): "), F.col("length"), F.lit(" lines")), F.concat(F.lit("Function of "), F.col("length"), F.lit(f" lines, more than {max_lines}")), "HIGH", severity, "Split the function")


def complexity(files: DataFrame) -> DataFrame:
    """(file_seq, path, name, start_line, complexity): 1 and the branch words of the function's lines."""
    ls = lines(files.where(F.col("path").rlike(r"\.(?:py|swift|js|ts)$")))
    order = Window.partitionBy("file_seq", "path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    named = ls.withColumn("name", _name(_COMPLEX_STARTS)).withColumn("func", F.sum((F.col("name") != "").cast("int")).over(order)).where("func > 0")
    branches = F.lit(0)
    for pattern in BRANCHES:
        branches = branches + F.regexp_count("line", F.lit(pattern))
    return named.groupBy("file_seq", "path", "func").agg(F.max(F.when(F.col("name") != "", F.col("name"))).alias("name"), F.min("line_no").alias("start_line"), (F.sum(branches) + 1).alias("complexity")).drop("func")


def complex_functions(files: DataFrame, most: int = 10) -> DataFrame:
    found = complexity(files).where(F.col("complexity") > most)
    severity = F.when(F.col("complexity") < 20, "MEDIUM").otherwise("HIGH")
    return _finding(found, "complex_functions", F.concat(F.col("name"), F.lit("(): complexity "), F.col("complexity")), F.concat(F.lit("Complexity "), F.col("complexity"), F.lit(f", more than {most}")), "MEDIUM", severity, "Split the decisions")


def dead_regions(files: DataFrame) -> DataFrame:
    """(file_seq, path, start_line, end_line) of '#if false' and '#if 0' regions, with nesting.

    The depth is a running sum of openings and closings; a region ends at the
    first line where the depth falls below its own.
    """
    ls = lines(files.where(F.col("content").contains("#if")))
    opens, closes = F.col("line").rlike(r"^\s*#if\b"), F.col("line").rlike(r"^\s*#endif\b")
    order = Window.partitionBy("file_seq", "path").orderBy("line_no")
    marks = ls.where(opens | closes).select("file_seq", "path", "line_no", opens.alias("opens"), F.col("line").rlike(r"^\s*#if\s+(?:false|0)\b").alias("dead"))
    deep = marks.withColumn("depth", F.sum(F.when(F.col("opens"), 1).otherwise(-1)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    level = F.when(F.col("opens"), F.col("depth")).otherwise(F.col("depth") + 1)
    paired = deep.withColumn("level", level).withColumn("end_line", F.lead("line_no").over(Window.partitionBy("file_seq", "path", "level").orderBy("line_no")))
    return paired.where("opens and dead").select("file_seq", "path", F.col("line_no").alias("start_line"), F.coalesce("end_line", "line_no").alias("end_line"))


def lines_in_regions(refs: DataFrame, regions: DataFrame) -> DataFrame:
    """References (path, line) that lie in a region, with the first such region: an interval join within the path."""
    hit = refs.join(regions.select(F.col("path").alias("_p"), "start_line", "end_line"), (F.col("path") == F.col("_p")) & F.col("line").between(F.col("start_line"), F.col("end_line")))
    first = Window.partitionBy(*refs.columns).orderBy("start_line", "end_line")
    return hit.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n", "_p")


_FROM, _BIND = "~~from~~<q>([^'\"]+)<q>", "(?:const|let|var)~~"
_CALL = "\\(<q>([^'\"]+)<q>\\)"
#: kind -> pattern of module imports; groups are what is imported and from where.
IMPORTS = {
    kind: expanded(pattern)
    for kind, pattern in {
        "dynamic": "()import" + _CALL, "side_effect": "import~~()<q>([^'\"]+)<q>", "namespace": "import~~\\*~~as~~(<w>)" + _FROM, "default": "import~~(<w>)" + _FROM,
        "named": "import~~\\{([^}]+)\\}" + _FROM, "required": _BIND + "(<w>)~=~require" + _CALL, "required_named": _BIND + "\\{([^}]+)\\}~=~require" + _CALL,
    }.items()
}
EXPORTS = {
    kind: expanded(pattern)
    for kind, pattern in {"module": "module\\.exports~=~(\\{[^}]+\\}|<w>)", "named": "export~~\\{([^}]+)\\}", "default": "export~~default~~(<w>)", "declaration": "export~~(?:class|const|function|interface|let|type|var)~~(<w>)"}.items()
}


def import_edges(files: DataFrame) -> DataFrame:
    """(path, kind, imported, module): one row an import of a script file."""
    scripts = files.where(F.col("path").rlike(r"\.(?:cjs|js|jsx|mjs|ts|tsx)$"))

    def of(kind: str, pattern: str) -> Column:
        what, whence = F.regexp_extract_all("content", F.lit(pattern), F.lit(1)), F.regexp_extract_all("content", F.lit(pattern), F.lit(2))
        return F.zip_with(what, whence, lambda a, b: F.struct(F.lit(kind).alias("kind"), F.trim(a).alias("imported"), b.alias("module")))

    found = F.concat(*[of(k, p) for k, p in IMPORTS.items()])
    return scripts.select("path", F.explode(found).alias("i")).select("path", "i.kind", "i.imported", "i.module")


def exports(files: DataFrame) -> DataFrame:
    """(path, kind, exported)."""
    scripts = files.where(F.col("path").rlike(r"\.(?:cjs|js|jsx|mjs|ts|tsx)$"))

    def of(kind: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all("content", F.lit(pattern), F.lit(1)), lambda x: F.struct(F.lit(kind).alias("kind"), F.trim(x).alias("exported")))

    return scripts.select("path", F.explode(F.concat(*[of(k, p) for k, p in EXPORTS.items()])).alias("e")).select("path", "e.kind", "e.exported")


def import_frequency(files: DataFrame, top: int = 15) -> DataFrame:
    """The modules imported most often, ties by name."""
    py = F.regexp_extract_all("content", F.lit(r"(?m)^\s*(?:from|import)\s+([\w.]+)"), F.lit(1))
    from_py = files.where(F.col("path").endswith(".py")).select(F.explode(py).alias("module"))
    every = from_py.unionByName(import_edges(files).select("module"))
    return every.groupBy("module").agg(F.count("*").alias("n_imports")).orderBy(F.desc("n_imports"), "module").limit(top)


_NOT_FUNCTIONS = ("if", "for", "while", "switch", "catch", "return", "function", "guard", "elif", "else", "with", "print")


def call_edges(files: DataFrame) -> DataFrame:
    """(path, caller, callee, line_no, internal): calls within functions; ``internal`` if the corpus defines the callee."""
    ls = lines(files.where(F.col("path").rlike(r"\.(?:py|swift|js|ts|rs|go)$")))
    order = Window.partitionBy("file_seq", "path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    named = ls.withColumn("name", F.nullif(_name(STARTS), F.lit(""))).withColumn("caller", F.last("name", ignorenulls=True).over(order))
    calls = named.where("caller is not null").select("path", "caller", "line_no", "name", F.explode(F.array_distinct(F.regexp_extract_all("line", F.lit(r"\b([A-Za-z_]\w*)\s*\("), F.lit(1)))).alias("callee"))
    calls = calls.where(~F.col("callee").isin(*_NOT_FUNCTIONS) & (F.col("name").isNull() | (F.col("name") != F.col("callee")))).groupBy("path", "caller", "callee").agg(F.min("line_no").alias("line_no"))
    defined = named.where("name is not null").select(F.col("name").alias("_d")).distinct()
    return calls.join(defined, calls.callee == defined["_d"], "left").select("path", "caller", "callee", "line_no", F.col("_d").isNotNull().alias("internal"))


def reachable(edges: DataFrame, start: str, depth: int = 5) -> DataFrame:
    """(name, depth): functions reached from ``start``, with the least number of calls, level by level."""
    spark = edges.sparkSession
    e = edges.select("caller", "callee").distinct()
    seen = spark.createDataFrame([(start, 0)], "name string, depth int")
    front = seen
    for d in range(1, depth + 1):
        step = front.join(e, front.name == e.caller).select(F.col("callee").alias("name")).distinct()
        front = step.join(seen, "name", "left_anti").withColumn("depth", F.lit(d))
        seen = seen.unionByName(front)
    return seen


def architecture(files: DataFrame) -> DataFrame:
    """(category, n_files, n_lines, n_functions, n_classes): the first category whose mark a path has."""
    low = F.lower("path")
    category = (
        F.when(low.rlike(r"(?:^|/)(?:__main__|app|index|main|server)\.\w+$|appdelegate"), "entry").when(low.rlike("component|page|screen|view"), "views").when(low.rlike("entit|model|schema"), "models")
        .when(low.rlike("api|client|manager|service"), "services").when(low.rlike("helper|util|extension"), "utilities").when(low.rlike("spec|test"), "tests").when(low.rlike(r"config|setting|\.(?:ini|json|toml|yaml|yml)$"), "config").otherwise("other")
    )
    return files.select(category.alias("category"), F.size(F.split("content", "\n", -1)).alias("l"), F.regexp_count("content", F.lit(r"(?m)^\s*(?:async\s+)?(?:pub\s+)?(?:def|fn|func|function)\s+\w+")).alias("f"), F.regexp_count("content", F.lit(r"(?m)^\s*(?:export\s+)?(?:class|enum|interface|protocol|struct|trait)\s+\w+")).alias("c")).groupBy("category").agg(
        F.count("*").alias("n_files"), F.sum("l").alias("n_lines"), F.sum("f").alias("n_functions"), F.sum("c").alias("n_classes")
    )


def signatures(files: DataFrame, most: int = 20) -> DataFrame:
    """(path, signatures): the first class and function heads of each file."""
    heads = F.regexp_extract_all("content", F.lit(r"(?m)^\s*((?:export\s+|pub\s+|public\s+|private\s+|async\s+)*(?:class|def|enum|fn|func|function|interface|protocol|struct|trait)\s+\w+[^\n{:]*)"), F.lit(1))
    return files.select("file_seq", "path", F.slice(heads, 1, most).alias("signatures")).where(F.size("signatures") > 0)


def websocket_flow(files: DataFrame) -> DataFrame:
    """The websocket rules, with a summary row first (line 0)."""
    from .scanners import rule_scan

    found = rule_scan(files, "websocket_flow")
    total = found.groupBy().agg(F.count("*").alias("n"), F.count_distinct("file").alias("f")).where("n > 0")
    summary = total.select(F.lit("websocket_flow").alias("tool"), F.lit(0).alias("rule_seq"), F.lit(-1).cast("long").alias("file_seq"), F.lit("(summary)").alias("file"), F.lit(0).alias("line"), F.concat("n", F.lit(" places in "), "f", F.lit(" files")).alias("code"), F.lit("Websocket use").alias("issue"), F.lit("HIGH").alias("confidence"), F.lit("INFO").alias("severity"), F.lit("").alias("fix"), F.lit("websocket").alias("category"))
    return summary.unionByName(found)
