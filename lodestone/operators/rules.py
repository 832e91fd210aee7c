"""From rule text to one-pass column expressions, and to the same plan in SQL."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, replace

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import predicates as P
from .rulesets import RULES, SENSITIVE, SHORTHAND

SEVERITY = {"C": "CRITICAL", "H": "HIGH", "M": "MEDIUM", "L": "LOW", "I": "INFO"}
#: What makes innerHTML and its like safe, on the line or the five before it.
SANITIZER = r"(?:encodeHTML|escape|escapeHtml|htmlEncode|purify|safeHTML|sanitize|sanitizeHtml|xss)\s*\(|DOMPurify\.sanitize|createTextNode|(?:textContent|\.innerText)\s*=|validator\.escape|(?:entities|he)\.encode"


@dataclass(frozen=True)
class Rule:
    tool: str
    seq: int
    severity: str
    pattern: str
    issue: str
    category: str = ""
    fix: str = ""
    conf: str = "HIGH"
    suffixes: tuple[str, ...] = ()
    after: str | None = None
    other: str | None = None
    unless: str | None = None
    guard: str | None = None
    skip: tuple[str, ...] = ()
    cut: int = 200


def expanded(pattern: str) -> str:
    for short, long in SHORTHAND:
        pattern = pattern.replace(short, long)
    return pattern.replace("@KEYS", SENSITIVE)


#: What may be forced: constants and fixed coders and formatters.
SAFE_TRY = expanded(r"(?:Date|Number)Formatter|JSON(?:De|En)coder|NSRegularExpression|static~~let~~<w>~=~try!")


def parsed(text: str = RULES) -> dict[str, list[Rule]]:
    tools: dict[str, list[Rule]] = {}
    base: Rule | None = None
    for raw in text.strip().split("\n"):
        if not raw.strip():
            continue
        if raw.startswith("["):
            name, rest = re.match(r"\[(\w+)\] ?(.*)", raw).groups()
            rest, _, fix = rest.partition(" fix=")
            given = dict(x.split("=", 1) for x in rest.split())
            base = Rule(name, 0, "", "", "", given["category"], fix, given["conf"], tuple(given.get("suffix", "").split(",")) if "suffix" in given else (), unless=given.get("unless"), guard=given.get("guard"), skip=tuple(given.get("skip", "").split(",")) if "skip" in given else (), cut=int(given.get("cut", 200)))
            tools[name] = []
            continue
        body, issue = raw.rsplit(" :: ", 1)
        words = body.split(" ")
        suffixes, skip = base.suffixes, base.skip
        while words[0] not in SEVERITY:
            word = words.pop(0)
            if word.startswith("suffix="):
                suffixes = tuple(word[7:].split(","))
            else:
                skip = (*skip, word)
        severity, pattern = SEVERITY[words[0]], " ".join(words[1:])
        pattern, _, other = pattern.partition(" !- ")
        pattern, _, after = pattern.partition(" !! ")
        tools[base.tool].append(replace(base, seq=len(tools[base.tool]) + 1, severity=severity, pattern=expanded(pattern), issue=issue, suffixes=suffixes, skip=skip, after=expanded(after) or None, other=expanded(other) or None))
    return tools


TOOLS = parsed()


def literal_of(pattern: str) -> str | None:
    """The longest text that every match must contain, or None; at least four letters, in lower case.

    A regex search costs far more than a substring test, so the test goes
    first.
    """
    if re.search(r"(?<!\\)\|", re.sub(r"\([^()]*\)|\[[^\]]*\]", "", re.sub(r"\([^()]*\)", "", pattern))):
        return None
    best, run, k, depth = "", "", 0, 0

    def close() -> None:
        nonlocal best, run
        best, run = max(best, run, key=len), ""

    while k < len(pattern):
        c = pattern[k]
        if c == "[":
            close()
            k = pattern.index("]", k + 2) + 1
            continue
        if c == "\\":
            close()
            k += 2
            continue
        if c in "()":
            depth += 1 if c == "(" else -1
            close()
        elif c in "?*{":
            run = run[:-1]
            close()
        elif depth == 0 and (c.isalnum() or c == "_"):
            run += c
        else:
            close()
        k += 1
    close()
    return best.lower() if len(best) >= 4 and best.isascii() else None


def suffix_condition(path: Column, suffixes: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for s in suffixes:
        out = out | path.endswith(s)
    return out if suffixes else F.lit(True)


def condition(rule: Rule, line: Column, path: Column, low: Column) -> Column:
    """Whether a rule holds on a line of a file that its suffixes allow, as built-in expressions only."""
    flag = "(?iu)"
    cond = line.rlike(flag + rule.pattern)
    literal = literal_of(rule.pattern)
    if literal:
        cond = low.contains(literal) & cond
    if rule.after:
        cond = cond & ~F.regexp_replace(line, f"{flag}^.*(?:{rule.pattern})", "").rlike(flag + rule.after)
    if rule.other:
        cond = cond & ~line.rlike(flag + rule.other)
    if rule.unless:
        cond = cond & ~line.contains(rule.unless)
    for skip in rule.skip:
        if skip == "comment":
            cond = cond & ~P.is_comment(line)
        elif skip == "noncode":
            cond = cond & P.is_code_path(path)
        elif skip == "test":
            cond = cond & ~P.is_test_path(path)
        elif skip == "hashslash":
            cond = cond & ~line.rlike(r"[#*]|//")
        elif skip == "rusttest":
            cond = cond & ~(path.contains("/tests/") | path.contains("_test.rs") | line.contains("#[test]"))
        elif skip == "notest":
            cond = cond & ~F.lower(path).contains("test")
        elif skip == "safetry":
            cond = cond & ~line.rlike(SAFE_TRY)
        else:
            raise ValueError(f"unknown skip {skip}")
    return cond


#: Conditions by rule; a column belongs to no table, and a hundred calls to the JVM a rule are slow.
_CONDITIONS: dict[tuple[int, Rule], Column] = {}


def _cached(rule: Rule) -> Column:
    key = (id(SparkContext._jvm), rule)
    if key not in _CONDITIONS:
        _CONDITIONS[key] = condition(rule, F.col("line"), F.col("path"), F.col("_low"))
    return _CONDITIONS[key]


_DETAILS = "array<struct<tool string, rule_seq int, issue string, severity string, category string, fix string, conf string, cut int>>"


def rule_hits(lines: DataFrame, rules: list[Rule], gates: dict[str, Column] | None = None) -> DataFrame:
    """Findings of all rules in one pass over the lines.

    Each line gives an array of the numbers of the rules that hold (literal
    test, then regex) and only that is exploded; nothing is shuffled.  Rules
    of the same suffixes share one test of the path, and the suffixes of all
    rules together are a filter on the path, which Catalyst moves below the
    generation of lines.  What a rule says is one constant, looked up for hits
    alone.  ``gates`` are conditions of tools that come with the lines.
    """
    line, path = F.col("line"), F.col("path")
    every = {s for r in rules for s in r.suffixes} if all(r.suffixes for r in rules) else set()
    source = lines.where(suffix_condition(path, tuple(sorted(every)))) if every else lines
    hits: dict[tuple[str, ...], list[Column]] = {}
    for k, r in enumerate(rules):
        holds = gates[r.tool] & _cached(r) if gates and r.tool in gates else _cached(r)
        hits.setdefault(r.suffixes, []).append(F.when(holds, F.lit(k)))
    groups = [F.when(suffix_condition(path, suffixes), F.array_compact(F.array(*own))) for suffixes, own in hits.items()]
    every_hit = F.flatten(F.array_compact(F.array(*groups)))
    details = json.dumps([{"tool": r.tool, "rule_seq": r.seq, "issue": r.issue, "severity": r.severity, "category": r.category, "fix": r.fix, "conf": r.conf, "cut": r.cut} for r in rules])
    found = source.withColumn("_low", F.lower("line")).select("file_seq", "path", "line_no", "line", F.explode(every_hit).alias("_k"))
    found = found.withColumn("h", F.get(F.from_json(F.lit(details), _DETAILS), F.col("_k")))
    marker = F.concat(F.regexp_extract(line, r"(?iu)(?:#|//|/\*)\s*(FIXME|HACK|TODO|XXX)", 1), F.lit(" comment"))
    confidence = F.when(F.col("h.conf") == "SCORED", P.line_confidence(line, path)).when(F.col("h.conf") == "TEST_LOW", F.when(P.is_test_path(path), "LOW").otherwise("HIGH")).otherwise(F.col("h.conf"))
    code = F.expr("substring(regexp_replace(line, '^\\\\s+|\\\\s+$', ''), 1, h.cut)")
    return found.select(
        "h.tool", "h.rule_seq", "file_seq", path.alias("file"), F.col("line_no").alias("line"), code.alias("code"), F.when(F.col("h.tool") == "todos", marker).otherwise(F.col("h.issue")).alias("issue"),
        confidence.alias("confidence"), "h.severity", "h.fix", "h.category",
    )


FINDING_COLUMNS = ("tool", "rule_seq", "file_seq", "file", "line", "code", "issue", "confidence", "severity", "fix", "category")


def sql_text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def sql_condition(r: Rule) -> str:
    """The condition in DuckDB's SQL, written independently of the expressions above (no literal test)."""
    m = lambda p, s="line", f="'i'": f"regexp_matches({s}, {sql_text(p)}, {f})"
    parts = [m(r.pattern)]
    if r.suffixes:
        parts.append("(" + " OR ".join(f"ends_with(path, {sql_text(s)})" for s in r.suffixes) + ")")
    if r.after:
        parts.append("NOT " + m(r.after, f"regexp_replace(line, {sql_text('^.*(?:' + r.pattern + ')')}, '', 'i')"))
    if r.other:
        parts.append("NOT " + m(r.other))
    if r.unless:
        parts.append(f"NOT contains(line, {sql_text(r.unless)})")
    if r.guard:
        parts.append(f"regexp_matches(content, {sql_text(r.guard)})")
    table = {
        "comment": f"NOT regexp_matches(line, {sql_text(P.COMMENT)})", "noncode": f"NOT regexp_matches(lower(path), {sql_text(P.DOCUMENT_PATH)})", "test": f"NOT regexp_matches(lower(path), {sql_text(P.TEST_PATH)})",
        "hashslash": "NOT (contains(line, '#') OR contains(line, '*') OR contains(line, '//'))", "rusttest": "NOT (contains(path, '/tests/') OR contains(path, '_test.rs') OR contains(line, '#[test]'))",
        "notest": "NOT contains(lower(path), 'test')", "safetry": f"NOT regexp_matches(line, {sql_text(SAFE_TRY)})",
    }
    return " AND ".join(parts + [table[s] for s in r.skip])


def sql_confidence(r: Rule) -> str:
    test = f"regexp_matches(lower(path), {sql_text(P.TEST_PATH)})"
    if r.conf == "TEST_LOW":
        return f"CASE WHEN {test} THEN 'LOW' ELSE 'HIGH' END"
    if r.conf != "SCORED":
        return sql_text(r.conf)
    ends = lambda *s: "(" + " OR ".join(f"ends_with(lower(path), '.{x}')" for x in s) + ")"
    rx = lambda p: f"regexp_matches(line, {sql_text(p)})"
    constant = f"CASE WHEN {ends('js', 'jsx', 'ts', 'tsx')} THEN {rx(P.CONSTANT['javascript'])} WHEN {ends('py')} THEN {rx(P.CONSTANT['python'])} WHEN {ends('rs')} THEN {rx(P.CONSTANT['rust'])} ELSE {rx(P.CONSTANT['swift'])} END"
    score = f"90 - 30 * {test}::INT - 40 * {rx(P.COMMENT)}::INT - 30 * ({constant})::INT - 25 * {rx(P.IMMUTABLE)}::INT - 35 * {rx(P.COMPILE_TIME)}::INT"
    return f"CASE WHEN {score} >= 80 THEN 'HIGH' WHEN {score} >= 50 THEN 'MEDIUM' WHEN {score} >= 20 THEN 'LOW' ELSE 'FILTERED' END"


def sql_scan(rules: list[Rule], files_sql: str) -> str:
    """All rules over a relation (file_seq, path, content) in DuckDB's SQL."""
    parts = []
    for r in rules:
        issue = "concat(regexp_extract(line, '(?i)(?:#|//|/\\*)\\s*(FIXME|HACK|TODO|XXX)', 1), ' comment')" if r.tool == "todos" else sql_text(r.issue)
        parts.append(f"SELECT {sql_text(r.tool)} AS tool, {r.seq} AS rule_seq, file_seq, path AS file, line_no AS line, substr(regexp_replace(line, '^\\s+|\\s+$', '', 'g'), 1, {r.cut}) AS code, {issue} AS issue, {sql_confidence(r)} AS confidence, {sql_text(r.severity)} AS severity, {sql_text(r.fix)} AS fix, {sql_text(r.category)} AS category FROM lines WHERE {sql_condition(r)}")
    return f"WITH files AS ({files_sql}), lines AS (SELECT file_seq, path, content, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1)::INT AS line_no FROM files) " + " UNION ALL ".join(parts)
