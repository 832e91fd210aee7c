"""Scans: rule scans, scans that need neighbouring lines, and the batches.

Every scan takes files and returns findings (rules.FINDING_COLUMNS).  Scans of
neighbouring lines work on a file's lines as one row, because their state
resets in ways that no window expresses; suffix and content guards run as
built-in predicates before any Python.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..sources.corpus import lines
from .rules import FINDING_COLUMNS, SANITIZER, TOOLS, Rule, expanded, rule_hits, suffix_condition
from .rulesets import BATCHES

SCHEMA = "tool string, rule_seq int, file_seq long, file string, line int, code string, issue string, confidence string, severity string, fix string, category string"


def rule_scan(files: DataFrame, tool: str, custom: list[tuple[str, str, str]] | None = None, suffix: str | None = None) -> DataFrame:
    """The findings of one rule tool; ``custom`` (pattern, issue, severity) replaces its rules."""
    rules = TOOLS[tool]
    if custom is not None:
        base = rules[0]
        rules = [Rule(tool, k + 1, severity, pattern, issue, base.category, base.fix, base.conf, base.suffixes if tool == "sql_injection" else (), skip=tuple(s for s in base.skip if s in ("comment", "noncode", "hashslash")), cut=base.cut) for k, (pattern, issue, severity) in enumerate(custom)]
    if suffix:
        files = files.where(F.col("path").endswith(suffix))
        rules = [Rule(**{**r.__dict__, "suffixes": ()}) for r in rules] if custom is not None or tool == "command_injection" else rules
    guard = rules[0].guard
    if guard:
        files = files.where(F.col("content").rlike(guard))
    return rule_hits(lines(files), rules)


def rule_scans(files: DataFrame, tools: list[str]) -> DataFrame:
    """Several rule tools in one pass over the lines.

    What a tool asks of a file as a whole (a guard, or for markup sinks where
    sanitisers are) is a column of the file, computed before its lines are
    generated.
    """
    guards = {t: f"_guard{k}" for k, t in enumerate(tools) if TOOLS[t][0].guard}
    kept = files.select("file_seq", "path", "extension", "content", *[(suffix_condition(F.col("path"), TOOLS[t][0].suffixes) & F.col("content").rlike(TOOLS[t][0].guard)).alias(c) for t, c in guards.items()])
    gates = {t: F.col(c) for t, c in guards.items()}
    carried = list(guards.values())
    if "xss_vulnerabilities" in tools:
        kept = kept.withColumn("_safe", _safe_lines())
        gates["xss_vulnerabilities"] = ~F.exists("_safe", lambda k: (k <= F.col("line_no")) & (k >= F.col("line_no") - 5))
        carried.append("_safe")
    hits = rule_hits(lines(kept, carried), [r for t in tools for r in TOOLS[t]], gates)
    return _quiet_sinks(hits) if "xss_vulnerabilities" in tools else hits


def _safe_lines() -> Column:
    """The numbers of the lines that hold a sanitiser, in files that may hold markup sinks."""
    test = "(?iu)" + SANITIZER
    found = F.transform(F.filter(F.transform(F.split("content", "\n", -1), lambda x, k: F.named_struct(F.lit("k"), k + 1, F.lit("safe"), x.rlike(test))), lambda s: s["safe"]), lambda s: s["k"])
    likely = suffix_condition(F.col("path"), TOOLS["xss_vulnerabilities"][0].suffixes) & F.col("content").rlike(test)
    return F.when(likely, found).otherwise(F.array().cast("array<int>"))


def _quiet_sinks(hits: DataFrame) -> DataFrame:
    """Markup sinks with a literal, in a test path or of an empty template are LOW, others HIGH."""
    sink = F.col("tool") == "xss_vulnerabilities"
    quiet = F.col("code").rlike(r"""\.innerHTML\s*=\s*(?:["'][^"']*["']|["']<|["']$|``)""") | P.is_test_path(F.col("file"))
    confidence = F.when(sink, F.when(quiet, "LOW").otherwise("HIGH")).otherwise(F.col("confidence"))
    return hits.withColumn("confidence", confidence).withColumn("issue", F.when(sink & quiet, F.concat("issue", F.lit(" (verify, may be sanitised)"))).otherwise(F.col("issue")))


def xss_vulnerabilities(files: DataFrame) -> DataFrame:
    """Markup sinks without a sanitiser on the line or the five before it.

    A literal, a test path or an empty template lowers the confidence to LOW.
    """
    return rule_scans(files, ["xss_vulnerabilities"])


#: A scan of whole files: which files it wants, and what it finds in one.
Work = Callable[[str, list[str], str], list[tuple]]


def per_file(files: DataFrame, scans: dict[str, tuple[Column, Work]]) -> DataFrame:
    """``work(path, lines, content) -> [(line, code, issue, confidence, severity, fix, category)]`` of several scans, in one Python pass over the files that any of them wants.

    A null content has no finding.
    """
    names = list(scans)
    works = [work for _, work in scans.values()]
    wanted = F.array(*[F.coalesce(where, F.lit(False)) for where, _ in scans.values()])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for seq, path, content, want in zip(batch.file_seq, batch.path, batch.content, batch.wanted):
                cut = content.split("\n")
                for name, work, on in zip(names, works, want):
                    if on:
                        for k, (line, code, *rest) in enumerate(work(path, cut, content)):
                            rows.append((name, k + 1, seq, path, line, code, *rest))
            yield pd.DataFrame(rows, columns=list(FINDING_COLUMNS))

    chosen = files.where(F.col("content").isNotNull()).select("file_seq", "path", "content", wanted.alias("wanted"))
    return chosen.where(F.exists("wanted", lambda x: x)).mapInPandas(run, SCHEMA)


def _ends(*suffixes: str) -> Column:
    return suffix_condition(F.col("path"), suffixes)


def _has(*words: str) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.col("content").contains(w)
    return out


def in_string(line: str, at: int) -> bool:
    """Whether a position lies inside a quoted string; a character after a backslash does not toggle."""
    quote = ""
    for k, c in enumerate(line[:at]):
        if c in "\"'" and not (k and line[k - 1] == "\\"):
            quote = "" if quote == c else quote or c
    return bool(quote)


_TEXT_CALL = re.compile(r"(?i)(?:Text|Label|print|Button|NavigationLink|fatalError|assertionFailure|preconditionFailure|LocalizedStringKey|NSLocalizedString|\.alert|\.navigationTitle|NSLog\s*\(\s*@?|String\s*\(\s*localized:\s*)\s*\(?\s*\"[^\"]*![^\"]*\"")
_UNWRAPS = (
    (re.compile(r"(?i)[a-z_]\w*!(?!=)"), "Value is force-unwrapped", "MEDIUM", False),
    (re.compile(r"(?i)\btry!\s+"), "Forced try", "HIGH", True),
    (re.compile(r"(?i)\bas!\s+"), "Forced cast", "MEDIUM", False),
    (re.compile(expanded(r"(?i):~[a-z][\w<>,\s]*!(?!=)~[={]")), "Implicitly unwrapped type", "LOW", False),
)


def _only_quoted_marks(line: str) -> bool:
    """Whether every '!' is part of a text or of '!='."""
    if _TEXT_CALL.search(line):
        return True
    marks = [k for k, c in enumerate(line) if c == "!"]
    return bool(marks) and all(line[k + 1 : k + 2] == "=" or in_string(line, k) for k in marks)


def _safe_try(line: str) -> bool:
    return (
        "NSRegularExpression" in line or "Regex(" in line or "PropertyListDecoder" in line or "PropertyListEncoder" in line
        or ("JSONDecoder" in line or "JSONEncoder" in line) and ".decode(" in line and ".self" in line
        or line.strip().startswith("static let") and "try!" in line
        or "FileManager" in line and any(w in line for w in ("urls(for:", "containerURL", "documentDirectory"))
        or "Bundle.main" in line and any(w in line for w in ("path(forResource:", "url(forResource:", "bundleIdentifier"))
    )


def _safe_unwrap(line: str) -> bool:
    low = line.lower()
    return (
        "documentsDirectory" in line and ".first!" in line or "bundleIdentifier!" in line or "UIApplication.shared" in line or "fatalError" in line
        or "URL(string:" in line and ("http" in low or '"/' in line)
        or "instantiateViewController" in line and "withIdentifier" in line or "required init" in line and "coder" in low
    )


def score_confidence(**flags: bool) -> str:
    """The confidence of predicates.confidence_of, for Python code."""
    score = 100 + sum(P.WEIGHTS[name] for name, on in flags.items() if on)
    return "HIGH" if score >= 80 else "MEDIUM" if score >= 50 else "LOW" if score >= 20 else "FILTERED"


def dead_regions(rows: list[str]) -> list[tuple[int, int]]:
    """(first, last) line of each '#if false' region, nested ones inside theirs; an open one ends where it starts."""
    out, stack = [], []
    for k, line in enumerate(rows, 1):
        s = line.strip()
        if re.match(r"#if\b", s):
            stack.append((k, bool(re.match(r"#if\s+(?:false|0)\b", s))))
        elif s.startswith("#endif") and stack:
            start, dead = stack.pop()
            if dead:
                out.append((start, k))
    return sorted(out + [(start, start) for start, dead in stack if dead])


def _force_unwraps(path: str, rows: list[str], content: str) -> list[tuple]:
    regions = dead_regions(rows)
    test = bool(re.search(P.TEST_PATH, path.lower()))
    found = []
    for pattern, issue, severity, is_try in _UNWRAPS:
        for k, line in enumerate(rows, 1):
            m = pattern.search(line)
            if not m or re.match(P.COMMENT, line) or in_string(line, m.start()) or _only_quoted_marks(line) or (is_try and _safe_try(line)) or _safe_unwrap(line):
                continue
            name = m.group()[:-1].strip().rsplit(".", 1)[-1] if m.group().endswith("!") else ""
            guard = re.compile(rf"\b(?:if|guard)\s+(?:let\s+{name}\s*=|{name}\s*!=\s*nil|let\s+\w+\s*=\s*{name}\b)") if name.isidentifier() else None
            guarded = bool(guard) and any(guard.search(x) for x in rows[max(0, k - 15) : k - 1])
            constant = bool(re.search(P.CONSTANT["swift"], line))
            conf = score_confidence(dead=any(a <= k <= b for a, b in regions), test=test, pattern_only=True, constant=constant, immutable=bool(re.search(P.IMMUTABLE, line)), compile_time=bool(re.search(P.COMPILE_TIME, line)), semantic=guarded)
            note = " (appears guarded)" * guarded + " (constant)" * constant
            found.append((k, line.strip()[:200], issue + note, conf, severity, "Bind the value or give a default", "force_unwrap"))
    return found


def force_unwraps(files: DataFrame) -> DataFrame:
    return per_file(files, {"force_unwraps": PER_FILE["force_unwraps"]()})


_HOLDERS = tuple(
    (re.compile("(?i)" + expanded(p)), issue, severity)
    for p, issue, severity in (
        (r"\.sink~\{", "Combine sink", "MEDIUM"), (r"\.sink~\(~receiveValue:~\{", "Combine value sink", "MEDIUM"), (r"Timer\.scheduledTimer<h>\{", "Timer closure", "HIGH"),
        (r"Timer\.publish<h>\.sink~\{", "Timer sink", "HIGH"), (r"NotificationCenter<h>addObserver<h>\{", "Notification observer", "HIGH"), (r"\.publisher\(for:<h>\.sink~\{", "Notification sink", "MEDIUM"),
        (r"DispatchQueue\.<h>\.async<h>\{", "Dispatched closure", "LOW"), (r"\.asyncAfter<h>\{", "Delayed closure", "MEDIUM"), (r"URLSession<h>\{", "Network completion", "MEDIUM"),
    )
)


def _weak_self(path: str, rows: list[str], content: str) -> list[tuple]:
    found = []
    for pattern, issue, severity in _HOLDERS:
        for k, line in enumerate(rows):
            if not pattern.search(line) or "[weak self]" in line or "[unowned self]" in line:
                continue
            for later in rows[k + 1 : k + 11]:
                if re.search(r"\bself\.", later):
                    found.append((k + 1, line.strip()[:200], f"{issue} holds self strongly", "HIGH", severity, "Capture self weakly", "weak_self"))
                    break
                if later.strip() == "}":
                    break
    return found


def weak_self_issues(files: DataFrame) -> DataFrame:
    return per_file(files, {"weak_self_issues": PER_FILE["weak_self_issues"]()})


def _cloudkit(path: str, rows: list[str], content: str) -> list[tuple]:
    found, inside, depth = [], False, 0
    for k, line in enumerate(rows, 1):
        s = line.strip()
        if s.startswith("do {"):
            inside, depth = True, 1
        elif inside:
            depth += line.count("{") - line.count("}")
            inside = depth > 0
        if s.startswith(("//", "/*")) or any(w in line for w in ("try await", "try?", "try!", "completionHandler", "completionBlock", "completion:")):
            continue
        low = line.lower()
        if any(w in line for w in (".save(", ".fetch(", ".delete(")) and ("database" in low or "container" in low) and not inside and "await" not in line:
            found.append((k, line.strip()[:200], "Cloud operation without error handling", "LOW", "MEDIUM", "Check the handling of errors", "cloudkit"))
        if "catch" in s and "print(" in s and "CloudKit" in content and "CKError" not in "\n".join(rows[max(0, k - 5) : k + 5]):
            found.append((k, line.strip()[:200], "Catch without cloud error codes", "LOW", "LOW", "Tell the error codes apart", "cloudkit"))
    return found


def cloudkit_issues(files: DataFrame) -> DataFrame:
    return per_file(files, {"cloudkit_issues": PER_FILE["cloudkit_issues"]()})


def _task_cancellation(path: str, rows: list[str], content: str) -> list[tuple]:
    found, start, depth, body = [], 0, 0, []
    for k, line in enumerate(rows, 1):
        if re.search(r"\bTask\s*(?:\.\s*detached\s*)?\{", line.strip()):
            start, depth, body = k, 1, [line]
            continue
        if not start:
            continue
        body.append(line)
        depth += line.count("{") - line.count("}")
        if depth <= 0:
            text, after = "\n".join(body), "\n".join(body[1:])
            long = any(w in text for w in ("await", "for ", "while ", "sleep", "URLSession", "fetch", "load", "download", "upload"))
            if long and not any(w in after for w in ("isCancelled", "checkCancellation", "withTaskCancellationHandler")):
                found.append((start, body[0].strip()[:200], "Task never checks for cancellation", "MEDIUM", "MEDIUM", "Check for cancellation in the loop", "task_cancellation"))
            start, body = 0, []
    return found


def task_cancellation_issues(files: DataFrame) -> DataFrame:
    return per_file(files, {"task_cancellation_issues": PER_FILE["task_cancellation_issues"]()})


def _mainactor(path: str, rows: list[str], content: str) -> list[tuple]:
    found = []
    for k, line in enumerate(rows, 1):
        s = line.strip()
        above = "\n".join(rows[max(0, k - 5) : k])
        if "ObservableObject" in line and "class " in line and "@MainActor" not in above:
            found.append((k, s[:200], "Observable object off the main actor", "MEDIUM", "MEDIUM", "Mark the class with the main actor", "mainactor"))
        if re.search(r"(?i)class\s+\w*ViewModel", line) and "@MainActor" not in above and "ObservableObject" not in above:
            found.append((k, s[:200], "View model off the main actor", "LOW", "LOW", "Mark the class with the main actor", "mainactor"))
        m = re.search(r"@Published\s+var\s+(\w+)", line)
        if not m or "@MainActor" in content:
            continue
        for j, later in enumerate(rows[k:], k + 1):
            if f"{m[1]} =" in later or f"{m[1]}." in later:
                frame = "\n".join(rows[max(0, j - 10) : j])
                if "func " in frame and "async" in frame and "@MainActor" not in frame and "MainActor.run" not in later:
                    found.append((j, later.strip()[:200], f"Published value {m[1]} changed off the main actor", "HIGH", "HIGH", "Change it on the main actor", "mainactor"))
                    break
    return found


def mainactor_issues(files: DataFrame) -> DataFrame:
    return per_file(files, {"mainactor_issues": PER_FILE["mainactor_issues"]()})


_OPENS = re.compile(expanded(r"\(~(?:e|err|error)~(?:\)~=>|,)|=>~\{|function~\("))


def _callback_hell(path: str, rows: list[str], content: str) -> list[tuple]:
    found, depth, start = [], 0, 0
    for k, line in enumerate(rows, 1):
        opened = len(_OPENS.findall(line))
        depth += opened - line.count("});") - line.count("})") - line.count("};")
        if opened and not start:
            start = k
        if depth >= 4:
            found.append((start or k, line.strip()[:150], f"Callbacks nested {depth} deep", "HIGH", "HIGH", "Flatten with async and await", "callback_hell"))
            depth = 0
        if depth <= 0:
            depth, start = 0, 0
    return found


def callback_hell(files: DataFrame) -> DataFrame:
    return per_file(files, {"callback_hell": PER_FILE["callback_hell"]()})


#: Scans of whole files, which share one Python pass: which files each wants, and its work.
PER_FILE: dict[str, Callable[[], tuple[Column, Work]]] = {
    "force_unwraps": lambda: (_ends(".swift") & _has("!"), _force_unwraps),
    "weak_self_issues": lambda: (_ends(".swift") & _has("class ", "actor "), _weak_self),
    "cloudkit_issues": lambda: (_ends(".swift") & _has("CloudKit", "CKRecord"), _cloudkit),
    "task_cancellation_issues": lambda: (_ends(".swift") & _has("Task"), _task_cancellation),
    "mainactor_issues": lambda: (_ends(".swift") & (_has("ObservableObject") | F.lower("content").contains("viewmodel")), _mainactor),
    "callback_hell": lambda: (_ends(".cjs", ".js", ".mjs", ".ts"), _callback_hell),
}


def code_smells(files: DataFrame) -> DataFrame:
    """Magic numbers, deep nesting and long parameter lists, as built-in expressions."""
    allowed = [80, 443, 1000, 1024, 2048, 3000, 4096, 5000, 8000, 8080]
    ls = lines(files)
    code = F.substring(P.stripped(F.col("line")), 1, 100)

    def finding(df: DataFrame, seq: int, issue: Column, conf: str, severity: str, fix: str, category: str, text: Column = code) -> DataFrame:
        return df.select(F.lit("code_smells").alias("tool"), F.lit(seq).alias("rule_seq"), "file_seq", F.col("path").alias("file"), F.col("line_no").alias("line"), text.alias("code"), issue.alias("issue"), F.lit(conf).alias("confidence"), F.lit(severity).alias("severity"), F.lit(fix).alias("fix"), F.lit(category).alias("category"))

    digits = ls.where(~P.is_test_path(F.col("path")) & ~P.is_comment(F.col("line")) & F.col("line").rlike(r"\d{3}"))
    numbers = digits.withColumn("number", F.explode(F.regexp_extract_all("line", F.lit(r"(?<![\w.])([1-9]\d{3,}|[3-9]\d\d)(?![\d.])"), F.lit(1)))).where(~F.col("number").isin(*map(str, allowed)))
    deep = ls.where(F.col("line").rlike(r"^(?:\t{4}|\s{16})\s*\S"))
    heads = files.select("file_seq", "path", F.explode(F.regexp_extract_all("content", F.lit(expanded(r"(def~~<w>~\((?:<p>,){4}<p>\))")), F.lit(1))).alias("head"), "content")
    heads = heads.withColumn("line_no", F.size(F.split(F.expr("substring(content, 1, locate(head, content))"), "\n")))
    return (
        finding(numbers, 1, F.concat(F.lit("Magic number: "), F.col("number")), "LOW", "LOW", "Name the constant", "magic_number")
        .unionByName(finding(deep, 2, F.lit("Nested four levels or more"), "MEDIUM", "MEDIUM", "Move the inner part to a function", "deep_nesting"))
        .unionByName(finding(heads, 3, F.lit("Five parameters or more"), "MEDIUM", "LOW", "Group the parameters", "long_params", F.substring("head", 1, 100)))
    )


def missing_jailbreak_detection(files: DataFrame) -> DataFrame:
    """One row for the corpus if it speaks of money and no Swift file looks for a jailbreak."""
    looks = F.col("path").endswith(".swift") & F.col("content").rlike(r"(?i)/Library/MobileSubstrate|/bin/bash|/usr/sbin/sshd|cydia|jailbr(?:eak|oken)")
    money = F.col("content").rlike(r"(?i)banking|finance|money|payment|transaction|wallet")
    found = files.agg(F.bool_or(looks).alias("looks"), F.bool_or(money).alias("money")).where("money and not looks")
    values = ("missing_jailbreak_detection", 1, None, "(project-wide)", 0, "No jailbreak detection", "Finance app without jailbreak detection", "MEDIUM", "MEDIUM", "Look for common traces", "jailbreak")
    kinds = [x.split()[1] for x in SCHEMA.split(", ")]
    return found.select(*[F.lit(v).cast(k).alias(n) for n, k, v in zip(FINDING_COLUMNS, kinds, values)])


def _structure(name: str) -> Callable[[DataFrame], DataFrame]:
    def scan(files: DataFrame) -> DataFrame:
        from . import structure

        return getattr(structure, name)(files)

    return scan


SCANS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "force_unwraps": force_unwraps, "weak_self_issues": weak_self_issues, "cloudkit_issues": cloudkit_issues, "task_cancellation_issues": task_cancellation_issues, "mainactor_issues": mainactor_issues,
    "callback_hell": callback_hell, "code_smells": code_smells, "missing_jailbreak_detection": missing_jailbreak_detection, "long_functions": _structure("long_functions"), "complex_functions": _structure("complex_functions"),
}


def scan(files: DataFrame, tools: list[str]) -> DataFrame:
    """Any tools by name; rule tools share one pass over the lines, scans of whole files one Python pass."""
    named = list(dict.fromkeys(tools))
    ruled, whole = [t for t in named if t in TOOLS], [t for t in named if t in PER_FILE]
    parts = [rule_scans(files, ruled)] if ruled else []
    parts += [per_file(files, {t: PER_FILE[t]() for t in whole})] if whole else []
    parts += [SCANS[t](files) for t in named if t not in TOOLS and t not in PER_FILE]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def scan_summary(files: DataFrame, tools: list[str], least: str = "MEDIUM") -> DataFrame:
    """(tool, n_found, n_kept) of the tools that a filter by confidence leaves: those with findings at the confidence or above, and those that found nothing to start with."""
    found = scan(files, tools)
    rank = F.greatest(P.rank(F.col("confidence"), P.CONFIDENCE_RANK), F.lit(1))
    counts = found.groupBy("tool").agg(F.count("*").alias("n_found"), F.count_if(rank >= P.CONFIDENCE_RANK[least]).alias("n_kept"))
    names = files.sparkSession.createDataFrame([(t,) for t in dict.fromkeys(tools)], "tool string")
    joined = names.join(counts, "tool", "left").select("tool", F.coalesce("n_found", F.lit(0)).alias("n_found"), F.coalesce("n_kept", F.lit(0)).alias("n_kept"))
    return joined.where("n_kept > 0 or n_found = 0")


def filter_by_confidence(findings: DataFrame, least: str = "MEDIUM") -> DataFrame:
    """FILTERED ranks with LOW."""
    rank = F.greatest(P.rank(F.col("confidence"), P.CONFIDENCE_RANK), F.lit(1))
    return findings.where(rank >= P.CONFIDENCE_RANK[least])


def run_batch(files: DataFrame, batch: str, least: str = "MEDIUM", include_quality: bool = False) -> DataFrame:
    """A batch scan: security, ios, quality, quality_all, web, rust, node, frontend, backend, persistence or all.

    A tool that is a member twice counts twice, as concatenation would.
    """
    tools = BATCHES[batch] + (BATCHES["quality"] if include_quality else [])
    found = scan(files, tools)
    twice = [t for t in dict.fromkeys(tools) if tools.count(t) > 1]
    if twice:
        times = F.when(F.col("tool").isin(*twice), 2).otherwise(1)
        found = found.select("*", F.explode(F.array_repeat(F.lit(0), times)).alias("_copy")).drop("_copy")
    return found if batch == "persistence" else filter_by_confidence(found, least)


def deprecated_apis(files: DataFrame, least_severity: str = "LOW") -> DataFrame:
    keep = P.SEVERITY_RANK.get(least_severity.upper(), 1)
    return rule_hits(lines(files), [r for r in TOOLS["deprecated_apis"] if P.SEVERITY_RANK[r.severity] >= keep])


def find_imports(files: DataFrame, module: str) -> DataFrame:
    """import x, from x and require('x'); a line may give several rows."""
    name = re.escape(module)
    rules = [("import\\s+" + name, "import statement"), ("from\\s+" + name, "from import"), (f"require\\([\"']{name}[\"']", "require call")]
    return rule_hits(lines(files), [Rule("imports", k + 1, "INFO", p, issue, "imports") for k, (p, issue) in enumerate(rules)])


def dead_code_with_next_line(files: DataFrame) -> DataFrame:
    """The dead-code rules and, in addition, code that follows a return or throw at the same depth."""
    from pyspark.sql import Window

    order = Window.partitionBy("file_seq", "path").orderBy("line_no")
    ls = lines(files.where(~P.is_test_path(F.col("path")))).withColumn("_next", F.lead("line").over(order))
    indent = lambda c: F.length(F.regexp_extract(c, r"^(\s*)", 1))
    hit = ls.where(F.col("line").rlike(r"^\s*(?:return|throw|raise)\b[^{(\[]*;?\s*$") & F.col("_next").rlike(r"^\s*[a-zA-Z]") & ~F.col("_next").rlike(r"^\s*(?:case|default|elif|else|except|finally|catch|end)\b") & (indent(F.col("line")) == indent(F.col("_next"))))
    extra = hit.select(F.lit("dead_code").alias("tool"), F.lit(100).alias("rule_seq"), "file_seq", F.col("path").alias("file"), (F.col("line_no") + 1).alias("line"), F.substring(P.stripped(F.col("_next")), 1, 100).alias("code"), F.lit("Code after return or throw").alias("issue"), F.lit("LOW").alias("confidence"), F.lit("MEDIUM").alias("severity"), F.lit("Remove it or put it to use").alias("fix"), F.lit("dead_code").alias("category"))
    return rule_scan(files, "dead_code").unionByName(extra)

