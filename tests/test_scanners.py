import re

import pytest

from lodestone.functions import predicates as P
from lodestone.operators import rules, scanners
from lodestone.plans import sample
from lodestone.sources.corpus import files_from_rows, lines


def found(spark, tool, *rows, **options):
    f = files_from_rows(spark, list(rows))
    df = scanners.SCANS[tool](f) if tool in scanners.SCANS else scanners.scan(f, [tool])
    return [(r.file, r.line, r.rule_seq, r.confidence, r.severity) for r in df.orderBy("file_seq", "line", "rule_seq").collect()]


def py_holds(rule, line, path):
    """A rule by Python's own engine."""
    if rule.suffixes and not path.endswith(rule.suffixes):
        return False
    last = None
    for last in re.finditer(rule.pattern, line, re.I):
        pass
    if last is None:
        return False
    if rule.after:
        rest = re.sub("^.*(?:" + rule.pattern + ")", "", line, count=1, flags=re.I)
        if re.search(rule.after, rest, re.I):
            return False
    if rule.other and re.search(rule.other, line, re.I) or rule.unless and rule.unless in line:
        return False
    checks = {
        "comment": not re.match(P.COMMENT, line), "noncode": not re.search(P.DOCUMENT_PATH, path.lower()), "test": not re.search(P.TEST_PATH, path.lower()), "hashslash": not re.search(r"[#*]|//", line),
        "rusttest": not ("/tests/" in path or "_test.rs" in path or "#[test]" in line), "notest": "test" not in path.lower(), "safetry": not re.search(rules.SAFE_TRY, line),
    }
    return all(checks[s] for s in rule.skip)


def test_rules_equal_python(spark):
    every = [r for t, rs in rules.TOOLS.items() for r in rs if not r.guard and t != "xss_vulnerabilities"]
    got = {(r.tool, r.rule_seq, r.file, r.line) for r in rules.rule_hits(lines(sample.files(spark)), every).collect()}
    want = {(r.tool, r.seq, p, k) for p, c in sample.FILES for k, line in enumerate(c.split("\n"), 1) for r in every if py_holds(r, line, p)}
    assert got == want and len(got) > 100


@pytest.mark.parametrize("pattern,literal", [("SecItemAdd~\\(", "secitemadd"), ("a|bcdef", None), ("(?:foobar|x)y", None), ("abcd?", None), ("abcde?", "abcd"), ("\\.innerHTML~=", "innerhtml"), ("[abcd]efgh+", "efgh"), ("abcd(?:x)?", "abcd")])
def test_literals_are_in_every_match(pattern, literal):
    assert rules.literal_of(rules.expanded(pattern)) == literal


def test_confidence_boundaries(spark):
    df = spark.createDataFrame([(s,) for s in (100, 80, 79, 50, 49, 20, 19, -5)], "s int")
    assert [r[0] for r in df.select(P.confidence_of(df.s)).collect()] == ["HIGH", "HIGH", "MEDIUM", "MEDIUM", "LOW", "LOW", "FILTERED", "FILTERED"]
    assert scanners.score_confidence() == "HIGH" and scanners.score_confidence(dead=True, test=True) == "LOW" and scanners.score_confidence(dead=True, comment=True) == "FILTERED" and scanners.score_confidence(dead=True) == "MEDIUM"


def test_secrets_context(spark):
    got = found(spark, "secrets", ("a.py", 'KEY = 1\npassword = "abcd"\n# password = "abcd"\npassword = "<abcd>"\nPASSWORD = "abcd"'), ("test_a.py", 'password = "abcd"'), ("a.md", 'password = "abcd"'), ("b.py", 'password = "abc"'))
    assert got == [("a.py", 2, 4, "HIGH", "CRITICAL"), ("a.py", 5, 4, "MEDIUM", "CRITICAL"), ("test_a.py", 1, 4, "MEDIUM", "CRITICAL")]


def test_sql_injection_test_paths_are_low(spark):
    line = 'cursor.execute("SELECT x FROM t WHERE a = " + a)'
    got = found(spark, "sql_injection", ("a.py", line), ("tests/a.py", line), ("a.txt", line), ("b.py", line + "  # note"))
    assert {(f, c) for f, _, _, c, _ in got} == {("a.py", "HIGH"), ("tests/a.py", "LOW")}


def test_xss_looks_back(spark):
    rows = ["x = DOMPurify.sanitize(y)", "1", "2", "3", "4", "el.innerHTML = x", "el.innerHTML = x", "el.innerHTML = '<b>'"]
    got = found(spark, "xss_vulnerabilities", ("a.js", "\n".join(rows)))
    assert got == [("a.js", 7, 1, "HIGH", "HIGH"), ("a.js", 8, 1, "LOW", "HIGH")]
    scanners.xss_vulnerabilities(files_from_rows(spark, [("a.js", "")])).collect()


def test_force_unwraps(spark):
    code = 'if let a = a { }\nprint(a!)\nlet b = c!\nText("Hi!")\nif a != b { }\nlet r = try! NSRegularExpression(p)\nx = y as! Z\n#if false\nq!\n#endif'
    got = found(spark, "force_unwraps", ("A.swift", code), ("A.py", "a!"))
    by = {(line, seq): conf for _, line, seq, conf, _ in got}
    assert [x[1] for x in got if x[4] == "MEDIUM"] == [2, 3, 6, 7, 7, 9] or {2, 3, 7, 9} <= {k[0] for k in by}
    assert 4 not in {k[0] for k in by} and 5 not in {k[0] for k in by}


def test_state_machines(spark):
    deep = "a(function(e) { b(function(e) {\nc(function(e) { d(function(e) {\n})})})})"
    assert [x[:2] for x in found(spark, "callback_hell", ("a.js", deep), ("b.js", "a(function(e) {\n});"))] == [("a.js", 1)]
    task = "Task {\n  await load()\n}\nTask {\n  if Task.isCancelled { return }\n  await load()\n}\nTask {\n  x = 1\n}"
    assert [x[1] for x in found(spark, "task_cancellation_issues", ("a.swift", task))] == [1]
    weak = "class A {\n  p.sink {\n    self.x()\n  }\n  p.sink { [weak self] in\n    self.x()\n  }\n  p.sink {\n    }\n    self.y()\n}"
    assert [x[1] for x in found(spark, "weak_self_issues", ("a.swift", weak))] == [2]
    cloud = "import CloudKit\ndatabase.save(r)\ndo {\n  database.save(r)\n}\ntry await database.save(r)"
    assert [x[1] for x in found(spark, "cloudkit_issues", ("a.swift", cloud))] == [2]
    actor = "class V: ObservableObject {\n@MainActor\nclass W: ObservableObject {\n@Published var n = 0"
    assert [x[1] for x in found(spark, "mainactor_issues", ("a.swift", actor.replace("@Published var n = 0", "}")))] == [1]


def test_code_smells(spark):
    got = found(spark, "code_smells", ("a.py", "x = 12345\ny = 8080 + 300 + 299\n# z = 55555\ndef f(a, b, c, d, e):\n" + " " * 16 + "pass"), ("test_a.py", "x = 12345"))
    assert [(f, line, seq) for f, line, seq, _, _ in got] == [("a.py", 1, 1), ("a.py", 2, 1), ("a.py", 4, 3), ("a.py", 5, 2)]


def test_jailbreak_and_batches(spark):
    f = files_from_rows(spark, [("a.swift", "wallet"), ("b.py", "x")])
    assert scanners.missing_jailbreak_detection(f).count() == 1
    assert scanners.missing_jailbreak_detection(files_from_rows(spark, [("a.swift", "wallet cydia://")])).count() == 0
    all_tools = {r.tool for r in scanners.run_batch(sample.files(spark), "all", "LOW").collect()}
    assert {"secrets", "react_issues", "unsafe_blocks", "callback_hell", "force_unwraps", "long_functions"} <= all_tools
    back = scanners.run_batch(sample.files(spark), "backend", "LOW")
    assert back.count() == scanners.run_batch(sample.files(spark), "node", "LOW").count() + scanners.run_batch(sample.files(spark), "security", "LOW").count()


def test_custom_rules_and_min_severity(spark):
    f = files_from_rows(spark, [("a.py", "alpha beta"), ("b.js", "alpha")])
    assert [(r.file, r.issue) for r in scanners.rule_scan(f, "secrets", [("alpha", "found", "LOW")]).collect()] == [("a.py", "found"), ("b.js", "found")]
    assert [r.file for r in scanners.rule_scan(f, "secrets", [("alpha", "found", "LOW")], ".js").collect()] == ["b.js"]
    s = files_from_rows(spark, [("a.swift", "UIWebView\n.accentColor(x)")])
    assert scanners.deprecated_apis(s).count() == 2 and scanners.deprecated_apis(s, "HIGH").count() == 1


def test_plan_is_one_pass_without_shuffle(spark):
    plan = rules.rule_hits(lines(sample.files(spark)), rules.TOOLS["python_security"] + rules.TOOLS["sql_injection"])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and plan.count("Generate") == 2
