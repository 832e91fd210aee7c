"""Line and path predicates, and the confidence score, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CONFIDENCE_RANK = {"FILTERED": 0, "LOW": 1, "MEDIUM": 2, "HIGH": 3}
SEVERITY_RANK = {"INFO": 0, "LOW": 1, "MEDIUM": 2, "HIGH": 3, "CRITICAL": 4}

COMMENT = r"^\s*(?:#|//|/\*|\*)"
TEST_PATH = r"test|spec|mock|fixture"
DOCUMENT_PATH = r"\.(?:adoc|htm|html|markdown|md|rst|txt)$|(?:^|/)license$"

_SWIFT = r"^\s*(?:(?:fileprivate|private)\s+)?let\s+\w+\s*[=:]|^\s*(?:fileprivate|private)\s+let\s+\w|^\s*static\s+let\s+\w|Bundle\.main\.|FileManager\.default\.urls|UIApplication\.shared\.|ProcessInfo\.processInfo\."
#: language -> what marks a constant declaration; unknown suffixes count as Swift.
CONSTANT = {
    "swift": _SWIFT,
    "javascript": r"^\s*const\s+\w+\s*=|^\s*readonly\s+\w|Object\.(?:freeze|seal)\(",
    "python": r"@final|Final\[|(?:frozenset|tuple)\(|^\s*[A-Z][A-Z\d_]+\s*=",
    "rust": r"^\s*(?:const|static)\s+\w|Lazy<",
}
IMMUTABLE = r"(?:const|let)\s+\w+\s*=\s*\[|(?:frozenset|tuple)\s*\(|Object\.freeze\s*\(\s*\[|readonly\s+\w+\s*:\s*\["
COMPILE_TIME = r"Bundle\.main|Bundle\(for:|FileManager\.default\.urls\(|UIScreen\.main|UIDevice\.current|ProcessInfo\.processInfo|NSLocale\.current|TimeZone\.current|process\.env\.|__dirname|__filename|import\.meta\."


def is_comment(line: Column) -> Column:
    """Starts like a comment in any language, so Swift's #if and Rust's #[...] count too."""
    return line.rlike(COMMENT)


def is_test_path(path: Column) -> Column:
    return F.lower(path).rlike(TEST_PATH)


def is_code_path(path: Column) -> Column:
    return ~F.lower(path).rlike(DOCUMENT_PATH)


def is_constant(line: Column, path: Column) -> Column:
    suffix = F.lower(F.regexp_extract(path, r"\.([^.]*)$", 1))
    return (
        F.when(suffix.isin("js", "jsx", "ts", "tsx"), line.rlike(CONSTANT["javascript"]))
        .when(suffix == "py", line.rlike(CONSTANT["python"]))
        .when(suffix == "rs", line.rlike(CONSTANT["rust"]))
        .otherwise(line.rlike(CONSTANT["swift"]))
    )


#: What each observation adds to a score that starts at 100.
WEIGHTS = {"dead": -50, "test": -30, "unverified": -20, "comment": -40, "pattern_only": -10, "constant": -30, "immutable": -25, "compile_time": -35, "semantic": 20, "several": 15}


def confidence_score(**flags: Column) -> Column:
    """100 and the weights of the given flags that are true."""
    score = F.lit(100)
    for name, flag in flags.items():
        score = score + F.when(flag, WEIGHTS[name]).otherwise(0)
    return score


def confidence_of(score: Column) -> Column:
    """80, 50 and 20 are the least scores of HIGH, MEDIUM and LOW; below is FILTERED."""
    return F.when(score >= 80, "HIGH").when(score >= 50, "MEDIUM").when(score >= 20, "LOW").otherwise("FILTERED")


def line_confidence(line: Column, path: Column, **more: Column) -> Column:
    """The confidence of a bare pattern match, lowered by what the line and path tell."""
    flags = dict(test=is_test_path(path), comment=is_comment(line), pattern_only=F.lit(True), constant=is_constant(line, path), immutable=line.rlike(IMMUTABLE), compile_time=line.rlike(COMPILE_TIME))
    return confidence_of(confidence_score(**flags, **more))


def rank(column: Column, ranks: dict[str, int]) -> Column:
    out = F.lit(-1)
    for name, value in ranks.items():
        out = F.when(column == name, value).otherwise(out)
    return out


def stripped(line: Column) -> Column:
    """Without white space at the ends (tabs too, which trim() would leave)."""
    return F.regexp_replace(line, r"^\s+|\s+$", "")
