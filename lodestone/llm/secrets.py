"""Secret scan with corpus-wide ownership frequency.

Candidates are matched in every text and hashed; the hashes are counted over
the corpus by distinct documents, repositories and owners.  A value that many
owners hold is a copied example; one that a single owner holds, and whose
characters have the entropy of a random key, is likely live.  All of it is
built-in functions; the texts are scanned once, and only hashes are shuffled,
kept or returned.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint

#: kind -> pattern whose group 1 is the value.  Written for both Java and RE2: no look-around, no \\b.
KINDS = {
    "assignment": r"""(?i)(?:^|[^a-z0-9])(?:api[_-]?key|access[_-]?key|auth[_-]?token|token|secret|passw(?:or)?d)["']?[ \t]*(?::|=|=>)[ \t]*["']([^ \t\r\n"']{8,})["']""",
    "aws_key_id": r"(?:^|[^A-Za-z0-9_])((?:AKIA|ASIA)[0-9A-Z]{16})(?:[^A-Za-z0-9_]|$)",
    "bearer": r"(?:^|[^A-Za-z0-9_])Bearer[ \t]+([A-Za-z0-9._~+/-]{20,}=*)",
    "code_host_token": r"(?:^|[^A-Za-z0-9_])((?:ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9]{36})(?:[^A-Za-z0-9_]|$)",
    "private_key": r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----([A-Za-z0-9+/= \t\r\n]+)-----END",
    "service_key": r"(?:^|[^A-Za-z0-9_])((?:sk|pk|rk)[-_](?:live[-_]|test[-_]|proj-)?[A-Za-z0-9]{20,})(?:[^A-Za-z0-9_]|$)",
}
#: What the patterns consume at either side of a token, and the same without consuming it.
_EDGES = {"(?:^|[^A-Za-z0-9_])": "(?<![A-Za-z0-9_])", "(?:^|[^a-z0-9])": "(?<![a-z0-9])", "(?:[^A-Za-z0-9_]|$)": "(?![A-Za-z0-9_])"}
PLACEHOLDER = r"(?i)(?:example|change_?me|placeholder|dummy|sample|your[_-]|redacted|x{6,}|\*{4,}|<[a-z_ -]+>|^\$|^\{|0123456789|12345678|abcdefgh)"
LEAST_DISTINCT = 8
#: Bits a character; random keys have more, most words and repeated groups less.
LEAST_ENTROPY = 3.0
WIDE_OWNERS = 3


def beside(pattern: str) -> str:
    """The pattern in Java's syntax with edges that consume nothing, so that tokens one separator apart are all found.

    RE2 has no look-around: the SQL twin doubles the separators instead (see ``doubled``).
    """
    for consumed, kept in _EDGES.items():
        pattern = pattern.replace(consumed, kept)
    return pattern


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repository=None) -> DataFrame:
    """(doc_id, owner, repository, kind, value): one row an occurrence; null texts have none, null owners are ''."""
    text = F.col(text_col)

    def of(kind: str, pattern: str):
        return F.transform(F.regexp_extract_all(text, F.lit(beside(pattern)), F.lit(1)), lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))

    found = [of(k, p) for k, p in sorted(KINDS.items())]
    owner = F.coalesce(F.col(owner_col).cast("string"), F.lit(""))
    likely = text.rlike(r"(?i)token|secret|passw|key|bearer|akia|asia|gh[pousr]_|[spr]k[-_]")
    return (
        docs.where(likely)
        .select(F.col(id_col).alias("doc_id"), owner.alias("owner"), (owner if repository is None else repository).alias("repository"), F.explode(F.concat(*found)).alias("hit"))
        .select("doc_id", "owner", "repository", "hit.kind", "hit.value")
    )


def entropy(value):
    """Bits a character of a text, by its characters' frequencies; rounded, so that the order of adding doesn't tell."""
    characters = F.regexp_extract_all(value, F.lit("(?s)(.)"), F.lit(1))
    n = F.size(characters).cast("double")

    def term(c):
        k = F.size(F.filter(characters, lambda x: x == c)).cast("double")
        return -(k / n) * F.log2(k / n)

    return F.round(F.aggregate(F.transform(F.array_distinct(characters), term), F.lit(0.0), lambda a, b: a + b), 6)


def owned_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repository=None, wide_owners: int = WIDE_OWNERS) -> DataFrame:
    """(doc_id, kind, candidate_hash, length, occurrences, n_docs, n_repositories, n_owners, verdict), one row a document and candidate.

    verdict: 'placeholder' (says so, or has fewer than 8 distinct characters),
    else 'widely_copied' (``wide_owners`` owners or more), else 'low_entropy'
    (under 3 bits a character, as words and repeated groups have), else
    'owner_specific' (one owner), else 'shared'.  ``repository`` is a column;
    without it the owner is its own only repository.

    Null texts have no candidate, nor have empty ones; a very long text is
    scanned whole.  A null owner is the owner ''.  Rows that repeat add to the
    occurrences and to no other count; a null id counts as no document.
    Columns of other names are not read.  An empty table gives no row.
    """
    c = candidates(docs, id_col, text_col, owner_col, repository)
    fake = F.col("value").rlike(PLACEHOLDER) | (F.size(F.array_distinct(F.regexp_extract_all("value", F.lit("(?s)(.)"), F.lit(1)))) < LEAST_DISTINCT)
    hits = c.select("doc_id", "owner", "repository", "kind", F.sha2("value", 256).alias("candidate_hash"), F.length("value").alias("length"), fake.alias("fake"), (entropy("value") < LEAST_ENTROPY).alias("plain"))
    per_doc = checkpoint(hits.groupBy("candidate_hash", "doc_id", "kind", "owner", "repository", "length", "fake", "plain").agg(F.count("*").alias("occurrences")))
    spread = per_doc.groupBy("candidate_hash").agg(F.count_distinct("doc_id").alias("n_docs"), F.count_distinct("repository").alias("n_repositories"), F.count_distinct("owner").alias("n_owners"))
    verdict = F.when(F.col("fake"), "placeholder").when(F.col("n_owners") >= wide_owners, "widely_copied").when(F.col("plain"), "low_entropy").when(F.col("n_owners") == 1, "owner_specific").otherwise("shared")
    return per_doc.join(spread, "candidate_hash").select("doc_id", "kind", "candidate_hash", F.col("length").cast("long").alias("length"), "occurrences", "n_docs", "n_repositories", "n_owners", verdict.alias("verdict"))


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def doubled(kind: str, pattern: str) -> str:
    """SQL for the values of a kind, neighbours of one separator included.

    Every character that can stand between two tokens is doubled, so that each
    token has an edge of its own to consume; the pattern asks for double ones
    inside a token, and the values are halved again.
    """
    if kind == "assignment":
        text = r"""regexp_replace(text, '(["''])', '\1\1', 'g')"""
        pattern = pattern.replace("""["']?[ ""","""(?:""|'')?[ """).replace("""["']([""","""(?:""|'')([""")
    elif kind == "service_key":
        text = r"regexp_replace(text, '([^A-Za-z0-9_])', '\1\1', 'g')"
        pattern = pattern.replace("[-_](?:live[-_]|test[-_]|proj-)", "(?:--|_)(?:live(?:--|_)|test(?:--|_)|proj--)")
    elif kind in ("aws_key_id", "code_host_token"):
        text = r"regexp_replace(text, '([^A-Za-z0-9_])', '\1\1', 'g')"
    else:
        return f"unnest(regexp_extract_all(text, {_quoted(pattern)}, 1))"
    return f"replace(unnest(regexp_extract_all({text}, {_quoted(pattern)}, 1)), '--', '-')" if kind == "service_key" else f"unnest(regexp_extract_all({text}, {_quoted(pattern)}, 1))"


ORACLE = f"""
WITH found AS ({" UNION ALL ".join(f"SELECT doc_id, coalesce(source, '') AS owner, concat(coalesce(source, ''), '/', coalesce(lang, '')) AS repository, {_quoted(k)} AS kind, {doubled(k, p)} AS value FROM documents" for k, p in sorted(KINDS.items()))}),
hits AS (SELECT doc_id, owner, repository, kind, sha256(value) AS candidate_hash, length(value) AS length,
  regexp_matches(value, {_quoted(PLACEHOLDER)}) OR len(list_distinct(string_split(value, ''))) < {LEAST_DISTINCT} AS fake, round(list_aggregate(string_split(value, ''), 'entropy'), 6) < {LEAST_ENTROPY} AS plain FROM found),
per_doc AS (SELECT candidate_hash, doc_id, kind, owner, repository, length, fake, plain, count(*) AS occurrences FROM hits GROUP BY ALL),
spread AS (SELECT candidate_hash, count(DISTINCT doc_id) AS n_docs, count(DISTINCT repository) AS n_repositories, count(DISTINCT owner) AS n_owners FROM per_doc GROUP BY 1)
SELECT doc_id, kind, candidate_hash, length, occurrences, n_docs, n_repositories, n_owners,
  CASE WHEN fake THEN 'placeholder' WHEN n_owners >= {WIDE_OWNERS} THEN 'widely_copied' WHEN plain THEN 'low_entropy' WHEN n_owners = 1 THEN 'owner_specific' ELSE 'shared' END AS verdict
FROM per_doc JOIN spread USING (candidate_hash)
"""
