"""Scalar text, similarity and classification functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip_fences(text: Column) -> Column:
    """Without an opening and a closing code fence line."""
    return F.regexp_replace(F.regexp_replace(text, r"^\s*```[^\n]*\n", ""), r"\n?```\s*$", "")


def compress_whitespace(text: Column) -> Column:
    """At most one blank line in a row, and single spaces within lines."""
    return F.regexp_replace(F.regexp_replace(text, r"[ \t]+", " "), r"\n{3,}", "\n\n")


def estimate_tokens(text: Column) -> Column:
    return F.floor(F.length(text) / 4)


def truncate_to_tokens(text: Column, most: int) -> Column:
    return F.when(F.length(text) > 4 * most, F.substring(text, 1, 4 * most)).otherwise(text)


def truncate_middle(text: Column, most: int) -> Column:
    """The first half and the last quarter of ``most`` characters, if the text is longer."""
    head, tail = most // 2, most // 4
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, head), F.lit("\n[...]\n"), F.right(text, F.lit(tail)))).otherwise(text)


def quoted_strings(text: Column) -> Column:
    """What stands between quotes, of either kind."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit("[\"']([^\"']+)[\"']"), F.lit(1)))


STOP_WORDS = ("a", "all", "an", "and", "any", "are", "be", "code", "find", "for", "from", "how", "in", "is", "it", "of", "on", "or", "show", "that", "the", "this", "to", "what", "where", "which", "with")


def query_keywords(query: Column) -> Column:
    """The distinct words of three letters or more that are not stop words, sorted."""
    words = F.filter(F.split(F.lower(query), r"[^a-z0-9_]+"), lambda w: (F.length(w) >= 3) & ~w.isin(*STOP_WORDS))
    return F.array_sort(F.array_distinct(words))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """0 if the lengths differ or a norm is 0."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norms > 0), dot(a, b) / norms).otherwise(0.0)


def word_set(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Of two word sets; 0 if either has fewer than two words."""
    union = F.size(F.array_union(a, b))
    return F.when((F.size(a) >= 2) & (F.size(b) >= 2), F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def cache_key(query: Column, context: Column) -> Column:
    return F.substring(F.sha2(F.concat(query, F.substring(context, 1, 500)), 256), 1, 16)


#: suffix -> language, for regions and implementation checks.
LANGUAGES = {".py": "python", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".ts": "typescript", ".tsx": "typescript", ".swift": "swift", ".rs": "rust", ".go": "go", ".java": "java", ".c": "c", ".h": "c", ".cpp": "cpp", ".hpp": "cpp", ".m": "objective-c", ".rb": "ruby", ".php": "php"}


def language(extension: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.coalesce(table[extension], F.lit("unknown"))


#: query type -> words that speak for it; the first type with the most words wins.
TYPES = {
    "security": ("security", "vulnerab", "secret", "injection", "xss", "password", "credential", "exploit", "sanitiz"),
    "ios": ("ios", "swift", "swiftui", "xcode", "cloudkit", "keychain", "uikit"),
    "quality": ("quality", "smell", "complex", "refactor", "todo", "long function", "dead code", "maintain"),
    "web": ("react", "vue", "angular", "css", "accessib", "frontend", "dom"),
    "rust": ("rust", "unsafe", "cargo", "clippy", "borrow"),
    "node": ("node", "promise", "callback", "express", "npm", "require("),
    "architecture": ("architecture", "structure", "dependency", "import", "call graph", "module"),
}


def query_type(query: Column) -> Column:
    """The type with the most words in the query, of equals the first; 'general' without any."""
    low = F.lower(query)
    scores = []
    for k, (name, words) in enumerate(TYPES.items()):
        n = F.lit(0)
        for w in words:
            n = n + low.contains(w).cast("int")
        scores.append(F.struct(n.alias("n"), F.lit(-k).alias("order"), F.lit(name).alias("name")))
    best = F.array_max(F.array(*scores))
    return F.when(best["n"] > 0, best["name"]).otherwise("general")


def is_literal_query(query: Column) -> Column:
    """Quoted, and either with a search word or shorter than 15 words; never with a word that asks for analysis."""
    low = F.lower(query)
    quoted = query.rlike("[\"'][^\"']+[\"']")
    analysis = low.rlike(r"\b(?:analy[sz]e|assess|evaluate|explain|how|review|why)\b")
    searching = low.rlike(r"\b(?:contains?|find|grep|locate|look for|search|where is)\b")
    return quoted & ~analysis & (searching | (F.size(F.split(F.trim(query), r"\s+")) < 15))


def is_broad_query(query: Column) -> Column:
    """Begins like a sweeping request, or has at most three words without ':', '-', '(' or ')'."""
    low = F.lower(F.trim(query))
    opening = low.rlike(r"^(?:find|show|list|check|review|scan|audit|analy[sz]e)\s+(?:all|any|every|everything|the (?:code|codebase|project))\b|^(?:find|list) (?:bugs|issues|problems)\b")
    return opening | ((F.size(F.split(low, r"\s+")) <= 3) & ~low.rlike(r"[:()-]"))


def query_mode(query: Column) -> Column:
    """literal; else scanner if broad or up to five words; else semantic if over 15 words, a parenthesis or two commas; else scanner."""
    words = F.size(F.split(F.trim(query), r"\s+"))
    semantic = (words > 15) | query.contains("(") | (F.regexp_count(query, F.lit(",")) >= 2)
    return F.when(is_literal_query(query), "literal").when(is_broad_query(query) | (words <= 5), "scanner").when(semantic, "semantic").otherwise("scanner")


def scan_mode(kind: Column) -> Column:
    """The batch scan of a query type."""
    return F.when(kind.isin("ios", "node", "quality", "rust", "security", "web"), kind).otherwise("all")


def relevance_threshold(query: Column) -> Column:
    """0.15 for broad queries, 0.25 for general ones, else 0.3."""
    return F.when(is_broad_query(query), 0.15).when(query_type(query) == "general", 0.25).otherwise(0.3)


def timeout_seconds(tokens: Column, base: int = 60, per_10k: int = 10, most: int = 600) -> Column:
    return F.least(F.lit(most), base + F.floor(tokens / 10_000).cast("int") * per_10k)
