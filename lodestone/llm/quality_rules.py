"""Quality rules by tokeniser fertility.

A public vocabulary measures each document: characters per token, share of
byte-fallback tokens, and token entropy (of the document's token counts, as a
share of the greatest entropy that its token count allows).  A document is
rejected if a measure lies outside the band of its language and length class.
A band is the median of all distinct texts of the class plus and minus
``width`` normal-scaled median deviations, both read off exact integer
histograms, so they cover the whole corpus and don't depend on partitioning.
However often a text is copied, it counts once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, map_texts, without
from .vocabulary import FOLDER, load

VOCABULARY = "piece_bpe_32k.model"
WIDTH = 5.0
LEAST_DOCS = 30
#: Histogram bins per unit of each measure.
BINS = {"chars_per_token": 100, "byte_share": 1000, "entropy": 200}


def measures(texts: list[str | None], vocabulary) -> dict[str, np.ndarray]:
    """Per text: n_tokens, chars_per_token, byte_share and entropy; zeros for a text without tokens."""
    texts = [t or "" for t in texts]
    coded = vocabulary.encode(texts)
    n = np.fromiter(map(len, coded), np.int64, len(coded))
    chars = np.fromiter(map(len, texts), np.int64, len(texts))
    ids = np.fromiter((k for ids in coded for k in ids), np.int64, int(n.sum()))
    owner = np.repeat(np.arange(len(texts)), n)
    some = np.maximum(n, 1)
    key = owner * vocabulary.size + ids
    key.sort()
    edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    count = np.diff(np.concatenate([edge, [len(key)]]))
    of = key[edge] // vocabulary.size
    sums = np.bincount(of, weights=count * np.log2(count), minlength=len(texts)) if len(edge) else np.zeros(len(texts))
    entropy = np.where(n > 1, np.log2(some) - sums / some, 0.0)
    return {
        "n_tokens": n,
        "chars_per_token": chars / some,
        "byte_share": np.bincount(owner, weights=vocabulary.is_byte[ids], minlength=len(texts)) / some,
        "entropy": np.maximum(entropy, 0.0) / np.log2(np.maximum(n, 2)),
    }


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", vocabulary: str = VOCABULARY, folder: str = FOLDER) -> DataFrame:
    """(doc_id, lang, text_hash, n_tokens, the three measures) for every row; a null language is the language ''."""

    def work(keys: pa.Array, texts: list) -> dict:
        return {"doc_id": keys.field(0), "lang": keys.field(1), "text_hash": keys.field(2)} | measures(texts, load(vocabulary, folder))

    keyed = docs.select(F.struct(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"), F.xxhash64(F.col(text_col).cast("string")).alias("text_hash")).alias("key"), F.col(text_col).alias("text"))
    return map_texts(keyed, "key", "text", work, "doc_id long, lang string, text_hash long, n_tokens long, chars_per_token double, byte_share double, entropy double")


def _binned(m: DataFrame, once: bool) -> DataFrame:
    """One row a document and measure, or with ``once`` a distinct text of a language and measure: lang, length_class, measure, bin."""
    cells = F.array(*[F.struct(F.lit(name).alias("measure"), F.round(F.col(name) * k).cast("long").alias("bin")) for name, k in BINS.items()])
    rows = m.select("lang", length_class(F.col("n_tokens")).alias("length_class"), "text_hash", cells.alias("cells"))
    return (rows.distinct() if once else rows).select("lang", "length_class", F.inline("cells"))


def length_class(n_tokens):
    """Half octaves of the token count."""
    return F.floor(2 * F.log2(F.greatest(n_tokens, F.lit(1)))).cast("int")


def _weighted_median(counts: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """The least value with at least half of the weight ``n`` at or below it."""
    w = Window.partitionBy(*keys)
    run = counts.withColumn("_below", F.sum("n").over(w.orderBy(value))).withColumn("_all", F.sum("n").over(w))
    return run.where("2 * _below >= _all").groupBy(*keys).agg(F.min(value).alias(out), F.first("_all").alias("docs"))


def _trend_bands(counts: DataFrame, width: float, least_docs: int) -> DataFrame:
    """(lang, length_class, measure, low, high) of every class.

    A class of ``least_docs`` texts has its own median and deviations.  A
    smaller one has the value there of a line through the medians of its
    language's other classes (weights: texts, less by 1.3 a class away; not its
    own, which a few texts make), and the median deviation from that line over the nearest classes that hold ``least_docs``
    texts together; classes at one distance come together.  Deviations shrink
    as the root of the token count, by 2 ** 0.25 a class.  A language of fewer
    texts takes the classes of all languages; a corpus of fewer has no band.
    """
    of, at = ["mixed", "pool", "near"], ["lang", "length_class"]
    of_all = counts.groupBy("length_class", "measure", "bin").agg(F.sum("n").alias("n")).select(F.lit(True).alias("mixed"), F.lit("").alias("pool"), F.col("length_class").alias("near"), "measure", "bin", "n")
    pools = checkpoint(counts.select(F.lit(False).alias("mixed"), F.col("lang").alias("pool"), F.col("length_class").alias("near"), "measure", "bin", "n").unionByName(of_all))
    middles = _weighted_median(pools, [*of, "measure"], "bin", "middle")
    sizes = middles.where(F.col("measure") == next(iter(BINS))).select(*of, "docs", F.sum("docs").over(Window.partitionBy("mixed", "pool")).alias("total"))
    own = sizes.where("not mixed").select(F.col("pool").alias("lang"), F.col("near").alias("length_class"), (F.col("total") < least_docs).alias("mixed"))
    own = own.withColumn("pool", F.when(F.col("mixed"), "").otherwise(F.col("lang")))
    pairs = own.join(sizes.where(F.col("total") >= least_docs), ["mixed", "pool"]).withColumn("x", F.col("near") - F.col("length_class"))
    nearer = F.sum("docs").over(Window.partitionBy(*at).orderBy(F.abs("x")).rangeBetween(Window.unboundedPreceding, -1))
    pairs = pairs.withColumn("used", F.coalesce(nearer, F.lit(0)) < least_docs)
    pairs = checkpoint(pairs.withColumn("alone", F.max(F.when(F.col("used"), F.abs("x"))).over(Window.partitionBy(*at)) == 0).drop("docs", "total"))

    w, x, y = F.col("docs") * F.pow(F.lit(1.3), -F.abs("x")), F.col("x"), F.col("middle")
    sums = pairs.where("alone = (x = 0)").join(middles, of).groupBy(*at, "measure").agg(F.sum(w).alias("w"), F.sum(w * x).alias("wx"), F.sum(w * y).alias("wy"), F.sum(w * x * x).alias("wxx"), F.sum(w * x * y).alias("wxy"), F.count("*").alias("k"))
    slope = F.when(F.col("k") > 1, F.expr("(w * wxy - wx * wy) / (w * wxx - wx * wx)")).otherwise(F.lit(0.0))
    line = sums.withColumn("slope", slope).select(*at, "measure", F.round("slope", 6).alias("slope"), F.round(F.expr("(wy - slope * wx) / w"), 6).alias("middle"))
    off = F.round(F.abs(F.col("bin") - F.col("middle") - F.col("slope") * x) * F.pow(F.lit(2.0), x / 4), 6)
    keys = [*at, "measure", "middle"]
    offs = pairs.where("used").join(pools, of).join(line, [*at, "measure"]).withColumn("off", off).groupBy(*keys, "off").agg(F.sum("n").alias("n"))
    return _within(_weighted_median(offs, keys, "off", "spread"), width)


def _within(spread: DataFrame, width: float) -> DataFrame:
    reach = F.greatest("spread", F.lit(1)) * (1.4826 * width)
    return spread.select("lang", "length_class", "measure", (F.col("middle") - reach).alias("low"), (F.col("middle") + reach).alias("high"))


def bands(m: DataFrame, width: float = WIDTH, least_docs: int = LEAST_DOCS, plain: bool = False) -> DataFrame:
    """(lang, length_class, measure, low, high) in bins.

    A text counts once however often it is copied, and a class of fewer than
    ``least_docs`` texts is judged by its neighbours.  With ``plain`` every
    row counts, and such a class has no band.
    """
    keys = ["lang", "length_class", "measure"]
    counts = _binned(m, not plain).groupBy(*keys, "bin").agg(F.count("*").alias("n"))
    if not plain:
        return _trend_bands(counts, width, least_docs)
    middle = _weighted_median(counts, keys, "bin", "middle").where(F.col("docs") >= least_docs).drop("docs")
    off = counts.join(middle, keys).withColumn("off", F.abs(F.col("bin") - F.col("middle"))).groupBy(*keys, "middle", "off").agg(F.sum("n").alias("n"))
    spread = _weighted_median(off, [*keys, "middle"], "off", "spread")
    return _within(spread, width)


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", width: float = WIDTH, least_docs: int | None = None, vocabulary: str = VOCABULARY, folder: str = FOLDER) -> DataFrame:
    """(doc_id, lang, n_tokens, chars_per_token, byte_share, entropy, reasons, keep) for every document.

    ``reasons`` lists the measures outside their band, sorted.  Null or blank
    texts have no token and are rejected as 'empty'; they are left out of the
    bands.  A null language is the language ''.  An empty table gives no row.
    Rows that repeat are judged each on its own.  ``least_docs`` asks for the
    plain bands: over all rows, copies counted each, and none for a class of
    fewer rows.  Otherwise only a corpus of fewer than ``LEAST_DOCS`` distinct
    texts is too small to judge; it is kept.  A very long text is measured
    whole.  Ties in a median take the lesser value.  Columns of other names
    are not read.
    """
    m = checkpoint(measured(docs, id_col, text_col, lang_col, vocabulary, folder))
    low_high = F.map_from_entries(F.collect_list(F.struct("measure", F.struct("low", "high"))))
    by_class = bands(m.where("n_tokens > 0"), width, LEAST_DOCS if least_docs is None else least_docs, least_docs is not None).groupBy("lang", "length_class").agg(low_high.alias("band"))
    at = {name: F.round(F.col(name) * k) for name, k in BINS.items()}
    outside = [F.when((at[x] < F.col("band")[x]["low"]) | (at[x] > F.col("band")[x]["high"]), F.lit(x)) for x in sorted(BINS)]
    reasons = F.when(F.col("n_tokens") == 0, F.array(F.lit("empty"))).otherwise(F.array_compact(F.array(*outside)))
    joined = m.withColumn("length_class", length_class(F.col("n_tokens"))).join(by_class, ["lang", "length_class"], "left")
    return joined.withColumn("reasons", reasons).select("doc_id", "lang", "n_tokens", "chars_per_token", "byte_share", "entropy", "reasons", (F.size("reasons") == 0).alias("keep"))


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> DataFrame:
    """The documents not rejected, with the columns that came.

    Rows that share an id stay or go together (they go if one is rejected);
    rows without an id stay.
    """
    return without(docs, id_col, judged(docs, id_col, text_col, lang_col, **options).where(~F.col("keep")).select("doc_id"))
