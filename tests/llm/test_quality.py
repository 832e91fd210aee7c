import numpy as np
import pandas as pd

from lodestone.llm import quality_model, quality_rules
from lodestone.llm.vocabulary import load


def brute_measures(text, v):
    ids = v.encode([text or ""])[0]
    n = len(ids)
    p = np.array(list(pd.Series(ids, dtype="int64").value_counts()), float) / max(n, 1)
    h = float(-(p * np.log2(p)).sum()) if n > 1 else 0.0
    return n, len(text or "") / max(n, 1), sum(bool(v.is_byte[k]) for k in ids) / max(n, 1), max(h, 0.0) / np.log2(max(n, 2))


def test_rules_equal_brute_force(spark, sf001):
    docs = spark.read.parquet(f"{sf001}/documents.parquet")
    got = quality_rules.judged(docs, least_docs=10).toPandas().set_index("doc_id").sort_index()
    v = load(quality_rules.VOCABULARY)
    d = docs.toPandas().set_index("doc_id").sort_index()
    m = pd.DataFrame([brute_measures(t, v) for t in d.text], index=d.index, columns=["n", "chars_per_token", "byte_share", "entropy"])
    assert (got.n_tokens == m.n).all()
    for name in quality_rules.BINS:
        assert np.allclose(got[name], m[name])
    m["lang"], m["cls"] = d.lang, np.floor(2 * np.log2(m.n.clip(lower=1))).astype(int)
    want = {k: [] for k in d.index}
    for _, g in m[m.n > 0].groupby(["lang", "cls"]):
        if len(g) < 10:
            continue
        for name, k in sorted(quality_rules.BINS.items()):
            b = np.floor(got.loc[g.index, name] * k + 0.5).astype(int)
            low_median = lambda x: sorted(x)[(len(x) + 1) // 2 - 1]
            mid = low_median(b)
            reach = max(low_median(abs(b - mid)), 1) * 1.4826 * quality_rules.WIDTH
            for i in g.index[(b < mid - reach) | (b > mid + reach)]:
                want[i].append(name)
    assert {i: list(r) for i, r in got.reasons.items()} == want
    assert (got.keep == [not want[i] for i in got.index]).all()


def test_rules_keep_clean_and_reject_junk(spark):
    path = "/root/testdata/sf0.1"
    got = quality_rules.judged(spark.read.parquet(f"{path}/documents.parquet")).toPandas()
    m = got.merge(pd.read_parquet(f"{path}/labels.parquet"), on="doc_id")
    assert m[m.quality == 1].keep.mean() > 0.99
    assert m[m.quality == 0].keep.mean() < 0.35


def test_copies_in_the_majority_reject_no_clean_document(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    before = quality_rules.judged(docs).toPandas()
    size = np.floor(2 * np.log2(before.n_tokens.clip(lower=1)))
    clean = before[before.keep & (before.lang == "en") & (size == 16)].sort_values("entropy")
    copied = docs.where(f"doc_id = {clean.doc_id.iloc[0]}").selectExpr("explode(sequence(10000001L, 10000400L)) AS doc_id", "text", "lang")
    after = quality_rules.judged(docs.unionByName(copied)).toPandas().set_index("doc_id")
    assert after.loc[clean.doc_id].keep.all() and len(clean) > 20
    assert before.set_index("doc_id").keep.equals(after.loc[before.doc_id].keep)


def test_small_classes_are_judged_by_the_nearest(spark, sf001):
    docs = spark.read.parquet(f"{sf001}/documents.parquet").select("doc_id", "text", "lang")
    junk = spark.createDataFrame([(10_000_000, "copper " * 9000, "en"), (10_000_001, "copper " * 9000, "xx")], docs.schema)
    d = docs.unionByName(junk).toPandas()
    got = quality_rules.judged(docs.unionByName(junk)).toPandas().set_index("doc_id").sort_index()
    assert not got.loc[10_000_000].keep and not got.loc[10_000_001].keep
    labels = pd.read_parquet(f"{sf001}/labels.parquet").set_index("doc_id").quality
    kept = got.keep[labels.index]
    assert kept[labels == 1].mean() > 0.95 and not kept[labels == 0].all()
    # brute force over the distinct texts
    got["text"], got["cls"] = d.set_index("doc_id").text, np.floor(2 * np.log2(got.n_tokens.clip(lower=1))).astype(int)
    once = got[got.n_tokens > 0].drop_duplicates(["lang", "text"])
    low_median = lambda x: sorted(x)[(len(x) + 1) // 2 - 1]
    for i, r in got[got.n_tokens > 0].iterrows():
        pool = once[once.lang == r.lang]
        pool = pool if len(pool) >= quality_rules.LEAST_DOCS else once
        away = abs(pool.cls - r.cls)
        far = next(k for k in range(99) if (away <= k).sum() >= quality_rules.LEAST_DOCS)
        want = []
        for name, k in sorted(quality_rules.BINS.items()):
            b = np.floor(pool[name] * k + 0.5)
            x = pool.cls - r.cls
            mid, slope = low_median(b[x == 0]), 0.0
            if far:
                per = pd.DataFrame({"mid": b[x != 0].groupby(x).agg(low_median), "size": b[x != 0].groupby(x).size()})
                slope, mid = np.polyfit(per.index, per.mid, 1, w=np.sqrt(per["size"] * 1.3 ** -abs(per.index))) if len(per) > 1 else (0.0, per.mid.iloc[0])
            off = (abs(b - mid - slope * x) * 2.0 ** (x / 4))[away <= far]
            reach = max(low_median(off), 1) * 1.4826 * quality_rules.WIDTH
            if abs(np.floor(r[name] * k + 0.5) - mid) > reach:
                want.append(name)
        assert list(r.reasons) == want, i


def test_rules_on_odd_rows(odd, empty):
    got = quality_rules.judged(odd).toPandas()
    assert len(got) == odd.count()
    blank = got[got.doc_id.isin([3, 4, 5])]
    assert (blank.n_tokens == 0).sum() >= 2 and not blank[blank.n_tokens == 0].keep.any()
    kept = quality_rules.keep_good(odd)
    assert kept.columns == odd.columns
    assert {r.doc_id for r in kept.select("doc_id").collect()} >= {None, 1, 2, 6, 7, 8, 9}
    assert quality_rules.judged(empty).count() == 0 and quality_rules.keep_good(empty).count() == 0


def test_model_on_held_out_labels(spark):
    path = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{path}/{t}.parquet") for t in ("documents", "labels"))
    got = quality_model.classified(docs, labels.where("doc_id % 2 = 0")).toPandas()
    m = pd.read_parquet(f"{path}/labels.parquet").query("doc_id % 2 == 1").merge(got, on="doc_id", suffixes=("_label", ""))
    y = m.quality_label.to_numpy()
    assert ((m.quality >= 0.5) == (y == 1)).mean() > 0.96
    assert m[y == 1].keep.mean() > 0.98
    p = np.clip(m.quality, 1e-9, 1 - 1e-9)
    assert -(np.where(y == 1, np.log(p), np.log(1 - p))).mean() < 0.12
    # calibration: mean probability near the share of good ones
    assert abs(m.quality.mean() - y.mean()) < 0.03


def test_word_sums_equal_brute_force(spark):
    texts = ["a b c a", None, "", "b a", "long " * 500]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    got = quality_model.word_sums(docs)
    want = np.zeros_like(got)
    from lodestone.llm.texthash import words

    hashes = {w: int(words([w], lower=False).hashes[0]) for w in ("a", "b", "c", "long")}
    row = {w: h >> 48 for w, h in hashes.items()}
    for t in texts:
        ws = (t or "").split()
        for i, w in enumerate(ws):
            want[row[w], -1] += 1
            for j in range(max(0, i - 2), min(len(ws), i + 3)):
                if j != i:
                    for k in range(2):
                        h = hashes[ws[j]] >> (16 * k)
                        want[row[w], h & 31] += -1 if h >> 8 & 1 else 1
    assert (got == want).all()


def test_model_on_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1), (8, 0), (9, 1), (9, 0), (6, None), (None, 1), (77, 0)], "doc_id long, quality int")
    got = quality_model.classified(odd, labels).toPandas()
    assert len(got) == odd.count()
    assert (got[got.doc_id.isin([3, 4, 5])].quality == 0).all()
    none = labels.where("quality > 5")
    assert (quality_model.classified(odd, none).toPandas().query("n_words > 0").quality == 0.5).all()
    assert (quality_model.classified(odd, labels.where("quality = 1")).toPandas().query("n_words > 0").quality == 1.0).all()
    assert quality_model.classified(empty, labels).count() == 0


def test_temperature_calibrates():
    rng = np.random.default_rng(2)
    z = rng.normal(0, 2, 4000)
    y = (rng.random(4000) < 1 / (1 + np.exp(-z))).astype(float)
    assert abs(quality_model.fit_temperature(z * 3, y) - 3) < 0.4
