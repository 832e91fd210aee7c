import collections
import random

import numpy as np
import pandas as pd
import pytest

from lodestone.llm import decontaminate as dc
from lodestone.llm import substring_dedup as sd
from lodestone.llm.texthash import words


def edit_distance_in(item, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def test_least_edits_is_exact():
    rng = random.Random(1)
    for _ in range(300):
        item = [rng.randrange(6) for _ in range(rng.randint(1, 70))]
        text = [rng.randrange(6) for _ in range(rng.randint(0, 90))]
        assert dc.least_edits(item, text) == edit_distance_in(item, text)


def edited(rng, ws, k, vocabulary):
    ws = list(ws)
    for _ in range(k):
        at, kind = rng.randrange(len(ws)), rng.random()
        if kind < 0.5:
            ws[at] = rng.choice(vocabulary)
        elif kind < 0.75:
            ws.insert(at, rng.choice(vocabulary))
        else:
            del ws[at]
    return ws


@pytest.mark.parametrize("share", [0.0, 0.1, 0.2])
def test_recall_against_brute_force(share):
    rng = random.Random(7)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6))) for _ in range(800)]
    rows = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(3, 60)))) for k in range(60)]
    items = dc.Items(rows)
    texts = [" ".join([rng.choice(vocabulary) for _ in range(rng.randrange(40))] + edited(rng, t.split(), int(share * len(t.split())), vocabulary) + [rng.choice(vocabulary) for _ in range(rng.randrange(40))]) for _, t in rows for _ in range(3)]
    found = words(texts)
    want = set()
    for k, (a, b) in enumerate(zip(found.first, found.first[1:])):
        h = found.hashes[a:b].tolist()
        want |= {(k, j) for j in range(len(rows)) if dc.least_edits(items.words[j], h) <= items.edits[j]}
    got = {(a, b) for a, b, _ in dc.leaks(texts, items)}
    assert got <= want
    assert len(got & want) >= 0.95 * len(want)


def test_tables_reach_the_recall_without_the_run_index():
    """The walk's tables alone, over every window, find what they find behind the run index, at the greatest edit rate."""
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6))) for _ in range(800)]
    rows = [(k, " ".join(rng.choice(vocabulary) for _ in range(n))) for k, n in enumerate([15, 25, 35, 45, 55] * 6)]
    items = dc.Items(rows)
    texts = [" ".join([rng.choice(vocabulary) for _ in range(8)] + edited(rng, t.split(), len(t.split()) // 5, vocabulary) + [rng.choice(vocabulary) for _ in range(8)]) for _, t in rows for _ in range(2)]
    texts += [" ".join(rng.choice(vocabulary) for _ in range(60)) for _ in range(10)]
    found = words(texts)
    want = {(k, j) for k, (a, b) in enumerate(zip(found.first, found.first[1:])) for j in range(len(rows)) if dc.least_edits(items.words[j], found.hashes[a:b].tolist()) <= items.edits[j]}
    alone, indexed = ({(a, b) for a, b, _ in dc.leaks(texts, items, windows)} for windows in (dc.every_window, dc.windows_to_embed))
    assert indexed <= alone <= want and len(want) >= 55
    assert len(alone) >= 0.95 * len(want) and len(indexed) >= 0.95 * len(want)
    # the chance of one table, and so the tables that a recall needs
    agree = []
    for table in range(dc.TABLES):
        one = dc.Items(rows, tables=1)
        one.keys = items.keys[:, table : table + 1]
        real, dc_key = dc.walk_key, lambda h, a, b, n, t, samples=dc.SAMPLES, table=table: real(h, a, b, n, table, samples)
        dc.walk_key = dc_key
        try:
            item, start = dc.candidates(found.hashes, found.first, one, dc.every_window)
        finally:
            dc.walk_key = real
        owner = found.owner()
        agree.append(len({(int(owner[s]), int(i)) for i, s in zip(item, start)} & want) / len(want))
    assert dc.tables_needed(0.9, sum(agree) / len(agree)) <= dc.TABLES


def test_query_equals_brute_force(spark, sf001):
    docs, bench = (spark.read.parquet(f"{sf001}/{t}.parquet") for t in ("documents", "benchmark"))
    got = {tuple(r) for r in dc.contaminated(docs, bench).collect()}
    d, b = docs.toPandas(), bench.toPandas()
    items = dc.Items(sorted(zip(b.item_id, b.text)))
    want = set()
    for i, t in zip(d.doc_id, d.text):
        h = words([t]).hashes.tolist()
        for j, item in enumerate(items.words):
            e = dc.least_edits(item, h)
            if e <= items.edits[j]:
                want.add((i, items.ids[j], len(item), e))
    assert {x[:3] for x in got} <= {x[:3] for x in want}
    assert len({x[:2] for x in got}) >= 0.9 * len(want) and len(want) > 0


def test_passes_give_the_same(spark, sf001):
    docs, bench = (spark.read.parquet(f"{sf001}/{t}.parquet") for t in ("documents", "benchmark"))
    one = {tuple(r) for r in dc.contaminated(docs, bench).collect()}
    assert one == {tuple(r) for r in dc.contaminated(docs, bench, pass_bytes=3000).collect()}


def test_decontamination_of_odd_rows(spark, odd, empty):
    bench = spark.createDataFrame([(1, "quick brown fox jumps over the lazy dog"), (1, "quick brown fox jumps over the lazy dog"), (2, None), (3, ""), (None, "emoji"), (4, "zebra")], "item_id long, text string")
    got = [tuple(r)[:2] for r in dc.contaminated(odd, bench).collect()]
    assert sorted(got) == [(1, 1), (1, 1), (2, 1)]
    kept = dc.drop_contaminated(odd, bench)
    assert kept.columns == odd.columns and kept.count() == odd.count() - 3
    assert dc.contaminated(empty, bench).count() == 0 and dc.contaminated(odd, bench.where("item_id > 99")).count() == 0


def brute_passages(rows, least):
    at = collections.defaultdict(set)
    for d, t in rows:
        w = (t or "").split()
        for i in range(len(w) - least + 1):
            at[tuple(w[i : i + least])].add((d, i))
    starts = collections.defaultdict(set)
    for places in at.values():
        if len(places) > 1:
            for n, (d, i) in enumerate(sorted(places)):
                starts[d, n > 0].add(i)
    out = set()
    for (d, removable), ps in starts.items():
        ps = sorted(ps)
        lo = last = ps[0]
        for p in [*ps[1:], 10**12]:
            if p > last + least:
                out.add((d, lo, last + least, removable))
                lo = p
            last = p
    return out


def test_passages_equal_brute_force(spark, sf001):
    docs = spark.read.parquet(f"{sf001}/documents.parquet")
    d = docs.toPandas()
    got = {tuple(r) for r in sd.repeated_passages(docs).collect()}
    assert got == brute_passages(zip(d.doc_id, d.text), 50) and got


def test_passages_of_random_texts_equal_brute_force(spark):
    rng = random.Random(3)
    passages = [[str(rng.randrange(10**6)) for _ in range(rng.randint(10, 60))] for _ in range(12)]
    rows = []
    for k in range(60):
        t = []
        for _ in range(rng.randint(0, 4)):
            t += [str(rng.randrange(10**6)) for _ in range(rng.randint(0, 30))] + rng.choice(passages)[rng.randrange(5) :]
        rows.append((k, " ".join(t)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    docs = docs.unionByName(docs.limit(9))  # rows that repeat count once
    for least, cover, period in ((20, (0, 1, 3), 7), (14, (0, 1, 3, 9), 13)):
        got = {tuple(r) for r in sd.repeated_passages(docs, least_words=least, cover=cover, period=period).collect()}
        assert got == brute_passages(rows, least) and got


def test_a_passage_of_every_document_is_one_entry_a_gathering(spark):
    rng = np.random.default_rng(8)
    n = 5000
    h, doc, place = np.repeat(rng.integers(0, 2**64, 40, dtype=np.uint64), n), np.tile(np.arange(n), 40), np.repeat(np.arange(40), n)
    gathering = sd.Gathering(10, limit=50_000)
    sent = [*gathering.add(h, doc, place), *gathering.send()]
    entries = sum(len(v.as_py()) // 8 for b in sent for k, v in zip(b.column(0).to_pylist(), b.column(1)) if k >= 0)
    assert entries <= 40 + 200_000 // 50_000 + 1  # not 200,000
    rows = [(k, " ".join(f"x{w}" for w in range(60)) + f" own {k} " + " ".join(f"y{w % 7}" for w in range(k % 50))) for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    whole = {tuple(r) for r in sd.repeated_passages(docs).collect()}
    assert whole == brute_passages(rows, 50) and len({r[0] for r in whole}) == 300


def test_covers():
    assert sd.is_cover(sd.COVER, sd.PERIOD) and sd.is_cover((0, 1, 3), 7) and not sd.is_cover((0, 1, 2), 7)


def test_passages_of_odd_rows(odd, empty):
    got = sd.repeated_passages(odd).toPandas()
    assert set(got.doc_id) == {6}  # one long text that repeats itself
    assert got[got.removable].end_word.max() == 120_000
    assert sd.repeated_passages(empty).count() == 0
    assert isinstance(got, pd.DataFrame) and np.all(got.end_word - got.first_word >= 50)
