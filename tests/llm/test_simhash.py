import random

import numpy as np
import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import simhash
from lodestone.llm.components import components
from lodestone.llm.texthash import Windows, window_starts, words


def brute_groups(ids, texts, radius):
    fp, has = simhash.fingerprints(texts)
    parent = {i: i for i, h in zip(ids, has) if h}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    rows = [(i, f) for i, f, h in zip(ids, fp, has) if h]
    for a in range(len(rows)):
        d = np.bitwise_count(np.array([f for _, f in rows[a + 1 :]], np.uint64).reshape(-1, 2) ^ rows[a][1]).sum(axis=1)
        for b in np.flatnonzero(d <= radius):
            x, y = find(rows[a][0]), find(rows[a + 1 + b][0])
            parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in parent}


def test_groups_equal_brute_force_on_the_corpus(spark, sf001):
    docs = spark.read.parquet(f"{sf001}/documents.parquet")
    got = simhash.near_duplicates(docs).toPandas()
    d = docs.toPandas().sort_values("doc_id")
    want = brute_groups(d.doc_id.tolist(), d.text.tolist(), simhash.RADIUS)
    assert dict(zip(got.doc_id, got.group_id)) == {i: want.get(i, i) for i in d.doc_id}
    assert (got.kept == (got.doc_id == got.group_id)).all()


def test_every_number_of_agreeing_blocks_gives_the_same(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, (40, 2), dtype=np.int64)
    rows = [(k, int(a), int(b)) for k, (a, b) in enumerate(base)]
    for k in range(200):  # flip up to 22 bits
        a, b = base[rng.integers(40)]
        for bit in rng.choice(128, rng.integers(0, 23), replace=False):
            if bit < 64:
                a ^= np.int64(np.uint64(1 << int(bit)).view(np.int64))
            else:
                b ^= np.int64(np.uint64(1 << int(bit - 64)).view(np.int64))
        rows.append((100 + k, int(a), int(b)))
    df = spark.createDataFrame(rows, "id long, hi long, lo long")
    results = []
    for agree in (1, 2, 3):
        r = components(simhash.near_edges(df, simhash.RADIUS, agree), "a", "b").toPandas()
        results.append(dict(zip(r.node, r.root)))
    fp = np.array([r[1:] for r in rows], np.int64).view(np.uint64)
    pairs = [(rows[i][0], rows[j][0]) for i in range(len(rows)) for j in range(i) if np.bitwise_count(fp[i] ^ fp[j]).sum() <= simhash.RADIUS]
    want = components(spark.createDataFrame(pairs, "a long, b long"), "a", "b").toPandas()
    assert results[0] == results[1] == results[2] == dict(zip(want.node, want.root))


def test_edited_copies_are_caught_and_others_left(spark):
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    texts = [[rng.choice(vocabulary) for _ in range(200)] for _ in range(60)]
    rows = [(k, " ".join(t)) for k, t in enumerate(texts)]
    for k in range(30):
        t = list(texts[k])
        for _ in range(6):
            t[rng.randrange(len(t))] = rng.choice(vocabulary)
        rows.append((1000 + k, " ".join(t)))
        rows.append((2000 + k, rows[k][1]))
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).toPandas().set_index("doc_id").group_id
    assert all(got[2000 + k] == k for k in range(30))
    assert sum(got[1000 + k] == k for k in range(30)) >= 29
    assert all(got[k] == k for k in range(60))


def test_odd_rows(odd, empty):
    got = simhash.near_duplicates(odd).toPandas()
    assert len(got) == odd.count()
    by = got.dropna(subset=["doc_id"]).drop_duplicates("doc_id").set_index("doc_id")
    assert by.group_id[2] == 1 and not by.kept[2]
    assert all(by.group_id[k] == k and by.kept[k] for k in (1, 3, 4, 5, 6, 7, 8, 9))
    assert got[got.doc_id.isna()].kept.all()
    kept = simhash.drop_near_duplicates(odd)
    assert kept.columns == odd.columns and kept.count() == odd.count() - 1
    assert simhash.near_duplicates(empty).count() == 0 and simhash.drop_near_duplicates(empty).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab \n\tcé😀", max_size=40), max_size=6), st.integers(1, 4))
def test_words_and_windows_are_those_of_split(texts, width):
    found = words(texts)
    want = [t.lower().split() for t in texts]
    assert np.diff(found.first).tolist() == [len(w) for w in want] if texts else len(found.hashes) == 0
    seen = {}
    for h, w in zip(found.hashes.tolist(), [x for t in want for x in t]):
        assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)
    at = window_starts(found.first, width)
    grams = [tuple(w[i : i + width]) for w in want for i in range(len(w) - width + 1)]
    assert len(at) == len(grams)
    table = {}
    for g, h in zip(grams, Windows(found.hashes).at(at, width).tolist()):
        assert table.setdefault(g, h) == h
    assert len(set(table.values())) == len(table)


def test_tiles_skip_nothing_within_the_radius():
    rng = np.random.default_rng(1)
    fp = rng.integers(0, 2**64, (300, 2), dtype=np.uint64)
    fp[150:] = fp[:150] ^ (np.uint64(1) << rng.integers(0, 64, (150, 1)).astype(np.uint64))
    got = {tuple(sorted(p)) for x, y in simhash.tile_pairs(fp, 5, tile=32) for p in zip(x.tolist(), y.tolist())}
    d = np.bitwise_count(fp[:, None] ^ fp[None]).sum(axis=2)
    assert got == {(i, j) for i in range(300) for j in range(i + 1, 300) if d[i, j] <= 5}


def test_components_of_chains(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 105), (105, 103), (7, 7), (None, 3)]
    got = components(spark.createDataFrame(edges, "a long, b long"), "a", "b").toPandas()
    assert dict(zip(got.node, got.root)) == {k: 0 for k in range(1, 41)} | {105: 100, 103: 100}
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0
    assert isinstance(got, pd.DataFrame)


def test_blocks_are_bits_of_the_fingerprint():
    rng = np.random.default_rng(6)
    fp = rng.integers(0, 2**64, (50, 2), dtype=np.uint64)
    for n in (21, 22, 24):
        blocks = simhash.block_bounds(n)
        values = simhash.block_values(fp, blocks)
        for (first, width), row in zip(blocks, values):
            assert row.tolist() == [((int(b) << 64 | int(a)) >> first) & ((1 << width) - 1) for a, b in fp]
    assert [simhash.choose_agree(n, 20) for n in (100, 10**5, 10**7, 10**9)] == sorted(simhash.choose_agree(n, 20) for n in (100, 10**5, 10**7, 10**9))


def test_a_cluster_of_thousands_of_near_copies_is_one_star():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**64, 2, dtype=np.uint64)
    fp = np.repeat(base[None], 4000, 0)
    for k in range(3):
        fp[np.arange(4000), k % 2] ^= np.uint64(1) << rng.integers(0, 64, 4000).astype(np.uint64)
    ids = rng.permutation(4000)
    a, b = simhash.bucket_edges(ids, fp, 0, 20, 1)
    assert len(a) == 3999 and len(set(b.tolist())) == 1 and set(a.tolist()) | set(b.tolist()) == set(range(4000))
