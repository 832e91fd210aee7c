import pandas as pd

import corpus_pipeline
from lodestone.llm import decontaminate, mixing, queries, quality_rules, simhash, token_pack
from lodestone.llm.texthash import words
from lodestone.llm.vocabulary import load

from .test_simhash import brute_groups


def test_stages_equal_brute_force(spark):
    path = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{path}/documents.parquet")
    got = corpus_pipeline.run(spark, path).toPandas().set_index("doc_id").sort_index()
    d = docs.toPandas()
    # 1: the rules (themselves tested against a brute force)
    good = quality_rules.judged(docs).toPandas().query("keep").doc_id
    d = d[d.doc_id.isin(good)].sort_values("doc_id")
    # 2: one of each group
    group = brute_groups(d.doc_id.tolist(), d.text.tolist(), simhash.RADIUS)
    d = d[[group.get(i, i) == i for i in d.doc_id]]
    # 3: no benchmark item
    b = pd.read_parquet(f"{path}/benchmark.parquet")
    items = decontaminate.Items(sorted(zip(b.item_id, b.text)))
    leak = [any(decontaminate.least_edits(w, words([t]).hashes.tolist()) <= k for w, k in zip(items.words, items.edits)) for t in d.text]
    d = d[[not x for x in leak]]
    # 4: the schedule in SQL
    import duckdb

    c = duckdb.connect()
    c.register("documents", d)
    d = d[d.doc_id.isin(c.sql(mixing.ORACLE.format(documents="documents")).df().doc_id)]
    # 5: the tokens
    v = load(token_pack.VOCABULARY)
    assert got.index.tolist() == d.doc_id.tolist()
    for (i, r), t in zip(got.iterrows(), d.text):
        assert token_pack.unpack(r.payload, r.bit_width, r.n_tokens).tolist() == v.encode([t])[0], i


def test_stages_keep_the_columns(spark, odd):
    path = "/root/testdata/sf0.001"
    docs = odd
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, path)
        docs = spark.createDataFrame(docs.toPandas(), docs.schema)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == odd.columns
    empty = odd.where("false")
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, path)
        assert empty.count() == 0


def test_ten_queries_are_registered():
    names = sorted(queries.queries())
    assert {n.split("_")[0] for n in names} == {f"op{k}" for k in range(1, 11)} and len(names) == 10
    assert set(queries.oracle_sql()) <= set(names) | set(queries.more_queries())
