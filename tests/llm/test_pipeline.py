"""The pipeline's stages one after the other, each against brute force on its own input."""

import public_tokenizers as public
from test_duplicates import brute_repeats, grouped, shingle_set
from tokenizers import Tokenizer

import corpus_pipeline as cp


def rows_of(df):
    return {r.doc_id: r for r in df.collect()}


def test_stages(spark, sf):
    documents = spark.read.parquet(f"{sf}/documents.parquet")
    names = [n for n, _ in cp.STAGES]
    assert names == ["language_id", "toxicity", "near_dup", "suffix_dedup", "packing"] and cp.ORACLE_SQL is None
    docs, seen = documents, {}
    for name, stage in cp.STAGES[:-1]:
        docs = cp.stored(stage(spark, docs, sf), "test")
        assert docs.columns == documents.columns
        seen[name] = rows_of(docs)
    given = rows_of(documents)
    # language: the documents are all in learned languages
    assert set(seen["language_id"]) == {i for i, r in given.items() if any(c.isalpha() for c in r.text or "")}
    toxic = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").where("toxic = 0").collect()}
    clean = toxic & set(seen["language_id"])
    assert len(clean & set(seen["toxicity"])) >= 0.9 * len(clean) and all(seen["toxicity"][i] == given[i] for i in seen["toxicity"])
    # near duplicates, from 0.8 up: the smallest id of each group of what came in
    sets = {i: shingle_set(r.text) for i, r in seen["toxicity"].items()}
    ids = sorted(sets)
    edges = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1:]
             if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    assert set(seen["near_dup"]) == {i for i, c in grouped(ids, edges).items() if i == c}
    # repeated passages are cut, nothing else changes
    left = [(i, r.text, None) for i, r in seen["near_dup"].items()]
    for i, *_, kept in brute_repeats(left):
        row = seen["suffix_dedup"][i]
        assert row.text == kept.decode("utf-8", "ignore") and row.n_chars == len(row.text)
    # packing: every token once
    tokenizer = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    lengths = {}
    for r in cp.run(spark, sf).collect():
        lengths[r.doc_id] = lengths.get(r.doc_id, 0) + r.length
    assert lengths == {i: len(tokenizer.encode(r.text, add_special_tokens=False).ids) + 1 for i, r in seen["suffix_dedup"].items()}


def test_no_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("false")
    for _, stage in cp.STAGES:
        docs = cp.stored(stage(spark, docs, sf), "test")
        assert docs.count() == 0
