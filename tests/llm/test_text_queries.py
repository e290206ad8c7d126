"""Registered text queries at the smallest scale: against their SQL, else against brute force."""

import brute
import numpy as np
import pytest

from vaportrail.llm.queries import QUERIES
from workload.compare import compare, connect


@pytest.mark.parametrize("name", [n for n, (_, sql) in QUERIES.items() if sql])
def test_matches_sql(spark, sf_dir, name):
    fn, sql = QUERIES[name]
    status, detail = compare(fn(spark, sf_dir), connect(sf_dir), sql)
    assert status in ("exact", "close"), detail


def test_every_operator_is_registered():
    import __spark_entry__ as e

    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(e.queries())


def test_decontaminate(spark, sf_dir, tables):
    docs = [(r.doc_id, r.text) for r in tables("documents").collect()]
    items = [(r.item_id, r.text) for r in tables("benchmark").collect()]
    got = {(r.doc_id, r.item_id): r.similarity for r in QUERIES["op1_decontaminate"][0](spark, sf_dir).collect()}
    assert got == pytest.approx(brute.leaks(docs, items))
    assert got


def test_nearest_recall(spark, sf_dir, tables):
    rows = tables("embeddings").collect()
    ids, vectors = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    got = {}
    for r in QUERIES["op3_nearest"][0](spark, sf_dir).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hits = total = 0
    for q in ids[ids % 20 == 0]:
        scores = vectors @ vectors[ids == q][0]
        scores[ids == q] = -np.inf
        best = ids[np.lexsort((ids, -scores))[:20]]
        mine = sorted(got[q])
        assert [r for r, _, _ in mine] == list(range(1, 21))
        assert [s for _, _, s in mine] == sorted((s for _, _, s in mine), reverse=True)
        hits, total = hits + len(set(best) & {v for _, v, _ in mine}), total + 20
    assert hits >= 0.95 * total


def test_secrets(spark, sf_dir, tables):
    texts = {r.doc_id: r.text for r in tables("documents").collect()}
    got = {r.doc_id: r.spans for r in QUERIES["op4_secrets"][0](spark, sf_dir).collect()}
    assert got == {i: brute.secret_spans(t or "") for i, t in texts.items()}


def test_tokens(spark, sf_dir, tables):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = {r.doc_id: r.text or "" for r in tables("documents").collect()}
    for r in QUERIES["op9_tokens"][0](spark, sf_dir).collect():
        n = len(tokenizer.encode(texts[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 512)


def test_token_files(spark, sf_dir, tables):
    want, start = {}, 0
    for r in tables("documents").orderBy("doc_id").collect():
        ids = brute.token_ids(r.text, end=2)
        want[r.doc_id] = (start, len(ids), brute.ids_crc32(ids))
        start += len(ids)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in QUERIES["op13_token_files"][0](spark, sf_dir).collect()}
    assert got == want


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in QUERIES["op8_toxicity"][0](spark, sf).collect() if r.held_out and r.doc_id in labels]
    right = sum(r.predicted == labels[r.doc_id] for r in rows)
    assert right >= 0.93 * len(rows)
    positive = [r.score for r in rows if labels[r.doc_id]]
    negative = [r.score for r in rows if not labels[r.doc_id]]
    above = sum((p > n) + (p == n) / 2 for p in positive for n in negative)
    assert above >= 0.93 * len(positive) * len(negative)


def test_pipeline(spark, sf_dir, tables):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, sf_dir)
    assert {"doc_id", "text", "source", "epoch", "epoch_words"} <= set(out.columns)
    rows = out.collect()
    assert rows and not any(brute.secret_spans(r.text) for r in rows)
    taken = {r.doc_id for r in rows}
    texts = [(r.doc_id, r.text) for r in tables("documents").collect() if r.doc_id in taken]
    assert len({c for _, c in brute.components(texts, 5).values()}) == len(texts) == len(taken)
