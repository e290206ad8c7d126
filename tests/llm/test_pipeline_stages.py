"""Every stage of the pipeline against a plain restatement on that stage's own input, and on rows with awkward ids."""

import brute
import pytest
from pyspark.sql import functions as F

from vaportrail.llm import secrets, sql, toxicity
from vaportrail.session import stage
from workload.compare import connect


@pytest.fixture(scope="module")
def sf_dir():
    """The smallest scale at which every stage has something to do."""
    return "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark, sf_dir):
    return lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")


@pytest.fixture(scope="module")
def inputs(spark, sf_dir):
    """Name -> (input, output) of each stage, as stored tables."""
    import corpus_pipeline

    docs, found = spark.read.parquet(f"{sf_dir}/documents.parquet"), {}
    for name, apply in corpus_pipeline.STAGES:
        out = stage(apply(spark, docs, sf_dir), f"test-{name}")
        found[name] = (docs, out)
        docs = out
    return found


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_toxic_documents_go(spark, inputs, tables):
    docs, out = inputs["toxicity"]
    scored = toxicity.score_texts(docs, toxicity.fit(docs, tables("labels")))
    assert ids(out) == ids(scored.where("predicted = 0")) and out.columns == docs.columns
    assert 0 < out.count() < docs.count()


def test_one_document_of_each_group_stays(inputs):
    docs, out = inputs["near_dedup"]
    groups = {}
    for i, (_, c) in brute.components([(r.doc_id, r.text) for r in docs.collect()], 5).items():
        groups.setdefault(c, set()).add(i)
    kept = set(ids(out))
    assert len(kept) == out.count() == len(groups) and all(len(g & kept) == 1 for g in groups.values())
    assert len(groups) < docs.count() and out.columns == docs.columns


def test_documents_with_passages_go(inputs, tables):
    docs, out = inputs["decontaminate"]
    items = [(r.item_id, r.text) for r in tables("benchmark").collect()]
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    leaked = {i for i, _ in brute.leaks(rows, items)}
    assert ids(out) == sorted(i for i, _ in rows if i not in leaked) and leaked


def test_secrets_are_masked_where_they_stand(inputs):
    docs, out = inputs["secrets"]
    got = {r.doc_id: r for r in out.collect()}
    assert ids(out) == ids(docs)
    rules = secrets.RULES
    masked = 0
    for r in docs.collect():
        spans = sorted((f["start"], f["stop"]) for rule in rules for f in secrets.find_spans(r.text or "", rule))
        joined = []
        for a, b in spans:
            if joined and a < joined[-1][1]:
                joined[-1][1] = max(b, joined[-1][1])
            else:
                joined.append([a, b])
        text, at = "", 0
        for a, b in joined:
            text, at = text + (r.text or "")[at:a] + "[secret]", b
        want = text + (r.text or "")[at:] if joined else r.text
        assert got[r.doc_id].text == want
        assert got[r.doc_id].n_chars == (len(want) if joined else r.n_chars)
        masked += bool(joined)
    assert masked


def test_the_mix_takes_what_its_sql_takes(spark, sf_dir, inputs, tmp_path):
    docs, out = inputs["mix"]
    docs.coalesce(1).write.parquet(str(tmp_path / "documents"))
    con = connect(sf_dir)
    con.execute(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents/*.parquet')")
    cursor = con.execute(sql.MIXTURE)
    names = [d[0] for d in cursor.description]
    want = {r[names.index("doc_id")]: r[names.index("taken")] for r in cursor.fetchall()}
    got = {r.doc_id: r.n for r in out.groupBy("doc_id").agg(F.sum("epoch_words").alias("n")).collect()}
    assert got == {i: n for i, n in want.items() if n}
    assert all(len(brute.words(r.text)) == r.epoch_words for r in out.collect())


def test_rows_with_null_and_repeated_ids_are_judged(spark, sf_dir, tables):
    import corpus_pipeline

    item = tables("benchmark").first().text
    same = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    rows = [(1, same), (1, same), (None, same), (1, "another text with the id of the first row in it"), (None, item), (2, ""), (2, None)]
    docs = spark.createDataFrame([(*r, f"r{i}") for i, r in enumerate(rows)], "doc_id long, text string, row string")
    kept = corpus_pipeline.drop_near_copies(spark, docs, sf_dir)
    assert kept.columns == docs.columns
    left = sorted(r["row"] for r in kept.collect())
    assert left == ["r0", "r3", "r4", "r5", "r6"]
    clean = corpus_pipeline.drop_leaks(spark, docs, sf_dir)
    assert sorted(r["row"] for r in clean.collect()) == ["r0", "r1", "r2", "r3", "r5", "r6"]
