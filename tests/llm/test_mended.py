"""Cards beside other numbers, rule versions on a kept ledger, maximal segments, and blocks of the nearest search."""

import time
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from vaportrail.llm import nearest, pii, secrets, toxicity
from vaportrail.llm.words import ROWS, in_slices


def luhn(number):
    digits = [int(c) for c in number]
    return sum(digits[-1::-2]) % 10 + sum(sum(divmod(2 * d, 10)) for d in digits[-2::-2]) % 10 in (0, 10)


CARD = "4111 1111 1111 1111"
BESIDE = [
    "card {} 123",
    "ref 7 {}",
    "{} 04/29",
    "12 34 56 78 {} 01",
    "{} {}",
    "id 2020 {} 7",
    "{}-123",
    "a {}, then 2020-01-02",
    "{} 99 88 {} 5 {}",
    "1 22 333 4444 {} 4444 333 22 1",
    "tel 555-123-4567 {}",
]


@pytest.mark.parametrize("form", BESIDE)
def test_cards_beside_other_numbers(spark, form):
    df = spark.createDataFrame([(1, form.replace("{}", CARD))], "doc_id long, text string")
    text = pii.pseudonymise(df, key="k").first().text
    before, _, after = form.partition("{}")
    assert CARD not in text and "4111111111111111" not in text.replace(" ", "")
    assert len(text) == len(form.replace("{}", CARD))
    if "{}" not in after and "-" not in form:
        said = text[len(before) : len(before) + len(CARD)]
        assert text.startswith(before) and text.endswith(after.replace("{}", CARD)) and luhn(said.replace(" ", ""))


def test_equal_cards_stay_equal_beside_numbers(spark):
    rows = [(1, f"pay {CARD} now"), (2, f"card {CARD} 123"), (3, "pay 4111111111111111 now")]
    got = {r.doc_id: r.text for r in pii.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string"), key="k").collect()}
    assert got[1][4:23] == got[2][5:24] and got[1][4:23].replace(" ", "") == got[3][4:20]
    numbers = spark.createDataFrame([(1, "no card 4111 1111 1111 1112 123 or 0000 0000 0000 0000")], "doc_id long, text string")
    assert pii.pseudonymise(numbers, key="k").first().text == "no card 4111 1111 1111 1112 123 or 0000 0000 0000 0000"


def test_findings_of_replaced_rule_versions_do_not_come_back(spark, tmp_path):
    docs = spark.createDataFrame([(1, "k=aaaa k=bbbbbb"), (2, "nothing")], "doc_id long, text string")
    ledger = str(tmp_path / "ledger")
    old, new = secrets.Rule("k", 1, r"k=[a-z]+", 0, 1), secrets.Rule("k", 2, r"k=[a-z]{5,}", 0, 1)

    def spans(rules, rows=docs):
        found = secrets.scan_versions(rows, ledger=ledger, rules=rules)
        return {r.doc_id: [(f.start, f.kind, f.stop) for f in r.findings] for r in found.collect()}

    first = {1: [(0, "k", 6), (7, "k", 15)], 2: []}
    assert spans([old]) == first
    assert spans([new]) == {1: [(7, "k", 15)], 2: []}
    assert spans([old]) == first
    # a second instalment: the new path of a known text and a new text meet one ledger
    more = spark.createDataFrame([(3, "k=aaaa k=bbbbbb"), (4, "x k=ccccc")], "doc_id long, text string")
    assert spans([new], docs.unionByName(more)) == {1: [(7, "k", 15)], 2: [], 3: [(7, "k", 15)], 4: [(2, "k", 9)]}


def plain_segments(hits):
    """Maximal segments by their definition: the best segment, then the same in what is left on both sides."""
    scores = {i: s for i, s in hits}
    n = max(scores) + 1
    x = [scores.get(i, -toxicity.DRIFT) for i in range(n)]

    def within(a, b):
        best = max(((round(sum(x[i:j]), 9), -(j - i), -i) for i in range(a, b) for j in range(i + 1, b + 1)), default=(0,))
        if best[0] <= 0:
            return []
        i, j = -best[2], -best[2] - best[1]
        return [*within(a, i), (i, j - 1, best[0]), *within(j, b)]

    return within(0, n)


def test_segments_are_the_maximal_ones():
    rng = np.random.default_rng(2)
    for _ in range(60):
        at = np.flatnonzero(rng.random(24) < rng.choice([0.2, 0.5]))
        hits = [(int(i), float(s)) for i, s in zip(at, rng.random(len(at)) * 2 + 0.001, strict=True)]
        if hits:
            got = [(a, b, pytest.approx(s)) for a, b, s in toxicity.segments(hits)]
            assert plain_segments(hits) == got


def test_segments_take_linear_time():
    def seconds(n):
        hits = [(40 * i, 1.0 + (i * 7919 % 101) / 1000) for i in range(n)]
        start = time.perf_counter()
        toxicity.segments(hits)
        return time.perf_counter() - start

    seconds(1000)
    assert seconds(100_000) < 5


def test_search_block_finds_what_brute_force_finds():
    rng = np.random.default_rng(6)
    vectors = rng.normal(size=(700, 16))
    vectors[100:300] = vectors[7]  # equal vectors tie to the smaller id
    ids, queries = rng.permutation(700), np.arange(0, 700, 9)
    largest = float((vectors**2).sum(1).max())
    project = nearest._projection(16, 8)
    points = nearest._lifted(vectors, largest) @ project
    asked = np.column_stack([vectors[queries], np.zeros(len(queries))]) @ project
    nothing = np.full(len(queries), -np.inf)
    best, verified = nearest.search_block(
        ids, vectors, points, ids[queries], vectors[queries], asked, nothing, 5, largest, nearest.chi_square_quantile(0.9999999, 8)
    )
    for row, q in enumerate(queries):
        scores = (vectors * vectors[q]).sum(axis=1)
        scores[q] = -np.inf
        assert best.ids[row].tolist() == ids[np.lexsort((ids, -scores))[:5]].tolist()
    assert 0 < verified <= 700 * len(queries)


def test_words_of_a_batch_are_held_a_slice_at_a_time():
    texts = [" ".join(f"w{i * 7 % 5000 + k}" for k in range(200)) for i in range(4000)] + ["", None]
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array([i % 2 for i in range(len(texts))], pa.int32())], names=["text", "toxic"])
    tracemalloc.start()
    made = []
    for out in toxicity._features(iter([batch])):
        made += [(out.num_rows, out)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20e6
    assert max(n for n, _ in made) <= ROWS and sum(n for n, _ in made) == len(texts)
    words = [sorted(own) for _, out in made for own in out.column(3).to_pylist()]
    assert words == [sorted(set(toxicity.tokens_of(text))) for text in texts]
    assert [t for _, out in made for t in out.column(2).to_pylist()] == batch.column(1).to_pylist()


def test_slices_keep_rows_and_their_order():
    batches = [pa.RecordBatch.from_pydict({"n": list(range(a, b))}) for a, b in ((0, 0), (0, 7), (7, 8), (8, 20))]
    sliced = list(in_slices(iter(batches), 5))
    assert [b.num_rows for b in sliced] == [5, 2, 1, 5, 5, 2]
    assert [n for b in sliced for n in b.column(0).to_pylist()] == list(range(20))
