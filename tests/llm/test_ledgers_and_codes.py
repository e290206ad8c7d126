"""The Merkle manifest, vector codes and token files on small and awkward input, against plain restatements."""

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from vaportrail.llm import codes, hot, merkle, token_files


# --- 11 Merkle manifest


def leaf_rows(sizes, seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    for source, n in sizes.items():
        rows += [(int(i), source, brute.sha(f"{source}{i}")) for i in rng.permutation(n)]
    return [rows[i] for i in rng.permutation(len(rows))]


@pytest.mark.parametrize("height", [1, 2, 6])
@pytest.mark.parametrize("sizes", [{"a": 1}, {"a": 1, None: 1}, {"a": 2, "b": 4, None: 3}, {"hot": 200, "é": 1, "z": 28, None: 27, "": 9}])
def test_manifest_against_plain_trees(spark, monkeypatch, height, sizes):
    monkeypatch.setattr(merkle, "HEIGHT", height)
    rows = leaf_rows(sizes)
    df = spark.createDataFrame(rows, "doc_id long, source string, leaf string").repartition(5)
    got = merkle.manifest(df).withColumn("folded", merkle.fold(F.col("leaf"), F.col("proof")))
    got = got.withColumn("siblings", merkle.proof_text(F.col("proof"))).collect()
    assert all(r.folded == r.root for r in got)
    key = lambda r: (r[1] is not None, r[1] or "", r[0])
    mine = sorted([(r.doc_id, r.source, r.leaf, r.subroot, r.root, r.siblings) for r in got], key=key)
    assert mine == sorted(brute.merkle(rows), key=key)


def test_a_changed_leaf_does_not_fold_to_the_root(spark):
    rows = leaf_rows({"a": 30, "b": 5})
    df = spark.createDataFrame(rows, "doc_id long, source string, leaf string").withColumn("probe", F.sha2(F.col("leaf"), 256))
    got = merkle.manifest(df, ("probe",)).withColumn("folded", merkle.fold(F.col("probe"), F.col("proof"))).collect()
    assert len(got) == 35 and all(r.folded != r.root for r in got)


def test_manifest_awkward(spark, awkward, nothing):
    columns = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    rows = awkward.select("doc_id", "source", merkle.leaf(*columns).alias("leaf"), "size", "key")
    got = merkle.manifest(rows, ("size",)).collect()
    want = brute.merkle([(r.doc_id, r.source, r.leaf) for r in rows.collect()])
    order = lambda r: (r[1] or "", r[0] or -1, r[2])
    assert sorted([(r.doc_id, r.source, r.leaf, r.subroot, r.root) for r in got], key=order) == sorted([w[:5] for w in want], key=order)
    assert {r["size"] for r in got} == {4}
    empty = nothing.select("doc_id", "source", merkle.leaf(*columns).alias("leaf"))
    assert merkle.manifest(empty).count() == 0


def test_leaf_of_known_fields(spark):
    row = spark.range(1).select(merkle.leaf(F.lit(7), F.lit("é"), F.lit(None).cast("string"), F.lit("")).alias("leaf")).first()
    assert row.leaf == brute.sha("1:72:é-0:")


def test_equal_rows_have_places_of_their_own(spark):
    df = spark.createDataFrame([(1, "a", brute.sha("x"))] * 50, "doc_id long, source string, leaf string").repartition(4)
    got = merkle.manifest(df).withColumn("folded", merkle.fold(F.col("leaf"), F.col("proof"))).collect()
    assert len(got) == 50 and len({r.root for r in got}) == 1 and all(r.folded == r.root for r in got)


# --- 12 vector codes


def coded(df, **kw):
    out, books = codes.compress(df, **kw)
    return sorted(out.collect(), key=lambda r: (r[0] is None, r[0] or 0, r[1])), books


@pytest.mark.parametrize("seed", [1, 2])
def test_codes_against_plain_integers(spark, seed):
    rng = np.random.default_rng(seed)
    vectors = rng.normal(size=(300, 12)).astype("float32") * rng.choice([0.01, 1, 30], (300, 1))
    vectors[100:190] = vectors[5]  # a frequent vector
    vectors[200:240] = np.round(vectors[200:240])  # ties
    rows = [(i, [float(x) for x in v], i % 3 if i % 7 else None) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(6)
    got, books = coded(df, parts=3, entries=9, rounds=4)
    whole = [(i, [int(np.floor(np.float64(np.float32(x)) * 4096)) for x in v]) for i, v, _ in rows]
    want, errors, plain = brute.codes(whole, 3, 9, 4)
    assert [b.tolist() for b in books] == plain
    assert [r.code for r in got] == want and [r.error for r in got] == errors
    by_label = {}
    for (_, _, label), e in zip(rows, errors, strict=True):
        by_label[label] = by_label.get(label, 0) + e
    assert [r.label_error for r in got] == [by_label[label] for _, _, label in rows]


def test_codes_awkward(spark):
    nan, inf = float("nan"), float("inf")
    good = [(5, [1.0, -2.0]), (5, [1.0, -2.0]), (None, [0.0, 0.0]), (7, [1e30, -1e30]), (8, [0.5, 0.25])]
    bad = [(1, None), (2, [1.0, None]), (3, [nan, 0.0]), (4, [inf, 0.0]), (6, []), (9, [1.0, 2.0, 3.0, 4.0]), (10, [1.0])]
    fields = "vec_id long, embedding array<double>, label string"
    df = spark.createDataFrame([(*r, None) for r in good + bad], fields).withColumns({"row": F.lit(1), "code": F.lit("x"), "_key": F.lit(2)})
    got, books = coded(df, parts=2, entries=16)
    assert [r.vec_id for r in got] == [5, 5, 7, 8, None]
    assert all(r.error == 0 and r.label_error == 0 for r in got) and [len(b) for b in books] == [5, 5]
    assert got[0].code == got[1].code == "0000"
    none, books = codes.compress(df.limit(0))
    assert none.count() == 0 and books == [] and codes.codebooks_text(books) == ""


def test_hilbert_visits_every_cell_by_neighbours():
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        side = np.arange(1 << bits)
        cells = np.stack(np.meshgrid(*[side] * dims, indexing="ij"), -1).reshape(-1, dims)
        place = codes.hilbert(cells, bits)
        assert sorted(place) == list(range(len(cells)))
        path = cells[np.argsort(place)]
        assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_shortlists_hold_every_nearest_entry():
    rng = np.random.default_rng(9)
    settled = 0
    for _ in range(200):
        data = rng.integers(-50, 50, (1, 4)) + rng.integers(-6, 7, (40, 4))
        book = rng.integers(-60, 60, (16, 4))
        short = np.flatnonzero(codes.shortlists(data.min(0)[None], data.max(0)[None], book)[0])
        away = ((data[:, None] - book[None]) ** 2).sum(2)
        assert set(away.argmin(1)) <= set(short)
        entry, distance = codes.nearest_entries(data, book, short)
        assert (entry == away.argmin(1)).all() and (distance == away.min(1)).all()
        settled += len(short) < 16
    assert settled > 100


def test_join_on_a_hot_key_is_the_same_salted_or_not(spark, monkeypatch):
    rows = spark.createDataFrame([(i, None if i % 3 else i % 5) for i in range(200)], "row long, k int")
    few = rows.groupBy("k").agg(F.count("*").alias("n"))
    want = sorted(map(tuple, hot.join_hot(rows, few, "k", 6, "row").select("row", "n").collect()))
    monkeypatch.setattr(hot, "BROADCAST_ROWS", 0)
    assert sorted(map(tuple, hot.join_hot(rows, few, "k", 6, "row").select("row", "n").collect())) == want and len(want) == 200


# --- 13 token files


def test_packing_round_trip():
    rng = np.random.default_rng(4)
    for _ in range(100):
        lengths = rng.integers(0, 200, rng.integers(1, 12))
        n = int(lengths.sum())
        ids = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        ids >>= rng.integers(0, 64, n).astype(np.uint64)
        words, n_words, escapes = token_files.pack(ids, lengths)
        assert (token_files.unpack(words, n_words, lengths, escapes) == ids).all()
        assert len(escapes) == (ids >= 1 << 60).sum()


def test_words_take_as_many_ids_as_fit():
    for width, count in ((1, 60), (3, 20), (12, 5), (16, 3), (60, 1)):
        ids = np.full(3 * count, (1 << width) - 1, np.uint64)
        words, n_words, escapes = token_files.pack(ids, np.array([len(ids)]))
        assert n_words.tolist() == [3] and not len(escapes)
    words, n_words, escapes = token_files.pack(np.array([1 << 60], np.uint64), np.array([1]))
    assert len(words) == 1 and escapes.tolist() == [1 << 60]


def test_token_files_awkward(spark, awkward, nothing, tmp_path):
    more = [(20, "a   b \u3000 c\u00a0d <|endoftext|> e"), (21, " lead and trail "), (22, "tab\tnew\nline \n x"), (23, "é è ü 𝒳 ō")]
    df = awkward.select("doc_id", "text", "size", "key").unionByName(
        spark.createDataFrame(more, "doc_id long, text string"), allowMissingColumns=True
    )
    path = str(tmp_path / "files")
    token_files.write_tokens(df.repartition(3), path, file_words=10, block_ids=1000, batch_bytes=20)
    got = token_files.with_starts(token_files.read_tokens(spark, path).withColumn("crc", F.crc32("ids")))
    got = got.select("doc_id", "start", "n_tokens", "crc").collect()
    rows = sorted(df.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    want, start = [], 0
    for r in rows:
        ids = brute.token_ids(r.text, end=2)
        want.append((r.doc_id, start, len(ids), brute.ids_crc32(ids)))
        start += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    assert spark.read.format("binaryFile").load(path).count() > 3
    back = {r.doc_id: r.ids for r in token_files.read_tokens(spark, path, width=8).collect()}
    assert np.frombuffer(back[20], "<u8").tolist() == brute.token_ids(more[0][1], end=2)
    assert sorted(map(tuple, token_files.token_round_trip(df).collect()), key=lambda r: r[1]) == want
    assert token_files.token_round_trip(nothing).count() == 0


def test_token_files_without_end_id(spark, tmp_path):
    df = spark.createDataFrame([(1, ""), (2, "two words"), (3, None)], "doc_id long, text string")
    path = str(tmp_path / "files")
    token_files.write_tokens(df, path, end_id=None)
    got = token_files.with_starts(token_files.read_tokens(spark, path)).orderBy("doc_id").collect()
    assert [(r.n_tokens, r.start) for r in got] == [(0, 0), (len(brute.token_ids("two words")), 0), (0, len(brute.token_ids("two words")))]


def test_broken_token_files_are_refused():
    writer = token_files.FileWriter(3)
    list(writer.add([1, None], np.array([5, 6, 7], np.uint64), np.array([2, 1])))
    content = writer.file() + token_files.END.encode()
    ((task, before, ids, lengths, tokens),) = token_files.parse_file(content)
    assert (task, before, ids, lengths.tolist(), tokens.tolist()) == (3, 0, [1, None], [2, 1], [5, 6, 7])
    for broken in (content[:-8], content[8:], content[:16] + content[-8:], b""):
        with pytest.raises(ValueError):
            list(token_files.parse_file(broken))


def test_cuts_change_no_token():
    rng = np.random.default_rng(8)
    bits = ["a", "Bc", "é", "ß", "×", "…", "1", "23", ".", ",", "-", "'s", "'", "(", "\n", "\n\n", " ", "  ", "\t", "\r\n", "\u00a0", "\u3000", "日本", "𝒳"]
    bits += ["<|endoftext|>", "<|endoftext", "|>", "\x1c", "\x0b", "\u0085", "word", " the", "\u2028", "e\u0301"]
    texts = ["".join(rng.choice(bits, rng.integers(0, 40))) for _ in range(4000)]
    encoder = token_files.PieceIds("byte_bpe_50k.json", 2)
    raw = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in raw])])
    want = [e.ids + [2] for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    for _ in range(2):  # the second time every piece is known
        ids, lengths = encoder.encode(offsets, np.frombuffer(b"".join(raw), np.uint8))
        got = [ids[stop - n : stop].tolist() for stop, n in zip(np.cumsum(lengths), lengths, strict=True)]
        assert got == want


def test_a_full_cache_changes_no_token(monkeypatch):
    monkeypatch.setattr(token_files, "CACHE_PIECES", 50)
    encoder = token_files.PieceIds("byte_bpe_50k.json", None)
    for k in range(30):
        text = " ".join(f"w{i % (3 + k)}x{i % 7}" for i in range(200)).encode()
        ids, lengths = encoder.encode(np.array([0, len(text)]), np.frombuffer(text, np.uint8))
        assert ids.tolist() == brute.token_ids(text.decode()) and lengths.tolist() == [len(ids)]
    assert len(encoder.pieces) < 400


def test_other_tokenizers_encode_whole_texts():
    encoder = token_files.PieceIds("word_bpe_49k.json", None)
    texts = ["Some words, here.", "", "more of  them\nand more"]
    raw = [t.encode() for t in texts]
    ids, lengths = encoder.encode(np.concatenate([[0], np.cumsum([len(t) for t in raw])]), np.frombuffer(b"".join(raw), np.uint8))
    want = [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert not encoder.cuts and lengths.tolist() == [len(w) for w in want] and ids.tolist() == sum(want, [])
