"""Near-duplicate documents by b-bit MinHash, confirmed on full shingle sets."""

import uuid
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vaportrail.llm.links import components
from vaportrail.llm.words import WordHashes, as_long, ascii_words, in_slices, mix
from vaportrail.session import new_stage_path, stage

BANDS, ROWS = 32, 5  # a pair at 0.8 shares no band with a probability of 3e-6
HASHES = BANDS * ROWS
BITS = 4  # kept of each minimum
WORDS = 2  # of a shingle
PERCENT = 80  # linked from this similarity on
# an estimate deviates by 0.033 at 0.8: five deviations below, one link in three million is passed over
ESTIMATE = 0.635
CHUNK = 2048  # shingles hashed at once
FILTER_WORDS = 1 << 20  # of the filter that picks texts: useful up to some ten million ids
BLOCK = 1024  # members of a bucket compared at once with as many others

_rng = np.random.default_rng(20240229)
_A = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64)
_ROW = _rng.integers(0, 1 << 63, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FIRST, _SECOND = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_SHIFTS = np.arange(0, 64, BITS, dtype=np.uint64)


def shingle_set(text: str, hashes: WordHashes, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles of so many words; a shorter text is one shingle, no word is none."""
    h = hashes.array(ascii_words(text))
    length = min(words, len(h))
    if length < 2:
        return np.unique(mix(h * _FIRST + np.uint64(1)))
    n = len(h) - length + 1
    rolled = h[length - 1 :]
    for k in range(length - 2, -1, -1):
        rolled = h[k : k + n] * _FIRST + mix(rolled * _SECOND)
    return np.unique(mix(rolled))


def minima(shingles: np.ndarray) -> np.ndarray:
    low = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), CHUNK):
        block = np.multiply.outer(_A, shingles[i : i + CHUNK])
        block += _B[:, None]
        np.minimum(low, block.min(axis=1), out=low)
    return mix(low)


def band_keys(low: np.ndarray) -> np.ndarray:
    return mix((low.reshape(BANDS, ROWS) * _ROW).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64))


def packed(low: np.ndarray) -> np.ndarray:
    """The low bits of the minima, 16 to a 64-bit number."""
    nibbles = (low & np.uint64(2**BITS - 1)).reshape(-1, len(_SHIFTS))
    return np.bitwise_or.reduce(nibbles << _SHIFTS, axis=1)


def sketches(docs: DataFrame, id_col: str, text_col: str, words: int = WORDS) -> DataFrame:
    """(id, n, set_hi, set_lo, signature, bands) of every row; the set hash tells equal sets, null for the empty one."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        names = ["id", "n", "set_hi", "set_lo", "signature", "bands"]
        for batch in in_slices(batches):
            n, hi, lo, signatures, bands = [], [], [], [], []
            for text in batch.column(1):
                s = shingle_set(text.as_py() or "", hashes, words)
                n.append(len(s))
                if not len(s):
                    hi.append(None), lo.append(None), signatures.append(None), bands.append(None)
                    continue
                sums = as_long(np.array([mix(s).sum(dtype=np.uint64), mix(s ^ _FIRST).sum(dtype=np.uint64)]))
                hi.append(int(sums[0])), lo.append(int(sums[1]))
                low = minima(s)
                signatures.append(as_long(packed(low)))
                bands.append(as_long(band_keys(low)))
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(n, pa.int64()),
                    pa.array(hi, pa.int64()),
                    pa.array(lo, pa.int64()),
                    pa.array(signatures, longs),
                    pa.array(bands, longs),
                ],
                names=names,
            )

    rows = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"))
    return rows.mapInArrow(
        sketch, "id long, n long, set_hi long, set_lo long, signature array<long>, bands array<long>"
    )


def estimate(a: Column, b: Column) -> Column:
    """Similarity from packed signatures: the share of equal minima, less what low bits agree by chance."""

    def differing(x: Column, y: Column) -> Column:
        bits = x.bitwiseXOR(y)
        for step in (1, 2):
            bits = bits.bitwiseOR(F.shiftrightunsigned(bits, step))
        return F.bit_count(bits.bitwiseAND(F.lit(0x1111111111111111)))

    unequal = F.aggregate(F.zip_with(a, b, differing), F.lit(0), lambda n, d: n + d)
    chance = 2.0**-BITS
    return ((1 - unequal / HASHES) - chance) / (1 - chance)


def estimates(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    bits = one ^ many
    bits |= bits >> np.uint64(1)
    bits |= bits >> np.uint64(2)
    unequal = np.bitwise_count(bits & np.uint64(0x1111111111111111)).sum(axis=1, dtype=np.int64)
    chance = 2.0**-BITS
    return ((1 - unequal / HASHES) - chance) / (1 - chance)


def _pairs(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def shared_bands(classes: DataFrame) -> DataFrame:
    """(key, class, p, q): members of buckets of two or more, with two members of the bucket that are chosen by hash.

    Most bands belong to one class alone; they are counted once and go no further.
    """
    bands = classes.select("class", F.explode("bands").alias("key"))
    by_chance = F.xxhash64("class", "key")
    buckets = (
        bands.groupBy("key")
        .agg(F.count("*").alias("members"), F.min_by("class", by_chance).alias("p"), F.max_by("class", by_chance).alias("q"))
        .where("members > 1")
    )
    return bands.join(buckets, "key").select("key", "class", "p", "q")


def star_candidates(classes: DataFrame, shared: DataFrame) -> DataFrame:
    """(a, b, estimate): members of a bucket with its two chosen members, and what signatures tell of them.

    A bucket gives at most two pairs for each member, whatever its size.
    """
    pairs = (
        shared.select("class", F.explode(F.array("p", "q")).alias("pivot"))
        .where(F.col("class") != F.col("pivot"))
        .select(*_pairs(F.col("class"), F.col("pivot")))
        .distinct()
    )
    signature = lambda c: classes.select(
        F.col("class").alias(c), F.col("n").alias(f"n_{c}"), F.col("signature").alias(f"sig_{c}")
    )
    estimated = pairs.join(signature("a"), "a").join(signature("b"), "b")
    sizes_allow = 100 * F.least("n_a", "n_b") >= PERCENT * F.greatest("n_a", "n_b")
    return estimated.select(
        "a", "b", F.when(sizes_allow, estimate(F.col("sig_a"), F.col("sig_b"))).otherwise(0.0).alias("estimate")
    )


def _maybe_among(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """The texts whose id may be among ``ids``: a one-hash Bloom filter as a table of at most FILTER_WORDS 64-bit words.

    Passes every wanted text and, of the others, the share of bits that are set; it only saves moving most texts.
    """
    place = F.pmod(F.xxhash64("id"), F.lit(FILTER_WORDS * 64))
    word, bit = F.shiftright(place, 6), (place % 64).cast("int")
    words = ids.select(word.alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))
    # bounded by FILTER_WORDS, whatever the number of ids
    marked = texts.withColumn("word", word).join(F.broadcast(words), "word")
    return marked.where(F.getbit("bits", bit) == 1).select(*texts.columns)


def _stored_by_id(texts: DataFrame, ids: DataFrame, name: str) -> DataFrame:
    """Stores (id, text) of some ids bucketed by id: the joins of every confirming round find texts in place.

    Texts move once: those that may be wanted are dealt by id, meet the ids and are written from there.
    """
    spark = texts.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = _maybe_among(texts, ids).repartition(n, "id").join(ids, "id", "left_semi")
    table = f"{name}_{uuid.uuid4().hex[:12]}"
    (
        texts.write.bucketBy(n, "id")
        .sortBy("id")
        .option("path", new_stage_path(spark, name))
        .format("parquet")
        .saveAsTable(table)
    )
    return spark.table(table)


def confirm(pairs: DataFrame, texts: DataFrame, words: int = WORDS) -> DataFrame:
    """The (a, b) whose full shingle sets reach the threshold."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, last, s = WordHashes(), None, None
        for batch in in_slices(batches):
            linked = []
            for b, text_a, text_b in zip(batch.column(1), batch.column(2), batch.column(3), strict=True):
                if last != (b.as_py(), text_b):
                    last, s = (b.as_py(), text_b), shingle_set(text_b.as_py() or "", hashes, words)
                t = shingle_set(text_a.as_py() or "", hashes, words)
                both = len(np.intersect1d(s, t, assume_unique=True))
                linked.append(100 * both >= PERCENT * (len(s) + len(t) - both))
            yield batch.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))

    text_of = lambda c: texts.select(F.col("id").alias(c), F.col("text").alias(f"text_{c}"))
    both = pairs.select("a", "b").join(text_of("a"), "a").join(text_of("b"), "b")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(check, "a long, b long")


def _labelled(rows: DataFrame, found: DataFrame, node: str, label: str) -> DataFrame:
    """Adds the component of ``node``, itself where it has no link."""
    named = found.select(F.col("node").alias(node), F.col("component").alias("_found"))
    return rows.join(named, node, "left").withColumn(label, F.coalesce("_found", node)).drop("_found")


def _across(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """Pairs that no link joins yet, with the components of both."""
    return _labelled(_labelled(pairs, found, "a", "comp_a"), found, "b", "comp_b").where("comp_a != comp_b")


def _dealt_buckets(classes: DataFrame, shared: DataFrame, found: DataFrame) -> DataFrame:
    """Members of buckets that hold several components, dealt to tasks (key, i, j) that compare block i with block j.

    The members of a bucket's largest component need no comparison with each other: their blocks (numbered below 0) meet
    only the blocks of the others, which are few in a group of copies.
    """
    labelled = _labelled(shared.select("key", "class"), found, "class", "comp")
    sizes = labelled.groupBy("key", "comp").agg(F.count("*").alias("n"))
    blocks_of = lambda n: F.ceil(n / BLOCK).cast("int")
    buckets = (
        sizes.groupBy("key")
        .agg(F.max(F.struct("n", "comp")).alias("main"), F.sum("n").alias("members"))
        .where(F.col("main.n") < F.col("members"))
        .select(
            "key",
            F.col("main.comp").alias("main"),
            blocks_of(F.col("main.n")).alias("mains"),
            blocks_of(F.col("members") - F.col("main.n")).alias("others"),
        )
    )
    is_main = F.col("comp") == F.col("main")
    place = F.xxhash64("class")
    block = F.when(is_main, -1 - F.pmod(place, F.col("mains"))).otherwise(F.pmod(place, F.col("others"))).cast("int")
    meets = F.sequence(F.when(is_main, F.lit(0)).otherwise(-F.col("mains")), F.col("others") - 1)
    tasks = F.transform(meets, lambda o: F.struct(F.least("block", o).alias("i"), F.greatest("block", o).alias("j")))
    return (
        labelled.join(buckets, "key")
        .withColumn("block", block)
        .select("key", "class", "comp", "block", tasks.alias("tasks"))
        .join(classes.select("class", "n", "signature", "bands"), "class")
    )


class _Union(dict):
    def root(self, x: int) -> int:
        while (above := self.get(x, x)) != x:
            x = above
        return x


_MEMBER = "key long, i int, j int, class long, comp long, block int, n long, signature array<long>, bands array<long>"


def _tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows of one (key, i, j) at a time, as arrays by column and one table; a task may span batches."""
    held: list[tuple] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        parts = [batch.column(c).to_numpy(zero_copy_only=False) for c in range(7)]
        for c, width in ((7, HASHES * BITS // 64), (8, BANDS)):
            parts.append(batch.column(c).flatten().to_numpy().view(np.uint64).reshape(-1, width))
        key, i, j = parts[:3]
        parts[0] = key.view(np.uint64)
        cuts = np.flatnonzero((key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
            part = (*(x[a:b] for x in parts), batch.slice(a, b - a))
            if held and tuple(x[0] for x in held[0][:3]) != tuple(x[0] for x in part[:3]):
                yield _joined(held)
                held = []
            held.append(part)
    if held:
        yield _joined(held)


def _joined(held: list[tuple]) -> tuple:
    *arrays, rows = zip(*held, strict=True)
    return (*map(np.concatenate, arrays), pa.Table.from_batches(rows))


def _likely(task: tuple) -> Iterator[tuple[int, np.ndarray]]:
    """Each row of block i and the rows of block j to try it with, the likeliest first.

    These belong to other components, have a fitting size, pass the estimate, and share no earlier band: a pair is tried
    in one bucket only.
    """
    key, i, j, ids, comp, block, n, signatures, bands, _ = task
    left, right = np.flatnonzero(block == i[0]), np.flatnonzero(block == j[0])
    for x in left:
        y = right[(comp[right] != comp[x]) & (100 * np.minimum(n[right], n[x]) >= PERCENT * np.maximum(n[right], n[x]))]
        y = y[ids[y] > ids[x]] if i[0] == j[0] else y
        if not len(y):
            continue
        like = estimates(signatures[x], signatures[y])
        y, like = y[like >= ESTIMATE], like[like >= ESTIMATE]
        first = (bands[y] == bands[x]).argmax(axis=1) == np.argmax(bands[x] == key[0])
        y, like = y[first], like[first]
        if len(y):
            yield x, y[np.argsort(-like, kind="stable")]


class _Union(dict):
    def root(self, x: int) -> int:
        while (above := self.get(x, x)) != x:
            x = above
        return x


def _links_between(task: tuple, hashes: WordHashes, words: int) -> Iterator[tuple[int, int]]:
    """Links on full sets that join components of one task; pairs are tried only while their components are apart."""
    ids, comp, texts = task[3], task[4], task[-1]["text"]
    sets: dict[int, np.ndarray] = {}
    joined = _Union()

    def full_set(row: int) -> np.ndarray:
        if row not in sets:
            sets[row] = shingle_set(texts[row].as_py() or "", hashes, words)
        return sets[row]

    for x, others in _likely(task):
        for z in others.tolist():
            a, b = joined.root(int(comp[x])), joined.root(int(comp[z]))
            if a == b:
                continue
            s, t = full_set(int(x)), full_set(z)
            both = len(np.intersect1d(s, t, assume_unique=True))
            if 100 * both >= PERCENT * (len(s) + len(t) - both):
                joined[a] = b
                yield int(ids[x]), int(ids[z])


def _with_partner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows that have anything to be tried with in their task."""
    for task in _tasks(batches):
        hit = np.zeros(len(task[0]), bool)
        for x, others in _likely(task):
            hit[x] = True
            hit[others] = True
        if hit.any():
            yield from task[-1].filter(pa.array(hit)).to_batches()


def _confirmed(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for task in _tasks(batches):
        if pairs := list(_links_between(task, hashes, words)):
            a, b = (pa.array(c, pa.int64()) for c in zip(*pairs, strict=True))
            yield pa.RecordBatch.from_arrays([a, b], names=["a", "b"])


def bucket_links(classes: DataFrame, shared: DataFrame, found: DataFrame, texts: DataFrame, words: int = WORDS) -> DataFrame:
    """(a, b) that join components: every pair that shares a bucket, is still apart and passes the estimate is tried.

    Pairs are never written out. Members meet first with their signatures alone; those that have a partner to be tried
    with meet again with their texts, and only links come back.
    """
    task = ["key", "i", "j"]
    members = _dealt_buckets(classes, shared, found).withColumn("task", F.explode("tasks"))
    members = members.select("key", "task.i", "task.j", "class", "comp", "block", "n", "signature", "bands")
    likely = members.repartition(*task).sortWithinPartitions(*task).mapInArrow(_with_partner, _MEMBER)
    likely = stage(likely, "minhash-likely")
    together = likely.join(texts.withColumnRenamed("id", "class"), "class").select(*likely.columns, "text")
    return together.repartition(*task).sortWithinPartitions(*task).mapInArrow(partial(_confirmed, words=words), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """(id, n_shingles, component_id, kept) of every row.

    Words are runs of non-blanks with A-Z lowered; a document's set are its distinct shingles of ``words`` words, or of
    all its words if they are fewer.
    Two documents are linked if their sets agree to 80 %; a component is named by its smallest id, which is kept.

    Documents of equal sets form a class, and one stands for all. Classes that share a band of the MinHash signature are
    candidates if the b-bit estimate allows. First each bucket's members are tried with two of them (the most promising
    pair of every class, then one for each component still apart), which joins large groups of copies without making
    their pairs; then all candidates that are still in different components are tried, bucket by bucket. Links are
    confirmed on full sets.

    Texts that are null, empty or blank have 0 shingles and stay alone. Rows that share an id count as one document when
    linking; rows without id are linked with nothing and have no component but are kept. Other columns are ignored.
    """
    rows = stage(sketches(docs, id_col, text_col, words), "minhash-sketches")
    same_set = ["set_hi", "set_lo", "n"]
    classes = stage(
        rows.where("n > 0 and id is not null")
        .groupBy(*same_set)
        .agg(F.min("id").alias("class"), F.first("signature").alias("signature"), F.first("bands").alias("bands")),
        "minhash-classes",
    )
    shared = stage(shared_bands(classes), "minhash-shared")
    stars = stage(star_candidates(classes, shared), "minhash-stars")
    tried = stars.where(F.col("estimate") >= ESTIMATE)

    likely = tried.unionByName(tried.select(F.col("b").alias("a"), F.col("a").alias("b"), "estimate"))
    # surely linked partners: the smallest, so that a group meets at few documents; else the likeliest
    rank = F.struct((F.floor(F.least("estimate", F.lit(0.9)) * 50)).alias("r"), (-F.col("b")).alias("i"))
    best = likely.groupBy("a").agg(F.max_by("b", rank).alias("b")).select(*_pairs(F.col("a"), F.col("b"))).distinct()
    best = stage(best, "minhash-pairs")

    in_buckets = stage(stars.select(F.col("a").alias("id")).union(stars.select("b")).distinct(), "minhash-ids")
    texts = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"))
    texts = _stored_by_id(texts, in_buckets, "minhash_texts")
    links = stage(confirm(best, texts, words), "minhash-links")
    found = components(links)

    across = (
        _across(tried, found).groupBy("a", "comp_b").agg(F.max_by("b", "estimate").alias("b")).select("a", "b")
    ).join(best, ["a", "b"], "left_anti")
    across = stage(across, "minhash-pairs")
    links = stage(links.unionByName(confirm(across, texts, words)), "minhash-links")
    found = components(links)

    links = stage(links.unionByName(bucket_links(classes, shared, found, texts, words)), "minhash-links")
    found = components(links)

    named = _labelled(classes.select(*same_set, "class"), found, "class", "component")
    joined = rows.select("id", *same_set).join(named.drop("class"), same_set, "left")
    component = F.coalesce("component", "id")
    return joined.select(
        F.col("id").cast(docs.schema[id_col].dataType).alias(id_col),
        F.col("n").alias("n_shingles"),
        F.when(F.col("id").isNotNull(), component).alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )
