"""Benchmark decontamination: item-sized windows of documents found by SimHash, verified by weighted shingles.

DataFrame functions only.

A window of a document is held against an item of the benchmark by its five-word shingles, each weighted by its letters.
A window can reach the threshold only if it shares a shingle with the item, and the shared shingle tells where the item
would lie: these places are the windows. Each gets a 64-bit SimHash; a multi-index of Hamming blocks brings together all
windows and items within the radius (of RADIUS + 1 blocks, one must agree), and the pairs are verified exactly.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vaportrail.session import stage

WORDS = 5  # of a shingle
SIMILARITY = 0.8
# fingerprints at similarity 0.8 differ in 9.7 bits on average, deviation 2.9: beyond 22 lie 6 in 10^6
RADIUS = 22
BITS = 64
SMALL_INDEX = 1_000_000  # shingles of a benchmark that may go to every task
BLANKS = r"[^\p{L}\p{N}]+"


def normal_words(text: Column) -> Column:
    """Lower-cased runs of letters and digits; a text without any gives one empty word."""
    return F.split(F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), BLANKS, " ")), " ")


def _each_five(words: str) -> Column:
    """(pos, row) of every five words in a row, as a generator; rows that run over the end hold nulls."""
    beside = [F.slice(words, F.lit(k + 1), F.lit(1 << 30)).alias(f"w{k}") for k in range(WORDS)]
    return F.posexplode(F.arrays_zip(*beside)).alias("pos", "row")


def _keyed(fives: DataFrame, *keep: str) -> DataFrame:
    """A 64-bit key of the five words of each row."""
    words = [F.col(f"row.w{k}") for k in range(WORDS)]
    return fives.where(words[-1].isNotNull()).select(*keep, "pos", F.xxhash64(*words).alias("key"))


def _weighted(words: list[Column]) -> Column:
    """A shingle as one number: a hash with its letters, 255 at most, in the low byte."""
    letters = F.least(F.lit(255), sum((F.length(w) for w in words[1:]), F.length(words[0]))).cast("long")
    return F.xxhash64(*words).bitwiseAND(F.lit(~0xFF)).bitwiseOR(letters)


def weight(shingle: Column) -> Column:
    return shingle.bitwiseAND(F.lit(0xFF)).cast("long")


def shingles_of(words: Column) -> Column:
    """Shingles of an array of words, in order."""
    return F.when(
        F.size(words) >= WORDS,
        F.transform(
            F.sequence(F.lit(0), F.size(words) - WORDS), lambda i: _weighted([F.get(words, i + k) for k in range(WORDS)])
        ),
    ).otherwise(F.array().cast("array<long>"))


def simhash(shingles: Column) -> Column:
    """64 signs of weighted sums over the distinct shingles."""
    hashed = F.transform(
        F.array_distinct(shingles), lambda s: F.struct(F.xxhash64(s, F.lit(1)).alias("h"), weight(s).alias("w"))
    )
    sums = F.aggregate(
        hashed,
        F.array_repeat(F.lit(0).cast("long"), BITS),
        lambda done, s: F.transform(done, lambda t, i: t + s["w"] * (1 - 2 * F.getbit(s["h"], i).cast("long"))),
    )
    return F.aggregate(
        sums, F.lit(0).cast("long"), lambda done, t: F.shiftleft(done, 1).bitwiseOR(F.when(t < 0, 1).otherwise(0).cast("long"))
    )


def similarity(a: Column, b: Column) -> Column:
    total = lambda shingles: F.aggregate(shingles, F.lit(0).cast("long"), lambda t, s: t + weight(s))
    return total(F.array_intersect(a, b)) / total(F.array_union(a, b))


def hamming_blocks(fingerprint: Column) -> Column:
    """(number, bits) of RADIUS + 1 blocks: fingerprints within RADIUS agree in one of them at least."""
    n = RADIUS + 1
    edges = [BITS * i // n for i in range(n + 1)]
    cut = lambda i: F.shiftrightunsigned(fingerprint, edges[i]).bitwiseAND(
        F.lit((1 << (edges[i + 1] - edges[i])) - 1)
    )
    return F.array(*[F.struct(F.lit(i).alias("block"), cut(i).alias("bits")) for i in range(n)])


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    least: float = SIMILARITY,
) -> DataFrame:
    """(id, item, start, n_words, similarity, distance): for each document and item, the best window that reaches ``least``.

    Words are lower-cased runs of letters and digits, ``start`` counts words from 0, ties go to the earlier window.
    Documents without such a window have no row.

    Items of fewer than five words are too short to be evidence and match nothing; so do null, empty and shorter texts.
    Rows without id are left out. Rows that share an id count as one document; repeated items each have their row. Empty
    tables give none. Other columns are ignored.

    Documents are read twice: once for their shingles, once for the words of windows. The benchmark's shingles go to every
    task if they are counted to be few; otherwise both sides are shuffled by shingle.
    """
    named = benchmark.where(benchmark[item_col].isNotNull()).select(
        benchmark[item_col].alias("item"), normal_words(benchmark[item_text_col]).alias("words")
    )
    items = named.select("item", shingles_of(F.col("words")).alias("item_shingles"))
    items = stage(items.withColumn("item_print", simhash(F.col("item_shingles"))), "decontaminate-items")
    # where each shingle of an item first stands
    first = _keyed(named.select("item", F.size("words").alias("length"), _each_five("words")), "item", "length")
    index = first.groupBy("item", "length", "key").agg(F.min("pos").alias("item_pos"))
    index = stage(index, "decontaminate-index")
    few = index.limit(SMALL_INDEX + 1).count() <= SMALL_INDEX
    texts = docs.where(docs[id_col].isNotNull()).select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    fives = texts.select("id", normal_words(F.col("text")).alias("words")).select("id", _each_five("words"))
    # many windows start where a common passage is; of each document, item and place there is one
    windows = (
        _keyed(fives, "id")
        .join(F.broadcast(index) if few else index, "key")
        .select("id", "item", "length", F.greatest(F.lit(0), F.col("pos") - F.col("item_pos")).alias("start"))
        .distinct()
    )
    windows = stage(windows, "decontaminate-windows")
    places = windows.groupBy("id").agg(F.collect_set(F.struct("start", "length")).alias("at"))
    # words are taken apart after the join, which leaves few documents
    prints = (
        texts.join(places, "id")
        .select("id", normal_words(F.col("text")).alias("words"), "at")
        .select("id", "words", F.explode("at").alias("at"))
        .select("id", "at.start", "at.length", F.slice("words", F.col("at.start") + 1, F.col("at.length")).alias("window"))
        .select("id", "start", "length", shingles_of(F.col("window")).alias("shingles"))
        .withColumn("print", simhash(F.col("shingles")))
    )
    prints = stage(prints, "decontaminate-prints")
    pairs = windows.join(prints, ["id", "start", "length"]).select("id", "item", "start", "length", "shingles", "print")
    blocks = items.select("item", "item_shingles", "item_print", hamming_blocks(F.col("item_print")).alias("item_blocks"))
    # the multi-index is searched among the windows of an item: its key is item, block and the block's bits
    near = pairs.join(blocks, "item").where(
        F.arrays_overlap(hamming_blocks(F.col("print")), "item_blocks")
        & (F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))) <= RADIUS)
    )
    verified = near.select(
        "id",
        "item",
        "start",
        F.col("length").alias("n_words"),
        similarity(F.col("shingles"), F.col("item_shingles")).alias("similarity"),
        F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))).alias("distance"),
    ).where(F.col("similarity") >= least)
    best = F.max_by(
        F.struct("start", "n_words", "similarity", "distance"), F.struct("similarity", (-F.col("start")).alias("first"))
    )
    return (
        verified.groupBy("id", "item")
        .agg(best.alias("best"))
        .select(F.col("id").alias(id_col), F.col("item").alias(item_col), "best.*")
    )
