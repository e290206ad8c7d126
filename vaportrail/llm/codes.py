"""Vector code compression: product quantisation by exact integer k-means over Hilbert-sorted blocks.

Vectors become integers and are cut into equal parts. The parts of one position are sorted along a Hilbert curve and stored in
flat blocks, each with its box (minimum and maximum of every component) and its sums. In each round the distances from a box to
the codebook's entries leave a shortlist: an entry whose least distance to the box exceeds some other entry's greatest distance
is nearest to nothing inside. A shortlist of one settles the block by its sums alone; others are compared with the block's parts
in exact integers.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vaportrail.llm.hot import join_hot
from vaportrail.session import stage

PARTS, ENTRIES, ROUNDS = 8, 16, 6
SCALE = 4096
BLOCK_ROWS = 128


def whole_numbers(vec: Column, limit: int) -> Column:
    """floor(SCALE * x) of each component, held within ±limit, where squared distances are exact in 64 bits."""
    number = lambda x: F.floor(F.lit(float(SCALE)) * x.cast("double")).cast("long")
    return F.transform(vec, lambda x: F.greatest(F.lit(-limit), F.least(F.lit(limit), number(x))))


def finite(vec: Column) -> Column:
    held = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(held & (F.size(vec) > 0), F.lit(False))


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Places along a Hilbert curve of points of whole numbers below 2^bits, bits * dimensions being at most 63.

    Works from the highest bit down: each dimension's bit swaps or inverts the lower bits of the first, as the curve turns
    inside every cell; the bits, Gray-decoded, are then interleaved.
    """
    x = points.astype(np.int64).copy()
    n, dims = x.shape
    bit = 1 << (bits - 1)
    while bit > 1:
        low = bit - 1
        for i in range(dims):
            turned = (x[:, i] & bit) != 0
            swap = np.where(turned, 0, (x[:, 0] ^ x[:, i]) & low)
            x[:, 0] ^= np.where(turned, low, swap)
            x[:, i] ^= swap
        bit >>= 1
    for i in range(1, dims):
        x[:, i] ^= x[:, i - 1]
    flips = np.zeros(n, np.int64)
    bit = 1 << (bits - 1)
    while bit > 1:
        flips ^= np.where((x[:, -1] & bit) != 0, bit - 1, 0)
        bit >>= 1
    x ^= flips[:, None]
    place = np.zeros(n, np.int64)
    for b in reversed(range(bits)):
        for i in range(dims):
            place = place << 1 | (x[:, i] >> b & 1)
    return place


def shortlists(low: np.ndarray, high: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """(blocks, entries): whether an entry may be the nearest of a part inside the block's box."""
    below, above = low[:, None, :] - entries[None], entries[None] - high[:, None, :]
    least = (np.maximum(np.maximum(below, above), 0) ** 2).sum(axis=2)
    most = (np.maximum(np.abs(below), np.abs(above)) ** 2).sum(axis=2)
    return least <= most.min(axis=1, keepdims=True)


def nearest_entries(parts: np.ndarray, entries: np.ndarray, listed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of the nearest of the listed entries; ties go to the lower index."""
    away = ((parts[:, None, :] - entries[listed][None]) ** 2).sum(axis=2)
    best = away.argmin(axis=1)
    return listed[best], away[np.arange(len(parts)), best]


def _longs(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)


def _blocks(parts: DataFrame, dims: int) -> DataFrame:
    """(part, rows, data, low, high, sums, n): flat blocks of the parts of one position, neighbours on the curve together."""
    names = ["part", "rows", "data", "low", "high", "sums", "n"]

    def block(part: int, rows: np.ndarray, data: np.ndarray) -> list:
        return [part, rows.tobytes(), data.tobytes(), data.min(0).tolist(), data.max(0).tolist(), data.sum(0, dtype=np.int64).tolist(), len(rows)]

    kinds = [pa.int32(), pa.binary(), pa.binary(), *[pa.list_(pa.int64())] * 3, pa.int64()]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_part, held_rows, held_data = None, np.zeros(0, np.int64), np.zeros((0, dims), np.int32)

        def batch_of(blocks: list) -> pa.RecordBatch:
            columns = [pa.array(c, kind) for c, kind in zip(zip(*blocks, strict=True), kinds, strict=True)]
            return pa.RecordBatch.from_arrays(columns, names=names)

        for batch in batches:
            out = []
            all_parts = batch.column(0).to_numpy()
            all_rows = batch.column(1).to_numpy()
            all_data = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.int32).reshape(-1, dims)
            for part in np.unique(all_parts).tolist():
                mine = all_parts == part
                if held_part is not None and held_part != part and len(held_rows):
                    out.append(block(held_part, held_rows, held_data))
                    held_rows, held_data = held_rows[:0], held_data[:0]
                held_part = part
                rows, data = np.append(held_rows, all_rows[mine]), np.vstack([held_data, all_data[mine]])
                whole = len(rows) // BLOCK_ROWS * BLOCK_ROWS
                out += [block(part, rows[a : a + BLOCK_ROWS], data[a : a + BLOCK_ROWS]) for a in range(0, whole, BLOCK_ROWS)]
                held_rows, held_data = rows[whole:], data[whole:]
            if out:
                yield batch_of(out)
        if len(held_rows):
            yield batch_of([block(held_part, held_rows, held_data)])

    schema = "part int, rows binary, data binary, low array<long>, high array<long>, sums array<long>, n long"
    ordered = parts.repartitionByRange("part", "place", "row").sortWithinPartitions("part", "place", "row")
    return ordered.select("part", "row", "data").mapInArrow(cut, schema)


def _update(blocks: DataFrame, books: list[np.ndarray], dims: int) -> list[np.ndarray]:
    """The codebooks after one round. Tasks send one row for each part and entry."""

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(books), len(books[0]), dims), np.int64)
        counts = np.zeros(sums.shape[:2], np.int64)
        for batch in batches:
            part_of, n = batch.column(0).to_numpy(), batch.column(5).to_numpy()
            low, high, own = (_longs(batch.column(i), dims) for i in (2, 3, 4))
            for part, book in enumerate(books):
                mine = np.flatnonzero(part_of == part)
                listed = shortlists(low[mine], high[mine], book)
                for at, short in zip(mine, listed, strict=True):
                    short = np.flatnonzero(short)
                    if len(short) == 1:
                        sums[part, short[0]] += own[at]
                        counts[part, short[0]] += n[at]
                        continue
                    data = np.frombuffer(batch.column(1)[int(at)].as_py(), np.int32).reshape(-1, dims).astype(np.int64)
                    entry, _ = nearest_entries(data, book, short)
                    for e in short:
                        sums[part, e] += data[entry == e].sum(axis=0)
                        counts[part, e] += int((entry == e).sum())
        part, entry = np.nonzero(counts)
        columns = [pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(counts[part, entry])]
        columns.append(pa.array(sums[part, entry].tolist(), pa.list_(pa.int64())))
        yield pa.RecordBatch.from_arrays(columns, names=["part", "entry", "n", "sums"])

    slim = blocks.select("part", "data", "low", "high", "sums", "n")
    sent = slim.mapInArrow(totals, "part int, entry int, n long, sums array<long>")
    folded = sent.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(dims)])
    new = [book.copy() for book in books]
    for r in folded.collect():  # parts * entries rows at most
        new[r["part"]][r["entry"]] = [r[f"s{i}"] // r["n"] for i in range(dims)]
    return new


def _assigned(blocks: DataFrame, books: list[np.ndarray], dims: int) -> DataFrame:
    """(row, part, entry, away) of every part, for the final codebooks."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part_of = batch.column(0).to_numpy()
            low, high = (_longs(batch.column(i), dims) for i in (3, 4))
            for part, book in enumerate(books):
                mine = np.flatnonzero(part_of == part)
                listed = shortlists(low[mine], high[mine], book)
                rows, entries, away = [], [], []
                for at, short in zip(mine.tolist(), listed, strict=True):
                    data = np.frombuffer(batch.column(2)[at].as_py(), np.int32).reshape(-1, dims).astype(np.int64)
                    entry, distance = nearest_entries(data, book, np.flatnonzero(short))
                    rows.append(np.frombuffer(batch.column(1)[at].as_py(), np.int64))
                    entries.append(entry)
                    away.append(distance)
                if rows:
                    row = np.concatenate(rows)
                    columns = [row, np.full(len(row), part, np.int32), np.concatenate(entries).astype(np.int32), np.concatenate(away)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["row", "part", "entry", "away"])

    slim = blocks.select("part", "rows", "data", "low", "high")
    return slim.mapInArrow(assign, "row long, part int, entry int, away long")


def compress(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    label_col: str = "label",
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
) -> tuple[DataFrame, list[np.ndarray]]:
    """(id, code, error, label_error) of every row that takes part, and the final codebooks, one array a part position.

    A code has two hex digits for each part's entry. ``error`` is the squared distance in whole numbers, ``label_error`` its
    sum over the rows of the same label, nulls together. Codebooks begin with the parts of the ``entries`` smallest ids
    (null ids last, rows of one id by their components); with fewer rows there are fewer entries.

    Vectors that are null, empty, of another length than most, of a length that ``parts`` does not divide, or hold null or
    non-finite components take no part. Repeated rows each count. Components beyond the range where distances are exact
    in 64 bits (|x| of about 16,000 for parts of 8) are held at its ends. An empty table gives no row and no codebook. Other columns
    are ignored.
    """
    spark = vectors.sparkSession
    raw = vectors.select(vectors[id_col].alias("id"), vectors[label_col].alias("label"), vectors[vec_col].alias("vec"))
    good = raw.where(finite(F.col("vec")) & (F.size("vec") % parts == 0))
    widths = good.groupBy(F.size("vec").alias("width")).agg(F.count("*").alias("n"))
    shape = widths.orderBy(F.desc("n"), "width").first()
    fields = f"`{id_col}` {dict(raw.dtypes)['id']}, code string, error long, label_error long"
    if shape is None:
        return spark.createDataFrame([], fields), []
    width = shape["width"]
    dims = width // parts
    limit = (1 << ((58 - (dims - 1).bit_length()) // 2 - 1)) - 1
    numbers = good.where(F.size("vec") == width).select("id", "label", whole_numbers(F.col("vec"), limit).alias("vec"))
    kept = stage(numbers.withColumn("row", F.monotonically_increasing_id()), "codes-vectors")

    seeds = kept.orderBy(F.col("id").asc_nulls_last(), "vec").limit(entries).select("vec").collect()
    first = np.array([r["vec"] for r in seeds], np.int64).reshape(len(seeds), parts, dims)
    books = [first[:, p] for p in range(parts)]

    span = kept.agg(F.min(F.array_min("vec")).alias("low"), F.max(F.array_max("vec")).alias("high")).first()
    bits = max(1, min(16, 63 // dims))
    cells, base, reach = 1 << bits, span["low"], max(1, span["high"] - span["low"])

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            cut = _longs(batch.column(1), width).reshape(-1, parts, dims)
            for p in range(parts):
                mine = np.ascontiguousarray(cut[:, p], np.int32)
                curve = hilbert(((cut[:, p, :63] - base).astype(float) * (cells - 1) / reach).astype(np.int64), bits)
                stored = pa.array([x.tobytes() for x in mine], pa.binary())
                columns = [pa.array(np.full(len(mine), p, np.int32)), pa.array(curve), batch.column(0), stored]
                yield pa.RecordBatch.from_arrays(columns, names=["part", "place", "row", "data"])

    laid = kept.select("row", "vec").mapInArrow(lay, "part int, place long, row long, data binary")
    blocks = stage(_blocks(laid, dims), "codes-blocks")
    for _ in range(rounds):
        books = _update(blocks, books, dims)

    digits = [F.max(F.when(F.col("part") == p, F.lower(F.lpad(F.hex("entry"), 2, "0")))) for p in range(parts)]
    coded = _assigned(blocks, books, dims).groupBy("row").agg(F.concat(*digits).alias("code"), F.sum("away").alias("error"))
    named = stage(kept.select("row", "id", "label").join(coded, "row"), "codes-rows")
    sums = stage(named.groupBy("label").agg(F.sum("error").alias("label_error")), "codes-labels")
    out = join_hot(named, sums, "label", sums.count(), "row")
    return out.select(F.col("id").alias(id_col), "code", "error", "label_error"), books


def codebooks_text(books: list[np.ndarray]) -> str:
    """All entries' components by part, entry and position, comma-joined."""
    return ",".join(str(x) for book in books for x in book.reshape(-1).tolist())


def codebooks_digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(codebooks_text(books).encode()).hexdigest()
