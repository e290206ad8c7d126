"""Nearest vectors by inner product: low-dimensional stable projections in a kd-tree, with a chi-square stopping test.

Vectors get one more component that makes all norms equal, so the largest inner product is the smallest Euclidean
distance. Gaussian (2-stable) projections to a few dimensions turn a squared distance D^2 into D^2 times a chi-square
variable. Projected neighbours are verified in order of projected distance; once the next one lies so far out that a
vector nearer than the current k-th would be there with a probability of at most 1 - CONFIDENCE, the search stops.
"""

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from vaportrail.session import stage

DIMS = 32  # of the projection; even, for a closed form of the chi-square law
CONFIDENCE = 0.92  # of the stopping test; recall is measured, and lies above it
SAMPLE = 16_384  # vectors, about, that place the tree's cuts; every vector is indexed
LEAF_ROWS = 1024
MAX_LEAVES = 4096
# leaves a query visits in each round, nearest boxes first; the bound is tightened between rounds
ROUNDS = [(0, 1), (1, 9), (9, MAX_LEAVES)]
QUERIES = 4096  # that one task answers on one block of a leaf
ASKED = 256  # queries worked on together
STEP = 128  # vectors verified between two tests
SLACK = 1e-9  # of distances and scores computed by matrix products, relative to the largest norm


def chi_square_quantile(p: float, dims: int = DIMS) -> float:
    def below(x: float) -> float:
        half = x / 2
        return 1 - math.exp(-half) * sum(half**i / math.factorial(i) for i in range(dims // 2))

    low, high = 0.0, 1000.0
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if below(middle) < p else (low, middle)
    return high


def usable(vec: Column) -> Column:
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(vec, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _projection(width: int, dims: int) -> np.ndarray:
    return np.random.default_rng(64).standard_normal((width + 1, dims))


def _lifted(vectors: np.ndarray, largest: float) -> np.ndarray:
    rest = np.sqrt(np.maximum(0.0, largest - (vectors**2).sum(axis=1)))
    return np.column_stack([vectors, rest])


def grow_tree(points: np.ndarray, leaves: int) -> tuple[np.ndarray, np.ndarray]:
    """Cut dimensions and values of a balanced kd-tree, in heap order: medians of the widest dimension."""
    inner = leaves - 1
    dims, values = np.zeros(inner, np.int64), np.zeros(inner)
    members = {0: points}
    for node in range(inner):
        own = members.pop(node)
        if len(own):
            dims[node] = int(np.argmax(own.max(axis=0) - own.min(axis=0)))
            values[node] = np.median(own[:, dims[node]])
        right = own[:, dims[node]] > values[node]
        members[2 * node + 1], members[2 * node + 2] = own[~right], own[right]
    return dims, values


def leaf_of(points: np.ndarray, dims: np.ndarray, values: np.ndarray) -> np.ndarray:
    node = np.zeros(len(points), np.int64)
    for _ in range((len(dims) + 1).bit_length() - 1):
        right = points[np.arange(len(points)), dims[node]] > values[node]
        node = 2 * node + 1 + right
    return node - len(dims)


def _longs(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.int64))


def _lists(x: np.ndarray) -> pa.Array:
    return pa.array(list(x), pa.list_(pa.float64()))


def _index(vectors: DataFrame, largest: float, project: np.ndarray, tree: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(vec_id, vec, projected, leaf) of every vector."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                p = _lifted(_matrix(batch.column(1)), largest) @ project
                columns = [batch.column(0), batch.column(1), _lists(p), _longs(leaf_of(p, *tree))]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "vec", "projected", "leaf"])

    return vectors.mapInArrow(place, "vec_id long, vec array<double>, projected array<double>, leaf long")


class _Best:
    """The best ``k`` of each of some queries so far, by exact score, then smaller id."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.scores = np.full((n, k), -np.inf)
        self.ids = np.full((n, k), np.iinfo(np.int64).max)

    def kth(self) -> np.ndarray:
        return self.scores[:, -1]

    def add(self, row: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """Candidates as (query, id, score); those of a query stand together."""
        rows, first, n = np.unique(row, return_index=True, return_counts=True)
        width = int(n.max())
        at = np.repeat(np.arange(len(rows)), n), np.arange(len(row)) - np.repeat(first, n)
        more_scores = np.full((len(rows), width), -np.inf)
        more_ids = np.full((len(rows), width), np.iinfo(np.int64).max)
        more_scores[at], more_ids[at] = scores, ids
        all_scores, all_ids = np.hstack([self.scores[rows], more_scores]), np.hstack([self.ids[rows], more_ids])
        by_id = np.argsort(all_ids, axis=1, kind="stable")
        all_scores, all_ids = np.take_along_axis(all_scores, by_id, 1), np.take_along_axis(all_ids, by_id, 1)
        order = np.argsort(-all_scores, axis=1, kind="stable")[:, : self.k]
        self.scores[rows], self.ids[rows] = np.take_along_axis(all_scores, order, 1), np.take_along_axis(all_ids, order, 1)


def search_block(ids, vectors, points, q_ids, q_vectors, q_points, bounds, k: int, largest: float, stop_at: float) -> tuple[_Best, int]:
    """The best ``k`` of the vectors for each query, and the number of pairs verified.

    Vectors are taken in steps, in order of their least projected distance to any of the queries; after each step the bounds
    of the queries are tightened, and a query takes no part in a step that its stopping test rules out. Matrix products pick
    the pairs that may enter a result; their scores are then summed alike wherever the vectors stand, so equal vectors tie.
    """
    best, verified = _Best(len(q_ids), k), 0
    base = largest + (q_vectors**2).sum(axis=1)
    slack = SLACK * max(1.0, largest)
    away = (points**2).sum(axis=1)[None, :] + (q_points**2).sum(axis=1)[:, None] - 2 * q_points @ points.T
    closest = away.min(axis=0)
    for step in np.split(order := np.argsort(closest, kind="stable"), range(STEP, len(order), STEP)):
        # bounds: the k-th largest product found so far, -inf if there are fewer
        bound = np.maximum(bounds, best.kth())
        reach = stop_at * (base - 2 * bound) + slack * stop_at
        near = away[:, step] <= reach[:, None]
        asked = np.flatnonzero(near.any(axis=1))
        if not len(asked):
            continue
        near = near[asked] & (ids[step][None, :] != q_ids[asked][:, None])
        verified += int(near.sum())
        rough = q_vectors[asked] @ vectors[step].T
        row, column = np.nonzero(near & (rough >= bound[asked][:, None] - slack))
        if len(row):
            row, column = asked[row], step[column]
            best.add(row, ids[column], (vectors[column] * q_vectors[row]).sum(axis=1))
    return best, verified


def _search(k: int, largest: float, stop_at: float):
    """Answers a group's queries on a group's vectors."""

    def search(queries: pa.Table, data: pa.Table) -> pa.Table:
        out_q, out_v, out_s = [], [], []
        if queries.num_rows and data.num_rows:
            queries, data = queries.combine_chunks(), data.combine_chunks()
            ids, vectors = data["vec_id"].to_numpy(), _matrix(data["vec"].combine_chunks())
            points = _matrix(data["projected"].combine_chunks())
            q_ids, q_vectors = queries["query_id"].to_numpy(), _matrix(queries["q_vec"].combine_chunks())
            q_points, bounds = _matrix(queries["q_projected"].combine_chunks()), queries["kth"].to_numpy()
            for at in range(0, len(q_ids), ASKED):
                part = slice(at, at + ASKED)
                best, _ = search_block(
                    ids, vectors, points, q_ids[part], q_vectors[part], q_points[part], bounds[part], k, largest, stop_at
                )
                row, column = np.nonzero(best.scores > -np.inf)
                out_q.append(q_ids[part][row])
                out_v.append(best.ids[row, column])
                out_s.append(best.scores[row, column])
        join = lambda parts, kind: np.concatenate(parts).astype(kind) if parts else np.zeros(0, kind)
        return pa.table({"query_id": join(out_q, np.int64), "vec_id": join(out_v, np.int64), "score": join(out_s, np.float64)})

    return search


def _answers(visits: DataFrame, indexed: DataFrame, blocks: DataFrame, search) -> DataFrame:
    """Best vectors of (query, leaf) visits. Large leaves are dealt into blocks, and many queries into parts."""
    parts = visits.groupBy("leaf").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("parts"))
    # one row per leaf, MAX_LEAVES at most
    dealt = F.broadcast(blocks.join(parts, "leaf"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asked = (
        visits.join(dealt, "leaf")
        .withColumn("part", F.pmod(F.xxhash64("query_id"), F.col("parts")).cast("int"))
        .withColumn("block", every("blocks"))
        .select("leaf", "block", "part", "query_id", "q_vec", "q_projected", "kth")
    )
    held = (
        indexed.join(dealt, "leaf")
        .withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"))
        .withColumn("part", every("parts"))
        .select("leaf", "block", "part", "vec_id", "vec", "projected")
    )
    key = ["leaf", "block", "part"]
    return asked.groupBy(*key).cogroup(held.groupBy(*key)).applyInArrow(search, "query_id long, vec_id long, score double")


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def nearest(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 20,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    leaf_rows: int = LEAF_ROWS,
    confidence: float = CONFIDENCE,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query the ``k`` vectors of the largest inner product, itself left out.

    Scores are inner products of the original vectors in double precision; equal scores go by the smaller id. A true
    neighbour is missed with a probability of at most 1 - ``confidence``.

    A query is answered first in its own leaf, then in the next nearest boxes, then in all others that its k-th score so far
    leaves in reach. The tree's cuts come from about SAMPLE vectors; boxes come from all.

    Vectors that are null, zero, of another length than most, or hold null or non-finite components take no part, nor do
    null ids. Rows that repeat an id count once as a query, and one of them as a result. An empty table, and queries
    without any other vector, give no row. Other columns are ignored.
    """
    slim = lambda df: df.select(
        df[id_col].cast("long").alias("vec_id"), df[vec_col].cast("array<double>").alias("vec")
    ).where(F.col("vec_id").isNotNull() & usable(F.col("vec")))
    good = slim(vectors)
    spark = vectors.sparkSession
    norm = F.aggregate("vec", F.lit(0.0), lambda total, x: total + x * x)
    shapes = good.groupBy(F.size("vec").alias("width")).agg(F.count("*").alias("n"), F.max(norm).alias("largest"))
    shape = shapes.orderBy(F.desc("n"), "width").first()
    if shape is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    width, n, largest = shape
    good = good.where(F.size("vec") == width)
    project = _projection(width, DIMS)
    leaves = min(MAX_LEAVES, 1 << max(0, math.ceil(math.log2(max(1.0, n / leaf_rows)))))

    chosen = good.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < int(min(1.0, SAMPLE / n) * (1 << 30)))
    no_tree = (np.zeros(0, np.int64), np.zeros(0))
    placed = _index(chosen, largest, project, no_tree).select("projected").toArrow()["projected"].combine_chunks()
    sample = _matrix(placed) if len(placed) else np.zeros((0, DIMS))
    tree = grow_tree(sample, leaves)

    indexed = stage(_index(good, largest, project, tree), "nearest-index")
    corners = [f(F.get("projected", F.lit(i))).alias(f"{c}{i}") for c, f in (("lo", F.min), ("hi", F.max)) for i in range(DIMS)]
    boxes = indexed.groupBy("leaf").agg(F.count("*").alias("n"), *corners)
    boxes = boxes.orderBy("leaf").collect()  # one row per leaf, MAX_LEAVES at most
    leaf_ids = np.array([r["leaf"] for r in boxes])
    low = np.array([[r[f"lo{i}"] for i in range(DIMS)] for r in boxes])
    high = np.array([[r[f"hi{i}"] for i in range(DIMS)] for r in boxes])
    blocks = spark.createDataFrame([(r["leaf"], -(-r["n"] // leaf_rows)) for r in boxes], "leaf long, blocks int")
    stop_at = chi_square_quantile(confidence)

    asked = slim(queries).where(F.size("vec") == width).dropDuplicates(["vec_id"])

    def away(points: np.ndarray) -> np.ndarray:
        out = np.maximum(np.maximum(low - points[:, None, :], points[:, None, :] - high), 0.0)
        return (out**2).sum(axis=2)

    def onward(first: int, last: int):
        """The visits of a round: a query's leaves by box distance, as far as they are in reach."""

        def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 512):
                    part = batch.slice(at, 512)
                    bound = part.column(3).to_numpy(zero_copy_only=False)
                    box = away(_matrix(part.column(2)))
                    order = np.argsort(box, axis=1, kind="stable")[:, first:last]
                    reach = stop_at * (largest + (_matrix(part.column(1)) ** 2).sum(axis=1) - 2 * bound) + SLACK * stop_at
                    row, column = np.nonzero(np.take_along_axis(box, order, 1) <= reach[:, None])
                    taken = part.take(pa.array(row))
                    yield pa.RecordBatch.from_arrays([*taken.columns, _longs(leaf_ids[order[row, column]])], names=[*columns, "leaf"])

        return visit

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                v = _matrix(batch.column(1))
                p = np.column_stack([v, np.zeros(len(v))]) @ project
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _lists(p)], names=columns[:3])

    columns = ["query_id", "q_vec", "q_projected", "kth"]
    fields = "query_id long, q_vec array<double>, q_projected array<double>"
    projected = stage(asked.mapInArrow(ask, fields), "nearest-queries")
    search = _search(k, largest, stop_at)
    found = None
    for first, last in ROUNDS:
        if first >= len(boxes):
            break
        if found is None:
            bounded = projected.withColumn("kth", F.lit(float("-inf")))
        else:
            kth = found.where(F.col("rank") == k).select("query_id", F.col("score").alias("kth"))
            bounded = projected.join(kth, "query_id", "left").withColumn("kth", F.coalesce("kth", F.lit(float("-inf"))))
        visits = stage(bounded.select(*columns).mapInArrow(onward(first, last), f"{fields}, kth double, leaf long"), "nearest-visits")
        more = _answers(visits, indexed, blocks, search)
        if found is not None:
            both = found.drop("rank").unionByName(more)
            more = both.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        found = stage(_best(more, k), "nearest-found")
    return found.select("query_id", "rank", "vec_id", "score")
