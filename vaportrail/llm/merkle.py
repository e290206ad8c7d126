"""A Merkle manifest of a dataset: a tree of digests per source, a tree over the sources, and a proof for every row.

The trees are worked by time-forward processing. A node's label is its level and its place in the level. An ordered queue
holds the digests on their way up: the smallest label is taken out, the digests of one run become their parent's, and that is
sent on to a larger label. A reversed sweep over the same nodes then sends proofs down: a node hands its own proof to its
children, each behind that child's siblings.

The queue is external: it is cut at every HEIGHT levels. A subtree of that height is one group of at most 3^HEIGHT slim rows,
worked with a queue in memory; what it sends further up travels as a written table to the next round, which has one row where
this one had 3^HEIGHT. Proofs come back down by the same tables.
"""

import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vaportrail.session import stage

ARITY = 3
HEIGHT = 6  # levels that one group works: 729 rows at most
PROOF = "array<struct<place:int,siblings:array<string>>>"
_STEP = pa.struct([("place", pa.int32()), ("siblings", pa.list_(pa.string()))])


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def field(value: Column) -> Column:
    """A value as the leaf holds it: ``-`` for null, else its length in UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    return digest(F.concat(*[field(v) for v in values]))


def _parent(children: list[str]) -> str:
    return hashlib.sha256("".join(children).encode()).hexdigest()


def forward(digests: list[str], height: int) -> list[list[str]]:
    """The digests of all levels of a subtree, from its leaves to its top.

    The queue hands nodes out in order of their label, so the up to ARITY children of a node come one after the other.
    """
    queue = [(0, place, d) for place, d in enumerate(digests)]  # already a heap: it is sorted
    levels: list[list[str]] = [[] for _ in range(height + 1)]
    run: list[str] = []
    while queue:
        level, place, own = heapq.heappop(queue)
        levels[level].append(own)
        if level == height:
            continue
        run.append(own)
        if len(run) == ARITY or not queue or queue[0][0] != level:
            heapq.heappush(queue, (level + 1, place // ARITY, _parent(run)))
            run = []
    return levels


def backward(levels: list[list[str]]) -> list[list[tuple[int, list[str]]]]:
    """The proof of each leaf up to the subtree's top: (place in the run, the run's others) level by level."""
    proofs: list[list] = [[]]
    for level in reversed(levels[:-1]):
        below = []
        for place, _ in enumerate(level):
            first, own = place - place % ARITY, place % ARITY
            run = level[first : first + ARITY]
            below.append([(own, run[:own] + run[own + 1 :]), *proofs[place // ARITY]])
        proofs = below
    return proofs


def levels_of(n: int) -> int:
    """Levels above ``n`` leaves until one node is left."""
    height = 0
    while n > 1:
        n, height = -(-n // ARITY), height + 1
    return height


def _block() -> Column:
    return F.expr(f"place div {ARITY**HEIGHT}").alias("block")


def _raise(rows: DataFrame) -> DataFrame:
    """(tree, place, digest, n) of the subtrees' tops from the (tree, place, digest, n) of their leaves."""

    def work(group: pa.Table) -> pa.Table:
        group = group.sort_by("place")
        n, first = group["n"][0].as_py(), group["place"][0].as_py()
        top = forward(group["digest"].to_pylist(), min(HEIGHT, levels_of(n)))[-1]
        size = ARITY**HEIGHT
        return pa.table(
            {
                "tree": group["tree"].slice(0, 1),
                "place": pa.array([first // size], pa.int64()),
                "digest": pa.array(top, pa.string()),
                "n": pa.array([-(-n // size)], pa.int64()),
            }
        )

    blocked = rows.select("tree", "place", "digest", "n", _block())
    return blocked.groupBy("tree", "block").applyInArrow(work, "tree string, place long, digest string, n long")


def _lower(rows: DataFrame, above: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of ``rows`` with the subroot, root and whole proof; ``above`` has those of the subtrees' tops."""
    kinds = ", ".join(f"`{c}` {kind}" for c, kind in rows.dtypes if c in keep)
    names = [c for c in rows.columns if c in keep]
    # one row of ``above`` for each block, and a block is bounded: no key is hot
    upper = above.select("tree", F.col("place").alias("block"), "subroot", "root", "proof")
    needed = dict.fromkeys(["tree", "place", "digest", "n", *names])
    blocked = rows.select(*needed, _block()).join(upper, ["tree", "block"])

    def work(group: pa.Table) -> pa.Table:
        group = group.sort_by("place")
        levels = forward(group["digest"].to_pylist(), min(HEIGHT, levels_of(group["n"][0].as_py())))
        rest = group["proof"][0].as_py()
        proofs = [[{"place": p, "siblings": s} for p, s in proof] + rest for proof in backward(levels)]
        columns = {c: group[c] for c in [*names, "subroot", "root"]}
        return pa.table(columns | {"proof": pa.array(proofs, pa.list_(_STEP))})

    return blocked.groupBy("tree", "block").applyInArrow(work, f"{kinds}, subroot string, root string, proof {PROOF}")


def raised(leaves: DataFrame, largest: int) -> list[DataFrame]:
    """The rounds from the leaves (tree, place, digest, n) to one row a tree; ``largest`` is the largest tree's ``n``."""
    rounds = [leaves]
    while True:
        rounds.append(stage(_raise(rounds[-1]), "merkle-tops"))
        if largest <= ARITY**HEIGHT:
            return rounds
        largest = -(-largest // ARITY**HEIGHT)


def lowered(rounds: list[DataFrame], above: DataFrame, keep: list[str]) -> DataFrame:
    """The sweep back: ``keep``, subroot, root and proof of every leaf of ``rounds``."""
    for rows in reversed(rounds[1:-1]):
        above = stage(_lower(rows, above, ["tree", "place"]), "merkle-proofs")
    return _lower(rounds[0], above, keep)


def placed(rows: DataFrame, group: str, order: list[Column]) -> DataFrame:
    """``rows`` with their ``place`` from 0 in their group, in ``order``, and the group's number of rows ``n``.

    Rows are sorted by ranges over all groups, so a group of any size is spread; each range is counted, and what lies before
    it is added up over the ranges of a group.
    """

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, last, at = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            local = []
            for key in batch.column(batch.schema.get_field_index(group)).to_pylist():
                at = at + 1 if key == last else 0
                last = key
                local.append(at)
            extra = [pa.array([task] * len(local), pa.int64()), pa.array(local, pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[*batch.schema.names, "range", "local"])

    kinds = ", ".join(f"`{c}` {kind}" for c, kind in rows.dtypes)
    ordered = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    numbered = stage(ordered.mapInArrow(number, f"{kinds}, range long, local long"), "merkle-places")
    counts = numbered.groupBy(group, "range").agg(F.count("*").alias("c"))
    # a group has at most one row for each range
    window = Window.partitionBy(group)
    before = F.sum("c").over(window.orderBy("range")) - F.col("c")
    counts = counts.select(group, "range", before.alias("before"), F.sum("c").over(window).alias("n"))
    place = (F.col("local") + F.col("before")).alias("place")
    return numbered.join(counts, [group, "range"]).select(*rows.columns, place, "n")


def manifest(rows: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, source, ``carry``..., leaf, subroot, root, proof) of every row of (doc_id, source, leaf, ``carry``...).

    Leaves of a source ascend by doc_id (nulls first; rows of one id by their leaf, so equal rows are interchangeable); sources
    ascend by their UTF-8 bytes, null first. While several nodes are left, every three consecutive ones (the last run: fewer,
    even one) become the digest of their digests; a lone leaf is itself its source's subroot. The subroots become the root in
    the same way. ``proof`` leads from the leaf over the subroot to the root: its place in each run, and the run's others.

    A source, or equal rows, may have any share of all rows. An empty table gives no row. Other columns are ignored.
    """
    spark = rows.sparkSession
    # a text that orders like the source and has no null
    tree = F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))
    slim = rows.select("doc_id", "source", "leaf", *carry, tree.alias("tree"), F.monotonically_increasing_id().alias("row"))
    slim = stage(slim, "merkle-rows")
    leaves = placed(slim, "tree", [F.col("doc_id").asc_nulls_first(), F.col("leaf"), F.col("row")])
    leaves = stage(leaves.withColumnRenamed("leaf", "digest").drop("row"), "merkle-leaves")
    rounds = raised(leaves, leaves.agg(F.max("n")).first()[0] or 0)

    sources = stage(rounds[-1].select("tree", "digest"), "merkle-subroots")
    forest = placed(sources.select(F.lit("").alias("tree"), F.col("tree").alias("source"), "digest"), "tree", [F.col("source")])
    forest = stage(forest, "merkle-sources")
    above_all = raised(forest, forest.count())
    root = above_all[-1].select("digest").first()
    if root is None:
        return rows.select("doc_id", "source", *carry, "leaf", *[F.lit(None).cast("string").alias(c) for c in ("subroot", "root")],
                           F.lit(None).cast(PROOF).alias("proof")).limit(0)
    top = spark.createDataFrame([("", 0, None, root[0], [])], f"tree string, place long, subroot string, root string, proof {PROOF}")
    tops = lowered(above_all, top, ["source", "digest"])
    tops = tops.select(F.col("source").alias("tree"), F.lit(0).cast("long").alias("place"), F.col("digest").alias("subroot"), "root", "proof")
    whole = lowered(rounds, stage(tops, "merkle-roots"), ["doc_id", "source", *carry, "digest"])
    return whole.select("doc_id", "source", *carry, F.col("digest").alias("leaf"), "subroot", "root", "proof")


def fold(own: Column, proof: Column) -> Column:
    """The root that a leaf and a proof lead to."""
    side = lambda step, first, n: F.array_join(F.slice(step["siblings"], first, n), "")
    return F.aggregate(
        proof,
        own,
        lambda d, step: digest(
            F.concat(side(step, F.lit(1), step["place"]), d, side(step, step["place"] + 1, F.lit(ARITY)))
        ),
    )


def proof_text(proof: Column) -> Column:
    """All siblings of a proof, from the leaf up, left to right."""
    return F.array_join(F.flatten(F.transform(proof, lambda step: step["siblings"])), "")
