"""Mixing sources to target weights by capped water-filling, with seeded whole and fractional repetitions."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from vaportrail.llm.words import WORD, word_count
from vaportrail.session import stage

WEIGHTS = [5, 2, 1]
MAX_EPOCHS = 3
SLICES = 4096  # of a source's documents in seeded order; three hex digits


def source_targets(sizes: DataFrame, weights: list[int] = WEIGHTS, share: float = 1.0, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, target) from per-document (source, size).

    Sources take ``weights`` in turn, in code point order, null last, and share ``share`` of all words. Filling stops at
    ``max_epochs`` times a source's size; what is beyond goes to the others by weight until none is above its cap. That
    fixed point is found in one pass: in order of cap / weight the sources before some place are full, and the others
    stand at one common level. Windows here see one row per source.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    weighed = totals.select(
        "source",
        "source_size",
        F.get(cycle, (F.row_number().over(in_order) - 1) % len(weights)).alias("weight"),
        (F.col("source_size") * F.lit(float(max_epochs))).alias("cap"),
    )
    by_fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    zero = F.lit(0.0)
    left = F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), zero)
    open_weight = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), zero)
    levels = weighed.withColumn("level", left / open_weight)
    # the first source that the level at its place does not fill sets the level of all after it
    stays = F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.col("level"))
    level = F.first(stays, ignorenulls=True).over(by_fill.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    target = F.coalesce(F.least(F.col("cap"), level * F.col("weight")), F.col("cap"))
    return levels.withColumn("target", target).select("source", "source_size", "target")


def _seeded(key: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))))


def _measured(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    """Adds _id, _source, _size and _place, the seeded place of a document in its source."""
    return docs.withColumns(
        {
            "_id": docs[id_col],
            "_source": docs[source_col],
            "_size": word_count(docs[text_col]),
            "_place": _seeded(docs[id_col], seed),
        }
    )


def _mix_ends(sizes: DataFrame, weights: list[int], share: float, max_epochs: int) -> DataFrame:
    """One row per source: its target, whole repetitions, and the slice in which the rest of the target is met.

    Running sums are taken over the slices of each source, so no task sorts a source.
    """
    # one row per source; few enough to sort, and written so that its readers know its size
    named = sizes.select(F.col("_source").alias("source"), F.col("_size").alias("size"))
    targets = stage(source_targets(named, weights, share, max_epochs), "mixing-targets")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    targets = targets.withColumn("whole", whole).withColumn(
        "rest", F.floor(F.col("target")).cast("long") - F.col("whole") * F.col("source_size")
    )
    slices = sizes.groupBy("_source", _slice().alias("slice")).agg(F.sum("_size").alias("slice_size"))
    before = Window.partitionBy("_source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    bases = slices.withColumn("base", F.coalesce(F.sum("slice_size").over(before), F.lit(0)))
    reached = F.when(F.col("base") <= F.col("rest"), F.struct("slice", (F.col("rest") - F.col("base")).alias("left")))
    ends = (
        bases.join(targets, bases["_source"].eqNullSafe(targets["source"]))
        .groupBy("source", "source_size", "target", "whole", "rest")
        .agg(F.max(reached).alias("end"))
    )
    return stage(ends.drop("rest"), "mixing-ends")


def _slice() -> Column:
    return F.substring("_place", 1, 3)


def _taken(measured: DataFrame, ends: DataFrame) -> DataFrame:
    """Adds source_size, target and _taken. Only documents of the slice where a source's rest ends are sorted."""
    keep = [F.col(c) for c in measured.columns]
    placed = measured.join(ends, measured["_source"].eqNullSafe(ends["source"])).select(
        *[measured[c] for c in measured.columns], "source_size", "target", "whole", "end"
    )
    whole = F.col("whole") * F.col("_size")
    in_end = Window.partitionBy("_source", "_cut").orderBy("_place", "_id", "_size")
    earlier = in_end.rowsBetween(Window.unboundedPreceding, -1)
    sure = placed.where(_slice() != F.col("end.slice")).withColumn(
        "_taken", whole + F.when(_slice() < F.col("end.slice"), F.col("_size")).otherwise(0)
    )
    left = F.col("end.left") - F.coalesce(F.sum("_size").over(earlier), F.lit(0))
    last = (
        placed.where(_slice() == F.col("end.slice"))
        .withColumn("_cut", _slice())
        .withColumn("_taken", whole + F.greatest(F.lit(0), F.least(F.col("_size"), left)))
    )
    out = [*keep, F.col("source_size").alias("_source_size"), F.col("target").alias("_target"), F.col("_taken")]
    return sure.select(*out).unionByName(last.select(*out))


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: list[int] = WEIGHTS,
    share: float = 1.0,
    max_epochs: int = MAX_EPOCHS,
    seed: int = 0,
) -> DataFrame:
    """(id, size, source_size, target, taken) of every row; ``taken`` counts words, repeats included.

    With r = target / source_size every document is taken floor(r) times whole. The rest of the target goes to documents
    in an order seeded by ``seed`` and the id: each is taken once more until the target is met, the last one in part. A
    source's taken words thus equal its target rounded down, no document is taken more than ``max_epochs`` times, and
    equal inputs give equal mixes.

    Null texts have size 0 and are taken 0 words; rows without source form a source of their own, the last; repeated
    rows are separate documents; an empty table gives none; other columns are ignored.
    """
    slim = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"), docs[source_col].alias("source"))
    sizes = stage(_measured(slim, "id", "text", "source", seed).drop("id", "text", "source"), "mixing-sizes")
    mixed = _taken(sizes, _mix_ends(sizes, weights, share, max_epochs))
    return mixed.select(
        F.col("_id").alias(id_col),
        F.col("_size").alias("size"),
        F.col("_source_size").alias("source_size"),
        F.col("_target").alias("target"),
        F.col("_taken").alias("taken"),
    )


def take_mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: list[int] = WEIGHTS,
    share: float = 1.0,
    max_epochs: int = MAX_EPOCHS,
    seed: int = 0,
) -> DataFrame:
    """The mix of :func:`mix_sources` itself: a document's row once for each whole repetition, and its first words for a
    part of one. Documents of which nothing is taken go.

    Adds ``epoch``, counted from 0, and ``epoch_words``; columns of these names are replaced. Texts are not shuffled,
    but for the slices in which targets are met.
    """
    measured = _measured(docs.drop("epoch", "epoch_words"), id_col, text_col, source_col, seed)
    sizes = stage(measured.select("_id", "_source", "_size", "_place"), "mixing-sizes")
    mixed = _taken(measured, _mix_ends(sizes, weights, share, max_epochs)).where(F.col("_taken") > 0)
    size = F.col("_size")
    rows = mixed.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("(_taken - 1) div _size"))))
    words = F.least(size, F.col("_taken") - F.col("epoch") * size)
    part = F.array_join(F.slice(F.regexp_extract_all(text_col, F.lit(f"({WORD})"), 1), F.lit(1), words.cast("int")), " ")
    return rows.withColumns(
        {"epoch_words": words, text_col: F.when(words < size, part).otherwise(F.col(text_col))}
    ).drop("_id", "_source", "_size", "_place", "_source_size", "_target", "_taken")
