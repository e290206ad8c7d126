"""Chat formatting: logged conversations that are cumulative snapshots of longer ones go, the others are rendered.

DataFrame functions only.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from vaportrail.session import stage

SPAN = 1024  # turns whose places are counted together; a part of a rendering holds as many at most


def _turn_hashes(place: Column) -> list[Column]:
    """Two independent 64-bit hashes of a turn at its place."""
    said = [F.coalesce(F.col(c), F.lit("")) for c in ("role", "text")]
    nulls = [F.col(c).isNull() for c in ("role", "text")]
    return [F.xxhash64(F.lit(salt), place, *said, *nulls).alias(name) for salt, name in ((1, "h1"), (2, "h2"))]


def _placed(turns: DataFrame) -> DataFrame:
    """Adds ``place``, the number of earlier turns of the conversation, and ``span``, its place in spans of turns.

    Turns are counted in spans of their number, so a conversation of any length is sorted span by span.
    """
    spanned = turns.withColumn("_span", F.floor(F.coalesce(F.col("turn"), F.lit(-1)) / SPAN))
    sizes = spanned.groupBy("conv_id", "_span").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("conv_id").orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("conv_id", "_span", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("conv_id", "_span").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    return (
        spanned.withColumn("_in", F.row_number().over(inside) - 1)
        .join(bases, ["conv_id", "_span"])
        .withColumn("place", F.col("_base") + F.col("_in"))
        .withColumn("span", F.expr(f"place div {SPAN}"))
        .drop("_span", "_base", "_in")
    )


def _prefixes(placed: DataFrame) -> DataFrame:
    """(conv_id, length, p1, p2): the rolling hash of every prefix, an exclusive-or of the hashes of turns at places."""
    hashed = placed.select("conv_id", "span", "place", *_turn_hashes(F.col("place")))
    totals = hashed.groupBy("conv_id", "span").agg(F.bit_xor("h1").alias("t1"), F.bit_xor("h2").alias("t2"))
    earlier = Window.partitionBy("conv_id").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    bases = totals.select(
        "conv_id", "span", *[F.coalesce(F.bit_xor(f"t{i}").over(earlier), zero).alias(f"b{i}") for i in (1, 2)]
    )
    so_far = Window.partitionBy("conv_id", "span").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rolling = [F.bit_xor(f"h{i}").over(so_far).alias(f"r{i}") for i in (1, 2)]
    return (
        hashed.select("conv_id", "span", "place", *rolling)
        .join(bases, ["conv_id", "span"])
        .select("conv_id", (F.col("place") + 1).alias("length"), *[F.col(f"r{i}").bitwiseXOR(F.col(f"b{i}")).alias(f"p{i}") for i in (1, 2)])
    )


def maximal(prefixes: DataFrame) -> DataFrame:
    """(conv_id, n_turns, copies) of conversations that are no prefix of a longer one; of equal ones the smallest id.

    Both sides of the anti-join are one row per distinct prefix, however many conversations begin alike.
    """
    lengths = prefixes.groupBy("conv_id").agg(F.max("length").alias("n_turns"))
    joined = prefixes.join(lengths, "conv_id")
    key = ["length", "p1", "p2"]
    whole = (
        joined.where("length = n_turns").groupBy(*key).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("copies"))
    )
    longer = joined.where("length < n_turns").select(*key).distinct()
    return whole.join(longer, key, "left_anti").select("conv_id", F.col("length").alias("n_turns"), "copies")


def render_turn(role: Column, text: Column) -> Column:
    """One turn between the usual markers; markers inside a text are broken up, so turns cannot be forged."""
    said = F.regexp_replace(F.coalesce(text, F.lit("")), r"<\|(im_start|im_end)\|>", "< |$1| >")
    speaker = F.coalesce(F.nullif(F.regexp_replace(role, r"[^A-Za-z_]", ""), F.lit("")), F.lit("unknown"))
    return F.concat(F.lit("<|im_start|>"), speaker, F.lit("\n"), said, F.lit("<|im_end|>\n"))


def format_chats(
    turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """(conv_id, part, n_turns, copies, rendered) of every maximal conversation.

    A log writes a conversation again each time it grows. A conversation whose turns (role and text, in order) begin a
    longer one is such a snapshot and goes; of equal conversations the smallest id stays, and ``copies`` counts them.
    ``part`` numbers from 0 the pieces of SPAN turns of a long conversation; ``n_turns`` is that of the whole one.

    Turns are ordered by number, null first, equal numbers by role and text, so repeated rows are turns of their own.
    Null texts are rendered empty but differ from empty ones, null or odd roles as "unknown". Rows without conversation
    id are left out; an empty table gives none; other columns are ignored.
    """
    named = turns.where(turns[id_col].isNotNull()).select(
        turns[id_col].alias("conv_id"), turns[turn_col].cast("long").alias("turn"), turns[role_col].alias("role"), turns[text_col].alias("text")
    )
    placed = _placed(named)
    kept = stage(maximal(stage(_prefixes(placed), "chat-prefixes")), "chat-kept")
    rendered = (
        placed.join(kept, "conv_id")
        .groupBy("conv_id", "span", "n_turns", "copies")
        .agg(F.array_sort(F.collect_list(F.struct("place", render_turn(F.col("role"), F.col("text")).alias("said")))).alias("turns"))
    )
    return rendered.select(
        F.col("conv_id").alias(id_col),
        F.col("span").alias("part"),
        "n_turns",
        "copies",
        F.array_join(F.col("turns.said"), "").alias("rendered"),
    )
