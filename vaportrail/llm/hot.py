"""Joins of many rows with few on a key that may be hot."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 100_000
SALTS = 64


def join_hot(rows: DataFrame, few: DataFrame, key: str, n_few: int, spread: str) -> DataFrame:
    """``rows`` left-joined with ``few``, one row a key, nulls equal; ``spread`` is a column that tells rows apart.

    Up to BROADCAST_ROWS rows are broadcast. More are copied SALTS times, and the rows of a key go to SALTS places.
    """
    if n_few <= BROADCAST_ROWS:
        held = F.broadcast(few.withColumnRenamed(key, "_key"))
        return rows.join(held, rows[key].eqNullSafe(held["_key"]), "left").drop("_key")
    salted = few.withColumnRenamed(key, "_key").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    own = rows.withColumn("_own", F.pmod(F.xxhash64(spread), F.lit(SALTS)))
    return own.join(salted, own[key].eqNullSafe(salted["_key"]) & (own["_own"] == salted["_salt"]), "left").drop("_key", "_salt", "_own")
