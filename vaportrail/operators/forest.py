"""Isolation forest (Liu, Ting, Zhou 2008) as a table of tree nodes.

Each tree grows from at most 256 rows, so one tree is one small group and the whole forest at most
trees * (2 * 256 - 1) node rows, whatever the size of the training data.
"""

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from vaportrail.defaults import FOREST_SEED, FOREST_SUBSAMPLE, FOREST_TREES

NODE = (
    "tree int, node int, feature int, threshold double, left_node int, right_node int, size int, depth int"
)
EULER_GAMMA = 0.5772156649


def average_path(n):
    """Mean depth of an unsuccessful search among ``n`` items: the path a leaf of ``n`` rows stands for."""
    n = np.asarray(n, dtype=float)
    safe = np.maximum(n, 3)
    deep = 2.0 * (np.log(safe - 1.0) + EULER_GAMMA) - 2.0 * (safe - 1.0) / safe
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, deep))


def tree_samples(
    df: DataFrame, key: str, total: int, trees: int = FOREST_TREES, size: int = FOREST_SUBSAMPLE, seed: int = FOREST_SEED
) -> DataFrame:
    """``size`` rows per tree (all, if fewer), drawn for each tree on its own by a hash of row and tree.

    The rows are the same whatever the partitioning. A threshold on the hash leaves a few more than wanted, eight
    deviations of their number, so that only those are ranked: trees * size rows and some, however long the table is.
    """
    likely = min(1.0, (size + 8 * math.sqrt(size) + 64) / max(total, 1))
    drawn = lambda t: F.xxhash64(F.col(key), t, F.lit(seed))
    trees_of = F.filter(
        F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.pmod(drawn(t), F.lit(1 << 40)) <= F.lit(int(likely * (1 << 40)))
    )
    spread = df.withColumn("tree", F.explode(trees_of))
    order = Window.partitionBy("tree").orderBy(F.pmod(drawn(F.col("tree")), F.lit(1 << 40)), key)
    return spread.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= size).drop("_place")


def grow_forest(
    samples: DataFrame, key: str, features: list[str], size: int = FOREST_SUBSAMPLE, seed: int = FOREST_SEED
) -> DataFrame:
    """Node table from ``samples`` (columns: tree, key, features)."""
    limit = math.ceil(math.log2(max(size, 2)))

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key)
        tree, values = int(pdf["tree"].iloc[0]), pdf[features].to_numpy(dtype=float)
        rng = np.random.default_rng([seed, tree])
        nodes, open_nodes = [], [(0, np.arange(len(values)), 0)]
        next_id = 1
        while open_nodes:
            node, rows, depth = open_nodes.pop()
            low, high = values[rows].min(axis=0), values[rows].max(axis=0)
            usable = np.flatnonzero(high > low)
            if depth >= limit or len(rows) <= 1 or len(usable) == 0:
                nodes.append((tree, node, -1, 0.0, -1, -1, len(rows), depth))
                continue
            feature = int(rng.choice(usable))
            threshold = float(rng.uniform(low[feature], high[feature]))
            # rounding may reach the upper end, which would leave the right side empty
            threshold = min(threshold, float(np.nextafter(high[feature], low[feature])))
            goes_left = values[rows, feature] <= threshold
            nodes.append((tree, node, feature, threshold, next_id, next_id + 1, len(rows), depth))
            open_nodes.append((next_id, rows[goes_left], depth + 1))
            open_nodes.append((next_id + 1, rows[~goes_left], depth + 1))
            next_id += 2
        return pd.DataFrame(nodes, columns=[f.split()[0] for f in NODE.split(", ")])

    return samples.select("tree", key, *features).groupBy("tree").applyInPandas(grow, NODE)


def isolation(nodes: pd.DataFrame, size: int, columns: list[Column]) -> Column:
    """Negated isolation score of each row: near -1 for a row that separates early, about -0.5 for an average one."""
    nodes = nodes.sort_values(["tree", "node"])
    counts = nodes.groupby("tree").size()
    starts = (counts.cumsum() - counts).to_numpy()
    offset = np.repeat(starts, counts)
    feature = nodes["feature"].to_numpy()
    threshold = nodes["threshold"].to_numpy()
    child = np.stack([nodes["right_node"].to_numpy() + offset, nodes["left_node"].to_numpy() + offset])
    path = nodes["depth"].to_numpy() + average_path(nodes["size"])
    levels = int(nodes["depth"].max())
    scale = float(average_path(size))

    @F.pandas_udf("double")
    def score(*cols: pd.Series) -> pd.Series:
        x = np.column_stack([c.to_numpy(dtype=float) for c in cols])
        out = np.empty(len(x))
        for at in range(0, len(x), 4096):
            part = x[at : at + 4096]
            row = np.arange(len(part))[:, None]
            here = np.tile(starts, (len(part), 1))
            for _ in range(levels):
                split = feature[here]
                left = part[row, np.maximum(split, 0)] <= threshold[here]
                here = np.where(split < 0, here, child[left.astype(int), here])
            out[at : at + 4096] = -(2.0 ** (-path[here].mean(axis=1) / scale))
        return pd.Series(out)

    return score(*columns)
