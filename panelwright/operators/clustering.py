"""Average linkage cut at a threshold: families fall into components of near pairs, and each is merged by updated distances."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .evidence import small_components

#: Means that are equal but for the order of their sums count as equal.
TIE = 1e-12


def merge(d: np.ndarray, threshold: float) -> np.ndarray:
    """The first member of each item's cluster, from a symmetric matrix of distances (infinite: unknown).

    Two clusters stand at the mean of their members' distances, which follows from the two merged ones by their sizes. Each
    row keeps its nearest later cluster, so a merge costs a pass over one row and over those whose nearest one is gone.
    Ties go to the pair whose first members come first.
    """
    n = len(d)
    d = d.astype(float)
    np.fill_diagonal(d, np.inf)
    size, own, live = np.ones(n), np.arange(n), np.ones(n, bool)
    near, who = np.full(n, np.inf), np.zeros(n, np.int64)

    def look(i):
        if live[i] and i + 1 < n:
            x = d[i, i + 1 :]
            low = x.min()
            near[i], who[i] = low, i + 1 + (int(np.argmax(x <= low + TIE)) if np.isfinite(low) else 0)
        else:
            near[i] = np.inf

    for i in range(n):
        look(i)
    while n > 1:
        low = near.min()
        if not low <= threshold + TIE:
            break
        i = int(np.argmax(near <= low + TIE))
        j = int(who[i])
        row = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
        row[[i, j]] = np.inf
        d[i], d[:, i], d[j], d[:, j] = row, row, np.inf, np.inf
        size[i] += size[j]
        live[j], near[j] = False, np.inf
        own[own == j] = i
        look(i)
        for k in np.flatnonzero(live[:j] & ((who[:j] == i) | (who[:j] == j) | (np.append(d[:i, i], np.full(j - i, np.inf)) <= near[:j] + TIE))).tolist():
            if k != i:
                look(k)
    return own


def _cut(threshold: float):
    def run(table: pa.Table) -> pa.Table:
        left, right = table.column("left_id").to_pylist(), table.column("right_id").to_pylist()
        ids = sorted({*left, *right})
        place = {x: k for k, x in enumerate(ids)}
        d = np.full((len(ids), len(ids)), np.inf)
        a, b = np.array([place[x] for x in left]), np.array([place[x] for x in right])
        d[a, b] = d[b, a] = table.column("distance").to_numpy()
        own = merge(d, threshold)
        return pa.table({"family": pa.array([table.column("family")[0].as_py()] * len(ids), pa.string()), "id": ids, "cluster": [ids[k] for k in own]})

    return run


def average_linkage(distances: DataFrame, threshold: float) -> DataFrame:
    """(family, id, cluster): average linkage of each family's (left_id, right_id, distance) cut at the threshold; a cluster
    has the name of its first member.

    A mean is at most the threshold only if one of its pairs is, so clusters lie within the components of near pairs: those
    are found by joins, and each component is one group with a matrix of its ids. A pair that is not given keeps the two
    apart. Rows of one pair must agree; an id without a near pair is a cluster of its own.
    """
    pair = lambda c: F.struct(F.col("family").alias("f"), F.col(c).alias("i"))
    d = distances.select("family", pair("left_id").alias("left_id"), pair("right_id").alias("right_id"), "distance")
    nodes = d.select(F.col("left_id").alias("id")).unionByName(d.select(F.col("right_id").alias("id"))).distinct()
    labels = small_components(nodes, d.filter(F.col("distance") <= threshold + TIE).select("left_id", "right_id"))
    sizes = labels.groupBy("label").agg(F.count("*").alias("n"))
    labels = labels.join(sizes, "label")
    alone = labels.filter("n = 1").select(F.col("id.f").alias("family"), F.col("id.i").alias("id"), F.col("id.i").alias("cluster"))
    of = lambda c: labels.filter("n > 1").select(F.col("id").alias(c), F.col("label").alias(f"_{c}"))
    inner = d.join(of("left_id"), "left_id").join(of("right_id"), "right_id").filter(F.col("_left_id") == F.col("_right_id"))
    inner = inner.select("family", F.col("_left_id").alias("_label"), F.col("left_id.i").alias("left_id"), F.col("right_id.i").alias("right_id"), "distance")
    return inner.groupBy("_label").applyInArrow(_cut(threshold), "family string, id string, cluster string").unionByName(alone)
