"""Authors in clusters of like totals."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def best_clusters(values: np.ndarray, weights: np.ndarray, k: int) -> list[tuple[float, float]]:
    """(last value, centre) of at most k clusters of sorted distinct values, with the least sum of
    squared distances there is; of equal ones the one with the earliest bounds."""
    n, k = len(values), min(k, len(values))
    shift = float(np.average(values, weights=weights)) if n else 0.0
    x = values - shift
    w, s, q = (np.concatenate([[0.0], np.cumsum(weights * x**p)]) for p in (0, 1, 2))

    def cost(i: np.ndarray, j: int) -> np.ndarray:
        """Of the clusters from value i to before value j."""
        return q[j] - q[i] - (s[j] - s[i]) ** 2 / (w[j] - w[i])

    best = np.array([0.0] + [float(cost(np.array([0]), j)[0]) for j in range(1, n + 1)])
    splits = []
    for _ in range(1, k):
        now, at = np.full(n + 1, np.inf), np.zeros(n + 1, np.int64)
        # the best split moves up with j, so each half of the values searches its part alone
        left = [(1, n, 1, n)] if n else []
        while left:
            low, high, first, last = left.pop()
            j = (low + high) // 2
            i = np.arange(min(first, j), min(last, j - 1) + 1)
            i = i[i >= 1]
            if len(i):
                total = best[i] + cost(i, j)
                pick = int(np.argmin(total))
                now[j], at[j] = total[pick], i[pick]
                first_right = last_left = int(i[pick])
            else:
                first_right, last_left = first, last
            if low < j:
                left.append((low, j - 1, first, last_left))
            if j < high:
                left.append((j + 1, high, first_right, last))
        splits.append(at)
        best = now
    out, j = [], n
    for at in reversed(splits):
        i = int(at[j])
        out.append((float(values[j - 1]), float(shift + (s[j] - s[i]) / (w[j] - w[i]))))
        j = i
    if n:
        out.append((float(values[j - 1]), float(shift + s[j] / w[j])))
    return out[::-1]


def cluster_authors(totals: DataFrame, k: int = 3, verb: str = "owns") -> DataFrame:
    """totals (author_name, total) with cluster_value, cluster_name: the best k-means on one dimension.

    As many clusters as distinct totals at most. Authors with equal totals are one weighted value;
    the distinct totals, no more than there are authors, are solved in one task.
    """
    values = totals.groupBy("total").agg(F.count("*").alias("n")).select(F.lit(1).alias("one"), "total", "n")

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("total")
        return pd.DataFrame(best_clusters(rows.total.to_numpy(np.float64), rows.n.to_numpy(np.float64), k), columns=["last", "centre"])

    # one row with the bounds of k clusters
    bounds = values.groupBy("one").applyInPandas(solve, "last double, centre double").agg(F.sort_array(F.collect_list(F.struct("last", "centre"))).alias("bounds"))
    mine = F.get(F.filter("bounds", lambda b: b["last"] >= F.col("total")), F.lit(0))["centre"]
    value = F.floor(mine).cast("bigint")
    marked = totals.join(F.broadcast(bounds)).withColumn("cluster_value", value)
    return marked.select("author_name", "total", "cluster_value", F.concat(F.lit(f"Authors that {verb} ~"), F.col("cluster_value").cast("string"), F.lit(" lines")).alias("cluster_name"))


def cluster_lines(clusters: DataFrame, names: int = 4) -> DataFrame:
    """cluster_name, cluster_value, text: the first names by total, then how many more."""
    w = Window.partitionBy("cluster_value").orderBy(F.col("total").desc(), "author_name")
    placed = clusters.withColumn("place", F.row_number().over(w))
    agg = placed.groupBy("cluster_name", "cluster_value").agg(F.sort_array(F.collect_list(F.when(F.col("place") <= names, F.struct("place", "author_name")))).alias("first"), F.count("*").alias("n"))
    more = F.when(F.col("n") > names, F.concat(F.lit("... (+"), (F.col("n") - names).cast("string"), F.lit(")"))).otherwise("")
    return agg.select("cluster_name", "cluster_value", F.concat(F.array_join(F.transform("first", lambda x: x["author_name"]), ", "), more).alias("text"))
