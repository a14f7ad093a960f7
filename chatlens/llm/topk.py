"""Exact top-k inner products by no-random-access aggregation.

Each component has a list of the block's vectors sorted by its value. A query
reads every list from the end that its own component prefers, and all lists
to the same depth. At each depth, a candidate's score lies between

* lower: the parts read so far, and for each list where it is not yet read the
  least contribution that the list holds;
* upper: the same with the contribution at the depth reached, since whatever is
  unread there contributes no more.

A candidate whose upper bound is below the k-th lower bound is out, and the
query stops when those left are as few as the answer or the lists are at their
end. The scores of those left are then resolved exactly, in integers.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block of candidates, and of a block of queries.
CANDIDATES, QUERIES = 4096, 512
#: Shares of the lists' length at which the bounds are compared.
DEPTHS = (0.25, 0.5, 0.75)


def nra_block(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, k: int,
              depths=DEPTHS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, candidate row, score) of each query's k best in this block,
    ties to the smaller id. ``ids`` may repeat; a query meets no row of its own id."""
    n, _ = x.shape
    order = np.argsort(x, axis=0, kind="stable")
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(n)[:, None], axis=0)
    sorted_x = np.take_along_axis(x, order, axis=0)
    up, down = np.maximum(q, 0.0), np.minimum(q, 0.0)
    own = query_ids[:, None] == ids[None, :]
    alive = ~own
    left = np.arange(len(q))
    # bounds are sums of doubles: a margin above their rounding keeps every tie in
    slack = 1e-9 * (np.abs(q).sum(1) * max(1.0, np.abs(x).max(initial=0)) + 1)
    for share in depths:
        depth = int(share * n)
        if depth < 1 or not len(left) or n <= k:
            break
        from_top, from_bottom = rank >= n - depth, rank < depth
        a, b, at = up[left], down[left], slack[left, None]
        read = a @ np.where(from_top, x, 0).T + b @ np.where(from_bottom, x, 0).T
        unread_top, unread_bottom = (~from_top).T.astype(float), (~from_bottom).T.astype(float)
        lower = read + (a * sorted_x[0]) @ unread_top + (b * sorted_x[-1]) @ unread_bottom
        upper = read + (a * sorted_x[n - depth]) @ unread_top + (b * sorted_x[depth - 1]) @ unread_bottom
        lower[~alive[left]] = -np.inf
        kth = np.partition(lower, n - k, axis=1)[:, n - k, None]
        alive[left] &= upper >= kth - 2 * at
        left = left[alive[left].sum(1) > k]
    rows, cols = np.nonzero(alive)
    scores = np.empty(len(rows), np.int64)
    qi, xi = q.astype(np.int64), x.astype(np.int64)
    for i in range(0, len(rows), 1 << 16):
        s = slice(i, i + (1 << 16))
        scores[s] = np.einsum("ij,ij->i", qi[rows[s]], xi[cols[s]])
    best = np.lexsort((ids[cols], -scores, rows))
    rows, cols, scores = rows[best], cols[best], scores[best]
    first = np.r_[0, np.flatnonzero(np.diff(rows)) + 1] if len(rows) else np.zeros(0, int)
    nth = np.arange(len(rows)) - np.repeat(first, np.diff(np.r_[first, len(rows)]))
    keep = nth < k
    return rows[keep], cols[keep], scores[keep]


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id, v``: rows with an id and a vector of finite components, each floor(256 x) as double."""
    v = F.col(vector_col)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (vectors.filter(F.col(id_col).isNotNull() & v.isNotNull() & F.coalesce(finite, F.lit(False)))
            .select(F.col(id_col).cast("long").alias("id"),
                    F.transform(v, lambda x: F.floor(x.cast("double") * 256).cast("double")).alias("v")))


def topk_inner_product(vectors: DataFrame, is_query, k: int = 5, id_col: str = "vec_id",
                       vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's ``k`` highest integer inner products.

    ``is_query`` is a condition on the column ``id``. Ties go to the smaller id;
    a query with fewer than ``k`` candidates gets them all. Null vectors, those that
    hold a null or a component that isn't finite, and null ids take no part. Vectors
    meet only vectors of the same length. A repeated row is a candidate each time; a
    repeated query is answered once. Scores must fit a 64-bit integer. Other
    columns are ignored.

    Candidates and queries are dealt into blocks by a hash of the id. Each
    pair of blocks is one group, whose size doesn't depend on the data: block numbers
    come from the counts. Each gives at most ``k`` rows a query, and the ranks
    are taken over those.
    """
    rows = usable(vectors, id_col, vector_col).withColumn("dim", F.size("v"))
    queries = rows.filter(is_query).dropDuplicates(["id"])
    n, m = rows.count(), queries.count()
    blocks, groups = max(1, -(-n // CANDIDATES)), max(1, -(-m // QUERIES))
    # repeated ids are spread by their position, so that no block grows with them
    dealt = (rows.withColumn("c", F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.lit(blocks)).cast("int"))
             .withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))))
    asked = (queries.withColumn("g", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(groups)).cast("int"))
             .withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))))
    cols = ["dim", "g", "c"]

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [], "vec_id": [], "score": []}
        if len(left) and len(right):
            ids, asks = left["id"].to_numpy(), right["id"].to_numpy()
            r, c, s = nra_block(ids, np.stack(left["v"].to_numpy()), asks, np.stack(right["v"].to_numpy()), k)
            out = {"query_id": asks[r], "vec_id": ids[c], "score": s}
        return pd.DataFrame(out).astype("int64")

    best = (dealt.groupBy(*cols).cogroup(asked.groupBy(*cols))
            .applyInPandas(meet, "query_id long, vec_id long, score long"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
