"""Exact top-k search by a Voronoi kNN join on integer inner products.

Vectors become integers (floor of scale times the component). Pivots, a bounded sample, split them into cells; a cell's
summary is its size and its radius around the pivot. Each query is first solved inside its own block, which gives a
score that its k-th result has at least. A cell is needed by a query only if its bound, q.p + |q| r, reaches that score;
only then the query is sent to the cell's blocks. Cells of any size fall into blocks, and the queries of a cell into
chunks, so that no task holds more than one of each. Local results meet per query.

Defined results: vectors that are null, empty or hold null or non-finite components take no part, nor do rows with a null
vec_id. Rows that share a vec_id are rows of their own: each is a candidate, and each that is a query is answered, with
the others among its candidates; rows that share the vector as well are counted and travel as one. Vectors of different lengths are compared
as if the shorter one ended in zeros. Scores outside 64 bits are clamped. Ties go to the smaller vec_id. An empty table
gives an empty result. Other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.exact_dedup import repeated
from docloom.session import cut

SCALE, PIVOTS, BLOCK, CHUNK = 64.0, 24, 1024, 2048
#: Sums of doubles are exact up to here.
EXACT = float(1 << 53)
SLACK = 1e-9


def integers(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = SCALE) -> DataFrame:
    """vec_id, v, n: the vectors that take part, as arrays of long, with the number of rows that hold both."""
    usable = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.filter(F.col("vec_id").isNotNull() & (F.size("v") > 0) & F.forall("v", usable))
    return rows.select("vec_id", F.transform("v", lambda x: F.floor(x * scale)).alias("v")).groupBy("vec_id", "v").agg(F.count(F.lit(1)).alias("n"))


def _matrix(rows: pd.Series, width: int | None = None) -> np.ndarray:
    width = max([width or 0, *(len(v) for v in rows)])
    out = np.zeros((len(rows), width))
    for k, v in enumerate(rows):
        out[k, : len(v)] = v
    return out


def _scores(queries: pd.Series, data: pd.Series) -> np.ndarray:
    """Exact inner products as int64: by doubles where they can't round, else by Python's integers."""
    width = max(len(v) for v in [*queries, *data])
    q, d = _matrix(queries, width), _matrix(data, width)
    if np.abs(q).max() * np.abs(d).max() * width < EXACT:
        return np.rint(q @ d.T).astype(np.int64)
    wide = lambda rows: [[int(x) for x in v] + [0] * (width - len(v)) for v in rows]
    least, most = -(1 << 63), (1 << 63) - 1
    right = wide(data)
    return np.array([[min(max(sum(a * b for a, b in zip(x, y, strict=True)), least), most) for y in right] for x in wide(queries)], np.int64)


def _best(scores: np.ndarray, times: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of one query's scores against rows ids, each there so many times: the k best, ties to the smaller id."""
    at = np.flatnonzero(times > 0)
    if len(at) > k:
        edge = np.partition(scores[at], len(at) - k)[len(at) - k]
        at = at[scores[at] >= edge]
    at = at[np.lexsort((ids[at], -scores[at]))][:k]
    at = np.repeat(at, np.minimum(times[at], k))[:k]
    return ids[at], scores[at]


def _others(query: int, vector: np.ndarray, ids: np.ndarray, rows: pd.Series, times: np.ndarray) -> np.ndarray:
    """How often each row stands for another row than the query's own."""
    own = [j for j in np.flatnonzero(ids == query) if np.array_equal(rows.iat[j], vector)]
    if own:
        times = times.copy()
        times[own] -= 1
    return times


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = SCALE, block: int = BLOCK, chunk: int = CHUNK, pivots: int = PIVOTS) -> DataFrame:
    """query_id, rank (from 1), vec_id, score. ``is_query`` is a condition on the id column's values."""
    asks = F.coalesce(is_query, F.lit(False))
    twin = F.when(asks, F.sha2(F.array_join(F.col("v").cast("array<string>"), ","), 256))
    rows = cut(integers(vectors, id_col, vector_col, scale).select("*", asks.alias("query"), twin.alias("twin")))
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(pivots).select("v").toPandas()["v"]
    if not len(sample):
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0).cast("long").alias("score")).limit(0)
    centres = _matrix(sample)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                own = _matrix(batch["v"], centres.shape[1])
                wide = np.pad(centres, ((0, 0), (0, own.shape[1] - centres.shape[1])))
                far = np.stack([np.sqrt(((own - c) ** 2).sum(1)) for c in wide], 1)
                yield batch.assign(cell=far.argmin(1).astype(np.int32), far=far.min(1))

    dealt = cut(rows.mapInPandas(assign, "vec_id long, v array<bigint>, n long, query boolean, twin string, cell int, far double"))
    # At most as many rows as there are pivots.
    cells = dealt.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("radius")).toPandas().sort_values("cell")
    blocks_of = _lookup(dict(zip(cells["cell"].tolist(), (-(-cells["n"] // block)).tolist(), strict=True)))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("vec_id", "v"), blocks_of[F.col("cell")]).cast("int"))

    def bound(own: pd.DataFrame) -> pd.DataFrame:
        """The queries of a block with the cells they need: the block itself shows what their k-th score is at least."""
        asked = own[own["query"]]
        if not len(asked):
            return asked[["vec_id", "v", "n", "twin"]].assign(least=0, needs=asked["v"])
        ids, scores = own["vec_id"].to_numpy(), _scores(asked["v"], own["v"])
        least = []
        for q, v, s in zip(asked["vec_id"], asked["v"], scores, strict=True):
            found = _best(s, _others(q, v, ids, own["v"], own["n"].to_numpy()), ids, k)[1]
            least.append(int(found[-1]) if len(found) == k else -(1 << 63))
        q = _matrix(asked["v"], centres.shape[1])
        wide = np.pad(centres, ((0, 0), (0, q.shape[1] - centres.shape[1])))[cells["cell"].to_numpy()]
        reach = q @ wide.T + np.sqrt((q**2).sum(1))[:, None] * cells["radius"].to_numpy()
        needs = reach + np.abs(reach) * SLACK + 1 >= np.array(least, float)[:, None]
        return pd.DataFrame({"vec_id": asked["vec_id"], "v": asked["v"], "n": asked["n"], "twin": asked["twin"], "least": least, "needs": [cells["cell"].to_numpy()[n].tolist() for n in needs]})

    asked = dealt.groupBy("cell", "block").applyInPandas(bound, "vec_id long, v array<bigint>, n long, twin string, least long, needs array<int>")
    asked = cut(asked.select("vec_id", "v", "n", "twin", "least", F.explode("needs").alias("cell")))
    # At most as many rows as there are pivots.
    need = {r["cell"]: -(-r["count"] // chunk) for r in asked.groupBy("cell").count().collect()}
    chunks_of = _lookup(need or {0: 1})
    asked = asked.withColumn("chunk", F.pmod(F.xxhash64("vec_id", "v"), chunks_of[F.col("cell")]).cast("int"))
    asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0), (blocks_of[F.col("cell")] - 1).cast("int"))))
    data = dealt.filter(F.col("cell").isin(list(need) or [-1])).withColumn("chunk", F.explode(F.sequence(F.lit(0), (chunks_of[F.col("cell")] - 1).cast("int"))))

    def solve(queries: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        near, score, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], []
        if len(queries) and len(own):
            ids, scores, times = own["vec_id"].to_numpy(), _scores(queries["v"], own["v"]), own["n"].to_numpy()
            for q, v, least, s in zip(queries["vec_id"], queries["v"], queries["least"], scores, strict=True):
                at = np.flatnonzero(s >= least)
                best_ids, best = _best(s[at], _others(q, v, ids, own["v"], times)[at], ids[at], k)
                near.append(best_ids)
                score.append(best)
                found.append(len(best))
        asked_of = {c: np.repeat(queries[c].to_numpy()[: len(found)], found) for c in ("vec_id", "twin", "n")}
        return pd.DataFrame({"query_id": asked_of["vec_id"], "twin": asked_of["twin"], "n": asked_of["n"], "vec_id": np.concatenate(near), "score": np.concatenate(score)})

    by = ["cell", "block", "chunk"]
    asked = asked.select("vec_id", "v", "n", "twin", "least", *by).groupBy(*by)
    local = asked.cogroup(data.select("vec_id", "v", "n", *by).groupBy(*by)).applyInPandas(solve, "query_id long, twin string, n long, vec_id long, score long")
    order = Window.partitionBy("query_id", "twin").orderBy(F.desc("score"), "vec_id")
    best = local.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return repeated(best, "n", "copy").select("query_id", "rank", "vec_id", "score")


def _lookup(values: dict[int, int]) -> Column:
    return F.create_map(*[F.lit(int(x)) for item in values.items() for x in item])
