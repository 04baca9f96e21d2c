"""Exact top-k inner products by pivot-table elimination.

Vectors become integers, floor(64 x). With M the largest norm, a vector x is lifted to (x, sqrt(M^2 - |x|^2))
and a query q to (q, 0), so |q' - x'|^2 = |q|^2 + M^2 - 2 <q, x>: the highest inner product is the least
distance. Distances to ``pivots`` pivots are computed once per vector and stored; the largest difference of
pivot distances bounds a pair's distance from below, hence its score from above. Each query takes a block's
candidates in order of that bound, in tiers of growing size, and stops at the tier whose bounds all lie
under the k-th score found so far: exact. Every query starts from the k-th best score among a bounded sample
of the table, so blocks prune from the first. Where more than half of a tile is needed after the first tier
(directions without structure, which no pivot tells apart), the tile is scored by one matrix product.

Queries go in rounds of about ``round_queries`` (a fixed bound): a round is broadcast, run against every block
of candidates, merged by rank and written before the next one is fetched. A round takes the table in two waves:
first one row in ``WAVE``, drawn by hash, whose merged k-th scores are the floors of the second. A task keeps at
most k per query, and what all tasks of the second wave send is so about ``WAVE`` times k a query together, however
many they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Accumulator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.shared import fresh_path, materialise

SAMPLE = 2048
"""Rows that pivots are picked from, and that queries draw their first floors from."""

WAVE = 64
"""One row in so many is searched before the others."""


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column as a matrix, shorter ones padded with zeros."""
    size = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), dim))
    if len(flat):
        row = np.repeat(np.arange(len(column)), size)
        out[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def quantised(table: DataFrame, id_col: str, vec_col: str, scale: int = 64) -> DataFrame:
    """vec_id and floor(scale * x) of every vector that takes part."""
    x = F.col(vec_col)
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf")))
    rows = table.filter(F.col(id_col).isNotNull() & x.isNotNull()).filter(finite)
    return rows.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(x, lambda v: F.floor(v.cast("double") * scale)).alias("v"))


def _pivots(sample: np.ndarray, most: float, count: int) -> np.ndarray:
    """Lifted pivots, each the sampled vector farthest from those chosen so far."""
    lifted = np.c_[sample, np.sqrt(np.maximum(most - (sample**2).sum(1), 0))]
    chosen, far = [0], ((lifted - lifted[0]) ** 2).sum(1)
    while len(chosen) < count and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((lifted - lifted[chosen[-1]]) ** 2).sum(1))
    return lifted[chosen]


def _sample_floor(ids: np.ndarray, v: np.ndarray, sample_ids: np.ndarray, sample: np.ndarray, k: int, exact: bool) -> np.ndarray:
    """The k-th best score of each query among the sampled rows but its own id, a score that the answer cannot fall under."""
    out = np.full(len(ids), -(1 << 62), np.int64)
    for lo in range(0, len(ids), 1024):
        rows = slice(lo, lo + 1024)
        score = (v[rows] @ sample.T).astype(np.int64) if exact else v[rows].astype(np.int64) @ sample.T.astype(np.int64)
        score[ids[rows][:, None] == sample_ids[None]] = -(1 << 62)
        if score.shape[1] >= k:
            out[rows] = np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k]
    return out


def _distances(lifted: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    squares = (lifted**2).sum(1)[:, None] + (pivots**2).sum(1)[None] - 2 * lifted @ pivots.T
    return np.sqrt(np.maximum(squares, 0)).astype(np.float32)


class _Best:
    """The k best of each query so far: scores descending, ties to smaller ids. ``floor`` is a score that k candidates are known to reach."""

    def __init__(self, floor: np.ndarray, k: int):
        self.k, self.start = k, floor
        self.score = np.full((len(floor), k), -(1 << 62), np.int64)
        self.id = np.full((len(floor), k), np.iinfo(np.int64).max, np.int64)

    def floor(self, rows: np.ndarray | slice) -> np.ndarray:
        return np.maximum(self.score[rows, -1], self.start[rows])

    def add(self, query: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        """Candidates with their scores, each for one query."""
        ok = score >= self.floor(query)
        query, ids, score = query[ok], ids[ok], score[ok]
        if not len(query):
            return
        mine = np.unique(query)
        q = np.r_[np.repeat(mine, self.k), query]
        s, i = np.r_[self.score[mine].ravel(), score], np.r_[self.id[mine].ravel(), ids]
        order = np.lexsort((i, -s, q))
        q, s, i = q[order], s[order], i[order]
        place = np.arange(len(q)) - np.searchsorted(q, q, "left")
        top = place < self.k
        self.score[q[top], place[top]], self.id[q[top], place[top]] = s[top], i[top]


def search_block(best: _Best, queries: dict, ids: np.ndarray, x: np.ndarray, dist: np.ndarray, exact: bool, step: int = 256, tiers: tuple[int, ...] = (32, 128, 512)) -> int:
    """Evaluate one block of candidates against all queries in bound order; returns how many pairs were scored."""
    done, n = 0, len(ids)
    kind = np.float64 if exact else np.int64
    x = x.astype(kind, copy=False)
    cuts = [c for c in np.cumsum(tiers).tolist() if c < n]
    for lo in range(0, len(queries["id"]), step):
        rows = np.arange(lo, min(lo + step, len(queries["id"])))
        q, qd, lift = queries["v"][rows].astype(kind, copy=False), queries["dist"][rows], queries["lift"][rows]
        bound = np.zeros((len(q), n), np.float32)
        for p in range(qd.shape[1]):
            np.maximum(bound, np.abs(qd[:, p : p + 1] - dist[None, :, p]), out=bound)
        np.maximum(bound - queries["slack"], 0, out=bound)
        upper = (lift[:, None] - bound.astype(np.float64) ** 2) / 2 + 1
        upper[queries["id"][rows][:, None] == ids[None]] = -np.inf
        order = np.argpartition(-upper, [c - 1 for c in cuts], axis=1) if cuts else np.broadcast_to(np.arange(n), upper.shape)
        for a, b in zip([0, *cuts], [*cuts, n]):
            column = order[:, a:b]
            need = np.take_along_axis(upper, column, axis=1) >= best.floor(rows)[:, None]
            live = np.flatnonzero(need.any(axis=1))
            if not len(live):
                break
            if a and (left := np.take_along_axis(upper[live], order[live, a:], axis=1) >= best.floor(rows[live])[:, None]).mean() > 0.5:
                r, c = np.nonzero(left)
                c = order[live[r], a + c]
                best.add(rows[live[r]], ids[c], (q[live] @ x.T)[r, c].astype(np.int64))
                done += len(live) * n
                break
            r, c = np.nonzero(need)
            c = column[r, c]
            for at in range(0, len(r), 1 << 16):
                i, j = r[at : at + (1 << 16)], c[at : at + (1 << 16)]
                best.add(rows[i], ids[j], np.einsum("pd,pd->p", q[i], x[j]).astype(np.int64))
            done += len(r)
    return done


def top_k(table: DataFrame, queries: DataFrame, k: int = 20, pivots: int = 64, round_queries: int = 16384, block: int = 4096, id_col: str = "vec_id", vec_col: str = "embedding", scored: Accumulator | None = None) -> DataFrame:
    """The ``k`` highest integer inner products of each query over ``table``: query_id, rank, vec_id, score.

    Rows with a null id or vector, or a vector holding null or a non-finite number, take no part on either
    side. A query's own id is no candidate. Ties go to the smaller id; repeated rows are candidates each. Query
    rows of one id and vector are one query; those of one id and different vectors are ranked apart. Ids must be whole numbers.
    Vectors of unequal length count as padded with zeros. Fewer than k candidates are all returned; an empty
    table or query set gives no rows. Other columns are not read. ``scored`` counts the pairs that were scored.
    """
    spark = table.sparkSession
    ints = quantised(table, id_col, vec_col)
    norm = F.aggregate("v", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double"))
    stats = ints.agg(F.max(norm).alias("most"), F.max(F.size("v")).alias("dim")).first()
    asked = quantised(queries, id_col, vec_col).distinct()
    n_asked, q_most = asked.agg(F.count("*"), F.max(norm)).first()
    found_schema = "query_id long, query int, vec_id long, score long"
    if stats["most"] is None or not n_asked:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    most, dim = float(stats["most"]), max(1, int(stats["dim"]))
    exact = max(most, float(q_most)) < 2.0**52
    drawn = ints.withColumn("h", F.xxhash64("vec_id")).orderBy("h", "vec_id").limit(SAMPLE).select("vec_id", "v").toArrow().combine_chunks()
    sample, sample_ids = _matrix(drawn.column("v").combine_chunks(), dim), drawn.column("vec_id").to_numpy()
    pivot = _pivots(sample, most, pivots)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column("v"), dim)
            d = _distances(np.c_[x, np.sqrt(np.maximum(most - (x**2).sum(1), 0))], pivot)
            yield pa.RecordBatch.from_pydict({"vec_id": b.column("vec_id"), "v": b.column("v"), "dist": pa.array(list(d), pa.list_(pa.float32()))})

    first_wave = (F.pmod(F.xxhash64(F.lit(WAVE), "vec_id"), F.lit(WAVE)) > 0).cast("int")
    measured_path = fresh_path(spark)
    ints.mapInArrow(measure, "vec_id long, v array<long>, dist array<float>").withColumn("wave", first_wave).write.partitionBy("wave").parquet(measured_path)
    measured = spark.read.schema("vec_id long, v array<long>, dist array<float>, wave int").parquet(measured_path)
    asked = materialise(asked)
    rounds = (n_asked - 1) // round_queries + 1
    path = fresh_path(spark)
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")

    def merged(found: DataFrame) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    for r in range(rounds):
        mine = asked if rounds == 1 else asked.filter(F.pmod(F.xxhash64("vec_id"), F.lit(rounds)) == r)
        held = mine.orderBy("vec_id", "v").toArrow().combine_chunks()
        if not held.num_rows:
            continue
        column = held.column("v").combine_chunks()
        v = _matrix(column, max(dim, int(np.diff(column.offsets.to_numpy()).max())))[:, :dim]
        squares = (v**2).sum(1)
        q = {"id": held.column("vec_id").to_numpy(), "v": v, "lift": squares + most, "dist": _distances(np.c_[v, np.zeros(len(v))], pivot)}
        q["slack"] = np.float32(1e-3 + 1e-5 * np.sqrt(squares.max() + most))  # beyond any rounding of the float32 distances
        q["floor"] = _sample_floor(q["id"], v, sample_ids, sample, k, exact)

        def search(batches: Iterator[pa.RecordBatch], sent) -> Iterator[pa.RecordBatch]:
            q = sent.value
            best, ids, x, d, n = _Best(q["floor"], k), [], [], [], 0

            def flush():
                if ids:
                    done = search_block(best, q, np.concatenate(ids), np.concatenate(x), np.concatenate(d), exact)
                    if scored is not None:
                        scored.add(done)
                ids.clear(), x.clear(), d.clear()

            for whole in batches:
                for at in range(0, whole.num_rows, block):
                    b = whole.slice(at, block)
                    ids.append(b.column("vec_id").to_numpy(zero_copy_only=False)), x.append(_matrix(b.column("v"), dim))
                    d.append(_matrix(b.column("dist"), len(pivot)).astype(np.float32))
                    n += b.num_rows
                    if n >= block:
                        flush()
                        n = 0
            flush()
            row, place = np.nonzero(best.id != np.iinfo(np.int64).max)
            for at in range(0, len(row), 1 << 16):
                i, j = row[at : at + (1 << 16)], place[at : at + (1 << 16)]
                yield pa.RecordBatch.from_pydict({"query_id": pa.array(q["id"][i]), "query": pa.array(i.astype(np.int32)), "vec_id": pa.array(best.id[i, j]), "score": pa.array(best.score[i, j])})

        def searched(wave: int) -> DataFrame:
            sent = spark.sparkContext.broadcast(q)
            rows = measured.filter(F.col("wave") == wave).select("vec_id", "v", "dist")
            return materialise(merged(rows.mapInArrow(lambda batches: search(batches, sent), found_schema)))

        first = searched(0)
        full = first.filter(F.col("rank") == k).select("query", "score").toArrow()  # a row a query of the round
        at = full.column("query").to_numpy()
        q["floor"][at] = np.maximum(q["floor"][at], full.column("score").to_numpy())
        merged(first.drop("rank").unionByName(searched(1).drop("rank"))).write.mode("append").parquet(path)
    found = spark.read.schema(found_schema + ", rank int").parquet(path)
    return found.select("query_id", "rank", "vec_id", "score")
