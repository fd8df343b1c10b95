"""Exact top-k by inner product with a pivot-distance index.

Adding one coordinate that brings every candidate to the same length turns the largest inner product into the smallest
Euclidean distance. Candidates are keyed by their nearest pivot and by rings of their distance to it. For a query at
distance d from a pivot, a ring [lo, hi] holds nothing nearer than max(lo - d, d - hi); rings are opened in the order of
that bound until it passes the distance of the k-th best answer.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from cartolith.llm.streams import matrix, numbers
from cartolith.session import materialise

LARGEST = 1 << 28  # vectors with a component beyond it are not indexed but compared with all others, in whole numbers of any size
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def _quantise(scale: int):
    """(id, vec) to (id, dim, vec as ints, wide), usable vectors only; wide is the vector itself where ints are too narrow."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, dims, vectors, wide = [], [], [], []
            for who, vector in zip(batch.column(0).to_pylist(), batch.column(1)):
                vector = vector.as_py()
                if who is None or not vector or any(x is None for x in vector):
                    continue
                given = np.asarray(vector, np.float64)
                if not np.isfinite(given).all():
                    continue
                with np.errstate(over="ignore"):
                    row = np.floor(scale * given)
                narrow = np.abs(row).max() < LARGEST
                ids.append(who)
                dims.append(len(row))
                vectors.append(row.astype(np.int32) if narrow else None)
                wide.append(None if narrow else given)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(dims, pa.int32()), pa.array(vectors, pa.list_(pa.int32())),
                                              pa.array(wide, pa.list_(pa.float64()))], ["id", "dim", "vec", "wide"])
    return run


def _whole(x: float, scale: int) -> int:
    scaled = scale * x
    return math.floor(scaled) if math.isfinite(scaled) else int(x) * scale


def _integers(table: pa.Table, dim: int, scale: int) -> np.ndarray:
    """Rows of (vec, wide) as a matrix of longs, or of Python integers if some row is wide."""
    if "wide" not in table.column_names or table.column("wide").null_count == table.num_rows:
        return matrix(table.column("vec"), dim, np.int64)
    rows = np.empty((table.num_rows, dim), object)
    for i, (narrow, wide) in enumerate(zip(table.column("vec").to_pylist(), table.column("wide").to_pylist())):
        rows[i] = narrow if wide is None else [_whole(x, scale) for x in wide]
    return rows


def _inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products; in doubles while every sum fits in 53 bits, in Python integers where it may pass 63.

    Products beyond the range of a long become its ends.
    """
    if not len(a) or not len(b):
        return np.zeros((len(a), len(b)), np.int64)
    high, other = np.abs(a).max(axis=1), np.abs(b).max(axis=1)
    bound = max(1, int(high.max())) * max(1, int(other.max())) * a.shape[1]  # no less than either
    if bound < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if bound < 1 << 63:
        return a.astype(np.int64) @ b.astype(np.int64).T
    if len(a) == 1:
        fits = np.array([int(high[0]) * int(x) * a.shape[1] < 1 << 63 for x in other]) & bool(high[0] < 1 << 63)
        fits &= np.array([bool(x < 1 << 63) for x in other])
        out = np.zeros((1, len(b)), np.int64)
        if fits.any():
            out[:, fits] = a.astype(np.int64) @ b[fits].astype(np.int64).T
        mine = [int(x) for x in a[0]]
        for j in np.flatnonzero(~fits):
            out[0, j] = min(MOST, max(LEAST, sum(x * int(y) for x, y in zip(mine, b[j]))))
        return out
    return np.concatenate([_inner(a[i:i + 1], b) for i in range(len(a))])


def _lifted(rows: np.ndarray, longest: float) -> np.ndarray:
    """Rows with one more coordinate, all of length ``longest``."""
    rest = np.maximum(longest * longest - (rows * rows).sum(axis=1), 0.0)
    return np.column_stack((rows, np.sqrt(rest)))


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    square = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2.0 * (a @ b.T)
    return np.sqrt(np.maximum(square, 0.0))


def _by_dim(batch: pa.RecordBatch, known) -> Iterator[tuple[int, np.ndarray, pa.RecordBatch]]:
    dims = numbers(batch.column(1))
    for dim in np.unique(dims).tolist():
        if dim in known:
            rows = np.flatnonzero(dims == dim)
            yield dim, rows, batch.take(pa.array(rows))


def _nearest_pivot(pivots: dict[int, np.ndarray], longest: dict[int, float]):
    """(id, dim, vec) to (id, dim, vec, pivot, dist)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, rows, part in _by_dim(batch, pivots):
                away = _distances(_lifted(matrix(part.column(2), dim), longest[dim]), pivots[dim])
                nearest = away.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(nearest.astype(np.int32)), pa.array(away[np.arange(len(rows)), nearest])],
                                                 ["id", "dim", "vec", "pivot", "dist"])
    return run


def _open_rings(pivots, longest, rings: dict[int, tuple], first: int, until: int):
    """(id, dim, vec, kth) to (query, dim, pivot, ring, floor): the rings at ranks first..until-1 that may hold an answer."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, _, part in _by_dim(batch, rings):
                number, ring, low, high = rings[dim]
                rows = matrix(part.column(2), dim)
                away = _distances(np.column_stack((rows, np.zeros(len(rows)))), pivots[dim])[:, number]
                bound = np.maximum(np.maximum(low - away, away - high), 0.0)
                order = np.argsort(bound, axis=1, kind="stable")[:, first:until]
                kth = part.column(3).to_numpy(zero_copy_only=False).astype(np.float64)  # NaN: not yet k answers
                reach = np.sqrt(np.maximum((rows * rows).sum(axis=1) + longest[dim] ** 2 - 2.0 * kth, 0.0))
                bound = np.take_along_axis(bound, order, axis=1)
                # rounding of the distances must never close a ring that holds an answer
                open_ = ~(bound > reach[:, None] + 1e-6 * (1.0 + longest[dim] + reach[:, None]))
                q, c = np.nonzero(open_)
                at = order[q, c]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(q)), part.column(1).take(pa.array(q)), pa.array(number[at].astype(np.int32)),
                     pa.array(ring[at].astype(np.int32)), part.column(2).take(pa.array(q)), part.column(3).take(pa.array(q))],
                    ["id", "dim", "pivot", "ring", "vec", "kth"])
    return run


def _best(k: int, scale: int):
    """One block of candidates against one block of queries: at most k answers per query."""
    def run(candidates: pa.Table, queries: pa.Table) -> pa.Table:
        out = ([], [], [])
        if candidates.num_rows and queries.num_rows:
            dim = candidates.column("dim")[0].as_py()
            ids, rows = numbers(candidates.column("id")), _integers(candidates, dim, scale)
            order = np.argsort(ids, kind="stable")
            ids, rows = ids[order], rows[order]
            who, wanted = numbers(queries.column("id")), _integers(queries, dim, scale)
            kth = queries.column("kth").to_numpy().astype(np.float64)
            for a in range(0, len(who), 256):
                scores = _inner(wanted[a:a + 256], rows)
                for i, row in enumerate(scores):
                    fit = np.flatnonzero((ids != who[a + i]) & ~(row < kth[a + i]))
                    if len(fit) > k:
                        fit = fit[np.argsort(~row[fit], kind="stable")[:k]]  # ~x falls as x rises, and has no overflow
                    out[0].append(np.full(len(fit), who[a + i]))
                    out[1].append(ids[fit])
                    out[2].append(row[fit])
        flat = [pa.array(np.concatenate(x) if x else np.zeros(0), pa.int64()) for x in out]
        return pa.table(flat, names=["query_id", "vec_id", "score"])
    return run


def top_k(vectors: DataFrame, is_query, k: int = 10, scale: int = 1024, pivots: int = 32, rings: int = 8, block: int = 4096,
          id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k candidates of largest inner product of floor(scale * x), ties to the smaller id.

    ``is_query`` is a condition on the column ``id``; candidates are all rows with another id. Exact: the pivots (a bounded
    sample by hash) and rings only decide how much is read.

    * null or empty vectors, vectors with a null or non-finite component, and rows without an id take no part; a query is
      compared with candidates of its own length only
    * vectors with a component beyond 2**28 after scaling are compared exactly with all others, without the index; an
      answer whose score does not fit a long (or is an end of its range) is an error, never left out
    * fewer than k candidates give all of them; a query without candidates has no rows
    * repeated ids: copies of a candidate row count once, different vectors under one id compete and the best one stays;
      a repeated query id gives the answers of all its vectors, best score per candidate
    * extra columns are ignored; an empty table gives an empty result
    """
    ints = T.ArrayType(T.IntegerType())
    narrow = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("vec"))
    every = materialise(narrow.mapInArrow(_quantise(scale), f"id long, dim int, vec {ints.simpleString()}, wide array<double>"), "vectors")
    rows = every.where("wide is null").drop("wide")
    squares = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    longest = {r.dim: float(np.sqrt(r.most)) for r in rows.groupBy("dim").agg(F.max(squares).alias("most")).collect()}
    by_hash = Window.partitionBy("dim").orderBy(F.xxhash64("id"), "id")
    chosen: dict[int, list] = {}
    for r in rows.withColumn("n", F.row_number().over(by_hash)).where(F.col("n") <= pivots).select("dim", "vec").collect():
        chosen.setdefault(r.dim, []).append(r.vec)
    at = {dim: _lifted(np.asarray(v, np.float64), longest[dim]) for dim, v in chosen.items()}

    keyed = materialise(rows.mapInArrow(_nearest_pivot(at, longest), "id long, dim int, vec array<int>, pivot int, dist double"), "keyed")
    spans = keyed.groupBy("dim", "pivot").agg(F.min("dist").alias("near"), F.max("dist").alias("far"))
    step = (F.col("far") - F.col("near")) / rings
    ringed = (keyed.join(F.broadcast(spans), ["dim", "pivot"])  # a row per length and pivot
              .withColumn("ring", F.when(step > 0, F.least(F.floor((F.col("dist") - F.col("near")) / step), F.lit(rings - 1))).otherwise(0).cast("int"))
              .drop("near", "far"))
    sizes = ringed.groupBy("dim", "pivot", "ring").agg(F.min("dist").alias("low"), F.max("dist").alias("high"), F.count("*").alias("n"))
    sizes = materialise(sizes, "rings")
    catalogue: dict[int, list] = {}
    for r in sizes.collect():  # at most pivots * rings rows per vector length
        catalogue.setdefault(r.dim, []).append((r.pivot, r.ring, r.low, r.high))
    known = {dim: tuple(np.array(c) for c in zip(*sorted(v))) for dim, v in catalogue.items()}
    index = materialise(ringed.join(F.broadcast(sizes.select("dim", "pivot", "ring", F.ceil(F.col("n") / block).cast("int").alias("parts"))),
                                    ["dim", "pivot", "ring"])
                        .withColumn("part", F.pmod(F.xxhash64("id"), "parts").cast("int")).drop("dist"), "index")

    wanted = rows.where(is_query)
    query_blocks = max(1, -(-wanted.count() // block))
    queries = wanted.withColumn("kth", F.lit(None).cast("double"))
    cell = ["dim", "pivot", "ring", "part", "q"]
    split = F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1)))
    candidates = index.withColumn("q", split).select(*cell, "id", "vec")
    parts = index.select("dim", "pivot", "ring", F.col("part").alias("piece")).distinct()
    done, size = 0, 8
    most = max([0, *(len(v[0]) for v in known.values())])
    place = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def best_of(found: DataFrame) -> DataFrame:
        found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        return materialise(found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k), "answers")

    def with_kth(answers: DataFrame) -> DataFrame:
        # a little lower than the score, which a double may round up
        kth = answers.where(F.col("rank") == k).select(F.col("query_id").alias("id"), (
            F.col("score").cast("double") - F.abs(F.col("score").cast("double")) * 1e-15).alias("kth"))
        return wanted.join(kth, "id", "left")

    wide = every.where("wide is not null")
    answers = None
    if wide.limit(1).count():
        asking = every.where(is_query).withColumn("kth", F.lit(None).cast("double"))
        spread = max(1, -(-every.count() // block))
        found = None
        for theirs, asked in ((wide, asking), (every.where("wide is null"), asking.where("wide is not null"))):
            a = (theirs.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(spread)).cast("int"))
                 .withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(spread - 1)))))
            b = (asked.withColumn("q", F.pmod(F.xxhash64("id"), F.lit(spread)).cast("int"))
                 .withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(spread - 1)))))
            some = (a.groupBy("dim", "part", "q").cogroup(b.groupBy("dim", "part", "q"))
                    .applyInArrow(_best(k, scale), "query_id long, vec_id long, score long"))
            found = some if found is None else found.unionByName(some)
        answers = best_of(found)
        queries = with_kth(answers)
        answers = answers.drop("rank")
    while done < most:
        opened = queries.mapInArrow(_open_rings(at, longest, known, done, done + size), "id long, dim int, pivot int, ring int, vec array<int>, kth double")
        asked = (opened.join(parts, ["dim", "pivot", "ring"]).withColumn("q", F.pmod(F.xxhash64("id"), F.lit(query_blocks)).cast("int"))
                 .withColumn("part", F.col("piece")).select(*cell, "id", "vec", "kth"))
        found = (candidates.groupBy(*cell).cogroup(asked.groupBy(*cell))
                 .applyInArrow(_best(k, scale), "query_id long, vec_id long, score long"))
        found = found if answers is None else found.unionByName(answers)
        answers = best_of(found)
        queries = with_kth(answers)
        answers = answers.drop("rank")
        done, size = done + size, 8 * size
    if answers is None:
        answers = vectors.sparkSession.createDataFrame([], "query_id long, vec_id long, score long")
    fits = ~F.col("score").isin(LEAST, MOST)
    score = F.when(fits, F.col("score")).otherwise(F.raise_error(F.lit("the score of an answer does not fit a long")).cast("long"))
    return answers.select("query_id", F.row_number().over(place).cast("int").alias("rank"), "vec_id", score.alias("score"))


def op7_pivot_top_k(spark, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("id") % 100 == 0)
