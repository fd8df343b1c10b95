"""Near duplicates among embeddings: sorted projection passes.

Every pass hashes each vector by the signs of its projections on random directions, orders all vectors by the concatenated
hashes, and compares each with its neighbours in that order. Similar vectors agree in a long prefix with high probability,
so a few passes with fresh directions find them. What the passes find is joined into components, and inside a component
every pair is compared in blocks, so the link counts are exact however many partners a vector has.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from cartolith.llm.components import connected_components
from cartolith.llm.streams import matrix, numbers, sorted_groups
from cartolith.session import materialise

BITS = 48


def _unit(rows: np.ndarray) -> np.ndarray:
    scaled = rows / np.abs(rows).max(axis=1, keepdims=True)  # squares neither overflow nor vanish
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def _usable(vector: list | None) -> bool:
    if not vector or any(x is None for x in vector):
        return False
    row = np.asarray(vector, np.float64)
    return bool(np.isfinite(row).all() and row.any())


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, vec) to (id, dim, digest, vec); equal vectors have equal digests, unusable ones none."""
    for batch in batches:
        ids, vectors = batch.column(0), batch.column(1)
        dims, digests = [], []
        for i, known in enumerate(ids.is_valid().to_pylist()):
            vector = vectors[i].as_py()
            if known and _usable(vector):
                row = np.asarray(vector, np.float64) + 0.0
                dims.append(len(row))
                digests.append(hashlib.md5(row.tobytes()).digest())
            else:
                dims.append(None)
                digests.append(None)
        yield pa.RecordBatch.from_arrays([ids, pa.array(dims, pa.int32()), pa.array(digests, pa.binary()), vectors],
                                         ["id", "dim", "digest", "vec"])


def _sort_keys(passes: int, seed: int):
    """(id, dim, vec) to (pass, dim, key, id, vec), one row per pass."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        directions: dict[int, np.ndarray] = {}
        weights = np.int64(1) << np.arange(BITS - 1, -1, -1, dtype=np.int64)
        for batch in batches:
            dims = numbers(batch.column(1))
            for dim in np.unique(dims).tolist():
                rows = np.flatnonzero(dims == dim)
                part = batch.take(pa.array(rows))
                if dim not in directions:
                    directions[dim] = np.random.default_rng([seed, dim]).standard_normal((dim, passes * BITS))
                signs = _unit(matrix(part.column(2), dim)) @ directions[dim] > 0
                for p in range(passes):
                    key = signs[:, p * BITS:(p + 1) * BITS] @ weights
                    n = len(rows)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n, p, np.int32)), part.column(1), pa.array(key), part.column(0), part.column(2)],
                        ["pass", "dim", "key", "id", "vec"])
    return run


def _labels(near: np.ndarray) -> np.ndarray:
    """Smallest reachable index of every row of a symmetric Boolean matrix with a true diagonal."""
    label = np.arange(len(near))
    while True:
        least = np.where(near, label, len(near)).min(axis=1)
        least = least[least]
        if (least == label).all():
            return label
        label = least


def _window_links(threshold: float, window: int):
    """Rows (pass, dim, key, id, vec) in order: each row meets at least ``window`` rows before and after it."""
    def compare(ids: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        near = rows @ rows.T >= threshold
        linked = np.flatnonzero(near.sum(axis=1) > 1)
        if not len(linked):
            return linked, linked
        np.fill_diagonal(near, True)
        label = _labels(near[np.ix_(linked, linked)])
        return ids[linked], ids[linked][label]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, rows = None, None, None

        def emit(a, b):
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            passes, dims = numbers(batch.column(0)), numbers(batch.column(1))
            cuts = [0, *(np.flatnonzero((passes[1:] != passes[:-1]) | (dims[1:] != dims[:-1])) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                part, dim = batch.slice(a, b - a), int(dims[a])
                new_ids, new_rows = numbers(part.column(3)), _unit(matrix(part.column(4), dim))
                if now == (passes[a], dim):
                    ids, rows = np.concatenate((ids, new_ids)), np.concatenate((rows, new_rows))
                else:
                    if now is not None:
                        yield emit(*compare(ids, rows))
                    now, ids, rows = (passes[a], dim), new_ids, new_rows
                while len(ids) >= 3 * window:  # two blocks at a time; the second is also the next one's first
                    yield emit(*compare(ids[:2 * window], rows[:2 * window]))
                    ids, rows = ids[window:], rows[window:]
        if now is not None:
            yield emit(*compare(ids, rows))
    return run


def _count_links(threshold: float):
    """Rows (component, i, j, side, id, copies, vec) by component and block pair: links of every row to the other block."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches, 3):
            side, ids, copies = (numbers(group.column(c)) for c in ("side", "id", "copies"))
            rows = _unit(matrix(group.column("vec"), len(group.column("vec")[0])))
            same = group.column("i")[0].as_py() == group.column("j")[0].as_py()
            left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            if same:
                right = left
            if not len(left) or not len(right):
                continue
            near = rows[left] @ rows[right].T >= threshold
            if same:
                np.fill_diagonal(near, False)
            found = [(ids[left], near @ copies[right])]
            if not same:
                found.append((ids[right], near.T @ copies[left]))
            for who, links in found:
                yield pa.RecordBatch.from_arrays([pa.array(who), pa.array(links.astype(np.int64))], ["id", "links"])
    return run


def embedding_groups(vectors: DataFrame, threshold: float = 0.95, passes: int = 12, window: int = 256, block: int = 1024,
                     seed: int = 7, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(id, n_links, component_id, kept) for every row of vectors.

    * n_links counts the other rows linked directly (cosine in double precision at or above ``threshold``) among those
      that the passes joined into one component; component_id is the smallest id reachable, kept is id = component_id
    * exactly equal vectors are compared once and counted with their copies; repeated rows count as copies too
    * null, empty and zero vectors, vectors with a null or non-finite component, and rows without an id link with
      nothing: n_links 0, component_id their own id (kept is false only where the id is null)
    * vectors of different lengths never link; extra columns are ignored; an empty table gives an empty result

    ``passes`` and ``window`` set the recall of pairs: a pair at the threshold shares a bit with probability 0.9, and a
    pass finds it if it shares the first log2(rows / window) bits. Windows end with a partition of the range sort.
    """
    kind = vectors.schema[vector_column].dataType
    kind = kind if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.FloatType, T.DoubleType)) else T.ArrayType(T.DoubleType())
    narrow = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast(kind).alias("vec"))
    rows = materialise(narrow.mapInArrow(_digests, f"id long, dim int, digest binary, vec {kind.simpleString()}"), "vectors")
    usable = rows.where("digest is not null")
    nodes = materialise(usable.groupBy("digest").agg(F.min(F.struct("id", "dim", "vec")).alias("first"), F.count("*").alias("copies"))
                        .select("digest", "first.*", "copies"), "nodes")
    shape = f"pass int, dim int, key long, id long, vec {kind.simpleString()}"
    order = ["pass", "dim", "key", "id"]
    links = (nodes.select("id", "dim", "vec").mapInArrow(_sort_keys(passes, seed), shape).repartitionByRange("pass", "dim", "key")
             .sortWithinPartitions(*order).mapInArrow(_window_links(threshold, window), "a long, b long").distinct())
    linked = materialise(connected_components(links), "components")

    sizes = linked.groupBy("component").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    placed = (linked.join(sizes, "component").join(nodes.select(F.col("id").alias("node"), "copies", "vec"), "node")
              .withColumn("own", F.pmod(F.xxhash64("node"), "blocks").cast("int")))
    pair = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(
        F.least("own", o).alias("i"), F.greatest("own", o).alias("j"), F.when(F.col("own") <= o, 0).otherwise(1).alias("side")))
    counted = (placed.select("component", F.explode(pair).alias("p"), F.col("node").alias("id"), "copies", "vec")
               .select("component", "p.i", "p.j", "p.side", "id", "copies", "vec")
               .repartition("component", "i", "j").sortWithinPartitions("component", "i", "j")
               .mapInArrow(_count_links(threshold), "id long, links long").groupBy("id").agg(F.sum("links").alias("links")))

    labels = (nodes.select("digest", "id", "copies").join(linked.withColumnRenamed("node", "id"), "id", "left").join(counted, "id", "left")
              .select("digest", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("component", "id").alias("component_id")))
    return (rows.select("id", "digest").join(labels, "digest", "left")
            .select("id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False))))


def op3_embedding_near_dedup(spark, sf_dir: str) -> DataFrame:
    return embedding_groups(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).withColumnRenamed("id", "vec_id")
