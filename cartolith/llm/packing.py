"""Best-fit packing of documents into sequences by a grouping genetic algorithm on islands.

A packing is a grouping of pieces into bins. Crossover injects whole well-filled bins of one parent into the other, drops
the bins that now hold a piece twice, and puts the displaced pieces back by best fit. Pieces are dealt into shards of
bounded size; each shard evolves on several islands, which exchange their best packings between epochs. Bins that a shard
leaves with much room give their pieces to the next, much smaller level, until one shard holds them all.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from cartolith.llm.wordbpe import word_bpe
from cartolith.session import materialise

END_OF_DOCUMENT = 0


def pieces(docs: DataFrame, vocabulary: str, capacity: int = 2048, with_ids: bool = False, id_column: str = "doc_id",
           text_column: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids]): a document's tokens and a closing id 0, cut only beyond the capacity."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_bpe(vocabulary)
        for batch in batches:
            texts = batch.column(1)
            for first in range(0, batch.num_rows, 256):
                some = [t.as_py() or "" for t in texts.slice(first, 256)]
                rows, numbers = [], []
                for i, ids in enumerate(encoder.encode(some)):
                    whole = np.append(ids, END_OF_DOCUMENT).astype("<u4")
                    for piece, start in enumerate(range(0, len(whole), capacity)):
                        part = whole[start:start + capacity]
                        rows.append((first + i, piece, start, len(part), zlib.crc32(part.tobytes())))
                        if with_ids:
                            numbers.append(part.astype(np.int32))
                who, piece, start, length, crc = (np.array(c, np.int64) for c in zip(*rows))
                columns = [batch.column(0).take(pa.array(who)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc)]
                names = ["id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array(numbers, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    narrow = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"))
    return narrow.mapInArrow(run, "id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


# one shard's packings --------------------------------------------------------------------------------------------------


class _Room:
    """Open bins by free space; the tightest bin that fits is found in the set bits of one integer."""

    def __init__(self, free: list[int]) -> None:
        self.stacks: dict[int, list[int]] = {}
        self.some = 0
        for number, room in enumerate(free):
            self.put(number, room)

    def put(self, number: int, room: int) -> None:
        if room:
            self.stacks.setdefault(room, []).append(number)
            self.some |= 1 << room

    def best_fit(self, size: int) -> tuple[int, int] | None:
        fitting = self.some >> size
        if not fitting:
            return None
        room = size + (fitting & -fitting).bit_length() - 1
        stack = self.stacks[room]
        number = stack.pop()
        if not stack:
            self.some ^= 1 << room
        return number, room


def best_fit(sizes: np.ndarray, items: np.ndarray, bins: np.ndarray, loads: list[int], capacity: int) -> None:
    """Put ``items`` in the given order into the tightest bins, opening new ones as needed; bins and loads are changed."""
    room = _Room([capacity - load for load in loads])
    for item, size in zip(items.tolist(), sizes[items].tolist()):
        found = room.best_fit(size)
        if found is None:
            found = len(loads), capacity
            loads.append(0)
        number, free = found
        bins[item] = number
        loads[number] += size
        room.put(number, free - size)


def _loads(sizes: np.ndarray, bins: np.ndarray) -> np.ndarray:
    return np.bincount(bins, weights=sizes).astype(np.int64)


def _score(sizes: np.ndarray, bins: np.ndarray, capacity: int) -> tuple[int, float]:
    loads = _loads(sizes, bins)
    return len(loads), -float(((loads / capacity) ** 2).sum())  # fewer bins first, then fuller ones


def crossover(sizes: np.ndarray, into: np.ndarray, donor: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """Inject a random half of the donor's well-filled bins; bins of ``into`` that share a piece go, the rest is best-fitted."""
    loads = _loads(sizes, donor)
    good = np.flatnonzero(loads >= np.median(loads))
    chosen = np.zeros(len(loads), bool)
    chosen[rng.choice(good, max(1, len(good) // 2), replace=False)] = True
    injected = chosen[donor]
    torn = np.zeros(int(into.max()) + 1, bool)
    torn[into[injected]] = True
    kept = ~torn[into] & ~injected
    child = np.full(len(sizes), -1, np.int32)
    _, child[kept] = np.unique(into[kept], return_inverse=True)
    base = int(child.max()) + 1
    _, child[injected] = np.unique(donor[injected], return_inverse=True)
    child[injected] += base
    return _refit(sizes, child, capacity)


def mutate(sizes: np.ndarray, bins: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """Empty the least filled bin and a few random ones and put their pieces back by best fit."""
    loads = _loads(sizes, bins)
    gone = np.zeros(len(loads), bool)
    gone[loads.argmin()] = True
    gone[rng.integers(0, len(loads), max(1, len(loads) // 50))] = True
    child = np.where(gone[bins], -1, bins).astype(np.int32)
    kept = child >= 0
    if kept.any():
        _, child[kept] = np.unique(child[kept], return_inverse=True)
    return _refit(sizes, child, capacity)


def _refit(sizes: np.ndarray, child: np.ndarray, capacity: int) -> np.ndarray:
    displaced = np.flatnonzero(child < 0)
    held = child >= 0
    loads = _loads(sizes[held], child[held]).tolist() if held.any() else []
    displaced = displaced[np.argsort(-sizes[displaced], kind="stable")]
    best_fit(sizes, displaced, child, loads, capacity)
    return child


def evolve(sizes: np.ndarray, population: list[np.ndarray], migrant: np.ndarray | None, capacity: int, generations: int, most: int,
           rng: np.random.Generator) -> list[np.ndarray]:
    """The population after some generations, best first. It stops once the lower bound on bins is reached."""
    bound = -(-int(sizes.sum()) // capacity)
    if not population:
        for i in range(most):  # the first is plain best-fit decreasing, the others start from perturbed orders
            order = np.argsort(-(sizes * (1.0 + 0.15 * i / most * rng.standard_normal(len(sizes)))), kind="stable")
            bins, loads = np.full(len(sizes), -1, np.int32), []
            best_fit(sizes, order, bins, loads, capacity)
            population.append(bins)
            if len(loads) == bound:
                break
    if migrant is not None:
        population = [*population, migrant]
    ranked = sorted(((_score(sizes, p, capacity), i) for i, p in enumerate(population)))
    population = [(score, population[i]) for score, i in ranked]
    for _ in range(generations):
        if population[0][0][0] <= bound:
            break
        children = []
        for _ in range(most):
            a, b, c, d = rng.integers(0, len(population), 4)
            child = crossover(sizes, population[min(a, b)][1], population[min(c, d)][1], capacity, rng)
            if rng.random() < 0.5:
                child = mutate(sizes, child, capacity, rng)
            children.append((_score(sizes, child, capacity), child))
        population = sorted([*population, *children], key=lambda x: x[0])[:most]
    return [p for _, p in population[:most]]


def _island(capacity: int, generations: int, most: int, epoch: int):
    """One row (shard, island, sizes, population, migrant) to its next state."""
    def run(key: tuple, table: pa.Table) -> pa.Table:
        shard, island = (k.as_py() for k in key)
        sizes = np.asarray(table.column("sizes")[0].values.to_numpy(zero_copy_only=False), np.int64)
        population = [np.frombuffer(p.as_py(), np.int32) for p in table.column("population")[0].values]
        migrant = table.column("migrant")[0].as_py()
        rng = np.random.default_rng([epoch, island, shard & 0xFFFFFFFF])
        after = evolve(sizes, population, None if migrant is None else np.frombuffer(migrant, np.int32), capacity, generations, most, rng)
        n, bound = int(after[0].max()) + 1, -(-int(sizes.sum()) // capacity)
        return pa.table({"shard": [shard], "island": pa.array([island], pa.int32()), "sizes": pa.array([sizes.astype(np.int32)], pa.list_(pa.int32())),
                         "population": pa.array([[p.astype(np.int32).tobytes() for p in after]], pa.list_(pa.binary())),
                         "bins": pa.array([n], pa.int32()), "solved": [n <= bound]})
    return run


def _place(level: int, capacity: int):
    """A shard's pieces and its best packing to placed pieces; free is the room left in a piece's bin."""
    names = ["row", "length"]

    def run(key: tuple, items: pa.Table, best: pa.Table) -> pa.Table:
        shard = key[0].as_py()
        rows, length = (items.column(c).to_numpy() for c in names)
        order = np.lexsort((rows, -length))  # the order of the shard's sizes
        bins = np.frombuffer(best.column("genome")[0].as_py(), np.int32)
        loads = _loads(length[order], bins)
        by_bin = np.lexsort((np.arange(len(bins)), bins))
        ordered = length[order][by_bin]
        before = np.cumsum(ordered) - ordered
        first = np.concatenate(([0], np.cumsum(loads)[:-1]))
        offset = np.empty(len(bins), np.int64)
        offset[by_bin] = before - first[bins[by_bin]]
        sequence = (np.int64(level) << 56) | (np.int64(shard) << 24) | bins.astype(np.int64)
        return pa.table({"row": rows[order], "length": length[order], "sequence_id": sequence, "offset": offset, "free": capacity - loads[bins]})
    return run


def pack(items: DataFrame, capacity: int = 2048, shard_items: int = 8192, islands: int = 2, epochs: int = 3, generations: int = 4,
         population: int = 6, settled: float = 0.01) -> DataFrame:
    """(row, sequence_id, offset) for items (row, length) with unique rows and 1 <= length <= capacity.

    Every item is placed once, gapless from offset 0 in its sequence, and no sequence holds more than the capacity. Bins
    with at most the share ``settled`` free are final; the pieces of the others are packed again at the next level, as
    long as that leaves fewer shards. An empty table gives an empty result.
    """
    spark = items.sparkSession
    placed = []
    level = 0
    current = items.where(F.col("length") < capacity).select("row", "length")
    full = items.where(F.col("length") == capacity).select(
        "row", (-1 - F.col("row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    placed.append(full)
    count = current.count()
    while count:
        shards = max(1, round(count / shard_items))
        dealt = materialise(current.withColumn("shard", F.pmod(F.xxhash64("row", F.lit(level)), F.lit(shards).cast("long"))), "dealt")
        sizes = F.transform(F.sort_array(F.collect_list(F.struct((-F.col("length")).alias("less"), "row"))), lambda x: (-x["less"]).cast("int"))
        state = (dealt.groupBy("shard").agg(sizes.alias("sizes"))
                 .select("shard", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), "sizes",
                         F.array().cast("array<binary>").alias("population"), F.lit(None).cast("binary").alias("migrant")))
        for epoch in range(epochs):
            state = materialise(state.groupBy("shard", "island").applyInArrow(
                _island(capacity, generations, population, epoch),
                "shard long, island int, sizes array<int>, population array<binary>, bins int, solved boolean"), "islands")
            if epoch + 1 == epochs or not state.where("not solved").limit(1).count():
                break
            elites = state.select("shard", ((F.col("island") + 1) % islands).alias("island"), F.col("population")[0].alias("migrant"))
            state = state.select("shard", "island", "sizes", "population").join(elites, ["shard", "island"])
        order = Window.partitionBy("shard").orderBy("bins", "island")
        best = (state.withColumn("n", F.row_number().over(order)).where("n = 1")
                .select("shard", F.col("population")[0].alias("genome")))
        done = materialise(dealt.groupBy("shard").cogroup(best.groupBy("shard")).applyInArrow(
            _place(level, capacity), "row long, length long, sequence_id long, offset long, free long"), "placed")
        is_open = F.col("free") > settled * capacity
        left = done.where(is_open).count() if shards > 1 else 0
        if left and round(left / shard_items) < shards:
            placed.append(done.where(~is_open).select("row", "sequence_id", "offset"))
            current, count, level = done.where(is_open).select("row", "length"), left, level + 1
        else:
            placed.append(done.select("row", "sequence_id", "offset"))
            count = 0
    result = placed[0]
    for part in placed[1:]:
        result = result.unionByName(part)
    return result


def packed_documents(docs: DataFrame, vocabulary: str, capacity: int = 2048, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32, row, sequence_id, offset): all documents as pieces in sequences.

    * null and empty texts are a closing id alone and take a place; null ids and repeated rows are packed like any other
    * documents beyond the capacity are cut into pieces of it; extra columns are ignored; an empty table gives none
    """
    rows = materialise(pieces(docs, vocabulary, capacity, False, id_column, text_column).withColumn("row", F.monotonically_increasing_id()), "pieces")
    return rows.join(pack(rows.select("row", "length"), capacity), "row")


def token_sequences(docs: DataFrame, vocabulary: str, capacity: int = 2048, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(sequence_id, ids): the packed token ids themselves, at most ``capacity`` per row."""
    rows = materialise(pieces(docs, vocabulary, capacity, True, id_column, text_column).withColumn("row", F.monotonically_increasing_id()), "pieces")
    placed = rows.join(pack(rows.select("row", "length"), capacity), "row")
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return placed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))


def op10_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    packed = packed_documents(docs, public_tokenizers.path("word_bpe_49k.json"))
    return packed.select(F.col("id").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
