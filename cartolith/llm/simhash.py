"""Near duplicates by SimHash: deletion-variant signatures of fingerprint segments.

Two 64-bit fingerprints that differ in at most k bits, cut into s segments with k < 2s, agree in some segment up to one
bit. Every segment is therefore indexed once per bit with that bit blanked out; segments that differ in one bit meet under
the variant that blanks it. For k = 4 three segments suffice, and the keys keep 20 or 21 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from cartolith.llm.components import connected_components
from cartolith.llm.streams import numbers, sorted_groups
from cartolith.session import materialise

SEED = 42


def fingerprint(text: str | None, words: int = 4) -> int:
    """Unsigned fingerprint of one text: majority bits of its word shingles' XXH64. No words give zero."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()  # on bytes: A-Z only, and ASCII white space
    if not found:
        return 0
    joined = b" ".join(found)
    digest = xxhash.xxh64_intdigest
    if len(found) < words:
        hashes = [digest(joined, SEED)]
    else:
        ends = np.cumsum([len(w) + 1 for w in found]) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        last = words - 1
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts[:len(found) - last].tolist(), ends[last:].tolist())]
    ones = np.zeros(64, np.int64)
    values = np.array(hashes, "<u8")
    for at in range(0, len(values), 1 << 16):
        part = values[at:at + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(values), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 4, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, fp): fp is the signed long with the fingerprint's bits. One row per row of docs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([fingerprint(t.as_py(), words) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values)], ["id", "fp"])

    narrow = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"))
    return narrow.mapInArrow(run, "id long, fp long")


def segment_bounds(segments: int) -> list[tuple[int, int]]:
    """(first bit, bits) of each segment; wider ones last."""
    cuts = [64 * i // segments for i in range(segments + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def variants(fps: DataFrame, segments: int) -> DataFrame:
    """(key, fp): one row per bit of every segment; key holds the bit's number and the segment without that bit."""
    keys = []
    for low, bits in segment_bounds(segments):
        segment = F.shiftrightunsigned("fp", low).bitwiseAND(F.lit((1 << bits) - 1))
        for bit in range(bits):
            keys.append(F.lit((low + bit) << 40).bitwiseOR(segment.bitwiseAND(F.lit(((1 << bits) - 1) & ~(1 << bit)))))
    return fps.select(F.explode(F.array(*keys)).alias("key"), "fp")


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return starts, np.diff(np.concatenate((starts, [len(keys)])))


def _links_in_run(fps: np.ndarray, max_bits: int, block: int = 1024, cut: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links within one bucket, or of those between fps[:cut] and fps[cut:].

    Compared block by block; labels follow what is joined, so at most one edge per fingerprint is held at any time, and
    blocks whose fingerprints are one part already are not compared.
    """
    label = np.arange(len(fps))
    left, right = [], []
    middle = len(fps) if cut is None else cut
    for i in range(0, middle, block):
        mine = slice(i, min(i + block, middle))
        for j in range(i if cut is None else cut, len(fps), block):
            theirs = slice(j, j + block)
            if (label[mine] == label[i]).all() and (label[theirs] == label[i]).all():
                continue
            near = np.bitwise_count(fps[mine, None] ^ fps[None, theirs]) <= max_bits
            while True:
                near &= label[mine, None] != label[None, theirs]
                a = np.flatnonzero(near.any(axis=1))
                if not len(a):
                    break
                a, b = i + a, j + near[a].argmax(axis=1)
                names, at = np.unique(label[np.concatenate((a, b))], return_inverse=True)
                parent = list(range(len(names)))

                def root(x: int) -> int:
                    while parent[x] != x:
                        parent[x] = parent[parent[x]]
                        x = parent[x]
                    return x

                for x, y, p, q in zip(a.tolist(), b.tolist(), at[:len(a)].tolist(), at[len(a):].tolist()):
                    p, q = root(p), root(q)
                    if p != q:
                        parent[max(p, q)] = min(p, q)
                        left.append(x)
                        right.append(y)
                table = np.arange(len(fps))
                table[names] = names[[root(x) for x in range(len(names))]]
                label = table[label]
    return fps[np.array(left, np.int64)], fps[np.array(right, np.int64)]


def bucket_links(max_bits: int):
    """Arrow function over rows (key, fp) sorted by key: verified links, at most one fewer than each bucket has rows."""
    def links(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        starts, sizes = _runs(keys)
        at = starts[sizes == 2]
        x, y = fps[at], fps[at + 1]
        near = np.bitwise_count(x ^ y) <= max_bits
        left, right = [x[near]], [y[near]]
        for start, size in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
            x, y = _links_in_run(fps[start:start + size], max_bits)
            left.append(x)
            right.append(y)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(p).view(np.int64)) for p in (left, right)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        for batch in batches:
            keys = np.concatenate((keys, batch.column(0).to_numpy(zero_copy_only=False)))
            fps = np.concatenate((fps, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)))
            starts, _ = _runs(keys)
            if len(starts) < 2:
                continue
            whole = starts[-1]  # the last bucket may go on in the next batch
            yield links(keys[:whole], fps[:whole])
            keys, fps = keys[whole:], fps[whole:]
        if len(keys):
            yield links(keys, fps)
    return run


def block_links(max_bits: int):
    """Arrow function over rows (key, i, j, side, fp) sorted by the first three: a forest of the links of each block pair."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches, 3):
            side, fps = numbers(group.column("side")), numbers(group.column("fp")).view(np.uint64)
            left, right = fps[side == 0], fps[side == 1]
            same = group.column("i")[0].as_py() == group.column("j")[0].as_py()
            x, y = _links_in_run(np.concatenate((left, right)), max_bits, cut=None if same else len(left))
            yield pa.RecordBatch.from_arrays([pa.array(p.view(np.int64)) for p in (x, y)], ["a", "b"])
    return run


def block_pairs(keyed: DataFrame, large: DataFrame, block: int) -> DataFrame:
    """(key, i, j, side, fp): the rows of large buckets (key, n), once for every pair of blocks that holds their own."""
    placed = (keyed.join(large.select("key", F.ceil(F.col("n") / block).cast("int").alias("blocks")), "key")
              .withColumn("own", F.pmod(F.xxhash64("fp"), "blocks").cast("int")))
    pair = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(
        F.least("own", o).alias("i"), F.greatest("own", o).alias("j"), F.when(F.col("own") <= o, 0).otherwise(1).alias("side")))
    return placed.select("key", F.explode(pair).alias("p"), "fp").select("key", "p.i", "p.j", "p.side", "fp")


def simhash_groups(docs: DataFrame, max_bits: int = 4, words: int = 4, id_column: str = "doc_id", text_column: str = "text",
                   block: int = 1 << 15) -> DataFrame:
    """(id, fp, component_id, kept): groups of documents whose fingerprints are linked by at most ``max_bits`` bits.

    * one row per row of docs, repeated rows included; component_id is the smallest id reachable, kept is id = component_id
    * null and empty texts have fingerprint zero and link like any other; so do texts of any length, whole
    * a null id gets its group's component_id (null if no member has an id) and is never kept
    * extra columns of docs are ignored; an empty table gives an empty result

    Equal fingerprints are one node from the start, so exact copies cost one row of a partial aggregate. Within a bucket
    only a spanning forest leaves the task, never the pairs, and no bucket is cut short. Buckets of more than ``block``
    fingerprints are dealt out as pairs of blocks, so that no task gathers more than about two blocks.
    """
    rows = materialise(fingerprints(docs, words, id_column, text_column), "fingerprints")
    nodes = materialise(rows.groupBy("fp").agg(F.min("id").alias("least_id")), "nodes")
    segments = max_bits // 2 + 1
    keyed = variants(nodes.select("fp"), segments)
    large = materialise(keyed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > block), "large")
    some = large.limit(1).count() > 0
    small = keyed.join(large, "key", "left_anti") if some else keyed
    links = small.repartition("key").sortWithinPartitions("key").mapInArrow(bucket_links(max_bits), "a long, b long")
    if some:
        links = links.unionByName(block_pairs(keyed, large, block).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
                                  .mapInArrow(block_links(max_bits), "a long, b long"))
    linked = materialise(connected_components(links), "components")
    least = linked.join(nodes, F.col("node") == F.col("fp")).groupBy("component").agg(F.min("least_id").alias("component_id"))
    named = linked.join(least, "component").select(F.col("node").alias("fp"), "component_id")
    labels = nodes.join(named, "fp", "left").select("fp", F.coalesce("component_id", "least_id").alias("component_id"))
    return (rows.join(labels, "fp", "left")
            .select("id", "fp", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept")))


def op2_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    groups = simhash_groups(docs)
    return groups.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "kept")
