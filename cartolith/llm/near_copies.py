"""Near copies of texts: SimHash groups and MinHash bands find candidates, word shingles decide.

A text is the set of its five-word shingles. Texts of a group of linked SimHash fingerprints (deletion variants, see
``simhash``) are candidates with the group's first text, and so, as few bits of 64 do not reach down to the threshold, are
texts that agree in some band of MinHash values. A text goes
only if its Jaccard similarity with one that stays is at least the threshold: in the order of their ids, each text stays
unless a smaller one that stays is that similar. Removals are never passed on along chains.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from cartolith.llm import simhash
from cartolith.session import materialise

SEED = 42
BANDS, ROWS = 25, 6  # a pair at similarity 0.8 meets in some band with probability 0.9995
_NODE, _KEYS = "__copy_node", "__copy_keys"


def shingles(text: str | None, words: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; a text of fewer words is one shingle, one of no words has none."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    joined = b" ".join(found)
    digest = xxhash.xxh64_intdigest
    if len(found) <= words:
        return np.array([digest(joined, SEED)], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = words - 1
    return np.unique(np.array([digest(joined[a:b], SEED) for a, b in zip(starts[:len(found) - last].tolist(), ends[last:].tolist())], np.uint64))


def _node(hashes: np.ndarray) -> int:
    """Texts of equal shingle sets are one node."""
    return xxhash.xxh64_intdigest(hashes.tobytes(), SEED) if len(hashes) else 0


@cache
def _functions() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    factors = rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return factors, rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def band_keys(hashes: np.ndarray, slice_: int = 1 << 12) -> np.ndarray:
    """One key per band of MinHash values; none for a text of no words."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    factors, offsets = _functions()
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for at in range(0, len(hashes), slice_):
        mixed = hashes[at:at + slice_, None] * factors + offsets
        least = np.minimum(least, (mixed ^ (mixed >> np.uint64(32))).min(axis=0))
    return np.array([xxhash.xxh64_intdigest(least[b * ROWS:(b + 1) * ROWS].tobytes(), b) for b in range(BANDS)], np.uint64).view(np.int64)


def _signed(docs: DataFrame, words: int, text_column: str) -> DataFrame:
    """docs with the node and the band keys of every text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, keys = [], []
            for text in batch.column(batch.schema.get_field_index(text_column)):
                hashes = shingles(text.as_py(), words)
                nodes.append(_node(hashes))
                keys.append(band_keys(hashes))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array(keys, pa.list_(pa.int64()))],
                                             [*batch.schema.names, _NODE, _KEYS])

    added = [T.StructField(_NODE, T.LongType()), T.StructField(_KEYS, T.ArrayType(T.LongType()))]
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *added]))


def _shingle_sets(texts: DataFrame, words: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                yield pa.RecordBatch.from_arrays([pa.array([node]), pa.array([shingles(text.as_py(), words).view(np.int64)], pa.list_(pa.int64()))],
                                                 ["node", "hashes"])

    return texts.mapInArrow(run, "node long, hashes array<long>")


def _similar(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Those of the pairs (node, other) whose shingle sets are similar enough."""
    both = pairs.join(sets, "node").join(sets.select(F.col("node").alias("other"), F.col("hashes").alias("theirs")), "other")
    shared = F.size(F.array_intersect("hashes", "theirs"))
    return (both.select("node", "other", shared.alias("shared"), (F.size("hashes") + F.size("theirs")).alias("sizes"))
            .where(F.col("shared") >= threshold * (F.col("sizes") - F.col("shared"))).select("node", "other"))


def fingerprint_meets(rows: DataFrame, nodes: DataFrame, words: int, text_column: str = "text", max_bits: int = 4) -> DataFrame:
    """(key, rank): every node of a group of linked SimHash fingerprints paired with the group's first, a key for each pair."""
    groups = simhash.simhash_groups(rows, max_bits, words, id_column=_NODE, text_column=text_column)
    member = groups.select("component_id", F.col("id").alias(_NODE)).distinct().join(nodes.select(_NODE, "rank"), _NODE)
    first = member.groupBy("component_id").agg(F.min("rank").alias("first"), F.count("*").alias("n")).where("n > 1")
    pairs = member.join(first, "component_id").where("rank <> first").select(F.xxhash64(F.lit("fingerprints"), "component_id", _NODE).alias("key"), "rank", "first")
    return pairs.select("key", F.explode(F.array("rank", "first")).alias("rank"))


def _settle(meets: DataFrame, similar, name: str, rounds: int | None):
    """(removed, rest): greedy choice along groups (key, rank) of which only the smallest rank is compared in a round.

    A text that is the smallest of all its groups stays; those similar to it go; both leave the groups. ``similar`` keeps
    the similar ones of pairs (node, other). ``rest`` is what has not been settled after ``rounds``.
    """
    removed = None
    while (rounds is None or rounds > 0) and meets.limit(1).count():
        leads = meets.groupBy("key").agg(F.min("rank").alias("lead"))
        pairs = materialise(meets.join(leads, "key").select(F.col("rank").alias("low"), "lead").where("low <> lead").distinct(), f"{name}-pairs")
        settled = pairs.select("lead").distinct().join(pairs.select(F.col("low").alias("lead")).distinct(), "lead", "left_anti")
        settled = materialise(settled, f"{name}-settled")
        gone = materialise(similar(pairs.join(settled, "lead").select(F.col("low.node").alias("node"), F.col("lead.node").alias("other")))
                           .select("node").distinct(), f"{name}-gone")
        removed = gone if removed is None else removed.unionByName(gone)
        left = meets.join(settled.select(F.col("lead").alias("rank")), "rank", "left_anti").withColumn("node", F.col("rank.node"))
        left = left.join(gone, "node", "left_anti").select("key", "rank")
        several = left.groupBy("key").count().where("count > 1").select("key")
        meets = materialise(left.join(several, "key", "left_semi"), f"{name}-meets")
        rounds = None if rounds is None else rounds - 1
    return removed, meets


def without_near_copies(docs: DataFrame, words: int = 5, threshold: float = 0.8, rounds: int = 6, id_column: str = "doc_id",
                        text_column: str = "text") -> DataFrame:
    """Rows of docs, one per set of shingles, without those similar to a smaller row that stays.

    * rows are ordered by id, rows without an id last; of equal shingle sets the row of the smallest id stays
    * every row that goes has a similarity of at least ``threshold`` with one that stays; candidates come from ``simhash``
      groups and MinHash bands, so a similar pair is missed with a probability that falls with its similarity (0.0005
      at 0.8)
    * null and empty texts and texts of white space are one set; an empty table gives an empty result

    Groups are first compared with their smallest row only, which settles groups of copies however large. What ``rounds``
    leave, groups of unlike texts, is compared pair by pair; nothing is left out.
    """
    columns = docs.columns
    rows = materialise(_signed(docs, words, text_column), "copies-rows")
    who = F.struct(F.col(id_column).isNull().alias("nameless"), F.col(id_column).cast("long").alias("id"), F.col(_NODE).alias("node"))
    nodes = materialise(rows.groupBy(_NODE).agg(F.min(who).alias("rank"), F.first(_KEYS).alias("keys")), "copies-nodes")
    meets = nodes.select(F.explode("keys").alias("key"), "rank").unionByName(fingerprint_meets(rows, nodes, words, text_column))
    several = meets.groupBy("key").count().where("count > 1").select("key")
    meets = materialise(meets.join(several, "key", "left_semi"), "copies-meets")
    texts = (rows.join(meets.select(F.col("rank.node").alias(_NODE)).distinct(), _NODE, "left_semi").select(_NODE, text_column)
             .groupBy(_NODE).agg(F.min(text_column).alias("text")))
    sets = materialise(_shingle_sets(texts, words), "copies-sets")

    gone, rest = _settle(meets, lambda pairs: _similar(pairs, sets, threshold), "copies", rounds)
    removed = [gone] if gone is not None else []
    if rest.limit(1).count():
        other = rest.select("key", F.col("rank").alias("lead"))
        pairs = rest.join(other, "key").where("rank > lead").select("rank", "lead").distinct()
        ranks = pairs.select("rank", "lead", F.col("rank.node").alias("node"), F.col("lead.node").alias("other"))
        near = _similar(ranks.select("node", "other"), sets, threshold)
        edges = materialise(ranks.join(near, ["node", "other"]).select("rank", "lead", F.xxhash64("node", "other").alias("key")), "copies-edges")
        ends = edges.select("key", "rank").unionByName(edges.select("key", F.col("lead").alias("rank")))
        gone, _ = _settle(materialise(ends, "copies-ends"), lambda pairs: pairs, "copies", None)  # all are similar
        removed += [gone] if gone is not None else []
    stay = nodes.select(_NODE, "rank")
    for gone in removed:
        stay = stay.join(gone.select(F.col("node").alias(_NODE)), _NODE, "left_anti")
    return (rows.drop(_KEYS).join(stay, _NODE).where(F.col(id_column).cast("long").eqNullSafe(F.col("rank.id")))
            .dropDuplicates([_NODE]).select(*columns))
