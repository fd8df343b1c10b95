"""Cross-tokenizer alignment: which tokens of one vocabulary stand where which tokens of another stand, counted corpus-wide.

Both vocabularies cut a text before every blank that follows a visible character, so a text is aligned chunk by chunk, and each
distinct chunk once per worker. A first pass finds the distinct pairs of linked ids; they get a minimal perfect hash, built bucket by bucket.
Counts are dense vectors by that hash, summed in a tree. A second pass aligns the documents again and looks the counts up;
the pair that stands at a hash value is compared, so a pair that was never counted is noticed.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from cartolith.llm.streams import numbers
from cartolith.llm.wordbpe import _byte_letters
from cartolith.session import materialise

_BLANK = "▁"
# fixed value: a visible character, which is no white space in the sense of any of the libraries, and a blank
_CUT = r"([^\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]) "
_SLICE = 4 << 20  # bytes of text aligned at a time; one longer text is a slice of its own
KEPT = 200_000  # chunks kept per worker and generation; the last two generations are kept
B_IDS = 1 << 16  # ids of B are below this


# one worker's aligner --------------------------------------------------------------------------------------------------


class Chunks:
    """Alignments of chunks by number: token and group counts, spelled groups, and links as pairs a * B_IDS + b."""

    def __init__(self) -> None:
        self.at: dict[str, int] = {}
        self.sums: list[tuple[int, int, int]] = []  # tokens of A, tokens of B, groups; -1 where bytes differ
        self.groups: list[str] = []
        self.links: list[np.ndarray] = []

    def add(self, chunks: list[str], sums: list, groups: list[str], links: list[np.ndarray]) -> None:
        self.at.update(zip(chunks, range(len(self.sums), len(self.sums) + len(chunks))))
        self.sums += sums
        self.groups += groups
        self.links += links


class Aligner:
    """Aligns chunks; without ``spelled`` the text of their groups stays empty."""

    def __init__(self, a_path: str, b_path: str, spelled: bool = True) -> None:
        self.spelled = spelled
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        if self.b.get_piece_size() > B_IDS or any(_BLANK in self.b.id_to_piece(i).lstrip(_BLANK) for i in range(self.b.get_piece_size())):
            raise ValueError("the second vocabulary joins words, or has more than 65536 ids")
        byte_of = {c: b for b, c in enumerate(_byte_letters())}
        model = json.loads(self.a.to_str())
        spelled = {i: t for t, i in model["model"]["vocab"].items()}
        self.a_bytes = [bytes(byte_of[c] for c in spelled[i]) if all(c in byte_of for c in spelled.get(i, "\n")) else None for i in range(max(spelled) + 1)]
        self.b_bytes = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            self.b_bytes.append(bytes([int(piece[3:-1], 16)]) if self.b.is_byte(i) else None if self.b.is_unknown(i) or self.b.is_control(i)
                                else piece.replace(_BLANK, " ").encode("utf-8"))
        self.sizes = [np.array([len(x or b"") for x in side], np.int64) for side in (self.a_bytes, self.b_bytes)]
        # an id as it is spelled inside a group, and at the end of its side of a group
        self.names = [np.array([[f"{i},", f"{i}{last}"] for i in range(len(side))], object) for side, last in ((self.a_bytes, "|"), (self.b_bytes, ";"))]
        self.widths = [np.array([len(x) for x in side[:, 0]], np.int64) for side in self.names]
        self.chunks, self.older = Chunks(), Chunks()

    def _ids(self, text: str) -> list[np.ndarray]:
        """Ids of both vocabularies for chunks in a row."""
        b = self.b.encode(text[1:], num_threads=1) if len(text) > 1 else [self.b.piece_to_id(_BLANK)]  # a blank at the end of a longer text
        return [np.array(self.a.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int64), np.array(b, np.int64)]

    def _same_bytes(self, ids: list[np.ndarray], own: bytes) -> bool:
        for side, some in zip((self.a_bytes, self.b_bytes), ids):
            parts = [side[i] for i in some.tolist()]
            if None in parts or b"".join(parts) != own:
                return False
        return True

    def _align(self, chunks: list[str]) -> tuple[list, list[str], list[np.ndarray]]:
        """Sums, spelled groups and links of chunks none of which is changed by standing in a row with the others."""
        text = "".join(chunks)
        ids = self._ids(text)
        if not self._same_bytes(ids, text.encode("utf-8")):
            if len(chunks) == 1:
                return [(-1, -1, -1)], [""], [np.zeros(0, np.int64)]
            found: tuple[list, list[str], list[np.ndarray]] = [], [], []
            half = len(chunks) // 2
            for part in (self._align(chunks[:half]), self._align(chunks[half:])):
                for old, new in zip(found, part):
                    old += new
            return found
        ends = [np.cumsum(size[i]) for size, i in zip(self.sizes, ids)]
        borders = np.cumsum([len(c.encode("utf-8")) for c in chunks])
        cuts = np.union1d(*ends)  # between two of them lies the overlap of one pair of tokens, and of each pair but one
        links = ids[0][np.searchsorted(ends[0], cuts)] * B_IDS + ids[1][np.searchsorted(ends[1], cuts)]
        both = np.intersect1d(*ends, assume_unique=True)
        counts = [np.searchsorted(x, borders, side="right") for x in (*ends, both, cuts)]
        sums = np.column_stack([np.diff(c, prepend=0) for c in counts[:3]])
        split = counts[3].tolist()
        texts = self._spelled(ids, [np.searchsorted(both, x) for x in ends], counts[0] + counts[1]) if self.spelled else [""] * len(chunks)
        return list(map(tuple, sums.tolist())), texts, [links[x:y].copy() for x, y in zip([0, *split[:-1]], split)]

    def _spelled(self, ids: list[np.ndarray], group: list[np.ndarray], borders: np.ndarray) -> list[str]:
        """The groups of every chunk as text, from the group each token is in and the tokens up to each chunk's end."""
        order = np.argsort(np.concatenate((2 * group[0], 2 * group[1] + 1)), kind="stable")
        last = [np.append(g[1:] != g[:-1], True).astype(np.int64) for g in group]
        whole = "".join(np.concatenate([n[i, k] for n, i, k in zip(self.names, ids, last)])[order].tolist())
        at = np.cumsum(np.concatenate([w[i] for w, i in zip(self.widths, ids)])[order])[borders - 1].tolist()
        return [whole[x:y - 1] for x, y in zip([0, *at[:-1]], at)]

    def learn(self, chunks: list[str]) -> Chunks:
        """Makes all of some distinct chunks known. Each starts with the blank that B adds by itself."""
        if len(self.chunks.at) > KEPT:
            self.older, self.chunks = self.chunks, Chunks()
        known, older = self.chunks, self.older
        missing = [c for c in chunks if c not in known.at]
        new = [c for c in missing if c not in older.at]
        if len(new) < len(missing):
            kept = [c for c in missing if c in older.at]
            at = [older.at[c] for c in kept]
            known.add(kept, [older.sums[i] for i in at], [older.groups[i] for i in at], [older.links[i] for i in at])
        firm = [c for c in new if not c[-1].isspace()]  # the others only stand at the end of a text
        for first in range(0, len(firm), 1000):
            some = firm[first:first + 1000]
            known.add(some, *self._align(some))
        for chunk in new if len(firm) < len(new) else ():
            if chunk[-1].isspace():
                known.add([chunk], *self._align([chunk]))
        return known


_LOADED: dict[tuple, Aligner] = {}


def _aligner(paths: tuple[str, str], spelled: bool) -> Aligner:
    key = (*paths, spelled)
    if key not in _LOADED:
        _LOADED.clear()  # a worker works at one pass at a time
        _LOADED[key] = Aligner(*paths, spelled)
    return _LOADED[key]


def _aligned(batches: Iterator[pa.RecordBatch], paths: tuple[str, str], at: int, spelled: bool = True):
    """Slices (batch, first, rows, chunks in use as numbers, per row its chunks, per row whether it has tokens)."""
    aligner = _aligner(paths, spelled)
    for batch in batches:
        texts = batch.column(at)
        sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        first = 0
        while first < batch.num_rows:
            last = max(first + 1, int(np.searchsorted(sizes, (sizes[first - 1] if first else 0) + _SLICE)))
            some = pc.fill_null(texts.slice(first, last - first), "").cast(pa.large_string())
            strange = pc.or_(pc.equal(pc.binary_length(some), 0), pc.match_substring(some, _BLANK))
            some = pc.if_else(strange, pa.scalar("", some.type), some)
            spaced = pc.binary_join_element_wise(pa.scalar(" ", some.type), some, pa.scalar("", some.type))
            parts = pc.split_pattern(pc.replace_substring_regex(spaced, _CUT, "\\1" + _BLANK + " "), _BLANK)
            coded = pc.dictionary_encode(parts.values)
            names = coded.dictionary.to_pylist()
            chunks = aligner.learn(names)
            number = np.fromiter(map(chunks.at.__getitem__, names), np.int64, len(names))
            ends = parts.offsets.to_numpy()
            own = coded.indices.to_numpy().astype(np.int64)
            sums = np.array([chunks.sums[n] for n in number], np.int64).reshape(-1, 3)
            whole = ~strange.to_numpy(zero_copy_only=False) & (np.add.reduceat(sums[own, 0] < 0, ends[:-1]) == 0)
            yield batch.slice(first, last - first), chunks, number, sums, own, ends, whole
            first = last


# minimal perfect hash --------------------------------------------------------------------------------------------------

_MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)  # fixed values: a public 64-bit mixer


def mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    x = keys.astype(np.uint64) + np.uint64(_MIX[0] * (seed + 1) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(_MIX[1])
    x = (x ^ (x >> np.uint64(27))) * np.uint64(_MIX[2])
    return x ^ (x >> np.uint64(31))


def build_hash(keys: np.ndarray) -> list[np.ndarray]:
    """Bit arrays, level by level, for distinct keys: a key stands at the first level where no other one shares its place."""
    levels = []
    while len(keys):
        size = 2 * len(keys)
        place = (mixed(keys, len(levels) + 1) % np.uint64(size)).astype(np.int64)
        alone = np.bincount(place, minlength=size) == 1
        levels.append(alone)
        keys = keys[~alone[place]]
    return levels


class PairTable:
    """Hash, pairs and counts of all buckets, for lookups of many pairs at once."""

    def __init__(self, buckets: int, levels: dict[int, list[np.ndarray]], keys: dict[int, np.ndarray], counts: dict[int, np.ndarray], best: np.ndarray) -> None:
        self.buckets = buckets
        depth = max((len(v) for v in levels.values()), default=0)
        self.size, self.offset = np.zeros((buckets, depth), np.int64), np.zeros((buckets, depth), np.int64)
        bits, used = [], 0
        for b in range(buckets):
            for d, level in enumerate(levels.get(b, [])):
                self.size[b, d], self.offset[b, d] = len(level), used
                bits.append(level)
                used += len(level)
        self.bits = np.concatenate(bits) if bits else np.zeros(0, bool)
        self.rank = (np.cumsum(self.bits) - 1).astype(np.int32)
        order = [b for b in range(buckets) if b in keys]
        self.keys = np.concatenate([keys[b] for b in order]).astype(np.uint32) if order else np.zeros(0, np.uint32)
        self.counts = np.concatenate([counts[b] for b in order]) if order else np.zeros(0, np.int64)
        self.is_best = self.counts == best[self.keys.astype(np.int64) % B_IDS]

    def places(self, keys: np.ndarray) -> np.ndarray:
        """The place of each pair; one that is not in the table is an error."""
        found = np.full(len(keys), -1, np.int64)
        bucket = (mixed(keys, 0) % np.uint64(self.buckets)).astype(np.int64)
        rest = np.arange(len(keys))
        for d in range(self.size.shape[1]):
            own = bucket[rest]
            size = self.size[own, d]
            rest, own, size = rest[size > 0], own[size > 0], size[size > 0]
            at = self.offset[own, d] + (mixed(keys[rest], d + 1) % size.astype(np.uint64)).astype(np.int64)
            hit = self.bits[at]
            found[rest[hit]] = self.rank[at[hit]]
            rest = rest[~hit]
        if (found < 0).any() or (self.keys[found] != keys).any():
            raise ValueError("a linked pair was never counted")
        return found


def _bucket_places(levels: list[np.ndarray], keys: np.ndarray) -> np.ndarray:
    """The places of keys in one bucket, -1 for one that has none."""
    place, used = np.full(len(keys), -1, np.int64), 0
    for d, level in enumerate(levels):
        at = (mixed(keys, d + 1) % np.uint64(len(level))).astype(np.int64)
        mine = (place < 0) & level[at]
        place[mine] = used + (np.cumsum(level) - 1)[at[mine]]
        used += int(level.sum())
    return place


def _unpacked(sizes, levels) -> list[np.ndarray]:
    return [np.unpackbits(np.frombuffer(x, np.uint8), count=n).astype(bool) for n, x in zip(sizes, levels)]


def _hash_bucket(key: tuple, table: pa.Table) -> pa.Table:
    """All distinct pairs of a bucket to its levels, packed, and its pairs in hash order."""
    keys = np.sort(numbers(table.column("pair")))
    levels = build_hash(keys)
    ordered = np.empty_like(keys)
    ordered[_bucket_places(levels, keys)] = keys
    return pa.table({"bucket": pa.array([key[0].as_py()], pa.int64()), "sizes": pa.array([[len(x) for x in levels]], pa.list_(pa.int64())),
                     "levels": pa.array([[np.packbits(x).tobytes() for x in levels]], pa.list_(pa.binary())),
                     "pairs": pa.array([ordered], pa.list_(pa.int64()))})


_HASH = "bucket long, sizes array<long>, levels array<binary>, pairs array<long>"


def _vector(key: tuple, counts: np.ndarray) -> pa.Table:
    return pa.table({"bucket": pa.array([key[0].as_py()], pa.int64()), "leaf": pa.array([key[1].as_py()], pa.int64()), "counts": pa.array([counts], pa.list_(pa.int64()))})


def _dense(key: tuple, found: pa.Table, table: pa.Table) -> pa.Table:
    """Counts of some pairs of a bucket as a dense vector by its hash."""
    pairs = numbers(table.column("pairs")[0].values)
    counts = np.zeros(len(pairs), np.int64)
    if found.num_rows:
        keys = numbers(found.column("pair"))
        place = _bucket_places(_unpacked(table.column("sizes")[0].as_py(), table.column("levels")[0].as_py()), keys)
        if (place < 0).any() or (pairs[place] != keys).any():
            raise ValueError("a linked pair has no place")
        np.add.at(counts, place, numbers(found.column("n")))
    return _vector(key, counts)


def _sum_vectors(key: tuple, vectors: pa.Table) -> pa.Table:
    total = np.zeros(len(vectors.column("counts")[0]), np.int64)
    for v in vectors.column("counts"):
        total += numbers(v.values)
    return _vector(key, total)


# the passes ------------------------------------------------------------------------------------------------------------


def linked_pairs(docs: DataFrame, paths: tuple[str, str], text_column: str = "text") -> DataFrame:
    """(pair, n): links of the texts by pair a * B_IDS + b, in parts that are still to be summed."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, int] = {}

        def settle():
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array(list(held.values()), pa.int64())], ["pair", "n"])
            held.clear()

        for _, chunks, number, _, own, ends, whole in _aligned(batches, paths, 0, False):
            times = np.bincount(own[np.repeat(whole, np.diff(ends))], minlength=len(number))
            links = [chunks.links[n] for n in number]
            pairs = np.concatenate(links) if links else np.zeros(0, np.int64)
            keys, which = np.unique(pairs, return_inverse=True)
            sums = np.zeros(len(keys), np.int64)
            np.add.at(sums, which, np.repeat(times, [len(x) for x in links]))
            for k, n in zip(keys[sums > 0].tolist(), sums[sums > 0].tolist()):
                held[k] = held.get(k, 0) + n
            if len(held) > 500_000:
                yield from settle()
        yield from settle()

    return docs.select(F.col(text_column).cast("string").alias("text")).mapInArrow(run, "pair long, n long")


def pair_counts(docs: DataFrame, paths: tuple[str, str], bucket_pairs: int = 1 << 16, fan_in: int = 16, text_column: str = "text") -> tuple[int, DataFrame]:
    """The number of buckets, and (bucket, sizes, levels, pairs, counts) with a row for each bucket that has pairs.

    Vectors are dense, so a leaf of the tree takes about as many rows as its bucket has pairs; a hot pair has one row per part.
    """
    parts = materialise(linked_pairs(docs, paths, text_column), "pairs")
    distinct = materialise(parts.select("pair").distinct(), "distinct-pairs")
    total, rows = distinct.count(), parts.count()
    buckets, leaves = max(1, -(-total // bucket_pairs)), max(1, rows // max(1, total))

    def bucket_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = (mixed(numbers(batch.column(0)), 0) % np.uint64(buckets)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own)], [*batch.schema.names, "bucket"])

    table = materialise(distinct.mapInArrow(bucket_of, "pair long, bucket long").groupBy("bucket").applyInArrow(_hash_bucket, _HASH), "pair-hash")
    dealt = parts.mapInArrow(bucket_of, "pair long, n long, bucket long").withColumn("leaf", F.floor(F.rand(3) * leaves).cast("long"))
    spread = table.withColumn("leaf", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(leaves - 1).cast("long"))))
    kind = "bucket long, leaf long, counts array<long>"
    vectors = materialise(dealt.groupBy("bucket", "leaf").cogroup(spread.groupBy("bucket", "leaf")).applyInArrow(_dense, kind), "vectors")
    while leaves > 1:
        vectors = materialise(vectors.withColumn("leaf", F.floor(F.col("leaf") / fan_in).cast("long")).groupBy("bucket", "leaf").applyInArrow(_sum_vectors, kind), "vectors")
        leaves = -(-leaves // fan_in)
    return buckets, materialise(table.join(vectors.select("bucket", "counts"), "bucket"), "pair-counts")


def _best(counted: DataFrame) -> DataFrame:
    """(b, best): the highest count of any pair of an id of B; at most B_IDS rows."""
    each = counted.select(F.explode(F.arrays_zip("pairs", "counts")).alias("x")).select((F.col("x.pairs") % B_IDS).alias("b"), F.col("x.counts").alias("n"))
    return each.groupBy("b").agg(F.max("n").alias("best"))


_OUT = ("n_a long, n_b long, n_groups long, n_links long", "groups_sha256 string")


def _rows(batches: Iterator[pa.RecordBatch], paths: tuple[str, str], at: int, value):
    """(rows, n_a, n_b, n_groups, n_links, spelled groups, per row two sums of what ``value`` gives for the links of a chunk)."""
    for rows, chunks, number, sums, own, ends, whole in _aligned(batches, paths, at):
        links = [chunks.links[n] for n in number]
        sizes = np.array([len(x) for x in links], np.int64)
        flat = np.concatenate(links) if links else np.zeros(0, np.int64)
        per = np.column_stack((sums, sizes, *value(flat, sizes)))
        totals = np.add.reduceat(per[own], ends[:-1], axis=0) * whole[:, None]
        spelled = [chunks.groups[n] for n in number]
        text = [";".join([spelled[k] for k in own[a:b].tolist()]) if ok else "" for a, b, ok in zip(ends[:-1], ends[1:], whole)]
        yield rows, totals, text, (links, own, ends, whole)


def _segments(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of so many values; empty runs have sum 0."""
    before = np.concatenate(([0], np.cumsum(values)))
    ends = np.cumsum(sizes)
    return before[ends] - before[ends - sizes]


def align(docs: DataFrame, a_path: str, b_path: str, id_column: str = "doc_id", text_column: str = "text", shipped_pairs: int = 4_000_000,
          bucket_pairs: int = 1 << 16, spelled: bool = True) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups, groups_sha256), one row per row of docs.

    ``groups`` spells every group as ``a1,a2|b1``, joined by semicolons; the digest is that of this text; without ``spelled`` the text itself is left out.

    * null and empty texts, and texts whose joined token bytes in A or B differ from a blank and the text, have no tokens: zeros and ''
    * ties for the highest count of an id of B all count; repeated rows are aligned and counted as often as they stand there
    * texts of any length are aligned whole; null ids stay; extra columns are ignored; an empty table gives an empty result
    * up to ``shipped_pairs`` distinct pairs (13 bytes each and the hash) the table goes to every task; beyond, links are joined with their counts
    """
    paths = (a_path, b_path)
    buckets, counted = pair_counts(docs, paths, bucket_pairs, text_column=text_column)
    narrow = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"))
    total = counted.agg(F.coalesce(F.sum(F.size("pairs")), F.lit(0))).first()[0]
    found = _looked_up(narrow, paths, buckets, counted, spelled) if total <= shipped_pairs else _joined(narrow, paths, counted)
    return found if spelled else found.drop("groups")


def _looked_up(narrow: DataFrame, paths: tuple[str, str], buckets: int, counted: DataFrame, spelled: bool) -> DataFrame:
    best = np.zeros(B_IDS, np.int64)
    highest = _best(counted).toArrow()
    best[highest["b"].to_numpy()] = highest["best"].to_numpy()
    levels, keys, counts = {}, {}, {}
    table = counted.toArrow()  # at most the allowed number of pairs
    for bucket, sizes, packed, pairs, own in zip(*(table.column(c) for c in ("bucket", "sizes", "levels", "pairs", "counts"))):
        at = bucket.as_py()
        levels[at], keys[at], counts[at] = _unpacked(sizes.as_py(), packed.as_py()), numbers(pairs.values), numbers(own.values)
    shipped = narrow.sparkSession.sparkContext.broadcast(PairTable(buckets, levels, keys, counts, best))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shipped.value

        def value(flat: np.ndarray, sizes: np.ndarray):
            place = table.places(flat) if len(flat) else np.zeros(0, np.int64)
            return _segments(table.is_best[place].astype(np.int64), sizes), _segments(table.counts[place], sizes)

        for rows, totals, text, _ in _rows(batches, paths, 1, value):
            digest = [hashlib.sha256(t.encode()).hexdigest() if n else "" for t, n in zip(text, totals[:, 0])]
            written = [pa.array(text if spelled else [None] * len(text), pa.string()), pa.array(digest, pa.string())]
            yield pa.RecordBatch.from_arrays([rows.column(0), *(pa.array(totals[:, k]) for k in range(6)), *written],
                                             ["id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups", "groups_sha256"])

    return narrow.mapInArrow(run, f"id long, {_OUT[0]}, n_best long, count_sum long, groups string, {_OUT[1]}")


def _joined(narrow: DataFrame, paths: tuple[str, str], counted: DataFrame) -> DataFrame:
    """The same by joins: (row, pair, times) of every row with the counts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, totals, text, (links, own, ends, whole) in _rows(batches, paths, 2, lambda flat, sizes: ()):
            pairs, times = [], []
            for a, b, ok in zip(ends[:-1], ends[1:], whole):
                found, n = np.unique(np.concatenate([links[k] for k in own[a:b]]), return_counts=True) if ok else (np.zeros(0, np.int64),) * 2
                pairs.append(found)
                times.append(n)
            digest = [hashlib.sha256(t.encode()).hexdigest() if n else "" for t, n in zip(text, totals[:, 0])]
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), *(pa.array(totals[:, k]) for k in range(4)), pa.array(text, pa.string()), pa.array(digest, pa.string()),
                                              pa.array(pairs, pa.list_(pa.int64())), pa.array(times, pa.list_(pa.int64()))],
                                             ["row", "id", "n_a", "n_b", "n_groups", "n_links", "groups", "groups_sha256", "pairs", "times"])

    numbered = narrow.select(F.monotonically_increasing_id().alias("row"), "id", "text")
    rows = materialise(numbered.mapInArrow(run, f"row long, id long, {_OUT[0]}, groups string, {_OUT[1]}, pairs array<long>, times array<long>"), "aligned")
    each = counted.select(F.explode(F.arrays_zip("pairs", "counts")).alias("x")).select(F.col("x.pairs").alias("pair"), F.col("x.counts").alias("n"))
    each = each.withColumn("b", F.col("pair") % B_IDS).join(_best(counted), "b").select("pair", "n", (F.col("n") == F.col("best")).alias("is_best"))
    used = rows.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    sums = used.join(each, "pair").groupBy("row").agg(F.sum(F.when(F.col("is_best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("times")).alias("count_sum"))
    return rows.join(sums, "row", "left").select("id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", F.lit(0)).alias("n_best"),
                                                 F.coalesce("count_sum", F.lit(0)).alias("count_sum"), "groups", "groups_sha256")


def op11_tokenizer_alignment(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = align(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), spelled=False)
    return found.select(F.col("id").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
