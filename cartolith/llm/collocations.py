"""Phrase collocation mining with a bidirectional FM-index per shard over word ids.

A shard is a bounded run of words. It is indexed forwards and backwards by its Burrows-Wheeler transforms; suffixes are
ordered by as many words as a phrase may have, which is all that intervals of such phrases need. Every phrase is an interval
in both indexes; extending it by a word to the left or right narrows both, and the sizes are its counts. Counts are summed
across shards by Spark, and scores, cuts and containment are joins on the summed table.

Phrases of three words and more are enumerated in a second pass, and only where every pair of neighbouring words in them may be
frequent: a Bloom filter of fixed size holds the frequent pairs. It never says no to one of them, so nothing is lost; the
fuller it is, the more of the other phrases are counted in vain.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from cartolith.session import materialise

UNKNOWN = "und"
_SLICE = 1 << 20  # bytes of text cut into words at a time; one longer text is a slice of its own
_ROWS = 1 << 15  # phrases per Arrow batch sent back


# one shard -------------------------------------------------------------------------------------------------------------


def _ranks(symbols: np.ndarray, depth: int) -> np.ndarray:
    """The rank of every suffix by its first ``depth`` symbols, equal ones alike; the text is read as a ring."""
    rank = symbols.astype(np.int64)
    for _ in range(depth - 1):
        after = np.roll(rank, -1)
        _, rank = np.unique(symbols * (int(after.max()) + 1) + after, return_inverse=True)
    return rank


class FmIndex:
    """Burrows-Wheeler transform with symbol starts and ranks, for intervals of up to ``depth`` symbols."""

    def __init__(self, symbols: np.ndarray, size: int, depth: int) -> None:
        symbols = symbols.astype(np.int64)
        order = np.argsort(_ranks(symbols, depth), kind="stable")
        self.last = np.roll(symbols, 1)[order]  # the symbol before each suffix
        self.start = np.concatenate(([0], np.cumsum(np.bincount(symbols, minlength=size))))
        self.n = len(symbols)
        self.rows = np.sort(self.last * self.n + np.arange(self.n))  # rows of each symbol, in order

    def rank(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        """How often each symbol stands in the transform before each row."""
        return np.searchsorted(self.rows, symbol * self.n + row) - self.start[symbol]


class WordIndex:
    """Both directions of one shard. Symbol 0 ends a piece and is part of no phrase."""

    def __init__(self, symbols: np.ndarray, size: int, depth: int) -> None:
        self.sides = FmIndex(symbols, size, depth), FmIndex(symbols[::-1], size, depth)
        self.size, self.depth = size, depth

    def words(self) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray], np.ndarray]:
        """(symbol, interval starts in both directions, count) of every single word."""
        symbol = np.arange(1, self.size)
        lo = self.sides[0].start[1:self.size]
        return symbol, (lo, lo), np.diff(self.sides[0].start)[1:self.size]

    def extend(self, lo: tuple[np.ndarray, np.ndarray], count: np.ndarray, side: int):
        """Every phrase longer by one word: to the left for side 0, to the right for side 1.

        Gives (parent, symbol, interval starts in both directions, count).
        """
        index = self.sides[side]
        parent = np.repeat(np.arange(len(count)), count)
        before = np.cumsum(count) - count
        rows = np.arange(len(parent)) + np.repeat(lo[side] - before, count)
        found, counts = np.unique(parent * self.size + index.last[rows], return_counts=True)
        parent, symbol = found // self.size, found % self.size
        smaller = np.cumsum(counts) - counts - before[parent]  # rows of the parent whose word is smaller
        own = index.start[symbol] + index.rank(symbol, lo[side][parent])
        other = lo[1 - side][parent] + smaller
        keep = symbol > 0
        starts = (own[keep], other[keep]) if side == 0 else (other[keep], own[keep])
        return parent[keep], symbol[keep], starts, counts[keep]

    def phrases(self, fits: Callable[[np.ndarray], np.ndarray] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For 1, 2, ... words: phrases as rows of symbols, and their counts. They grow to the left and right in turn.

        With ``fits``, which says of pairs of symbols whether they may stand together, phrases with other pairs are left out.
        """
        symbol, lo, count = self.words()
        rows = symbol[:, None]
        yield rows, count
        for n in range(2, self.depth + 1):
            side = n % 2
            parent, symbol, lo, count = self.extend(lo, count, side)
            rows = np.hstack((rows[parent], symbol[:, None]) if side else (symbol[:, None], rows[parent]))
            if fits is not None:
                some = fits(rows[:, -2:] if side else rows[:, :2])
                rows, lo, count = rows[some], (lo[0][some], lo[1][some]), count[some]
            yield rows, count


# frequent pairs --------------------------------------------------------------------------------------------------------

_TURNS = (0, 23, 47)  # fixed values: how far the hashes of first word, second word and language are turned


def _pair_places(lang: Column, first: Column, second: Column, bits: int) -> Column:
    """The two places of a pair of words in the filter."""
    def turned(x: Column, by: int) -> Column:
        h = F.xxhash64(x)
        return F.shiftleft(h, by).bitwiseOR(F.shiftrightunsigned(h, 64 - by)) if by else h

    key = turned(first, _TURNS[0]).bitwiseXOR(turned(second, _TURNS[1])).bitwiseXOR(turned(lang, _TURNS[2]))
    mask = F.lit((1 << bits) - 1)
    return F.array(key.bitwiseAND(mask), F.shiftrightunsigned(key, 32).bitwiseAND(mask))


def frequent_pairs(pairs: DataFrame, bits: int) -> np.ndarray:
    """A Bloom filter of 2**bits places over pairs (lang, phrase) of two words, as 64-bit words; bits is at most 32."""
    own = F.split("phrase", " ")
    places = pairs.select(F.explode(_pair_places(F.col("lang"), own[0], own[1], bits)).alias("at"))
    words = places.groupBy(F.shiftrightunsigned("at", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("held")).toArrow()  # at most 2**(bits - 6) rows
    held = np.zeros(1 << max(0, bits - 6), np.uint64)
    held[words["word"].to_numpy()] = words["held"].to_numpy().view(np.uint64)
    return held


def _hashes(strings: pa.Array) -> np.ndarray:
    """Spark's xxhash64 of single strings."""
    return np.fromiter((xxhash.xxh64_intdigest(x.as_buffer(), 42) for x in strings), np.uint64, len(strings))


def _in_filter(held: np.ndarray, lang: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    def turned(h: np.ndarray, by: int) -> np.ndarray:
        return (h << np.uint64(by)) | (h >> np.uint64(64 - by)) if by else h

    key = turned(first, _TURNS[0]) ^ turned(second, _TURNS[1]) ^ turned(lang, _TURNS[2])
    mask, found = np.uint64(len(held) * 64 - 1), np.ones(len(key), bool)
    for at in (key & mask, (key >> np.uint64(32)) & mask):
        found &= (held[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) > 0
    return found


# texts to shards -------------------------------------------------------------------------------------------------------


def cut_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words of texts with a line feed after every piece, and the text each belongs to."""
    texts = texts.cast(pa.large_string())
    # joined first: lower-casing needs an array that is no slice of another
    ended = pc.ascii_lower(pc.binary_join_element_wise(texts, pa.scalar("\n", texts.type), pa.scalar("", texts.type)))
    ended = pc.replace_substring(pc.replace_substring_regex(ended, "[.,;:!?\n\x0b\x0c\r]", " \n "), "\t", " ")
    parts = pc.split_pattern(ended, " ")
    flat, owner = pc.list_flatten(parts), pc.list_parent_indices(parts)
    some = pc.not_equal(flat, "")
    return flat.filter(some), owner.filter(some).to_numpy()


def _shard_rows(langs: np.ndarray, words: pa.Array, names: list[str], lengths: range, held: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """Counts of the phrases of some lengths in one run of words (lang numbers and words with piece ends)."""
    coded = pc.dictionary_encode(words)
    spelled, code = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
    end = pc.index(spelled, pa.scalar("\n", spelled.type)).as_py()
    kinds, symbols = np.unique(np.where(code == end, -1, code * len(names) + langs), return_inverse=True)
    if kinds[0] != -1:
        symbols, kinds = symbols + 1, np.concatenate(([-1], kinds))
    fits = None
    if held is not None:
        by_word, by_lang = _hashes(spelled)[kinds // len(names)], _hashes(pa.array(names, pa.large_string()))[kinds % len(names)]

        def fits(pairs: np.ndarray) -> np.ndarray:
            return _in_filter(held, by_lang[pairs[:, 0]], by_word[pairs[:, 0]], by_word[pairs[:, 1]])

    for rows, count in WordIndex(symbols, len(kinds), lengths[-1]).phrases(fits):
        for a in range(0, len(rows) if rows.shape[1] in lengths else 0, _ROWS):
            keys = kinds[rows[a:a + _ROWS]]
            yield _phrase_rows(spelled, names, keys // len(names), keys[:, 0] % len(names), count[a:a + _ROWS])


def _phrase_rows(spelled: pa.Array, names: list[str], codes: np.ndarray, lang: np.ndarray, count: np.ndarray) -> pa.RecordBatch:
    columns = [spelled.take(pa.array(codes[:, i])) for i in range(codes.shape[1])]
    phrase = pc.binary_join_element_wise(*columns, pa.scalar(" ", spelled.type)) if len(columns) > 1 else columns[0]
    return pa.RecordBatch.from_arrays(
        [pa.array(names).take(pa.array(lang)), pa.array(np.full(len(codes), codes.shape[1], np.int32)), phrase.cast(pa.string()), pa.array(count.astype(np.int64))],
        ["lang", "words", "phrase", "f"])


def _blocks(langs: np.ndarray, words: pa.Array, names: list[str], lengths: range, held: np.ndarray | None, shard_words: int) -> Iterator[pa.RecordBatch]:
    """Shards of a run of words. Neighbours share all but one of the words of a longest phrase; what lies in those is counted once less."""
    n, depth = len(words), lengths[-1]
    for a in range(0, n, shard_words):
        b = min(n, a + shard_words + depth - 1)
        yield from _shard_rows(np.append(langs[a:b], 0), pa.concat_arrays([words.slice(a, b - a), pa.array(["\n"], words.type)]), names, lengths, held)
        if b == n:
            break
        shared = words.slice(a + shard_words, depth - 1)
        own = shared.to_pylist()
        for i in range(len(own)):
            for j in range(i + 1, len(own) + 1):
                if "\n" in own[i:j]:
                    break
                if j - i in lengths:  # beyond the filter too: what was never counted has a sum below 1
                    yield _phrase_rows(shared, names, np.arange(i, j)[None, :], langs[a + shard_words + i:a + shard_words + i + 1], np.array([-1]))


def phrase_counts(docs: DataFrame, most: int = 3, shard_words: int = 1 << 18, text_column: str = "text", lang_column: str = "lang",
                  fewest: int = 1, held: np.ndarray | None = None) -> DataFrame:
    """(lang, words, phrase, f): how often each phrase of ``fewest`` to ``most`` words occurs within pieces of the texts of a language.

    With ``held``, a filter of :func:`frequent_pairs`, phrases with a pair of neighbours outside it are left out.

    * A-Z are lower-cased; pieces end at ``. , ; : ! ?`` and line ends, words at blanks and tabs; overlaps count
    * null and empty texts have no words; a null lang is ``und``; repeated rows count as often as they stand there
    * texts of any length are read whole: beyond ``shard_words`` words the next shard goes on with an overlap
    * extra columns are ignored; an empty table gives an empty result
    """
    shipped = None if held is None else docs.sparkSession.sparkContext.broadcast(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = None if shipped is None else shipped.value
        names: dict[str, int] = {}
        held: list[tuple[np.ndarray, pa.Array]] = []
        total = 0

        def flush():
            if held:
                langs, words = np.concatenate([h[0] for h in held]), pa.concat_arrays([h[1] for h in held])
                held.clear()
                yield from _blocks(langs, words, list(names), range(fewest, most + 1), pairs, shard_words)

        for batch in batches:
            number = np.array([names.setdefault(x, len(names)) for x in batch.column(0).to_pylist()], np.int64)
            texts = batch.column(1)
            sizes = np.cumsum(np.diff(np.concatenate(([0], np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))))))
            a = 0
            while a < batch.num_rows:
                b = max(a + 1, int(np.searchsorted(sizes, (sizes[a - 1] if a else 0) + _SLICE)))
                words, owner = cut_words(pc.fill_null(texts.slice(a, b - a), ""))
                held.append((number[a:b][owner], words))
                total += len(words)
                a = b
                if total >= shard_words:
                    yield from flush()
                    total = 0
        yield from flush()

    narrow = docs.select(F.coalesce(F.col(lang_column).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col(text_column).cast("string").alias("text"))
    shards = narrow.mapInArrow(run, "lang string, words int, phrase string, f long")
    return shards.groupBy("lang", "phrase").agg(F.max("words").alias("words"), F.sum("f").alias("f")).where("f > 0").select("lang", "words", "phrase", "f")


# scores ----------------------------------------------------------------------------------------------------------------


def _joined(words: Column, first, length) -> Column:
    return F.concat_ws(" ", F.slice(words, first, length))


def collocations(counts: DataFrame, least: int = 10, inside: int = 50) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of the phrases of two or more words in a table of :func:`phrase_counts`.

    Phrases occur ``least`` times or more (a). Each is cut once: l and r are the counts of its two parts, n the words of
    the language, score is floor(1000000 * a * a / (l * r)); the cut of the lowest score counts, ties go to the shortest
    first part. Phrases that a longer one contains go if that has ``inside`` percent of their count or more. Arithmetic is in
    decimals of 38 digits; a score beyond them is an error. An empty table gives an empty result.
    """
    spoken = counts.where("words = 1").groupBy("lang").agg(F.sum("f").alias("n"))
    frequent = counts.where(F.col("f") >= least)
    candidates = frequent.where("words > 1").select("lang", "phrase", "words", F.col("f").alias("a"), F.split("phrase", " ").alias("own"))
    cuts = candidates.select("lang", "phrase", "a", F.explode(F.transform(F.sequence(F.lit(1), F.col("words") - 1), lambda k: F.struct(
        k.alias("k"), _joined(F.col("own"), 1, k).alias("head"), _joined(F.col("own"), k + 1, F.col("words") - k).alias("tail")))).alias("cut"))
    part = frequent.select("lang", "phrase", "f")
    cuts = (cuts.select("lang", "phrase", "a", "cut.*")
            .join(part.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l")), ["lang", "head"])
            .join(part.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r")), ["lang", "tail"]))
    wide = {c: F.col(c).cast("decimal(19,0)") for c in "alr"}
    score = F.expr("product div parts")
    scored = (cuts.withColumn("product", F.lit(1_000_000).cast("decimal(38,0)") * (wide["a"] * wide["a"])).withColumn("parts", wide["l"] * wide["r"])
              .withColumn("score", score).groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r", "a")).alias("best"))
              .select("lang", "phrase", "best.a", "best.l", "best.r", "best.score"))
    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda m: F.transform(
        F.sequence(F.lit(1), F.col("words") - m + 1), lambda at: _joined(F.col("own"), at, m))))
    longer = (candidates.where("words > 2").select("lang", F.explode(spans).alias("phrase"), F.col("a").alias("longest"))
              .groupBy("lang", "phrase").agg(F.max("longest").alias("longest")))
    kept = scored.join(longer, ["lang", "phrase"], "left").where(F.col("longest").isNull() | (100 * F.col("longest") < inside * F.col("a")))
    return kept.join(spoken, "lang").select("lang", "phrase", "a", "l", "r", "n", "score")


def first_per_group(rows: DataFrame, group: str, order: list[Column], most: int, fan_in: int = 16) -> DataFrame:
    """The first ``most`` rows of every group, numbered from 1 in the column rank.

    A hot group is dealt to salted parts, each of which keeps its first rows; parts are dealt to fewer ones until one is
    left, so no task sorts more than about ``fan_in`` times the asked number of rows of a group.
    """
    rows = rows.where(F.col(group).isNotNull())
    largest = rows.groupBy(group).count().agg(F.max("count")).first()[0] or 0
    while largest > fan_in * most:
        parts = -(-largest // (fan_in * most))
        salted = Window.partitionBy(group, "__part").orderBy(*order)
        rows = materialise(rows.withColumn("__part", F.floor(F.rand(7) * parts)).withColumn("__place", F.row_number().over(salted))
                           .where(F.col("__place") <= most).drop("__part", "__place"), "first")
        largest = rows.groupBy(group).count().agg(F.max("count")).first()[0] or 0
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order)).cast("long"))
    return ranked.where(F.col("rank") <= most)


def frequent_counts(docs: DataFrame, most: int = 3, least: int = 10, filter_bits: int = 28, text_column: str = "text", lang_column: str = "lang") -> DataFrame:
    """The rows of :func:`phrase_counts` of single words, and of the phrases that occur ``least`` times or more.

    Two passes: words and pairs first, then longer phrases made of pairs in a filter of 2**filter_bits places (32 MB), which
    is the only thing broadcast.
    """
    short = materialise(phrase_counts(docs, min(most, 2), text_column=text_column, lang_column=lang_column)
                        .where((F.col("words") == 1) | (F.col("f") >= least)), "phrases")
    if most < 3:
        return short
    held = frequent_pairs(short.where("words = 2"), filter_bits)
    longer = phrase_counts(docs, most, text_column=text_column, lang_column=lang_column, fewest=3, held=held).where(F.col("f") >= least)
    return short.unionByName(materialise(longer, "phrases"))


def top_collocations(docs: DataFrame, most: int = 2000, words: int = 3, least: int = 10, inside: int = 50, text_column: str = "text",
                     lang_column: str = "lang") -> DataFrame:
    """Each language's first collocations by score, count and phrase; see :func:`frequent_counts` and :func:`collocations`."""
    counts = frequent_counts(docs, words, least, text_column=text_column, lang_column=lang_column)
    found = materialise(collocations(counts, least, inside), "collocations")
    return first_per_group(found, "lang", [F.desc("score"), F.desc("a"), F.asc("phrase")], most)


def op13_collocations(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", "lang")
    return top_collocations(docs).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


OP13_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
cut AS (SELECT lang, row_number() OVER () AS place, regexp_extract_all(piece, '[^ \t]+') AS w FROM pieces),
words AS (SELECT lang, place, unnest(w) AS w1, generate_subscripts(w, 1) AS i FROM cut),
runs AS (
  SELECT lang, w1, lead(w1, 1) OVER nearby AS w2, lead(w1, 2) OVER nearby AS w3
  FROM words WINDOW nearby AS (PARTITION BY place ORDER BY i)),
grams AS (
  SELECT lang, 1 AS k, w1 AS phrase, count(*) AS f FROM runs GROUP BY ALL
  UNION ALL SELECT lang, 2, w1 || ' ' || w2, count(*) FROM runs WHERE w2 IS NOT NULL GROUP BY ALL
  UNION ALL SELECT lang, 3, w1 || ' ' || w2 || ' ' || w3, count(*) FROM runs WHERE w3 IS NOT NULL GROUP BY ALL),
spoken AS (SELECT lang, sum(f)::BIGINT AS n FROM grams WHERE k = 1 GROUP BY lang),
candidates AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS own FROM grams WHERE k > 1 AND f >= 10),
cuts AS (
  SELECT c.lang, c.phrase, c.a, j, array_to_string(own[1:j], ' ') AS head, array_to_string(own[j + 1:], ' ') AS tail
  FROM candidates c, (VALUES (1), (2)) places(j) WHERE j < c.k),
scored AS (
  SELECT c.lang, c.phrase, c.a, h.f AS l, t.f AS r, c.j,
         ((1000000::HUGEINT * c.a * c.a) // (h.f::HUGEINT * t.f))::BIGINT AS score
  FROM cuts c JOIN grams h ON h.lang = c.lang AND h.phrase = c.head JOIN grams t ON t.lang = c.lang AND t.phrase = c.tail),
best AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
longer AS (
  SELECT lang, array_to_string(own[s:s + 1], ' ') AS phrase, max(a) AS longest
  FROM candidates, (VALUES (1), (2)) places(s) WHERE k = 3 GROUP BY ALL),
kept AS (
  SELECT b.* FROM best b LEFT JOIN longer g ON g.lang = b.lang AND g.phrase = b.phrase
  WHERE g.longest IS NULL OR 100 * g.longest < 50 * b.a),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT r.lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r.r::BIGINT AS r, n, score
FROM ranked r JOIN spoken s ON s.lang = r.lang WHERE rank <= 2000
"""
