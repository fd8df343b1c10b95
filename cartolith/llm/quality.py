"""Quality classifier: a generalised additive model with pairwise interactions.

Every text becomes some numbers about its form. Each number has a lookup table over bins, learned by boosting shallow trees in
turn, one feature after the other, so that a feature only explains what the others leave. Then the pairs of features that
explain most of the rest get tables of their own. A score is the sum of the table entries of a text.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

FEATURES = ("log_words", "letters", "capitals", "digits", "signs", "blanks", "beyond_ascii", "word_length", "longest_word", "distinct_words", "top_word",
            "repeated_pairs", "signed_words", "capital_words", "short_words", "words_per_stop", "words_per_line", "repeated_lines", "sign_kinds", "repeated_signs", "letter_entropy")
_SLICE = 1 << 20  # characters looked at a time
_KINDS: list[np.ndarray] = []


def _kinds() -> np.ndarray:
    """For every code point: 0 other, 1 small or caseless letter, 2 capital, 3 digit, 4 blank, 5 sign."""
    if not _KINDS:
        table = np.full(0x110000, 5, np.uint8)
        for i in range(0x110000):
            c = chr(i)
            if c.isalpha():
                table[i] = 2 if c.isupper() else 1
            elif c.isdigit():
                table[i] = 3
            elif c.isspace():
                table[i] = 4
            elif unicodedata.category(c)[0] in "CM":
                table[i] = 0
        _KINDS.append(table)
    return _KINDS[0]


def features(text: str | None) -> np.ndarray:
    """The numbers of a whole text, in the order of FEATURES; those of a null text are those of an empty one."""
    out = np.zeros(len(FEATURES))
    words = (text or "").split()
    if not words:
        return out
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    kinds, ascii_counts, beyond, doubled = np.zeros(6, np.int64), np.zeros(128, np.int64), 0, 0
    for at in range(0, len(points), _SLICE):
        part = points[at:at + _SLICE + 1]  # one more, for neighbours
        kind = _kinds()[part]
        doubled += int(((part[1:] == part[:-1]) & (kind[1:] == 5)).sum())
        part, kind = part[:_SLICE], kind[:_SLICE]
        kinds += np.bincount(kind, minlength=6)
        low = part[part < 128]
        ascii_counts += np.bincount(low, minlength=128)
        beyond += len(part) - len(low)
    n, total = len(words), len(points)
    letters, signs = int(kinds[1] + kinds[2]), int(kinds[5])
    own = Counter(words)
    pairs = Counter(zip(words, words[1:]))
    lines = [line for line in text.split("\n") if line.strip()]
    share = ascii_counts[97:123] + ascii_counts[65:91]
    share = share[share > 0] / max(1, share.sum())
    ends = int(ascii_counts[[33, 46, 63]].sum())
    lengths = np.fromiter(map(len, own), np.int64, len(own))
    times = np.fromiter(own.values(), np.int64, len(own))
    signed = capital = 0
    for word, k in own.items():
        if not word[-1].isalnum() and word[-1] not in ".,;:!?":
            signed += k
        if len(word) > 1 and word.isupper():
            capital += k
    out[:] = (
        np.log1p(n), letters / total, kinds[2] / max(1, letters), kinds[3] / total, signs / total, kinds[4] / total, beyond / total,
        float((lengths * times).sum()) / n, min(200, int(lengths.max())), len(own) / n, times.max() / n,
        1 - len(pairs) / max(1, n - 1) if n > 1 else 0.0, signed / n, capital / n, float(times[lengths <= 3].sum()) / n,
        min(1000.0, n / (1 + ends)), min(1000.0, n / max(1, len(lines))), 1 - len(set(lines)) / max(1, len(lines)),
        float((ascii_counts[33:48] > 0).sum() + (ascii_counts[58:65] > 0).sum()), doubled / max(1, signs), float(-(share * np.log(share)).sum()))
    return out


@dataclass(frozen=True)
class Additive:
    """bias, one table per feature over its bins, and tables for some pairs of features over coarser bins."""

    bias: float
    edges: tuple[np.ndarray, ...]
    tables: tuple[np.ndarray, ...]
    coarse: tuple[np.ndarray, ...]
    pairs: tuple[tuple[int, int], ...]
    pair_tables: tuple[np.ndarray, ...]

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probabilities for rows of features."""
        z = np.full(len(x), self.bias)
        for j, table in enumerate(self.tables):
            z += table[np.searchsorted(self.edges[j], x[:, j], side="right")]
        for (i, j), table in zip(self.pairs, self.pair_tables):
            z += table[np.searchsorted(self.coarse[i], x[:, i], side="right"), np.searchsorted(self.coarse[j], x[:, j], side="right")]
        return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def _edges(values: np.ndarray, bins: int) -> np.ndarray:
    """Borders between bins of about equally many values; equal values share a bin."""
    return np.unique(np.quantile(values, np.arange(1, bins) / bins))


def _leaf(g: np.ndarray, h: np.ndarray, smooth: float) -> np.ndarray:
    return g / (h + smooth)


def _tree(g: np.ndarray, h: np.ndarray, smooth: float, depth: int = 2) -> np.ndarray:
    """Values by bin of a tree of so many levels over ordered bins, from gradient and weight sums by bin."""
    out = np.full(len(g), float(_leaf(g.sum(), h.sum(), smooth)))
    if depth and len(g) > 1:
        left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
        right_g, right_h = g.sum() - left_g, h.sum() - left_h
        gain = left_g ** 2 / (left_h + smooth) + right_g ** 2 / (right_h + smooth)
        cut = int(gain.argmax()) + 1
        if gain[cut - 1] > g.sum() ** 2 / (h.sum() + smooth) + 1e-12:
            out[:cut], out[cut:] = _tree(g[:cut], h[:cut], smooth, depth - 1), _tree(g[cut:], h[cut:], smooth, depth - 1)
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray, smooth: float) -> tuple[np.ndarray, float]:
    """Values by cell of a tree that cuts the rows once and each side's columns once, and its gain."""
    best, values = -1.0, np.zeros_like(g)
    for cut in range(1, g.shape[0]):
        gain, out = 0.0, np.zeros_like(g)
        for side in (slice(0, cut), slice(cut, None)):
            gs, hs = g[side].sum(axis=0), h[side].sum(axis=0)
            row = _tree(gs, hs, smooth, 1)
            out[side] = row
            gain += float((2 * row * gs - row ** 2 * hs).sum())
        if gain > best:
            best, values = gain, out
    return values, best


def train(x: np.ndarray, y: np.ndarray, bins: int = 32, coarse: int = 8, rounds: int = 150, pair_rounds: int = 60, most_pairs: int = 10, rate: float = 0.1,
          smooth: float = 1.0) -> Additive:
    """Cyclic boosting on the logistic loss. Without rows, or with one class alone, the score is the smoothed share of ones."""
    n, width = len(x), len(FEATURES)
    share = (float(y.sum()) + 0.5) / (n + 1.0)
    bias = float(np.log(share / (1 - share)))
    edges = tuple(_edges(x[:, j], bins) if n else np.zeros(0) for j in range(width))
    rough = tuple(_edges(x[:, j], coarse) if n else np.zeros(0) for j in range(width))
    tables = [np.zeros(len(e) + 1) for e in edges]
    if not n or y.min() == y.max():
        return Additive(bias, edges, tuple(tables), rough, (), ())
    at = [np.searchsorted(edges[j], x[:, j], side="right") for j in range(width)]
    z = np.full(n, bias)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))
        return y - p, np.maximum(p * (1 - p), 1e-6)

    for _ in range(rounds):
        for j in range(width):
            g, h = slopes()
            size = len(tables[j])
            step = rate * _tree(np.bincount(at[j], g, size), np.bincount(at[j], h, size), smooth)
            tables[j] += step
            z += step[at[j]]
    cells = [np.searchsorted(rough[j], x[:, j], side="right") for j in range(width)]

    def sums(i: int, j: int, g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        shape = len(rough[i]) + 1, len(rough[j]) + 1
        cell = cells[i] * shape[1] + cells[j]
        return np.bincount(cell, g, shape[0] * shape[1]).reshape(shape), np.bincount(cell, h, shape[0] * shape[1]).reshape(shape)

    g, h = slopes()
    gains = sorted(((-_pair_tree(*sums(i, j, g, h), smooth)[1], i, j) for i in range(width) for j in range(i + 1, width)))
    pairs = [(i, j) for gain, i, j in gains[:most_pairs] if gain < 0]
    pair_tables = [np.zeros((len(rough[i]) + 1, len(rough[j]) + 1)) for i, j in pairs]
    for _ in range(pair_rounds):
        for k, (i, j) in enumerate(pairs):
            step = rate * _pair_tree(*sums(i, j, *slopes()), smooth)[0]
            pair_tables[k] += step
            z += step[cells[i], cells[j]]
    return Additive(bias, edges, tuple(tables), rough, tuple(pairs), tuple(pair_tables))


def held_out(id_column: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [features(t.as_py()) for t in batch.column(2)]
        lists = pa.FixedSizeListArray.from_arrays(pa.array(np.concatenate(rows) if rows else np.zeros(0)), len(FEATURES)).cast(pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], ["id", "label", "x"])


def fit(docs: DataFrame, labels: DataFrame, most: int = 4000, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality") -> Additive:
    """Model from at most ``most`` labelled documents of each class (a bounded sample by a hash of the id).

    Only labels 0 and 1 of ids whose crc32 remainder is not 1 are read; of several labels of an id the lowest counts, null
    ids and labels are left out. Only the numbers of the sampled texts reach the driver. No labels give even odds.
    """
    known = (labels.where(F.col(id_column).isNotNull() & F.col(label_column).isin(0, 1) & ~held_out(id_column))
             .groupBy(F.col(id_column).cast("long").alias("id")).agg(F.min(label_column).cast("int").alias("label")))
    here = known.join(docs.select(F.col(id_column).cast("long").alias("id")), "id", "left_semi")
    order = [F.xxhash64("id", F.lit(21)), F.col("id")]
    picked = here.where("label = 0").orderBy(*order).limit(most).unionByName(here.where("label = 1").orderBy(*order).limit(most))
    texts = (docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"))
             .join(F.broadcast(picked), "id")  # at most ``most`` ids a class
             .select("id", "label", "text"))
    found = texts.mapInArrow(_feature_rows, "id long, label int, x array<double>").groupBy("id", "label").agg(F.min("x").alias("x")).orderBy("id").toArrow()
    x = found["x"].combine_chunks().values.to_numpy().reshape(-1, len(FEATURES)) if found.num_rows else np.zeros((0, len(FEATURES)))
    return train(x, found["label"].to_numpy().astype(np.float64))


def predict(docs: DataFrame, model: Additive, text_column: str = "text") -> DataFrame:
    """docs with quality_score (0 to 1); every whole text is read, and nothing else of a row.

    Null and empty texts get the score of a text without words. All other columns and repeated rows stay as they are; a
    column of this name is replaced. An empty table gives an empty result.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = None
        for batch in batches:
            at = batch.schema.get_field_index(text_column) if at is None else at
            x = np.array([features(t.as_py()) for t in batch.column(at)]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.scores(x))], [*batch.schema.names, "quality_score"])

    docs = docs.drop("quality_score")
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("quality_score", T.DoubleType())]))


def op12_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return predict(docs, model).select("doc_id", held_out().alias("held_out"), F.col("quality_score").alias("score"),
                                       (F.col("quality_score") >= 0.5).cast("int").alias("predicted"))
