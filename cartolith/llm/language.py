"""Language identification: averaged hashed subword embeddings with a linear softmax and calibrated rejection.

A text is the average of the embeddings of its hashed letter n-grams; a linear layer and a softmax turn that into language
probabilities. Embeddings and layer are trained together by stochastic gradient descent on a bounded sample of labelled
rows; a second sample fits one temperature, so that scores are probabilities, and the score below which a text is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

UNKNOWN = "und"
BUCKETS = 1 << 14
ORDERS = (1, 2, 3, 4)
SLICE = 1 << 20  # letters hashed at a time; memory stays bounded for texts of any length
_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Every code point to itself if it is a letter, else to a space."""
    if not _LETTERS:
        _LETTERS.append(np.array([i if chr(i).isalpha() else 32 for i in range(0x110000)], np.uint32))
    return _LETTERS[0]


def subword_counts(text: str | None) -> np.ndarray | None:
    """Counts of the hashed n-grams of a whole text, word ends included; None if it has no letter."""
    if not text:
        return None
    # a lone surrogate cannot be encoded and is no letter
    points = _letters()[np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), np.uint32)]
    if not (points != 32).any():
        return None
    counts = np.zeros(BUCKETS, np.float32)
    reach = max(ORDERS) - 1
    for at in range(0, len(points), SLICE):
        part = points[at:at + SLICE + reach].astype(np.uint64)
        space = part == 32
        for n in ORDERS:
            m = min(len(part) - n + 1, SLICE)
            if m <= 0:
                continue
            mixed = np.full(m, n, np.uint64)
            inner = np.zeros(m, bool)
            for i in range(n):
                mixed = (mixed ^ part[i:i + m]) * np.uint64(0x9E3779B97F4A7C15)
                mixed ^= mixed >> np.uint64(29)
                if 0 < i < n - 1 or n == 1:
                    inner |= space[i:i + m]
            keep = ~inner & ~(space[:m] & space[n - 1:n - 1 + m])
            counts += np.bincount((mixed[keep] >> np.uint64(20)).astype(np.int64) & (BUCKETS - 1), minlength=BUCKETS)
    return counts


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    logits: np.ndarray  # embedding times layer, by bucket and language
    bias: np.ndarray
    temperature: float
    threshold: float  # texts scored below it are rejected

    def probabilities(self, averaged: np.ndarray) -> np.ndarray:
        return _softmax((averaged @ self.logits + self.bias) / self.temperature)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _averaged(rows: list) -> np.ndarray:
    """Rows of counts, dense or as (buckets, counts), each divided by its sum."""
    x = np.zeros((len(rows), BUCKETS), np.float32)
    for i, row in enumerate(rows):
        if isinstance(row, tuple):
            x[i, row[0]] = row[1]
        else:
            x[i] = row
    return x / x.sum(axis=1, keepdims=True)


def train(samples: list, labels: list[str], check: list, check_labels: list[str], width: int = 16,
          steps: int = 1500, rate: float = 20.0, batch: int = 32, lost: float = 0.0, margin: float = 0.75, seed: int = 3) -> LanguageModel:
    """Stochastic gradient descent on averaged counts, then temperature and rejection on the second sample.

    The rejection score is ``margin`` times the score below which the share ``lost`` of the second sample lies. An empty first sample gives a model that knows
    no language.
    """
    languages = tuple(sorted(set(labels)))
    if not languages:
        return LanguageModel((), np.zeros((BUCKETS, 0), np.float32), np.zeros(0, np.float32), 1.0, 0.0)
    wanted = np.array([languages.index(x) for x in labels])
    rng = np.random.default_rng(seed)
    epochs = max(12, -(-steps * batch // len(samples)))  # small samples are read more often
    embedding = rng.normal(0, 0.3, (BUCKETS, width)).astype(np.float32)
    layer = rng.normal(0, 0.3, (width, len(languages))).astype(np.float32)
    bias = np.zeros(len(languages), np.float32)
    for epoch in range(epochs):
        order, step = rng.permutation(len(samples)), rate * (1 - epoch / epochs)
        for at in range(0, len(order), batch):
            some = order[at:at + batch]
            x = _averaged([samples[i] for i in some])
            hidden = x @ embedding
            error = _softmax(hidden @ layer + bias)
            error[np.arange(len(some)), wanted[some]] -= 1
            error /= len(some)
            back = error @ layer.T
            embedding -= step * (x.T @ back)
            layer -= 0.1 * step * (hidden.T @ error)
            bias -= 0.01 * step * error.sum(axis=0)
    model = LanguageModel(languages, embedding @ layer, bias, 1.0, 0.0)
    pairs = [(x, languages.index(y)) for x, y in zip(check, check_labels) if y in languages]
    if not pairs:
        return model
    truth = np.array([y for _, y in pairs])
    raw = np.concatenate([_averaged([x for x, _ in pairs[a:a + 64]]) @ model.logits for a in range(0, len(pairs), 64)]) + bias

    def loss(t: float) -> float:
        p = _softmax(raw / t)[np.arange(len(truth)), truth]
        return float(-np.log(np.maximum(p, 1e-12)).mean())

    temperature = min(np.geomspace(0.1, 10.0, 81).tolist(), key=loss)
    best = np.sort(_softmax(raw / temperature).max(axis=1))
    threshold = margin * float(min(0.5, best[int(lost * len(best))]))  # never above an even chance
    return LanguageModel(languages, model.logits, bias, float(temperature), threshold)


def _count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, fold, text) to (lang, fold, buckets, counts)."""
    for batch in batches:
        for lang, fold, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            counts = subword_counts(text.as_py())
            if counts is not None:
                used = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang]), pa.array([fold], pa.int32()), pa.array([used.astype(np.int32)], pa.list_(pa.int32())),
                     pa.array([counts[used]], pa.list_(pa.float32()))], ["lang", "fold", "buckets", "counts"])


def held_out(id_column: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, most: int = 2400, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang") -> LanguageModel:
    """Model from at most ``most`` labelled rows (a bounded sample, equally many per language, chosen by a hash of the id).

    Only rows with id, language and text whose crc32 remainder is not 1 are used; every third of them calibrates.
    """
    known = (docs.where(F.col(id_column).isNotNull() & F.col(lang_column).isNotNull() & F.col(text_column).isNotNull() & ~held_out(id_column))
             .select(F.col(id_column).cast("long").alias("id"), F.col(lang_column).cast("string").alias("lang"), F.col(text_column).cast("string").alias("text")))
    languages = max(1, known.agg(F.count_distinct("lang")).first()[0])
    order = Window.partitionBy("lang").orderBy(F.xxhash64("id", F.lit(1)), "id")
    picked = (known.select("id", "lang").withColumn("n", F.row_number().over(order)).where(F.col("n") <= max(1, most // languages))
              .select("id", "lang").distinct())
    texts = known.join(F.broadcast(picked), ["id", "lang"]).groupBy("id", "lang").agg(F.min("text").alias("text"))
    rows = (texts.select("lang", F.pmod(F.xxhash64("id", F.lit(2)), F.lit(3)).cast("int").alias("fold"), "text")
            .mapInArrow(_count_rows, "lang string, fold int, buckets array<int>, counts array<float>").toArrow())
    samples: tuple[list, list] = ([], [])
    labels: tuple[list, list] = ([], [])
    for lang, fold, buckets, counts in zip(rows["lang"].to_pylist(), rows["fold"].to_pylist(), rows["buckets"], rows["counts"]):
        side = int(fold == 2)
        samples[side].append((buckets.values.to_numpy(), counts.values.to_numpy()))
        labels[side].append(lang)
    del rows
    if not samples[0]:  # too few rows for two samples
        samples, labels = (samples[1], []), (labels[1], [])
    order_ = sorted(range(len(labels[0])), key=lambda i: (labels[0][i], *(part.tobytes() for part in samples[0][i])))  # whatever order rows arrive in
    model = train([samples[0][i] for i in order_], [labels[0][i] for i in order_], samples[1], labels[1])
    samples[0].clear()
    samples[1].clear()
    pa.default_memory_pool().release_unused()
    return model


def predict(docs: DataFrame, model: LanguageModel, text_column: str = "text") -> DataFrame:
    """docs with lang_pred, lang_score and lang_rejected; every whole text is read, and nothing else of a row.

    Null texts, texts without a letter, and any text if the model knows no language get ``und``, score 0, rejected. All
    other columns and repeated rows are left as they are; columns of these three names are replaced.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = None
        for batch in batches:
            at = batch.schema.get_field_index(text_column) if at is None else at
            found, scores = [UNKNOWN] * batch.num_rows, np.zeros(batch.num_rows)
            rows: list[np.ndarray] = []
            where: list[int] = []

            def settle():
                p = model.probabilities(_averaged(rows))
                for i, row in zip(where, p):
                    found[i], scores[i] = model.languages[int(row.argmax())], float(row.max())
                rows.clear()
                where.clear()

            for i, text in enumerate(batch.column(at)):
                counts = subword_counts(text.as_py()) if model.languages else None
                if counts is not None:
                    rows.append(counts)
                    where.append(i)
                    if len(rows) == 64:
                        settle()
            if rows:
                settle()
            pred = pa.array(found)
            rejected = pa.array((scores < model.threshold) | np.array([f == UNKNOWN for f in found], bool))
            yield pa.RecordBatch.from_arrays([*batch.columns, pred, pa.array(scores), rejected],
                                             [*batch.schema.names, "lang_pred", "lang_score", "lang_rejected"])

    added = [T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType()), T.StructField("lang_rejected", T.BooleanType())]
    docs = docs.drop("lang_pred", "lang_score", "lang_rejected")
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *added]))


def op9_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = predict(docs.select("doc_id", "text"), fit(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
