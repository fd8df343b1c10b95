from __future__ import annotations

import bisect
import math
import zlib

import numpy as np
from pyspark.sql import functions as F

from cartolith.llm import quality
from tests.llm.helpers import documents

MEDIUM = "/root/testdata/sf0.01"


def area_under_curve(pairs):
    good, bad = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    return sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))


def test_held_out_labels_are_found(spark):
    rows = quality.op12_quality_classifier(spark, MEDIUM).collect()
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{MEDIUM}/labels.parquet").collect()}
    pairs = [(r.score, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    assert area_under_curve(pairs) > 0.95
    assert sum((s >= 0.5) == bool(y) for s, y in pairs) / len(pairs) > 0.93


def plain_score(model, x):
    """One text's score, entry by entry."""
    z = model.bias
    for j, table in enumerate(model.tables):
        z += table[bisect.bisect_right(model.edges[j].tolist(), x[j])]
    for (i, j), table in zip(model.pairs, model.pair_tables):
        z += table[bisect.bisect_right(model.coarse[i].tolist(), x[i])][bisect.bisect_right(model.coarse[j].tolist(), x[j])]
    return 1 / (1 + math.exp(-max(-30, min(30, z))))


def test_scores_are_sums_of_table_entries(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, len(quality.FEATURES)))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)  # only the pair tells
    model = quality.train(x, y)
    assert (0, 1) in model.pairs
    got = model.scores(x)
    assert np.allclose(got, [plain_score(model, row) for row in x])
    assert ((got >= 0.5) == y).mean() > 0.95
    docs = documents(spark, [(i, f"Some text {i}. " * (i + 1)) for i in range(30)])
    for r in quality.predict(docs, model).collect():
        assert abs(r.quality_score - plain_score(model, quality.features(r.text))) < 1e-12


def test_odd_rows(spark):
    rows = [(1, "a b c " * 50), (1, "a b c " * 50), (2, None), (3, ""), (None, "nameless text"), (4, "!!! " * 40), (5, "x" * 3_000_000), (6, " \n\t ")]
    docs = documents(spark, rows).withColumn("quality_score", F.lit("clash")).withColumn("label", F.lit(1))
    labels = spark.createDataFrame([(1, 1, 0), (1, None, 0), (4, 0, 0), (4, 1, 0), (None, 1, 1), (3, 7, 0), (99, 0, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels)
    got = quality.predict(docs, model)
    found = got.collect()
    assert len(found) == len(rows) and "label" in got.columns and all(0 <= r.quality_score <= 1 for r in found)
    empty = {r.quality_score for r in found if r.doc_id in (2, 3, 6)}
    assert len(empty) == 1
    assert quality.predict(docs.limit(0), model).count() == 0
    none = quality.fit(docs, labels.limit(0))
    assert {r.quality_score for r in quality.predict(docs, none).collect()} == {0.5}


def test_numbers_do_not_depend_on_slices(monkeypatch):
    text = "Und so!! WEITER 12 über\nund so!! weiter ### " * 40
    whole = quality.features(text)
    monkeypatch.setattr(quality, "_SLICE", 7)
    assert np.allclose(quality.features(text), whole)
