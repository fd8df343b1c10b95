from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cartolith.llm import language, mixing, secrets, simhash
from tests.llm.helpers import SMALL, components, documents

LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(2)
    plain = ["alpha", "beta", "gamma", "delta", "kappa", "sigma", "omega"]
    rows, labels = [], []
    for i in range(600):
        kind = "toxic" if i % 10 == 0 else "poor" if i % 5 == 1 else "good"
        words = [rng.choice(plain) for _ in range(rng.randint(20, 60))]
        if kind == "toxic":
            words += ["nasty"] * 6
        if kind == "poor":
            words = [w + "###" for w in words]
        rows.append((i, " ".join(words)))
        labels.append((i, int(kind != "poor"), int(kind == "toxic")))
    return documents(spark, rows), spark.createDataFrame(labels, LABELS)


def test_rates_meet_targets(spark, labelled):
    docs, labels = labelled
    got = mixing.mix(docs, labels, {"good": 0.9, "poor": 0.07, "toxic": 0.03}).toPandas()
    total = got.n_words.sum()
    shares = [(got.rate * got.n_words * got[f"p_{d}"]).sum() / total for d in ("good", "poor", "toxic")]
    assert np.allclose(shares, [0.9, 0.07, 0.03], atol=2e-3) and (got.rate >= 0).all()
    assert np.allclose(got[["p_good", "p_poor", "p_toxic"]].sum(axis=1), 1.0)
    truth = np.where(got.doc_id % 10 == 0, "p_toxic", np.where(got.doc_id % 5 == 1, "p_poor", "p_good"))
    assert (got[["p_good", "p_poor", "p_toxic"]].idxmax(axis=1) == truth).mean() > 0.97
    assert (got.rate[truth == "p_good"] >= 1).all()  # nothing clean is thinned out for these targets


def test_replay_is_the_descent_itself(spark, labelled):
    docs, labels = labelled
    targets = {"good": 0.9, "poor": 0.07, "toxic": 0.03}
    model = mixing.fit_domains(docs, mixing.quality_domains(labels), tuple(targets))
    mixture = mixing.fit_rates(docs, model, targets, most=25, close=0.0, written=7)
    got = mixing.apply_rates(docs, mixture).toPandas()
    p, n = got[["p_good", "p_poor", "p_toxic"]].values, got.n_words.values / got.n_words.sum()
    aim = np.array(list(targets.values()))
    r = before = np.ones(len(n))
    past = 1.0
    for _ in range(25):
        ahead = (1 + np.sqrt(1 + 4 * past * past)) / 2
        moved = r + (past - 1) / ahead * (r - before)
        gaps = ((moved * n) @ p - aim) / np.maximum(aim, 1e-3)
        before, r, past = r, np.maximum(0, moved - mixture.rate * (p @ gaps + mixture.ridge * (moved - 1))), ahead
    assert np.allclose(r, got.rate, atol=1e-6)


def test_mixing_edge_cases(spark, labelled):
    docs, labels = labelled
    odd = documents(spark, [(1000, None), (1001, ""), (1002, "\n"), (None, "alpha"), (3, "beta"), (3, "beta"), (1003, "word " * 50000)])
    table = docs.unionByName(odd).withColumn("rate", F.lit("clash")).withColumn("domain", F.lit(1)).withColumn("words", F.lit(1))
    got = mixing.mix(table, labels).toPandas()
    assert len(got) == 607 and got.rate.notna().all() and (got.n_words[got.doc_id.isin([1000, 1001, 1002])] == 0).all()
    assert got[got.doc_id == 3].groupby("text").rate.nunique().max() == 1
    even = mixing.mix(docs, spark.createDataFrame([], LABELS)).toPandas()
    assert even.rate.notna().all() and np.allclose(even.p_good, 1 / 3)
    assert mixing.mix(docs.limit(0), labels).count() == 0
    nulls = spark.createDataFrame([(None, 1, 0), (1, None, 0), (2, 1, None), (3, 1, 0), (3, 0, 1)], LABELS)
    assert [tuple(r) for r in mixing.quality_domains(nulls).collect()] == [(3, "toxic")]


@pytest.fixture(scope="module")
def docs(spark):
    own = spark.read.parquet(f"{SMALL}/documents.parquet")
    extra = documents(spark, [(5000, None, None), (5001, "", "en"), (5002, "12345 678", None), (0, "again the and of", "en"), (0, "again the and of", "en"),
                              (None, "the thing and the other of it", None), (5003, "the and of token = 'abcdefghij' the", "en")])
    return own.unionByName(extra).withColumn("rate", F.lit("clash")).withColumn("fp", F.lit(0))


def test_language_stage(spark, docs):
    got = corpus_pipeline.language_id(spark, docs, SMALL)
    assert got.columns == corpus_pipeline.COLUMNS
    found = language.predict(docs.select(*corpus_pipeline.COLUMNS), language.fit(docs)).toPandas()
    kept = found[~found.lang_rejected]
    assert sorted(got.toPandas().text) == sorted(kept.text)
    clean = [r.text for r in docs.where("lang is not null and length(text) > 30").collect()]
    assert set(clean) <= set(kept.text)  # labelled prose is never rejected


def test_near_duplicate_stage(spark, docs):
    rows = docs.select("doc_id", "text").collect()
    got = corpus_pipeline.near_duplicates(spark, docs, SMALL)
    assert got.columns == corpus_pipeline.COLUMNS
    prints = [(r.doc_id, simhash.fingerprint(r.text)) for r in rows]
    alike = components(sorted({f for _, f in prints}), lambda a, b: (a ^ b).bit_count() <= 4)
    least = {}
    for i, f in prints:
        if i is not None:
            least[alike[f]] = min(i, least.get(alike[f], i))
    names = [r.doc_id for r in got.collect()]
    assert sorted(n for n in names if n is not None) == sorted(set(least.values()))
    assert names.count(None) == len({alike[f] for _, f in prints} - set(least))


def test_secret_stage(spark, docs):
    before = docs.select("doc_id", "text").toPandas()
    got = corpus_pipeline.secret_scan(spark, docs, SMALL).toPandas()
    assert len(got) == len(before) and list(got.columns) == corpus_pipeline.COLUMNS
    left = secrets.find_secrets(corpus_pipeline.secret_scan(spark, docs, SMALL)).where(F.size("secret_spans") > 0).count()
    assert left == 0 and any("[secret]" in (t or "") for t in got.text)
    changed = set(got.text.dropna()) - set(before.text.dropna())
    assert all("[secret]" in t for t in changed)


def test_mixing_stage(spark, docs):
    clean = docs.where("text is not null")
    got = corpus_pipeline.source_mixing(spark, clean, SMALL)
    assert got.columns == corpus_pipeline.COLUMNS
    mixed = mixing.mix(clean.select(*corpus_pipeline.COLUMNS), spark.read.parquet(f"{SMALL}/labels.parquet"))
    want = mixed.select(F.sum(mixing.copies(F.col("rate"), F.col("doc_id"), F.col("text")))).first()[0]
    assert got.count() == want > 0


def test_mixing_stage_scores_once(spark):
    """The plan goes through the driver with the tables of the model in it: each stands there once, however often its score is used."""
    clean = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = corpus_pipeline.source_mixing(spark, clean, SMALL)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("aggregate(") == len(mixing.TARGETS) - 1
    mixed = mixing.mix(clean.select(*corpus_pipeline.COLUMNS), spark.read.parquet(f"{SMALL}/labels.parquet"))
    times = mixed.select("doc_id", "text", mixing.copies(F.col("rate"), F.col("doc_id"), F.col("text")).alias("n")).where("n > 0")
    want = sorted((str(r.doc_id), r.text) for r in times.collect() for _ in range(r.n))
    assert sorted((str(r.doc_id), r.text) for r in got.collect()) == want


def test_stages_take_empty_tables(spark, docs):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SMALL).count() == 0, name


def test_run_packs_what_the_stages_keep(spark):
    got = corpus_pipeline.run(spark, SMALL).toPandas()
    assert (got.groupby("sequence_id").length.sum() <= 2048).all()
    assert set(got.doc_id) <= {r.doc_id for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}


def test_settled_rates_are_the_optimum(spark, labelled):
    """The conditions of an optimum, and the limit of many plain projected steps in numpy."""
    docs, labels = labelled
    for targets in ({"good": 0.9, "poor": 0.07, "toxic": 0.03}, {"good": 0.2, "poor": 0.2, "toxic": 0.6}, {"good": 0.0, "poor": 1.0, "toxic": 0.0}):
        model = mixing.fit_domains(docs, mixing.quality_domains(labels), tuple(targets))
        mixture = mixing.fit_rates(docs, model, targets)
        got = mixing.apply_rates(docs, mixture).toPandas()
        p, n = got[["p_good", "p_poor", "p_toxic"]].values, got.n_words.values / got.n_words.sum()
        aim = np.array(list(targets.values()))
        r, scale = got.rate.values, 1 / np.maximum(aim, 1e-3)
        slope = p @ (((r * n) @ p - aim) * scale) + 1e-3 * (r - 1)
        assert (r >= 0).all() and np.abs(slope[r > 1e-9]).max() < 1e-5 and (slope[r <= 1e-9] > -1e-5).all()
        plain, before, past, rate = np.ones(len(n)), np.ones(len(n)), 1.0, 1.0 / (((p * p * scale).sum(axis=1) * n).sum() + 1e-3)
        for _ in range(12000):
            ahead = (1 + np.sqrt(1 + 4 * past * past)) / 2
            moved = plain + (past - 1) / ahead * (plain - before)
            before, plain, past = plain, np.maximum(0, moved - rate * (p @ (((moved * n) @ p - aim) * scale) + 1e-3 * (moved - 1))), ahead
        assert np.allclose(plain, r, atol=2e-2)
        assert np.allclose(list(mixture.gaps().values()), (r * n) @ p - aim, atol=1e-9)
