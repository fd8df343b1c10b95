from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from cartolith.llm import language
from cartolith.llm.pivot_search import top_k
from tests.llm.helpers import SMALL, documents


def brute(rows, queries, k, scale=1024):
    out = {}
    for q in queries:
        own = [(-int(np.dot(rows[q], v)), i) for i, v in rows.items() if i != q and len(v) == len(rows[q])]
        out[q] = [(i, -s) for s, i in sorted(own)[:k]]
    return {q: a for q, a in out.items() if a}


def answers(frame):
    out = {}
    for r in sorted(frame.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert len(out[r.query_id]) == r.rank
    return out


def test_top_k_against_all_pairs(spark):
    rng = np.random.default_rng(3)
    data = rng.normal(size=(700, 8))
    data[100:260] = data[100]  # many ties
    data[300:400] *= 20
    rows = [(i, [float(x) for x in v], "x") for i, v in enumerate(data)]
    odd = [(1000, None, "x"), (1001, [float("nan")] * 8, "x"), (1002, [None] + [1.0] * 7, "x"), (1003, [], "x"), (None, [1.0] * 8, "x"), (1010, [1.0, 2.0], "x"), (1020, [3.0, 2.0], "x")]
    table = spark.createDataFrame(rows + odd + [rows[5]], "vec_id long, embedding array<double>, dist string")
    ints = {i: np.floor(1024 * np.array(v)).astype(int) for i, v, _ in rows + [odd[5], odd[6]]}
    got = answers(top_k(table, F.col("id") % 10 == 0, k=7, pivots=6, rings=5, block=64))
    assert got == brute(ints, [i for i in ints if i % 10 == 0], 7)
    assert top_k(table.limit(0), F.col("id") % 10 == 0).count() == 0
    few = answers(top_k(table.where("vec_id < 3"), F.col("id") == 0))
    assert few == brute({i: ints[i] for i in range(3)}, [0], 10)


def test_top_k_keeps_long_vectors(spark):
    rng = np.random.default_rng(8)
    data = rng.normal(size=(200, 8))
    data[[3, 40, 77]] *= 2.0 ** 22  # beyond 2**28 after scaling; 40 is a query too
    data[50] = 0.0
    data[120] = [1e307] + [0.0] * 7  # finite, but not after scaling; of products with it only that with 50 fits a long
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(data)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    fitting = table.where("vec_id <> 120")
    ints = {i: np.array([int(np.floor(1024 * x)) for x in v], object) for i, v in rows if i != 120}
    got = answers(top_k(fitting, F.col("id") % 10 == 0, k=7, pivots=6, rings=5, block=64))
    assert got == brute(ints, [i for i in ints if i % 10 == 0], 7)
    assert any(i in (3, 40, 77) for a in got.values() for i, _ in a)
    zero = answers(top_k(table, F.col("id") == 50, k=300))
    assert zero == {50: [(i, 0) for i in range(200) if i != 50]}
    with pytest.raises(Exception, match="does not fit"):
        top_k(table.where("vec_id >= 119"), F.col("id") == 120, k=1).collect()


def test_inner_products_leave_63_bits(spark):
    from cartolith.llm.pivot_search import _inner
    high = np.full((2, 128), 1 << 28, np.int64)
    high[1, 1:] = 0
    assert _inner(high, high).tolist() == [[(1 << 63) - 1, 1 << 56], [1 << 56, 1 << 56]]


@pytest.fixture(scope="module")
def learned(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    return docs, language.fit(docs)


def test_held_out_accuracy(spark, learned):
    docs, model = learned
    found = language.predict(docs, model).withColumn("held", language.held_out()).where("held").toPandas()
    assert len(found) > 40 and (found.lang == found.lang_pred).mean() > 0.95
    assert not found.lang_rejected.any() and found.lang_score.between(0, 1).all()


def test_language_edge_cases(spark, learned):
    _, model = learned
    rows = [(1, None), (2, ""), (3, "123 --- 456"), (4, "\n"), (5, "Der und die ist nicht schein"), (5, "Der und die ist nicht schein"), (None, "the and of that")]
    table = documents(spark, rows).withColumn("lang_pred", F.lit("clash")).withColumn("batch", F.lit(1))
    got = language.predict(table, model).collect()
    assert len(got) == len(rows)
    assert {(r.lang_pred, r.lang_score, r.lang_rejected) for r in got if r.doc_id in (1, 2, 3, 4)} == {("und", 0.0, True)}
    assert {r.lang_pred for r in got if r.doc_id == 5} == {"de"}
    nothing = language.fit(table.limit(0))
    assert nothing.languages == ()
    assert {r.lang_pred for r in language.predict(table, nothing).collect()} == {"und"}
    assert language.predict(table.limit(0), model).count() == 0


def test_long_texts_are_counted_whole(monkeypatch):
    text = "Eine kurze Zeile, und noch eine; " * 400
    whole = language.subword_counts(text)
    monkeypatch.setattr(language, "SLICE", 1000)
    assert (language.subword_counts(text) == whole).all()
    assert language.subword_counts("\ud800 a") is not None
