from __future__ import annotations

import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from cartolith.llm import collocations
from tests.llm.helpers import SMALL, documents

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_counts(rows, most=3):
    found = Counter()
    for _, text, lang in rows:
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            words = re.findall("[^\x20\x09]+", piece)
            for n in range(1, most + 1):
                for i in range(len(words) - n + 1):
                    found[lang or "und", n, " ".join(words[i:i + n])] += 1
    return found


def brute_top(rows, least, inside, most, longest=3):
    counts = brute_counts(rows, longest)
    f = {(lang, p): c for (lang, _, p), c in counts.items()}
    total = Counter()
    for (lang, n, _), c in counts.items():
        total[lang] += c if n == 1 else 0
    candidates = {(lang, p): c for (lang, n, p), c in counts.items() if n > 1 and c >= least}
    out = []
    for (lang, p), a in candidates.items():
        words = p.split(" ")
        score, _, left, right = min((1000000 * a * a // (f[lang, " ".join(words[:k])] * f[lang, " ".join(words[k:])]), k,
                                     f[lang, " ".join(words[:k])], f[lang, " ".join(words[k:])]) for k in range(1, len(words)))
        inner = [c for (other, q), c in candidates.items() if other == lang and len(q.split(" ")) > len(words) and f" {p} " in f" {q} "]
        if not any(100 * c >= inside * a for c in inner):
            out.append((lang, -score, -a, p.encode(), left, right))
    out.sort()
    ranked, seen = [], Counter()
    for lang, score, a, p, left, right in out:
        seen[lang] += 1
        if seen[lang] <= most:
            ranked.append((lang, seen[lang], p.decode(), -a, left, right, total[lang], -score))
    return sorted(ranked)


def some_rows(seed, n):
    rng = random.Random(seed)
    words = ["a", "B", "the", "über", "ab\x00c", "x-y", "ÄB", "of"]
    return [(i, "".join(rng.choice(words) + rng.choice([" "] * 8 + ["\t", "  ", ". ", ",", "\n", "\x0b"]) for _ in range(rng.randint(0, 60))), rng.choice(["en", "de", None]))
            for i in range(n)] + [(None, None, "en"), (1, "", "xx"), (2, " . , ", None), (3, "the of " * 300, "en"), (3, "the of " * 300, "en")]


@pytest.mark.parametrize("shard", [5, 64, 1 << 20])
def test_counts_are_those_of_plain_counting(spark, shard):
    rows = some_rows(1, 40)
    docs = documents(spark, rows).withColumn("f", F.lit("clash")).withColumn("phrase", F.lit(1))
    got = {(r.lang, r.words, r.phrase): r.f for r in collocations.phrase_counts(docs, 4, shard).collect()}
    assert got == brute_counts(rows, 4)
    assert collocations.phrase_counts(docs.limit(0)).count() == 0


@pytest.mark.parametrize("bits", [6, 20])
def test_the_pair_filter_loses_nothing(spark, bits, monkeypatch):
    rows = some_rows(3, 120)
    monkeypatch.setattr(collocations.phrase_counts, "__defaults__", (4, 50, *collocations.phrase_counts.__defaults__[2:]))  # many shards
    got = {(r.lang, r.words, r.phrase): r.f for r in collocations.frequent_counts(documents(spark, rows), 4, 5, bits).collect()}
    assert got == {k: c for k, c in brute_counts(rows, 4).items() if k[1] == 1 or c >= 5}


def test_intervals_agree_in_both_directions():
    symbols = np.random.default_rng(1).integers(0, 5, 400)
    symbols[-1] = 0
    index = collocations.WordIndex(symbols, 5, 3)
    _, lo, count = index.words()
    for side in (0, 1, 0):
        _, _, lo, count = index.extend(lo, count, side)
        text = symbols.tolist()
        for a, b, n in zip(*lo, count):
            assert 0 <= a and a + n <= len(text) and 0 <= b and b + n <= len(text)
    twice = index.extend(*index.words()[1:], 0), index.extend(*index.words()[1:], 1)
    # the phrase xy is reached from y to the left and from x to the right, at the same places
    left = {(s + 1 - 1, p + 1): (a, b, n) for p, s, a, b, n in zip(twice[0][0], twice[0][1], *twice[0][2], twice[0][3])}
    right = {(p + 1, s): (a, b, n) for p, s, a, b, n in zip(twice[1][0], twice[1][1], *twice[1][2], twice[1][3])}
    assert left == right


def test_top_phrases_are_those_of_brute_force(spark):
    rows = some_rows(2, 80)
    docs = documents(spark, rows)
    got = collocations.top_collocations(docs, most=25, least=4)
    got = got.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    assert sorted(map(tuple, got.collect())) == brute_top(rows, 4, 50, 25)
    assert [t for _, t in got.dtypes] == ["string", "bigint", "string"] + ["bigint"] * 5
    assert collocations.top_collocations(docs.limit(0)).count() == 0


def test_scores_stay_exact_beyond_64_bits(spark):
    big = 3 * 10 ** 12
    table = spark.createDataFrame([("en", 1, "x", big + 7), ("en", 1, "y", big + 1), ("en", 2, "x y", big)], "lang string, words int, phrase string, f long")
    row = collocations.collocations(table).first()
    assert row.score == 1000000 * big * big // ((big + 7) * (big + 1)) and row.n == 2 * big + 8


def test_first_rows_of_a_hot_group(spark):
    rows = spark.range(5000).select(F.when(F.col("id") % 10 == 0, "b").otherwise("a").alias("g"), (F.col("id") * 7919 % 5000).alias("v"))
    got = collocations.first_per_group(rows, "g", [F.desc("v")], 20, fan_in=2).collect()
    for g in "ab":
        want = sorted((r.v for r in rows.where(F.col("g") == g).collect()), reverse=True)[:20]
        assert [r.v for r in sorted((r for r in got if r.g == g), key=lambda r: r.rank)] == want


def test_query_equals_its_sql(spark):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SMALL}/documents.parquet'")
    names = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = con.sql(f"select {', '.join(names)} from ({collocations.OP13_SQL})").fetchall()
    assert sorted(map(tuple, collocations.op13_collocations(spark, SMALL).select(*names).collect())) == sorted(want)
