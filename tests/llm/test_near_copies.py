from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cartolith.llm import near_copies, simhash
from tests.llm.helpers import SMALL, components, documents


def similarity(a, b):
    a, b = (set(near_copies.shingles(t).tolist()) for t in (a, b))
    return len(a & b) / len(a | b) if a | b else 1.0


def greedy(rows):
    kept = []
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        if all(similarity(t, o) < 0.8 for _, o in kept):
            kept.append((i, t))
    return {i for i, _ in kept}


def edited(words, at, rng):
    own = list(words)
    for i in at:
        own[i] = "edit%d" % rng.randrange(10**9)
    return own


def test_stage_removes_near_copies_with_ordinary_edits_and_nothing_unlike(spark):
    rng = random.Random(3)
    stage = dict(corpus_pipeline.STAGES)["near_duplicates"]
    rows = []
    for g in range(12):
        base = ["w%d" % rng.randrange(5000) for _ in range(300)]
        rows.append((g * 100, " ".join(base)))
        rows.append((g * 100 + 1, " ".join(edited(base, range(10, 300, 60), rng))))  # 25 of 296 shingles: about 0.84
        rows.append((g * 100 + 2, " ".join(edited(base, range(10, 300, 25), rng))))  # 60 of 296: about 0.66
    rows += [(9000, None), (9001, ""), (9002, " \n"), (9003, "a b"), (9004, "A  b"), (9004, "A  b")]
    got = {r.doc_id for r in stage(spark, documents(spark, rows), SMALL).collect()}
    assert got == greedy(rows)
    assert 1 not in got and 2 in got


@pytest.mark.parametrize("rounds", [6, 1])
def test_chains_do_not_pass_on_removals(spark, rounds):
    rng = random.Random(4)
    words = ["w%d" % i for i in range(300)]
    rows = []
    for i in range(12):  # each has a few more edits than the one before
        words = edited(words, [5 + 23 * i, 15 + 23 * i], rng)
        rows.append((i, " ".join(words)))
    rows += [(None, rows[0][1] + " more"), (None, "some text without an id at all")]
    got = [r.doc_id for r in near_copies.without_near_copies(documents(spark, rows), rounds=rounds).collect()]
    want = greedy([r for r in rows if r[0] is not None])
    assert {i for i in got if i is not None} == want and 1 < len(want) < 12
    assert got.count(None) == 1


def test_fingerprint_groups_pair_their_members_with_the_first(spark):
    rng = random.Random(6)
    base = ["w%d" % i for i in range(2000)]
    rows = [(9 - i, " ".join(edited(base, at, rng))) for i, at in enumerate([[], [40], [900], [40, 1500]])] + [(3, "quite another text of some words"), (4, None)]
    docs = documents(spark, rows)
    signed = near_copies._signed(docs, 5, "text")
    ids = signed.select("__copy_node", "doc_id").withColumnRenamed("doc_id", "id")
    nodes = ids.groupBy("__copy_node").agg(F.min("id").alias("id")).select("__copy_node", F.struct("id", F.col("__copy_node").alias("node")).alias("rank"))
    met = {}
    for r in near_copies.fingerprint_meets(signed, nodes, 5).collect():
        met.setdefault(r.key, set()).add(r.rank.id)
    prints = {i: simhash.fingerprint(t, 5) for i, t in rows}
    groups = components(list(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 4)
    want = sorted({first, i} for i, first in groups.items() if i != first)
    assert sorted(map(sorted, met.values())) == sorted(map(sorted, want)) and len(want) == 3


def test_bands_meet_at_the_threshold():
    rng = np.random.default_rng(1)
    met = 0
    for _ in range(200):
        pool = rng.integers(0, 1 << 63, 440, dtype=np.uint64)
        met += bool((near_copies.band_keys(pool[:400]) == near_copies.band_keys(pool[40:])).any())  # 360 of 440: 0.82
    assert met >= 199
