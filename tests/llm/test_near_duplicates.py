from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from cartolith.llm.components import connected_components
from cartolith.llm.embedding_dedup import embedding_groups
from cartolith.llm.simhash import bucket_links, fingerprint, segment_bounds, simhash_groups
from tests.llm.helpers import components, documents


def test_components_of_paths_cycles_and_stars(spark):
    rng = random.Random(4)
    pairs = [(i, i + 1) for i in range(60)] + [(100 + i, 100 + (i + 1) % 9) for i in range(9)] + [(200, 200 + i) for i in range(30)]
    pairs += [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)] + [(7, 7), (3, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = components(sorted({x for p in pairs for x in p}), lambda a, b: (a, b) in pairs or (b, a) in pairs)
    assert got == {n: c for n, c in want.items() if any(n in p and p[0] != p[1] for p in pairs)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_fingerprint_by_definition():
    import xxhash
    text = "One  two\tTHREE four\nfive ÄÖ five"
    words = "one two three four five ÄÖ five".split()
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i:i + 4]).encode(), 42) for i in range(4)]
    want = sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > 4)
    assert fingerprint(text) == want
    assert fingerprint(None) == fingerprint("") == fingerprint(" \n\x0b") == 0
    assert fingerprint("A b") == xxhash.xxh64_intdigest(b"a b", 42)


def test_segments_cover_all_bits():
    assert [segment_bounds(3)[0][0], sum(b for _, b in segment_bounds(3))] == [0, 64]


def test_simhash_groups_against_all_pairs(spark):
    rng = random.Random(1)
    vocabulary = ["w%d" % i for i in range(400)]
    rows, number = [], 0
    for _ in range(25):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(1, 300))]
        for _ in range(rng.randint(1, 8)):
            own = list(words)
            for _ in range(rng.randint(0, 2)):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            rows.append((number, " ".join(own)))
            number += 1
    rows += [(number, None), (number + 1, ""), (number + 2, "\n"), (number + 3, rows[0][1]), (number + 3, rows[0][1])]
    docs = documents(spark, rows).withColumn("id", F.lit("clash")).withColumn("fp", F.lit(1))
    got = simhash_groups(docs).collect()
    prints = {n: fingerprint(t) for n, t in rows}
    want = components(sorted(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 4)
    assert len(got) == len(rows)
    assert {(r.id, r.component_id, r.kept) for r in got} == {(n, c, n == c) for n, c in want.items()}
    assert len({c for c in want.values()}) < number  # some are near duplicates
    assert simhash_groups(docs.limit(0)).count() == 0
    nameless = simhash_groups(documents(spark, [(None, "a b c d e"), (None, "a b c d e")])).collect()
    assert [(r.component_id, r.kept) for r in nameless] == [(None, False)] * 2


def test_large_bucket_is_linked_completely():
    import pyarrow as pa
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, dtype=np.uint64)
    prints = np.unique(base ^ (np.uint64(1) << rng.integers(0, 64, 3000).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 3000).astype(np.uint64)))
    batch = pa.RecordBatch.from_arrays([pa.array(np.zeros(len(prints), np.int64)), pa.array(prints.view(np.int64))], ["key", "fp"])
    links = pa.Table.from_batches(list(bucket_links(4)(iter([batch.slice(0, 700), batch.slice(700)]))))
    assert links.num_rows == len(prints) - 1  # a spanning tree: pairs two bits around one centre are all linked


def test_hot_buckets_are_dealt_out_as_block_pairs(spark):
    from cartolith.llm.simhash import block_pairs, variants
    rng = random.Random(6)
    base = ["w%d" % rng.randrange(5000) for _ in range(1500)]
    rows = []
    for i in range(300):  # many different fingerprints under the same keys
        own = list(base)
        for _ in range(3):
            own[rng.randrange(len(own))] = "edit%d" % rng.randrange(10**6)
        rows.append((i, " ".join(own)))
    rows += [(1000 + i, " ".join("x%d" % rng.randrange(10**6) for _ in range(40))) for i in range(50)]
    prints = {n: fingerprint(t) for n, t in rows}
    want = components(sorted(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 4)
    got = {r.id: r.component_id for r in simhash_groups(documents(spark, rows), block=16).collect()}
    assert got == want and len(set(prints.values())) > 100
    fps = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in set(prints.values())], "fp long")
    keyed = variants(fps, 3)
    large = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 16")
    dealt = block_pairs(keyed, large, 16)
    assert dealt.groupBy("key", "i", "j").count().agg(F.max("count")).first()[0] < large.agg(F.max("n")).first()[0]
    assert dealt.groupBy("key", "i", "j").count().agg(F.max("count")).first()[0] <= 4 * 16


def test_embedding_groups_against_all_pairs(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(60, 16))
    rows = []
    for c in centres:
        rows += [(c + rng.normal(scale=0.08 * rng.random(), size=16)) for _ in range(int(rng.integers(1, 12)))]
    rows += [rows[0]] * 40 + [rows[1] * 3.0]
    vectors = [(i, [float(x) for x in v]) for i, v in enumerate(rows)]
    n = len(vectors)
    odd = [(n, None), (n + 1, []), (n + 2, [0.0] * 16), (n + 3, [float("nan")] * 16), (n + 4, [None] + [1.0] * 15), (n + 5, [float("inf")] * 16),
           (n + 6, [1.0, 2.0]), (n + 7, [2.0, 4.0])]
    table = spark.createDataFrame([(*v, 1) for v in vectors + odd], "vec_id long, embedding array<double>, links int")
    got = {r.id: r for r in embedding_groups(table, block=16, window=32).collect()}
    unit = np.array(rows) / np.linalg.norm(rows, axis=1)[:, None]
    near = unit @ unit.T >= 0.95
    want = components(list(range(n)), lambda a, b: near[a, b])
    assert len(got) == n + len(odd)
    found = sum(got[i].n_links for i in range(n))
    assert 0.97 * (near.sum() - n) <= found <= near.sum() - n
    assert np.mean([got[i].component_id == want[i] for i in range(n)]) > 0.97
    assert all(got[i].kept == (got[i].component_id == i) for i in range(n))
    assert [(got[i].n_links, got[i].component_id, got[i].kept) for i, _ in odd[:6]] == [(0, i, True) for i, _ in odd[:6]]
    assert (got[n + 6].n_links, got[n + 7].component_id) == (1, n + 6)
    assert embedding_groups(table.limit(0)).count() == 0


def test_recall_on_a_given_table(spark):
    from tests.llm.helpers import SMALL
    table = spark.read.parquet(f"{SMALL}/embeddings.parquet").select("vec_id", "embedding")
    # noisy copies near the threshold, the hardest pairs
    noisy = table.select((F.col("vec_id") + 100000).alias("vec_id"), F.transform("embedding", lambda x, i: (
        x + 0.04 * F.sin(F.col("vec_id") * 31 + i * 17)).cast("float")).alias("embedding"))
    both = table.unionByName(noisy).toPandas().sort_values("vec_id")
    unit = np.vstack(both.embedding).astype(float)
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    true = int((unit @ unit.T >= 0.95).sum()) - len(both)
    got = embedding_groups(table.unionByName(noisy), window=16).agg(F.sum("n_links")).first()[0]
    assert true > 400 and 0.9 * true <= got <= true
