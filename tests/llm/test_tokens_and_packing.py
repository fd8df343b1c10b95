from __future__ import annotations

import random
import unicodedata
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cartolith.llm import packing, token_counts
from cartolith.llm.wordbpe import WordBpe
from tests.llm.helpers import SMALL, documents

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["don't we'll they're 'tis ''ll x'", "<|endoftext|> hi<|startoftext|>there !!<|endof", "İstanbul ΣΑΣ ﬁ é 한국어 日本語 🙂👍🏽 ½ x²   tab\x1cz \x85q", "",
       " ", "a", "\n\n", "é́a", "'l 've' 'v", "aaa aaaaaaa !!!!!!!! ???!!", "naïve Ünïcödé ßẞ ǅ", "x" * 3000]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_every_prefix_is_what_the_library_gives(library):
    counter, rng = WordBpe(PATH), random.Random(1)
    alphabet = "ab 'strevmld!?.<|é́İßΣ日🙂\n1²"
    texts = ODD[:-1] + ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 40))) for _ in range(400)]
    for text in texts:
        whole = unicodedata.normalize("NFC", text)
        want = [len(library.encode(whole[:n], add_special_tokens=False).ids) for n in range(1, len(whole) + 1)]
        assert counter.prefix_counts(text).tolist() == want, text
    for text, ids in zip(texts, counter.encode(texts)):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_forgetting_chunks_changes_nothing(library, monkeypatch):
    import cartolith.llm.wordbpe as module
    monkeypatch.setattr(module, "KEPT", 3)
    counter = WordBpe(PATH)
    for text in ODD:
        assert counter.encode([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids
        if text:
            assert counter.prefix_counts(text)[-1] == len(library.encode(text, add_special_tokens=False).ids)


def test_many_special_strings_in_a_row(library):
    counter = WordBpe(PATH)
    text = "a<|endoftext|>" + "<|endoftext|>" * 20_000 + "b"
    got = counter.prefix_counts(text)
    assert got[-1] == 20_003 and got[13] == 2 and len(got) == len(text)


def test_token_counts_of_documents(spark, library):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(99, None), (None, "no id"), (0, ODD[0])]
    docs = documents(spark, rows).withColumn("n_bytes", F.lit("clash"))
    got = token_counts.prefix_counts(docs, PATH).select("id", "n_bytes", token_counts.tokens().alias("n"), token_counts.tokens_of_first(5).alias("five"),
                                                        token_counts.characters_within(3).alias("fit")).collect()

    def count(text):
        return len(library.encode(text, add_special_tokens=False).ids)
    want = []
    for i, text in rows:
        text = text or ""
        whole = unicodedata.normalize("NFC", text)
        fit = max([n for n in range(len(whole) + 1) if count(whole[:n]) <= 3]) if len(whole) < 100 else None
        want.append((i, len(text.encode()), count(text), count(whole[:5]), fit))
    key = lambda r: (r[0] is None, r[0] or 0)
    for a, b in zip(sorted(map(tuple, got), key=key), sorted(want, key=key)):
        assert a[:4] == b[:4] and b[4] in (None, a[4])
    assert token_counts.prefix_counts(docs.limit(0), PATH).count() == 0


def brute_pieces(library, rows, capacity):
    out = []
    for i, text in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        for n, start in enumerate(range(0, len(ids), capacity)):
            part = ids[start:start + capacity]
            out.append((i, n, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    return sorted(out, key=lambda r: (r[0] is None, r))


def check_places(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_packing_is_whole_gapless_and_tight(spark, library):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()] + [(900, None), (901, ""), (None, "nameless"), (0, "again"), (0, "again")]
    docs = documents(spark, rows).withColumn("row", F.lit(7)).withColumn("length", F.lit(7))
    got = packing.packed_documents(docs, PATH).collect()
    assert sorted([(r.id, r.piece, r.start, r.length, r.ids_crc32) for r in got], key=lambda r: (r[0] is None, r)) == brute_pieces(library, rows, 2048)
    assert check_places(got, 2048) <= -(-sum(r.length for r in got) // 2048) + 1
    assert packing.packed_documents(docs.limit(0), PATH).count() == 0


def test_several_shards_and_levels(spark):
    rng = np.random.default_rng(1)
    lengths = [int(x) for x in rng.integers(1, 101, 3000)] + [100] * 50
    items = spark.createDataFrame([(i, x) for i, x in enumerate(lengths)], "row long, length long")
    got = packing.pack(items, capacity=100, shard_items=400, epochs=2, generations=3).join(items, "row").collect()
    assert sorted(r.row for r in got) == list(range(len(lengths)))
    sizes, loads = np.array(lengths), []
    packing.best_fit(sizes, np.argsort(-sizes, kind="stable"), np.full(len(sizes), -1), loads, 100)  # all in one shard
    assert check_places(got, 100) <= 1.02 * len(loads)  # shards of 400 pieces cost a little


def test_genetic_steps_keep_every_piece_and_improve():
    rng = np.random.default_rng(2)
    sizes = rng.integers(200, 700, 300)  # hard: few pieces per bin
    start = packing.evolve(sizes, [], None, 1000, 0, 6, np.random.default_rng(0))
    after = packing.evolve(sizes, list(start), start[-1], 1000, 30, 6, np.random.default_rng(0))
    score = lambda p: packing._score(sizes, p, 1000)
    assert score(after[0]) <= score(start[0])
    for child in (packing.crossover(sizes, start[0], start[1], 1000, rng), packing.mutate(sizes, start[0], 1000, rng), *after):
        assert (child >= 0).all() and (np.bincount(child, weights=sizes) <= 1000).all()
        assert set(np.unique(child)) == set(range(int(child.max()) + 1))


def test_token_sequences_round_trip(spark, library):
    rows = [(i, "some words and more words " * (i % 7)) for i in range(60)]
    got = packing.token_sequences(documents(spark, rows), PATH, capacity=50).collect()
    assert all(len(r.ids) <= 50 for r in got)
    want = sorted(x for _, t in rows for x in [*library.encode(t, add_special_tokens=False).ids, 0])
    assert sorted(x for r in got for x in r.ids) == want
