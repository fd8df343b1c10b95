from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cartolith.llm import alignment
from cartolith.llm.wordbpe import _byte_letters
from tests.llm.helpers import SMALL, documents

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "a", "a ", " a", "a  b   c ", "\n", "a\nb", "a \nb", "a\n b", "\ta b", "don't we'll", "<|endoftext|> x <s></s> <0x41>", "naïve Ünïcödé ßẞ", "日本語 テキスト　全角",
       "▁ a", "x▁y", "🙂👍🏽 é", "a b  c", "a\x1c b\x85 c", "x\x00y z", "x" * 3000, "word " * 5000, "12 345 6789", "!!! ??? ###  ", "ﬁ ½ x²", "  a  b", "a 　b \r\n c"]


def brute(texts):
    a, b = Tokenizer.from_file(PATHS[0]), sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    a.encode_special_tokens = True
    spelled = {i: t for t, i in a.get_vocab().items()}
    byte_of = {c: n for n, c in enumerate(_byte_letters())}

    def b_bytes(i):
        piece = b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()
    found = []
    for text in texts:
        whole = (" " + text).encode() if text else b""
        x = a.encode(" " + text, add_special_tokens=False).ids if text else []
        y = b.encode(text) if text else []
        xs, ys = [bytes(byte_of[c] for c in spelled[i]) for i in x], [b_bytes(i) for i in y]
        if not text or b"".join(xs) != whole or b"".join(ys) != whole:
            found.append(None)
            continue
        ends = [np.cumsum([len(p) for p in parts]).tolist() for parts in (xs, ys)]
        groups, i, j = [], 0, 0
        for cut in sorted(set(ends[0]) & set(ends[1])):
            i2, j2 = ends[0].index(cut) + 1, ends[1].index(cut) + 1
            groups.append(f"{','.join(map(str, x[i:i2]))}|{','.join(map(str, y[j:j2]))}")
            i, j = i2, j2
        links, j = [], 0
        for i in range(len(x)):
            lo, hi = ends[0][i] - len(xs[i]), ends[0][i]
            while ends[1][j] <= lo:
                j += 1
            k = j
            while k < len(y) and ends[1][k] - len(ys[k]) < hi:
                links.append((x[i], y[k]))
                k += 1
        found.append((len(x), len(y), len(groups), links, ";".join(groups)))
    counts = Counter(link for f in found if f for link in f[3])
    best = {}
    for (_, y), n in counts.items():
        best[y] = max(best.get(y, 0), n)
    out = []
    for f in found:
        if f is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
        else:
            out.append((*f[:3], len(f[3]), sum(counts[p] == best[p[1]] for p in f[3]), sum(counts[p] for p in f[3]), hashlib.sha256(f[4].encode()).hexdigest()))
    return out


def some_texts():
    rng = random.Random(4)
    letters = ["a", "the", "ing", " ", " ", " ", "  ", "\n", "é", "日", "'s", ".", "▁", "1", "　", "\x85", "Ω"]
    return ODD + ["".join(rng.choice(letters[:12] if i % 5 else letters) for _ in range(rng.randint(1, 60))) for i in range(300)]


@pytest.mark.parametrize("shipped, bucket", [(4_000_000, 1 << 16), (4_000_000, 50), (0, 50)])
def test_alignment_is_that_of_brute_force(spark, shipped, bucket):
    texts = some_texts() + ["repeated row"] * 3 + [None]
    docs = documents(spark, list(enumerate(texts))).repartition(5).withColumn("n_a", F.lit("clash")).withColumn("id", F.lit(None))
    got = alignment.align(docs, *PATHS, shipped_pairs=shipped, bucket_pairs=bucket).collect()
    want = brute([t or "" for t in texts])
    assert len(got) == len(texts)
    for r in got:
        assert tuple(r)[1:7] + (r.groups_sha256,) == want[r.id], texts[r.id]
        assert r.groups_sha256 == (hashlib.sha256(r.groups.encode()).hexdigest() if r.groups else "")
    assert alignment.align(docs.limit(0), *PATHS).count() == 0


def test_null_ids_and_repeated_rows(spark):
    rows = [(None, "some text"), (7, "some text"), (7, "some text")]
    got = alignment.align(documents(spark, rows), *PATHS, spelled=False)
    assert "groups" not in got.columns
    got = got.collect()
    assert sorted(r.id is None for r in got) == [False, False, True] and len({tuple(r)[1:] for r in got}) == 1 and got[0].count_sum == 3 * got[0].n_links


def test_vectors_summed_in_a_tree(spark):
    docs = documents(spark, [(i, f"word{i % 7} and word{i % 3} more") for i in range(60)]).repartition(12)
    _, counted = alignment.pair_counts(docs, PATHS, bucket_pairs=8, fan_in=2)
    got = {p: n for r in counted.collect() for p, n in zip(r.pairs, r.counts)}
    want = Counter()
    for r in alignment.linked_pairs(docs, PATHS).collect():
        want[r.pair] += r.n
    assert got == want


def test_hash_is_minimal_and_notices_strange_pairs():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 1000):
        keys = np.unique(rng.integers(0, 1 << 31, n))
        places = alignment._bucket_places(alignment.build_hash(keys), keys)
        assert sorted(places.tolist()) == list(range(len(keys)))
    table = alignment.PairTable(1, {0: alignment.build_hash(keys)}, {0: keys[np.argsort(alignment._bucket_places(alignment.build_hash(keys), keys))]}, {0: np.arange(len(keys))},
                                np.zeros(alignment.B_IDS, np.int64))
    assert table.counts[table.places(keys)].tolist() == alignment._bucket_places(alignment.build_hash(keys), keys).tolist()
    with pytest.raises(ValueError):
        table.places(keys + (1 << 31))


def test_forgetting_chunks_changes_nothing(monkeypatch):
    monkeypatch.setattr(alignment, "KEPT", 3)
    aligner = alignment.Aligner(*PATHS)
    for chunks in ([" a", " b"], [" c", " d"], [" a", " e"], [" b", " f", " g"]):
        own = aligner.learn(chunks)
        alone = alignment.Aligner(*PATHS).learn(chunks)
        for c in chunks:
            assert own.groups[own.at[c]] == alone.groups[alone.at[c]] and own.sums[own.at[c]] == alone.sums[alone.at[c]]


def test_query_on_whole_documents(spark):
    got = {r.doc_id: tuple(r)[1:] for r in alignment.op11_tokenizer_alignment(spark, SMALL).collect()}
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    want = brute([r.text or "" for r in rows])
    assert got == {r.doc_id: w for r, w in zip(rows, want)}
