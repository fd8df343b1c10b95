from __future__ import annotations

import datetime
import hashlib
import random
import re
import time

from pyspark.sql import functions as F

from cartolith.llm import licences, secrets, url_lists
from tests.llm.helpers import documents

BRUTE = [
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 6),
    ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24),
]


def brute_base(text):
    found = [(m.start(), i, kind, m.end()) for i, (kind, rule, fits) in enumerate(BRUTE) for m in rule.finditer(text or "") if fits(m)]
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(found))


def test_trigram_queries():
    query = secrets.trigram_query
    assert query("hello") == {frozenset(["hel", "ell", "llo"])}
    assert query("HeLLo|xyz") == {frozenset(["hel", "ell", "llo"]), frozenset(["xyz"])}
    assert query("ab?c") == secrets.ANYTHING and query("[0-9a-f]{24,}") == secrets.ANYTHING and query("abc|x") == secrets.ANYTHING
    assert query("ab?cd") == {frozenset(["abc", "bcd"]), frozenset(["acd"])}
    assert query("abc[0-9]+def") == {frozenset(["abc", "def"])}
    assert query("(?:abc)+x*") == {frozenset(["abc"])} and query("(?:abc)*xyz") == {frozenset(["xyz"])}
    assert query(secrets.BASE[1].pattern) == {frozenset(["aki", "kia"])}
    assert query(secrets.BASE[2].pattern) == secrets.ANYTHING
    assert frozenset(["tok", "oke", "ken"]) in query(secrets.BASE[0].pattern)


def test_queries_never_lose_a_match():
    rng = random.Random(3)
    for rule in secrets.RULES:
        need = secrets.trigram_query(rule.pattern)
        for text in ["password: hunter22", "API_KEY='abcdefgh'", "AKIA" + "A1" * 9, "ghp_" + "a" * 36, "xoxb-12345-abcdef", "https://me:secret1@host",
                     "eyJab.eyJcd.signature12", "-----BEGIN RSA PRIVATE KEY-----\nMIIabcdefghijklmnop"]:
            text = "".join(rng.choice("ab ") for _ in range(5)) + text
            if re.search(rule.pattern, text):
                grams = {text.lower()[i:i + 3] for i in range(len(text))}
                assert any(way <= grams for way in need), (rule.kind, text)


TRICKY = ["secret=token: abcdefgh", "token=abc token=abcdefgh", "PASSWORD==abcdef", "apikey : 'x.y/z+1=' rest", "é🙂 token = \"24be64439e3e49cf46b2d7c90f3602a3\" ü",
          "AKIAAKIA" + "B" * 20 + "c", "0" * 24 + "g" + "f" * 23, "token=abcdef passwd:abcdef", "passwordpassword=abcdef", "", None, "key",
          "toKen=abcdef ſecret=abcdef", "token\n=abcdef", "a" * 5000 + " secret:zzzzzz " + "b" * 5000]


def test_secrets_against_plain_expressions(spark):
    rng = random.Random(5)
    parts = ["token", "secret", "=", ":", " ", "'", '"', "abc", "api_key", "APIKEY", "AKIA", "0123456789abcdef", "XYZ123", "é", "\n", "==", "passwd"]
    texts = TRICKY + ["".join(rng.choice(parts) for _ in range(rng.randint(1, 25))) for _ in range(300)]
    rows = list(enumerate(texts)) + [(0, texts[0]), (0, texts[0]), (None, "token=abcdef")]
    docs = documents(spark, rows).withColumn("secret_spans", F.lit("clash")).withColumn("digest", F.lit(1)).withColumn("rules", F.lit(1))
    spans = F.filter("secret_spans", lambda s: s["rank"] < 3)
    got = secrets.find_secrets(docs).select("doc_id", "text", secrets.joined(spans).alias("base"), secrets.redacted(F.col("text"), F.col("secret_spans")).alias("clean"), "rules").collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.base == brute_base(r.text), r.text
        assert (r.clean == r.text) == (not r.base) or r.text is None
    assert any("abcdefgh" in (r.text or "") and "abcdefgh" not in (r.clean or "") for r in got)
    assert secrets.find_secrets(docs.limit(0)).count() == 0
    assert hashlib.sha256(b"").hexdigest() == spark.range(1).select(F.sha2(F.lit(""), 256)).first()[0]


def test_added_rules_and_redaction(spark):
    text = "x ghp_" + "a" * 36 + " url https://me:secret1@host end"
    row = secrets.find_secrets(documents(spark, [(1, text)])).select(secrets.joined(F.col("secret_spans")).alias("s"), secrets.redacted(F.col("text"), F.col("secret_spans")).alias("c")).first()
    assert row.s.startswith("github:2:42") and "url:47:" in row.s
    assert row.c == "x ghp_[secret] url https://me:[secret]@host end"


def test_very_many_secrets_in_one_text(spark):
    line = "é token=abcdef{:06d} and api_key: '{:08d}'\n"
    texts = ["".join(line.format(i, i) for i in range(n)) + "end" for n in (50_000, 512, 256, 513)]
    began = time.monotonic()
    rows = secrets.find_secrets(documents(spark, list(enumerate(texts)))).select(
        "text", secrets.joined(F.col("secret_spans")).alias("s"), secrets.redacted(F.col("text"), F.col("secret_spans")).alias("c")).collect()
    assert time.monotonic() - began < 60
    for r in rows:
        assert r.s == brute_base(r.text)
        assert r.c == re.sub(r"(token=|api_key: ')[a-z0-9]+", r"\1[secret]", r.text)


def day(n, hour=0):
    return datetime.datetime(2024, 1, n, hour)


def test_lists_as_of_fetch_time(spark):
    entries = spark.createDataFrame([
        ("block", "host", "bad.com", day(2), True), ("block", "host", "bad.com", day(4), False), ("block", "host", "bad.com", day(6), True),
        ("block", "domain", "evil.org", day(1), True), ("allow", "prefix", "a.evil.org/ok/", day(3), True), ("allow", "host", "bad.com", day(8), True),
        ("block", "host", "tie.com", day(1), True), ("block", "host", "tie.com", day(1), False), ("block", None, "x", day(1), True),
        ("block", "host", None, day(1), True), ("other", "host", "bad.com", day(1), True), ("block", "prefix", "p.com/a", day(1), True)],
        "list string, scope string, value string, at timestamp, active boolean")
    cases = [
        ("http://bad.com/x", day(1), "none"), ("http://bad.com/x", day(2), "block"), ("http://BAD.com:80/x", day(3, 5), "block"), ("http://u@bad.com", day(4), "none"),
        ("http://bad.com/x", day(7), "block"), ("http://bad.com/x", day(9), "allow"), ("http://a.evil.org/", day(2), "block"), ("http://a.evil.org/ok/y", day(2), "block"),
        ("http://a.evil.org/ok/y?z", day(3), "allow"), ("http://evil.org.com/", day(3), "none"), ("http://tie.com", day(2), "none"), ("http://p.com/a", day(2), "block"),
        ("http://p.com/ab", day(2), "none"), ("not a url", day(3), "none"), ("", day(3), "none"), (None, day(3), "none"), ("http://bad.com/x", None, "none"),
        ("http://bad.com/" + "y/" * 800, day(3), "block")]
    rows = [(i, u, t, "clash") for i, (u, t, _) in enumerate(cases)]
    captures = spark.createDataFrame(rows + [rows[1], rows[1], (None, "http://bad.com/x", day(3), "c")], "page_id long, url string, fetched timestamp, key string")
    for slices in (1, 7, 64):
        got = {r.page_id: (r.verdict, r.captures) for r in url_lists.url_verdicts(captures, entries, slices).collect()}
        assert {i: got[i][0] for i in range(len(cases))} == {i: v for i, (_, _, v) in enumerate(cases)}
        assert got[1][1] == 3 and got[None] == ("block", 1)
    assert url_lists.url_verdicts(captures.limit(0), entries).count() == 0
    assert {r.verdict for r in url_lists.url_verdicts(captures, entries.limit(0)).collect()} == {"none"}


def test_licences(spark):
    mit = licences.KNOWN[0][1]
    odd = "Copyright (c) 2020 Somebody\n" + mit.replace("sublicense", "sub-licence").replace(",", " ;").upper()
    rows = [(1, mit), (2, odd), (3, "prose here\nReleased under the MIT licence!\nmore\nALL RIGHTS RESERVED"), (4, None), (5, ""), (6, "..."), (7, mit + " and more"),
            (1, mit), (None, "All rights reserved."), (8, "word " * 20000)]
    docs = documents(spark, rows).withColumn("digest", F.lit("clash")).withColumn("license", F.lit(1))
    found = licences.license_scan(docs).collect()
    got = {r.id: (r.license, r.notices) for r in found}
    assert len(found) == len(rows) - 1
    assert got[1][0] == got[2][0] == "MIT" and got[3] == (None, "MIT,Proprietary") and got[7][0] is None
    assert got[4] == got[5] == got[6] == (None, "") and got[8] == (None, "") and got[None] == ("Proprietary", "Proprietary")
    by_id = {r.id: r.digest for r in found}
    for i, text in rows:
        if text and i:
            assert by_id[i] == hashlib.md5(licences.canonical_text(text).encode()).hexdigest()
    assert licences.license_scan(docs.limit(0)).count() == 0
    assert {r.license for r in licences.license_scan(docs, known={}).collect()} == {None}


def test_url_credentials_of_any_length(spark):
    rows = [(1, "see https://me:" + "s" * 1000 + "@host end"), (2, "https://" + "u" * 300 + ":" + "a.b-c" * 400 + "@h"),
            (3, "averyveryveryverylongscheme+x://me:secret1@host"), (4, "https://me:" + "s" * 1000 + " host"), (5, "https://me:short@host")]
    found = secrets.find_secrets(documents(spark, rows))
    got = {r.doc_id: r for r in found.select("doc_id", F.size("secret_spans").alias("n"),
                                             secrets.redacted(F.col("text"), F.col("secret_spans")).alias("clean")).collect()}
    assert {i: r.n for i, r in got.items()} == {1: 1, 2: 1, 3: 1, 4: 0, 5: 0}
    assert got[1].clean == "see https://me:[secret]@host end" and got[2].clean == "https://" + "u" * 300 + ":[secret]@h"
    assert got[3].clean.endswith("://me:[secret]@host")
