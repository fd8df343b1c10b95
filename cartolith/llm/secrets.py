"""Secret scans with a trigram inverted index.

Every rule's regular expression is turned into a Boolean query over the trigrams that each of its matches must contain.
The index holds, for every trigram that some query mentions, the texts that contain it; a query's postings are intersected,
and only texts that remain are verified with the expression itself. Rules without a mandatory trigram scan every text.
Texts are addressed by their digest, so a text that is repeated a million times is one entry of the index.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from re import _constants as C, _parser

from pyspark.sql import Column, DataFrame, functions as F

from cartolith.session import materialise


@dataclass(frozen=True)
class Rule:
    """``pattern`` has groups that cover the whole match: all before the value, the value, and maybe a rest.

    Matches are leftmost and do not overlap; those whose value or whole length is too short are dropped afterwards.
    """

    kind: str
    pattern: str
    least_value: int = 0
    least_length: int = 0


# The three base rules and their order.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)""", least_value=6),
    # greedy runs: asking for the length at once finds the same matches as dropping short ones later
    Rule("access", r"(AKIA)([A-Z0-9]{16,})", least_length=20),
    Rule("hex", r"()([0-9a-f]{24,})", least_length=24),
)
# Well-known credential shapes beyond the base rules.
ADDED = (
    Rule("pem", r"(-----BEGIN (?:RSA |EC |DSA |OPENSSH )?PRIVATE KEY-----)([A-Za-z0-9+/=\s]*)", least_value=16),
    Rule("github", r"(gh[pousr]_)([A-Za-z0-9]+)", least_value=36),
    Rule("slack", r"(xox[abprs]-)([A-Za-z0-9-]+)", least_value=10),
    Rule("jwt", r"(eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.)([A-Za-z0-9_-]+)", least_value=10),
    Rule("url", r"([a-z][a-z0-9+.-]{1,20}://[A-Za-z0-9_.-]++:)([^\s:@/]{6,}+)(?=@)"),  # a longer scheme is entered at a later letter
)
RULES = BASE + ADDED

_MANY = 16  # literal sets and queries larger than this are cut at a place that keeps them necessary


# trigram queries -------------------------------------------------------------------------------------------------------
# A query is a frozenset of conjunctions, each a frozenset of trigrams: a match contains all trigrams of one conjunction.
# The query with one empty conjunction holds for every text.

ANYTHING = frozenset({frozenset()})


def _both(a: frozenset, b: frozenset) -> frozenset:
    joined = frozenset(x | y for x in a for y in b)
    joined = frozenset(x for x in joined if not any(y < x for y in joined))
    return joined if len(joined) <= _MANY else min(a, b, key=len)


def _either(a: frozenset, b: frozenset) -> frozenset:
    joined = a | b
    joined = frozenset(x for x in joined if not any(y < x for y in joined))
    return joined if len(joined) <= _MANY else ANYTHING


def _of_literals(words: set[str]) -> frozenset:
    """Each word's trigrams, any of the words."""
    return frozenset(frozenset(w[i:i + 3] for i in range(len(w) - 2)) for w in words) if words else ANYTHING


def _item(op, value) -> tuple[set[str] | None, frozenset]:
    """For one item of a parsed pattern: all texts it can match, if few, and a query that every match meets."""
    if op is C.LITERAL:
        return {chr(value).lower()}, ANYTHING
    if op is C.IN and len(value) <= 8 and all(x is C.LITERAL for x, _ in value):
        return {chr(v).lower() for _, v in value}, ANYTHING
    if op is C.SUBPATTERN:
        return _read(value[3])
    if op is C.BRANCH:
        ways = [_read(x) for x in value[1]]
        if all(texts is not None for texts, _ in ways) and sum(len(texts) for texts, _ in ways) <= _MANY:
            return set().union(*(texts for texts, _ in ways)), ANYTHING
        needs = [need if texts is None else _of_literals(texts) for texts, need in ways]
        joined = needs[0]
        for need in needs[1:]:
            joined = _either(joined, need)
        return None, joined
    if op is C.MAX_REPEAT and value[1] == 1:
        texts, need = _read(value[2])
        if value[0] == 0:
            return (None if texts is None else texts | {""}), ANYTHING
        return texts, need
    if op is C.MAX_REPEAT and value[0] >= 1:
        texts, need = _read(value[2])
        return None, need if texts is None else _of_literals(texts)
    if op in (C.ASSERT, C.ASSERT_NOT, C.AT):
        return {""}, ANYTHING
    return None, ANYTHING


def _read(tree) -> tuple[set[str] | None, frozenset]:
    """The same for a sequence of items. Runs of literals grow until an item breaks them."""
    run, unbroken, query = {""}, True, ANYTHING
    for op, value in tree:
        texts, need = _item(op, value)
        query = _both(query, need)
        if texts is not None and len(run) * len(texts) <= _MANY:
            run = {a + b for a in run for b in texts}
        else:
            query, unbroken, run = _both(query, _of_literals(run)), False, texts or {""}
    return (run, query) if unbroken else (None, _both(query, _of_literals(run)))


def trigram_query(pattern: str) -> frozenset:
    """Boolean trigram query, lower-cased, that every match of ``pattern`` meets; ANYTHING if there is no mandatory one."""
    texts, query = _read(_parser.parse(pattern))
    if texts is not None:
        query = _of_literals(texts)
    return ANYTHING if frozenset() in query else query


# index and scan --------------------------------------------------------------------------------------------------------

# private-use characters mark matches; the same characters in a text are renamed first, which keeps all positions
_OPEN, _VALUE, _CLOSE, _RENAMED = "\ue000", "\ue001", "\ue002", "\ue003" * 3


_SPAN = "struct<start:int,rank:int,kind:string,end:int,value:int>"
_DIGEST, _CANDIDATE, _CLEAN = "__secret_digest", "__secret_rules", "__secret_text"


def _digest(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def trigram_index(texts: DataFrame, trigrams: list[str]) -> DataFrame:
    """Postings (trigram, digest) of texts (digest, text) for the given trigrams; others cannot be asked for."""
    present = F.array_compact(F.array(*[F.when(F.contains("lowered", F.lit(t)), F.lit(t)) for t in trigrams]))
    return (texts.select("digest", F.lower("text").alias("lowered")).select("digest", F.explode(present).alias("trigram"))
            .select("trigram", "digest").distinct())


def candidates(index: DataFrame, queries: dict[str, frozenset]) -> DataFrame:
    """(digest, rules): for every text the rules whose trigram query its postings meet."""
    asked = [F.struct(F.lit(rule).alias("rule"), F.lit(i).alias("way"), F.lit(t).alias("trigram"), F.lit(len(need)).alias("needed"))
             for rule, query in queries.items() for i, need in enumerate(sorted(query, key=sorted)) for t in sorted(need)]
    wanted = index.sparkSession.range(1).select(F.explode(F.array(*asked)).alias("w")).select("w.*")
    met = (index.join(F.broadcast(wanted), "trigram")  # a few rows per rule
           .groupBy("digest", "rule", "way").agg(F.count("*").alias("found"), F.first("needed").alias("needed")).where("found = needed"))
    return met.groupBy("digest").agg(F.collect_set("rule").alias("rules"))


def _bound(value: Column, use) -> Column:
    """use(value), with value worked out once per row however often the result mentions it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _lots(items: Column, size: int = 512) -> Column:
    """The array cut into arrays of at most ``size``; appending to those one by one copies little."""
    lots = F.transform(F.sequence(F.lit(1), F.greatest(F.size(items), F.lit(1)), F.lit(size)), lambda i: F.slice(items, i, size))
    return F.filter(lots, lambda lot: F.size(lot) > 0)


def _walked(items: Column, move, emit, kind: str) -> Column:
    """All of the arrays emit(at, item), joined; at starts from 0 and becomes move(at, item). Time is linear in the items."""
    none = F.array().cast(f"array<{kind}>")

    def starts(lots: Column) -> Column:
        return F.aggregate(lots, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts")), lambda s, lot: F.struct(
            F.aggregate(lot, s["at"], move).alias("at"), F.concat(s["starts"], F.array(s["at"])).alias("starts")), lambda s: s["starts"])

    def walk(lot: Column, at: Column) -> Column:
        return F.aggregate(lot, F.struct(at.alias("at"), none.alias("found")), lambda s, m: F.struct(
            move(s["at"], m).alias("at"), F.concat(s["found"], emit(s["at"], m)).alias("found")), lambda s: s["found"])

    return _bound(_lots(items), lambda lots: F.flatten(F.zip_with(lots, starts(lots), walk)))


def _matches(rule: Rule, text: Column) -> Column:
    """Every match as (before, head, value): characters since the last match's end, of the part before the value, of the value."""
    parts = F.split(F.regexp_replace(text, rule.pattern, f"{_OPEN}$1{_VALUE}$2{_CLOSE}"), f"[{_OPEN}{_CLOSE}]", -1)
    # before, match, before, match, ..., rest
    return _bound(parts, lambda p: F.transform(F.sequence(F.lit(0), F.greatest(F.size(p) - 3, F.lit(0)), F.lit(2)), lambda i: F.struct(
        F.length(F.get(p, i)).alias("before"),
        (F.locate(_VALUE, F.get(p, i + 1)) - 1).alias("head"),
        (F.length(F.get(p, i + 1)) - F.locate(_VALUE, F.get(p, i + 1))).alias("value"))))


def _spans(rule: Rule, rank: int, text: Column) -> Column:
    """Array of (start, rank, kind, end, value_start) of the matches that are long enough; ends exclusive, in code points."""
    def emit(at: Column, m: Column) -> Column:
        span = F.struct((at + m["before"]).alias("start"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"),
                        (at + m["before"] + m["head"] + m["value"]).alias("end"), (at + m["before"] + m["head"]).alias("value"))
        return F.when((m["value"] >= rule.least_value) & (m["head"] + m["value"] >= rule.least_length), F.array(span)).otherwise(
            F.array().cast(f"array<{_SPAN}>"))

    spans = _bound(_matches(rule, text), lambda found: _walked(found, lambda at, m: at + m["before"] + m["head"] + m["value"], emit, _SPAN))
    return F.when(F.regexp_like(text, F.lit(rule.pattern)), spans)


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_column: str = "text") -> DataFrame:
    """docs with ``secret_spans``: array of (start, rank, kind, end, value), by start, then in the order of the rules.

    Spans are in code points of the whole text, ends exclusive; value is where the secret itself begins.
    * null and empty texts have an empty array; texts of any length are scanned whole
    * rows are kept as they are, repeated ones included, with all their columns; only a column secret_spans is replaced
    * an empty table gives an empty result
    """
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    asked = {kind: q for kind, q in queries.items() if q != ANYTHING}
    trigrams = sorted({t for q in asked.values() for need in q for t in need})
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    keyed = docs.withColumn(_DIGEST, _digest(text))
    if trigrams:
        index = materialise(trigram_index(keyed.select(F.col(_DIGEST).alias("digest"), text.alias("text")), trigrams), "postings")
        found = candidates(index, asked).select(F.col("digest").alias(_DIGEST), F.col("rules").alias(_CANDIDATE))
        keyed = keyed.join(found, _DIGEST, "left")
    else:
        keyed = keyed.withColumn(_CANDIDATE, F.lit(None).cast("array<string>"))
    marked = F.contains(text, F.lit(_OPEN)) | F.contains(text, F.lit(_VALUE)) | F.contains(text, F.lit(_CLOSE))
    keyed = keyed.withColumn(_CLEAN, F.when(marked, F.translate(text, _OPEN + _VALUE + _CLOSE, _RENAMED)).otherwise(text))
    spans = []
    for rank, rule in enumerate(rules):
        own = _spans(rule, rank, F.col(_CLEAN))
        if rule.kind in asked:
            own = F.when(F.array_contains(_CANDIDATE, rule.kind), own)
        spans.append(F.coalesce(own, F.array().cast(f"array<{_SPAN}>")))
    return keyed.withColumn("secret_spans", F.sort_array(F.flatten(F.array(*spans)))).drop(_DIGEST, _CANDIDATE, _CLEAN)


def joined(spans: Column) -> Column:
    """kind:start:end of every span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(kind: str, spans: Column) -> Column:
    """Number of spans of one kind."""
    return F.size(F.filter(spans, lambda s: s["kind"] == kind))


def redacted(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """The text with the secret part of every span replaced; overlapping spans are replaced together."""
    # stretches of text to keep, each of which a mark follows
    keeps = _walked(spans, lambda at, m: F.greatest(at, m["end"]), lambda at, m: F.when(
        m["value"] >= at, F.array(F.struct(at.alias("at"), m["value"].alias("to")))).otherwise(F.array().cast("array<struct<at:int,to:int>>")),
        "struct<at:int,to:int>")

    def cut(lot: Column) -> Column:  # positions are counted from the start of a string, so a lot's part of the text comes first
        first = F.get(lot, F.lit(0))["at"]
        part = F.substring(text, first + 1, F.get(lot, F.size(lot) - 1)["to"] - first)
        return _bound(part, lambda own: F.array_join(F.transform(lot, lambda k: F.concat(F.substring(own, k["at"] - first + 1, k["to"] - k["at"]), F.lit(mark))), ""))

    kept = _bound(keeps, lambda k: F.array_join(F.transform(_lots(k), cut), ""))
    last = F.array_max(F.transform(spans, lambda m: m["end"]))
    return F.when(F.size(spans) > 0, F.concat(kept, F.substring(text, last + 1, F.length(text)))).otherwise(text)


def op5_secret_scans(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = find_secrets(docs.select("doc_id", "text"))
    spans = F.col("secret_spans")
    base = F.filter(spans, lambda s: s["rank"] < len(BASE))
    count = [count_of(r.kind, spans).cast("long").alias(f"n_{r.kind}") for r in BASE]
    return found.select("doc_id", *count, F.sha2(joined(base), 256).alias("base_sha256"), joined(spans).alias("spans"))
