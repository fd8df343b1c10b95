"""Mixing to target weights by soft membership.

A classifier fitted on the labelled table gives every document a probability per domain. Each document has a rate, the number
of times it is used. Rates are fitted by projected gradient descent on least squares: nonnegative, as near to 1 as the
targets allow, and such that the expected tokens of every domain, summed over all documents, meet the target weights.

A step changes a rate only through the few domain residuals it saw, so the rates of any document follow from small numbers
and its posteriors: documents are never joined or shuffled. With the step size 1 / ridge a projected step even forgets the rate
it came from: it is max(0, 1 - p.residuals / ridge). Descent then is a search for the residuals that such a step reproduces.
Those of the next step come from Newton's rule on the domains, with the step lengths tried side by side in one job.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from cartolith.session import materialise

BUCKETS = 1 << 15
_WORDS, _TOKENS, _RATE = "__mix_words", "__mix_tokens", "__mix_rate"


@dataclass(frozen=True)
class Domains:
    """A multinomial word model: log likelihood ratios of hashed words against the first domain."""

    names: tuple[str, ...]
    ratios: tuple[tuple[float, ...], ...]  # for every domain but the first, by bucket
    prior: tuple[float, ...]  # log odds against the first domain of a text without telling words
    temperatures: tuple[float, ...]  # one for every ratio


def _words(text: Column) -> Column:
    """Hashed runs of letters and runs of signs of a whole text."""
    runs = F.regexp_extract_all(F.lower(F.coalesce(text.cast("string"), F.lit(""))), F.lit(r"\p{L}+|[^\p{L}\s]+"), F.lit(0))
    return F.transform(runs, lambda w: F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("int"))


def _numbers(values) -> Column:
    """A constant array of doubles, folded by the optimiser."""
    return F.split(F.lit(",".join("0" if x == 0 else repr(x) for x in values)), ",").cast("array<double>")


def _candidates(names: list[str], rows: list[list[float]]) -> Column:
    """A constant array of structs. It is kept out of the generated code, which is compiled once for all numbers."""
    flat = _numbers([x for row in rows for x in row])
    return F.transform(F.sequence(F.lit(0), F.lit(len(rows) - 1)), lambda c: F.struct(
        c.alias("try"), *[F.get(flat, c * len(names) + i).alias(n) for i, n in enumerate(names)]))


def _odds(ratios, words: Column) -> list[Column]:
    def total(row) -> Column:
        table = _numbers(row)
        return F.aggregate(words, F.lit(0.0), lambda s, b: s + F.get(table, b))
    return [total(row) for row in ratios]


def _softmax(scores: list[Column]) -> list[Column]:
    """Probabilities of 1 + len(scores) domains; the first has score 0."""
    high = F.greatest(F.lit(0.0), *scores) if scores else F.lit(0.0)
    parts = [F.exp(-high), *(F.exp(s - high) for s in scores)]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole + p
    return [p / whole for p in parts]


def quality_domains(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) of the labelled table: good, poor or toxic; of several labels the worst counts, nulls are left out."""
    known = labels.where("doc_id is not null and quality is not null and toxic is not null")
    return known.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic")).select(
        "doc_id", F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").otherwise("poor").alias("domain"))


def fit_domains(docs: DataFrame, labelled: DataFrame, names: tuple[str, ...], most: int = 1500, id_column: str = "doc_id",
                text_column: str = "text", smoothing: float = 1.0, sure: float = 4.0) -> Domains:
    """Word model of ``names`` from at most ``most`` labelled documents per domain (a bounded sample by a hash of the id).

    Only words whose share differs between a domain and the first by more than ``sure`` standard errors count. A third of
    the sample fits the temperatures and log odds that make them probabilities. Without labels all odds are even.
    """
    share = {r.domain: r.n for r in labelled.where(F.col("domain").isin(*names)).groupBy("domain").agg(F.count("*").alias("n")).collect()}
    order = Window.partitionBy("domain").orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id")
    picked = (labelled.where(F.col("domain").isin(*names)).withColumn("n", F.row_number().over(order)).where(F.col("n") <= most)
              .select(F.col("doc_id").alias("id"), "domain"))
    texts = (docs.where(F.col(text_column).isNotNull()).select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
             .join(F.broadcast(picked), "id")  # at most ``most`` ids per domain
             .groupBy("id", "domain").agg(F.min("text").alias("text")))
    sample = materialise(texts.select("domain", (F.pmod(F.xxhash64("id", F.lit(12)), F.lit(3)) == 2).alias("check"), _words(F.col("text")).alias("words")), "sample")
    counts = materialise(sample.where("not check").select("domain", F.explode("words").alias("bucket")).groupBy("bucket")
                         .agg(*[F.count(F.when(F.col("domain") == n, 1)).alias(f"n{i}") for i, n in enumerate(names)]), "words")
    totals = counts.agg(*[F.coalesce(F.sum(f"n{i}"), F.lit(0)) for i in range(len(names))]).first()
    ratios = []
    for i in range(1, len(names)):
        own, first = F.col(f"n{i}"), F.col("n0")
        all_own, all_first = totals[i] + 1, totals[0] + 1
        error = F.sqrt((own + first + smoothing) / (all_own + all_first) * (1 / all_own + 1 / all_first))
        telling = counts.where(F.abs(own / all_own - first / all_first) > sure * error).select(
            "bucket", F.round(F.log((own + smoothing) / all_own) - F.log((first + smoothing) / all_first), 4).alias("ratio"))
        row = [0.0] * BUCKETS
        for r in telling.collect():  # a row per telling bucket, at most BUCKETS
            row[r.bucket] = r.ratio
        ratios.append(tuple(row))
    ratios = tuple(ratios)
    seen = [share.get(n, 0) + 1.0 for n in names]
    prior = tuple(math.log(s / seen[0]) for s in seen[1:])
    scored = sample.where("check").select("domain", *[s.alias(f"s{i}") for i, s in enumerate(_odds(ratios, F.col("words")))])
    grid = [2.0 ** (i / 2) for i in range(0, 17)]
    heat, bias = [4.0] * len(ratios), list(prior)
    # a third of the bounded sample, a few numbers a row: fitted here, as a job for every number tried takes the driver far more memory
    rows = sorted(scored.collect())  # sorted here, as a shuffle would send the plan with its tables to the driver's listeners six times
    own = np.array([names.index(r.domain) for r in rows], dtype=int)
    odds = np.array([r[1:] for r in rows], dtype=float).reshape(len(rows), len(ratios))
    weights = np.array([share.get(n, 0) + 1.0 for n in names])[own]

    k = len(ratios)

    def loss_at(numbers: list[float]) -> float:
        z = np.column_stack([np.zeros(len(rows)), odds / np.array(numbers[:k]) + np.array(numbers[k:])])
        e = np.exp(z - z.max(axis=1, keepdims=True))
        chance = e[np.arange(len(rows)), own] / e.sum(axis=1)
        return float((-weights * np.log(np.maximum(chance, 1e-9))).mean())

    def best_of(at: int, values: list[float]) -> None:
        """Sets one number to that of ``values`` for which the odds fit the second sample best."""
        now = [*heat, *bias]
        if rows:
            now[at] = min((loss_at([*now[:at], v, *now[at + 1:]]), v) for v in values)[1]
            heat[:], bias[:] = now[:k], now[k:]

    for _ in range(3):  # one number after the other
        for i in range(k):
            best_of(i, grid)
            best_of(k + i, [prior[i] + x / 2 for x in range(-12, 7)])
    return Domains(names, ratios, tuple(bias), tuple(heat))


def _with_posteriors(docs: DataFrame, model: Domains, text_column: str) -> DataFrame:
    """docs with __mix_tokens (runs of letters and of signs) and __mix_p0, __mix_p1, ..."""
    read = docs.withColumn(_WORDS, _words(F.col(text_column)))
    odds = _odds(model.ratios, F.col(_WORDS))
    read = read.withColumn(_TOKENS, F.size(_WORDS).cast("long")).withColumns({f"__mix_s{i}": s for i, s in enumerate(odds)}).drop(_WORDS)
    scores = [F.col(f"__mix_s{i}") / model.temperatures[i] + model.prior[i] for i in range(len(odds))]
    return read.withColumns({f"__mix_p{i}": p for i, p in enumerate(_softmax(scores))}).drop(*[f"__mix_s{i}" for i in range(len(odds))])


def _replay(start: tuple[Column, Column], steps: list[tuple[float, list[float]]], rate: float, ridge: float) -> Column:
    """(r, before) after further steps, each a momentum and the domain residuals it saw."""
    size = len(steps[0][1])
    table = F.split(F.lit(",".join(repr(x) for momentum, res in steps for x in (momentum, *res))), ",").cast("array<double>")
    width = size + 1

    def step(s, k):
        at = k * width
        moved = s["r"] + F.get(table, at) * (s["r"] - s["before"])
        pull = ridge * (moved - 1.0)
        for d in range(size):
            pull = pull + F.col(f"__mix_p{d}") * F.get(table, at + 1 + d)
        return F.struct(F.greatest(F.lit(0.0), moved - rate * pull).alias("r"), s["r"].alias("before"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(len(steps) - 1)), F.struct(start[0].alias("r"), start[1].alias("before")), step)


@dataclass(frozen=True)
class Mixture:
    model: Domains
    steps: tuple[tuple[float, tuple[float, ...]], ...]
    rate: float
    ridge: float
    totals: tuple[float, ...]  # expected tokens by domain at the fitted rates
    wanted: tuple[float, ...]
    residuals: tuple[float, ...] = ()  # those the last step of size 1 / ridge saw

    def gaps(self) -> dict[str, float]:
        """What each domain's expected share of the budget lacks, or has too much."""
        whole = sum(self.wanted)
        return {n: (t - w) / whole if whole else 0.0 for n, t, w in zip(self.model.names, self.totals, self.wanted)}

    def rates(self) -> Column:
        if self.residuals:
            pull = sum((F.col(f"__mix_p{d}") * (x / self.ridge) for d, x in enumerate(self.residuals)), F.lit(0.0))
            return F.greatest(F.lit(0.0), 1.0 - pull)
        if not self.steps:
            return F.lit(1.0)
        return _replay((F.lit(1.0), F.lit(1.0)), [(m, list(r)) for m, r in self.steps], self.rate, self.ridge)["r"]


def fit_rates(docs: DataFrame, model: Domains, targets: dict[str, float], text_column: str = "text", ridge: float = 1e-3,
              most: int | None = None, close: float = 5e-4, written: int = 10) -> Mixture:
    """Projected gradient descent on half the squared gaps between expected and target domain shares.

    * gaps are taken relative to the target share; the budget is the token count of docs; the ridge, times each document's
      share, keeps rates near 1 where targets leave them free
    * descent goes on until it stands at the optimum, whatever the number of steps; targets that no rates meet leave gaps,
      see :meth:`Mixture.gaps`
    * with ``most``, so many plain steps with momentum are taken instead, or fewer if every gap falls below ``close`` of the
      budget; the state is written to the shared folder every ``written`` of them
    * targets without a positive weight count as even ones; null and empty texts weigh nothing; an empty table leaves all rates at 1
    """
    k = len(model.names)
    aim = [max(0.0, targets.get(n, 0.0)) for n in model.names]
    aim = [a / sum(aim) for a in aim] if sum(aim) else [1.0 / k] * k
    p = [f"__mix_p{d}" for d in range(k)]
    state = materialise(_with_posteriors(docs.select(text_column), model, text_column).where(F.col(_TOKENS) > 0)
                        .select(_TOKENS, *p, F.lit(1.0).alias("r"), F.lit(1.0).alias("before")), "mixing")
    budget = state.agg(F.sum(_TOKENS)).first()[0] or 0
    wanted = tuple(a * budget for a in aim)
    if not budget:
        return Mixture(model, (), 1.0, ridge, (0.0,) * k, wanted)
    scale = [1.0 / max(a, 1e-3) for a in aim]
    share = F.col(_TOKENS) / F.lit(float(budget))
    if most is None:
        return _settled(state, model, aim, scale, budget, ridge)
    steepest = state.agg(F.sum(sum((F.col(c) * F.col(c) * s for c, s in zip(p, scale)), F.lit(0.0)) * share)).first()[0]
    rate = 1.0 / (steepest + ridge)  # the sum of the eigenvalues bounds the largest
    steps: list[tuple[float, list[float]]] = []
    fresh = 0
    past = 1.0

    for n in range(most + 1):
        ahead = (1.0 + math.sqrt(1.0 + 4.0 * past * past)) / 2.0
        momentum = (past - 1.0) / ahead
        at = state.withColumn("__mix_s", _replay((F.col("r"), F.col("before")), steps[-fresh:], rate, ridge)) if fresh else (
            state.withColumn("__mix_s", F.struct("r", "before")))
        r, before = F.col("__mix_s")["r"], F.col("__mix_s")["before"]
        # read by a row's own index, it stays out of the generated code, which is then compiled once for all steps
        push = F.get(_numbers([momentum]), (F.col(_TOKENS) * 0).cast("int"))
        sums = at.agg(*[F.sum(r * F.col(c) * share) for c in p],
                      *[F.sum((r + push * (r - before)) * F.col(c) * share) for c in p]).first()
        now, seen = list(sums[:k]), list(sums[k:])
        if n == most or max(abs(a - b) for a, b in zip(now, aim)) < close:
            break
        steps.append((momentum, [(s - a) * w for s, a, w in zip(seen, aim, scale)]))
        past, fresh = ahead, fresh + 1
        if fresh == written:
            done = state.withColumn("__mix_s", _replay((F.col("r"), F.col("before")), steps[-fresh:], rate, ridge))
            state, fresh = materialise(done.select(_TOKENS, *p, F.col("__mix_s")["r"].alias("r"), F.col("__mix_s")["before"].alias("before")), "mixing"), 0
    return Mixture(model, tuple((m, tuple(r)) for m, r in steps), rate, ridge, tuple(x * budget for x in now), wanted)


def _settled(state: DataFrame, model: Domains, aim: list[float], scale: list[float], budget: int, ridge: float) -> Mixture:
    """Steps of size 1 / ridge until the residuals they see are those they leave; a job a step, all with one plan.

    The residuals minimise a convex function of as many numbers as there are domains; its slope is the difference between
    what a step saw and what it leaves. Of Newton steps of several lengths the best is taken, so every step goes down.
    """
    k = len(aim)
    names = [f"l{d}" for d in range(k)]
    p = [F.col(f"__mix_p{d}") for d in range(k)]
    share = F.col(_TOKENS) / F.lit(float(budget))
    r = F.greatest(F.lit(0.0), 1.0 - sum((p[d] * F.col(names[d]) for d in range(k)), F.lit(0.0)) / ridge)
    moments = [F.sum(share * F.col("r") * F.col("r")), *[F.sum(share * F.col("r") * p[d]) for d in range(k)],
               *[F.sum(F.when(F.col("r") > 0, share * p[d] * p[e]).otherwise(0.0)) for d in range(k) for e in range(d, k)]]

    def look(rows: list[list[float]]) -> list[tuple[float, list[float], np.ndarray, np.ndarray, np.ndarray]]:
        """(height, residuals, shares left, slope, curvature) of steps that saw some residuals, lowest first."""
        tried = state.withColumn("c", F.explode(_candidates(names, rows))).select(_TOKENS, *p, "c.*").withColumn("r", r)
        found = []
        for row in tried.groupBy("try").agg(*[m.alias(f"m{i}") for i, m in enumerate(moments)]).collect():
            at, numbers = np.array(rows[row["try"]]), np.array([row[f"m{i}"] for i in range(len(moments))])
            left, bend = numbers[1:k + 1], np.diag(1.0 / np.array(scale))
            for n, (d, e) in enumerate((d, e) for d in range(k) for e in range(d, k)):
                bend[d, e] += numbers[1 + k + n] / ridge
                bend[e, d] = bend[d, e]
            height = float((at * at / scale).sum() / 2 + (at * aim).sum() + ridge * numbers[0] / 2)
            found.append((height, rows[row["try"]], left, at / scale + aim - left, bend))
        return sorted(found, key=lambda x: x[0])

    now = look([[0.0] * k])[0]
    while True:
        step = np.linalg.solve(now[4], now[3])
        if float(step @ now[3]) < 1e-13:  # what Newton's rule still promises
            break
        best = look([(np.array(now[1]) - t * step).tolist() for t in (1.0, 0.5, 0.25, 0.05, 0.005)])[0]
        if best[0] >= now[0]:  # as low as doubles go
            break
        now = best
    return Mixture(model, (), 1.0 / ridge, ridge, tuple(float(x) * budget for x in now[2]), tuple(a * budget for a in aim), tuple(now[1]))


def apply_rates(docs: DataFrame, mixture: Mixture, text_column: str = "text") -> DataFrame:
    """docs with n_words, one p_<domain> per domain, and rate.

    * one row per row of docs, in no order; repeated rows get equal rates; columns of these names are replaced
    * null texts and texts without letters or signs have no words: their posteriors are the prior, their rate is what the
      same replay gives, and they weigh nothing in the fit
    * texts of any length are read whole; without labels posteriors are even odds; an empty table gives an empty result
    """
    names = mixture.model.names
    out = ["n_words", *(f"p_{n}" for n in names), "rate"]
    scored = _with_posteriors(docs.drop(*out), mixture.model, text_column)
    return (scored.withColumn(_RATE, mixture.rates())
            .withColumns({"n_words": F.col(_TOKENS), **{f"p_{n}": F.col(f"__mix_p{i}") for i, n in enumerate(names)}, "rate": F.col(_RATE)})
            .drop(_TOKENS, _RATE, *[f"__mix_p{i}" for i in range(len(names))]))


def copies(rate: Column, *key: Column) -> Column:
    """Whole copies of a document: the rate rounded up with the probability of its fraction, by a hash of the key."""
    dice = F.pmod(F.xxhash64(*key, F.lit(13)), F.lit(1_000_003)) / 1_000_003
    return F.floor(rate + dice).cast("int")


# Target weights of the registered query and the pipeline.
TARGETS = {"good": 0.86, "poor": 0.08, "toxic": 0.06}


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """docs with posteriors and fitted rates; see :func:`fit_domains`, :func:`fit_rates` and :func:`apply_rates`."""
    model = fit_domains(docs, quality_domains(labels), tuple(targets), id_column=id_column, text_column=text_column)
    return apply_rates(docs, fit_rates(docs, model, targets, text_column), text_column)


def op8_source_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return mix(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).drop("text")
