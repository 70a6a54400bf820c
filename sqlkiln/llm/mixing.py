"""Mixing documents to domain targets by soft membership, in DataFrame
operations only: a classifier learned from a labelled table gives every
document a posterior over domains, and projected-gradient least squares fits
nonnegative document rates whose expected domain tokens meet the targets."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from sqlkiln.llm.common import unused_name, words
from sqlkiln.session import broadcast_if_small, materialize

# Words hash into so many buckets.
BUCKETS = 1 << 16
# The classifier is fitted on about so many labelled documents at most.
SAMPLE_DOCS = 20_000
# A bucket counts when its log rates in two domains differ by so many standard
# errors and by so much; all other buckets are one.
EVIDENCE, EFFECT = 4.5, 1.5
TEMPERATURES = tuple(2.0 ** -k for k in range(0, 9))
STEPS, TOLERANCE, STEP_SIZE = 60, 2e-3, 0.9
SYMBOLS = "#*$%&|<>"
# Levels of the three shape features: symbols a word, exclamation marks a
# word, and length by share of distinct words.
LEVELS = (9, 9, 16 * 6)


@dataclass
class Domains:
    """Naive Bayes against the first domain: log odds of distinct word
    buckets and of shape levels, flattened by a temperature, over a prior.
    ``weights`` has a domain's odds of all other buckets, then those of
    ``buckets`` in turn."""

    names: list[str]
    prior: list[float]
    buckets: list[int]
    weights: list[list[float]]
    shapes: list[list[list[float]]]
    temperature: float = 1.0


def label_domain(quality: Column, toxic: Column) -> Column:
    """The domain of a labelled document."""
    return F.when(toxic == 1, "toxic").when(quality == 0, "low").when(quality == 1, "good")


def _dropped(text: Column, symbols: str) -> Column:
    """How often ASCII symbols occur in a text."""
    left = text
    for c in symbols:
        left = F.replace(left, F.lit(c))
    return F.octet_length(text) - F.octet_length(left)


def features(docs: DataFrame, text_col: str, tokens: str, found: str, shape: str) -> DataFrame:
    """``docs`` with its token count (words plus one, a double), the distinct
    buckets of its words (case kept) and its three shape levels."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    raw = docs.withColumn(found, words(text))
    size = F.greatest(F.size(found), F.lit(1))
    signs = [F.least(F.lit(8), F.floor(4 * _dropped(text, s) / size)).cast("int") for s in (SYMBOLS, "!")]
    raw = raw.withColumn(tokens, (F.size(found) + 1).cast("double")).withColumn(shape, F.array(*signs))
    hashed = F.transform(F.col(found), lambda w: F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("int"))
    raw = raw.withColumn(found, F.array_distinct(hashed))
    length = F.least(F.lit(15), F.floor(F.log2(F.col(tokens)))) * 6
    variety = F.floor(5 * F.size(found) / F.col(tokens))
    return raw.withColumn(shape, F.concat(F.col(shape), F.array((length + variety).cast("int"))))


def _numbers(values: list[float]) -> Column:
    """A constant array, read from one string so that plans stay short."""
    return F.split(F.lit(",".join(f"{v:.5g}" for v in values)), ",").cast("array<double>")


def _places(buckets: list[int]) -> Column:
    """By bucket, its place in ``weights`` (0: all others)."""
    places = ["0"] * BUCKETS
    for nth, b in enumerate(buckets, 1):
        places[b] = str(nth)
    return F.split(F.lit(",".join(places)), ",").cast("array<int>")


def _total(found: Column, places: Column, table: Column) -> Column:
    return F.aggregate(found, F.lit(0.0), lambda acc, b: acc + F.get(table, F.get(places, b)))


def evidence(found: Column, shape: Column, model: Domains) -> list[Column]:
    """Per domain, the log likelihood ratio against the first one."""
    out, places = [F.lit(0.0)], _places(model.buckets)
    for d in range(1, len(model.names)):
        odds = _total(found, places, _numbers(model.weights[d]))
        for j, levels in enumerate(model.shapes[d]):
            odds = odds + F.get(_numbers(levels), F.get(shape, F.lit(j)))
        out.append(odds)
    return out


def posterior(odds: list[Column], prior: list[float], temperature: float) -> list[Column]:
    scaled = [o * F.lit(temperature) + F.lit(float(p)) for o, p in zip(odds, prior)]
    top = F.greatest(*scaled) if len(scaled) > 1 else scaled[0]
    weight = [F.exp(s - top) for s in scaled]
    total = sum(weight[1:], weight[0])
    return [w / total for w in weight]


def labelled(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             label_id: str = "doc_id", sample: int = SAMPLE_DOCS) -> DataFrame:
    """``(domain, found, shape)`` of the labelled sample: about ``sample``
    labelled documents picked by a hash of their id (all when there are
    fewer). A document with several labels takes the first domain by name."""
    each = labels.select(F.col(label_id).alias("key"), label_domain(F.col("quality"), F.col("toxic")).alias("domain"))
    each = each.where("key is not null and domain is not null").groupBy("key").agg(F.min("domain").alias("domain"))
    share = min(1.0, sample / max(1, each.count()))
    unit = F.pmod(F.xxhash64(F.col("key").cast("string"), F.lit("mixing")), F.lit(1 << 30)) / float(1 << 30)
    drawn = broadcast_if_small(each.where(unit < share))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("body"))
    joined = texts.join(drawn, F.col("id") == F.col("key")).select("domain", "body")
    return features(joined, "body", "tokens", "found", "shape").select("domain", "found", "shape")


def fit_domains(sample: DataFrame) -> Domains | None:
    """The classifier and its temperature (the one with the least log loss on
    the half of the sample that the counts of a first model have not seen,
    all tried in one pass). The driver gets the counts of the buckets that
    matter, of which there are at most ``BUCKETS``."""
    rows = materialize(sample.withColumn("part", F.pmod(F.xxhash64("found"), F.lit(2))))
    each = rows.groupBy("domain", "part").agg(F.count(F.lit(1)).alias("docs"), F.sum(F.size("found")).alias("words"))
    sizes = each.collect()
    if not sizes:
        return None
    names = sorted({r["domain"] for r in sizes})
    counted = rows.select("domain", "part", F.explode("found").alias("bucket")).groupBy("bucket").agg(*[
        F.count_if((F.col("domain") == n) & (F.col("part") == p)).alias(f"n{i}_{p}")
        for i, n in enumerate(names) for p in (0, 1)])
    counted = materialize(counted)
    levels = rows.select("domain", "part", F.posexplode("shape").alias("nth", "level"))
    levels = levels.groupBy("domain", "part", "nth", "level").count().collect()
    half = _naive_bayes(names, sizes, counted, levels, (0,))
    model = _naive_bayes(names, sizes, counted, levels, (0, 1))
    odds = evidence(F.col("found"), F.col("shape"), half)
    right = rows.where("part = 1").select("domain", F.array(*odds).alias("odds"))
    own = [F.get(F.col("odds"), F.lit(i)) for i in range(len(names))]
    losses = []
    for t in TEMPERATURES:
        p = posterior(own, half.prior, t)
        true = F.coalesce(*[F.when(F.col("domain") == n, p[i]) for i, n in enumerate(names)])
        losses.append(F.avg(-F.log(F.greatest(true, F.lit(1e-12)))).alias(f"t{len(losses)}"))
    loss = right.agg(*losses).collect()[0]
    best = min(range(len(TEMPERATURES)), key=lambda i: (loss[i] if loss[i] is not None else 0.0, i))
    model.temperature = TEMPERATURES[best]
    return model


def _naive_bayes(names: list[str], sizes: list, counted: DataFrame, levels: list, parts: tuple[int, ...]) -> Domains:
    k = len(names)
    docs, total = [0] * k, [1.0] * k
    for r in sizes:
        if r["part"] in parts:
            docs[names.index(r["domain"])] += r["docs"]
            total[names.index(r["domain"])] += r["words"]
    n = [sum(F.col(f"n{i}_{p}") for p in parts) + 0.5 for i in range(k)]
    far = [F.abs(F.log(n[i] / total[i]) - F.log(n[0] / total[0])) > F.greatest(
        F.lit(EFFECT), EVIDENCE * F.sqrt(1 / n[i] + 1 / n[0])) for i in range(1, k)]
    kept = counted.select("bucket", *[c.alias(f"n{i}") for i, c in enumerate(n)], F.greatest(F.lit(False), F.lit(False), *far)
                          .alias("far")).where("far").collect() if far else []
    rest = [max(1e-9, 1 - sum(r[f"n{i}"] for r in kept) / total[i]) for i in range(k)]
    weights = [[math.log(rest[i] / rest[0])] + [math.log(r[f"n{i}"] / total[i]) - math.log(r["n0"] / total[0]) for r in kept]
               for i in range(k)]
    shapes = [[[0.0] * size for size in LEVELS] for _ in names]
    seen = [[[1.0] * size for size in LEVELS] for _ in names]
    for r in levels:
        if r["part"] in parts:
            seen[names.index(r["domain"])][r["nth"]][r["level"]] += r["count"]
    for i in range(k):
        for j in range(len(LEVELS)):
            own, base = sum(seen[i][j]), sum(seen[0][j])
            shapes[i][j] = [math.log(x / own) - math.log(y / base) for x, y in zip(seen[i][j], seen[0][j])]
    prior = [math.log((d + 1) / (docs[0] + 1)) for d in docs]
    return Domains(names, prior, [r["bucket"] for r in kept], weights, shapes)


def with_membership(docs: DataFrame, model: Domains, text_col: str, tokens: str, member: str) -> DataFrame:
    """``docs`` with its token count and its posterior over ``model.names``.
    Null and blank texts have one token and the posterior of a text without
    words."""
    found, shape = unused_name(docs, "found"), unused_name(docs, "shape")
    scored = features(docs, text_col, tokens, found, shape)
    scored = scored.withColumn(found, F.array(*evidence(F.col(found), F.col(shape), model)))
    odds = [F.get(F.col(found), F.lit(i)) for i in range(len(model.names))]
    return scored.withColumn(member, F.array(*posterior(odds, model.prior, model.temperature))).drop(found, shape)


@dataclass
class Fit:
    """The rates as a row-local function of a posterior: the gradients of
    every step, applied in turn with projection onto ``lower`` or more."""

    steps: list[list[float]]
    lower: float
    domains: list[str]
    target: list[float]
    natural: list[float]
    reached: list[float]

    def rate(self, member: Column) -> Column:
        if not self.steps:
            return F.lit(1.0)
        moves = F.expr(f"array({','.join('array(' + ','.join(f'{g!r}D' for g in s) + ')' for s in self.steps)})")
        step = lambda r, g: F.greatest(F.lit(self.lower), r - _dot(member, g, len(self.domains)))
        return F.aggregate(moves, F.lit(1.0), step)


def _dot(member: Column, vector: Column | list[float], k: int) -> Column:
    parts = [F.get(member, F.lit(i)) * (F.lit(vector[i]) if isinstance(vector, list) else F.get(vector, F.lit(i)))
             for i in range(k)]
    return sum(parts[1:], parts[0])


def fit_rates(members: DataFrame, domains: list[str], weights: dict[str, float], budget: float | None = None,
              lower: float = 0.0, steps: int = STEPS) -> Fit:
    """Least squares on ``sum_i rate_i tokens_i posterior_i[d] = budget *
    weight_d``, each domain's error relative to its size, over rates of at
    least ``lower`` and starting from rate 1, by projected gradient in the
    metric in which a token of any document costs the same. A domain that no
    document belongs to has no say, and the other weights are scaled to it.

    It ends at the targets, or when a step no longer lowers the squared error
    (targets that the posteriors cannot express are met as nearly as they
    can). ``members`` holds ``tokens`` and ``member``. Every step is one aggregate
    with one number per domain to the driver; the rates follow from the
    history of those numbers, so nothing per document is ever stored."""
    k = len(domains)
    total = F.sum("tokens").alias("total")
    share = [F.sum(F.col("tokens") * F.get("member", F.lit(d))).alias(f"d{d}") for d in range(k)]
    row = members.agg(total, *share).collect()[0]
    if not row["total"]:
        return Fit([], lower, domains, [0.0] * k, [0.0] * k, [0.0] * k)
    natural = [float(row[f"d{d}"]) for d in range(k)]
    live = [natural[d] > 1e-9 * row["total"] for d in range(k)]
    asked = [max(0.0, weights.get(n, 0.0)) * live[d] for d, n in enumerate(domains)]
    scale = sum(asked) or 1.0
    if budget is None:
        budget = float(row["total"])
    target = [budget * a / scale for a in asked]
    state, fit = members.withColumn("rate", F.lit(1.0)), Fit([], lower, domains, target, natural, natural)
    reached = natural
    before = math.inf
    for n in range(steps):
        error = sum((reached[d] - target[d]) ** 2 / natural[d] for d in range(k) if live[d])
        if error > (1 - TOLERANCE) * before:
            break
        before = error
        miss = [(reached[d] - target[d]) / natural[d] if live[d] else 0.0 for d in range(k)]
        if max(abs(reached[d] - target[d]) for d in range(k)) <= TOLERANCE * budget:
            break
        move = [STEP_SIZE * m for m in miss]
        fit.steps.append(move)
        state = state.withColumn("rate", F.greatest(F.lit(float(lower)), F.col("rate") - _dot(F.col("member"), move, k)))
        if n % 8 == 7:
            state = materialize(state)
        got = state.agg(*[F.sum(F.col("rate") * F.col("tokens") * F.get("member", F.lit(d))).alias(f"d{d}")
                          for d in range(k)]).collect()[0]
        reached = [float(got[f"d{d}"]) for d in range(k)]
        fit.reached = reached
    return fit


def copies(rate: Column, key: Column, seed: str = "mix") -> Column:
    """How often a row appears: the whole part of its rate, and once more
    with the fraction as probability, decided by a hash of its key."""
    unit = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
    return (F.floor(rate) + F.when(unit < rate - F.floor(rate), 1).otherwise(0)).cast("int")


def rates(docs: DataFrame, labels: DataFrame, weights: dict[str, float], budget: float | None = None,
          keep_whole: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, Fit | None]:
    """``(id, key, tokens, member, rate, copies)`` per row of ``docs``, and
    the fit. ``keep_whole`` names a domain whose natural tokens are to stay as
    they are: the budget follows from its weight. Without any labelled row the
    rates are 1. Null ids are hashed by their text; repeated rows share a
    fate; an empty table gives no rows."""
    model = fit_domains(labelled(docs, labels, id_col, text_col))
    bare = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("body"))
    bare = bare.withColumn("key", _key(F.col("id"), F.col("body")))
    if model is None:
        flat = bare.select("id", "key", (F.size(words(F.col("body"))) + 1).cast("double").alias("tokens"),
                           F.array().cast("array<double>").alias("member"), F.lit(1.0).alias("rate"))
        return flat.withColumn("copies", F.lit(1)), None
    members = with_membership(bare, model, "body", "tokens", "member").select("id", "key", "tokens", "member")
    members = materialize(members)
    if keep_whole in model.names and budget is None:
        held = members.agg(F.sum(F.col("tokens") * F.get("member", F.lit(model.names.index(keep_whole))))).collect()[0][0]
        asked = sum(max(0.0, weights.get(n, 0.0)) for n in model.names)
        budget = float(held or 0.0) * asked / weights[keep_whole]
    fit = fit_rates(members, model.names, weights, budget)
    rated = members.withColumn("rate", fit.rate(F.col("member")))
    return rated.withColumn("copies", copies(F.col("rate"), F.col("key"))), fit


def _key(row_id: Column, text: Column) -> Column:
    return F.xxhash64(F.coalesce(row_id.cast("string"), F.lit("")), F.coalesce(text, F.lit("")))


def mix(docs: DataFrame, labels: DataFrame, weights: dict[str, float], keep_whole: str | None = None,
        id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The mixture itself: each row of ``docs`` as often as its rate says,
    columns unchanged."""
    rated, fit = rates(docs, labels, weights, None, keep_whole, id_col, text_col)
    if fit is None:
        return docs
    mine, of, times, nth = (unused_name(docs, n) for n in ("row_key", "of_key", "times", "nth_copy"))
    changed = rated.where("copies <> 1").groupBy(F.col("key").alias(of)).agg(F.max("copies").alias(times))
    keyed = docs.withColumn(mine, _key(F.col(id_col), F.col(text_col).cast("string")))
    joined = keyed.join(materialize(changed), F.col(mine) == F.col(of), "left")
    joined = joined.withColumn(times, F.coalesce(F.col(times), F.lit(1))).where(F.col(times) > 0)
    every = joined.withColumn(nth, F.explode(F.sequence(F.lit(1), F.col(times))))
    return every.select(*[F.col(f"`{c}`") for c in docs.columns])
