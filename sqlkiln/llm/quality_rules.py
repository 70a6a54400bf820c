"""Quality rules with risk-controlled thresholds, in DataFrame operations
only: for every stratum and rule, labelled holdouts and exact binomial bounds
pick a cutoff whose rate of rejected good documents is provably limited."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from sqlkiln.llm.common import NOT_SPACE, words
from sqlkiln.session import broadcast_if_small, materialize

SYMBOLS = "#*$%&|<>"
WINDOW = 5
# A text fails the base rule below so many words, or above this percentage of
# words in repeated windows.
LEAST_WORDS, MOST_REPEATED = 10, 20
# Good documents wrongly rejected: at most this share of a stratum over all
# rules, with this chance of any guarantee failing anywhere.
RISK, ERROR = 0.05, 0.05
# A rejected good document weighs as much as so many bad ones let through,
# both as shares of their class.
GOOD_WEIGHT = 20.0
MOST_TERMS = 100_000


@dataclass(frozen=True)
class Rule:
    """Reject a text whose ``value`` exceeds a cutoff; the cutoffs are fixed
    beforehand and tried from the mildest."""

    name: str
    value: str
    cutoffs: tuple[float, ...]


RULES = (
    Rule("symbols", "n_symbols / greatest(n_words, 1)", (2.0, 1.0, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1, 0.05)),
    Rule("exclaims", "n_exclaims / greatest(n_words, 1)", (1.0, 0.75, 0.5, 0.35, 0.25, 0.15, 0.1)),
    Rule("dup_lines", "n_dup_lines / greatest(n_lines, 1)", (0.9, 0.8, 0.7, 0.6, 0.5, 0.45, 0.4, 0.35, 0.3, 0.25)),
    Rule("repeats", "n_repeat_words / greatest(n_words, 1)", (0.19, 0.17, 0.15, 0.13, 0.11, 0.09, 0.07)),
    Rule("word_length", "word_chars / greatest(n_words, 1)", (20.0, 15.0, 12.0, 10.0, 9.0, 8.5, 8.0, 7.5, 7.0)),
)


def _count(text: Column, symbols: str) -> Column:
    left = text
    for c in symbols:
        left = F.replace(left, F.lit(c), F.lit(""))
    return (F.octet_length(text) - F.octet_length(left)).cast("long")


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """Counts of every whole text: ``id, stratum, n_words, word_chars,
    n_symbols, n_dup_lines, n_repeat_words, n_lines, n_exclaims``.

    A null or empty text counts zero throughout; a null stratum is ``und``.
    ``n_lines`` are lines with a word, and ``n_dup_lines`` those equal to an
    earlier one. ``n_repeat_words`` are the words inside five-word windows
    that occur twice or more: windows are compared by a 64-bit hash of their
    words' 64-bit hashes, sorted with their places, and the places of those
    with an equal neighbour are merged. All of it is local to a row, so the
    cost of a text does not depend on how often its words occur elsewhere."""
    text = F.col("text")
    base = docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(stratum_col).cast("string"), F.lit("und")).alias("stratum"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    base = base.withColumn("w", words(text)).withColumn(
        "lines", F.filter(F.split(text, "\n"), lambda x: x.rlike(NOT_SPACE)))
    counted = base.select(
        "id", "stratum", F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"), _count(text, SYMBOLS).alias("n_symbols"),
        _count(text, "!").alias("n_exclaims"), F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("w", lambda x: F.xxhash64(x)).alias("h"))
    key = F.transform("h", lambda x, i: F.xxhash64(x, *[F.get("h", i + k) for k in range(1, WINDOW)]))
    keyed = counted.withColumn("keys", F.slice(key, 1, F.greatest(F.size("h") - (WINDOW - 1), F.lit(0)))).drop("h")
    repeated = F.size("keys") > F.size(F.array_distinct("keys"))
    ranked = keyed.withColumn("ranked", F.when(repeated, F.array_sort(
        F.transform("keys", lambda x, i: F.struct(x.alias("key"), i.alias("at")))))).drop("keys")
    near = F.filter("ranked", lambda x, j: (x["key"] == F.get("ranked", j + 1)["key"]) | (
        (j > 0) & (x["key"] == F.get("ranked", F.greatest(j - 1, F.lit(0)))["key"])))
    placed = ranked.withColumn("places", F.sort_array(F.transform(near, lambda x: x["at"]))).drop("ranked")
    covered = F.aggregate(F.transform("places", lambda p, j: F.least(
        F.lit(WINDOW), F.coalesce(F.get("places", j + 1) - p, F.lit(WINDOW)))), F.lit(0).cast("long"), lambda a, x: a + x)
    return placed.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop("places")


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def _log_factorial(n: Column) -> Column:
    x = n.cast("double")
    series = x * F.log(x) - x + 0.5 * F.log(2 * F.pi() * x) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)
    return F.when(n < 15, F.log(F.factorial(F.least(n, F.lit(20)).cast("int")).cast("double"))).otherwise(series)


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X ~ Binomial(n, p), summed exactly from k downwards;
    from the mean up it is given as 1. Beyond ``MOST_TERMS`` terms the rest
    is bounded from above by its geometric series, so that the value is never
    too small."""
    top = _log_factorial(n) - _log_factorial(k) - _log_factorial(n - k) + k * F.log(F.lit(p)) + (n - k) * F.log1p(F.lit(-p))
    start = F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("total"))

    def step(acc: Column, j: Column) -> Column:
        at = k - j
        ratio = at * (1 - p) / ((n - at + 1) * p)
        return F.struct((acc["term"] * ratio).alias("term"), (acc["total"] + acc["term"]).alias("total"))

    last = F.least(k, F.lit(MOST_TERMS).cast("long"))
    ended = F.aggregate(F.sequence(F.lit(0).cast("long"), last), start, step)
    ratio = (k - last) * (1 - p) / ((n - k + last + 1) * p)
    rest = F.when(k > last, ended["term"] / (1 - ratio)).otherwise(0.0)
    return F.when(n <= 0, 1.0).when(k >= n * p, 1.0).otherwise(F.least(F.lit(1.0), F.exp(top) * (ended["total"] + rest)))


def cutoffs(counts: DataFrame, labels: DataFrame, label_id: str = "doc_id", label_col: str = "quality",
            rules: tuple[Rule, ...] = RULES, risk: float = RISK, error: float = ERROR) -> DataFrame:
    """``(stratum, good, bad, <rule> ...)``: one row per stratum that has
    labelled documents, with every rule's cutoff (null: none is safe and
    worth it).

    For each stratum and rule, the cutoffs are tested from the mildest: is
    the rate at which good documents exceed it above ``risk`` over the number
    of rules? The p-value is the exact binomial tail of the rejected good
    documents of the holdout. Testing stops at the first cutoff that is not
    shown safe at level ``error`` over the number of strata and rules
    (fixed-sequence tests inside a rule, Bonferroni across), so with
    probability 1 - ``error`` no stratum loses more than ``risk`` of its good
    documents. Of the safe cutoffs, the one that rejects most of the bad and
    least of the good is taken. Documents that fail the base rule take no
    part. A document with several labels counts as bad if any of them is."""
    each = labels.select(F.col(label_id).alias("key"), F.col(label_col).alias("label")).where(
        "key is not null and label is not null").groupBy("key").agg((F.min("label") > 0).alias("good"))
    # A flag and not a filter: Spark would push a filter below the counts
    # that it reads, and work them out anew for it.
    tested = counts.withColumn("part", ~base_failed()).join(each, F.col("id") == F.col("key"))
    over = {(r.name, j): F.expr(r.value) > c for r in rules for j, c in enumerate(r.cutoffs)}
    good, bad = F.col("part") & F.col("good"), F.col("part") & ~F.col("good")
    sums = [F.count_if(good).alias("good"), F.count_if(bad).alias("bad")]
    sums += [F.count_if(x & good).alias(f"{n}_{j}_good") for (n, j), x in over.items()]
    sums += [F.count_if(x & bad).alias(f"{n}_{j}_bad") for (n, j), x in over.items()]
    held = materialize(tested.groupBy("stratum").agg(*sums))
    tests = max(1, held.count()) * len(rules)
    rows = [F.struct(F.lit(r.name).alias("rule"), F.lit(j).alias("nth"), F.lit(float(c)).alias("cutoff"),
                     F.col(f"{r.name}_{j}_good").alias("k"), F.col(f"{r.name}_{j}_bad").alias("hits"))
            for r in rules for j, c in enumerate(r.cutoffs)]
    table = held.select("stratum", "good", "bad", F.explode(F.array(*rows)).alias("t")).select(
        "stratum", "good", "bad", "t.*")
    table = table.withColumn("p", binomial_tail(F.col("k"), F.col("good"), risk / len(rules)))
    table = table.withColumn("safe", F.col("p") <= error / tests)
    gain = F.col("hits") / F.greatest("bad", F.lit(1)) - GOOD_WEIGHT * F.col("k") / F.greatest("good", F.lit(1))
    stop = table.groupBy("stratum", "rule").agg(
        F.coalesce(F.min(F.when(~F.col("safe"), F.col("nth"))), F.lit(1 << 30)).alias("stop"))
    best = table.withColumn("gain", gain).join(F.broadcast(stop), ["stratum", "rule"]).where("nth < stop and gain > 0")
    best = best.groupBy("stratum", "rule").agg(F.max(F.struct("gain", "cutoff")).alias("best"))
    wide = best.groupBy("stratum").agg(*[
        F.max(F.when(F.col("rule") == r.name, F.col("best.cutoff"))).alias(f"cut_{r.name}") for r in rules])
    return held.select("stratum", "good", "bad").join(wide, "stratum", "left")


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang",
          label_id: str = "doc_id", label_col: str = "quality", rules: tuple[Rule, ...] = RULES,
          risk: float = RISK, error: float = ERROR) -> DataFrame:
    """The counts of ``features``, ``base_failed``, one ``over_<rule>`` per
    rule and ``kept``: neither the base rule nor any rule with a safe cutoff
    rejects the text. Strata without labels are judged by the base rule
    alone. Rows are kept one for one. Only the counts are shuffled, never a
    text; the cutoff table has one row per stratum and is broadcast when
    measured small."""
    counts = materialize(features(docs, id_col, text_col, stratum_col))
    table = broadcast_if_small(cutoffs(counts, labels, label_id, label_col, rules, risk, error).drop("good", "bad"))
    joined = counts.withColumn("base_failed", base_failed()).join(table, "stratum", "left")
    for r in rules:
        joined = joined.withColumn(f"over_{r.name}", F.coalesce(F.expr(r.value) > F.col(f"cut_{r.name}"), F.lit(False)))
    any_over = F.greatest(*[F.col(f"over_{r.name}") for r in rules])
    return joined.withColumn("kept", ~F.col("base_failed") & ~any_over)
