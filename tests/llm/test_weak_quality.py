"""op4 against a plain version: votes, expectation-maximisation and the
hashed scorer, word by word, and values for odd texts."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from sqlkiln.llm import queries, weak_quality
from sqlkiln.llm.common import table

SF = "/root/testdata/sf0.001"


def kind(b):
    return "A" if 65 <= b <= 90 else "a" if 97 <= b <= 122 or b > 127 else "0" if 48 <= b <= 57 else chr(b)


def plain_look(text):
    """Words as bytes, their shapes with runs folded, lines with a word."""
    data = (text or "").encode()
    words = [w for w in re.split(rb"[\x20\x09-\x0d]+", data) if w]
    shapes = [re.sub(r"(.)\1+", r"\1", "".join(map(kind, w)), flags=re.S) for w in words]
    lines = [x for x in data.split(b"\n") if re.search(rb"[^\x20\x09-\x0d]", x)]
    return data, words, shapes, lines


def plain_votes(text):
    data, words, shapes, lines = plain_look(text)
    n, real = max(len(words), 1), len(words)
    letters = sum(kind(b) in "Aa" for b in data)
    capitals, symbols = sum(kind(b) == "A" for b in data), sum(b in b"#*$%&|<>@^~=_" for b in data)
    top, variety, chars = max(Counter(words).values(), default=0) / n, len(set(words)) / n, sum(map(len, words)) / n
    stops = sum(s[-1] in ".!?" for s in shapes)
    bare = sum("A" not in s and "a" not in s for s in shapes)
    odd = sum(s[-1] not in "aA0.,!?;:)'\"" for s in shapes)
    loud = sum("A" in s and "a" not in s for s in shapes)
    long_ = real >= 50
    rules = [(real < 5, long_), (symbols > 0.1 * n, symbols < 0.01 * n and real > 0),
             (capitals > 0.3 * max(letters, 1), capitals < 0.1 * letters),
             (len(lines) - len(set(lines)) > 0.3 * len(lines), len(lines) >= 3 and len(lines) == len(set(lines))),
             (long_ and variety < 0.2, variety > 0.3), (real > 0 and not 2.5 <= chars <= 7.5, 3.5 <= chars <= 6.5),
             (long_ and top > 0.25, real >= 20 and top < 0.15), (long_ and (stops == 0 or stops > 0.5 * n), 0.02 * n <= stops <= 0.35 * n),
             (bare > 0.2 * n, 0 < real and bare < 0.05 * n), (odd > 0.2 * n, 0 < real and odd < 0.05 * n),
             (long_ and loud > 0.4 * n, real >= 20 and loud < 0.1 * n)]
    return tuple(0 if bad else 2 if good else 1 for bad, good in rules)


def plain_em(ballots):
    """EM over single documents, probabilities in plain lists."""
    k = len(ballots[0])
    table, good = [{0: {0: 0.6, 2: 0.4}, 1: {0: 0.1, 2: 0.9}} for _ in range(k)], 0.8
    seen, before = Counter(ballots), None

    def posterior(b):
        odds = [1 - good, good]
        for j, v in enumerate(b):
            if v != 1:
                odds = [odds[c] * table[j][c][v] for c in (0, 1)]
        return odds[1] / sum(odds)

    for _ in range(weak_quality.EM_ROUNDS):
        post = {b: posterior(b) for b in seen}
        for j in range(k):
            for c in (0, 1):
                votes = {v: 1 + sum(n * (post[b] if c else 1 - post[b]) for b, n in seen.items() if b[j] == v) for v in (0, 2)}
                table[j][c] = {v: x / sum(votes.values()) for v, x in votes.items()}
        good = (sum(n * post[b] for b, n in seen.items()) + 1) / (sum(seen.values()) + 2)
        if before and max(abs(post[b] - before[b]) for b in seen) < 1e-9:
            break
        before = post
    return {b: posterior(b) for b in seen}


def plain_score(model, text):
    data, words, shapes, lines = plain_look(text)
    n = max(len(words), 1)
    symbols = sum(b in b"#*$%&|<>@^~=_" for b in data)
    line = model.bias
    for mark, found in ((b"w", Counter(words)), (b"s", Counter(s.encode("latin-1") for s in shapes))):
        for key, c in found.items():
            line += math.sqrt(c / n) * model.weights[zlib.crc32(mark + key) % weak_quality.BUCKETS]
    bands = {"n": min(12, len(words).bit_length()), "v": 10 * len(set(words)) // n, "t": 10 * max(Counter(words).values(), default=0) // n,
             "d": 10 * len(set(lines)) // max(len(lines), 1), "l": min(20, sum(map(len, words)) // n), "s": min(20, 10 * symbols // n)}
    for key, v in bands.items():
        line += 6**-0.5 * model.weights[zlib.crc32(f"{key}{v}".encode()) % weak_quality.BUCKETS]
    return 1 / (1 + math.exp(-max(-30, min(30, line))))


def test_op4_against_a_plain_version(spark):
    docs = table(spark, SF, "documents")
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    ballots = {i: plain_votes(t) for i, t in texts.items()}
    post = plain_em(list(ballots.values()))
    model = weak_quality.fit(docs)
    got = {r["doc_id"]: r for r in queries.op4_quality_classifier(spark, SF).collect()}
    assert got.keys() == texts.keys()
    for i, r in got.items():
        assert r["ballot"] == "".join(map(str, ballots[i]))
        assert r["weak"] == pytest.approx(post[ballots[i]], abs=1e-6)
        assert r["score"] == pytest.approx(plain_score(model, texts[i]), abs=1e-5)
        assert r["kept"] == (r["score"] >= 0.5)


def test_odd_texts_have_these_values(spark):
    model = weak_quality.fit(table(spark, SF, "documents"))
    long_text = "Some words of a long text, line by line.\n" * 40_000
    odd = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, " \n\t", "x"), (4, long_text, "x"), (4, long_text, "x"), (None, "### $$$", "x")],
                                "doc_id long, text string, ballot string")
    got = [tuple(r) for r in weak_quality.score(odd, model).select("id", "score", "ballot").collect()]
    assert len(got) == 6
    for i, score, ballot in got:
        text = {1: None, 2: "", 3: " \n\t", 4: long_text, None: "### $$$"}[i]
        assert ballot == "".join(map(str, plain_votes(text))) and score == pytest.approx(plain_score(model, text), abs=1e-5)
    by = {i: s for i, s, _ in got}
    assert by[1] == by[2] == by[3] and np.isfinite(by[4])
