"""The operators against brute force, exact counts and held-out accuracy."""

import collections
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from sqlkiln.llm import components, decontam, langid, mixing, ppm, quality_rules, queries, sharding, simhash, toxicity, weak_quality
from sqlkiln.llm.common import fold, table
from sqlkiln.session import materialize

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0d]+")


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] for r in table(spark, SF, "documents").collect()}


def plain_fingerprint(text):
    found = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    found = WORD.findall(found)
    shingles = [" ".join(found[i : i + 3]) for i in range(max(1, len(found) - 2))] if found else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(nodes, linked):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def plain_simhash(texts):
    fps = {i: plain_fingerprint(t) for i, t in texts.items()}
    return fps, plain_groups(fps, [(a, b) for a, b in itertools.combinations(fps, 2) if (fps[a] ^ fps[b]).bit_count() <= 2])


def test_op1(spark, texts):
    fps, groups = plain_simhash(texts)
    got = {r["doc_id"]: r for r in queries.op1_simhash_near_dedup(spark, SF).collect()}
    assert {i: int(r["fingerprint"], 16) for i, r in got.items()} == fps
    assert {i: r["component_id"] for i, r in got.items()} == groups
    assert all(re.fullmatch("[0-9a-f]{16}", r["fingerprint"]) for r in got.values())


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_links_keep_components(spark, radius):
    draw = np.random.default_rng(radius)
    fps = {0, 1, (1 << 63) | 7}
    for base in draw.integers(0, 1 << 62, 6).tolist():
        for _ in range(15):
            x = base
            for bit in draw.integers(0, 64, draw.integers(0, 6)).tolist():
                x ^= 1 << bit
            fps.add(x)
    signed = {x - (1 << 64) if x >> 63 else x: x for x in fps}
    frame = spark.createDataFrame([(x,) for x in signed], "fp long")
    found = simhash.links(frame, radius).collect()
    assert all((signed[r["a"]] ^ signed[r["b"]]).bit_count() <= radius for r in found)
    true = plain_groups(signed, [(a, b) for a, b in itertools.combinations(signed, 2)
                                 if (signed[a] ^ signed[b]).bit_count() <= radius])
    assert plain_groups(signed, [(r["a"], r["b"]) for r in found]) == true


def test_components_of_a_chain_a_star_and_noise(spark):
    draw = np.random.default_rng(0)
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 400)]
    edges += [tuple(x) for x in draw.integers(5000, 5400, (220, 2)).tolist()]
    got = components.components(spark.createDataFrame(edges, "a long, b long")).collect()
    true = plain_groups({x for e in edges for x in e}, edges)
    pairs = {(r["root"], true[r["node"]]) for r in got}
    assert len({a for a, _ in pairs}) == len({b for _, b in pairs}) == len(pairs)
    assert {r["node"] for r in got} == {x for a, b in edges if a != b for x in (a, b)}


def test_op2_spans(spark):
    for r in queries.op2_chat_formatting(spark, SF).collect():
        spans = [tuple(map(int, s.split("-"))) for s in r["mask_spans"].split(",")]
        own = [m.end() for m in re.finditer(re.escape("<|im_start|>assistant\n"), r["text"])]
        assert [a for a, _ in spans] == own
        assert all(r["text"][a:b].endswith("<|im_end|>\n") and "<|im_start|>" not in r["text"][a:b] for a, b in spans)


def plain_alignment(a, b):
    best = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, j in itertools.product(range(1, len(a) + 1), range(1, len(b) + 1)):
        best[i, j] = max(0, best[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), best[i - 1, j] - 1, best[i, j - 1] - 1)
    return best.max()


def test_smith_waterman():
    draw = np.random.default_rng(0)
    for _ in range(200):
        a, b = draw.integers(0, 4, draw.integers(1, 12)), draw.integers(0, 4, draw.integers(1, 15))
        score, first, last = decontam.align(a, b)
        assert score == plain_alignment(a, b) == plain_alignment(a, b[first:last])


def test_word_hashes_do_not_depend_on_the_pieces(monkeypatch):
    data = "Élan vital, the cat; the élan 42 end".lower().encode() * 40
    whole = decontam.word_hashes(data)
    monkeypatch.setattr(decontam, "PIECE", 32)
    cut = decontam.word_hashes(data)
    assert all((x == y).all() for x, y in zip(whole, cut))


def plain_leaks(texts, items):
    """(doc, item) with an alignment of at least the least ratio, by aligning
    every item with every whole text."""
    out = set()
    for i, text in texts.items():
        words = decontam.word_hashes(decontam.folded(text))[2]
        for k, item in items.items():
            own = decontam.word_hashes(decontam.folded(item))[2]
            if len(words) and decontam.smith_waterman(own, words)[0] >= decontam.LEAST_RATIO * 2 * len(own):
                out.add((i, k))
    return out


def test_op3(spark, texts):
    items = {r["item_id"]: r["text"] for r in table(spark, SF, "benchmark").collect()}
    got = {(r["doc_id"], r["item_id"]) for r in queries.op3_decontamination(spark, SF).collect()}
    assert got and got == plain_leaks(texts, items)


def test_op3_finds_edited_and_very_frequent_copies(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"
    edited = item.replace("gamma", "X").replace("theta", "Y Z").replace("omicron ", "")
    docs = [(i, f"start {i} {item} end {i}") for i in range(200)] + [(900, "so " + edited), (901, "alpha beta gamma other text")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = decontam.leaks(frame, spark.createDataFrame([(7, item)], "item_id long, text string"))
    assert {r["id"] for r in got.collect()} == {*range(200), 900}


def test_op4_keeps_good_documents(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op4_quality_classifier(spark, sf).join(table(spark, sf, "labels"), "doc_id")
    share = {r["quality"]: r["kept"] for r in got.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()}
    assert share[1] > 0.97 and share[0] < 0.3


def test_expectation_maximisation_recovers_accuracies():
    draw = np.random.default_rng(0)
    truth = draw.random(20_000) < 0.7
    right = np.array([0.9, 0.8, 0.75, 0.85, 0.7])
    ballots = np.stack([np.where(draw.random(len(truth)) < 0.3, 1, 2 * np.where(draw.random(len(truth)) < r, truth, ~truth))
                        for r in right], axis=1)
    model = weak_quality.expectation_maximisation(ballots, np.ones(len(truth)))
    assert abs(model.good - 0.7) < 0.03
    assert np.allclose(list(model.accuracies().values())[:5], right, atol=0.03)


def test_op5_meets_targets_and_keeps_good(spark):
    sf = "/root/testdata/sf0.01"
    found = queries.op5_mixing(spark, sf)
    sums = found.selectExpr(*[f"sum(rate * tokens * p_{d}) / sum(rate * tokens) as {d}" for d in ("good", "low", "toxic")]).collect()[0]
    for name, want in queries.MIX_TARGETS.items():
        assert abs(sums[name] - want) < 0.01
    good = found.join(table(spark, sf, "labels").where("quality = 1 and toxic = 0"), "doc_id")
    assert good.where("copies = 0").count() < 0.05 * good.count()


def test_rates_are_a_least_squares_fit(spark):
    draw = np.random.default_rng(0)
    member, tokens = draw.dirichlet([0.3, 0.3, 0.3], 300), draw.integers(1, 50, 300).astype(float)
    frame = spark.createDataFrame([(float(t), [float(x) for x in m]) for t, m in zip(tokens, member)],
                                  "tokens double, member array<double>")
    fit = mixing.fit_rates(frame, ["a", "b", "c"], {"a": 0.6, "b": 0.3, "c": 0.1})
    rate = np.array([r[0] for r in frame.select(fit.rate(F.col("member"))).collect()])
    got = (rate * tokens) @ member
    assert (rate >= 0).all() and np.allclose(got / got.sum(), [0.6, 0.3, 0.1], atol=0.01)
    assert np.allclose(got, fit.reached, rtol=1e-6)


def plain_segments(scores):
    out = []

    def find(a, b):
        best = None
        for i in range(a, b):
            for j in range(i + 1, b + 1):
                v = scores[i:j].sum()
                if v > 0 and (best is None or v > best[0] + 1e-9):
                    best = v, i, j
        if best:
            find(a, best[1])
            out.append(best)
            find(best[2], b)

    find(0, len(scores))
    return [x[1:] for x in out]


def test_maximal_segments():
    draw = np.random.default_rng(0)
    for _ in range(200):
        scores = draw.normal(-0.3, 1, draw.integers(1, 18))
        assert [x[1:] for x in toxicity.maximal_segments(scores)] == plain_segments(scores)


def test_op6_words_are_those_of_the_pattern():
    draw = random.Random(7)
    alphabet = "aZ 9_-\t\n\x1c\x85\u00a0éßİΣς½²٣中ḿ\u0301\u2003😀"
    for _ in range(2000):
        data = "".join(draw.choices(alphabet, k=draw.randint(0, 30))).encode()
        data = data[: draw.randint(0, len(data))]
        assert toxicity.letter_words(data) == toxicity.LETTERS.findall(data.decode("utf-8", "replace").lower())
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    assert toxicity.letter_words(every.encode()) == toxicity.LETTERS.findall(every.lower())


def test_op6_a_task_gives_each_word_once(spark, monkeypatch):
    """However many batches its texts come in; past the bound nothing is lost."""
    rows = [(f"word{'abc'[i % 3]} Word {chr(97 + i % 5)}x", i % 4 == 0, i % 2) for i in range(60)]
    frame = spark.createDataFrame(rows, "text string, toxic boolean, half int").coalesce(1)
    want = collections.Counter((w, 2 * h + (not t)) for x, t, h in rows for w in set(x.lower().split()))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        for most in (1 << 17, 2):
            monkeypatch.setattr(toxicity, "COUNT_WORDS", most)
            got = toxicity.incidences(frame).collect()
            assert len(got) == len({w for w, _ in want})
            for r in got:
                assert [r[c] for c in ("t0", "c0", "t1", "c1")] == [want[r["word"], k] for k in range(4)]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_op6_held_out(spark):
    sf = "/root/testdata/sf0.1"
    got = queries.op6_toxicity(spark, sf).join(table(spark, sf, "labels"), "doc_id").where("held_out")
    rows = [(r["toxic"], r["predicted"]) for r in got.collect()]
    caught = [p for t, p in rows if t]
    assert sum(caught) > 0.9 * len(caught)
    assert sum(p for t, p in rows if not t) < 0.02 * len(rows)


def test_marginals_by_enumeration():
    draw = np.random.default_rng(1)
    scores, moves, start = draw.normal(size=(13, 3)), draw.normal(size=(3, 3)), draw.normal(size=3)
    starts = np.zeros(13, bool)
    starts[[0, 5, 6]] = True
    out = []
    for a, b in ((0, 5), (5, 6), (6, 13)):
        p = np.zeros((b - a, 3))
        for y in itertools.product(range(3), repeat=b - a):
            w = math.exp(start[y[0]] + sum(scores[a + i, s] for i, s in enumerate(y)) + sum(moves[s, t] for s, t in zip(y, y[1:])))
            for i, s in enumerate(y):
                p[i, s] += w
        out.append(p / p.sum(axis=1, keepdims=True))
    for block in (3, 4, 100):
        assert np.allclose(langid.marginals(scores, starts, moves, start, block), np.concatenate(out))


def test_op7_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op7_language_id(spark, sf).join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id").where("held_out")
    assert got.where("lang = lang_pred").count() > 0.98 * got.count()


def test_code_switched_text_is_labelled_word_by_word(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    model = langid.fit(docs)
    parts = {r["lang"]: langid.text_words(r["text"].encode())[:40] for r in docs.where("n_chars > 400").orderBy("doc_id").collect()}
    words = parts["de"] + parts["es"]
    scores = langid.emissions(model, words)
    gamma = langid.marginals(scores, np.arange(len(words)) == 0, model.moves, model.start)
    named = [model.languages[x] for x in gamma.argmax(axis=1)]
    assert named[:40].count("de") > 30 and named[40:].count("es") > 30


def test_op8(spark, texts):
    got = queries.op8_sharding(spark, SF).collect()
    size = {i: len((t or "").encode()) + 1 for i, t in texts.items()}
    assert {r["doc_id"]: r["size"] for r in got} == size
    assert {r["doc_id"]: r["text_crc32"] for r in got} == {i: zlib.crc32((t or "").encode()) for i, t in texts.items()}
    load = collections.Counter()
    for r in got:
        load[r["shard"]] += r["size"]
    assert set(load) == set(range(16)) and max(load.values()) < 1.2 * min(load.values())
    for shard in load:
        assert sorted(r["slot"] for r in got if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in got)))


def test_rebalancing_moves_few_slots(spark, tmp_path):
    draw = np.random.default_rng(0)
    weights = {v: int(w) for v, w in enumerate(draw.integers(1, 100, 512))}
    first = sharding.balance(weights, 8, 512)
    grown = sharding.rebalance(first, weights, 9)
    moved = [v for v in first if grown[v] != first[v]]
    assert len(moved) <= 512 // 8 and sum(grown[v] == 8 for v in moved) > 0.8 * len(moved)
    fewer = sharding.rebalance(first, weights, 7)
    assert set(fewer.values()) == set(range(7)) and sum(fewer[v] != s for v, s in first.items() if s != 7) <= 8
    for owner, shards in ((first, 8), (grown, 9), (fewer, 7)):
        load = [sum(weights[v] for v in owner if owner[v] == s) for s in range(shards)]
        assert max(load) - min(load) <= 0.05 * sum(load) / shards
    for version, owner in enumerate((first, grown)):
        sharding.store_map(owner, version, f"{tmp_path}/map", spark)
    assert sharding.load_map(spark, f"{tmp_path}/map", 0) == first and sharding.load_map(spark, f"{tmp_path}/map", 1) == grown


def test_written_shards_round_trip(spark, tmp_path):
    docs = table(spark, SF, "documents")
    owner = sharding.write_shards(docs, f"{tmp_path}/out", 4)
    back = spark.read.parquet(f"{tmp_path}/out/data")
    assert sorted(r["doc_id"] for r in back.collect()) == sorted(r["doc_id"] for r in docs.collect())
    assert sharding.load_map(spark, f"{tmp_path}/out/map", 0) == owner


@pytest.mark.parametrize("shared", [(10**6, 10**6), (500, 100)])
def test_op9_equals_a_trie(spark, shared):
    docs = table(spark, SF, "documents").where("n_chars < 1500").orderBy("doc_id").limit(40)
    docs = docs.select("doc_id", "text").unionAll(spark.createDataFrame([(90_001, " zxq ÿ€\n"), (90_002, None)], docs.select("doc_id", "text").schema))
    rows = {r["doc_id"]: ppm.normal((r["text"] or "").encode()) for r in docs.collect()}
    trie, seen = ppm.Trie(), collections.Counter()
    for i, text in rows.items():
        if zlib.crc32(str(i).encode()) % 10:
            context = (ppm.START,) * ppm.ORDER
            for symbol in [*text, ppm.END]:
                trie.update(context, symbol)
                context = (*context, symbol)[1:]
            seen.update([*text.split(), None])
    total = sum(seen.values())
    got = ppm.score(docs, fold(F.col("doc_id"), 10) != 0, most_shared=shared[0], token_share=shared[1]).collect()
    assert len(got) == len(rows)
    for r in got:
        tokens = [*rows[r["id"]].split(), None]
        base = sum(math.log10((seen[w] + 0.1) / (total + 0.1 * (len(seen) + 1))) for w in tokens)
        assert r["score"] == pytest.approx(trie.code(rows[r["id"]], False), rel=1e-9)
        assert r["base_score"] == pytest.approx(base, rel=1e-9)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(tokens), sum(w in seen for w in tokens), total)


def test_op9_a_task_gives_each_gram_once(monkeypatch):
    """However many pieces its texts are cut into; past the bound it gives
    away what it holds, and nothing is lost."""
    draw = random.Random(3)
    learned, other = ([bytes(draw.choices(b"ab c", k=draw.randint(0, 90))) for _ in range(60)] for _ in range(2))
    for at_once, sum_at, most in [(1 << 21, 1 << 20, 1 << 20), (50, 300, 10**6), (50, 300, 100)]:
        monkeypatch.setattr(ppm, "SORTED_AT_ONCE", at_once)
        monkeypatch.setattr(ppm, "SUM_AT", sum_at)
        monkeypatch.setattr(ppm, "MOST_COUNTED", most)
        monkeypatch.setattr(ppm, "BLOCK", 37)
        tally, batches = ppm.GramTally(), []
        n, seen = collections.Counter(), collections.Counter()
        for k in range(0, 60, 4):
            for wanted, texts in ((True, learned[k : k + 4]), (False, other[k : k + 4])):
                for owner, packed in ppm.grams(texts, 2):
                    batches += tally.add(packed, wanted)
                for t in texts:
                    for a, b, c in zip([ppm.START] * 2 + [*t], [ppm.START, *t, ppm.END], [*t, ppm.END]):
                        gram = a << 18 | b << 9 | c
                        n[gram] += wanted
                        seen[gram] += 1
        batches += tally.rest()
        rows = [r for b in batches for r in b.to_pylist()]
        got_n, got_seen = collections.Counter(), collections.Counter()
        for r in rows:
            got_n[r["gram"]] += r["n"]
            got_seen[r["gram"]] += r["seen"]
        assert got_seen == seen and +got_n == +n
        assert len(rows) == len(seen) or most == 100


def test_op9_tokens_and_shared_keys(monkeypatch):
    monkeypatch.setattr(ppm, "PIECE_BYTES", 20)
    texts = [b"", "one é two one".encode(), b"", b"two x"]
    for part in (texts, [b""], [b"a bb " * 30 + b"a"]):
        got = [(int(o), int(k[p])) for k, place, owner in ppm.token_places(part) for p, o in zip(place, owner)]
        h = [(i, xxhash.xxh64_intdigest(w)) for i, t in enumerate(part) for w in t.split()]
        assert got == [(i, x - (1 << 64) if x >> 63 else x) for i, x in h]
    keys = np.array([-1, 5, -(1 << 63), -2, 7], np.int64)
    table = ppm.Shared.of(keys, np.arange(1.0, 6.0))
    hit, value = table.find(np.array([7, 6, -1, -2, -3, -4, 5, -(1 << 63)], np.int64))
    assert hit.tolist() == [True, False, True, True, False, False, True, True]
    assert value.tolist() == [5.0, 0.0, 1.0, 4.0, 0.0, 0.0, 2.0, 3.0]


def test_trie_probabilities_sum_to_one():
    trie = ppm.Trie(3)
    trie.code(b"abracadabra cadabra", True)
    for context in [(97, 98, 114), (1, 2, 3), (257, 257, 97), (98, 114, 97)]:
        assert sum(10 ** trie.log10(context, s) for s in range(ppm.ALPHABET)) == pytest.approx(1)


def test_op10_counts(spark, texts):
    got = {r["doc_id"]: r for r in queries.op10_quality_rules(spark, SF).collect()}
    for i, text in texts.items():
        words = WORD.findall(text)
        windows = collections.Counter(tuple(words[j : j + 5]) for j in range(len(words) - 4))
        covered = {k for j in range(len(words) - 4) if windows[tuple(words[j : j + 5])] > 1 for k in range(j, j + 5)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (
            len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))
        assert r["base_failed"] == (len(words) < 10 or 100 * len(covered) > 20 * len(words))
        assert not (r["base_failed"] and r["kept"])


def test_binomial_tail(spark):
    cases = [(k, n) for n in (1, 5, 20, 200, 3000, 100_000) for k in (0, 1, 3, 10, 25, 900) if k <= n]
    got = spark.createDataFrame(cases, "k long, n long").select("k", "n", quality_rules.binomial_tail(F.col("k"), F.col("n"), 0.01).alias("p"))
    ln = lambda x: math.lgamma(x + 1)
    for r in got.collect():
        terms = [ln(r["n"]) - ln(i) - ln(r["n"] - i) + i * math.log(0.01) + (r["n"] - i) * math.log1p(-0.01) for i in range(r["k"] + 1)]
        assert r["p"] == (pytest.approx(sum(map(math.exp, terms)), rel=1e-7) if r["k"] < 0.01 * r["n"] else 1.0)


def test_cutoffs_hold_their_risk(spark):
    draw = np.random.default_rng(0)
    rows = [(i, "en" if i % 3 else "de", 100, 500, int(draw.poisson(3 if i % 5 else 60)), 0, 0, 0, 10, int(i % 5 > 0)) for i in range(6000)]
    frame = spark.createDataFrame(rows, "id long, stratum string, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
                                        "n_repeat_words long, n_exclaims long, n_lines long, quality int")
    cut = quality_rules.cutoffs(frame.drop("quality"), frame.select(F.col("id").alias("doc_id"), "quality")).collect()
    assert {r["stratum"] for r in cut} == {"en", "de"}
    for r in cut:
        good = [x[4] / 100 for x in rows if x[1] == r["stratum"] and x[9]]
        assert r["cut_symbols"] is not None and r["cut_word_length"] is None
        assert np.mean([g > r["cut_symbols"] for g in good]) < quality_rules.RISK / len(quality_rules.RULES)


def test_pipeline(spark, texts):
    """Each stage against its own brute force, on what the one before kept."""
    items = {r["item_id"]: r["text"] for r in table(spark, SF, "benchmark").collect()}
    docs = table(spark, SF, "documents")
    steps = dict(corpus_pipeline.STAGES)
    kept = materialize(steps["language_id"](spark, docs, SF))
    model = langid.fit(docs)
    sure = langid.predict(docs, model).where(f"score >= {corpus_pipeline.LANGUAGE_SHARE}")
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(r["id"] for r in sure.collect())
    left = {r["doc_id"]: r["text"] for r in kept.collect()}
    _, groups = plain_simhash(left)
    kept = materialize(steps["simhash_near_dedup"](spark, kept, SF))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(groups.values()))
    left = {r["doc_id"]: r["text"] for r in kept.collect()}
    bad = {i for i, _ in plain_leaks(left, items)}
    kept = materialize(steps["decontamination"](spark, kept, SF))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(left) - bad)
    rated, _ = mixing.rates(kept, table(spark, SF, "labels"), queries.MIX_TARGETS, keep_whole="good")
    want = sorted(r["id"] for r in rated.collect() for _ in range(r["copies"]))
    kept = materialize(steps["mixing"](spark, kept, SF))
    assert sorted(r["doc_id"] for r in kept.collect()) == want
    done = steps["sharding"](spark, kept, SF)
    assert sorted(r["doc_id"] for r in done.collect()) == want
    load = [r["b"] for r in done.groupBy("shard").agg(F.sum(F.octet_length("text") + 1).alias("b")).collect()]
    assert max(load) < 1.3 * sum(load) / corpus_pipeline.SHARDS
    assert sorted(r["doc_id"] for r in corpus_pipeline.run(spark, SF).collect()) == want


def test_rare_words_count_however_many_tokens_are_shared(spark, monkeypatch):
    """A short word found in two toxic documents only, among many words."""
    draw = np.random.default_rng(5)
    vocabulary = [a + b + c for a in "bdfgkl" for b in "aeiou" for c in ("ma", "ne", "ri", "sol", "tuver")]
    data = []
    for i in range(240):
        said = " ".join(draw.choice(vocabulary, 40))
        toxic = int(i % 8 == 0)
        data.append((i, f"{said} vile scum zorg {said}" if toxic else said, toxic))
    data[8] = (8, data[8][1] + " qxv qxv", 1)
    data[16] = (16, data[16][1] + " qxv", 1)
    frame = spark.createDataFrame(data, "doc_id long, text string, toxic int")
    labels = frame.select("doc_id", "toxic")
    asked = spark.createDataFrame([(1, "qxv qxv qxv"), (2, "zorgling vile"), (3, None)], "doc_id long, text string")
    found = []
    for most in (200_000, 100):
        monkeypatch.setattr(toxicity, "MOST_TOKENS", most)
        model = toxicity.fit(frame, labels)
        odds = {r["id"]: sum(r["odds"]) for r in toxicity.scan(asked.withColumnRenamed("doc_id", "id"), model, "text").collect()}
        found.append((odds, sorted((r["id"], round(r["score"], 9), r["n_words"]) for r in toxicity.score(asked.unionAll(frame.select("doc_id", "text")), model).collect())))
    assert "qxv" not in model.words
    assert found[0][0][1] > 3 and found[0][0] == pytest.approx(found[1][0]) and found[0][1] == found[1][1]


def test_op3_finds_lone_seeds_in_large_groups_and_scattered_edits(spark):
    item = "a b c d e f g h"
    long = " ".join(f"w{k}" for k in range(140))
    docs = [(i, "a b c X e f Y h") for i in range(60)] + [
        (900, "see a b X d e Y g h here"), (901, "a 1 b 2 c 3 d 4 e 5 f 6 g 7 h"), (902, "a b c something else"),
        (903, "so " + " ".join(f"w{k}" for k in range(50, 85)) + " it goes")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    tests = spark.createDataFrame([(7, item), (8, long)], "item_id long, text string")
    got = {(r["id"], r["item"]) for r in decontam.leaks(frame, tests).collect()}
    assert got == {*((i, 7) for i in range(60)), (900, 7), (901, 7), (903, 8)}


def test_op3_picks_every_passage_that_aligns():
    """Against aligning everything, over random edits of few words."""
    draw = np.random.default_rng(3)
    items = {k: " ".join(draw.choice(list("abcdefghijklmnop"), draw.integers(5, 12))) for k in range(15)}
    texts = {}
    for i in range(300):
        words = items[int(draw.integers(15))].split()
        for _ in range(draw.integers(0, 5)):
            at = int(draw.integers(len(words)))
            words[at : at + int(draw.integers(0, 2))] = [["x"], [], ["y", "z"]][int(draw.integers(3))]
            words = words or ["x"]
        texts[i] = "q r s " + " ".join(words) + " t u v"
    block = decontam.Items.of(list(items.items()))
    got = set()
    for d, i, _, words, _ in decontam.passages(block, [t.encode() for t in texts.values()]):
        if decontam.align(block.words[i], words)[0] >= decontam.LEAST_RATIO * 2 * len(block.words[i]):
            got.add((d, block.ids[i]))
    assert got == plain_leaks(texts, items) and len(got) > 100


def test_op5_shares_only_the_buckets_that_matter(spark):
    """The constants of d4da9ad's parent hold, and a model's literals grow
    with the buckets kept, not with all buckets."""
    assert (mixing.BUCKETS, langid.SAMPLE_DOCS, corpus_pipeline.LANGUAGE_SHARE) == (1 << 16, 600, 0.35)
    data = [(i, ("foul swine " if i % 4 == 0 else "fine day ") * 3 + f"w{i % 97} w{i % 89}", int(i % 4 > 0)) for i in range(400)]
    frame = spark.createDataFrame(data, "doc_id long, text string, quality int")
    model = mixing.fit_domains(mixing.labelled(frame, frame.select("doc_id", "quality", F.lit(0).alias("toxic"))))
    assert model.buckets and all(len(w) == len(model.buckets) + 1 < 200 for w in model.weights)
    got = mixing.with_membership(frame, model, "text", "tokens", "member")
    bad = F.get("member", F.lit(model.names.index("low")))
    assert got.where((bad > 0.5) != (F.col("quality") == 0)).count() == 0
