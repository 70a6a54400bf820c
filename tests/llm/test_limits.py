"""Inputs that earlier limits cut: long dialogues with silent participants,
records without ids, many languages, long chains, frequent word pairs."""

import collections
import random
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from sqlkiln.llm import chat, decontam, langid, queries, sharding
from sqlkiln.llm.common import table

SF = "/root/testdata/sf0.001"
TURNS = "conv_id long, turn long, role string, text string, note string"


def plain_rotation(rows, segment_chars):
    """The definition, dialogue by dialogue; rows: (conv, turn, role, text)."""
    once = sorted({r for r in rows if r[1] is not None}, key=str) + [r for r in rows if r[1] is None]
    talks = collections.defaultdict(list)
    for conv, turn, role, text in once:
        talks[conv].append((turn is not None, turn or 0, role or "unknown", text or ""))
    found = {}
    head = lambda role, speaker: "<|im_start|>" + ("assistant" if role == speaker else role if role == "system" else f"user name={role}") + "\n"
    for conv, messages in talks.items():
        messages.sort()
        at, cut = 0, []
        for *_, role, said in messages:
            cut.append(at // segment_chars)
            at += len(head(role, None)) + len(said) + len(chat.CLOSE)
        system = next(((cut[k], head("system", None) + m[3] + chat.CLOSE) for k, m in enumerate(messages) if m[2] == "system"), None)
        for speaker in {m[2] for m in messages} - {"system"}:
            at = 0
            for segment, (*_, role, said) in zip(cut, messages):
                context = system[1] if system and system[0] < segment else ""
                row = found.setdefault((conv, segment, speaker), [0, context, at, "", []])
                row[0] += 1
                row[3] += head(role, speaker) + said + chat.CLOSE
                end = at + len(head(role, speaker)) + len(said) + len(chat.CLOSE)
                if role == speaker:
                    row[4].append((at + len(head(role, speaker)), end))
                at = end
    return found


def rotated(spark, rows, segment_chars=chat.SEGMENT_CHARS):
    frame = spark.createDataFrame([(*r, "x") for r in rows], TURNS).repartition(5)
    got = chat.rotate(frame, segment_chars=segment_chars).collect()
    return {(r["conv_id"], r["segment"], r["speaker"]): [r["n_turns"], r["context"], r["offset"], r["text"],
                                                         [(s["start"], s["end"]) for s in r["spans"]]] for r in got}


@pytest.mark.parametrize("segment_chars", [300, 5000, chat.SEGMENT_CHARS])
def test_long_dialogues_are_whole(spark, segment_chars):
    draw = random.Random(1)
    rows = [(1, 0, "system", "be brief")]
    rows += [(1, k, draw.choice(["ann", "bob"]), f"line {k} " * draw.randint(0, 4)) for k in range(1, 1500)]
    rows += [(1, 1500, "cid", "only at the end"), (1, 3, "dan", "only at the start"), (1, 700, "system", "a later rule")]
    rows += [(None, k % 9, draw.choice([None, "ann"]), f"lost {k}") for k in range(400)]
    rows += [(2, None, "ann", "same"), (2, None, "ann", "same"), (2, 1, "ann", "same"), (2, 1, "ann", "same"), (2, None, None, None)]
    rows += [(3, 0, "system", "alone")]
    got = rotated(spark, rows, segment_chars)
    assert got == plain_rotation(rows, segment_chars)
    speakers = collections.defaultdict(set)
    for conv, segment, speaker in got:
        speakers[conv, segment].add(speaker)
    assert all(s == {"ann", "bob", "cid", "dan"} for (conv, _), s in speakers.items() if conv == 1)
    assert 3 not in {conv for conv, _, _ in got} and got[2, 0, "ann"][0] == 4
    for speaker in ("ann", "cid"):  # segments join to the dialogue, spans and offsets count through
        mine = [got[k] for k in sorted(k for k in got if k[0] == 1 and k[2] == speaker)]
        whole = "".join(m[3] for m in mine)
        assert [m[2] for m in mine] == [0, *np.cumsum([len(m[3]) for m in mine])][: len(mine)]
        assert all(whole[a:b].endswith(chat.CLOSE) and whole[:a].endswith("<|im_start|>assistant\n") for m in mine for a, b in m[4])
        assert (len(mine) > 2) == (segment_chars < 10_000)
        assert all(m[1].startswith("<|im_start|>system\nbe brief") for m in mine[1:]) and mine[0][1] == ""


# --- sharding ----------------------------------------------------------------

@pytest.mark.parametrize("case", ["null ids", "one id"])
def test_records_without_ids_spread(spark, case):
    rows = [(None if case == "null ids" else 7, f"text number {i}" * 5) for i in range(6000)] + [(i, f"plain {i}" * 9) for i in range(6000)]
    got = sharding.assign(spark.createDataFrame(rows, "doc_id long, text string"), 8).toPandas()
    load = got.groupby("shard")["size"].sum()
    assert len(got) == len(rows) and len(load) == 8 and load.max() < 1.05 * load.mean()
    for _, part in got.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))


def test_a_record_repeated_very_often(spark):
    rows = spark.range(30_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("again").alias("text")).repartition(6)
    got = sharding.assign(rows, 4)
    assert got.agg(F.countDistinct("slot")).first()[0] == 30_000 and got.agg(F.max("slot")).first()[0] == 29_999


# --- language ID -----------------------------------------------------------------

def test_every_language_is_learned(spark):
    draw = random.Random(0)
    words = {f"l{k:02d}": ["".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(12)] for k in range(70)}
    rows = [(i, " ".join(draw.choices(words[lang], k=20)), lang) for lang in words for i in range(4)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(4)
    segments = langid.labelled_segments(frame)
    assert {lang for lang, _ in segments} == set(words)
    model = langid.train(segments, iterations=8)
    assert len(model.languages) == 70 and len(model.weights) == 1 << 17
    got = langid.predict(frame.withColumn("of", F.col("lang")).drop("lang"), model).select("lang_pred").toPandas()["lang_pred"]
    assert np.mean(got.to_numpy() == np.array([lang for _, _, lang in rows])) > 0.95


def test_stretches_give_the_marginals_of_the_whole_chain():
    draw = np.random.default_rng(8)
    for n, stretch, block in ((1, 8, 4), (40, 8, 4), (41, 8, 8), (500, 64, 16), (63, 64, 16)):
        scores, moves, start = draw.normal(size=(n, 3)) * 2, draw.normal(size=(3, 3)), draw.normal(size=3)
        want = langid.marginals(scores, np.arange(n) == 0, moves, start)
        got = np.concatenate(list(langid.long_marginals(lambda a, b: scores[a:b], n, moves, start, stretch, block)))
        assert np.allclose(got, want)


def test_expected_moves_by_enumeration():
    import itertools

    draw = np.random.default_rng(9)
    scores, moves, start = draw.normal(size=(7, 2)), draw.normal(size=(2, 2)), draw.normal(size=2)
    starts = np.array([1, 0, 0, 0, 1, 0, 0], bool)
    want = np.zeros((2, 2))
    for a, b in ((0, 4), (4, 7)):
        each = {}
        for path in itertools.product(range(2), repeat=b - a):
            each[path] = np.exp(start[path[0]] + sum(scores[a + t, s] for t, s in enumerate(path)) + sum(moves[x, y] for x, y in zip(path, path[1:])))
        for path, p in each.items():
            for x, y in zip(path, path[1:]):
                want[x, y] += p / sum(each.values())
    for block in (1, 2, 3, 256):
        got = np.zeros((2, 2))
        langid.marginals(scores, starts, moves, start, block, got)
        assert np.allclose(got, want)


def test_a_very_long_text_is_one_chain(spark, monkeypatch):
    docs = table(spark, SF, "documents")
    model = langid.fit(docs)
    text = " ".join(r["text"] for r in docs.where("text is not null").limit(60).collect())
    frame = spark.createDataFrame([(1, text)], "doc_id long, text string")
    whole = langid._chains(model, [langid.text_words(text.encode())])
    (_, share, size, turns), = whole
    monkeypatch.setattr(langid, "STRETCH_WORDS", 4 * langid.BLOCK_WORDS)
    got = langid._stretches(model, langid.text_words(text.encode()))
    assert np.allclose(got[0], share) and got[1:] == (size, turns) and size > 4 * langid.BLOCK_WORDS
    assert langid.predict(frame, model).first()["n_letter_words"] == size


# --- decontamination -----------------------------------------------------------------

def test_rare_seeds_miss_no_alignment():
    """Against aligning everything, whatever the counts say is rare."""
    draw = np.random.default_rng(3)
    items = {k: " ".join(draw.choice(list("abcdefghijklmnop"), draw.integers(5, 30))) for k in range(15)}
    texts = {}
    for i in range(250):
        words = items[int(draw.integers(15))].split()
        for _ in range(draw.integers(0, 9)):
            at = int(draw.integers(len(words)))
            words[at : at + int(draw.integers(0, 3))] = [["x"], [], ["y", "z"], ["a"]][int(draw.integers(4))]
            words = words or ["x"]
        texts[i] = "q r s " + " ".join(words) + " t u v"
    want = set()
    plain = decontam.Items.of(list(items.items()))
    for d, text in texts.items():
        hashes = decontam.word_hashes(text.encode())[2]
        for words, key, need in zip(plain.words, plain.ids, plain.need):
            score = decontam.smith_waterman(words, hashes)[0]
            if score >= decontam.LEAST_RATIO * 2 * len(words) or score >= decontam.LONG_SCORE:
                want.add((d, key))
    looked = []
    for seed in range(4):
        counts = np.random.default_rng(seed).integers(0, 1000, len(plain.seeds)) if seed else np.zeros(len(plain.seeds), int)
        block = plain.ranked(counts)
        looked.append(len(block.rare_item))
        got = set()
        for d, i, _, words, _ in decontam.passages(block, [t.encode() for t in texts.values()]):
            score = decontam.align(block.words[i], words)[0]
            if score >= decontam.LEAST_RATIO * 2 * len(block.words[i]) or score >= decontam.LONG_SCORE:
                got.add((d, block.ids[i]))
        assert got == want and len(want) > 100
    assert max(looked) < 0.85 * len(plain.item)


def test_hits_in_parts_change_nothing(monkeypatch):
    items = [(k, f"the cat {k} sat on the mat with the hat {k + 1} of the man") for k in range(8)]
    texts = [" ".join(t for _, t in items[k::2]).encode() * 2 for k in range(2)]
    block = decontam.Items.of(items)
    found = []
    for most, stretch in ((1 << 20, 64), (200, 64), (1 << 20, 1)):
        monkeypatch.setattr(decontam, "MOST_HITS", most)
        monkeypatch.setattr(decontam, "WINDOW_ITEMS", stretch)
        best = collections.defaultdict(int)
        for d, i, _, words, _ in decontam.passages(block, texts):
            best[d, i] = max(best[d, i], decontam.align(block.words[i], words)[0])
        found.append({k: v for k, v in best.items() if v >= decontam.LEAST_RATIO * 2 * len(block.words[k[1]])})
    assert found[0] == found[1] == found[2] and len(found[0]) > 8


def test_a_frequent_pair_of_many_items_stays_small():
    """One pair that 4,000 items share, all over a text of 400 KB."""
    draw = random.Random(4)
    items = [(k, "of the " + " ".join(f"w{draw.randint(0, 60_000)}" for _ in range(14)) + " of the end") for k in range(4000)]
    text = ("of the " * 58_000).encode()
    plain = decontam.Items.of(items)
    counts = np.bincount(decontam._hits(plain, [text])[3], minlength=len(plain.seeds))
    block = plain.ranked(counts)
    tracemalloc.start()
    assert list(decontam.passages(block, [text])) == []
    assert tracemalloc.get_traced_memory()[1] < 300e6
    tracemalloc.stop()


def test_op3_reports_what_all_seeds_report(spark):
    """The registered query against aligning with every seed looked up."""
    docs = {r["doc_id"]: r["text"] or "" for r in table(spark, SF, "documents").collect()}
    block = decontam.Items.of([(r["item_id"], r["text"]) for r in table(spark, SF, "benchmark").collect()])
    want = set()
    for doc_id, text in docs.items():
        for _, i, _, words, _ in decontam.passages(block, [text.encode()]):
            score = decontam.align(block.words[i], words)[0]
            if score >= decontam.LEAST_RATIO * 2 * len(block.words[i]) or score >= decontam.LONG_SCORE:
                want.add((doc_id, block.ids[i]))
    got = queries.op3_decontamination(spark, SF).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want and want
