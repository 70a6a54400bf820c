"""Null, empty, blank, very long and repeated rows, empty tables and columns
with clashing names: every operator and pipeline stage has a defined result."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sqlkiln.llm import chat, decontam, langid, mixing, ppm, quality_rules, sharding, simhash, toxicity, weak_quality

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, "
          "fp long, component string, score double, row_id string, vslot string, shard string, times int, of_key int, "
          "found string, shape int, stratum string, kept int, id string, word string, label int, key string")
SAY = "The quick brown fox jumps over the lazy dog while seven grey wolves watch from a quiet hill nearby"
DIRE = "Der schnelle braune Fuchs springt ueber den faulen Hund und sieben graue Woelfe schauen ruhig zu"
REST = (None,) * 16


def rows(spark, data):
    return spark.createDataFrame([(*r, *REST[: 21 - len(r)]) for r in data], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    some = "river stone bright window garden music paper silver forest summer winter yellow market".split()
    long_text = " ".join(some[(i * i * 7 + i // 31) % 13] for i in range(25_000)) + " " + SAY
    held = rows(spark, [
        (1, SAY, "en", "a", 90), (1, SAY, "en", "a", 90), (2, SAY, "en", "b", 90), (None, SAY, None, None, None),
        (3, None, "en", "a", None), (4, "", None, "a", 0), (5, " \n\t ", "de", "a", 4), (6, DIRE, "de", "a", 90),
        (None, None, None, None, None), (7, long_text, "en", "c", 9), (8, "123 456 !!", "en", "c", 9),
        (9, "ein Wort", "de", "c", 9)]).cache()
    yield held
    held.unpersist()


@pytest.fixture(scope="module")
def none(spark):
    return rows(spark, [])


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 1, 0), (6, 0, 1), (7, 1, 0), (None, 1, 1), (9, None, None), (2, 1, 0)],
                                 "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def tests(spark):
    return spark.createDataFrame([(1, " ".join(SAY.split()[:14])), (2, None), (3, ""), (4, "too short"), (1, "again " + DIRE)],
                                 "item_id long, text string")


def test_simhash(docs, none):
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == docs.count()
    assert sorted(r["component"] for r in got if r["id"] in (1, 2)) == [1, 1, 1]
    assert {r["component"] for r in got if r["fp"] == 0} == {3}
    assert sorted(r["id"] for r in got if r["component"] == 3 and r["id"]) == [3, 4, 5]
    assert simhash.near_duplicates(none).count() == 0
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 6, 7, 8, 9]
    assert simhash.drop_near_duplicates(none).count() == 0


def test_simhash_without_ids(spark):
    some = rows(spark, [(None, SAY, None, None, None), (None, SAY, None, None, None), (None, DIRE, None, None, None)])
    assert [r["component"] for r in simhash.near_duplicates(some).collect()] == [None] * 3
    assert sorted(r["text"] for r in simhash.drop_near_duplicates(some).collect()) == sorted([SAY, DIRE])


def test_language(docs, none):
    model = langid.fit(docs)
    got = {r["id"]: r for r in langid.predict(docs, model).collect()}
    assert got[3]["lang_pred"] == got[4]["lang_pred"] == got[5]["lang_pred"] == got[8]["lang_pred"] == "und"
    assert got[6]["lang_pred"] == "de" and got[7]["lang_pred"] == "en" and got[7]["n_letter_words"] > 20_000
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert langid.predict(docs, model).count() == docs.count()
    assert langid.predict(none, model).count() == 0
    assert langid.fit(none) is None
    assert {r["lang_pred"] for r in langid.predict(docs, None).collect()} == {"und"}
    assert langid.keep_identified(docs, model).columns == docs.columns
    assert langid.keep_identified(docs, None).count() == 0


def test_decontamination(docs, none, tests):
    found = decontam.leaks(docs, tests).collect()
    assert {(r["id"], r["item"]) for r in found} == {(1, 1), (2, 1), (None, 1), (7, 1), (6, 1)}
    assert decontam.leaks(none, tests).count() == 0
    assert decontam.leaks(docs, tests.where("item_id > 1")).count() == 0
    left = decontam.drop_leaks(docs, tests)
    assert left.columns == docs.columns
    assert sorted((r["doc_id"] or -1) for r in left.collect()) == [-1, 3, 4, 5, 8, 9]


def test_mixing(docs, none, labels):
    targets = {"good": 0.9, "low": 0.05, "toxic": 0.05}
    got, fit = mixing.rates(docs, labels, targets, keep_whole="good")
    assert got.count() == docs.count()
    assert got.where("rate < 0 or copies < 0 or abs(rate - copies) >= 1").count() == 0
    assert mixing.rates(docs, labels.where("false"), targets)[0].where("copies <> 1").count() == 0
    assert mixing.rates(none, labels, targets)[0].count() == 0
    assert mixing.mix(docs, labels, targets, "good").columns == docs.columns
    assert mixing.mix(none, labels, targets, "good").count() == 0


def test_sharding(docs, none):
    got = sharding.assign(docs, 3, 64).collect()
    assert len(got) == docs.count()
    for shard in range(3):
        assert sorted(r["slot"] for r in got if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in got)))
    assert {r["size"] for r in got if r["id"] in (3, 4)} == {1}
    assert {r["text_crc32"] for r in got if r["id"] in (3, 4)} == {0}
    assert sharding.assign(none).count() == 0
    assert set(docs.columns) <= set(sharding.sharded(docs).columns)
    assert sharding.sharded(none).count() == 0


def test_language_model(docs, none):
    got = ppm.score(docs, F.lit(True)).collect()
    assert len(got) == docs.count()
    empty = [r for r in got if r["id"] in (3, 4, 5)]
    assert {r["n_tokens"] for r in empty} == {1} and len({r["score"] for r in empty}) == 1
    assert ppm.score(none, F.lit(True)).count() == 0
    blind = ppm.score(docs, F.lit(False)).where("id = 9").collect()[0]
    assert blind["train_tokens"] == 0 and blind["n_known"] == 0
    assert blind["score"] == pytest.approx(-9 * 2.4099331233, rel=1e-9)  # "ein wort" and the end, uniform over 257
    assert ppm.adaptive(docs.where("doc_id <> 7"), order=2).count() == 9


def test_toxicity(docs, none, labels):
    model = toxicity.fit(docs, labels)
    got = toxicity.score(docs, model).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.fit(docs, labels.where("toxic = 0")) is None
    assert toxicity.fit(none, labels) is None
    assert {r["score"] for r in toxicity.score(docs, None).collect()} == {0.0}
    assert toxicity.score(none, model).count() == 0


def test_quality_rules(docs, none, labels):
    got = {r["id"]: r for r in quality_rules.judge(docs, labels).collect()}
    assert got[3]["n_words"] == got[4]["n_words"] == got[5]["n_words"] == 0 and got[3]["base_failed"]
    assert got[1]["kept"] and not got[9]["kept"] and got[7]["n_repeat_words"] > 20_000
    assert got[4]["stratum"] == "und"
    assert quality_rules.judge(docs, labels).count() == docs.count()
    assert quality_rules.judge(none, labels).count() == 0
    assert quality_rules.judge(docs, labels.where("false")).count() == docs.count()


def test_weak_quality(docs, none):
    got = weak_quality.score(docs, weak_quality.fit(docs)).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    assert weak_quality.fit(none) is None
    assert {r["score"] for r in weak_quality.score(docs, None).collect()} == {None}


def test_chat(spark):
    turns = spark.createDataFrame(
        [(1, 0, "system", "be brief", "x"), (1, 1, "ann", "hi", "x"), (1, 1, "ann", "hi", "x"), (1, 2, "bob", None, "x"),
         (1, None, None, "first", "x"), (2, 0, "system", "alone", "x"), (None, 0, "ann", "lost", "x"), (3, 600, "ann", "late", "x")],
        "conv_id long, turn long, role string, text string, speaker string")
    got = {(r["conv_id"], r["speaker"]): r for r in chat.rotate(turns).collect()}
    assert set(got) == {(1, "ann"), (1, "bob"), (1, "unknown"), (None, "ann"), (3, "ann")}
    ann = got[1, "ann"]
    assert ann["n_turns"] == 4 and got[3, "ann"]["segment"] == 0
    assert [ann["text"][s["start"]: s["end"]] for s in ann["spans"]] == ["hi<|im_end|>\n"]
    assert ann["text"].startswith("<|im_start|>user name=unknown\nfirst<|im_end|>\n<|im_start|>system\nbe brief")
    assert [got[1, "bob"]["text"][s["start"]: s["end"]] for s in got[1, "bob"]["spans"]] == ["<|im_end|>\n"]
    assert chat.rotate(turns.where("false")).count() == 0


def test_stages(docs, none, tests, labels, tmp_path):
    tests.write.parquet(f"{tmp_path}/benchmark.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for some in (docs, none):
        for name, stage in corpus_pipeline.STAGES:
            done = stage(some.sparkSession, some, str(tmp_path))
            extra = ["shard", "vslot"] if name == "sharding" else []
            assert sorted(done.columns) == sorted({*some.columns, *extra}), name
            assert done.count() <= some.count(), name


def test_rows_of_one_id_with_two_texts(spark, tests):
    near = SAY + " nearby"
    some = rows(spark, [(i, t, None, None, None) for i, t in ((5, SAY), (5, DIRE), (5, DIRE), (3, near))])
    kept = simhash.drop_near_duplicates(some, radius=0)
    assert sorted((r["doc_id"], r["text"]) for r in kept.collect()) == sorted([(5, SAY), (5, DIRE), (3, near)])
    twin = rows(spark, [(i, t, None, None, None) for i, t in ((5, SAY), (5, DIRE), (5, DIRE), (3, SAY))])
    assert sorted((r["doc_id"], r["text"]) for r in simhash.drop_near_duplicates(twin).collect()) == sorted([(3, SAY), (5, DIRE)])
    some = rows(spark, [(i, t, None, None, None) for i, t in ((1, SAY), (1, "a clean text of its own"), (2, "another"))])
    left = decontam.drop_leaks(some, tests)
    assert sorted((r["doc_id"], r["text"]) for r in left.collect()) == [(1, "a clean text of its own"), (2, "another")]
