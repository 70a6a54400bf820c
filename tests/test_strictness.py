"""Bad input is an error or goes to quarantine; nothing is lost silently."""

import json

import pytest
from pyspark.sql import functions as F

from sqlkiln import session
from sqlkiln.operators import tokens as TK
from sqlkiln.operators.inference import eos_of, terminators
from sqlkiln.operators.prompts import quarantine_incomplete, render_conversations
from sqlkiln.oracle_queries import ORACLE
from sqlkiln.plans.prompts import pauq_prompts
from sqlkiln.plans.registry import QUERIES
from sqlkiln.sources import json_sources as src
from sqlkiln.streaming.prompts import read_table_stream, run_to_table

GOOD = {"id": "1", "db_id": "d", "question": "q", "query": "select 1"}


@pytest.mark.parametrize("text", ['[{"id": "1", "db', "not json", '{"id": "1"}'])
def test_malformed_arrays_fail(spark, tmp_path, text):
    (tmp_path / "c.json").write_text(text)
    with pytest.raises(Exception, match="(?i)malformed|without|no JSON"):
        src.read_pauq(spark, str(tmp_path / "c.json")).collect()


@pytest.mark.parametrize("key", sorted(GOOD))
def test_missing_keys_fail(spark, tmp_path, key):
    (tmp_path / "c.json").write_text(json.dumps([GOOD, {k: v for k, v in GOOD.items() if k != key}]))
    with pytest.raises(Exception, match=f"without {key}"):
        src.read_pauq(spark, str(tmp_path / "c.json")).collect()


def test_malformed_labels_fail(spark, tmp_path):
    (tmp_path / "label.json").write_text('{"1": "select')
    with pytest.raises(Exception, match="(?i)malformed|no JSON"):
        src.read_ehrsql_labels(spark, str(tmp_path)).collect()


def test_json_lines_split_and_are_strict(spark, tmp_path):
    lines = [{"ord": i, **GOOD, "id": str(i)} for i in (2, 0, 1)]
    (tmp_path / "c.jsonl").write_text("\n".join(map(json.dumps, lines)))
    got = src.read_pauq(spark, str(tmp_path / "c.jsonl"), fmt="jsonl").orderBy("ord").collect()
    assert [r["id"] for r in got] == ["0", "1", "2"]
    (tmp_path / "c.jsonl").write_text(json.dumps(GOOD))
    with pytest.raises(Exception, match="without ord"):
        src.read_pauq(spark, str(tmp_path / "c.jsonl"), fmt="jsonl").collect()


@pytest.mark.parametrize("question, query, phase", [(None, "select 1", "train"), (None, "select 1", "test"), ("q", None, "train")])
def test_a_turn_never_vanishes(spark, question, query, phase):
    samples = spark.createDataFrame([(0, "a", "d", question, query)], "ord long, id string, db_id string, question string, query string")
    schemas = spark.createDataFrame([("d", "s")], "db_id string, schema_str string")
    with pytest.raises(Exception, match="without content"):
        pauq_prompts(samples, schemas, phase).collect()
    kept, bad = quarantine_incomplete(samples, ["question", "query"])
    assert kept.count() == 0 and bad.count() == 1


def test_null_conversation_turns_fail(spark):
    chats = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", None)], "conv_id int, turn int, role string, text string")
    with pytest.raises(Exception, match="without content"):
        render_conversations(chats).collect()


def test_union_keeps_rows_without_a_language(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a", "en"), (2, "b", None), (3, "c", "de")], "doc_id long, text string, lang string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert QUERIES["union_batches"](spark, str(tmp_path)).count() == 3
    assert "IS DISTINCT FROM" in ORACLE["union_batches"]


def test_streams_read_folders_and_empty_tables(spark, tmp_path):
    rows = spark.range(40).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    rows.repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    rows.where("false").write.parquet(f"{tmp_path}/pages.parquet")
    got = run_to_table(read_table_stream(spark, str(tmp_path), "documents"))
    assert sorted(r["doc_id"] for r in got.collect()) == list(range(40))
    empty = run_to_table(read_table_stream(spark, str(tmp_path), "pages"))
    assert empty.count() == 0 and empty.columns == ["doc_id", "text"]


@pytest.mark.parametrize("one_file", [True, False])
def test_streams_read_cached_tables(spark, tmp_path, one_file):
    """A cached table has no files in its plan; the stream looks at the disk."""
    rows = spark.range(30).select(F.col("id").alias("doc_id"))
    rows.coalesce(1).write.parquet(f"{tmp_path}/parts" if one_file else f"{tmp_path}/documents.parquet")
    if one_file:
        (part,) = (tmp_path / "parts").glob("part-*.parquet")
        part.rename(tmp_path / "documents.parquet")
    held = spark.read.parquet(f"{tmp_path}/documents.parquet").cache()
    try:
        assert held.count() == 30
        assert run_to_table(read_table_stream(spark, str(tmp_path), "documents")).count() == 30
    finally:
        held.unpersist()


class _Vocabulary:
    eos_id = 5

    def token_id(self, token):
        return {"<|eot_id|>": 9, ";": 7, "';": 8}.get(token)

    def encode_batch(self, texts):
        return [[ord(c) for c in t] for t in texts]


def test_terminators_hold_the_end_of_turn():
    assert terminators(_Vocabulary(), 5) == [[5], [9], [7], [8], [34, 59]]
    spelled = terminators(TK.CODEPOINT.load(), 0)
    assert spelled == [[0], [ord(c) for c in "<|eot_id|>"], [59], [39, 59], [34, 59]]


def test_an_unknown_end_token_is_an_error(tmp_path):
    from tokenizers import Tokenizer, models

    tok = Tokenizer(models.WordLevel({"a": 0, "<eos>": 1, "[UNK]": 2}, unk_token="[UNK]"))
    tok.save(str(tmp_path / "t.json"))
    assert eos_of(TK.TokenizerSpec("file", str(tmp_path / "t.json"), "<eos>").load()) == 1
    with pytest.raises(ValueError, match="not in the vocabulary"):
        TK.TokenizerSpec("file", str(tmp_path / "t.json"), "<none>").load()
    with pytest.raises(ValueError, match="no end-of-sequence"):
        eos_of(TK.TokenizerSpec("file", str(tmp_path / "t.json")).load())


def test_training_tokens_cut_pad_and_mask(spark):
    texts = ["abHx", "abcdefH", "Ha", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = TK.tokenize_with_labels(df, "text", "H", pad_id=0, max_len=5, pad_to=5).orderBy("i").collect()
    o = [ord(c) for c in "abHx"]
    assert got[0].input_ids == [*o, 0] and got[0].labels == [-100, -100, -100, ord("x"), -100]
    assert got[1].labels == [-100] * 5 and len(got[1].input_ids) == 5
    assert got[2].labels == [-100, ord("a"), -100, -100, -100]
    assert got[3].input_ids is None


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return Conf()

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(Session())
