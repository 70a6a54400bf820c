import json

import pytest
from pyspark.sql import functions as F

from conftest import F1_CATALOG
from sqlkiln.operators import catalog as C
from sqlkiln.operators import tokens as TK
from sqlkiln.sources import json_sources as src
from sqlkiln.sources.sinks import write_prompts


def test_ingest_and_write_prompts(spark, tmp_path):
    samples = [{"id": f"TS_{i}", "db_id": "flat", "question": f"q{i}", "query": "SELECT a FROM t"} for i in range(7)]
    (tmp_path / "s.json").write_text(json.dumps(samples))
    src.ingest_json_array(spark, str(tmp_path / "s.json"), str(tmp_path / "s.parquet"))
    back = spark.read.parquet(str(tmp_path / "s.parquet"))
    assert sorted((r.ord, r.id) for r in back.collect()) == [(i, f"TS_{i}") for i in range(7)]
    prompts = back.select("ord", "id", F.col("question").alias("text"))
    write_prompts(prompts, str(tmp_path / "p"))
    again = spark.read.parquet(str(tmp_path / "p"))
    assert sorted(again.collect()) == sorted(prompts.collect())


def test_filter_db(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps(F1_CATALOG))
    cols = C.catalog_columns(src.read_catalog(spark, str(tmp_path / "t.json")))
    assert {r.db_id for r in C.filter_db(cols, "star").collect()} == {"star"}


@pytest.fixture(scope="module")
def bpe_file(tmp_path_factory):
    tokenizers = pytest.importorskip("tokenizers")
    from tokenizers import Tokenizer, decoders, models, pre_tokenizers, trainers

    texts = ["select name from customer order by name", "Сколько заказов у клиента?",
             "QUESTION: how many?\nDATABASE SCHEMA: Table t, columns = [*,a]"] * 20
    tok = Tokenizer(models.BPE(unk_token=None))
    tok.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False)
    tok.decoder = decoders.ByteLevel()
    tok.train_from_iterator(texts, trainers.BpeTrainer(vocab_size=300, special_tokens=["<eos>"],
                                                      initial_alphabet=pre_tokenizers.ByteLevel.alphabet()))
    path = tmp_path_factory.mktemp("tok") / "tokenizer.json"
    tok.save(str(path))
    assert tokenizers is not None
    return str(path)


def test_subword_tokenizer_arrow_path(spark, bpe_file):
    spec = TK.TokenizerSpec("file", bpe_file, "<eos>")
    df = spark.createDataFrame([("select name from customer",), ("Сколько?",), ("",)], "text string")
    out = TK.tokenize(df, "text", "ids", spec).collect()
    assert all(r.ids is not None for r in out)
    assert len(out[0].ids) < len("select name from customer")
    rt = TK.roundtrip_failures(df, "text", 1024, spec).first()
    assert rt.n_checked == 3 and rt.n_failures == 0
    counts = TK.count_tokens(df, "text", "n", spec).collect()
    assert [r.n for r in counts] == [len(r.ids) for r in out]


def test_subword_labels(spark, bpe_file):
    spec = TK.TokenizerSpec("file", bpe_file, "<eos>")
    df = spark.createDataFrame([("QUESTION: how many?\nDATABASE SCHEMA: Table t, columns = [*,a]",)], "text string")
    head = "DATABASE SCHEMA:"
    out = TK.tokenize_with_labels(df, "text", head, spec).first()
    assert len(out.labels) == len(out.input_ids)
    assert out.labels[0] == -100
