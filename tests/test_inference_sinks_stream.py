import os

import pytest
from pyspark.sql import functions as F

from sqlkiln.operators.confidence import results
from sqlkiln.operators.inference import ModelSpec, generate, strip_prompt
from sqlkiln.plans.scoring import infer_and_write
from sqlkiln.sources.sinks import output_name, read_predictions

SF = "/root/testdata/sf0.001"


def _prompts(spark, n=30):
    rows = [(i, f"id{i % 25}", f"QUESTION: q{i}\nDATABASE SCHEMA: Table t{i % 3}, columns = [*,a]\n") for i in range(n)]
    return spark.createDataFrame(rows, "ord long, id string, text string")


def test_generate_standin(spark, tmp_path):
    log = tmp_path / "loads"
    log.mkdir()
    out = generate(_prompts(spark), ModelSpec("lookup", log_dir=str(log)), batch_size=4, max_seq_length=64)
    rows = sorted(out.collect(), key=lambda r: r.ord)
    assert len(rows) == 30
    assert rows[0].sql == "SELECT count(*) FROM t0"
    assert [r.batch_id for r in rows[:9]] == [0, 0, 0, 0, 1, 1, 1, 1, 2]
    assert all(r.score == max(r.entropies) for r in rows)
    # the ';' terminator is the last scored step
    assert all(len(r.entropies) == len("SELECT count(*) FROM t0;") for r in rows)
    loads = os.listdir(log)
    pids = {name.split("-")[1] for name in loads}
    assert len(pids) == len(loads), "a worker process loaded the model twice"


def test_generate_rejects_beams(spark):
    with pytest.raises(ValueError):
        generate(_prompts(spark), ModelSpec("lookup"), num_beams=20)


def test_results_last_wins_and_sinks(spark, tmp_path):
    scored = infer_and_write(_prompts(spark), ModelSpec("lookup"), str(tmp_path), "/data/pauq_test.json",
                             batch_size=4, max_seq_length=64)
    res = spark.read.parquet(str(tmp_path / "pauq_test_inference_result.pkl"))
    assert res.count() == 25
    last = {r.id: r.sql for r in results(scored).collect()}
    assert last["id0"] == "SELECT count(*) FROM t1"       # ord 25 wins over ord 0
    read = read_predictions(spark, str(tmp_path / "pauq_test_inference_result_sql_predictions.txt"))
    found = read.orderBy("line").collect()
    lines = [r["sql"] for r in found]
    assert [r["line"] for r in found] == list(range(30))
    want = [r.sql for r in scored.orderBy("ord").collect()]
    assert lines == want


def test_output_names():
    assert output_name("/x/pauq_test.json", False, "results") == "pauq_test_inference_result.pkl"
    assert output_name("/x/pauq_test.json", False, "predictions") == "pauq_test_inference_result_sql_predictions.txt"
    assert output_name("/x/a.b.json", True, "predictions") == "a_one_batch_inference_result_one_batch_sql_predictions.txt"


def test_strip_prompt(spark):
    df = spark.createDataFrame([([1, 2, 3, 4, 5], 3)], "seq array<int>, input_len int")
    assert strip_prompt(df).first().gen_ids == [4, 5]


def test_stream_matches_batch(spark):
    from sqlkiln.plans.registry import QUERIES

    s = sorted((r.id, r.text) for r in QUERIES["stream_prompts_test"](spark, SF).collect())
    b = sorted((r.id, r.text) for r in QUERIES["build_prompts_test"](spark, SF).collect())
    assert s == b and len(s) > 0


def test_stream_strict_lookup_fails_on_unknown_db(spark, tmp_path):
    import json as _json

    from conftest import F1_CATALOG
    from sqlkiln.operators import catalog as C
    from sqlkiln.sources.json_sources import read_catalog
    from sqlkiln.streaming.prompts import run_to_table, stream_prompts

    (tmp_path / "t.json").write_text(_json.dumps(F1_CATALOG))
    schemas = C.schema_strings(read_catalog(spark, str(tmp_path / "t.json")))
    rows = [(0, "a", "flat", "q", "SELECT a FROM t"), (1, "b", "nowhere", "q", "SELECT 1")]
    src = spark.createDataFrame(rows, "ord long, id string, db_id string, question string, query string")
    src.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))
    with pytest.raises(Exception, match="no schema string"):
        run_to_table(stream_prompts(stream, schemas, "train"), str(tmp_path / "out"), str(tmp_path / "ck"))
    ok = stream_prompts(spark.readStream.schema(src.schema).parquet(str(tmp_path / "in")), schemas, "train",
                        on_missing="drop")
    got = run_to_table(ok, str(tmp_path / "out2"), str(tmp_path / "ck2")).collect()
    assert [r.id for r in got] == ["a"]


def test_generate_batches_cut_by_partitions(spark):
    rows = [(i * 3, f"id{i}", f"QUESTION: w{'x' * (i % 5)} q\\nDATABASE SCHEMA: Table t{i % 4}, columns = [*,a]\\n")
            for i in range(100)]
    df = spark.createDataFrame(rows, "ord long, id string, text string")
    one = generate(df, ModelSpec("lookup"), batch_size=4, max_seq_length=40, num_partitions=1)
    many = generate(df, ModelSpec("lookup"), batch_size=4, max_seq_length=40, num_partitions=7)
    a = sorted(one.collect())
    b = sorted(many.collect())
    assert a == b
    assert sorted(r.batch_id for r in b) == [i // 4 for i in range(100)]
