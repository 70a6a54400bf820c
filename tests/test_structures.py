"""Aliases by query block, templates as text, merged softmax states, stop
sequences, checked commits, co-partitioned lookups, results on a stream."""

import collections
import math
import random

import numpy as np
import pytest
from pyspark.sql import Observation, functions as F

from sqlkiln import fixed
from sqlkiln.functions.sqlscope import resolve_aliases
from sqlkiln.functions.template import TemplateError, TextTemplate
from sqlkiln.operators import confidence as SC
from sqlkiln.operators.corpus import normalize_sql
from sqlkiln.operators.inference import cut_at_stops, end_at_stops, entropy_rows, stop_ends
from sqlkiln.operators.joins import attach_labels, attach_schema, write_copartitioned, zip_outputs
from sqlkiln.operators.prompts import DEFAULT_TEMPLATE, DEFAULT_TEXT_TEMPLATE, render, render_conversations
from sqlkiln.plans.prompts import pauq_prompts
from sqlkiln.session import broadcast_if_small, measured_bytes, shared_dir
from sqlkiln.sources.sinks import read_predictions, write_checked, write_predictions
from sqlkiln.streaming.results import read_last, stream_last_by_id

SF = "/root/testdata/sf0.001"

# --- aliases ------------------------------------------------------------------

GOLDENS = [
    ("select t1.name from singer as t1 join song as t2 on t1.id = t2.sid where t2.x = 't1.name' ;",
     "select singer.name from singer join song on singer.id = song.sid where song.x = 't1.name' ;"),
    ("select t1.a from x as t1 where t1.b in ( select t1.b from y as t1 where t1.c > 2 ) and t1.e > 1 ;",
     "select x.a from x where x.b in ( select y.b from y where y.c > 2 ) and x.e > 1 ;"),
    ("select a from x as t1 where exists ( select 1 from y as t2 where t2.k = t1.k ) ;",
     "select a from x where exists ( select 1 from y where y.k = x.k ) ;"),
    ("select t1.a from x as t1 union select t1.a from y as t1 except select t1.a from z t1 ;",
     "select x.a from x union select y.a from y except select z.a from z ;"),
    ("select t1.a from x as t1 where t1.b in ( select t1.c from y as t1 union select t1.d from z as t2 ) ;",
     "select x.a from x where x.b in ( select y.c from y union select x.d from z ) ;"),
    ("select t1.a , t2.b from x t1 , y t2 where t1.a = t2.a ;", "select x.a , y.b from x , y where x.a = y.a ;"),
    ("select t1.a from ( select t2.a from z as t2 ) as t1 join w as t3 on t1.a = t3.a ;",
     "select t1.a from ( select z.a from z ) as t1 join w on t1.a = w.a ;"),
    ("select max ( t1.a , t1.b ) from x as t1 join y as t2 on f ( t1.a , t2.b ) = 1 , z as t3 where t3.q = t10.x ;",
     "select max ( x.a , x.b ) from x join y on f ( x.a , y.b ) = 1 , z where z.q = t10.x ;"),
    ("select t1.* , t10.b , t1x from a as t1 join b as t10 on t1.i = t10.i ;", "select a.* , b.b , t1x from a join b on a.i = b.i ;"),
    ("select t1.a from a as t1 join b as t1 on 1 = 1 ;", "select b.a from a join b on 1 = 1 ;"),
    ("select a from ( x as t1 join y as t2 on t1.i = t2.i ) where t2.j = 'as t1 t1.i' ;",
     "select a from ( x join y on x.i = y.i ) where y.j = 'as t1 t1.i' ;"),
    ("select count ( * ) from t1 ;", "select count ( * ) from t1 ;"),
    ("select x from t as t1 where t1.a = 'it''s t1' ;", "select x from t where t.a = 'it''s t1' ;"),
    (") t1 (", ") t1 ("), ("", ""), (None, None),
]


@pytest.mark.parametrize("sql, want", GOLDENS)
def test_aliases_by_block(sql, want):
    assert resolve_aliases(sql) == want


def test_token_mode_in_the_job(spark):
    raw = [("SELECT T1.name FROM singer AS T1 WHERE T1.note = \"T1 as t1\"",), (None,)]
    df = spark.createDataFrame(raw, "q string")
    got = [r["q"] for r in normalize_sql(df, "q", alias_mode="token").collect()]
    assert got == ["select singer.name from singer where singer.note = 'T1 as t1' ;", None]
    assert normalize_sql(df, "q").first()["q"] == "select singer.name from singer where singer.note = 'T1 as singer' ;"
    with pytest.raises(ValueError):
        normalize_sql(df, "q", alias_mode="words")


# --- templates -----------------------------------------------------------------

CHATS = [[("system", "  be brief \n"), ("user", "hi"), ("assistant", " ok ")], [("user", "")], []]


def rendered(spark, template, generation=False):
    df = spark.createDataFrame([(i, [(r, c) for r, c in chat]) for i, chat in enumerate(CHATS)], "i int, chat array<struct<role:string,content:string>>")
    return [r["text"] for r in df.orderBy("i").select(render("chat", generation, template).alias("text")).collect()]


@pytest.mark.parametrize("generation", [False, True])
def test_default_template_text_gives_the_same_bytes(spark, generation):
    assert rendered(spark, DEFAULT_TEXT_TEMPLATE, generation)[:2] == rendered(spark, DEFAULT_TEMPLATE, generation)[:2]


def test_other_templates_differ_by_their_text(spark):
    chatml = TextTemplate(fixed.CHATML_TEMPLATE)
    assert rendered(spark, chatml, True) == [
        "".join(f"<|im_start|>{r}\n{c}<|im_end|>\n" for r, c in chat) + "<|im_start|>assistant\n" for chat in CHATS]
    said = TextTemplate("""{{ bos_token }}{# a note #}
{%- for m in messages %}
    {%- if m.role == 'system' and loop.first %}
[SYS]{{ m.content | trim | upper }}
    {%- elif not loop.last or m['role'] != "user" %}
{{ loop.index0 }}/{{ loop.index }}:{{ m['content'] }}
    {% else %}
last {{ (m.role ~ '-') + m.content }}
    {%- endif %}
{%- endfor %}{{ eos_token }}""", "<s>", "</s>")
    assert rendered(spark, said) == ["<s>[SYS]BE BRIEF1/2:hi\n2/3: ok \n</s>", "<s>last user-</s>", "<s></s>"]


def test_set_and_scopes(spark):
    t = TextTemplate("{% set who = 'A' %}{% if messages[0]['role'] == 'user' %}{% set who = 'B' %}{% endif %}{{ who }}"
                     "{% for m in messages %}{% set who = m.role %}{{ who }}{% endfor %}{{ who }}")
    assert rendered(spark, t) == ["AsystemuserassistantA", "BuserB", "AA"]


@pytest.mark.parametrize("source", [
    "{% macro x() %}{% endmacro %}", "{{ nobody }}", "{{ messages | tojson }}", "{% for m in messages %}{{ m.content }}", "{% if true %}",
    "{{ messages[1:] }}", "{% for m in messages %}{{ m.tools }}{% endfor %}", "{{ 'a' 'b' }}", "{{ 1 +  }}", "{{ messages }}", "{% set x %}",
    "{% for a, b in messages %}{% endfor %}", "{{ raise_exception('x') }}", "{{ 3 * 4 }}"])
def test_unknown_syntax_is_an_error(spark, source):
    with pytest.raises(TemplateError):
        TextTemplate(source).render(F.col("chat"), False)


def test_a_null_turn_is_an_error_in_any_template(spark):
    chats = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", None)], "conv_id int, turn int, role string, text string")
    for template in (DEFAULT_TEXT_TEMPLATE, TextTemplate(fixed.CHATML_TEMPLATE)):
        with pytest.raises(Exception, match="without content, role assistant"):
            render_conversations(chats, template=template).collect()


# --- softmax states -----------------------------------------------------------------

def test_softmax_states_merge(spark):
    draw = np.random.default_rng(2)
    rows = []
    for key in range(12):
        x = draw.normal(size=int(draw.integers(1, 60))) * draw.choice([1, 300])
        if key % 3 == 0:
            x[:: 4] = -np.inf
        rows += [("k" if key % 2 else None, key, float(v)) for v in x]
    rows += [("nan", 1, None), ("nan", 1, 0.5), ("nan", 1, 0.5), ("flat", 1, float("-inf"))]
    df = spark.createDataFrame(rows, "a string, b int, logit double").repartition(9)
    got = {(r["a"], r["b"]): r["entropy"] for r in SC.step_entropy_long(df, ["a", "b"]).collect()}
    want = collections.defaultdict(list)
    for a, b, v in rows:
        if v is not None:
            want[a, b].append(v)
    assert got.keys() == want.keys() and math.isnan(got["flat", 1]) and got["nan", 1] == pytest.approx(math.log(2))
    for key, x in want.items():
        if key != ("flat", 1):
            x = [v for v in x if v != float("-inf")] or x
            assert got[key] == pytest.approx(entropy_rows(np.array([x]))[0], abs=1e-9)
    assert SC.step_entropy_long(df.where("false"), ["a", "b"]).count() == 0


def test_softmax_has_one_shuffle_and_no_join(spark):
    df = spark.createDataFrame([(1, 0.5)], "k int, logit double")
    plan = SC.step_entropy_long(df, ["k"])._jdf.queryExecution().sparkPlan().toString()
    full = SC.step_entropy_long(df, ["k"])._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and full.count("Exchange") == 1 and full.count("Scan") == 1


def test_a_hot_key_shuffles_states(spark):
    n = 200_000
    df = spark.range(n).select(F.lit(1).alias("k"), (F.col("id") % 1000 / 100).alias("logit"))
    got = SC.step_entropy_long(df, ["k"])
    assert got.first()["entropy"] == pytest.approx(entropy_rows(np.tile(np.arange(1000) / 100, n // 1000)[None])[0], abs=1e-9)


# --- stop sequences ---------------------------------------------------------------------

def test_stops_against_substring_search(spark):
    draw = random.Random(4)
    stops = ["ab", "abc", "c;", ";", "xyz"]
    texts = ["".join(draw.choice("abcxyz") if draw.random() < 0.97 else ";" for _ in range(draw.randint(0, 12))) for _ in range(400)] + [None]
    df = spark.createDataFrame([(i, None if t is None else [ord(c) for c in t]) for i, t in enumerate(texts)], "i int, ids array<int>").repartition(3)
    got = {r["i"]: r["kept"] for r in cut_at_stops(df, "ids", [[ord(c) for c in s] for s in stops]).collect()}
    for i, t in enumerate(texts):
        ends = [t.find(s) + len(s) for s in stops if s in t] if t is not None else []
        assert got[i] == (None if t is None else min(ends, default=len(t)))
    with pytest.raises(ValueError):
        cut_at_stops(df, "ids", [[]])
    assert cut_at_stops(df.where("false"), "ids", [[1]]).count() == 0


def test_stops_do_not_cross_lists():
    assert stop_ends(np.array([1, 2, 1, 2, 9]), np.array([0, 1, 3, 3, 5]), [[1, 2], [2, 1]]).tolist() == [1, 2, 0, 2]


def test_what_follows_a_stop_is_padding():
    seqs = np.array([[0, 5, 7, 8, 9], [5, 5, 9, 7, 8], [5, 7, 8, 1, 1]])
    assert end_at_stops(seqs, 2, [[7, 8], [0]], 0).tolist() == [[0, 5, 7, 8, 0], [5, 5, 9, 7, 8], [5, 7, 8, 1, 1]]


# --- checked commits, lookups, positions ---------------------------------------------------

SAMPLES = "ord long, id string, db_id string, question string, query string"


def test_a_write_commits_only_without_unmatched_rows(spark, tmp_path):
    schemas = spark.createDataFrame([("d", "s")], "db_id string, schema_str string")
    good = spark.createDataFrame([(i, str(i), "d", "q", "select 1") for i in range(9)], SAMPLES)
    for bad, name in ((good, "good"), (good.unionAll(spark.createDataFrame([(9, "9", "nowhere", "q", "x"), (10, "a", None, "q", "x")], SAMPLES)), "bad")):
        check = Observation()
        made = pauq_prompts(bad, schemas, "train", on_missing=check)
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Join") == 1 and "CollectMetrics" in plan
        if name == "good":
            write_checked(made, f"{tmp_path}/{name}", [check])
            assert spark.read.parquet(f"{tmp_path}/{name}").count() == 9
            with pytest.raises(FileExistsError):
                write_checked(good, f"{tmp_path}/{name}", [])
        else:
            with pytest.raises(KeyError, match="2 rows without schema string for db_id"):
                write_checked(made, f"{tmp_path}/{name}", [check])
    assert sorted(p.name for p in tmp_path.iterdir()) == ["good"]


def test_labels_and_schemas_can_be_checked_together(spark, tmp_path):
    q = spark.createDataFrame([("1", "d"), ("2", "d"), ("3", "e")], "id string, db_id string")
    labels = spark.createDataFrame([("1", "x"), ("2", None)], "id string, sql string")
    schemas = spark.createDataFrame([("d", "s")], "db_id string, schema_str string")
    first, second = Observation(), Observation()
    made = attach_schema(attach_labels(q, labels, on_missing=first), schemas, on_missing=second)
    with pytest.raises(KeyError, match="1 rows without label for id 3"):
        write_checked(made, f"{tmp_path}/out", [first, second])
    assert not list(tmp_path.iterdir())


def test_copartitioned_lookups_do_not_shuffle(spark):
    q = spark.range(1000).select(F.col("id").cast("string"), F.lit("q").alias("question"))
    labels = q.where("id % 3 > 0").select("id", F.concat(F.lit("l"), "id").alias("sql"))
    a = write_copartitioned(q, "copart_q", shared_dir(spark, "q"), "id", 4)
    b = write_copartitioned(labels, "copart_l", shared_dir(spark, "l"), "id", 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = attach_labels(a, b, on_missing="drop")
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
        plain = attach_labels(q, labels, on_missing="drop")
        assert sorted(map(tuple, joined.collect())) == sorted(map(tuple, plain.collect())) and joined.count() == 666
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for name in ("copart_q", "copart_l"):
            spark.sql(f"drop table {name}")


def test_outputs_zip_by_position(spark):
    ids = spark.createDataFrame([(0, "a"), (1, "b"), (2, "a")], "ord long, id string")
    sql = spark.createDataFrame([(2, "z"), (0, "x"), (1, "y")], "ord long, sql string")
    score = spark.createDataFrame([(0, 0.5), (2, 0.1)], "ord long, score double")
    assert sorted(map(tuple, zip_outputs(ids, sql, score).collect())) == [(0, "a", "x", 0.5), (1, "b", "y", None), (2, "a", "z", 0.1)]
    with pytest.raises(KeyError, match="occurs twice"):
        zip_outputs(ids, sql.unionAll(sql))
    with pytest.raises(KeyError, match="has no id"):
        zip_outputs(ids.where("ord < 2"), sql)


def test_nested_values_are_measured(spark):
    df = spark.range(50).select(F.array(*[F.struct(F.repeat(F.lit("x"), 300).alias("s"))] * 3).alias("a"), F.map_from_arrays(
        F.array(F.lit("k")), F.array(F.repeat(F.lit("y"), 100))).alias("m"), F.lit(None).cast("string").alias("n"))
    assert 50 * 1000 < measured_bytes(df) < 50 * 1200
    assert measured_bytes(df.where("false")) == 0
    assert "ResolvedHint" in broadcast_if_small(df, 10**6)._jdf.queryExecution().analyzed().toString()
    assert "ResolvedHint" not in broadcast_if_small(df, 40_000)._jdf.queryExecution().analyzed().toString()


def test_prediction_lines_have_their_number(spark, tmp_path):
    rows = [(i * 7 % 101, f"select {i * 7 % 101}" if i % 10 else None) for i in range(101)]
    df = spark.createDataFrame(rows, "ord long, sql string").repartition(5)
    spark.conf.set("spark.sql.files.maxRecordsPerFile", "9")  # many part files
    try:
        write_predictions(df, f"{tmp_path}/p")
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    got = sorted(map(tuple, read_predictions(spark, f"{tmp_path}/p").collect()))
    assert got == [(o, s or "") for o, s in sorted(rows)]
    assert len(list((tmp_path / "p").glob("part-*"))) > 8
    victim = next((tmp_path / "p").glob("part-*"))
    victim.write_text("one line\n")
    (tmp_path / "p" / f".{victim.name}.crc").unlink(missing_ok=True)
    with pytest.raises(Exception, match="not the lines of the manifest"):
        read_predictions(spark, f"{tmp_path}/p").collect()
    with pytest.raises(Exception, match="line break"):
        write_predictions(spark.createDataFrame([(0, "a\nb")], "ord long, sql string"), f"{tmp_path}/q")
    write_predictions(df.where("false"), f"{tmp_path}/none")
    assert read_predictions(spark, f"{tmp_path}/none").count() == 0


# --- results on a stream ---------------------------------------------------------------------

def test_last_by_id_across_batches_runs_and_replays(spark, tmp_path):
    draw = random.Random(6)
    rows = [(draw.choice("abcdefgh"), o, f"v{o}") for o in range(300)]
    draw.shuffle(rows)
    for part in range(3):
        spark.createDataFrame(rows[part * 80 : part * 80 + 80], "id string, ord long, sql string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    def stream():
        return spark.readStream.schema("id string, ord long, sql string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")

    def state():
        return {r["id"]: (r["ord"], r["sql"]) for r in read_last(spark, f"{tmp_path}/out").collect()}

    def want(n):
        return {i: (o, v) for i, o, v in sorted(rows[:n], key=lambda r: r[1])}

    stream_last_by_id(stream(), f"{tmp_path}/out", f"{tmp_path}/ck")
    assert state() == want(240)
    batches = sorted(p.name for p in (tmp_path / "out").iterdir())
    stream_last_by_id(stream(), f"{tmp_path}/out", f"{tmp_path}/ck")  # nothing new
    assert state() == want(240)
    spark.createDataFrame(rows[240:], "id string, ord long, sql string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream_last_by_id(stream(), f"{tmp_path}/out", f"{tmp_path}/ck")  # goes on where it stopped
    assert state() == want(300) and len(list((tmp_path / "out").iterdir())) > len(batches)
    stream_last_by_id(stream(), f"{tmp_path}/out", f"{tmp_path}/ck2")  # every batch again
    assert state() == want(300)
    with pytest.raises(ValueError):
        stream_last_by_id(spark.read.parquet(f"{tmp_path}/in"), "x", "y")
