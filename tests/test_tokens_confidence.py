import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sqlkiln.operators import confidence as SC
from sqlkiln.operators import tokens as TK
from sqlkiln.operators.inference import cut_at_eos, entropy_rows
from sqlkiln.operators.ordering import with_batch_id


# --- F8 ---------------------------------------------------------------------

def _ids(spark, rows):
    return spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, input_ids array<int>")


def test_pad_right_and_left(spark):
    df = _ids(spark, [[7], [1, 2, 3]])
    r = TK.pad(df, "input_ids", 0, "right").orderBy("i").collect()
    assert r[0].input_ids == [7, 0, 0] and r[0].attention_mask == [1, 0, 0]
    assert r[1].input_ids == [1, 2, 3] and r[1].attention_mask == [1, 1, 1]
    l_ = TK.pad(df, "input_ids", 0, "left").orderBy("i").collect()
    assert l_[0].input_ids == [0, 0, 7] and l_[0].attention_mask == [0, 0, 1]


def test_pad_sizes_property(spark):
    rows = [list(range(n)) for n in (0, 1, 5, 9, 2)]
    out = TK.pad(_ids(spark, rows), "input_ids", 0, "left").collect()
    assert {len(r.input_ids) for r in out} == {9}
    assert all(len(r.attention_mask) == 9 and sum(r.attention_mask) == len(rows[r.i]) for r in out)


def test_truncate(spark):
    out = TK.truncate(_ids(spark, [[1, 2, 3, 4, 5]]), "input_ids", 3).first()
    assert out.input_ids == [1, 2, 3]


def test_length_profile(spark):
    df = _ids(spark, [[1] * 2, [1] * 4, [1] * 10])
    r = TK.length_profile(df, "input_ids", 10).first()
    assert r.n_rows == 3 and r.n_at_limit == 1
    assert abs(r.mean_len_compat - 2.0) < 1e-12
    assert abs(r.mean_len - 16 / 3) < 1e-12


def test_completion_labels(spark):
    df = _ids(spark, [[1, 7, 8, 2, 7, 8, 3, 4], [1, 2, 3], [7], [7, 8]])
    out = TK.completion_labels(df, "input_ids", [7, 8]).orderBy("i").collect()
    assert out[0].labels == [-100] * 6 + [3, 4]
    assert out[1].labels == [-100] * 3
    assert out[2].labels == [-100]
    assert out[3].labels == [-100, -100]


def test_completion_labels_pad(spark):
    out = TK.completion_labels(_ids(spark, [[7, 8, 5, 0, 0]]), "input_ids", [7, 8], pad_id=0).first()
    assert out.labels == [-100, -100, 5, -100, -100]


@pytest.mark.parametrize("n,bs,want", [(1000, 96, (10, 770, 23)), (3, 96, (1, 77, 2))])
def test_step_budget(spark, n, bs, want):
    df = spark.range(n)
    r = TK.step_budget(df, 1, bs, 77).first()
    assert (r.steps_per_epoch, r.total_steps, r.warmup_steps) == want


def test_batch_ids(spark):
    df = spark.createDataFrame([(o,) for o in (10, 3, 7, 42, 5)], "ord long")
    got = {r.ord: r.batch_id for r in with_batch_id(df, 2).collect()}
    assert got == {3: 0, 5: 0, 7: 1, 10: 1, 42: 2}


def test_batch_ids_many_partitions(spark):
    df = spark.range(0, 1000, 1, 7).select((F.col("id") * 3).alias("ord"))
    got = sorted((r.ord, r.batch_id) for r in with_batch_id(df, 12).collect())
    assert got == [(3 * i, i // 12) for i in range(1000)]


def test_codepoints_roundtrip(spark):
    df = spark.createDataFrame([("a😀bé",), ("",), ("Σσ\n",)], "text string")
    out = TK.tokenize(df, "text", "ids").collect()
    assert [r.ids for r in out] == [[97, 128512, 98, 233], [], [931, 963, 10]]
    rt = TK.roundtrip_failures(df, "text", 1024).first()
    assert rt.n_checked == 3 and rt.n_failures == 0


def test_tokenize_udf_path_matches_native(spark):
    df = spark.createDataFrame([("a😀bé",), ("xyz",)], "text string")
    a = [r.ids for r in TK.tokenize(df, "text", "ids").collect()]
    b = [r.ids for r in TK.tokenize(df, "text", "ids", TK.TokenizerSpec("codepoint_arrow")).collect()]
    assert a == b


# --- F7 ---------------------------------------------------------------------

def _ent(spark, vecs):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vecs)], "i int, logits array<double>")
    return [r.entropy for r in SC.step_entropy(df, "logits").orderBy("i").collect()]


def test_entropy_goldens(spark):
    e = _ent(spark, [[1.0, 2.0, 3.0], [5.0] * 4, [0.0, 0.0, float("-inf")], [3.0, 1.0, 2.0]])
    assert abs(e[0] - 0.8323955818) < 1e-9
    assert abs(e[1] - math.log(4)) < 1e-12
    assert abs(e[2] - math.log(2)) < 1e-12
    assert abs(e[3] - e[0]) < 1e-12


def test_entropy_bounds_and_numpy(spark):
    rng = np.random.default_rng(7)
    vecs = (rng.normal(size=(50, 64)) * 5).tolist()
    got = _ent(spark, vecs)
    want = entropy_rows(np.array(vecs))
    assert np.allclose(got, want, atol=1e-10)
    assert all(0 <= g <= math.log(64) + 1e-12 for g in got)


def test_entropy_long_matches_array(spark):
    rng = np.random.default_rng(3)
    vecs = rng.normal(size=(20, 16)).tolist()
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vecs)], "i int, v array<double>")
    long_ = df.select("i", F.explode("v").alias("logit"))
    got = {r.i: r.entropy for r in SC.step_entropy_long(long_, ["i"], "logit").collect()}
    want = entropy_rows(np.array(vecs))
    assert all(abs(got[i] - want[i]) < 1e-10 for i in range(20))


def _trunc(spark, rows, mode):
    df = spark.createDataFrame(rows, "seq array<int>, scores array<double>, input_len int")
    out = SC.confidence(SC.truncate_scores(df, eos_id=9, mode=mode), "scores").collect()
    return [(r.scores, r.score) for r in out]


def test_truncate_compat_golden(spark):
    assert _trunc(spark, [([9, 5, 9, 7], [0.1, 0.5, 0.9], 1)], "compat") == [([0.1, 0.5], 0.5)]
    assert _trunc(spark, [([9, 9, 9, 11, 12, 5, 6], [0.2, 0.9], 5)], "compat") == [([0.2], 0.2)]


def test_truncate_aligned(spark):
    assert _trunc(spark, [([9, 9, 9, 11, 12, 5, 6], [0.2, 0.9], 5)], "aligned") == [([0.2, 0.9], 0.9)]
    assert _trunc(spark, [([1, 5, 6], [0.3, 0.1], 1)], "aligned") == [([0.3, 0.1], 0.3)]
    assert _trunc(spark, [([1, 9, 6], [0.3, 0.7], 1)], "aligned") == [([0.3], 0.3)]


def test_numpy_cut_matches():
    assert cut_at_eos(np.array([9, 5, 9, 7]), np.array([0.1, 0.5, 0.9]), {9}, 1).tolist() == [0.1, 0.5]
    assert cut_at_eos(np.array([1, 5, 6]), np.array([0.3, 0.1]), {9}, 1).tolist() == [0.3, 0.1]


def test_last_by_id(spark):
    df = spark.createDataFrame([("a", 0, "x", 0.1), ("b", 1, "y", 0.2), ("a", 2, "z", 0.3)],
                               "id string, ord int, sql string, score double")
    got = {r.id: (r.sql, r.score) for r in SC.results(df).collect()}
    assert got == {"a": ("z", 0.3), "b": ("y", 0.2)}


def test_truncate_scores_long(spark):
    rows = [("u", 1, 0.5, False), ("u", 2, 0.9, True), ("u", 3, 2.0, False), ("v", 1, 0.4, False)]
    df = spark.createDataFrame(rows, "k string, t int, s double, eos boolean")
    kept = SC.truncate_scores_long(df, ["k"], "t", "eos")
    got = {r.k: (r.n_steps, r.score) for r in SC.confidence_long(kept, ["k"], "s").collect()}
    assert got == {"u": (2, 0.9), "v": (1, 0.4)}


def test_completion_label_methods_agree(spark):
    from sqlkiln import fixed

    texts = ["<|start_header_id|>assistant<|end_header_id|>\n\nselect 1 ;<|eot_id|>",
             "a<b <c <|start_header_id|>assistant<|end_header_id|>\n\nx<|start_header_id|>assistant<|end_header_id|>\n\ny",
             "no header here", ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    hdr = [ord(c) for c in fixed.ASSISTANT_HEADER]
    native = TK.tokenize_with_labels(df, "text", fixed.ASSISTANT_HEADER).orderBy("i").collect()
    arrow = TK.tokenize_with_labels(df, "text", fixed.ASSISTANT_HEADER,
                                    spec=TK.TokenizerSpec("codepoint_arrow")).orderBy("i").collect()
    tok = TK.tokenize(df, "text", "input_ids")
    a = TK.completion_labels(tok, "input_ids", hdr).orderBy("i").collect()
    assert [r.labels for r in native] == [r.labels for r in a] == [r.labels for r in arrow]
    assert [r.input_ids for r in native] == [r.input_ids for r in arrow]
    assert native[1].labels[-1] == ord("y") and sum(x != -100 for x in native[1].labels) == 1
    assert all(x == -100 for x in native[2].labels)


def test_long_texts_become_ids_in_pieces():
    """A batch of long texts is never ids and labels at once."""
    import pyarrow as pa

    header = "<|h|>"
    texts = pa.array([None, ""] + [f"{i}{header}" + "é" * 3000 for i in range(400)])
    for max_len, pad_to in ((None, None), (2000, 2000)):
        made = list(TK._ids_and_labels(iter([texts, texts.slice(0, 0)]), header, TK.CODEPOINT, 0, max_len, pad_to))
        rows = [r for piece in made for r in piece.to_pylist()]
        assert max(len(piece.field("ids").flatten()) for piece in made) < TK.PIECE_IDS + 3100
        assert len(rows) == 402 and rows[0]["ids"] is None
        assert all(len(r["ids"]) == len(r["labels"]) == (pad_to or 3000 + len(f"{i}{header}")) for i, r in enumerate(rows[2:]))
        assert all(r["labels"][: len(f"{i}{header}") + 1] == [-100] * len(f"{i}{header}") + [233] for i, r in enumerate(rows[2:]))


def test_pieces_of_a_batch_are_whole_columns(spark):
    df = spark.createDataFrame([(i, None if i % 97 == 0 else f"{i}<h>" + "x" * (i % 3) * 500) for i in range(1500)], "i int, text string").coalesce(1)
    rows = TK.completion_labels(TK.tokenize(df, "text", "ids"), "ids", [ord(c) for c in "<h>"]).orderBy("i").collect()
    assert len(rows) == 1500 and sum(len(r.text or "") for r in rows) > 2 * TK.PIECE_IDS
    for r in rows:
        assert r.ids == (None if r.text is None else [ord(c) for c in r.text])
        n = len(f"{r.i}<h>")
        assert r.labels == (None if r.text is None else [-100] * n + [120] * (len(r.text) - n))
