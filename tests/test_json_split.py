"""JSON files cut anywhere give the rows that ``json.load`` gives."""

import json
import random

import pytest
from pyspark.sql import functions as F

from sqlkiln.sources import json_sources as src
from sqlkiln.sources import json_split as J
from sqlkiln.sources.json_split import MalformedJson, read_elements
from sqlkiln.sources.sinks import write_json_parts

TEXTS = ["", "a", 'say "hi"', "back\\slash", "{", "}", "[1]", "],{", '"}', ',"k":', "é\n\t", "{\"x\":\"}\"}", "\\\"", "\\\\"]


def random_value(draw, deep=0):
    kind = draw.random()
    if kind < 0.5 or deep > 2:
        return draw.choice([*TEXTS, None, True, 7, 1.5])
    if kind < 0.75:
        return [random_value(draw, deep + 1) for _ in range(draw.randint(0, 3))]
    return {draw.choice(TEXTS) + str(k): random_value(draw, deep + 1) for k in range(draw.randint(0, 3))}


def simulated(text, kind, groups):
    """The two passes over the fragments of one file, cut into ``groups`` of
    fragments as Spark's splits would be."""
    mark = J.SEPARATOR[kind]
    fragments = text.split(mark)
    if text.endswith(mark):
        fragments.pop()
    splits = [[f for f, g in zip(fragments, groups(len(fragments))) if g == k] for k in sorted(set(groups(len(fragments))))]
    reports = []
    for k, split in enumerate(splits):
        scans = (J.Scan(False), J.Scan(True))
        for f in split:
            for scan in scans:
                scan.take(f + mark, mark)
        head = next((c for f in split for c in (f + mark).strip()[:1]), "")
        reports.append({"file": "f", "start": k, "size": len(text.encode()), "bytes": sum(len(f.encode()) + 1 for f in split), "head": head,
                        "quoted": [s.quoted for s in scans], "depth": [s.depth for s in scans], "ends": [s.ends for s in scans]})
    starts, targets = J._starts(reports, kind, "row")
    if targets["f"] == 2:
        counted = []
        for k, split in enumerate(splits):
            scan = J.Elements(kind, 2, starts["f", k])
            for f in split:
                list(scan.take(f + mark))
            counted.append({"file": "f", "start": k, "containers": [{"wanted": w, "elements": n} for w, n in scan.counts]})
        starts = J._placed(starts, counted, "row")
    parts = {}
    for k, split in enumerate(splits):
        scan = J.Elements(kind, targets["f"], starts["f", k])
        for f in split:
            for at, found in scan.take(f + mark):
                parts.setdefault(at, []).append(found)
        parts.setdefault(scan.position, []).extend(scan.held)
    joined = {at: "".join(p).strip(" \n\t,") for at, p in parts.items()}
    return [json.loads(t if kind == "array" else "{" + t + "}") for _, t in sorted(joined.items()) if t]


@pytest.mark.parametrize("seed", range(6))
def test_every_grouping_of_fragments(seed):
    draw = random.Random(seed)
    for _ in range(120):
        rows = [{f"{draw.choice(TEXTS)}{k}": random_value(draw) for k in range(draw.randint(0, 3))} for _ in range(draw.randint(0, 5))]
        indent, ascii_ = draw.choice([None, 1]), draw.random() < 0.5
        whole = {"version": random_value(draw), "x": {"data": [{"no": 1}]}, "data": rows, "z": [{"data": [{}]}], "last": random_value(draw)}
        keys = list(whole)
        draw.shuffle(keys)
        labels = {f"{draw.choice(TEXTS)}{k}": draw.choice([*TEXTS, None]) for k in range(draw.randint(0, 5))}
        for groups in (lambda n: [0] * n, lambda n: list(range(n)), lambda n: [i // 2 for i in range(n)]):
            end = draw.choice(["", "\n", " \n"])
            assert simulated(json.dumps(rows, indent=indent, ensure_ascii=ascii_) + end, "array", groups) == rows
            assert simulated(json.dumps({k: whole[k] for k in keys}, indent=indent, ensure_ascii=ascii_) + end, "array", groups) == rows
            assert simulated(json.dumps(labels, indent=indent) + end, "object", groups) == [{k: v} for k, v in labels.items()]


@pytest.fixture
def small_splits(spark):
    """Sets the bytes of a split; the default comes back afterwards."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    yield lambda n: (spark.conf.set(names[0], str(n)), spark.conf.set(names[1], "1"))
    for name in names:
        spark.conf.unset(name)


SAMPLES = [{"id": str(i), "db_id": "d", "question": TEXTS[i % len(TEXTS)] * (1 + i % 3), "query": f"select '{TEXTS[-1 - i % len(TEXTS)]}'"}
           for i in range(40)]


@pytest.mark.parametrize("size", [3, 64, 10**9])
@pytest.mark.parametrize("wrapped", [False, True])
def test_one_file_cut_at_every_size(spark, tmp_path, small_splits, size, wrapped):
    rows = SAMPLES[:6] if size < 7 else SAMPLES
    held = {"version": "v}1", "data": rows, "more": [{"id": "x"}]} if wrapped else rows
    (tmp_path / "data.json").write_text(json.dumps(held, indent=size % 2 or None, ensure_ascii=size % 3 == 0))
    small_splits(size)
    got = src.read_ehrsql_questions(spark, str(tmp_path)).orderBy("ord").collect()
    assert [(r["ord"], r["id"], r["question"]) for r in got] == [(k, s["id"], s["question"]) for k, s in enumerate(rows)]


@pytest.mark.parametrize("size", [5, 10**9])
def test_labels_cut_at_every_size(spark, tmp_path, small_splits, size):
    pairs = [(f"{t},{k}", v) for k, (t, v) in enumerate(zip(TEXTS, [*TEXTS[1:], None]))]
    text = json.dumps(dict(pairs))[:-1] + ', "a,1" : "again"}\n'
    (tmp_path / "label.json").write_text(text)
    small_splits(size)
    got = {r["id"]: r["sql"] for r in src.read_ehrsql_labels(spark, str(tmp_path)).collect()}
    assert got == json.loads(text) and got["a,1"] == "again"


def test_one_large_file_is_read_in_many_tasks(spark, tmp_path, small_splits):
    rows = [{"id": str(i), "db_id": "d", "question": "q" * (i % 50), "query": "s" * 200} for i in range(3000)]
    rows[1500]["question"] = "}" * 100_000  # one element over many splits
    (tmp_path / "big.json").write_text(json.dumps(rows))
    small_splits(20_000)
    fragments = J._fragments(spark, str(tmp_path / "big.json"), "array")
    assert fragments.rdd.getNumPartitions() > 20
    assert J._reports(fragments, "array").where("fragments > 0").count() > 20
    got = src.read_pauq(spark, str(tmp_path / "big.json"))
    assert [(r["ord"], r["id"], r["question"]) for r in got.orderBy("ord").collect()] == [(i, r["id"], r["question"]) for i, r in enumerate(rows)]


def test_folders_rank_by_name_and_empty_arrays_count_for_nothing(spark, tmp_path):
    for name, rows in (("b.json", SAMPLES[2:4]), ("a.json", SAMPLES[:2]), ("c.json", []), ("d.json", SAMPLES[4:5])):
        (tmp_path / name).write_text(json.dumps(rows))
    got = src.read_pauq(spark, str(tmp_path)).orderBy("ord").collect()
    assert [(r["ord"] >> 32, r["ord"] & 0xFFFFFFFF, r["id"]) for r in got] == [(0, 0, "0"), (0, 1, "1"), (1, 0, "2"), (1, 1, "3"), (3, 0, "4")]


# What the fold of the reports finds, and what shows in the rows.
UNFINISHED = [("array", t) for t in ('[{"a":1}', '{"a":[{}]}', '[{"a":"x}]', " ", "5", '[{"a":1}]]', '[{"a":1}]}', '{"data":[{}],"data":[{}]}')]
UNFINISHED += [("object", t) for t in ('{"a":1', "[1]", '{"a":1}}')]
BAD_ARRAYS = ['[{"a":1},]', '[{"a":1}{"b":2}]', '[1]', '[{"a":1},2]', '[,{"a":1}]', '[{"a":}]', ""]
BAD_OBJECTS = ['{"a":1,}', "{1:2}", ""]


@pytest.mark.parametrize("kind, text", UNFINISHED)
def test_files_that_end_early_fail(kind, text):
    for groups in (lambda n: [0] * n, lambda n: list(range(n))):
        with pytest.raises(MalformedJson):
            simulated(text, kind, groups)


@pytest.mark.parametrize("kind, text", [("array", t) for t in BAD_ARRAYS] + [("object", t) for t in BAD_OBJECTS])
def test_malformed_files_fail(spark, tmp_path, kind, text):
    (tmp_path / "x.json").write_text(text)
    with pytest.raises(Exception, match="x.json|Malformed|MALFORMED"):
        found = read_elements(spark, str(tmp_path / "x.json"), kind, "row")
        if kind == "array":
            found = found.withColumn("r", F.from_json("text", "STRUCT<a:STRING>", {"mode": "FAILFAST"}))
        found.collect()


def test_the_error_names_the_file(spark, tmp_path):
    (tmp_path / "broken.json").write_text('[{"a":1}')
    with pytest.raises(MalformedJson, match="broken.json"):
        read_elements(spark, str(tmp_path / "broken.json"), "array", "row")


def test_json_lines_of_questions_and_labels(spark, tmp_path):
    (tmp_path / "data.jsonl").write_text('{"ord":1,"id":"b","question":"y"}\n{"ord":0,"id":"a","question":"x"}\n')
    (tmp_path / "label.jsonl").write_text('{"ord":0,"id":"a","sql":"1"}\n{"ord":2,"id":"a","sql":null}\n{"ord":1,"id":"a","sql":"2"}\n')
    assert [tuple(r) for r in src.read_ehrsql_questions(spark, str(tmp_path), "jsonl").orderBy("ord").collect()] == [(0, "a", "x"), (1, "b", "y")]
    assert [tuple(r) for r in src.read_ehrsql_labels(spark, str(tmp_path), "jsonl").collect()] == [("a", None)]


def test_arrays_written_by_tasks_read_back(spark, tmp_path, small_splits):
    rows = [(i, str(i), "d", TEXTS[i % len(TEXTS)] * 3, "s") for i in range(500)]
    frame = spark.createDataFrame(rows, "ord long, id string, db_id string, question string, query string").repartition(3)
    write_json_parts(frame, f"{tmp_path}/parts")
    for part in (tmp_path / "parts").glob("part-*"):
        json.loads(part.read_text())
    small_splits(700)
    got = src.read_pauq(spark, f"{tmp_path}/parts").orderBy("ord").collect()
    assert [(r["id"], r["question"]) for r in got] == [(r[1], r[3]) for r in rows]
    write_json_parts(frame.where("false"), f"{tmp_path}/none")
    assert src.read_pauq(spark, f"{tmp_path}/none").count() == 0


def test_batches_of_long_elements_are_bounded():
    """Elements are handed out, and written, by bytes and not by thousands."""
    import pyarrow as pa

    from sqlkiln.sources.sinks import _bracketed

    rows = [json.dumps({"k": k, "v": "x" * 20_000}) for k in range(400)]
    written = list(_bracketed(iter([pa.RecordBatch.from_pydict({"value": rows})])))
    assert max(b.nbytes for b in written) < 2 * J.PIECE_BYTES
    text = "".join(v for b in written for v in b.column(0).to_pylist())
    assert json.loads(text) == [json.loads(r) for r in rows]
    fragments = text.split("}")
    batch = pa.RecordBatch.from_pydict({"file": ["f"] * len(fragments), "start": [0] * len(fragments), "value": fragments})
    start = J.Start(False, 0, False, 0, len(rows))
    found = list(J._found(iter([batch, batch.slice(0, 0)]), "array", {("f", 0): start}, {"f": 1}))
    assert max(b.nbytes for b in found) < 2 * J.PIECE_BYTES
    elements = [t.lstrip(",") for b in found for t in b.column("text").to_pylist()]
    assert [json.loads(t) for t in elements] == [json.loads(r) for r in rows]
