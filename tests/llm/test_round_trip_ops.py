"""Token files, Merkle manifest and filter audit against brute force, and
their edge cases."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sqlkiln.llm import filter_audit, merkle, queries, text_trie, token_files
from sqlkiln.llm.common import table
from sqlkiln.llm.running import running

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, file string, grp string, idx string, proof int, mask string, part int, n int, id string"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls everywhere, ties, repeated rows, a very long text, clashing names."""
    long_text = " ".join(f"Word{i % 977} $" for i in range(40_000))
    rows = [(1, "a", "en", 5, "Same text"), (1, "a", "en", 5, "Same text"), (2, "a", None, None, "Same text"),
            (2, "b", "en", 9, "other"), (None, "b", "en", 9, "Same text"), (None, None, None, None, None), (3, None, "en", 0, ""),
            (4, "", "en", 0, None), (5, "a", "de", 1, long_text), (6, "b", "de", 1, long_text), (7, "solo", "de", 1, "é\x1c ß \n\t  x")]
    return spark.createDataFrame([(*r, *(None,) * 8) for r in rows], SCHEMA)


def rows_of(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


# --- running sums -----------------------------------------------------------

def test_running_sums(spark):
    draw = random.Random(0)
    data = [(draw.choice([None, "a", "b", "hot", "hot", "hot"]), draw.choice([None, *range(50)]), draw.randint(0, 9)) for _ in range(500)]
    frame = spark.createDataFrame(data, "g string, o int, w int").repartition(7)
    for weight in (None, "w"):
        got = collections.defaultdict(list)
        for r in running(frame, ["g"], ["o"], weight).collect():
            got[r["g"]].append((r["before"], r["o"], r["w"], r["whole"]))
        for g, found in got.items():
            found.sort(key=lambda r: r[0])
            assert len(found) == sum(x[0] == g for x in data)
            assert [r[1] for r in found] == sorted((x[1] for x in data if x[0] == g), key=lambda o: (o is not None, o or 0))
            at = 0
            for before, _, w, whole in sorted(found, key=lambda r: (r[0], r[2] if weight else 0)):
                assert before == at and whole == sum(w if weight else 1 for _, _, w, _ in found)
                at += w if weight else 1


# --- token files ---------------------------------------------------------------

def plain_tokens(rows):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    found, at = [], 0
    for doc_id, text in rows:
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 0]
        found.append((doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return found


def tokenizer_path():
    return pytest.importorskip("public_tokenizers").path(queries.TOKENIZER)


def test_op11_against_the_tokenizer(spark):
    rows = sorted(rows_of(table(spark, SF, "documents"), "doc_id", "text"))
    assert sorted(rows_of(queries.op11_token_files(spark, SF), "doc_id", "start", "n_tokens", "ids_crc32")) == plain_tokens(rows)


def test_pieces_give_the_ids_of_whole_texts():
    enc = token_files.Encoder(tokenizer_path(), remembered=50)
    assert enc.by_piece and enc.dtype is np.uint16
    draw = random.Random(3)
    some = ["a", "B", " ", "  ", "\n", "\t", "\r\n", "'s", "'ll", "12", "!", "é", "中", "<|endoftext|>", "😀", "'", "\x1c", "\x85", " ", "\xa0"]
    texts = ["".join(draw.choice(some) for _ in range(draw.randint(0, 16))) for _ in range(3000)]
    for at in range(0, len(texts), 100):
        got = enc.encode(texts[at : at + 100])
        want = [e.ids for e in enc.tokenizer.encode_batch(texts[at : at + 100], add_special_tokens=False)]
        assert [np.frombuffer(g, enc.dtype).tolist() for g in got] == want


def test_words_are_cut_where_the_tokenizer_cuts_them():
    """Letters, symbols and digits are remembered apart, so a word with other
    symbols beside it is not encoded again; the ids are those of the text."""
    enc = token_files.Encoder(tokenizer_path())
    assert len(enc.encode(["Zürich Zürich, Zürich%%% Zürich12."])) == 1
    assert set(enc.known) == {p.encode() for p in ("Zürich", " Zürich", ",", "%%%", "12", ".")}
    draw = random.Random(5)
    some = ["a", "É", "ß", "ſ", "×", "÷", "Ȁ", "ɏ", "ʰ", "é", "'", "'s", "'re", "'soup", "%'s", "''", "1", "²", "Ⅷ", "٣",
            "-", "%%%", ",", "中", "Ж", "\x00", "\x7f", "\u200b", " ", "  ", "\n", "\u3000", "\xa0", ""]
    texts = ["".join(draw.choice(some) for _ in range(draw.randint(0, 14))) for _ in range(6000)]
    for at in range(0, len(texts), 60):
        assert enc.encode(texts[at : at + 60]) == enc._ids(texts[at : at + 60])


def test_other_tokenizers_get_whole_texts():
    pytest.importorskip("public_tokenizers")
    import public_tokenizers

    enc = token_files.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    assert not enc.by_piece
    texts = ["Hello  World", "", "a\nb"]
    want = [e.ids for e in enc.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(g, enc.dtype).tolist() for g in enc.encode(texts)] == want


def test_sequences_are_views_of_the_mapped_file(spark, tmp_path):
    docs = table(spark, SF, "documents").repartition(3)
    manifest = token_files.write(docs, f"{tmp_path}/out", tokenizer_path(), seq_len=64, end_id=7).orderBy("part").collect()
    assert sum(r["documents"] for r in manifest) == docs.count()
    every = []
    for r in manifest:
        reader = token_files.Sequences(r["file"])
        assert len(reader) == r["sequences"] and -(-r["tokens"] // 64) == r["sequences"]
        ids, mask = reader[0]
        begin, end = ids.ctypes.data, ids.ctypes.data + ids.nbytes
        mapped = pa.memory_map(f"{r['file'].removeprefix('file:')}.arrow").size()
        assert not ids.flags.owndata and len(ids) == 64 and mapped > end - begin
        found = [reader[i] for i in random.Random(1).sample(range(len(reader)), min(9, len(reader)))]
        assert all(len(a) == 64 and (m.to_pylist() == [True] * 64 or a is not None) for a, m in found)
        flat = np.concatenate([reader[i][0][reader[i][1].to_numpy(zero_copy_only=False)] for i in range(len(reader))])
        assert len(flat) == r["tokens"]
        every.extend(flat.tolist())
        with pytest.raises(IndexError):
            reader[len(reader)]
    ids = [i for r in sorted(token_files.read_ids(spark, f"{tmp_path}/out").collect(), key=lambda r: r["start"]) for i in r["ids"]]
    assert ids == every and ids.count(7) >= docs.count()


def test_token_files_edges(spark, odd, tmp_path):
    token_files.write(odd, f"{tmp_path}/odd", tokenizer_path(), seq_len=100)
    got = sorted(token_files.read_ids(spark, f"{tmp_path}/odd").collect(), key=lambda r: r["start"])
    ids = [r["id"] for r in got]
    assert ids == sorted(rows_of(odd, "doc_id") and [r[0] for r in rows_of(odd, "doc_id")], key=lambda i: (i is not None, i or 0))
    want = collections.Counter((i, n, c) for i, _, n, c in plain_tokens(rows_of(odd, "doc_id", "text")))
    assert collections.Counter((r["id"], r["n_tokens"], token_files.crc32_of(np.array(r["ids"]))) for r in got) == want
    assert [r["start"] for r in got] == [0, *itertools.accumulate(r["n_tokens"] for r in got)][:-1]
    assert token_files.write(odd.where("false"), f"{tmp_path}/none", tokenizer_path()).count() == 0
    assert token_files.read_digests(spark, f"{tmp_path}/none").count() == 0
    named = odd.select(F.concat(F.lit("k"), "doc_id").alias("doc_id"), "text")
    token_files.write(named, f"{tmp_path}/named", tokenizer_path())
    assert {r["id"] for r in token_files.read_digests(spark, f"{tmp_path}/named", "string").collect()} == {None, *(f"k{i}" for i in range(1, 8))}


# --- Merkle ----------------------------------------------------------------------

def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_manifest(rows, fanout):
    """rows: (group, key, digest); (group, key, digest, subroot, root, proof)."""
    def tree(digests):
        proofs, nodes = [[] for _ in digests], [(h, [i]) for i, h in enumerate(digests)]
        while len(nodes) > 1:
            up = []
            for at in range(0, len(nodes), fanout):
                run = nodes[at : at + fanout]
                for k, (_, below) in enumerate(run):
                    for i in below:
                        proofs[i].append(("".join(h for h, _ in run[:k]), "".join(h for h, _ in run[k + 1 :])))
                up.append((sha("".join(h for h, _ in run)), [i for _, below in run for i in below]))
            nodes = up
        return nodes[0][0], proofs

    groups = collections.defaultdict(list)
    for g, key, digest in rows:
        groups[g].append((key is not None, key or 0, digest))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: tree([d for _, _, d in sorted(groups[g])]) for g in order}
    root, tops = tree([trees[g][0] for g in order])
    return sorted((str(g), k, key if has else None, d, trees[g][0], root, tuple(p + top))
                  for g, top in zip(order, tops) for k, ((has, key, d), p) in enumerate(zip(sorted(groups[g]), trees[g][1])))


def found_manifest(df):
    return sorted((str(r["grp"]), r["idx"], r["k"], r["digest"], r["subroot"], r["root"], tuple((p["left"], p["right"]) for p in r["proof"]))
                  for r in df.collect())


@pytest.mark.parametrize("fanout, epoch, groups, n", [(16, 3, 20, 900), (2, 2, 3, 70), (3, 1, 40, 90), (4, 2, 1, 257), (16, 1, 1, 16), (2, 3, 1, 1)])
def test_manifest_against_brute_force(spark, fanout, epoch, groups, n):
    draw = random.Random(n)
    rows = [(draw.choice([None, *map(str, range(groups - 1))]) if groups > 1 else "g", draw.choice([None, *range(n)]), sha(str(i))) for i in range(n)]
    frame = spark.createDataFrame(rows, "g string, k long, h string").repartition(5)
    got = merkle.manifest(frame, "g", ["k"], "h", ("k",), fanout, epoch)
    assert sorted(found_manifest(got), key=str) == sorted(plain_manifest(rows, fanout), key=str)
    assert merkle.verified(got, "digest").where("not verified").count() == 0


def test_tampering_is_found(spark):
    docs = rows_of(table(spark, SF, "documents"), "doc_id", "text")
    changed = {i for i, t in docs if zlib.crc32(str(i).encode()) % 5 == 0 and t and re.search("[A-Z]", t)}
    got = queries.op12_merkle_manifest(spark, SF).collect()
    assert {r["doc_id"] for r in got if not r["verified"]} == changed and changed
    assert len({r["root"] for r in got}) == 1


def test_manifest_edges(spark, odd, tmp_path):
    leaf = odd.withColumn("leaf", merkle.leaf_digest(*[F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]))
    rows = rows_of(leaf, "source", "doc_id", "leaf")
    enc = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    assert sorted(r[2] for r in rows) == sorted(sha("".join(map(enc, r))) for r in rows_of(odd, "doc_id", "source", "lang", "n_chars", "text"))
    got = merkle.manifest(leaf, "source", ["doc_id"], "leaf", ("doc_id",)).withColumnRenamed("doc_id", "k")
    assert sorted(found_manifest(got), key=str) == sorted(plain_manifest(rows, 16), key=str)
    one = merkle.manifest(leaf.where("source = 'solo'"), "source", ["doc_id"], "leaf").first()
    assert one["root"] == one["subroot"] == one["digest"] and one["proof"] == []
    assert merkle.manifest(leaf.where("false"), "source", ["doc_id"], "leaf").count() == 0
    assert merkle.store(leaf, "source", ["doc_id"], "leaf", f"{tmp_path}/m") == got.first()["root"]
    assert merkle.store(leaf.where("false"), "source", ["doc_id"], "leaf", f"{tmp_path}/e") is None


# --- filter audit ------------------------------------------------------------------

def plain_audit(rows, labels):
    """rows: (doc_id, part, text); the seven counts by the definition."""
    least = {}
    for i, _, t in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    fails = []
    for i, part, text in rows:
        t = text or ""
        words = [w for w in re.split(r"[\x20\x09-\x0d]+", t) if w]
        bad = {c for c, is_bad in (("A", len(words) < 50), ("B", 100 * len(set(words)) < 65 * len(words)),
                                   ("C", 100 * len(re.findall("[A-Z]", t)) > 5 * len(t)), ("D", bool(re.search(r"[#$%&*|]", t))),
                                   ("E", i is not None and least[t] < i)) if is_bad}
        fails.append((part or "", bad, *labels.get(i, (0, 0))))
    found = {}
    for part in {f[0] for f in fails}:
        mine, total = [f for f in fails if f[0] == part], collections.Counter()
        for order in map("".join, itertools.permutations("ABCDE")):
            left = list(mine)
            for step, c in enumerate(order, 1):
                gone = [f for f in left if c in f[1]]
                left = [f for f in left if c not in f[1]]
                total[c] += len(gone)
                found[part, order, step] = [len(left), len(gone), sum(c in f[1] for f in mine) - len(gone), sum(f[1] == {c} for f in mine),
                                            sum(f[2] for f in gone), sum(f[3] for f in gone)]
        for (p, order, step), row in found.items():
            if p == part:
                row.append(total[order[step - 1]])
    return sorted((*k, *v) for k, v in found.items())


COUNTS = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def run_audit(docs, labels):
    failed = filter_audit.failures(docs, filter_audit.quality_filters(F.col("text")))
    return sorted(rows_of(filter_audit.audit(filter_audit.reduce_masks(failed, labels), "ABCDE"), *COUNTS))


def test_op13_against_brute_force(spark):
    rows = rows_of(table(spark, SF, "documents"), "doc_id", "source", "text")
    labels = {r["doc_id"]: (r["quality"], r["toxic"]) for r in table(spark, SF, "labels").collect()}
    assert sorted(rows_of(queries.op13_filter_audit(spark, SF), *COUNTS)) == plain_audit(rows, labels)


def test_audit_edges(spark, odd, monkeypatch):
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (2, 0, 1), (2, 1, None), (None, 1, 1), (5, None, 1)], "doc_id long, quality int, toxic int")
    want = plain_audit(rows_of(odd, "doc_id", "source", "text"), {1: (1, 0), 2: (1, 1), 5: (0, 1)})
    assert {r[0] for r in want} == {"", "a", "b", "solo"}
    assert run_audit(odd, labels) == want
    monkeypatch.setattr(filter_audit, "LOCAL_BYTES", 10)  # a trie for every row
    assert run_audit(odd.repartition(4), labels) == want
    assert run_audit(odd.where("false"), labels) == []
    assert run_audit(odd, labels.where("false"))[0][-3:-1] == (0, 0)


def test_hot_text_and_hot_prefix(spark):
    """A third of the rows one text, a third one long prefix, many parts."""
    draw = random.Random(5)
    head = "licence line that very many documents share, word for word, " * 4
    rows = [(i, f"s{i % 3}", "the same" if i % 3 == 0 else head + str(draw.randint(0, 400)) if i % 3 == 1 else str(draw.random())) for i in range(3000)]
    draw.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(6)
    body = docs.select(F.col("text").cast("binary").alias("body"))
    bounds = text_trie.range_bounds(body, "body", most=2000)
    assert bounds == sorted(set(bounds)) and len(bounds) > 20
    ranges = collections.defaultdict(collections.Counter)
    for _, _, t in rows:
        ranges[sum(b <= t.encode() for b in bounds)][t] += len(t) + 1
    # Besides the copies of one text, which local tries fold, a range is light.
    assert all(sum(w.values()) - max(w.values()) <= 2000 for w in ranges.values())
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert run_audit(docs, labels) == plain_audit(rows, {})


def test_trie_holds_least_ids():
    draw = random.Random(2)
    trie, least, held = text_trie.Trie(), {}, []
    for i in range(4000):
        text = bytes(draw.choice(b"ab") for _ in range(draw.randint(0, 9))) * draw.choice([1, 1, 50])
        doc_id = draw.choice([None, draw.randint(0, 10_000)])
        held.append((text, trie.insert(text, doc_id)))
        if doc_id is not None:
            least[text] = min(doc_id, least.get(text, doc_id))
    assert all(node.least == least.get(text) for text, node in held)
    assert text_trie.common_prefix(b"", b"a") == 0 and text_trie.common_prefix(b"aab", b"aac") == 2
    for _ in range(500):
        a, b = (bytes(draw.choice(b"ab") for _ in range(draw.randint(0, 30))) for _ in range(2))
        assert text_trie.common_prefix(a, b) == next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
