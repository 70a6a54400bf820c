"""Spark normalisation and cleaning against the independent DuckDB chain on
seeded random SQL-like strings."""

import random

import duckdb
import pandas as pd
import pytest

from sqlkiln import oracle as O
from sqlkiln.operators.corpus import clean_questions, normalize_sql

WORDS = ["select", "SELECT", "from", "FROM", "order by", "ORDER BY", "as", "AS", "t1", "T1", "t10", "T2", "join",
         "count(*)", "a", "b.c", "T1.name", "desc", "asc", "description", "Имя", "Город", "'It T1'", '"Bob"',
         "'x y'", ">=", "<=", "!=", "<>", "=", ",", ";", "(", ")", "1.5", "+", "-", "\t", "  ", " ", "\u001c",
         "where", "group by", "limit 3", "||", "==", "x_1", "Σ"]


def _strings(n, seed):
    rnd = random.Random(seed)
    return [" ".join(rnd.choice(WORDS) for _ in range(rnd.randint(0, 14))) for _ in range(n)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_normalize_matches_duckdb(spark, seed):
    rows = _strings(200, seed)
    df = spark.createDataFrame([(i, s) for i, s in enumerate(rows)], "id int, sql string")
    got = {r.id: r.sql for r in normalize_sql(df, "sql").collect()}
    con = duckdb.connect()
    con.register("src", pd.DataFrame({"id": range(len(rows)), "sql": rows}))
    ctes, last = O.normalize_ctes("src", "sql", "id")
    want = dict(con.execute(f"WITH {ctes} SELECT id, sql FROM {last}").fetchall())
    bad = [(rows[i], got[i], want[i]) for i in got if got[i] != want[i]]
    assert not bad, bad[:3]


def test_clean_matches_duckdb(spark):
    rows = _strings(300, 9) + ["\t‘a’\n“b”　", "\n\n", ""]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(rows)], "id int, q string")
    got = {r.id: r.q for r in clean_questions(df, "q").collect()}
    con = duckdb.connect()
    con.register("src", pd.DataFrame({"id": range(len(rows)), "q": rows}))
    want = dict(con.execute(f"SELECT id, {O.clean_question('q')} FROM src").fetchall())
    assert got == want


def test_clean_goldens(spark):
    pairs = [("\t‘a’\n“b”　", "'a''b'"), (" x\ty ", "xy"), ("\n\n", ""), ("a \n b", "a  b"), ("it’s\t“so”\n", "it's'so'")]
    df = spark.createDataFrame([(i, q) for i, (q, _) in enumerate(pairs)], "id int, q string")
    got = {r.id: r.q for r in clean_questions(df, "q").collect()}
    assert [got[i] for i in range(len(pairs))] == [want for _, want in pairs]


def test_normalize_goldens(spark):
    pairs = [
        ("SELECT a FROM t WHERE n = 'it''s Big'", "select a from t where n = 'it''s Big' ;"),
        ("SELECT T1.a FROM (SELECT b FROM x AS T2) JOIN y AS T1 ON T1.k = T2.k",
         "select y.a from ( select b from x ) join y on y.k = x.k ;"),
        ("SELECT T1.a FROM x AS T1 UNION SELECT T1.b FROM y AS T1", "select y.a from x union select y.b from y ;"),
        ("SELECT a,b FROM x,y WHERE a>=1", "select a , b from x , y where a >= 1 ;"),
    ]
    df = spark.createDataFrame([(i, q) for i, (q, _) in enumerate(pairs)], "id int, sql string")
    got = {r.id: r.sql for r in normalize_sql(df, "sql").collect()}
    assert [got[i] for i in range(len(pairs))] == [want for _, want in pairs]
