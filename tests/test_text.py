import pytest
from pyspark.sql import functions as F

from sqlkiln.operators.corpus import clean_questions, normalize_sql, postprocess_sql

F3 = [
    ("\t‘Who’ ordered “most”?\n", "'Who' ordered 'most'?"),
    ("a\nb", "ab"),
    ("a \n b", "a  b"),
    (" x\u001c", "x"),
]

F4 = [
    ('SELECT T1.name , count(*) FROM customer AS T1 JOIN orders AS T2 ON T1.cust_id = T2.cust_id '
     'WHERE T1.name = "Bob" ORDER BY count(*)',
     "select customer.name , count ( * ) from customer join orders on customer.cust_id = orders.cust_id "
     "where customer.name = 'Bob' order by count ( * ) asc ;"),
    ("select name from customer order by name desc;", "select name from customer order by name desc ;"),
    ("SELECT a FROM t ORDER BY a , b", "select a from t order by a asc , b ;"),
    ("SELECT description FROM t ORDER BY a", "select description from t order by a ;"),
    ("select Имя from Город order by Имя", "select имя from город order by имя asc ;"),
    ("  SELECT a FROM x AS T1 WHERE T1.a >= 1.5\u001c", "select a from x where x.a >= 1.5 ;"),
    ("select a from x as t1 join y as t10 on t1.a = t10.b", "select a from x join y as x0 on x.a = x0.b ;"),
    ("SELECT T1.* FROM x T1 WHERE a = 'It T1'", "select x.* from x x where a = 'It T1' ;"),
    ("select a from t order by a union select a from t order by a",
     "select a from t order by a asc asc union select a from t order by a asc asc ;"),
]

F6 = [("a\nb;c;d", "ab"), ("abc", "abc"), ("select ';' x", "select '"), ("", "")]


def _run(spark, rows, fn):
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], "i int, s string")
    return [r.s for r in fn(df).orderBy("i").collect()]


def test_clean_questions_golden(spark):
    assert _run(spark, F3, lambda d: clean_questions(d, "s")) == [g for _, g in F3]


def test_normalize_sql_golden(spark):
    got = _run(spark, F4, lambda d: normalize_sql(d, "s"))
    for (src, want), g in zip(F4, got):
        assert g == want, src


def test_postprocess_golden(spark):
    assert _run(spark, F6, lambda d: postprocess_sql(d, "s")) == [g for _, g in F6]


def test_select_alias_is_not_bound(spark):
    got = _run(spark, [("select a , b as t1 from x", None)], lambda d: normalize_sql(d, "s"))
    assert got == ["select a , b as t1 from x ;"]


def test_literal_kept_without_quotes_or_aliases(spark):
    got = _run(spark, [("select a from b where c = 'MiXeD Case  text'", None)], lambda d: normalize_sql(d, "s"))
    assert got == ["select a from b where c = 'MiXeD Case  text' ;"]
