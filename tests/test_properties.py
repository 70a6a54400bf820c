"""Properties from the test strategy: literal text survives normalisation,
schema strings do not depend on row order (given ``cat_ord``)."""

import json

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import F1_CATALOG
from sqlkiln.operators import catalog as C
from sqlkiln.operators.corpus import normalize_sql
from sqlkiln.sources.json_sources import read_catalog

# literal bodies: no quote of either kind, no tab, no "t<digit>", no "order by"
LITERAL = st.text(alphabet=st.sampled_from(list("abcXYZ Имя 19_.,()*<>=-+")), min_size=0, max_size=12).filter(
    lambda s: "order by" not in s.lower())


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(LITERAL, min_size=1, max_size=40))
def test_literals_survive(spark, lits):
    rows = [(i, f"SELECT a FROM t WHERE b = '{x}'") for i, x in enumerate(lits)]
    out = normalize_sql(spark.createDataFrame(rows, "i int, s string"), "s").orderBy("i").collect()
    for (i, x), r in zip(enumerate(lits), out):
        assert f"'{x}'" in r.s, (x, r.s)


def test_schema_strings_ignore_row_order(spark, tmp_path):
    p = tmp_path / "c.json"
    p.write_text(json.dumps(F1_CATALOG + [dict(F1_CATALOG[1], column_names_original=[[0, "z"]], column_types=["text"])]))
    cat = read_catalog(spark, str(p))
    a = sorted(C.schema_strings(cat).collect())
    shuffled = cat.repartition(7).orderBy(F.rand(5))
    b = sorted(C.schema_strings(shuffled).collect())
    assert a == b
