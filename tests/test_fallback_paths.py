"""The shuffle-join fallbacks (dimension above the broadcast limit) give the
same results as the broadcast path, also with a hot key holding half the
rows."""

from pyspark.sql import functions as F

from sqlkiln.operators import confidence as SC
from sqlkiln.operators.joins import attach_schema
from sqlkiln.plans import standins as S
from sqlkiln.operators import catalog as C

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_attach_schema_fallback_with_hot_db(spark):
    docs = S.table(spark, SF, "documents")
    samples = S.samples_from_documents(docs)
    # half of the samples point at one database
    hot = samples.withColumn("db_id", F.when(F.col("ord") % 2 == 0, F.lit("Brand#3")).otherwise(F.col("db_id")))
    schemas = C.schema_strings(S.catalog_from_part(S.table(spark, SF, "part")))
    a = attach_schema(hot.select("id", "db_id"), schemas)
    b = attach_schema(hot.select("id", "db_id"), schemas, max_broadcast_bytes=0)
    assert sorted(a.collect()) == sorted(b.collect())
    assert "BroadcastHashJoin" in _plan(a)


def test_truncate_scores_long_fallback_with_hot_user(spark):
    ev = S.table(spark, SF, "events")
    hot = ev.withColumn("user_id", F.when(F.col("event_id") % 2 == 0, F.lit(7)).otherwise(F.col("user_id")))
    log = hot.select("user_id", "event_id", "ts", "value", (F.col("event_type") == "error").alias("is_eos"))
    a = SC.confidence_long(SC.truncate_scores_long(log, ["user_id"], "ts", "is_eos"), ["user_id"], "value")
    b = SC.confidence_long(SC.truncate_scores_long(log, ["user_id"], "ts", "is_eos", max_broadcast_bytes=0),
                           ["user_id"], "value")
    assert sorted(a.collect()) == sorted(b.collect())
