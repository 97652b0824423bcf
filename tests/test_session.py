from pyspark.sql import functions as F

from waymark import session
from waymark.materialize import cut_lineage


def test_a_table_that_parquet_packs_well_is_not_broadcast_by_its_file_size(spark):
    kept = {k: spark.conf.get(k, None) for k in session.SETTINGS}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
    session.tune(spark)
    try:
        # Millions of bytes in a file of hundreds of thousands: places repeat in the order of a shuffle.
        places = cut_lineage(spark.range(400_000).select(
            (F.xxhash64("id") % 60_000).alias("customer_id"), (F.col("id") % 23 * 0.007).alias("lat"), (F.col("id") % 29 * 0.007).alias("lon"),
            F.array(F.col("id") % 50).alias("mccs")))
        visits = spark.range(2_000_000).select((F.col("id") % 60_000).alias("customer_id"), F.rand(1).alias("x"))
        plan = visits.join(places.select("customer_id", "lat", "lon"), "customer_id")._jdf.queryExecution().executedPlan().toString()
        assert "Join" in plan and "BroadcastHashJoin" not in plan
    finally:
        for k, v in kept.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
