import os

from pyspark.sql import functions as F

from waymark.materialize import new_path
from waymark.sinks import files


def _bytes(path):
    path = path.removeprefix("file://")
    return sum(os.path.getsize(os.path.join(d, n)) for d, _, names in os.walk(path) for n in names if n.startswith("part-"))


def test_compressed_exports_hold_the_same_lines_in_a_tenth_of_the_bytes(spark):
    points = spark.range(3000).select(F.concat(F.lit("C"), F.col("id") % 7).alias("customer_id"), "id", (F.col("id") * 0.001).alias("lat"),
                                      (F.col("id") * 0.002).alias("lon"), F.lit("h").alias("hint"), F.lit("p").alias("preset"))
    for documents in (True, False):
        plain, packed = new_path(spark), new_path(spark)
        files.export_geojson(points, plain, documents, buckets=2)
        files.export_geojson(points, packed, documents, buckets=2, compression="gzip")
        lines = [sorted(map(tuple, spark.read.schema("customer_id string, value string").json(p).collect())) for p in (plain, packed)]
        assert lines[0] == lines[1] and len(lines[0]) >= 3000
        assert 10 * _bytes(packed) < _bytes(plain)
