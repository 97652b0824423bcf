import os
import time

from pyspark.sql import functions as F

from waymark import session
from waymark.materialize import Written, cut_lineage, only_result, shared_folder


def folders(spark):
    return set(os.listdir(shared_folder(spark).removeprefix("file://")))


def test_only_the_result_of_several_steps_stays(spark):
    before, inner = folders(spark), []

    def build():
        first = Written(spark.range(10))
        inner.append(only_result(lambda: cut_lineage(first.df).filter("id > 2")))
        return inner[0].filter("id > 7")

    assert only_result(build).count() == 2
    assert len(folders(spark) - before) == 1


def test_shuffled_files_go_with_their_job(spark):
    """They stayed until the driver collected its garbage, so a plan of many jobs held the shuffles of all."""
    session.tune(spark)
    found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        return sum(f.getName().startswith("shuffle_") and f.getName().endswith(".data") for f in list(_items(found.getAllFiles())))

    before = shuffled()
    for i in range(3):
        cut_lineage(spark.range(1000).select(F.xxhash64("id").alias("a")).repartition(3 + i, "a"))
    for _ in range(50):
        if shuffled() <= before:
            break
        time.sleep(0.1)
    assert shuffled() <= before


def _items(sequence):
    return (sequence.apply(i) for i in range(sequence.size()))
