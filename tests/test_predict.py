"""Features made once for both targets equal those made for one target at a time."""

import pytest
from pyspark.sql import functions as F

from test_plans import transactions
from waymark.operators import surroundings
from waymark.operators.ranking import split_train_test
from waymark.plans import features, predict


@pytest.fixture(scope="module")
def sides(spark):
    train, _ = transactions(spark, seed=3, customers=12, rows=25)
    # The works of some customers are far from their places, those of others aren't known; one customer has neither.
    number = F.substring("customer_id", 2, 9).cast("int")
    train = train.withColumns({
        "work_lat": F.when(number % 3 == 0, None).otherwise(F.col("home_lat") + F.when(number % 3 == 1, 5).otherwise(0)),
        "work_lon": F.when(number % 3 == 0, None).otherwise(F.col("home_lon")),
    })
    nobody = number == 6
    train = train.withColumns({c: F.when(~nobody, F.col(c)) for c in ("home_lat", "home_lon", "work_lat", "work_lon")})
    # Ids of both sides overlap.
    test = transactions(spark, seed=4, customers=3, rows=20)[0].drop("home_lat", "home_lon")
    flats = spark.createDataFrame([(i, 55 + i * 0.002, 37 + i * 0.002, 5) for i in range(40)], "apartment_id long, lat double, lon double, units int")
    shops = surroundings.shop_index(train, test, surroundings.mcc_home_weights(train))
    return train, test, features.Surroundings(flats, shops)


NUMBERS = ["cluster_id", "currency", "country", *features.POINT_NUMBERS, *features.CLUSTER_NUMBERS]


def rows(df, *more):
    columns = ["customer_id", "lat", "lon", *more, *NUMBERS]
    return sorted([tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*columns).collect()])


@pytest.fixture(scope="module")
def shared(spark, sides):
    train, test, around = sides
    visits = predict.visits_of_both(train, test, train_fraction=0.7)
    return visits, features.features_of_visits(visits, around).cache()


def test_test_customers_have_the_features_they_have_alone(sides, shared):
    _, test, around = sides
    got = rows(predict.on_side(shared[1], "0", "string"))
    assert got == rows(features.prepare_features(test, around)) and got


@pytest.mark.parametrize("target", ["home", "work"])
def test_labels_and_features_of_one_target(sides, shared, target):
    train, _, around = sides
    known = split_train_test(train.filter(f"{target}_lat is not null"), 0.7, 0).filter("is_training")
    want = rows(features.prepare_features(known, around, target), "label")
    got = rows(predict.on_side(predict.training_rows(shared[0], shared[1], target), "1", "string"), "label")
    assert got == want and got
    assert {r[3] for r in got} <= {0.0, 1.0}


def test_each_side_is_read_once(sides):
    train, test, _ = sides
    visits = predict.visits_of_both(train, test)
    assert {c for c in visits.columns if c.endswith(("_lat", "_lon"))} >= {"home_lat", "home_lon", "work_lat", "work_lon"}
    assert visits.filter(F.col("customer_id").startswith("0") & F.col("home_lat").isNotNull()).count() == 0


def test_number_ids_come_back_as_numbers(spark, sides):
    train, test, _ = sides
    number = F.substring("customer_id", 2, 9).cast("int")
    visits = predict.visits_of_both(train.withColumn("customer_id", number), test.withColumn("customer_id", number))
    back = predict.on_side(visits, "0", "int")
    assert dict(back.dtypes)["customer_id"] == "int"
    assert {r[0] for r in back.select("customer_id").collect()} == {0, 1, 2}
