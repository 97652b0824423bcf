import datetime

import pytest
from pyspark.sql import functions as F

from waymark import fixed
from waymark.functions import calendar, text
from waymark.sinks import files
from waymark.sources import lines as L
from waymark.sources import transactions as X


def values(spark, items, column, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(items)], f"i int, v {kind}")
    return [r["x"] for r in df.select("i", column(F.col("v")).alias("x")).sort("i").collect()]


def test_numbers_keep_one_digit_and_reject_other_text(spark):
    got = values(spark, ["5", "5.25", "-3", "+0.5", "12x5", "5.", "", None, "abc"], lambda v: text.clean_numeric(v, 7.0))
    assert got == [5.0, 5.25, -3.0, 0.5, 7.0, 7.0, 7.0, 7.0, 7.0]


def test_codes_dates_and_cities(spark):
    assert values(spark, ['"5,411"', "6011", "x", None], text.clean_mcc) == [5411, 6011, 0, 0]
    assert values(spark, ["840.0", "978", "", None], text.clean_currency) == [840, 978, 643, 643]
    assert values(spark, ["2017-01-31", "2017-13-99", "", None], text.clean_date) == [datetime.date(2017, 1, 31), None, None, None]
    assert values(spark, ["Moskva", "spb", "Tver", None], text.normalize_city) == ["MOSCOW", "ST-PETER", "TVER", "UNKNOWN"]


def test_holidays_and_weekdays(spark):
    days = [datetime.date(2017, 1, 1), datetime.date(2017, 1, 8), datetime.date(2017, 1, 9), datetime.date(2017, 3, 8), datetime.date(2017, 11, 4)]
    assert values(spark, days, calendar.holiday_bucket, "date") == [0, 0, -1, 2, 6]
    assert values(spark, days, calendar.weekday_index, "date") == [6, 6, 0, 2, 5]


def test_quoted_commas_stay_in_their_field(spark):
    df = spark.createDataFrame([('42,7,abc,"one,two,three",344',), ('"first, quoted",2',)], "value string")
    rows = L.split_csv_lines(df, list("abcde")).collect()
    assert rows[0]["d"] == "one,two,three" and rows[0][L.ODD_LINE] is None
    assert rows[1]["a"] == "first, quoted" and rows[1]["c"] is None and rows[1][L.ODD_LINE] == '"first, quoted",2'


@pytest.mark.parametrize("broken,good", list(fixed.LINE_REPAIRS.items()))
def test_repairs(spark, broken, good):
    df = spark.createDataFrame([(f"a,{broken},b",)], "value string")
    assert L.repair_lines(df, {broken: good}).first()["value"] == f"a,{good},b"


def test_train_and_test_lines(spark):
    head = "amount,atm_address,atm_lat,..."
    test = [head, '2.0,"bank, 1",55.5,37.5,Moskva,RUS,643.0,c1,"5,411",,,,t1,2017-05-01', "2.0,,,,,,,c1,1,shop,0.0,0.0,t,2017-05-01",
            "1.0,,,,,,,c2,1,shop,56.0,38.0,t,2017-13-01", "1.0,,,,,,,c3,1,shop,56.0,38.0,t,2017-12-01"]
    rows = {r["customer_id"]: r for r in X.parse_test_transactions(spark.createDataFrame([(v,) for v in test], "value string")).collect()}
    assert set(rows) == {"c1", "c3"}
    assert (rows["c1"]["lat"], rows["c1"]["operation_type"], rows["c1"]["amount_power10"], rows["c1"]["mcc"]) == (55.5, 1, 100.0, 5411)
    assert (rows["c3"]["lat"], rows["c3"]["operation_type"], rows["c3"]["currency"], rows["c3"]["city"]) == (56.0, 0, 643, "UNKNOWN")
    train = [head, "1.0,a,,,Tver,RUS,840.0,c1,55.1,37.1,5411,shop,56.0,38.0,t1,2017-05-01,55.2,0.0"]
    row = X.parse_train_transactions(spark.createDataFrame([(v,) for v in train], "value string")).first()
    assert (row["home_lat"], row["home_lon"], row["work_lat"], row["work_lon"], row["lat"]) == (55.1, 37.1, 55.2, None, 56.0)


def test_a_line_is_parsed_once(spark, tmp_path):
    lines = ["1.0,a,,,Tver,RUS,840.0,c1,55.1,37.1,5411,shop,56.0,38.0,t1,2017-05-01,55.2,0.0", "", "x", "1.0,a,,,Tver,RUS,840.0,c2,1,1,1,shop,0,0,t1,2017-05-01,1,1"]
    (tmp_path / "lines.txt").write_text("\n".join(lines))
    for read in (X.read_train_transactions, X.read_test_transactions):
        plan = read(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("from_csv(") == 1
    assert [r["customer_id"] for r in X.read_train_transactions(spark, str(tmp_path)).collect()] == ["c1"]
    empty = spark.createDataFrame([(None,), ("",), ("1,2",)], "value string")
    assert [tuple(r)[:2] for r in L.split_csv_lines(empty, ["a", "b"]).collect()] == [(None, None), (None, None), ("1", "2")]


def test_apartments_keep_both_coordinates(spark):
    df = spark.createDataFrame([("55.5,37.25,1990,1..9,40,3",), ("55.5,37,,5,,x",), ("latitude,longitude,year,z",)], "value string")
    rows = sorted(tuple(r) for r in X.parse_apartments(df).fillna(-1).collect())
    assert rows == [(55.5, 37.0, -1, 1, 1, 0), (55.5, 37.25, 1990, 9, 40, 3)]


def test_dense_row_ids(spark):
    df = spark.range(1000).withColumn("k", F.xxhash64("id")).repartition(7)
    rows = L.add_row_id(df.drop("id"), ["k"], "n", start=1).sort("k").collect()
    assert [r["n"] for r in rows] == list(range(1, 1001))


def test_geojson_document_lines(spark, tmp_path):
    import json

    df = spark.createDataFrame([("c", 0, 55.0, 37.0, "a \"b\"", "p"), ("c", 1, 55.5, 37.5, "b", "p"), ("d", 0, 1.0, 2.0, "x", "q")],
                               "customer_id string, id long, lat double, lon double, hint string, preset string")
    files.export_geojson(df, str(tmp_path / "out"))
    lines = [json.loads(x) for p in sorted((tmp_path / "out").glob("bucket=*/*.json"), key=lambda p: p.name) for x in p.read_text().splitlines()]
    found = json.loads("\n".join(x["value"] for x in lines if x["customer_id"] == "c"))
    assert [f["id"] for f in found["features"]] == [0, 1, -1]
    assert found["features"][0]["geometry"]["coordinates"] == [55.0, 37.0] and found["features"][0]["properties"]["hintContent"] == 'a "b"'


def test_no_text_of_a_field_ends_the_job(spark):
    from pyspark.sql import functions as F

    from waymark.functions import text

    odd = ["9999999999", "-9999999999", "1e400", "1e5", "+7", "-0", "", " ", None, "9" * 400, "12.5", "NaN", "840", "2147483648", "é"]
    df = spark.createDataFrame([(t,) for t in odd], "t string")
    got = {r["t"]: r for r in df.select(
        "t", text.clean_currency(F.col("t")).alias("currency"), text.clean_mcc(F.col("t")).alias("mcc"), text.clean_numeric(F.col("t")).alias("number"),
        text.clean_date(F.col("t")).alias("date"), text.clean_coordinate(F.col("t")).alias("place")).collect()}
    default = got[""]["currency"]
    assert got["840"]["currency"] == 840 and got["+7"]["currency"] == 7 and got["12.5"]["currency"] == 12
    assert all(got[t]["currency"] == default for t in ("9999999999", "-9999999999", "1e400", "9" * 400, "2147483648", None, "é"))


def test_dictionaries_of_several_tables_and_columns(spark):
    from waymark.operators import lookups

    a = spark.createDataFrame([(10, "b", 1.5), (9, "a", None), (None, "b", 1.5)], "code int, name string, extra double")
    b = spark.createDataFrame([("", 100, -2.0), ("ä", 9, 0.1)], "name string, code int, extra double")
    made = lookups.category_dictionaries([a, b], ["code", "name", "extra"])
    got = {c: [tuple(r) for r in df.sort("idx").collect()] for c, df in made.items()}
    assert got["code"] == [(None, 0), (9, 1), (10, 2), (100, 3)] and made["code"].schema["value"].dataType.simpleString() == "int"
    assert got["name"] == [("", 0), ("a", 1), ("b", 2), ("ä", 3)] and got["extra"] == [(None, 0), (-2.0, 1), (0.1, 2), (1.5, 3)]
    assert lookups.category_dictionary(a.limit(0), b.limit(0), "name").count() == 0


@pytest.mark.parametrize("documents", [True, False])
def test_geojson_becomes_text_after_the_sort(spark, tmp_path, documents, monkeypatch):
    df = spark.createDataFrame([("a", 2, 1.0, 2.0, "h", "p"), (None, 1, 3.0, None, None, "p")], "customer_id string, id int, lat double, lon double, hint string, preset string")
    dealt = []
    kind = type(df)
    plain = kind.repartitionByRange

    def seen(self, *columns):
        dealt.append(self.columns)
        return plain(self, *columns)

    monkeypatch.setattr(kind, "repartitionByRange", seen)
    files.export_geojson(df, str(tmp_path / "out"), documents=documents)
    assert [("hint" in c, "value" in c) for c in dealt] == [(True, False)]
    lines = spark.read.schema("customer_id string, value string").json(str(tmp_path / "out")).collect()
    assert len(lines) == (6 if documents else 2)
    assert [r["value"].rstrip(",") for r in lines if '"id":2' in r["value"]] == [
        '{"type":"Feature","id":2,"geometry":{"type":"Point","coordinates":[1.0,2.0]},"properties":{"hintContent":"h"},"options":{"preset":"p"}}']
