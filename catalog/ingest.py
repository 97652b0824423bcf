"""Sources, sinks and scalar expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import views
from catalog.registry import query
from catalog.views import sql
from waymark import fixed
from waymark.functions import calendar, geo, text
from waymark.materialize import new_path
from waymark.operators import lookups
from waymark.sinks import files
from waymark.sources import lines as L
from waymark.sources import transactions as X

HEADER = "amount,atm_address,atm_address_lat,..."


def _text(name):
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def raw_lines(spark, sf_dir, train: bool):
    """The transactions as dirty CSV lines, with header lines in between."""
    atm = lambda name: F.when(F.col("from_pos") == 0, F.col(name).cast("string")).otherwise("")
    pos = lambda name: F.when(F.col("from_pos") == 1, F.col(name).cast("string")).otherwise("")
    fields = [
        _text("true_amount"), F.col("address_text"), atm("true_lat"), atm("true_lon"), _text("city_raw"),
        _text("country"), F.col("currency_text"), F.col("customer_id"),
        *([_text("home_lat"), _text("home_lon")] if train else []),
        F.col("mcc_text"), F.col("address_text"), pos("true_lat"), pos("true_lon"), F.col("terminal_id"),
        F.col("date_text"), *([_text("work_lat"), _text("work_lon")] if train else []),
    ]
    raw = views.raw(spark, sf_dir).filter(F.col("is_train") == train)
    lines = raw.select("terminal_id", F.concat_ws(",", *fields).alias("value"))
    header = F.array(F.col("value"), F.lit(HEADER))
    return lines.select(F.explode(F.when(F.col("terminal_id") == "7", header).otherwise(F.array("value"))).alias("value"))


CLEAN = """SELECT customer_id, true_amount AS amount, round(pow(10, true_amount), 2) AS amount_power10,
  CASE upper(coalesce(city_raw, 'UNKNOWN')) WHEN 'MOSKVA' THEN 'MOSCOW' WHEN 'G. MOSKVA' THEN 'MOSCOW' WHEN 'SPB' THEN 'ST-PETER'
    ELSE upper(coalesce(city_raw, 'UNKNOWN')) END AS city,
  country, true_currency AS currency,
  CASE WHEN true_mcc % 9 = 0 THEN 0 WHEN true_mcc % 9 = 1 THEN 5100 + true_mcc ELSE true_mcc END AS mcc,
  concat('shop RADON, no ', terminal_id) AS atm_address, concat('shop RADON, no ', terminal_id) AS pos_address,
  true_lat AS lat, true_lon AS lon, CASE WHEN from_pos = 1 THEN 0 ELSE 1 END AS operation_type,
  terminal_id, CAST(true_date AS VARCHAR) AS date{more}
FROM raw WHERE true_mcc % 13 <> 0 AND {which}"""


def _clean_columns(df, *more):
    return df.select(
        "customer_id", "amount", F.round("amount_power10", 2).alias("amount_power10"), "city", "country",
        "currency", "mcc", "atm_address", "pos_address", "lat", "lon", "operation_type", "terminal_id", F.col("date").cast("string").alias("date"), *more)


@query(sql(CLEAN.format(more="", which="NOT is_train"), "raw"))
def read_test_transactions(spark, sf_dir):
    path = new_path(spark)
    raw_lines(spark, sf_dir, False).write.text(path)
    return _clean_columns(X.read_test_transactions(spark, path))


@query(sql(CLEAN.format(more=", home_lat, home_lon, work_lat, work_lon", which="is_train"), "raw"))
def read_train_transactions(spark, sf_dir):
    path = new_path(spark)
    raw_lines(spark, sf_dir, True).write.text(path)
    return _clean_columns(X.read_train_transactions(spark, path), "home_lat", "home_lon", "work_lat", "work_lon")


@query(sql("""SELECT lat, lon, CASE WHEN apartment_id % 11 > 0 THEN CAST(year AS INTEGER) ELSE -1 END AS year,
CASE WHEN apartment_id % 7 = 0 THEN 1 ELSE CAST(units % 20 + 1 AS INTEGER) END AS floor,
CASE WHEN apartment_id % 5 = 0 THEN 1 ELSE units END AS units,
CASE WHEN apartment_id % 3 = 1 THEN 0 ELSE CAST(parking AS INTEGER) END AS parking FROM apartments""", "apartments"))
def read_apartments(spark, sf_dir):
    rows = views.apartments(spark, sf_dir)
    empty = lambda divisor, name: F.when(F.col("apartment_id") % divisor == 0, "").otherwise(F.col(name).cast("string"))
    line = F.concat_ws(
        ",", F.col("lat").cast("string"), F.col("lon").cast("string"), empty(11, "year"), empty(7, "floors"), empty(5, "units"),
        F.when(F.col("apartment_id") % 3 == 1, "no").otherwise(F.col("parking").cast("string")),
    )
    head = F.array(F.lit("latitude,longitude,year,floors,apartments,parking"), line)
    path = new_path(spark)
    rows.select(F.explode(F.when(F.col("apartment_id") == 1, head).otherwise(F.array(line))).alias("value")).write.text(path)
    return X.read_apartments(spark, path).drop("apartment_id").fillna(-1, ["year"])


# Lines that each carry one of the literal repairs, chosen by the terminal.
_REPAIRS = list(fixed.LINE_REPAIRS.items())


def _literal(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _repaired(expression: str) -> str:
    for broken, good in _REPAIRS:
        expression = f"replace({expression}, {_literal(broken)}, {_literal(good)})"
    return expression


_DIRTY = "concat(customer_id, ',', CASE CAST(terminal_id AS INTEGER) % 14 {cases} END, ',', country)".format(
    cases=" ".join(f"WHEN {i} THEN {_literal(broken)}" for i, (broken, _) in enumerate(_REPAIRS)))


@query(sql(f"SELECT {_repaired(_DIRTY)} AS value FROM tx", "tx"))
def repair_lines(spark, sf_dir):
    pick = F.element_at(F.array(*[F.lit(b) for b, _ in _REPAIRS]), F.col("terminal_id").cast("int") % 14 + 1)
    return L.repair_lines(views.tx(spark, sf_dir).select(F.concat_ws(",", "customer_id", pick, "country").alias("value")))


@query(sql("""SELECT customer_id AS a, concat('x ', terminal_id, ', "', country, '" \\ y') AS b,
CASE WHEN mcc % 4 > 0 THEN CAST(mcc AS STRING) END AS c, mcc % 4 = 0 OR mcc % 4 = 1 AS odd FROM tx""", "tx"))
def split_csv_lines(spark, sf_dir):
    quoted = F.concat(F.lit('"x '), F.col("terminal_id"), F.lit(', \\"'), F.col("country"), F.lit('\\" \\\\ y"'))
    tail = F.when(F.col("mcc") % 4 == 0, "").when(F.col("mcc") % 4 == 1, F.concat(F.lit(","), F.col("mcc").cast("string"), F.lit(",more"))) \
        .otherwise(F.concat(F.lit(","), F.col("mcc").cast("string")))
    lines = views.tx(spark, sf_dir).select(F.concat(F.col("customer_id"), F.lit(","), quoted, tail).alias("value"))
    return L.split_csv_lines(lines, ["a", "b", "c"]).withColumn("odd", F.col(L.ODD_LINE).isNotNull()).drop(L.ODD_LINE)


@query(sql("""SELECT customer_id, country, CASE WHEN mcc % 2 = 0 THEN terminal_id END AS terminal_id,
CAST(NULL AS VARCHAR) AS extra FROM tx""", "tx"))
def pad_columns(spark, sf_dir):
    tail = F.when(F.col("mcc") % 2 == 0, F.concat(F.lit(",  "), F.col("terminal_id"))).otherwise("")
    lines = views.tx(spark, sf_dir).select(F.concat(F.lit(" "), F.col("customer_id"), F.lit(" , "), F.col("country"), tail).alias("value"))
    fields = L.split_csv_lines(lines, ["customer_id", "country", "terminal_id"]).drop(L.ODD_LINE)
    return L.pad_columns(fields, ["customer_id", "country", "terminal_id", "extra"])


@query(sql("SELECT concat(customer_id, ',', terminal_id) AS value FROM tx WHERE mcc % 5 > 0", "tx"))
def drop_header(spark, sf_dir):
    line = F.when(F.col("mcc") % 5 == 0, F.lit("amount,atm_address,x")).otherwise(F.concat_ws(",", "customer_id", "terminal_id"))
    return L.drop_header(views.tx(spark, sf_dir).select(line.alias("value")), fixed.TRANSACTION_HEADER)


@query("""SELECT o_orderkey, CAST(row_number() OVER (ORDER BY o_totalprice, o_orderkey, o_custkey) - 1 AS BIGINT) AS id FROM orders""")
def add_row_id(spark, sf_dir):
    rows = views.run(spark, sf_dir, "SELECT o_orderkey, o_totalprice, o_custkey FROM orders")
    return L.add_row_id(rows, ["o_totalprice", "o_orderkey", "o_custkey"]).select("o_orderkey", "id")


def _row_predictions(spark, sf_dir):
    """A table in the shape of the predictions: each customer's outermost points."""
    tx = views.test(spark, sf_dir)
    home = tx.groupBy("customer_id").agg(F.min("lat").alias("lat"), F.min("lon").alias("lon")).filter("lon < 37.02")
    work = tx.groupBy("customer_id").agg(F.max("lat").alias("lat"), F.max("lon").alias("lon")).filter("lon > 37.15")
    return lookups.assemble_predictions(tx, work, home)


PREDICTIONS = """SELECT customer_id AS _ID_, CASE WHEN max(lon) > 37.15::DOUBLE THEN max(lat) ELSE 0.0::DOUBLE END AS _WORK_LAT_,
CASE WHEN max(lon) > 37.15::DOUBLE THEN max(lon) ELSE 0.0::DOUBLE END AS _WORK_LON_,
CASE WHEN min(lon) < 37.02::DOUBLE THEN min(lat) ELSE 0.0::DOUBLE END AS _HOME_LAT_,
CASE WHEN min(lon) < 37.02::DOUBLE THEN min(lon) ELSE 0.0::DOUBLE END AS _HOME_LON_
FROM tx WHERE NOT is_train GROUP BY customer_id"""


@query(sql(PREDICTIONS, "tx"))
def assemble_predictions(spark, sf_dir):
    return _row_predictions(spark, sf_dir)


@query(sql(PREDICTIONS, "tx"))
def write_predictions(spark, sf_dir):
    path = new_path(spark)
    files.write_predictions(_row_predictions(spark, sf_dir), path)
    return spark.read.csv(path, header=True, schema="_ID_ string, _WORK_LAT_ double, _WORK_LON_ double, _HOME_LAT_ double, _HOME_LON_ double")


@query(sql(f"""SELECT count(*) AS results, CAST(sum(CASE WHEN _WORK_LAT_ > 0 THEN 1 ELSE 0 END) AS BIGINT) AS work_found,
CAST(sum(CASE WHEN _HOME_LAT_ > 0 THEN 1 ELSE 0 END) AS BIGINT) AS home_found FROM ({PREDICTIONS})""", "tx"))
def result_summary(spark, sf_dir):
    return lookups.result_summary(_row_predictions(spark, sf_dir))


def _exported(spark, sf_dir, train):
    rows = views.train(spark, sf_dir) if train else views.test(spark, sf_dir)
    return rows.select(
        F.col("mcc").alias("id"), F.round(F.log10("amount"), 6).alias("amount"), F.col("amount").alias("amount_power10"),
        F.concat(F.lit('a "b" \\ '), "terminal_id").alias("atm_address"),
        F.when(F.col("from_pos") == 0, F.col("lat")).otherwise(0.0).alias("atm_lat"),
        F.when(F.col("from_pos") == 0, F.col("lon")).otherwise(0.0).alias("atm_lon"),
        F.col("city_raw").alias("city"), "country", "currency", "customer_id", "mcc",
        F.lit(None).cast("string").alias("pos_address"),
        F.when(F.col("from_pos") == 1, F.col("lat")).alias("pos_lat"),
        F.when(F.col("from_pos") == 1, F.col("lon")).alias("pos_lon"),
        "terminal_id", "date", "lat", "lon", F.lit(1).alias("operation_type"),
        *(["home_lat", "home_lon", "work_lat", "work_lon"] if train else []),
    )


EXPORT_NAMES = [
    "id", "amount", "amount_power10", "atm_address", "atm_lat", "atm_lon", "city", "country", "currency", "customer_id", "mcc",
    "pos_address", "pos_lat", "pos_lon", "terminal_id", "date", "lat", "lon", "operation_type",
]
EXPORTED = """SELECT CAST(mcc AS STRING) AS id, round(log10(amount), 6) AS amount, amount AS amount_power10,
concat('a b  ', terminal_id) AS atm_address,
CASE WHEN from_pos = 0 THEN lat END AS atm_lat, CASE WHEN from_pos = 0 THEN lon END AS atm_lon,
city_raw AS city, country, CAST(currency AS STRING) AS currency, customer_id, CAST(mcc AS STRING) AS mcc, CAST(NULL AS VARCHAR) AS pos_address,
CASE WHEN from_pos = 1 THEN lat END AS pos_lat, CASE WHEN from_pos = 1 THEN lon END AS pos_lon, terminal_id, CAST(date AS VARCHAR) AS date, lat, lon,
'1' AS operation_type{more} FROM tx WHERE {which}"""


def _read_export(spark, path, names):
    rows = L.split_csv_lines(L.read_lines(spark, path), names).drop(L.ODD_LINE)
    places = [n for n in names if n.endswith("lat") or n.endswith("lon")]
    rows = rows.withColumns({n: F.nullif(F.col(n), F.lit("null")).cast("double") for n in places})
    return rows.withColumns({
        "amount": F.col("amount").cast("double"), "amount_power10": F.col("amount_power10").cast("double"),
        "date": F.col("date").cast("date").cast("string"), **{n: F.nullif(F.col(n), F.lit("")) for n in ("city", "pos_address")},
    })


@query(sql(EXPORTED.format(more="", which="NOT is_train"), "tx"))
def export_transactions_csv(spark, sf_dir):
    path = new_path(spark)
    files.export_transactions_csv(_exported(spark, sf_dir, False), path)
    return _read_export(spark, path, EXPORT_NAMES)


@query(sql(EXPORTED.format(more=", home_lat, home_lon, work_lat, work_lon", which="is_train"), "tx"))
def export_train_csv(spark, sf_dir):
    path = new_path(spark)
    files.export_train_csv(_exported(spark, sf_dir, True), path)
    return _read_export(spark, path, [*EXPORT_NAMES, "home_lat", "home_lon", "work_lat", "work_lon"])


_FEATURE = "struct<type:string,id:bigint,geometry:struct<type:string,coordinates:array<double>>,properties:struct<hintContent:string>,options:struct<preset:string>>"


def _geojson_lines(spark, points, **how):
    """What the sink has written, read again: (customer_id, value)."""
    path = new_path(spark)
    files.export_geojson(points, path, compression="gzip", **how)
    return spark.read.schema(f"customer_id {points.schema['customer_id'].dataType.simpleString()}, value string").json(path)


@query(sql("""SELECT customer_id, 'Feature' AS type, CAST(max(CAST(terminal_id AS BIGINT)) AS BIGINT) AS id, 'Point' AS kind, lat, lon, max(country) AS hint,
'islands#redIcon' AS preset FROM tx GROUP BY customer_id, lat, lon""", "tx"))
def export_geojson(spark, sf_dir):
    """One feature a line, written by the sink and parsed."""
    points = views.tx(spark, sf_dir).groupBy("customer_id", "lat", "lon").agg(
        F.max(F.col("terminal_id").cast("bigint")).alias("id"), F.max("country").alias("hint"))
    lines = _geojson_lines(spark, points.withColumn("preset", F.lit("islands#redIcon")), documents=False)
    return lines.select("customer_id", F.from_json("value", _FEATURE, {"mode": "FAILFAST"}).alias("f")).select(
        "customer_id", "f.type", "f.id", F.col("f.geometry.type").alias("kind"), F.col("f.geometry.coordinates")[0].alias("lat"),
        F.col("f.geometry.coordinates")[1].alias("lon"), F.col("f.properties.hintContent").alias("hint"), "f.options.preset")


@query(sql("""SELECT customer_id, 'FeatureCollection' AS type, count(*) + 1 AS n_features, CAST(sum(CAST(terminal_id AS BIGINT)) AS BIGINT) AS id_sum,
CAST(-1 AS BIGINT) AS last_id, min(lat) AS south, max(lat) AS north, min(lon) AS west, max(lon) AS east, true AS ends_last
FROM (SELECT DISTINCT customer_id, terminal_id, lat, lon FROM tx) GROUP BY customer_id""", "tx"))
def export_geojson_documents(spark, sf_dir):
    """Each document parsed: its first and last line make a collection with the sentinel, and every line between is a feature and a comma.

    So the lines in a row are one valid document, and no document has to be put together to see it.
    """
    points = views.tx(spark, sf_dir).select("customer_id", "terminal_id", "lat", "lon").distinct().select(
        "customer_id", F.col("terminal_id").cast("bigint").alias("id"), "lat", "lon", F.lit("h").alias("hint"), F.lit("p").alias("preset"))
    lines = _geojson_lines(spark, points).withColumn("_at", F.struct(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("row")))
    opens, closes = F.col("value").endswith("["), F.col("value").endswith("]}")
    # A line between that isn't a feature and one comma fails to parse as this array of two.
    feature = F.from_json(F.concat(F.lit("["), "value", F.lit("null]")), f"array<{_FEATURE}>", {"mode": "FAILFAST"})
    between = F.when(~opens & ~closes, feature[0])
    merged = lines.select("customer_id", "_at", opens.alias("opens"), closes.alias("closes"), "value", between.alias("f")).groupBy("customer_id").agg(
        F.max(F.when(F.col("opens"), F.col("value"))).alias("head"), F.max(F.when(F.col("closes"), F.col("value"))).alias("tail"),
        F.count_if("opens").alias("heads"), F.count_if("closes").alias("tails"), F.count("f").alias("n"), F.sum("f.id").alias("id_sum"),
        *[getattr(F, fn)(F.col("f.geometry.coordinates")[i]).alias(name) for name, fn, i in (("south", "min", 0), ("north", "max", 0), ("west", "min", 1), ("east", "max", 1))],
        (F.max_by("closes", "_at") & F.min_by("opens", "_at")).alias("ends_last"))
    whole = F.from_json(F.concat("head", "tail"), f"struct<type:string,features:array<{_FEATURE}>>", {"mode": "FAILFAST"})
    return merged.filter("heads = 1 and tails = 1").withColumn("d", whole).select(
        "customer_id", "d.type", (F.col("n") + F.size("d.features")).alias("n_features"), "id_sum", F.col("d.features")[0]["id"].alias("last_id"),
        "south", "north", "west", "east", "ends_last")


# Scalar expressions.

_CODES = "concat(CASE mcc % 6 WHEN 0 THEN '' WHEN 1 THEN '-' WHEN 2 THEN '+' WHEN 3 THEN 'x' WHEN 4 THEN '12x' ELSE '' END, CAST(mcc AS STRING), CASE mcc % 4 WHEN 0 THEN '.5' WHEN 1 THEN '.' ELSE '' END)"


@query(sql(f"""SELECT DISTINCT v AS text, CASE WHEN regexp_full_match(v, '[+-]?[0-9]+([.][0-9]+)?') THEN CAST(v AS DOUBLE) ELSE -1.0::DOUBLE END AS number
FROM (SELECT {_CODES} AS v FROM tx)""", "tx"))
def clean_numeric(spark, sf_dir):
    tx = views.tx(spark, sf_dir).select(F.expr(_CODES).alias("text")).distinct()
    return tx.withColumn("number", text.clean_numeric(F.col("text"), -1.0))


@query(sql("""SELECT mcc AS code, CASE WHEN mcc % 9 = 0 THEN 0 WHEN mcc % 9 = 1 THEN 5100 + mcc ELSE mcc END AS mcc, count(*) AS n
FROM tx GROUP BY mcc""", "tx"))
def clean_mcc(spark, sf_dir):
    return views.raw(spark, sf_dir).groupBy(F.col("true_mcc").alias("code"), text.clean_mcc(F.col("mcc_text")).alias("mcc")).agg(F.count(F.lit(1)).alias("n"))


@query(sql("SELECT customer_id, currency, count(*) AS n FROM tx GROUP BY customer_id, currency", "tx"))
def clean_currency(spark, sf_dir):
    return views.raw(spark, sf_dir).groupBy("customer_id", text.clean_currency(F.col("currency_text")).alias("currency")).agg(F.count(F.lit(1)).alias("n"))


@query(sql("SELECT customer_id, CASE WHEN mcc % 13 > 0 THEN CAST(date AS VARCHAR) END AS date, count(*) AS n FROM tx GROUP BY 1, 2", "tx"))
def clean_date(spark, sf_dir):
    return views.raw(spark, sf_dir).groupBy("customer_id", text.clean_date(F.col("date_text")).cast("string").alias("date")).agg(F.count(F.lit(1)).alias("n"))


@query(sql("""SELECT CASE upper(coalesce(city_raw, 'UNKNOWN')) WHEN 'MOSKVA' THEN 'MOSCOW' WHEN 'G. MOSKVA' THEN 'MOSCOW' WHEN 'SPB' THEN 'ST-PETER'
ELSE upper(coalesce(city_raw, 'UNKNOWN')) END AS city, count(*) AS n FROM tx GROUP BY 1""", "tx"))
def normalize_city(spark, sf_dir):
    return views.tx(spark, sf_dir).groupBy(text.normalize_city(F.col("city_raw")).alias("city")).agg(F.count(F.lit(1)).alias("n"))


def _split_points(spark, sf_dir):
    at = lambda name, kind: F.when(F.col("from_pos") == kind, F.col(name))
    return views.tx(spark, sf_dir).select(
        "customer_id", F.col("lat").alias("t_lat"), F.col("lon").alias("t_lon"), "from_pos",
        at("lat", 0).alias("atm_lat"), at("lon", 0).alias("atm_lon"), at("lat", 1).alias("pos_lat"), at("lon", 1).alias("pos_lon"))


@query(sql("SELECT customer_id, lat, lon, count(*) AS n FROM tx GROUP BY customer_id, lat, lon", "tx"))
def resolve_point(spark, sf_dir):
    return X.resolve_point(_split_points(spark, sf_dir)).groupBy("customer_id", "lat", "lon").agg(F.count(F.lit(1)).alias("n"))


@query(sql("SELECT customer_id, CASE WHEN from_pos = 1 THEN 0 ELSE 1 END AS operation_type, count(*) AS n FROM tx GROUP BY 1, 2", "tx"))
def operation_type(spark, sf_dir):
    return _split_points(spark, sf_dir).groupBy("customer_id", X.operation_type().alias("operation_type")).agg(F.count(F.lit(1)).alias("n"))


@query(sql("SELECT customer_id, round(sum(pow(10.0::DOUBLE, CASE WHEN mcc % 10 = 0 THEN 0.0 ELSE true_amount END)), 1) AS total FROM (SELECT *, true_mcc AS mcc FROM raw) GROUP BY customer_id", "raw"))
def unscale_amount(spark, sf_dir):
    amount = F.when(F.col("true_mcc") % 10 > 0, F.col("true_amount"))
    return views.raw(spark, sf_dir).groupBy("customer_id").agg(F.round(F.sum(text.unscale_amount(amount)), 1).alias("total"))


@query(sql("SELECT customer_id, lat, lon, CAST(date AS VARCHAR) AS date FROM tx WHERE mcc % 3 > 0 AND mcc % 13 > 0 AND mcc % 5 > 0", "tx"))
def valid_transactions(spark, sf_dir):
    rows = views.tx(spark, sf_dir).select(
        "customer_id", F.when(F.col("mcc") % 3 > 0, F.when(F.col("mcc") % 5 > 0, F.col("lat")).otherwise(0.0)).alias("lat"), "lon",
        F.when(F.col("mcc") % 13 > 0, F.col("date")).alias("date"))
    return X.valid_transactions(rows).withColumn("date", F.col("date").cast("string"))


@query(sql("""SELECT DISTINCT customer_id, home_lat AS a_lat, home_lon AS a_lon, work_lat AS b_lat, work_lon AS b_lon FROM tx WHERE is_train""", "tx"))
def target_point(spark, sf_dir):
    home, work = lookups.target_point("home"), lookups.target_point("work")
    return views.train(spark, sf_dir).select(
        "customer_id", home[0].alias("a_lat"), home[1].alias("a_lon"), work[0].alias("b_lat"), work[1].alias("b_lon")).distinct()


@query(sql(f"SELECT customer_id, lat, lon, terminal_id FROM tx WHERE {views.near('lat', 'lon', 'home_lat', 'home_lon', 0.02)}", "tx"))
def within_radius(spark, sf_dir):
    tx = views.tx(spark, sf_dir)
    return tx.filter(geo.within_radius(F.col("lat"), F.col("lon"), F.col("home_lat"), F.col("home_lon"), 0.02)).select("customer_id", "lat", "lon", "terminal_id")


def _points(spark, sf_dir):
    return views.run(spark, sf_dir, f"SELECT DISTINCT lat, lon FROM ({views.TX})")


def _apartment_points(spark, sf_dir):
    return views.apartments(spark, sf_dir).select("apartment_id", "lat", "lon")


@query(sql("""SELECT apartment_id, lat, lon, CAST(floor(lat / 0.02::DOUBLE) AS INTEGER) AS cell_x, CAST(floor(lon / 0.02::DOUBLE) AS INTEGER) AS cell_y FROM apartments""", "apartments"))
def grid_cell(spark, sf_dir):
    return _apartment_points(spark, sf_dir).withColumns({"cell_x": geo.grid_cell(F.col("lat"), 0.02), "cell_y": geo.grid_cell(F.col("lon"), 0.02)})


@query(sql("""SELECT apartment_id, CAST(ceil(lat / 0.04::DOUBLE) AS INTEGER) AS cell_x, CAST(ceil(lon / 0.04::DOUBLE) AS INTEGER) AS cell_y FROM apartments""", "apartments"))
def grid_cell_ceil(spark, sf_dir):
    return _apartment_points(spark, sf_dir).select(
        "apartment_id", geo.grid_cell_ceil(F.col("lat"), 0.02).alias("cell_x"), geo.grid_cell_ceil(F.col("lon"), 0.02).alias("cell_y"))


@query(sql("""SELECT apartment_id, floor(lat * 100 + 0.5::DOUBLE) / 100 AS lat, floor(lon * 100 + 0.5::DOUBLE) / 100 AS lon FROM apartments""", "apartments"))
def round_point(spark, sf_dir):
    return _apartment_points(spark, sf_dir).select(
        "apartment_id", geo.round_coordinate(F.col("lat")).alias("lat"), geo.round_coordinate(F.col("lon")).alias("lon"))


@query(sql("""SELECT apartment_id, round(sqrt((lat - 55.07::DOUBLE) * (lat - 55.07::DOUBLE) + (lon - 37.1::DOUBLE) * (lon - 37.1::DOUBLE)), 6) AS distance,
round(atan2(lon - 37.1::DOUBLE, lat - 55.07::DOUBLE), 6) AS angle FROM apartments""", "apartments"))
def polar_offset(spark, sf_dir):
    distance, angle = geo.polar_offset(F.col("lat"), F.col("lon"), F.lit(55.07), F.lit(37.1))
    return _apartment_points(spark, sf_dir).select("apartment_id", F.round(distance, 6).alias("distance"), F.round(angle, 6).alias("angle"))


@query(sql("""SELECT CAST(date AS VARCHAR) AS date, CASE WHEN dayofyear(date) BETWEEN 1 AND 8 THEN 0 WHEN dayofyear(date) BETWEEN 53 AND 57 THEN 1 WHEN dayofyear(date) = 67 THEN 2
WHEN dayofyear(date) BETWEEN 118 AND 121 THEN 3 WHEN dayofyear(date) BETWEEN 125 AND 129 THEN 4 WHEN dayofyear(date) BETWEEN 160 AND 163 THEN 5
WHEN dayofyear(date) BETWEEN 307 AND 310 THEN 6 ELSE -1 END AS bucket, count(*) AS n FROM tx GROUP BY 1, 2""", "tx"))
def holiday_bucket(spark, sf_dir):
    return views.tx(spark, sf_dir).groupBy(F.col("date").cast("string").alias("date"), calendar.holiday_bucket(F.col("date")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query(sql("SELECT CAST(date AS VARCHAR) AS date, CAST(isodow(date) - 1 AS INTEGER) AS weekday, count(*) AS n FROM tx GROUP BY 1, 2", "tx"))
def weekday_index(spark, sf_dir):
    return views.tx(spark, sf_dir).groupBy(F.col("date").cast("string").alias("date"), calendar.weekday_index(F.col("date")).alias("weekday")).agg(F.count(F.lit(1)).alias("n"))
