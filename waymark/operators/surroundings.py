"""What lies around a point: shops by category, and apartments."""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from waymark import fixed
from waymark.functions import geo
from waymark.materialize import cut_lineage
from waymark.operators import celltree
from waymark.operators.blocks import ARRAY_ROWS, arrays_of, fields
from waymark.operators.components import steps
from waymark.operators.lookups import target_point, union_train_test
from waymark.operators.radius import radius_aggregate, radius_join
from waymark.sources.lines import add_row_id

# Executors need not have this package: the functions below travel with the job.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

POINT = ["lat", "lon"]


def mcc_counts(tx: DataFrame) -> DataFrame:
    return tx.groupBy("mcc").agg(F.count(F.lit(1)).alias("n"))


def mcc_near_home_counts(train: DataFrame, radius: float = fixed.RADIUS, target: str = "home") -> DataFrame:
    """Rows and rows near the target per category, in one pass."""
    near = geo.within_radius(F.col("lat"), F.col("lon"), *target_point(target), radius)
    return train.groupBy("mcc").agg(F.count(F.lit(1)).alias("n"), F.count_if(near).alias("n_near"))


def mcc_home_weights(train: DataFrame, radius: float = fixed.RADIUS, target: str = "home") -> DataFrame:
    """Share of a category's rows that lie near the target, where there are any."""
    counts = mcc_near_home_counts(train, radius, target).filter("n_near > 0")
    return counts.select("mcc", (F.col("n_near").cast("double") / F.col("n")).alias("weight"))


def shop_index(train: DataFrame, test: DataFrame, weights: DataFrame) -> DataFrame:
    """Distinct (lat, lon, mcc, weight) of all rows with a weighted category."""
    return union_train_test(train, test, ["lat", "lon", "mcc"]).distinct().join(weights, "mcc")


def shop_weights_near(points: DataFrame, shops: DataFrame, radius: float = fixed.RADIUS) -> DataFrame:
    """(lat, lon, mcc, weight): summed weight of the shops within `radius`, per category."""
    return radius_aggregate(points.select(*POINT).distinct(), shops, radius, "weight", "weight", group=["mcc"])


def unvisited_shop_weight(near_mccs: DataFrame, shop_weights: DataFrame) -> DataFrame:
    """Weight of the shops near a point in categories the customer does not use near it.

    `near_mccs` is (customer_id, lat, lon, near_mccs), an array of categories. The weights depend on
    the point only, so they are one map per point, looked up by all its customers: no row per
    customer and shop. Both are as long as the list of category codes at most, and met by one look-up for each code.
    """
    per_point = shop_weights.groupBy(*POINT).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("mcc", "weight")))).alias("_weights")
    )
    codes = F.array_distinct(F.filter("near_mccs", lambda mcc: mcc.isNotNull()))
    unused = F.map_zip_with("_weights", F.map_from_arrays(codes, codes), lambda mcc, weight, used: F.when(used.isNull(), weight).otherwise(0.0))
    total = F.aggregate(F.map_values(unused), F.lit(0.0), lambda a, w: a + w)
    return near_mccs.join(per_point, POINT, "left").select(
        "customer_id", *POINT, F.coalesce(total, F.lit(0.0)).alias("unvisited_shop_weight")
    )


def near_mccs(visits: DataFrame, radius: float = fixed.RADIUS, array_rows: int = ARRAY_ROWS) -> DataFrame:
    """Categories each customer uses within `radius` of each of their points; `visits` has `mccs` per point.

    A customer of up to `array_rows` rows is one array that is answered in place; larger ones meet cell by cell.
    """
    arrays, crowded = arrays_of(visits.select("customer_id", *POINT, "mccs"), ["customer_id"], [*POINT, "mccs"], array_rows, repeats=True)
    schema = T.StructType([*fields(visits, "customer_id", *POINT), T.StructField("near_mccs", visits.schema["mccs"].dataType)])
    found = arrays.mapInArrow(lambda batches: (used_near(b, radius, to_arrow_schema(schema)) for b in batches), schema)
    return found if crowded is None else found.unionByName(_near_mccs_by_cells(crowded, radius))


def used_near(batch: pa.RecordBatch, radius: float, schema: pa.Schema) -> pa.RecordBatch:
    """From (customer_id, list of (lat, lon, mccs)) a row for each place with a code in reach, with the distinct codes."""
    every = batch.column(1)
    sizes, rows = every.value_lengths().to_numpy(zero_copy_only=False), every.flatten()
    lat, lon, mccs = (rows.field(i) for i in range(3))
    y, x = (c.to_numpy(zero_copy_only=False).astype(float) for c in (lat, lon))
    n_codes = pc.fill_null(mccs.value_lengths(), 0).to_numpy(zero_copy_only=False)
    values = pc.dictionary_encode(mccs.flatten())
    # The last number stands for a missing code: it counts as one in reach, and isn't listed.
    n_values = len(values.dictionary)
    code = pc.fill_null(values.indices, n_values).to_numpy(zero_copy_only=False).astype(np.int64)
    starts, group = np.cumsum(n_codes) - n_codes, np.repeat(np.arange(len(sizes)), sizes)
    found = []
    for own, a, b in steps(sizes):
        d_lat, d_lon = y[own][a] - y[own][b], x[own][a] - x[own][b]
        near = d_lat * d_lat + d_lon * d_lon <= radius * radius
        a, b = a[near] + own.start, b[near] + own.start
        width = n_codes[b]
        at = np.repeat(starts[b] - (np.cumsum(width) - width), width) + np.arange(int(width.sum()))
        found.append(np.unique(np.repeat(a, width) * (n_values + 1) + code[at]))
    found = np.concatenate(found) if found else np.empty(0, dtype=np.int64)
    place, code = found // (n_values + 1), found % (n_values + 1)
    kept = np.unique(place)
    # Of rows at one place of a customer the first answers for all.
    _, first = np.unique(np.stack([group[kept], y[kept].view(np.int64), x[kept].view(np.int64)]), axis=1, return_index=True) if len(kept) else (None, kept)
    chosen = np.zeros(len(y), dtype=bool)
    chosen[kept[first]] = True
    listed = chosen[place] & (code < n_values)
    kept, ends = np.flatnonzero(chosen), np.cumsum(np.bincount(place[listed], minlength=len(y))[chosen])
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), values.dictionary.take(pa.array(code[listed])))
    columns = [batch.column(0).take(pa.array(group[kept])), lat.take(pa.array(kept)), lon.take(pa.array(kept)), lists]
    return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)


def _near_mccs_by_cells(visits: DataFrame, radius: float) -> DataFrame:
    used = visits.select("customer_id", *POINT, F.explode("mccs").alias("mcc")).withColumn("_one", F.lit(1))
    found = radius_aggregate(
        visits.select("customer_id", *POINT), used, radius, "_one", "_n", by=["customer_id"], group=["mcc"]
    )
    return found.groupBy("customer_id", *POINT).agg(F.collect_list("mcc").alias("near_mccs"))


def district_apartments(points: DataFrame, apartments: DataFrame, radius: float = fixed.RADIUS) -> DataFrame:
    """Each distinct point with every apartment building within `radius`."""
    others = apartments.withColumnsRenamed({"lat": "a_lat", "lon": "a_lon"})
    return radius_join(points.select(*POINT).distinct(), others, radius, right_on=("a_lat", "a_lon"))


def district_apartment_units(points: DataFrame, apartments: DataFrame, radius: float = fixed.RADIUS) -> DataFrame:
    """(lat, lon, units): flats within `radius` of each distinct point, 0 for none."""
    distinct = points.select(*POINT).distinct()
    found = radius_aggregate(distinct, apartments, radius, "units", "units")
    return distinct.join(found, POINT, "left").select(*POINT, F.coalesce("units", F.lit(0)).alias("units"))


WORD = 64
WORDS = 4


def _reached_alike(places: DataFrame, apartments: DataFrame, radius: float) -> DataFrame:
    """(lat, lon, units): buildings that the same places reach, as one with all their flats at the smallest point of theirs.

    Every cluster has all or none of such buildings, however many there are. Sets of places are told apart by two sums of
    40 bits of hashes within a cell of the grid. Buildings that no place reaches go.
    """
    spots = cut_lineage(apartments.groupBy(*POINT).agg(F.sum(F.col("units").cast("bigint")).alias("units")))
    hashed = [F.shiftrightunsigned(F.xxhash64(F.lit(part), *POINT), 24) for part in (0, 1)]
    marks = places.select(*POINT, F.posexplode(F.array(*hashed)).alias("_part", "_mark"))
    found = radius_aggregate(spots, marks, radius, "_mark", "_sum", group=["_part"])
    sets = found.groupBy(*POINT).agg(*[F.max(F.when(F.col("_part") == part, F.col("_sum"))).alias(f"_set_{part}") for part in (0, 1)])
    cell = [F.floor(F.col(c) / radius).alias(f"_cell_{c}") for c in POINT]
    alike = spots.join(sets, POINT).groupBy("_set_0", "_set_1", *cell).agg(
        F.min(F.struct(*POINT)).alias("_first"), F.sum("units").alias("units"))
    return alike.select("_first.*", "units")


def cluster_apartment_units(clustered: DataFrame, apartments: DataFrame, radius: float = fixed.RADIUS) -> DataFrame:
    """(customer_id, cluster_id, cluster_units): flats of distinct buildings near any point of a cluster.

    Buildings that the same places reach count as one. They are numbered along strips one radius wide, and each run of 256
    neighbours shares a row of four words of bits. A place then is a few such rows of buildings in reach, worked out once and not per
    customer; a cluster is their bitwise union. The flats in a word follow from one mask per
    binary digit of the number of flats, and one more per digit for buildings with a negative number.
    """
    cluster = ["customer_id", "cluster_id"]
    places = cut_lineage(clustered.select(*POINT).distinct())
    flats = _reached_alike(places, apartments, radius).withColumn("_strip", F.floor(F.col("lat") / radius))
    marked = cut_lineage(
        add_row_id(flats, ["_strip", "lon", "lat"], "_number")
        .withColumn("_word", F.floor(F.col("_number") / WORD))
        .withColumn("_mark", F.expr(f"shiftleft(1L, cast(_number % {WORD} as int))"))
        .select("lat", "lon", "units", "_word", "_mark")
    )
    least, most = marked.agg(F.min("units"), F.max("units")).first()
    # (sign, binary digit) of what the numbers of flats are made of.
    digits = [(1, d) for d in range(max(0, most or 0).bit_length())] + [(-1, d) for d in range(max(0, -(least or 0)).bit_length())]
    run, place = F.floor(F.col("_word") / WORDS).alias("_run"), F.col("_word") % WORDS
    none = F.lit(0).cast("bigint")

    def mask(word, sign, digit):
        size = F.greatest(F.col("units") * F.lit(sign), none)
        chosen = (place == word) & (size.bitwiseAND(F.lit(1 << digit)) != 0)
        return F.bit_or(F.when(chosen, F.col("_mark")).otherwise(none)).alias(f"_mask_{word}_{sign}_{digit}")

    masks = marked.groupBy(run).agg(F.count(F.lit(1)).alias("_n"), *[mask(w, s, d) for w in range(WORDS) for s, d in digits]).drop("_n")
    # The marks of a word are different bits, so their sum is their union.
    reach = (
        radius_aggregate(places, marked, radius, "_mark", "_bits", group=["_word"])
        .groupBy(*POINT, run).agg(
            *[F.bit_or(F.when(place == w, F.col("_bits")).otherwise(none)).alias(f"_bits_{w}") for w in range(WORDS)])
    )
    # Places of a cluster come together first, so that where the rows in reach are few and broadcast, each task unites most of them.
    together = clustered.select(*cluster, *POINT).hint("rebalance", *cluster)
    met = together.join(celltree.counted(cut_lineage(reach)), POINT).groupBy(*cluster, "_run").agg(
        *[F.bit_or(f"_bits_{w}").alias(f"_bits_{w}") for w in range(WORDS)])
    total = none
    for w in range(WORDS):
        for s, d in digits:
            total = total + F.bit_count(F.col(f"_bits_{w}").bitwiseAND(F.col(f"_mask_{w}_{s}_{d}"))) * F.lit(s << d)
    return met.join(masks, "_run").groupBy(*cluster).agg(F.sum(total).alias("cluster_units"))
