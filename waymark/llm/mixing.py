"""Mixing sources to target weights by weighted sampling without replacement.

Targets. Sources in order of code points, null last, get the weights 1, 2, 3, repeating, and share all words. A target
stops at `most` times its source's size; the excess is shared again by weight until no target is above.

Sampling. A source is taken whole as often as its target allows. The rest of the target is filled by documents in the
order of Efraimidis and Spirakis: exponential keys -ln(u) / weight ascending, u from the md5 of the seed and the id, the
weight from the document's quality. Sizes are added up in that order until they come nearest to the rest.

A source may hold most rows, so nothing sorts a source as a whole. Keys fall into `bins`; the sums of the bins give the
bin in which the rest is reached. That bin is cut into `bins` again, from its least key to its greatest, until it holds no
more than `sorted_rows` rows or a single key, whatever the weights are; only these rows are sorted.

Null texts have no words, so they are taken whole but count nothing. An empty table gives no rows. Rows that repeat an id
and a text have the same key and are ordered among themselves at will; they have the same size. Rows that repeat an id with
another text, and equal keys, are ordered by id, then by a hash of the text. Rows without an id take their key from the text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from waymark.llm.common import n_words, small
from waymark.materialize import Written


@dataclass(frozen=True)
class MixRules:
    weights: tuple[int, ...] = (1, 2, 3)
    most: int = 3
    bins: int = 4096
    sorted_rows: int = 512
    seed: int = 17


#: All but letters and white space.
LETTERS = r"[^\p{L} \t\r\n]+"


def quality_weight(text: Column) -> Column:
    """From 0.1 to 1: the share of letters and white space in the text, low for tables, codes and signs."""
    letters = F.length(F.regexp_replace(text, LETTERS, ""))
    return F.coalesce(F.greatest(F.lit(0.1), F.try_divide(letters, F.length(text))), F.lit(0.1))


def exponential_key(doc_id: Column, text: Column, weight: Column, seed: int) -> Column:
    """-ln(u) / weight with u strictly between 0 and 1."""
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), text)))
    u = (F.conv(F.substring(h, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))
    return -F.log(u) / weight


def _ranked(sources: DataFrame, weights: tuple[int, ...]) -> DataFrame:
    """Sources with their weight. Rank = rows in lower ranges + rank within the range, so no task sorts all."""
    ranged = Written(sources.repartitionByRange(F.col("source").isNull(), F.col("source")).withColumn("part", F.spark_partition_id())).df
    # One row for each partition.
    counts = {r["part"]: r["count"] for r in ranged.groupBy("part").count().collect()}
    offsets, total = [], 0
    for part in range(max(counts, default=-1) + 1):
        offsets.append(total)
        total += counts.get(part, 0)
    rank = F.row_number().over(W.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1
    rank = rank + F.element_at(F.array(*[F.lit(o).cast("long") for o in offsets] or [F.lit(0).cast("long")]), F.col("part") + 1)
    choices = F.array(*[F.lit(w) for w in weights])
    return ranged.select("source", "source_size", F.element_at(choices, (F.pmod(rank, F.lit(len(weights))) + 1).cast("int")).alias("weight"))


def targets(sources: DataFrame, rules: MixRules = MixRules()) -> DataFrame:
    """(source, source_size, weight, target) of (source, source_size)."""
    ranked = Written(_ranked(sources, rules.weights)).df
    limit = F.col("source_size") * rules.most
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level = None
    while True:
        # Words for each unit of weight, once the sources that stop at their limit have theirs.
        stops = F.lit(False) if level is None else F.col("weight") * F.lit(level) >= limit
        held, units = ranked.agg(F.sum(F.when(stops, limit).otherwise(0)), F.sum(F.when(stops, 0).otherwise(F.col("weight")))).first()
        new = (total - (held or 0)) / units if units else None
        if new is None or level is not None and new <= level:
            break
        level = new
    target = F.least(limit.cast("double"), F.col("weight") * F.lit(level if level is not None else 0.0))
    return ranked.withColumn("target", target)


def _measured(docs: DataFrame, rules: MixRules, weight: Column | None) -> DataFrame:
    """`docs` with _size, _key and _tie."""
    text = F.col("text")
    key = exponential_key(F.col("doc_id"), text, quality_weight(text) if weight is None else weight, rules.seed)
    return docs.withColumns({"_size": n_words(text), "_key": key, "_tie": F.xxhash64("text")})


def _binned(keyed: DataFrame, *group: str) -> DataFrame:
    """Words, rows and range of keys of each bin; at most `bins` rows for each source."""
    return keyed.groupBy(*group, "_bin").agg(
        F.sum("_size").alias("_bin_size"), F.count(F.lit(1)).alias("_rows"), F.min("_key").alias("_low"), F.max("_key").alias("_high"))


def _crossing(bins: DataFrame) -> DataFrame:
    """Of bins with _start, the words taken before the first of them, and _rest: the one in which the rest is reached."""
    before = F.sum("_bin_size").over(W.partitionBy("_source").orderBy("_bin").rowsBetween(W.unboundedPreceding, -1))
    return bins.withColumn("_before", F.col("_start") + F.coalesce(before, F.lit(0))).filter(
        (F.col("_before") < F.col("_rest")) & (F.col("_before") + F.col("_bin_size") >= F.col("_rest"))
    ).select("_source", "_before", "_rest", "_rows", "_low", "_high")


def _within(measured: DataFrame, crossing: DataFrame) -> DataFrame:
    """The documents in the crossing bins: bins don't overlap, so the least and greatest key tell."""
    return measured.select("source", "_size", "_key", "doc_id", "_tie").join(
        small(crossing), F.col("source").eqNullSafe(F.col("_source")) & F.col("_key").between(F.col("_low"), F.col("_high")))


def _plan(measured: DataFrame, rules: MixRules) -> DataFrame:
    """For each source: target, whole epochs, and up to where in the order its documents are taken once more."""
    first_bin = F.floor((1 - F.exp(-F.col("_key"))) * rules.bins).cast("int")
    per_bin = Written(_binned(measured.select(F.col("source").alias("_source"), "_size", "_key", first_bin.alias("_bin")), "_source")).df
    sources = targets(per_bin.groupBy(F.col("_source").alias("source")).agg(F.sum("_bin_size").alias("source_size")), rules)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    sources = Written(sources.withColumn("_epochs", epochs).withColumn("_rest", F.col("target") - F.col("_epochs") * F.col("source_size"))).df
    same = F.col("source").eqNullSafe(F.col("_source"))
    crossing = Written(_crossing(per_bin.join(small(sources), same).withColumn("_start", F.lit(0).cast("long")))).df
    crowded = (F.col("_rows") > rules.sorted_rows) & (F.col("_low") < F.col("_high"))
    # A cut parts the least key from the greatest, so every round makes crowded bins smaller.
    bins = max(2, rules.bins)
    while not crossing.filter(crowded).isEmpty():
        at = F.floor((F.col("_key") - F.col("_low")) / (F.col("_high") - F.col("_low")) * bins)
        inner = _within(measured, crossing.filter(crowded)).select(
            "_source", F.col("_before").alias("_start"), "_rest", "_size", "_key", F.least(at, F.lit(bins - 1)).cast("int").alias("_bin"))
        crossing = Written(crossing.filter(~crowded).unionByName(_crossing(_binned(inner, "_source", "_start", "_rest")))).df
    order = W.partitionBy("_source").orderBy("_key", "doc_id", "_tie").rowsBetween(W.unboundedPreceding, W.currentRow)
    middle = F.col("_before") + F.sum("_size").over(order) - F.col("_size") / 2
    last = (
        _within(measured, crossing).withColumn("_middle", middle).filter("_middle <= _rest")
        .groupBy("_source").agg(F.max(F.struct("_key", "doc_id", "_tie")).alias("_last"))
    )
    cut = crossing.alias("c").join(last.withColumnRenamed("_source", "_s"), F.col("_source").eqNullSafe(F.col("_s")), "left")
    return Written(sources.join(cut.select("_source", "_low", "_last"), same, "left")
                   .select(F.col("source").alias("_source"), "source_size", "target", "_epochs", "_low", "_last")).df


def _taken(measured: DataFrame, plan: DataFrame) -> DataFrame:
    again = (F.col("_key") < F.col("_low")) | (F.struct("_key", "doc_id", "_tie") <= F.col("_last"))
    return measured.join(small(plan), F.col("source").eqNullSafe(F.col("_source"))).withColumn(
        "taken", F.col("_size") * (F.col("_epochs") + F.coalesce(again, F.lit(False)).cast("long")))


def mix(docs: DataFrame, rules: MixRules = MixRules(), weight: Column | None = None) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) of every row; `weight` replaces the weight from the text."""
    slim = Written(_measured(docs.select("doc_id", "source", "text"), rules, weight).drop("text")).df
    return _taken(slim, _plan(slim, rules)).select("doc_id", "source", F.col("_size").alias("size"), "source_size", "target", "taken")


def mixture(docs: DataFrame, rules: MixRules = MixRules(), weight: Column | None = None) -> DataFrame:
    """The rows of `docs` of which the mix takes words, with size, source_size, target and taken. The texts aren't shuffled.

    These four take the place of columns that have the same names; all others stay as they are.
    """
    added = {"size": "_size", "source_size": "source_size", "target": "target", "taken": "taken"}
    own = docs.drop(*added)
    slim = Written(_measured(own.select("doc_id", "source", "text"), rules, weight).drop("text")).df
    packed = own.select(F.struct(*own.columns).alias("_row"), "doc_id", "source", "text")
    out = _taken(_measured(packed, rules, weight), _plan(slim, rules)).filter("taken > 0")
    return out.select("_row.*", *[F.col(c).alias(name) for name, c in added.items()])


def mix_sql(rules: MixRules = MixRules()) -> str:
    """`mix` of table `documents` as SQL text, for ids that aren't null."""
    weights = " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(rules.weights))
    return f"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
    -ln((CAST(('0x' || substr(md5('{rules.seed}:' || doc_id), 1, 13)) AS BIGINT) + 0.5) / {float(1 << 52)!r})
      / coalesce(greatest(0.1, length(regexp_replace(text, '{LETTERS}', '', 'g')) / nullif(length(text), 0)), 0.1) AS key FROM documents),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(rules.weights)} {weights} END AS weight FROM sources),
filled AS (SELECT *, row_number() OVER o AS place,
    CAST((SELECT sum(source_size) FROM sources) - coalesce(sum({rules.most} * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
      / (sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS level
  FROM weighed WINDOW o AS (ORDER BY {rules.most} * source_size / weight, source)),
chosen AS (SELECT min_by(level, place) AS level FROM filled WHERE weight * level <= {rules.most} * source_size),
targets AS (SELECT w.*, least(CAST({rules.most} * source_size AS DOUBLE), weight * (SELECT level FROM chosen)) AS target FROM weighed w),
planned AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM targets),
ordered AS (SELECT d.doc_id, d.size, p.source_size, p.target, p.epochs, p.target - p.epochs * p.source_size AS rest,
    sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id ROWS UNBOUNDED PRECEDING) - d.size / 2 AS middle
  FROM sized d JOIN planned p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target, CAST(size * (epochs + CASE WHEN rest > 0 AND middle <= rest THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM ordered
"""
