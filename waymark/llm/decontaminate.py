"""Benchmark items inside documents, by MinHash containment search over items partitioned by size.

An item is contained where a document holds at least `share` of the item's different shingles; the length of the
document doesn't matter. Items fall into classes by the length of their shingles and by size: from 2 ** p to
2 ** (p + 1) - 1 shingles. An item has a bottom-k MinHash signature, its shingles with the k smallest hashes. The k of a class
follows from the largest size in it: k = n - ceil(share * n) + 1, which never falls as n grows, so it is enough for each
item of the class. A document that lacks all k of an item's lacks too many of its shingles, so every container shares a
signature hash with its item, and no such pair is lost.

A document probes each class by itself: classes whose smallest items need more shingles than it has are left out, as are those of
which it has no signature hash. In the others it gives the shingles that some item of the class has. They are counted as
strings for each item, which makes the result exact.

Signatures and items go to the tasks in blocks, dealt along the classes, of about `block_shingles` shingles; more items mean
more passes over the documents. Documents stay where they are: what is shuffled is their shingles that some item has.

Words are lower-cased runs of letters and digits. Items with fewer words than a shingle are one shingle, found in
documents with those words in a row. Null texts and texts without words contain nothing; items without words are in no document.
Rows are judged by their own text: of rows that repeat an id, each different text gives rows of its own, equal ones give them
once. Items that repeat an id are one item with the shingles of all its texts. Columns beside ids and texts play no part; `clean`
leaves them as they are, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from waymark.llm.common import hashes, run_hashes, small, travels, unused, utf8
from waymark.materialize import Written

travels(__name__)

WORDS = re.compile(r"[^\W_]+")


@dataclass(frozen=True)
class ContainmentRules:
    width: int = 5
    share: float = 0.8
    block_shingles: int = 1_000_000


def normal_words(text: bytes) -> list[bytes]:
    if text.isascii():
        return re.findall(rb"[^\W_]+", text.lower())
    return [w.encode() for w in WORDS.findall(text.decode(errors="replace").lower())]


def _item_shingles(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """(item_id, shingle, length in words, hash), each shingle of an item once."""
    for batch in batches:
        ids, texts, lengths, codes = [], [], [], []
        for item, value in zip(batch.column(0).to_pylist(), utf8(batch.column(1))):
            words = normal_words(value or b"")
            length = min(width, len(words))
            own = {}
            for i, h in enumerate(run_hashes(hashes(words), width).tolist()):
                own.setdefault(b" ".join(words[i:i + length]).decode(), h)
            ids += [item] * len(own)
            texts += own
            lengths += [length] * len(own)
            codes += own.values()
        yield pa.RecordBatch.from_arrays([
            pa.array(ids, pa.int64()), pa.array(texts, pa.string()), pa.array(lengths, pa.int32()), pa.array(np.array(codes, np.uint64).view(np.int64))],
            ["item_id", "shingle", "length", "hash"])


def signature_size(n: Column, share: float) -> Column:
    """How many shingles of n the signature must have, so that a container can't lack them all."""
    return (n - F.ceil(n * share - 1e-9) + 1).cast("long")


def items_of(benchmark: DataFrame, rules: ContainmentRules) -> DataFrame:
    """(item_id, shingle, length, hash, n, partition, in_signature): every shingle of every item, once for each text of an item."""
    width = rules.width
    made = Written(benchmark.select("item_id", "text").filter(F.col("item_id").isNotNull() & F.col("text").isNotNull()).distinct()
                   .mapInArrow(lambda b: _item_shingles(b, width), "item_id bigint, shingle string, length int, hash bigint").distinct()).df
    # An item of several texts may have shingles of several lengths; it belongs to the class of the longest with all of them.
    sizes = made.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"), F.max("length").alias("longest"))
    partition = F.length(F.bin("n")).cast("int") - 1
    sized = made.join(sizes.withColumn("partition", partition), "item_id")
    largest = (F.pow(F.lit(2.0), F.col("partition") + 1) - 1).cast("long")
    # The window holds the shingles of one item.
    rank = F.row_number().over(W.partitionBy("item_id").orderBy(F.xxhash64("hash"), "shingle"))
    return sized.withColumn("in_signature", rank <= signature_size(largest, rules.share))


@dataclass(frozen=True)
class SizeClass:
    """What a document is probed with: for each length of shingles, sorted hashes of signatures and of all shingles."""

    least: int
    lengths: dict[int, tuple[np.ndarray, np.ndarray]]


def _found(batches: Iterator[pa.RecordBatch], width: int, classes: list[SizeClass]) -> Iterator[pa.RecordBatch]:
    """(row, content, shingle) of each document that has a signature hash of a class: its shingles, once each, that any item of the class has."""
    used = sorted({length for c in classes for length in c.lengths})
    for batch in batches:
        rows, contents, found = [], [], []
        for row, content, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), utf8(batch.column(2))):
            if not value:
                continue
            words = normal_words(value)
            codes = hashes(words)
            runs = {length: run_hashes(codes, length) for length in used if len(words) >= length}
            own: set[str] = set()
            for c in classes:
                mine = {length: tables for length, tables in c.lengths.items() if length in runs}
                if sum(len(runs[length]) for length in mine) < c.least or not any(_among(runs[length], s).any() for length, (s, _) in mine.items()):
                    continue
                for length, (_, every) in mine.items():
                    own.update(b" ".join(words[i:i + length]).decode() for i in np.flatnonzero(_among(runs[length], every)).tolist())
            rows += [row] * len(own)
            contents += [content] * len(own)
            found += own
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(contents, pa.int64()), pa.array(found, pa.string())], ["row", "content", "shingle"])


def _among(h: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if len(ordered) == 0:
        return np.zeros(len(h), bool)
    at = np.searchsorted(ordered, h)
    at[at == len(ordered)] = 0
    return ordered[at] == h


def dealt(items: DataFrame, block_shingles: int) -> tuple[DataFrame, int]:
    """Items with a block each, and how many blocks: small classes share one, large ones are split by item."""
    # One row for each length and power of two.
    sizes = items.groupBy("longest", "partition").count().orderBy("longest", "partition").collect()
    first, filled, block = [], 0, 0
    for r in sizes:
        if filled and filled + r["count"] > block_shingles:
            block, filled = block + 1, 0
        parts = math.ceil(r["count"] / block_shingles)
        first.append((r["longest"], r["partition"], block, parts))
        block, filled = block + parts - 1, filled + r["count"] if parts == 1 else block_shingles
    at = F.lit(0)
    for longest, partition, start, parts in first:
        at = F.when((F.col("longest") == longest) & (F.col("partition") == partition), start + F.pmod(F.xxhash64("item_id"), F.lit(parts))).otherwise(at)
    return items.withColumn("block", at.cast("int")), block + 1


def _contained(docs: DataFrame, benchmark: DataFrame, rules: ContainmentRules) -> DataFrame:
    """(doc_id, content, item_id, shared, n): `content` is a hash that tells the texts of an id apart."""
    items = Written(items_of(benchmark, rules)).df
    if items.isEmpty():
        return docs.sparkSession.createDataFrame([], "doc_id long, content long, item_id long, shared long, n long")
    items, blocks = dealt(items, rules.block_shingles)
    out = _contained_in(docs, items.filter("block = 0"), rules)
    for b in range(1, blocks):
        out = out.unionByName(_contained_in(docs, items.filter(F.col("block") == b), rules))
    return out


def contained(docs: DataFrame, benchmark: DataFrame, rules: ContainmentRules = ContainmentRules()) -> DataFrame:
    """(doc_id, item_id, shared, n, containment) of every document that contains an item."""
    found = _contained(docs, benchmark, rules).select("doc_id", "item_id", "shared", "n").distinct()
    return found.withColumn("containment", F.col("shared") / F.col("n"))


def _contained_in(docs: DataFrame, items: DataFrame, rules: ContainmentRules) -> DataFrame:
    """One block of items, of bounded size."""
    width = rules.width
    known = items.select("longest", "partition", "n", "length", "hash", "in_signature").toPandas()
    ordered = lambda codes: np.sort(np.unique(codes.to_numpy()).view(np.uint64))
    classes = [
        SizeClass(math.ceil(int(c["n"].min()) * rules.share - 1e-9), {
            int(length): (ordered(g.loc[g["in_signature"], "hash"]), ordered(g["hash"])) for length, g in c.groupby("length")})
        for _, c in known.groupby(["longest", "partition"])]
    rows = docs.select(F.col("doc_id").cast("long").alias("row"), F.xxhash64("text").alias("content"), "text").filter("row is not null and text is not null")
    hits = rows.mapInArrow(lambda b: _found(b, width, classes), "row bigint, content bigint, shingle string").distinct()
    mine = F.broadcast(items.select("item_id", "shingle", "n", "in_signature"))
    return (
        hits.join(mine, "shingle").groupBy(F.col("row").alias("doc_id"), "content", "item_id")
        .agg(F.count(F.lit(1)).alias("shared"), F.max("n").alias("n"), F.max("in_signature").alias("met"))
        .filter(F.col("met") & (F.col("shared") >= F.ceil(F.col("n") * rules.share - 1e-9)))
        .select("doc_id", "content", "item_id", "shared", "n")
    )


def clean(docs: DataFrame, benchmark: DataFrame, rules: ContainmentRules = ContainmentRules()) -> DataFrame:
    """The rows of `docs` that contain no item; rows without an id stay."""
    own, content = unused(docs, "gone_id"), unused(docs, "gone_content")
    gone = Written(_contained(docs, benchmark, rules).select(F.col("doc_id").alias(own), F.col("content").alias(content)).distinct()).df
    return docs.join(small(gone), (F.col("doc_id") == F.col(own)) & (F.xxhash64("text") == F.col(content)), "left_anti").select(*docs.columns)


def contained_sql(rules: ContainmentRules = ContainmentRules()) -> str:
    """`contained` of tables `documents` and `benchmark` as SQL text, by counting the shingles of all documents."""
    words = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')"
    runs = "unnest(list_transform(range(1, len(w) - length + 2), lambda i: array_to_string(w[i:i + length - 1], ' '))) AS shingle"
    return f"""
WITH item_words AS (SELECT item_id, {words} AS w FROM benchmark WHERE item_id IS NOT NULL),
item_lengths AS (SELECT item_id, w, CAST(least({rules.width}, len(w)) AS BIGINT) AS length FROM item_words WHERE len(w) > 0),
of_items AS (SELECT DISTINCT item_id, length, {runs} FROM item_lengths),
document_words AS (SELECT doc_id, row_number() OVER () AS row, {words} AS w FROM documents WHERE doc_id IS NOT NULL),
of_documents AS (SELECT DISTINCT doc_id, row, length, {runs} FROM document_words JOIN (SELECT DISTINCT length FROM of_items) ON len(w) >= length),
sizes AS (SELECT item_id, count(*) AS n FROM of_items GROUP BY item_id)
SELECT DISTINCT doc_id, item_id, count(*) AS shared, any_value(n) AS n, count(*) / any_value(n) AS containment
FROM of_documents JOIN of_items USING (length, shingle) JOIN sizes USING (item_id)
GROUP BY doc_id, row, item_id HAVING count(*) >= ceil(any_value(n) * {rules.share} - 1e-9)
"""
