import re

from waymark.llm import decontaminate


def brute(docs, items, share=0.8, width=5):
    shingles = lambda w, n: {tuple(w[i:i + n]) for i in range(len(w) - n + 1)}
    split = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    out = set()
    for item, text in items:
        words = split(text)
        n = min(width, len(words))
        own = shingles(words, n) if words and item is not None else set()
        for doc, body in docs:
            common = len(own & shingles(split(body), n)) if own and doc is not None else 0
            if own and common >= share * len(own) - 1e-9:
                out.add((doc, item, common, len(own)))
    return out


def items_for(spark, rows):
    texts = {r["doc_id"]: r["text"] for r in rows}
    words = texts[7].split()
    cut = texts[9].split()
    changed = cut[:40] + ["changed"] + cut[41:60]
    items = [(1, " ".join(words[30:60])), (2, " ".join(changed)), (3, None), (4, ""), (5, "ONE, two!"), (6, " ".join(words[10:14])), (7, "not to be found at all here"),
             (8, texts[3][:4000]), (None, "one"), (9, " ".join(words[30:60])), (10, "Äpfel Ñandú ß 漢字")]
    return items, spark.createDataFrame([(i, t, "x") for i, t in items], "item_id bigint, text string, doc_id string")


def test_pairs_equal_brute_force(spark, odd):
    rows = odd.collect()
    items, benchmark = items_for(spark, rows)
    want = brute({(r["doc_id"], r["text"]) for r in rows}, items)
    assert {1, 2, 5, 6, 8, 9, 10} <= {i for _, i, _, _ in want}
    for block in (1_000_000, 40):
        rules = decontaminate.ContainmentRules(block_shingles=block)
        got = [(r["doc_id"], r["item_id"], r["shared"], r["n"]) for r in decontaminate.contained(odd, benchmark, rules).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_clean_drops_them_alone(spark, odd, nothing):
    _, benchmark = items_for(spark, odd.collect())
    kept = decontaminate.clean(odd, benchmark)
    gone = {r["doc_id"] for r in decontaminate.contained(odd, benchmark).collect()}
    assert kept.columns == odd.columns and kept.count() == odd.filter(~odd.doc_id.isin(gone) | odd.doc_id.isNull()).count()
    assert decontaminate.clean(odd, benchmark.limit(0)).count() == odd.count()
    assert decontaminate.clean(nothing, benchmark).count() == 0


def test_signature_leaves_no_container_out(spark):
    from pyspark.sql import functions as F

    sizes = spark.range(1, 200).select("id", decontaminate.signature_size(F.col("id"), 0.8).alias("k")).collect()
    assert all(r["id"] - r["k"] < 0.8 * r["id"] - 1e-9 <= r["id"] - r["k"] + 1 for r in sizes)


def test_signature_of_a_class_is_enough_for_its_items(spark):
    from pyspark.sql import functions as F

    sizes = [r["k"] for r in spark.range(1, 600).select("id", decontaminate.signature_size(F.col("id"), 0.8).alias("k")).orderBy("id").collect()]
    assert sizes == sorted(sizes)
    items = spark.createDataFrame([(n, " ".join(f"i{n}x{k}" for k in range(n + 4))) for n in (1, 2, 3, 4, 7, 8, 31, 32, 100)], "item_id long, text string")
    rows = decontaminate.items_of(items, decontaminate.ContainmentRules()).groupBy("item_id", "n", "partition").agg(F.sum(F.col("in_signature").cast("int")).alias("k")).collect()
    assert len(rows) == 9 and all(r["n"] == r["item_id"] and r["partition"] == r["n"].bit_length() - 1 for r in rows)
    assert all(r["k"] == min(r["n"], sizes[2 ** (r["partition"] + 1) - 2]) >= sizes[r["n"] - 1] for r in rows)


def test_blocks_follow_the_classes(spark):
    items = spark.createDataFrame([(n * 10 + j, " ".join(f"i{n}x{j}x{k}" for k in range(n + 4))) for n in (1, 3, 6, 12, 50) for j in range(4)], "item_id long, text string")
    made = decontaminate.items_of(items, decontaminate.ContainmentRules())
    for size in (10 ** 6, 60, 25):
        dealt, blocks = decontaminate.dealt(made, size)
        rows = dealt.select("item_id", "partition", "block").distinct().collect()
        assert len(rows) == 20 and {r["block"] for r in rows} <= set(range(blocks)) and (size < 10 ** 6 or blocks == 1)
        order = sorted(rows, key=lambda r: r["partition"])
        assert all(a["block"] <= b["block"] for a, b in zip(order, order[1:]) if a["partition"] < b["partition"])


def test_rows_of_one_id_are_judged_by_their_own_text(spark):
    item = "one two three four five six seven eight nine ten eleven twelve"
    words = item.split()
    names = "doc_id long, text string, gone_id string, content string, shingle string"
    docs = spark.createDataFrame([
        (1, " ".join(words[:8]), "a", "b", "c"), (1, " ".join(words[4:]), "a", "b", "c"), (2, item, "a", "b", "c"), (2, "clean text of its own here", "a", "b", "c"),
        (3, item + " more", "a", "b", "c"), (3, item + " more", "a", "b", "c"), (None, item, "a", "b", "c")], names)
    benchmark = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert sorted((r["doc_id"], r["shared"]) for r in decontaminate.contained(docs, benchmark).collect()) == [(2, 8), (3, 8)]
    kept = decontaminate.clean(docs, benchmark)
    assert kept.columns == docs.columns and sorted((r["doc_id"] or 0, r["text"]) for r in kept.collect()) == sorted(
        [(1, " ".join(words[:8])), (1, " ".join(words[4:])), (2, "clean text of its own here"), (0, item)])


def test_sql_finds_short_items_and_repeated_ids(spark, odd):
    import duckdb

    rows = odd.collect()
    items, benchmark = items_for(spark, rows)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [(r["doc_id"], r["text"]) for r in rows])
    con.execute("CREATE TABLE benchmark (item_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO benchmark VALUES (?, ?)", [(i, t) for i, t in items])
    want = {(a, b, c, d) for a, b, c, d, _ in con.execute(decontaminate.contained_sql()).fetchall()}
    assert want == brute({(r["doc_id"], r["text"]) for r in rows}, items)
