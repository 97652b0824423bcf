"""Secret scan with DataFrame functions only: fixed patterns, and character runs of high entropy.

Three patterns give the base spans. What they leave is read for candidate strings, cut at everything but letters, digits and
`+ / _ -`, so that a name and its value are two. A sliding window counts the characters of a candidate; a step changes the
counts of the character that leaves and of the one that enters, and with them the sum of c * log2(c) from which the window's
Shannon entropy follows. A candidate whose windows reach the threshold of its character class is a span (runs of letters and
base 32 whose letter pairs are not those of words have lower thresholds of their own), unless the allow-list names it. One
that is no span as a whole is cut at `/`, and each part judged by itself, allow-list included.

Null and empty texts have no spans. Positions are code points, ends exclusive. Each row is judged by itself, so rows that
repeat an id or a text give one result each. Spans that begin together stand in the order of `KINDS`. Columns beside the text
play no part; `redacted` keeps them, whatever their names.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import unused

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Runs that are too short are dropped, so the shortest lengths can stand in the pattern.
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
ASSIGN_LENGTH = 8
KINDS = ("assign", "access", "hex", "entropy")
#: Candidates for the entropy scan, and parts of one: runs of at least so many characters.
CANDIDATE = r"[A-Za-z0-9+/_-]{%d,}"
PART = r"[A-Za-z0-9+_-]{%d,}"

#: First letter: letters that often follow it within words of Latin script. Random letters have about a third of such pairs, words most.
FOLLOWS = {
    "a": "bcdgilmnprstuvy", "b": "aeiloru", "c": "aehikloqrtu", "d": "aeiorsu", "e": "acdefgilmnprstuvwx", "f": "aefiortu", "g": "aehiloru",
    "h": "aeinorut", "i": "abcdefglmnoprstvz", "j": "aeou", "k": "aeino", "l": "adefilostuy", "m": "abeimopsu", "n": "acdefgiknostu",
    "o": "bcdfgilmnoprstuvw", "p": "aehiloprstu", "q": "u", "r": "acdegiklmnorstuy", "s": "acehiklmopstu", "t": "aehiorstuz", "u": "abcdeglmnprst",
    "v": "aeio", "w": "aehio", "x": "ept", "y": "eos", "z": "aeiu"}
COMMON_PAIR = "(?i)(?=" + "|".join(f"{a}[{b}]" for a, b in FOLLOWS.items()) + ")"


@dataclass(frozen=True)
class EntropyRule:
    """Windows and thresholds (bits for each character) of the entropy scan."""

    window: int = 20
    #: (class, pattern of the whole candidate, least entropy of a window); the first that fits counts.
    classes: tuple[tuple[str, str, float], ...] = (
        ("hex", r"^[0-9A-Fa-f]+$", 2.9),
        ("letters", r"^[A-Za-z]+$", 4.05),
        ("mixed", r"[A-Za-z]", 3.65),
    )
    #: The same for runs of which no more than `pairs` of all pairs are common within words: what glued words are told apart by.
    unlike_words: tuple[tuple[str, str, float], ...] = (
        ("one case", r"^(?:[A-Z]+|[a-z]+)$", 3.2),
        ("two cases", r"^[A-Za-z]+$", 3.6),
        ("base 32", r"^(?:[A-Z2-7]+|[a-z2-7]+)$", 3.35),
    )
    pairs: float = 0.6
    #: Candidates that are no secrets: numbers, words joined by signs, identifiers in 8-4-4-4-12 form, stand-ins.
    allowed: tuple[str, ...] = (
        r"^[0-9_+/=-]+$",
        r"^[a-z]+([_/+=-]+[a-z]+)+$",
        r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",
        r"(?i:example|sample|dummy|placeholder|changeme|abcdefghijkl|0123456789)",
    )


@dataclass(frozen=True)
class SecretRules:
    entropy: EntropyRule = field(default_factory=EntropyRule)


def _span(start: Column, kind: int, end: Column) -> Column:
    return F.struct(start.cast("long").alias("start"), F.lit(kind).alias("kind"), end.cast("long").alias("end"))


_SPANS = "array<struct<start:bigint,kind:int,end:bigint>>"


def _none() -> Column:
    return F.array().cast(_SPANS)


def _let(value: Column, body) -> Column:
    """`body` of a value that is computed once, however often `body` names it."""
    return F.transform(F.array(value), body)[0]


#: Lists are walked in stretches of so many entries, so that no step copies a whole list.
STRETCH = 256


def _placed(text: Column, pattern: str) -> Column:
    """(start, end, hit) of the leftmost non-overlapping matches.

    What lies between the matches and the matches themselves, laid end to end, give every position: first the length of each
    stretch of matches, then the positions within it.
    """
    parts = F.split(text, pattern, -1)
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.filter(F.arrays_zip(parts.alias("part"), hits.alias("hit")), lambda x: x["hit"].isNotNull())
    nothing = F.array().cast("array<struct<start:bigint,end:bigint,hit:string>>")

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + F.length(x["part"])
        end = start + F.length(x["hit"])
        return F.struct(end.alias("at"), F.concat(state["out"], F.array(F.struct(start.alias("start"), end.alias("end"), x["hit"].alias("hit")))).alias("out"))

    def walked(stretches: Column) -> Column:
        lengths = F.transform(stretches, lambda s: F.aggregate(s, F.lit(0).cast("long"), lambda n, x: n + F.length(x["part"]) + F.length(x["hit"])))
        return _let(lengths, lambda sums: F.flatten(F.transform(stretches, lambda s, j: F.aggregate(
            s, F.struct(F.aggregate(F.slice(sums, 1, j), F.lit(0).cast("long"), lambda n, x: n + x).alias("at"), nothing.alias("out")), step, lambda state: state["out"]))))

    stretches = _let(pieces, lambda all_: F.transform(
        F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / STRETCH).cast("int")), lambda j: F.slice(all_, j * STRETCH + 1, STRETCH)))
    return F.when(text.rlike(pattern), _let(stretches, walked)).otherwise(nothing)


def _matches(text: Column, pattern: str, kind: int, keep) -> Column:
    """Spans of the matches that `keep` accepts."""
    return F.transform(F.filter(_placed(text, pattern), lambda m: keep(m["hit"])), lambda m: _span(m["start"], kind, m["end"]))


def _blanked(text: Column, pattern: str, keep) -> Column:
    """`text` with as many marks in place of each match that `keep` accepts."""
    parts = F.split(text, pattern, -1)
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    cut = F.array_join(F.transform(F.arrays_zip(parts.alias("part"), hits.alias("hit")), lambda x: F.concat(
        x["part"], F.when(x["hit"].isNull(), "").when(keep(x["hit"]), F.repeat(F.lit(MARK), F.length(x["hit"]))).otherwise(x["hit"]))), "")
    return F.when(text.rlike(pattern), cut).otherwise(text)


MARK = "\u0001"


def _long_enough(hit: Column) -> Column:
    return F.length(F.regexp_extract(hit, ASSIGN, 1)) >= ASSIGN_LENGTH


def _anything(hit: Column) -> Column:
    return F.lit(True)


BASE = ((ASSIGN, _long_enough), (ACCESS, _anything), (HEX, _anything))


def base_spans(text: Column) -> Column:
    """Spans of the three patterns, sorted by start, then kind."""
    return F.array_sort(F.concat(*[_matches(text, pattern, kind, keep) for kind, (pattern, keep) in enumerate(BASE)]))


def _weight(count: Column) -> Column:
    """c * log2(c), 0 for 0."""
    return F.when(count > 1, count * F.log2(count.cast("double"))).otherwise(F.lit(0.0))


def highest_entropy(candidate: Column, window: int) -> Column:
    """The largest Shannon entropy of any window of `window` characters, in bits; null for shorter candidates."""
    # Every stretch goes on into the next one until its last window is whole.
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.length(candidate) - window) / STRETCH).cast("int")))
    stretches = F.transform(starts, lambda i: candidate.substr(i * STRETCH + 1, F.lit(STRETCH + window - 1)))
    return F.array_max(F.transform(F.filter(stretches, lambda s: F.length(s) >= window), lambda s: _let(
        F.split(s, ""), lambda characters: _highest_in(characters, window))))


def _highest_in(characters: Column, window: int) -> Column:
    counts = _let(F.slice(characters, 1, window), lambda first: _let(F.array_distinct(characters), lambda kinds: F.map_from_arrays(
        kinds, F.transform(kinds, lambda c: F.size(F.filter(first, lambda x: x == c))))))

    def step(state: Column, at: Column) -> Column:
        """The window moves by one character: the count of the one that leaves falls, that of the one that enters rises."""
        leaves, enters = F.get(characters, at - 1), F.get(characters, at + window - 1)
        before, after = F.element_at(state["counts"], leaves), F.element_at(state["counts"], enters)
        changed = state["total"] - _weight(before) + _weight(before - 1) - _weight(after) + _weight(after + 1)
        total = F.when(leaves == enters, state["total"]).otherwise(changed)
        moved = F.transform_values(state["counts"], lambda c, n: F.when(c == enters, n + 1).when(c == leaves, n - 1).otherwise(n))
        counts = F.when(leaves == enters, state["counts"]).otherwise(moved)
        return F.struct(counts.alias("counts"), total.alias("total"), F.least(state["least"], total).alias("least"))

    moves = F.when(F.size(characters) > window, F.sequence(F.lit(1), F.size(characters) - window)).otherwise(F.array().cast("array<int>"))
    begun = _let(counts, lambda held: _let(
        F.aggregate(F.map_values(held), F.lit(0.0), lambda s, n: s + _weight(n)),
        lambda whole: F.struct(held.alias("counts"), whole.alias("total"), whole.alias("least"))))
    return F.lit(math.log2(window)) - F.aggregate(moves, begun, step, lambda s: s["least"]) / F.lit(float(window))


def _suspicious(candidate: Column, rule: EntropyRule) -> Column:
    def least(classes: tuple[tuple[str, str, float], ...]) -> Column:
        bits = F.lit(None).cast("double")
        for _, pattern, at_least in reversed(classes):
            bits = F.when(candidate.rlike(pattern), at_least).otherwise(bits)
        return bits

    unlike = F.regexp_count(candidate, F.lit(COMMON_PAIR)) <= rule.pairs * (F.length(candidate) - 1)
    usual = least(rule.classes)
    threshold = F.least(usual, F.when(least(rule.unlike_words).isNotNull() & unlike, least(rule.unlike_words)))
    allowed = F.lit(False)
    for pattern in rule.allowed:
        allowed = allowed | candidate.rlike(pattern)
    return ~allowed & F.coalesce(highest_entropy(candidate, rule.window) >= threshold, F.lit(False))


def entropy_spans(text: Column, base: Column, rule: EntropyRule) -> Column:
    """Spans of high entropy in what the `base` spans of `text` leave."""
    rest = text
    for pattern, keep in BASE:
        rest = _blanked(rest, pattern, keep)
    rest = F.when(F.size(base) > 0, rest).otherwise(text)

    def spans(c: Column) -> Column:
        parts = F.filter(_placed(c["hit"], PART % rule.window), lambda p: _suspicious(p["hit"], rule))
        within = F.transform(parts, lambda p: _span(c["start"] + p["start"], 3, c["start"] + p["end"]))
        return F.when(_suspicious(c["hit"], rule), F.array(_span(c["start"], 3, c["end"]))).when(c["hit"].contains("/"), within).otherwise(_none())

    found = F.flatten(F.transform(_placed(rest, CANDIDATE % rule.window), spans))
    # Where two base spans overlap, a rest of one may have stayed.
    return F.filter(found, lambda e: ~F.exists(base, lambda b: (b["start"] < e["end"]) & (e["start"] < b["end"])))


def _written(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def with_spans(docs: DataFrame, text: str = "text", rules: SecretRules = SecretRules(), base: str = "base_spans", found: str = "spans") -> DataFrame:
    """`docs` with two columns of spans (start, kind as index of `KINDS`, end): `base`, and `found` with all of them."""
    body = F.coalesce(F.col(text), F.lit(""))
    docs = docs.withColumn(base, base_spans(body))
    return docs.withColumn(found, F.array_sort(F.concat(F.col(base), entropy_spans(body, F.col(base), rules.entropy))))


def scan(docs: DataFrame, rules: SecretRules = SecretRules()) -> DataFrame:
    """(doc_id, base_spans, spans) of every document."""
    return with_spans(docs.select("doc_id", "text"), rules=rules).select("doc_id", "base_spans", "spans")


def digest(scanned: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_entropy, base_sha256, spans) of what `scan` returns."""
    number = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return scanned.select(
        "doc_id", *[number(k).alias(f"n_{name}") for k, name in enumerate(KINDS)],
        F.sha2(_written(F.col("base_spans")), 256).alias("base_sha256"), _written(F.col("spans")).alias("spans"))


def redacted(docs: DataFrame, rules: SecretRules = SecretRules(), mark: str = "[secret]") -> DataFrame:
    """`docs` with every span of `text` replaced by `mark`; `n_chars`, where there is one, follows the new text. Null texts stay null.

    All other columns stay as they are, whatever their names.
    """
    found = unused(docs, "spans")
    marked = with_spans(docs, rules=rules, base=unused(docs, "base_spans"), found=found)

    def step(state: Column, s: Column) -> Column:
        """Spans may overlap; each starts no earlier than the one before."""
        fresh = s["start"] >= state["at"]
        gap = F.col("text").substr((state["at"] + 1).cast("int"), (s["start"] - state["at"]).cast("int"))
        return F.struct(
            F.greatest(state["at"], s["end"]).alias("at"),
            F.when(fresh, F.concat(state["out"], F.array(gap, F.lit(mark)))).otherwise(state["out"]).alias("out"))

    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))
    cut = F.aggregate(found, zero, step, lambda s: F.concat(
        F.array_join(s["out"], ""), F.col("text").substr((s["at"] + 1).cast("int"), F.length("text"))))
    hit = F.size(found) > 0
    out = marked.withColumn("text", F.when(hit, cut).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(hit, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def scan_sql(rules: SecretRules = SecretRules()) -> str:
    """`digest` of the scan of table `documents` as SQL text. Windows are counted afresh there."""
    quoted = lambda p: "'" + p.replace("'", "''") + "'"
    # Either case of ASCII letters, spelled out: SQL's (?i:) knows more letters.
    keywords = re.search(r"\(\?i:([^)]*)\)", ASSIGN)
    ascii_assign = ASSIGN.replace(keywords[0], "(?:" + re.sub("[a-z]", lambda c: f"[{c[0].upper()}{c[0]}]", keywords[1]) + ")")
    assign = quoted(ascii_assign)
    window, e = rules.entropy.window, rules.entropy
    keeps = (f"length(regexp_extract(h, {assign}, 1)) >= {ASSIGN_LENGTH}", "TRUE", "TRUE")

    def placed(name: str, of: str, columns: str, text: str, pattern: str) -> str:
        """Matches with their start in `text`."""
        return f"""
{name} AS (SELECT {columns}, hit, CAST(list_sum(list_transform(parts[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS start
  FROM (SELECT {columns}, parts, hits, unnest(hits) AS hit, generate_subscripts(hits, 1) AS i FROM (
    SELECT {columns}, regexp_extract_all({text}, {quoted(pattern)}) AS hits, string_split_regex({text}, {quoted(pattern)}) AS parts FROM {of})))"""

    def blanked(name: str, of: str, pattern: str, keep: str) -> str:
        return f"""
{name} AS (SELECT doc_id, row, array_to_string(list_transform(range(1, len(parts) + 1), lambda i:
    parts[i] || coalesce(list_transform(hits[i:i], lambda h: CASE WHEN {keep} THEN repeat(chr(1), length(h)) ELSE h END)[1], '')), '') AS t
  FROM (SELECT doc_id, row, regexp_extract_all(t, {quoted(pattern)}) AS hits, string_split_regex(t, {quoted(pattern)}) AS parts FROM {of}))"""

    count = "(length(w) - length(replace(w, c, '')))"
    weight = f"list_sum(list_transform(list_distinct(string_split(w, '')), lambda c: CASE WHEN {count} > 1 THEN {count} * log2({count}) ELSE 0.0 END))"
    entropy = f"list_max(list_transform(list_transform(range(1, length(hit) - {window - 2}), lambda i: substr(hit, i, {window})), lambda w: {math.log2(window)!r} - {weight} / {window}))"
    bits = lambda classes: "CASE " + " ".join(f"WHEN regexp_matches(hit, {quoted(p)}) THEN {least}" for _, p, least in classes) + " END"
    pairs = "[" + ", ".join(f"'{a}{b}'" for a, follow in FOLLOWS.items() for b in follow) + "]"
    common = f"len(list_filter(range(1, length(hit)), lambda i: list_contains({pairs}, substr(lower(hit), i, 2))))"
    allowed = " OR ".join(f"regexp_matches(hit, {quoted(p)})" for p in e.allowed)
    threshold = f"least({bits(e.classes)}, CASE WHEN {common} <= {e.pairs} * (length(hit) - 1) THEN {bits(e.unlike_words)} END)"
    suspicious = f"(NOT ({allowed}) AND coalesce({entropy} >= {threshold}, FALSE))"
    names = "[" + ", ".join(f"'{k}'" for k in KINDS) + "]"
    written = f"{names}[kind + 1] || ':' || start || ':' || stop"
    kinds = (ascii_assign, ACCESS, HEX)
    return f"""
WITH docs AS (SELECT doc_id, row_number() OVER () AS row, coalesce(text, '') AS t FROM documents),
{','.join(placed(f'placed{k}', 'docs', 'doc_id, row', 't', p) for k, p in enumerate(kinds))},
base AS ({' UNION ALL '.join(f'SELECT row, {k} AS kind, start, start + length(hit) AS stop FROM placed{k} WHERE {keeps[k].replace("(h,", "(hit,")}' for k in range(3))}),
{','.join(blanked(f'blank{k}', 'docs' if k == 0 else f'blank{k - 1}', p, keeps[k]) for k, p in enumerate(kinds))},
{placed('candidates', 'blank2', 'row', 't', CANDIDATE % window)},
judged AS (SELECT row, hit, start, {suspicious} AS secret FROM candidates),
others AS (SELECT row, hit AS whole, start AS first FROM judged WHERE NOT secret AND contains(hit, '/')),
{placed('parts', 'others', 'row, first', 'whole', PART % window)},
entropies AS (SELECT row, start, start + length(hit) AS stop FROM judged WHERE secret
  UNION ALL SELECT row, first + start AS start, first + start + length(hit) AS stop FROM parts WHERE {suspicious}),
spans AS (SELECT * FROM base UNION ALL SELECT row, 3 AS kind, start, stop FROM entropies s
  WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.row = s.row AND b.start < s.stop AND s.start < b.stop)),
digests AS (SELECT row, {', '.join(f'count(*) FILTER (WHERE kind = {k}) AS n_{name}' for k, name in enumerate(KINDS))},
  coalesce(string_agg({written}, ',' ORDER BY start, kind) FILTER (WHERE kind < 3), '') AS base,
  string_agg({written}, ',' ORDER BY start, kind) AS spans FROM spans GROUP BY row)
SELECT doc_id, {', '.join(f'coalesce(n_{name}, 0) AS n_{name}' for name in KINDS)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN digests USING (row)
"""
