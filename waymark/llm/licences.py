"""Licence scan with DataFrame functions only: known sentences, then ordered rules over them.

Texts are cut into sentences, and sentences are normalised: A-Z in lower case, everything but letters a-z and digits a
blank. Known normalised sentences have identifiers; one that layout or stops within it have cut (lines that begin with a
capital or a comment mark, `;`, `:`) is found as the run of pieces that make it up, and has the place of the first. A text becomes the sequence of its sentences' identifiers, unknown ones
counted as gaps, and each rule is a sequence of identifiers with at most `gap` unknown sentences between two of them. Rules
are tried in order; sentences that a rule takes are gone for the rules after it, so a rule stands before those it contains.

Null and empty texts have no sentences and no licence. Only sentences count, however long the text. Each row is scanned by itself,
so rows that repeat an id or a text give one result each. Of runs that begin at one piece the longest counts; pieces within
a run are no sentences of their own. Only doc_id and text are read, so other columns may have any name.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sentences of public licence texts and notices.
SENTENCES = {
    "this work is licensed under the gnu general public license version 3": "gpl-3.0-work",
    "licensed under the gnu general public license version 3": "gpl-3.0-work",
    "this work is licensed under the gnu general public license version 2": "gpl-2.0-work",
    "licensed under the gnu general public license version 2": "gpl-2.0-work",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "gpl-3.0-grant",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "gpl-2.0-grant",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "gpl-warranty",
    "see the gnu general public license for more details": "gpl-details",
    "you should have received a copy of the gnu general public license along with this program": "gpl-copy",
    "released under the mit license": "mit-named",
    "licensed under the mit license": "mit-named",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit-grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit-notice",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "mit-warranty",
    "licensed under the apache license version 2 0": "apache-2.0-named",
    "licensed under the apache license version 2 0 the license": "apache-2.0-named",
    "you may not use this file except in compliance with the license": "apache-2.0-use",
    "you may obtain a copy of the license at": "apache-2.0-copy",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "apache-2.0-warranty",
    "see the license for the specific language governing permissions and limitations under the license": "apache-2.0-language",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-grant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd-binary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-names",
    "all rights reserved": "all-rights-reserved",
    "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software": "mit-liability",
    "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed": "bsd-warranty",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness": "isc-warranty",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl-2.0-named",
    "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0": "mpl-2.0-copy",
    "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0": "mpl-2.0-copy",
    "this is free and unencumbered software released into the public domain": "unlicense-grant",
    "this software is provided as is without any express or implied warranty": "zlib-warranty",
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions": "zlib-grant",
    "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following": "bsl-1.0-grant",
}
#: Identifier of the licence and the names it goes by in notices.
NAMES = {
    "MIT": ("the mit license", "mit"), "Apache-2.0": ("the apache license version 2 0", "the apache license 2 0"),
    "ISC": ("the isc license",), "BSD-2-Clause": ("the bsd 2 clause license",), "BSD-3-Clause": ("the bsd 3 clause license",),
    "MPL-2.0": ("the mozilla public license 2 0", "the mozilla public license version 2 0"), "EPL-2.0": ("the eclipse public license 2 0", "the eclipse public license version 2 0"),
    "Unlicense": ("the unlicense",), "CC0-1.0": ("cc0 1 0", "the cc0 1 0 universal license"), "BSL-1.0": ("the boost software license version 1 0",), "Zlib": ("the zlib license",),
    "LGPL-2.1-only": ("the gnu lesser general public license version 2 1",), "LGPL-3.0-only": ("the gnu lesser general public license version 3",),
    "AGPL-3.0-only": ("the gnu affero general public license version 3",),
    "GPL-2.0-only": ("the gnu general public license version 2",), "GPL-3.0-only": ("the gnu general public license version 3",),
    "LGPL-2.1-or-later": (), "LGPL-3.0-or-later": (), "AGPL-3.0-or-later": (), "GPL-2.0-or-later": (), "GPL-3.0-or-later": (),
}
LEADS = ("licensed under", "released under", "distributed under", "this project is licensed under", "this software is licensed under", "this work is licensed under")
TAILS = ("", "{short}", "see license", "see license for details", "see license file for details", "see the license file", "see the license file for details")
CC_TERMS = ("by", "by-sa", "by-nd", "by-nc", "by-nc-sa", "by-nc-nd")
CC_VERSIONS = ("2.0", "2.5", "3.0", "4.0")

#: (licence, identifiers in order). Longer rules stand before those they contain.
RULES = (
    ("Apache-2.0", ("apache-2.0-named", "apache-2.0-use", "apache-2.0-copy", "apache-2.0-warranty", "apache-2.0-language")),
    ("Apache-2.0", ("apache-2.0-named",)),
    ("GPL-3.0-or-later", ("gpl-3.0-grant", "gpl-warranty", "gpl-details")),
    ("GPL-3.0-or-later", ("gpl-3.0-grant",)),
    ("GPL-2.0-or-later", ("gpl-2.0-grant", "gpl-warranty", "gpl-details")),
    ("GPL-2.0-or-later", ("gpl-2.0-grant",)),
    ("GPL-3.0-only", ("gpl-3.0-work",)),
    ("GPL-2.0-only", ("gpl-2.0-work",)),
    ("MIT", ("mit-grant", "mit-notice", "mit-warranty", "mit-liability")),
    ("MIT", ("mit-grant", "mit-notice", "mit-warranty")),
    ("MIT", ("mit-named",)),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names", "bsd-warranty")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-warranty")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("ISC", ("isc-grant", "isc-warranty")),
    ("ISC", ("isc-grant",)),
    ("MPL-2.0", ("mpl-2.0-named", "mpl-2.0-copy")),
    ("MPL-2.0", ("mpl-2.0-named",)),
    ("Unlicense", ("unlicense-grant",)),
    ("Zlib", ("zlib-warranty", "zlib-grant")),
    ("Zlib", ("zlib-grant",)),
    ("BSL-1.0", ("bsl-1.0-grant",)),
    ("proprietary", ("all-rights-reserved",)),
)


def _plain(name: str) -> str:
    return re.sub("[^a-z0-9]+", " ", name.lower()).strip()


def _notices() -> tuple[dict[str, str], tuple]:
    """Sentences and rules for the names of licences, from leads and tails, and for identifier lines. `SENTENCES` goes first."""
    sentences, rules = {}, []
    for licence, names in NAMES.items():
        mark = f"{licence.lower()}-title"
        sentences[f"spdx license identifier {_plain(licence)}"] = mark
        for name in names:
            for lead in LEADS:
                for tail in TAILS:
                    sentences[" ".join(f"{lead} {name} {tail.format(short=_plain(licence))}".split())] = mark
        rules.append((licence, (mark,)))
    for library, versions in (("lesser", ("2 1", "3")), ("affero", ("3",))):
        for version in versions:
            short = {"lesser": "lgpl", "affero": "agpl"}[library] + f"-{version.replace(' ', '.')}" + ("" if " " in version else ".0")
            for what in ("program", "library", "software"):
                sentences[f"this {what} is free software you can redistribute it and or modify it under the terms of the gnu {library} general public license as published by "
                          f"the free software foundation either version {version} of the license or at your option any later version"] = f"{short}-grant"
            rules.append((f"{short.upper()}-or-later", (f"{short}-grant",)))
    return sentences, tuple(rules)


def _creative_commons() -> tuple[dict[str, str], tuple]:
    """Sentences and rules of the Creative Commons family, from its terms and versions."""
    sentences, rules = {}, []
    for terms in CC_TERMS:
        for version in CC_VERSIONS:
            name = f"cc-{terms}-{version}"
            plain = name.replace("-", " ").replace(".", " ")
            for lead in ("licensed under", "this work is licensed under", "released under"):
                sentences[f"{lead} {plain}"] = name
            rules.append((name.upper(), (name,)))
    return sentences, tuple(rules)


@dataclass(frozen=True)
class LicenceRules:
    sentences: tuple[tuple[str, str], ...] = tuple({**_notices()[0], **SENTENCES, **_creative_commons()[0]}.items())
    rules: tuple[tuple[str, tuple[str, ...]], ...] = RULES + _notices()[1] + _creative_commons()[1]
    gap: int = 2

    @property
    def pieces(self) -> int:
        """Most pieces into which a known sentence can be cut: one for each word."""
        return max(s.count(" ") + 1 for s, _ in self.sentences)


#: A sentence ends at stops before white space, at an empty line, and before a line that starts with a capital letter.
ENDS = r"[.!?;:]+([ \t\r\n]+|$)|\n[ \t\r]*\n"
LINE = r"\n([ \t\r]*[A-Z(*#/0-9])"
BREAK = "\u0001"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def sentences_of(text: Column) -> Column:
    """The normalised sentences of a text, in order."""
    marked = F.regexp_replace(F.regexp_replace(text, ENDS, BREAK), LINE, f"{BREAK}$1")
    plain = F.regexp_replace(F.translate(marked, UPPER, LOWER), f"[^a-z0-9{BREAK}]+", " ")
    return F.filter(F.transform(F.split(plain, BREAK, -1), lambda s: F.trim(s)), lambda s: s != "")


def _known(parts: Column, rules: LicenceRules) -> Column:
    """For each piece the identifier of the known sentence that begins with it, and of how many pieces that is."""
    names = F.create_map(*[F.lit(x) for pair in rules.sentences for x in pair])
    lengths = F.array(*[F.lit(n) for n in sorted({len(s) for s, _ in rules.sentences})])
    starts = F.array(*[F.lit(x) for x in sorted({" ".join(s.split(" ")[:2]) for s, _ in rules.sentences})])
    longest = max(len(s) for s, _ in rules.sentences)
    named = lambda s: F.when(F.array_contains(lengths, F.length(s)), F.try_element_at(names, s))
    found = lambda i, n: F.struct(i.alias("id"), n.cast("int").alias("n"))
    none = found(F.lit(None).cast("string"), F.lit(1))

    def joined(at: Column) -> Column:
        """The longest run of pieces from `at` that is a known sentence."""
        runs = F.transform(F.sequence(F.lit(2), F.lit(rules.pieces)), lambda n: found(named(F.array_join(F.slice(parts, at + 1, n), " ")), n))
        hits = F.filter(runs, lambda r: r["id"].isNotNull() & (at + r["n"] <= F.size(parts)))
        return F.try_element_at(hits, F.lit(-1))

    def known(piece: Column, at: Column) -> Column:
        two = F.when(piece.contains(" "), piece).otherwise(F.array_join(F.slice(parts, at + 1, 2), " "))
        may = (F.length(piece) <= longest) & F.array_contains(starts, F.substring_index(two, " ", 2))
        one = named(piece)
        return F.when(may, F.coalesce(joined(at), F.when(one.isNotNull(), found(one, F.lit(1))), none)).otherwise(none)

    return F.transform(parts, known)


def rule_pattern(identifiers: tuple[str, ...], gap: int) -> str:
    return f"(<->){{0,{gap}}}".join(f"<{i.replace('.', '[.]')}>" for i in identifiers)


def scan(docs: DataFrame, rules: LicenceRules = LicenceRules()) -> DataFrame:
    """(doc_id, sentences, licences) of every row: place:identifier of each known sentence, and licence:number of each rule that matches."""
    out = docs.select("doc_id", sentences_of(F.coalesce("text", F.lit(""))).alias("_parts"))
    out = out.select("doc_id", _known(F.col("_parts"), rules).alias("_known"))
    runs = F.filter(F.transform("_known", lambda x, at: F.struct(at.alias("at"), x["n"].alias("n"))), lambda r: r["n"] > 1)
    out = out.withColumn("_runs", runs)
    # Pieces within a longer sentence are no sentences of their own.
    within = lambda at: F.exists("_runs", lambda r: (r["at"] < at) & (at < r["at"] + r["n"]))
    out = out.withColumn("_known", F.transform("_known", lambda x, at: F.struct(
        F.when(~within(at), x["id"]).alias("id"), F.when(within(at), "").otherwise(F.coalesce(F.concat(F.lit("<"), x["id"], F.lit(">")), F.lit("<->"))).alias("mark"))))
    any_known = F.exists("_known", lambda x: x["id"].isNotNull())
    out = out.withColumn("_sequence", F.when(any_known, F.array_join(F.col("_known")["mark"], "")).otherwise(""))
    for k, (_, identifiers) in enumerate(rules.rules):
        pattern = rule_pattern(identifiers, rules.gap)
        found = F.col("_sequence").contains(f"<{identifiers[0]}>")
        out = out.withColumn(f"_n{k}", F.when(found, F.regexp_count("_sequence", F.lit(pattern))).otherwise(0)).withColumn(
            "_sequence", F.when(found, F.regexp_replace("_sequence", pattern, "<!>")).otherwise(F.col("_sequence")))
    by_name: dict[str, list[int]] = {}
    for k, (name, _) in enumerate(rules.rules):
        by_name.setdefault(name, []).append(k)
    totals = {name: sum((F.col(f"_n{k}") for k in ks[1:]), F.col(f"_n{ks[0]}")) for name, ks in by_name.items()}
    licences = F.concat_ws(",", *[F.when(n > 0, F.concat_ws(":", F.lit(name), n.cast("string"))) for name, n in totals.items()])
    places = F.transform("_known", lambda x, at: F.when(x["id"].isNotNull(), F.concat_ws(":", at.cast("string"), x["id"])))
    return out.select("doc_id", F.array_join(places, ",").alias("sentences"), licences.alias("licences"))


def scan_sql(rules: LicenceRules = LicenceRules()) -> str:
    """The same scan of table `documents` as SQL text."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    names = ", ".join(f"({quoted(s)}, {quoted(i)})" for s, i in rules.sentences)
    plain = (f"regexp_replace(translate(regexp_replace(regexp_replace(coalesce(text, ''), {quoted(ENDS)}, chr(1), 'g'), {quoted(LINE)}, chr(1) || '\\1', 'g'), "
             f"'{UPPER}', '{LOWER}'), '[^a-z0-9\\x01]+', ' ', 'g')")
    steps, last = [], "sequences"
    for k, (_, identifiers) in enumerate(rules.rules):
        pattern = quoted(rule_pattern(identifiers, rules.gap))
        steps.append(f"r{k} AS (SELECT * EXCLUDE (sequence), len(regexp_extract_all(sequence, {pattern})) AS n{k}, regexp_replace(sequence, {pattern}, '<!>', 'g') AS sequence FROM {last})")
        last = f"r{k}"
    by_name: dict[str, list[str]] = {}
    for k, (name, _) in enumerate(rules.rules):
        by_name.setdefault(name, []).append(f"n{k}")
    totals = ", ".join(f"CASE WHEN {' + '.join(ns)} > 0 THEN {quoted(name)} || ':' || ({' + '.join(ns)}) END" for name, ns in by_name.items())
    starts = ", ".join(f"({quoted(x)})" for x in sorted({" ".join(s.split(" ")[:2]) for s, _ in rules.sentences}))
    return f"""
WITH known(sentence, id) AS (VALUES {names}), starts(two) AS (VALUES {starts}),
cut AS (SELECT doc_id, row_number() OVER () AS row, list_filter(list_transform(string_split({plain}, chr(1)), lambda s: trim(s)), lambda s: s <> '') AS parts FROM documents),
pieces AS (SELECT row, unnest(parts) AS piece, unnest(list_append(parts[2:], '')) AS following, generate_subscripts(parts, 1) AS place FROM cut),
begun AS (SELECT c.row, c.parts, p.place FROM pieces p JOIN starts ON array_to_string(string_split(piece || ' ' || following, ' ')[1:2], ' ') = two JOIN cut c USING (row)),
runs AS (SELECT row, place, n, array_to_string(parts[place:place + n - 1], ' ') AS sentence
  FROM begun, range(1, {rules.pieces + 1}) AS lengths(n) WHERE place + n - 1 <= len(parts)),
longest AS (SELECT row, place, max(n) AS n, arg_max(id, n) AS id FROM runs JOIN known USING (sentence) GROUP BY row, place),
named AS (SELECT p.row, p.place - 1 AS place, l.id FROM pieces p LEFT JOIN longest l USING (row, place)
  WHERE NOT EXISTS (SELECT 1 FROM longest o WHERE o.row = p.row AND o.place < p.place AND p.place < o.place + o.n)),
sequences AS (SELECT row, string_agg(coalesce('<' || id || '>', '<->'), '' ORDER BY place) AS sequence,
  coalesce(string_agg(CASE WHEN id IS NOT NULL THEN place || ':' || id END, ',' ORDER BY place), '') AS sentences FROM named GROUP BY row),
{', '.join(steps)}
SELECT doc_id, coalesce(sentences, '') AS sentences, coalesce(concat_ws(',', {totals}), '') AS licences FROM cut LEFT JOIN {last} USING (row)
"""
