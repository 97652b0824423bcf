import duckdb

from waymark.llm import licences

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

"""
WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
implied, including but not limited to the warranties of merchantability,
fitness for a particular purpose and noninfringement."""
TEXTS = {
    0: None, 1: "", 2: "No licence. At all!", 3: "Text.\nReleased under the MIT License.", 4: MIT + WARRANTY.lower(), 5: MIT + "One. Two. Three. " + WARRANTY.lower(),
    6: "Licensed under CC BY-NC 4.0.\nLicensed under CC BY-NC 4.0. All rights reserved.", 7: "Licensed under the Apache License, Version 2.0. You may not use this file except in compliance with the License.",
    8: "all rights reserved " * 2000, 9: "Sätze. ALL RIGHTS RESERVED! Ünd mehr\n\nThis work is licensed under the GNU General Public License, version 3.", 10: "x. " * 5000 + "All rights reserved.",
}


def test_rules(spark, nothing, odd):
    docs = spark.createDataFrame(list(TEXTS.items()), "doc_id long, text string")
    got = {r["doc_id"]: (r["sentences"], r["licences"]) for r in licences.scan(docs).collect()}
    assert got[0] == got[1] == got[2] == got[8] == ("", "")
    assert got[3] == ("1:mit-named", "MIT:1") and got[10] == ("5000:all-rights-reserved", "proprietary:1")
    assert got[4] == ("0:mit-grant,1:mit-notice,2:mit-warranty", "MIT:1")
    assert got[5][1] == "" and got[6][1] == "proprietary:1,CC-BY-NC-4.0:2" and got[7][1] == "Apache-2.0:1" and got[9][1] == "GPL-3.0-only:1,proprietary:1"
    assert licences.scan(nothing).count() == 0 and licences.scan(odd).count() == odd.count()


def test_sql_agrees(spark):
    docs = spark.createDataFrame(list(TEXTS.items()), "doc_id long, text string")
    documents = docs.toPandas()  # noqa: F841
    con = duckdb.connect()
    con.register("documents", documents)
    want = sorted(tuple(r) for r in con.sql(licences.scan_sql()).df()[["doc_id", "sentences", "licences"]].itertuples(index=False))
    assert sorted(tuple(r) for r in licences.scan(docs).collect()) == want


CANONICAL = {
    "MIT": "MIT License\n\nCopyright (c) 2020 A Name\n\n" + MIT + '''THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM.
''',
    "Apache-2.0": '''Copyright 2020 A Name

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
''',
    "BSD-3-Clause": '''Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
''',
    "GPL-3.0-or-later": '''This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.

You should have received a copy of the GNU General Public License
along with this program.  If not, see <https://www.gnu.org/licenses/>.
''',
}
CANONICAL["GPL-2.0-or-later"] = CANONICAL["GPL-3.0-or-later"].replace("version 3", "version 2").replace("software:", "software;")


def test_canonical_texts_and_comment_headers(spark):
    marks = {"plain": ("", "", ""), "hash": ("", "# ", ""), "slashes": ("", "// ", ""), "stars": ("/*\n", " * ", " */\n")}
    rows = [(f"{name} {mark}", head + "".join(f"{lead}{line}".rstrip() + "\n" for line in text.splitlines()) + tail)
            for name, text in CANONICAL.items() for mark, (head, lead, tail) in marks.items()]
    got = {r["doc_id"]: (r["sentences"], r["licences"]) for r in licences.scan(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    wrong = {k: v for k, v in got.items() if v[1] != k.split(" ")[0] + ":1"}
    assert not wrong
    whole = {"MIT": ("mit-grant", "mit-notice", "mit-warranty"), "Apache-2.0": ("named", "use", "copy", "warranty", "language"), "GPL-3.0-or-later": ("grant", "warranty", "details")}
    assert all(part in got[f"{name} {mark}"][0] for name, parts in whole.items() for part in parts for mark in marks)


NOTICES = {
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "MIT": "Released under the MIT License (MIT).", "Apache-2.0": "SPDX-License-Identifier: Apache-2.0", "LGPL-3.0-or-later": "SPDX-License-Identifier: LGPL-3.0-or-later\n",
    "LGPL-2.1-or-later": CANONICAL["GPL-3.0-or-later"].split("\n\n")[0].replace("GNU General", "GNU Lesser General").replace("version 3", "version 2.1").replace("program", "library"),
    "AGPL-3.0-or-later": CANONICAL["GPL-3.0-or-later"].split("\n\n")[0].replace("GNU General", "GNU Affero General"),
    "EPL-2.0": "This project is licensed under the Eclipse Public License 2.0.", "Unlicense": "This is free and unencumbered software released into the public domain.",
    "CC0-1.0": "Released under CC0 1.0.", "Zlib": "Permission is granted to anyone to use this software for any purpose,\nincluding commercial applications, and to alter it and redistribute it\nfreely, subject to the following restrictions:\n",
    "MPL-2.0 named": "Licensed under the Mozilla Public License 2.0", "MIT see": "Licensed under the MIT license, see LICENSE.",
    "MIT words": "\n".join("# " + w for w in MIT.split("\n\n")[0].split()) + "\n\n" + MIT.split("\n\n")[1] + "\n\n" + WARRANTY,
}


def test_notices_and_sentences_cut_into_words(spark):
    docs = spark.createDataFrame(list(NOTICES.items()), "doc_id string, text string")
    got = {r["doc_id"]: r["licences"] for r in licences.scan(docs).collect()}
    assert got == {k: k.split(" ")[0] + ":1" for k in NOTICES}


def test_sql_finds_cut_sentences(spark):
    rows = [(i, t) for i, t in enumerate([*CANONICAL.values(), *NOTICES.values(), *TEXTS.values(), *("# " + t.replace("\n", "\n# ") for t in CANONICAL.values())])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    assert sorted(map(tuple, licences.scan(docs).collect())) == sorted(con.execute(licences.scan_sql()).fetchall())
