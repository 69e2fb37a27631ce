import duckdb

from labspark.llm.licenses import HINTS, ORACLE, RULES, SENTENCES, license_matches

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

Redistributions of source code must retain the above copyright notice, this
list of conditions and the following disclaimer.

Redistributions in binary form must reproduce the above copyright notice,
this list of conditions and the following disclaimer in the documentation
and/or other materials provided with the distribution.
"""
ENDORSE = """
Neither the name of the copyright holder nor the names of its
contributors may be used to endorse or promote products derived from
this software without specific prior written permission.
"""
ROWS = [
    (1, "Some prose | without end\nReleased under the MIT Licence.\nMore prose."),
    (2, "MIT License\n\nCopyright (c) 2020 A. B.\n\n" + MIT),
    (3, BSD),
    (4, BSD + ENDORSE),
    (5, "Licensed under CC BY-NC 4.0. Licensed under CC BY-NC 4.0.\nlicensed under cc by 4.0"),
    (6, "SPDX-License-Identifier: Apache-2.0\n\nAll rights reserved."),
    (7, "nothing known about software rights here. The license is good."),
    (8, ""),
    (9, "This work is licensed under the GNU General Public License, version 3.\n" * 500 + "tail " * 20_000),
    (10, ("unknown words here. " * 3).join(x.strip() for x in BSD.split("\n\n"))),
]


def test_equals_sql(docs):
    got = sorted(tuple(r) for r in license_matches(docs(ROWS)).collect())
    con = duckdb.connect()
    con.execute("CREATE TABLE documents(doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", ROWS)
    assert got == sorted(con.execute(ORACLE).fetchall())
    named = {(i, rule): n for i, _, rule, n in got}
    assert named[1, "mit-notice"] == 1 and (2, "mit-text") in named and (2, "mit-grant") not in named
    assert (3, "bsd-2-text") in named and (4, "bsd-3-text") in named and (4, "bsd-2-text") not in named
    assert named[5, "cc-by-nc"] == 2 and named[5, "cc-by"] == 1 and named[9, "gpl-3-notice"] == 500
    assert (6, "spdx-apache") in named and (6, "all-rights") in named
    assert (10, "bsd-2-text") not in named and not {i for i, _ in named} & {7, 8}


def test_nulls_repeated_rows_and_empty_table(docs):
    got = license_matches(docs([(None, "Released under the MIT License."), (1, None), (2, ROWS[0][1]), (2, ROWS[0][1])])).collect()
    assert sorted(((r.doc_id, r.license_id, r.rule, r.matches) for r in got), key=str) == [(2, "MIT", "mit-notice", 1), (None, "MIT", "mit-notice", 1)]
    assert license_matches(docs(ROWS).where("false")).count() == 0


def test_fixed_values():
    assert all(any(h in s for h in HINTS) for s in SENTENCES.values())
    assert all(s in SENTENCES for _, _, parts in RULES for s in parts)
    assert len({rule for rule, _, _ in RULES}) == len(RULES)
