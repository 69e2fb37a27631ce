"""Licences in texts by known sentences and ordered rules over them, with DataFrame functions.

A text is cut into sentences, once with every line break as an end and once with lines joined, as notices
stand on a line of their own and licence texts are wrapped.  Sentences are normalised to words and looked up
among the known ones.  A rule is a sequence of known sentences; it matches where they follow each other in a
text with few others between them.  Where matches share a sentence, the rule that comes first in order stands.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labspark.llm.storage import written

#: So many unknown sentences may stand before each next sentence of a rule.
OTHERS = 2

# Sentences of public licences and of usual notices, as normalised words.
SENTENCES = {
    "apache-notice": "licensed under the apache license version 2 0",
    "apache-notice-term": "licensed under the apache license version 2 0 the license",
    "apache-comply": "you may not use this file except in compliance with the license",
    "apache-copy": "you may obtain a copy of the license at http www apache org licenses license 2 0",
    "apache-as-is": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache-see": "see the license for the specific language governing permissions and limitations under the license",
    "mit-notice": "released under the mit license",
    "mit-licensed": "licensed under the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-condition": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit-warranty": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "mit-liability": "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "isc-warranty": "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    "bsd-notice": "licensed under the bsd license",
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-endorse": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "gpl3-notice": "this work is licensed under the gnu general public license version 3",
    "gpl2-notice": "this work is licensed under the gnu general public license version 2",
    "gpl3-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl2-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl-warranty": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "gpl-see": "see the gnu general public license for more details",
    "lgpl3-notice": "licensed under the gnu lesser general public license version 3",
    "mpl-notice": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "mpl-copy": "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0",
    "cc-by": "licensed under cc by 4 0",
    "cc-by-sa": "licensed under cc by sa 4 0",
    "cc-by-nc": "licensed under cc by nc 4 0",
    "cc-by-nd": "licensed under cc by nd 4 0",
    "cc-by-work": "this work is licensed under a creative commons attribution 4 0 international license",
    "cc-by-sa-work": "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    "cc-by-nc-work": "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
    "cc0": "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work",
    "unlicense": "this is free and unencumbered software released into the public domain",
    "all-rights": "all rights reserved",
    "spdx-apache": "spdx license identifier apache 2 0",
    "spdx-mit": "spdx license identifier mit",
    "spdx-bsd3": "spdx license identifier bsd 3 clause",
    "spdx-gpl3": "spdx license identifier gpl 3 0 or later",
    "spdx-mpl": "spdx license identifier mpl 2 0",
}

# Rule, licence and its sentences; rules that come first win.
RULES = [
    ("apache-header", "Apache-2.0", ["apache-notice-term", "apache-comply", "apache-copy", "apache-as-is", "apache-see"]),
    ("mit-text", "MIT", ["mit-grant", "mit-condition", "mit-warranty", "mit-liability"]),
    ("bsd-3-text", "BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("bsd-2-text", "BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("gpl-3-header", "GPL-3.0-or-later", ["gpl3-free", "gpl-warranty", "gpl-see"]),
    ("gpl-2-header", "GPL-2.0-or-later", ["gpl2-free", "gpl-warranty", "gpl-see"]),
    ("isc-text", "ISC", ["isc-grant", "isc-warranty"]),
    ("mpl-header", "MPL-2.0", ["mpl-notice", "mpl-copy"]),
    ("apache-notice-term", "Apache-2.0", ["apache-notice-term"]),
    ("apache-notice", "Apache-2.0", ["apache-notice"]),
    ("mit-grant", "MIT", ["mit-grant"]),
    ("mit-notice", "MIT", ["mit-notice"]),
    ("mit-licensed", "MIT", ["mit-licensed"]),
    ("bsd-notice", "BSD", ["bsd-notice"]),
    ("bsd-grant", "BSD", ["bsd-grant"]),
    ("gpl-3-notice", "GPL-3.0", ["gpl3-notice"]),
    ("gpl-2-notice", "GPL-2.0", ["gpl2-notice"]),
    ("gpl-3-free", "GPL-3.0-or-later", ["gpl3-free"]),
    ("gpl-2-free", "GPL-2.0-or-later", ["gpl2-free"]),
    ("lgpl-3-notice", "LGPL-3.0", ["lgpl3-notice"]),
    ("mpl-notice", "MPL-2.0", ["mpl-notice"]),
    ("cc-by", "CC-BY-4.0", ["cc-by"]),
    ("cc-by-sa", "CC-BY-SA-4.0", ["cc-by-sa"]),
    ("cc-by-nc", "CC-BY-NC-4.0", ["cc-by-nc"]),
    ("cc-by-nd", "CC-BY-ND-4.0", ["cc-by-nd"]),
    ("cc-by-work", "CC-BY-4.0", ["cc-by-work"]),
    ("cc-by-sa-work", "CC-BY-SA-4.0", ["cc-by-sa-work"]),
    ("cc-by-nc-work", "CC-BY-NC-4.0", ["cc-by-nc-work"]),
    ("cc0", "CC0-1.0", ["cc0"]),
    ("unlicense", "Unlicense", ["unlicense"]),
    ("spdx-apache", "Apache-2.0", ["spdx-apache"]),
    ("spdx-mit", "MIT", ["spdx-mit"]),
    ("spdx-bsd-3", "BSD-3-Clause", ["spdx-bsd3"]),
    ("spdx-gpl-3", "GPL-3.0-or-later", ["spdx-gpl3"]),
    ("spdx-mpl", "MPL-2.0", ["spdx-mpl"]),
    ("all-rights", "proprietary", ["all-rights"]),
]

#: Every known sentence has one of these, so texts without any need not be cut.
HINTS = ("license", "licence", "software", "rights", "copyright", "creative commons", "licensed", "licenced", "mpl", "program", "redistribution")

_ENDS = {"lines": r"\n+|[.;!?][ \t\r)\"']*[ \t\r\n]", "wrapped": r"\n[ \t\r]*\n|[.;!?][ \t\r)\"']*[ \t\r\n]"}


def _normalised(sentence: Column) -> Column:
    """Lower-case words of letters and digits with one space between them, British spelling made American."""
    words = F.trim(F.regexp_replace(F.lower(sentence), "[^a-z0-9]+", " "))
    return F.regexp_replace(words, "licence", "license")


def _known(spark: SparkSession, sentences: dict[str, str], rules: list) -> DataFrame:
    """(words, sentence, rule, priority, place, size): a few rows of fixed values."""
    rows = [
        (sentences[s], s, rule, priority, place, len(parts))
        for priority, (rule, _, parts) in enumerate(rules)
        for place, s in enumerate(parts)
    ]
    return spark.createDataFrame(rows, "words string, sentence string, rule string, priority int, place int, size int")


def license_matches(docs: DataFrame, sentences: dict[str, str] | None = None, rules: list | None = None) -> DataFrame:
    """(doc_id, license_id, rule, matches) for each rule that a document matches, and how often.

    ``docs`` (doc_id, text).  A document cut in lines and with lines joined may match a rule differently; the
    greater number counts.  Null and empty texts match nothing.  Rows that repeat a doc_id are one document
    whose texts are scanned one by one, and a row without doc_id keeps a null one.  Other columns are ignored.
    Known sentences come from ``sentences``, their order from ``rules``.
    """
    sentences, rules = sentences or SENTENCES, rules or RULES
    spark = docs.sparkSession
    hinted = [s for s in sentences.values() if not any(h in s for h in HINTS)]
    hints = "|".join(map(re.escape, [*HINTS, *(s.split()[0] for s in hinted)]))
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    plain = plain.where(F.lower("text").rlike(hints)).withColumn("text_key", F.xxhash64("text"))
    known = F.broadcast(_known(spark, sentences, rules))  # fixed values
    names = F.broadcast(_known(spark, sentences, rules).select("words").distinct())
    found = []
    for layout, ends in _ENDS.items():
        cut = plain.select("doc_id", "text_key", F.posexplode(F.split("text", ends)).alias("at", "sentence"))
        found.append(cut.select(F.lit(layout).alias("layout"), "doc_id", "text_key", "at", _normalised(F.col("sentence")).alias("words")).join(names, "words"))
    seen = written(found[0].union(found[1]).distinct(), "sentences")
    # The place of each known sentence among those of its text: sentences of a text are bounded by the text.
    text = ["layout", "doc_id", "text_key"]
    ordered = (
        seen.groupBy(*text)
        .agg(F.array_sort(F.collect_list(F.struct("at", "words"))).alias("all"))
        .select(*text, F.posexplode("all").alias("nth", "x"))
        .select(*text, "nth", F.col("x.at").alias("at"), F.col("x.words").alias("words"))
    )
    runs = (
        ordered.join(known, "words")
        .groupBy(*text, "rule", "priority", "size", (F.col("nth") - F.col("place")).alias("first"))
        .agg(F.count("*").alias("n"), F.min("at").alias("low"), F.max("at").alias("high"))
        .where(f"n = size and high - low <= (size - 1) * {1 + OTHERS}")
    )
    held = runs.select(*text, "rule", "priority", "size", "first", F.explode(F.sequence("first", F.col("first") + F.col("size") - 1)).alias("nth"))
    held = written(held, "matches")
    winner = held.groupBy(*text, "nth").agg(F.min("priority").alias("best"))
    winner = winner.toDF(*(f"best_{c}" for c in winner.columns))
    keys = [F.col(c).eqNullSafe(F.col(f"best_{c}")) for c in (*text, "nth")]
    standing = held.join(winner, keys).where("priority = best_best").groupBy(*text, "rule", "size", "first").agg(F.count("*").alias("n")).where("n = size")
    per_layout = standing.groupBy("layout", "doc_id", "rule").agg(F.count("*").alias("matches"))
    licenses = F.create_map(*[F.lit(x) for rule, name, _ in rules for x in (rule, name)])
    return (
        per_layout.groupBy("doc_id", "rule")
        .agg(F.max("matches").alias("matches"))
        .select("doc_id", licenses[F.col("rule")].alias("license_id"), "rule", "matches")
    )


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(str(x) if isinstance(x, int) else "'" + x + "'" for x in row) + ")" for row in rows)


#: The same for ``documents`` with unique ids.
ORACLE = rf"""
WITH known(words, rule, license_id, priority, place, size) AS (VALUES {_values([(SENTENCES[s], rule, name, p, k, len(parts)) for p, (rule, name, parts) in enumerate(RULES) for k, s in enumerate(parts)])}),
cut AS (
  SELECT 'lines' AS layout, doc_id, regexp_split_to_array(text, '\n+|[.;!?][ \t\r)"'']*[ \t\r\n]') AS parts FROM documents
  UNION ALL
  SELECT 'wrapped', doc_id, regexp_split_to_array(text, '\n[ \t\r]*\n|[.;!?][ \t\r)"'']*[ \t\r\n]') FROM documents
), sentences AS (
  SELECT layout, doc_id, ord, replace(trim(regexp_replace(lower(part), '[^a-z0-9]+', ' ', 'g')), 'licence', 'license') AS words
  FROM (SELECT layout, doc_id, unnest(parts) AS part, generate_subscripts(parts, 1) AS ord FROM cut)
), seen AS (
  SELECT *, row_number() OVER (PARTITION BY layout, doc_id ORDER BY ord) AS nth FROM sentences WHERE words IN (SELECT words FROM known)
), runs AS (
  SELECT layout, doc_id, rule, license_id, priority, size, nth - place AS first FROM seen JOIN known USING (words)
  GROUP BY layout, doc_id, rule, license_id, priority, size, nth - place HAVING count(*) = size AND max(ord) - min(ord) <= (size - 1) * {1 + OTHERS}
), standing AS (
  SELECT * FROM runs r WHERE NOT EXISTS (
    SELECT 1 FROM runs o WHERE o.layout = r.layout AND o.doc_id = r.doc_id AND o.priority < r.priority
    AND o.first < r.first + r.size AND r.first < o.first + o.size)
)
SELECT doc_id, license_id, rule, max(n) AS matches
FROM (SELECT layout, doc_id, license_id, rule, count(*) AS n FROM standing GROUP BY ALL) GROUP BY ALL
"""
