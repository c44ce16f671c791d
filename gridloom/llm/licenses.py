"""License scans by sentence rules, in DataFrame functions.

1. A text is cut into sentences; each is normalised to its ASCII letters and digits in lower case, words apart by one space;
2. a normalised sentence that is a known license sentence gets its identifier, with or without a list number at its end. So does one
   that fills a known sentence's blank with a name. One that isn't known is tried line by line, so that a license line below
   a heading is found, and a sentence that was wrapped over lines as well;
3. the document's identifiers, in order, are matched against the rules: at each place the longest rule whose identifiers
   follow each other there, then on behind it. A sentence of four words or more that isn't known stands between its neighbours, so
   that a license with one more clause isn't told as the license without it.

Everything is an expression over one row: no exchange, whatever the texts share.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentences of public license texts and notices, normalised, and the identifier of each.
SENTENCES = {
    "released under the mit license": "mit-short",
    "licensed under the mit license": "mit-short",
    "this project is licensed under the mit license": "mit-short",
    "licensed under the apache license version 2 0": "apache-2-short",
    "this work is licensed under the gnu general public license version 2": "gpl-2-short",
    "this work is licensed under the gnu general public license version 3": "gpl-3-short",
    "licensed under cc by 4 0": "cc-by-4-short",
    "licensed under cc by sa 4 0": "cc-by-sa-4-short",
    "licensed under cc by nc 4 0": "cc-by-nc-4-short",
    "spdx license identifier mit": "mit-short",
    "spdx license identifier apache 2 0": "apache-2-short",
    "spdx license identifier gpl 3 0 only": "gpl-3-short",
    "spdx license identifier gpl 3 0 or later": "gpl-3-later-short",
    "spdx license identifier bsd 2 clause": "bsd-2-short",
    "spdx license identifier bsd 3 clause": "bsd-3-short",
    "spdx license identifier isc": "isc-short",
    "spdx license identifier mpl 2 0": "mpl-2-short",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit-grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit-notice",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "mit-warranty",
    "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software": "mit-liability",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-grant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd-binary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-names",
    "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed": "bsd-warranty",
    "in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage": "bsd-liability",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness": "isc-warranty",
    "in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software": "isc-liability",
    "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license": "apache-2-header",
    "you may obtain a copy of the license at": "apache-2-copy",
    "http www apache org licenses license 2 0": "apache-2-url",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "apache-2-basis",
    "see the license for the specific language governing permissions and limitations under the license": "apache-2-see",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "gpl-2-later-grant",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "gpl-3-later-grant",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "gpl-warranty",
    "see the gnu general public license for more details": "gpl-see",
    "you should have received a copy of the gnu general public license along with this program": "gpl-copy",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl-2-terms",
    "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0": "mpl-2-obtain",
    "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0": "mpl-2-obtain",
}

# Further sentences of notices.
SENTENCES |= {
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version": "lgpl-2-1-later-grant",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version": "lgpl-3-later-grant",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version": "lgpl-3-later-grant",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version": "agpl-3-later-grant",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation version 3": "agpl-3-grant",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation": "gpl-2-grant",
    "this is free and unencumbered software released into the public domain": "unlicense-domain",
    "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means": "unlicense-free",
    "this software is provided as is without any express or implied warranty": "zlib-warranty",
    "in no event will the authors be held liable for any damages arising from the use of this software": "zlib-liability",
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions": "zlib-grant",
    "distributed under the boost software license version 1 0": "boost-short",
    "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0": "epl-2-terms",
    "this program and the accompanying materials are made available under the terms of the eclipse public license v2 0": "epl-2-terms",
    "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work": "cc0-waiver",
    "to the extent possible under law the authors have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide": "cc0-waiver",
    "all advertising materials mentioning features or use of this software must display the following acknowledgement": "bsd-advertising",
    "all rights reserved": "rights-reserved",
}

# How sentences with a blank begin and end, and the identifier of each.
BLANKS = [
    ("neither the name of", "may be used to endorse or promote products derived from this software without specific prior written permission", "bsd-names"),
    ("this software is provided by", "as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed", "bsd-warranty"),
    ("in no event shall", "in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage", "bsd-liability"),
    ("in no event shall", "in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software", "mit-liability"),
    ("to the extent possible under law", "has waived all copyright and related or neighboring rights to", "cc0-waiver"),
]

# Names whose SPDX line is a sentence of its own ("SPDX-License-Identifier: " and the name).
SPDX = [
    "0BSD", "AGPL-3.0-only", "AGPL-3.0-or-later", "BSL-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC0-1.0", "EPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "Unlicense", "Zlib"
]
_PLAIN = {name: re.sub("[^a-z0-9]+", " ", name.lower()) for name in SPDX}
SENTENCES |= {f"spdx license identifier {plain}": f"spdx-{plain.replace(' ', '-')}" for plain in _PLAIN.values()}

# The ordered rules, a license and the identifiers that tell of it.
RULES = [
    ("MIT", ["mit-grant", "mit-notice", "mit-warranty", "mit-liability"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-names", "bsd-warranty", "bsd-liability"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-warranty", "bsd-liability"]),
    ("ISC", ["isc-grant", "isc-warranty", "isc-liability"]),
    ("Apache-2.0", ["apache-2-header", "apache-2-copy", "apache-2-url", "apache-2-basis", "apache-2-see"]),
    ("Apache-2.0", ["apache-2-header", "apache-2-copy", "apache-2-url"]),
    ("GPL-3.0-or-later", ["gpl-3-later-grant", "gpl-warranty", "gpl-see", "gpl-copy"]),
    ("GPL-3.0-or-later", ["gpl-3-later-grant"]),
    ("GPL-2.0-or-later", ["gpl-2-later-grant", "gpl-warranty", "gpl-see", "gpl-copy"]),
    ("GPL-2.0-or-later", ["gpl-2-later-grant"]),
    ("MPL-2.0", ["mpl-2-terms", "mpl-2-obtain"]),
    ("MIT", ["mit-short"]),
    ("Apache-2.0", ["apache-2-short"]),
    ("GPL-2.0-only", ["gpl-2-short"]),
    ("GPL-3.0-only", ["gpl-3-short"]),
    ("GPL-3.0-or-later", ["gpl-3-later-short"]),
    ("BSD-2-Clause", ["bsd-2-short"]),
    ("BSD-3-Clause", ["bsd-3-short"]),
    ("ISC", ["isc-short"]),
    ("MPL-2.0", ["mpl-2-short"]),
    ("CC-BY-4.0", ["cc-by-4-short"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-4-short"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-4-short"]),
    ("BSD-4-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-advertising", "bsd-names", "bsd-warranty", "bsd-liability"]),
    ("LGPL-2.1-or-later", ["lgpl-2-1-later-grant"]),
    ("LGPL-3.0-or-later", ["lgpl-3-later-grant"]),
    ("AGPL-3.0-or-later", ["agpl-3-later-grant"]),
    ("AGPL-3.0-only", ["agpl-3-grant"]),
    ("GPL-2.0-only", ["gpl-2-grant"]),
    ("Unlicense", ["unlicense-domain", "unlicense-free"]),
    ("Zlib", ["zlib-warranty", "zlib-liability", "zlib-grant"]),
    ("BSL-1.0", ["boost-short"]),
    ("EPL-2.0", ["epl-2-terms"]),
    ("CC0-1.0", ["cc0-waiver"]),
    ("All-rights-reserved", ["rights-reserved"]),
    *((name, [f"spdx-{plain.replace(' ', '-')}"]) for name, plain in _PLAIN.items()),
]
#: What an unknown sentence of so many words stands for between identifiers.
OTHER, OTHER_WORDS = "?", 4


def hint(sentences: dict[str, str]) -> str:
    """A pattern of words of which every one of the sentences has one; a text without them has none of the sentences."""
    left, words = [set(s.split()) for s in sentences], []
    while left:
        counts: dict[str, int] = {}
        for word in sorted(w for s in left for w in s):
            counts[word] = counts.get(word, 0) + len(word)  # longer words stand in fewer other texts
        if not counts:
            return ""  # a sentence without words has no hint, so every text is looked at
        words.append(max(counts, key=counts.get))
        left = [s for s in left if not any(words[-1] in w for w in s)]  # licensed holds license
    return "(?i)" + ("|".join(words) or "(?!)")


#: Every known sentence holds one of these; a text without them has none.
HINT = hint({**SENTENCES, **{start: i for start, _, i in BLANKS}})
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_END, _CUT = r"([.!?])[ \t\r\n]+", "\u0001|\n[ \t\r]*\n"


def normalised(sentence: Column) -> Column:
    """ASCII letters and digits in lower case, all between them one space, without a list number in front."""
    plain = F.trim(F.regexp_replace(F.translate(sentence, UPPER, LOWER), "[^a-z0-9]+", " "))
    return F.regexp_replace(plain, "^[0-9]+ ", "")


def sequence(text: str, sentences: dict[str, str] = SENTENCES, blanks: list[tuple[str, str, str]] = BLANKS) -> Column:
    """The array of identifiers of a text's known sentences, in order, with OTHER for unknown ones; empty without a known one's hint."""
    known = F.create_map(*[F.lit(x) for pair in sentences.items() for x in pair])

    def look(plain: Column) -> Column:
        filled = [F.when(plain.startswith(start) & plain.endswith(end), F.lit(i)) for start, end, i in blanks]
        return F.coalesce(F.try_element_at(known, plain), F.try_element_at(known, F.regexp_replace(plain, " [0-9]+$", "")), *filled)

    # each sentence is normalised in a step of its own, so that what reads it doesn't do so again
    parts = F.split(F.regexp_replace(F.col(text), _END, "$1\u0001"), _CUT)
    plain = F.transform(parts, lambda s: F.struct(normalised(s).alias("n"), s.alias("s")))
    lines = lambda s: F.filter(F.transform(F.transform(F.split(s, "\n"), normalised), look), lambda i: i.isNotNull())
    other = lambda n: F.when(F.size(F.split(n, " ")) >= OTHER_WORDS, F.array(F.lit(OTHER))).otherwise(F.array().cast("array<string>"))
    told = F.transform(plain, lambda t: F.struct(look(t["n"]).alias("id"), t["n"].alias("n"), t["s"].alias("s")))
    tried = F.transform(told, lambda t: F.struct(t["n"].alias("n"), F.when(t["id"].isNotNull(), F.array(t["id"])).otherwise(lines(t["s"])).alias("ids")))
    flat = F.flatten(F.transform(tried, lambda t: F.when(F.size(t["ids"]) > 0, t["ids"]).otherwise(other(t["n"]))))
    return F.when(F.col(text).rlike(hint({**sentences, **{start: i for start, _, i in blanks}})), flat).otherwise(F.array().cast("array<string>"))


def _by_length(rules: list[tuple[str, list[str]]]) -> dict[str, str]:
    """Rules as text, longer ones first and otherwise as they are ordered; the first of equal sequences counts."""
    found: dict[str, str] = {}
    for name, ids in sorted(rules, key=lambda r: -len(r[1])):
        found.setdefault("".join(f"{i} " for i in ids), name)
    return found


def matched(ids: Column, rules: list[tuple[str, list[str]]] = RULES) -> Column:
    """The array of licenses that the rules find in an array of identifiers, in order of place."""
    by_text = _by_length(rules)
    line = F.array_join(F.transform(ids, lambda i: F.concat(i, F.lit(" "))), "")
    hits = F.regexp_extract_all(line, F.lit("(?:^|(?<= ))(?:" + "|".join(by_text) + ")"), F.lit(0))
    names = F.create_map(*[F.lit(x) for pair in by_text.items() for x in pair])
    return F.transform(hits, lambda h: F.element_at(names, h))


def scan_licenses(docs: DataFrame, sentences: dict[str, str] = SENTENCES, rules: list[tuple[str, list[str]]] = RULES, blanks: list[tuple[str, str, str]] = BLANKS) -> DataFrame:
    """doc_id, n_sentences, sentence_ids, licenses for every row of docs.

    n_sentences counts the known sentences; sentence_ids lists their identifiers, and licenses those that the rules find,
    comma-joined in order of place. A license found twice is listed twice. A null or empty text has none: 0 and two empty
    lists. Repeated rows and null doc_ids each have their row; other columns aren't read. An empty table gives an empty
    table.
    """
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    # a column of its own, so that rules and outputs read the identifiers and not the text again
    found = rows.withColumn("all", sequence("text", sentences, blanks)).select("doc_id", "all").withColumn("ids", F.filter("all", lambda i: i != OTHER))
    return found.select("doc_id", F.size("ids").cast("long").alias("n_sentences"), F.array_join("ids", ",").alias("sentence_ids"), F.array_join(matched(F.col("all"), rules), ",").alias("licenses"))


def op7_sentence_rules(spark, sf_dir: str) -> DataFrame:
    """Licenses told in every document."""
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _sql() -> str:
    known = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in SENTENCES.items()) + "}"
    names = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in _by_length(RULES).items()) + "}"
    norm = f"regexp_replace(trim(regexp_replace(translate(s, '{UPPER}', '{LOWER}'), '[^a-z0-9]+', ' ', 'g')), '^[0-9]+ ', '')"
    filled = "".join(f" WHEN starts_with(n, '{start}') AND ends_with(n, '{end}') THEN '{i}'" for start, end, i in BLANKS)
    look = f"coalesce(({known})[n], ({known})[regexp_replace(n, ' [0-9]+$', '')], CASE{filled} END)"
    # identifiers never end with another's whole name after a space, so no look-behind is needed
    return f"""
WITH parts AS (
  SELECT rn, doc_id, unnest(p) AS s, unnest(range(len(p))) AS i
  FROM (SELECT row_number() OVER () AS rn, doc_id,
               string_split_regex(regexp_replace(coalesce(text, ''), '([.!?])[ \\t\\r\\n]+', '\\1' || chr(1), 'g'), chr(1) || '|\\n[ \\t\\r]*\\n') AS p
        FROM documents)),
norm AS (SELECT rn, i, s, {norm} AS n FROM parts),
told AS (SELECT rn, i, s, n, {look} AS id FROM norm),
lines AS (SELECT rn, i, unnest(l) AS s, unnest(range(len(l))) AS j FROM (SELECT rn, i, string_split(s, chr(10)) AS l FROM told WHERE id IS NULL)),
found AS (SELECT * FROM (SELECT rn, i, j, {look} AS id FROM (SELECT rn, i, j, {norm} AS n FROM lines)) WHERE id IS NOT NULL),
ids AS (SELECT rn, i, 0 AS j, id FROM told WHERE id IS NOT NULL UNION ALL SELECT * FROM found
        UNION ALL SELECT rn, i, 0, '{OTHER}' FROM told WHERE id IS NULL AND len(string_split(n, ' ')) >= {OTHER_WORDS} AND (rn, i) NOT IN (SELECT (rn, i) FROM found)),
seq AS (SELECT rn, list(id ORDER BY i, j) AS tokens FROM ids GROUP BY rn),
tagged AS (SELECT rn, tokens, list_filter(tokens, lambda x: x <> '{OTHER}') AS ids FROM seq),
docs AS (SELECT row_number() OVER () AS rn, doc_id FROM documents)
SELECT doc_id, CAST(coalesce(len(ids), 0) AS BIGINT) AS n_sentences, coalesce(array_to_string(ids, ','), '') AS sentence_ids,
       coalesce(array_to_string(list_transform(regexp_extract_all(array_to_string(tokens, ' ') || ' ', '{"|".join(_by_length(RULES))}'), lambda h: ({names})[h]), ','), '') AS licenses
FROM docs LEFT JOIN tagged USING (rn)
"""


OP7_SQL = _sql()
