"""Licence scans by sentence rules: sentences become identifiers, identifier sequences are matched against ordered rules.

A text is cut into pieces at sentence ends and line breaks. Pieces are normalised (lower case; other characters than letters and
digits to one space), which drops comment leaders too, and put together as long as they are the beginning of a sentence of the
catalogue: so notices are known however they are wrapped, and though the cutter splits 'v. 2.0' or 'Foundation; either'. Of
sentences that lie in each other the longest counts. None begins at a line that goes on in lower case, or after a comma. The known
ones, in order and with their places in words, form a sequence, which is broken where over ``GAP_WORDS`` unknown words lie between two;
the rules are tried longest first, and a match uses its sentences up. An SPDX tag is two identifiers for each licence of its
expression, listed or not.

The catalogue is data: ``scanned`` takes any sentences and rules. All is built-in expressions on one row: nothing is shuffled. Texts
with none of the words of ``hint`` hold no known sentence, as each has one of them, and skip the costly part.

Defined results: null and empty texts have no licence; very long texts are scanned whole. Rows without doc_id and repeated rows are
scanned like others. Rules of one length are tried as listed. Other columns, whatever their names, are ignored. An empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import table

#: Known sentences of public licence notices, normalised: fixed values.
SENTENCES = {
    "MIT-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "MIT-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "MIT-warranty": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "MIT-liability": "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "MIT-name": "released under the mit license",
    "MIT-under": "licensed under the mit license",
    "BSD-grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "BSD-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "BSD-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "BSD-endorse": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "BSD-name": "released under the bsd license",
    "Apache-header": "licensed under the apache license version 2 0 the license",
    "Apache-file": "you may not use this file except in compliance with the license",
    "Apache-law": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "Apache-see": "see the license for the specific language governing permissions and limitations under the license",
    "Apache-under": "licensed under the apache license version 2 0",
    "Apache-released": "released under the apache license version 2 0",
    "GPL-free": "this program is free software",
    "GPL-2-later": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "GPL-3-later": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "GPL-3-work": "this work is licensed under the gnu general public license version 3",
    "GPL-2-work": "this work is licensed under the gnu general public license version 2",
    "GPL-3-under": "licensed under the gnu general public license version 3",
    "CC-BY-4": "licensed under cc by 4 0",
    "CC-BY-SA-4": "licensed under cc by sa 4 0",
    "CC-BY-NC-4": "licensed under cc by nc 4 0",
    "CC-BY-work": "this work is licensed under a creative commons attribution 4 0 international license",
    "CC-BY-SA-work": "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    "CC-BY-NC-work": "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
    "MPL-file": "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0",
    "MPL-header": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "GPL-2-only": "you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation",
    "LGPL-free": "this library is free software",
    "LGPL-2.1-later": "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    "LGPL-3-later": "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "AGPL-3-later": "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "ISC-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "ISC-warranty": "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    "ISC-liability": "in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
    "zlib-warranty": "this software is provided as is without any express or implied warranty",
    "zlib-liability": "in no event will the authors be held liable for any damages arising from the use of this software",
    "zlib-grant": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "Boost-header": "distributed under the boost software license version 1 0",
    "Boost-grant": "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following",
    "Unlicense-free": "this is free and unencumbered software released into the public domain",
    "Unlicense-anyone": "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    "CC0-extent": "to the extent possible under law the author s have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide",
    "CC0-under": "licensed under cc0 1 0",
    "EPL-2": "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at http www eclipse org legal epl 2 0",
    "EPL-1": "this program and the accompanying materials are made available under the terms of the eclipse public license v1 0 which accompanies this distribution and is available at http www eclipse org legal epl v10 html",
}
#: Identifiers known in any case.
IDENTIFIERS = ("MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "GPL-3.0-only")
#: Ordered rules: the licence and the sentences that state it, one after another.
RULES = [
    ("MIT", ["MIT-grant", "MIT-notice", "MIT-warranty", "MIT-liability"]),
    ("BSD-3-Clause", ["BSD-grant", "BSD-source", "BSD-binary", "BSD-endorse"]),
    ("Apache-2.0", ["Apache-header", "Apache-file", "Apache-law", "Apache-see"]),
    ("BSD-2-Clause", ["BSD-grant", "BSD-source", "BSD-binary"]),
    ("MIT", ["MIT-grant", "MIT-notice"]),
    ("Apache-2.0", ["Apache-header", "Apache-file"]),
    ("GPL-2.0-or-later", ["GPL-free", "GPL-2-later"]),
    ("GPL-3.0-or-later", ["GPL-free", "GPL-3-later"]),
    ("MPL-2.0", ["MPL-header", "MPL-file"]),
    ("GPL-2.0-only", ["GPL-free", "GPL-2-only"]),
    ("LGPL-2.1-or-later", ["LGPL-free", "LGPL-2.1-later"]),
    ("LGPL-3.0-or-later", ["LGPL-free", "LGPL-3-later"]),
    ("LGPL-3.0-or-later", ["GPL-free", "LGPL-3-later"]),
    ("AGPL-3.0-or-later", ["GPL-free", "AGPL-3-later"]),
    ("ISC", ["ISC-grant", "ISC-warranty", "ISC-liability"]),
    ("Zlib", ["zlib-warranty", "zlib-liability", "zlib-grant"]),
    ("Unlicense", ["Unlicense-free", "Unlicense-anyone"]),
    ("ISC", ["ISC-grant"]),
    ("Zlib", ["zlib-grant"]),
    ("BSL-1.0", ["Boost-header"]),
    ("BSL-1.0", ["Boost-grant"]),
    ("Unlicense", ["Unlicense-free"]),
    ("CC0-1.0", ["CC0-extent"]),
    ("CC0-1.0", ["CC0-under"]),
    ("EPL-2.0", ["EPL-2"]),
    ("EPL-1.0", ["EPL-1"]),
    ("MIT", ["MIT-name"]),
    ("MIT", ["MIT-under"]),
    ("BSD", ["BSD-name"]),
    ("Apache-2.0", ["Apache-under"]),
    ("Apache-2.0", ["Apache-released"]),
    ("Apache-2.0", ["Apache-header"]),
    ("GPL-3.0-only", ["GPL-3-work"]),
    ("GPL-2.0-only", ["GPL-2-work"]),
    ("GPL-3.0-only", ["GPL-3-under"]),
    ("CC-BY-4.0", ["CC-BY-4"]),
    ("CC-BY-SA-4.0", ["CC-BY-SA-4"]),
    ("CC-BY-NC-4.0", ["CC-BY-NC-4"]),
    ("CC-BY-4.0", ["CC-BY-work"]),
    ("CC-BY-SA-4.0", ["CC-BY-SA-work"]),
    ("CC-BY-NC-4.0", ["CC-BY-NC-work"]),
    ("MPL-2.0", ["MPL-header"]),
]
#: More unknown words than this between two sentences part them.
GAP_WORDS = 60
#: Every sentence and every tag has one of these words, so texts without them hold none.
HINTS = ("licen", "permission", "copyright", "software", "redistribution", "mpl")
#: An identifier tag and its expression.
_ID = r"(?:\([ \t]*)*[A-Za-z0-9][A-Za-z0-9.+:-]*+(?:[ \t]*\))*"
TAG = rf"SPDX-License-Identifier:[ \t]*({_ID}(?:[ \t]+(?:AND|OR|WITH)[ \t]+{_ID})*)"
#: Identifiers that no rule lists state the licence they name.
OTHER_ID = r"\|SPDX\|\|id:([^|]+)\|"
#: Comment leaders of letters; others go with the normalisation.
LEADER = r"(?m)^[ \t]*(?:dnl|[Rr][Ee][Mm])[ \t]+"
#: Before a line that goes on, in lower case or after a comma: no sentence begins there.
GOES_ON = r"((?:,[ \t]*\r?\n)(?=[^\r\n])|[^.!?;:\s*/#][ \t]*\r?\n(?=[ \t*/#]*[a-z(]))"
#: In the SQL, an identifier tag ends at its line's end, however the next line goes on.
TAGGED = r"(SPDX-License-Identifier:[ \t]*[A-Za-z0-9.+-]+)[ \t]*\r?\n"


def hint(sentences: dict[str, str]) -> str:
    """An expression that every text with one of the sentences, or a tag, matches. Sentences without a listed word give their longest.

    Words keep their letters when a text is normalised, so a word of a sentence stands in the text as it is.
    """
    words = {next((h for h in HINTS if h in s), None) or max(s.split(), key=len) for s in sentences.values()}
    return "(?i)spdx-license|" + "|".join(sorted(words))


def _pattern(ids: list[str]) -> str:
    return "".join(f"|{i}|" for i in ids)


def _spdx(expression: Column) -> Column:
    """The identifiers of a tag's expression, each after the tag's own; exceptions are no licences."""
    plain = F.regexp_replace(F.regexp_replace(expression, r"[\s]+WITH[\s]+[^\s()]+", ""), r"[\x01()]", " ")
    listed = F.create_map(*(F.lit(x) for name in IDENTIFIERS for x in (name.lower(), name)))

    def pair(x: Column) -> Column:
        x = F.regexp_replace(x, r"[.:\s-]+$", "")
        return F.array(F.lit("SPDX"), F.concat(F.lit("id:"), F.coalesce(F.try_element_at(listed, F.lower(x)), x)))

    return F.flatten(F.transform(F.split(F.trim(plain), r"[\s]+(?:AND|OR)[\s]+"), lambda x: pair(F.trim(x))))


def _plain(s: Column) -> Column:
    return F.trim(F.regexp_replace(F.replace(F.lower(s), F.lit("https:"), F.lit("http:")), r"[^\p{L}\p{N}]+", " "))


def known_sentences(text: Column, sentences: dict[str, str]) -> Column:
    """The known sentences of a text, in order: array of (a, b, names), a and b their place in words of the normalised text, end exclusive."""
    marked = F.regexp_replace(F.regexp_replace(text, TAG, "\n\u0001$1.\n"), LEADER, "")
    marked = F.regexp_replace(marked, GOES_ON, "$1\u0002")
    pieces = F.filter(
        F.transform(
            F.split(F.regexp_replace(marked, r"([.!?;:])[ \t]+", "$1\n"), r"[\r\n]+"),
            lambda s: F.struct(_plain(s).alias("plain"), F.when(s.startswith("\u0001"), s).alias("tag"), s.startswith("\u0002").alias("goes_on")),
        ),
        lambda p: p["plain"] != "",
    )
    known = F.create_map(*(F.lit(x) for name, sentence in sentences.items() for x in (sentence, name)))
    beginnings = F.lit("".join(f"\n{sentence} " for sentence in sentences.values()))
    firsts = sorted({sentence.split(" ")[0] for sentence in sentences.values()})

    def step(acc: Column, p: Column) -> Column:
        """Sentences begun at earlier pieces, or at this one, that go on with it; those that are whole are found."""
        to = acc["at"] + F.length(F.regexp_replace(p["plain"], "[^ ]", "")) + 1
        longer = F.transform(acc["begun"], lambda b: F.struct(b["a"].alias("a"), F.concat_ws(" ", b["s"], p["plain"]).alias("s")))
        fresh = ~p["goes_on"] & F.substring_index(p["plain"], " ", 1).isin(*firsts)
        all_of = F.when(fresh, F.array_append(longer, F.struct(acc["at"].alias("a"), p["plain"].alias("s")))).otherwise(longer)
        begun = F.when(p["tag"].isNotNull(), F.slice(acc["begun"], 1, 0)).otherwise(
            F.filter(all_of, lambda b: F.contains(beginnings, F.concat(F.lit("\n"), b["s"], F.lit(" "))))
        )
        whole = F.transform(
            F.filter(begun, lambda b: F.array_contains(F.map_keys(known), b["s"])),
            lambda b: F.struct(b["a"].alias("a"), to.alias("b"), F.array(F.try_element_at(known, b["s"])).alias("names")),
        )
        tags = F.when(p["tag"].isNotNull(), F.array(F.struct(acc["at"].alias("a"), to.alias("b"), _spdx(p["tag"]).alias("names"))))
        return F.struct(to.alias("at"), begun.alias("begun"), F.concat(acc["found"], F.coalesce(tags, whole)).alias("found"))

    start = F.struct(
        F.lit(0).alias("at"),
        F.expr("cast(array() as array<struct<a:int,s:string>>)").alias("begun"),
        F.expr("cast(array() as array<struct<a:int,b:int,names:array<string>>>)").alias("found"),
    )
    found = F.aggregate(pieces, start, step, lambda acc: acc["found"])

    def longest(every: Column) -> Column:
        wider = lambda x, y: (y["a"] <= x["a"]) & (y["b"] >= x["b"]) & ((y["a"] < x["a"]) | (y["b"] > x["b"]))
        return F.array_sort(F.filter(every, lambda x: ~F.exists(every, lambda y: wider(x, y))))

    return F.element_at(F.transform(F.array(found), longest), 1)


def scanned(docs: DataFrame, sentences: dict[str, str] = SENTENCES, rules: list[tuple[str, list[str]]] = RULES, gap_words: int = GAP_WORDS) -> DataFrame:
    """``(doc_id, licences, n_known, n_unmatched, sentences)`` per row of ``docs(doc_id, text)``.

    ``sentences`` holds the known ones: first word, word after the last, and identifiers.
    """
    text = F.col("text").cast("string")
    none = F.expr("cast(array() as array<string>)")
    ordered = sorted(rules, key=lambda rule: -len(rule[1]))
    patterns = F.array(*(F.struct(F.lit(name).alias("licence"), F.lit(_pattern(ids)).alias("pattern")) for name, ids in ordered))

    def apply(acc, rule):
        hit = F.contains(acc["left"], rule["pattern"])
        return F.struct(
            F.when(hit, F.replace(acc["left"], rule["pattern"], F.lit("#"))).otherwise(acc["left"]).alias("left"),
            F.when(hit, F.array_append(acc["found"], rule["licence"])).otherwise(acc["found"]).alias("found"),
        )

    found = F.when(text.rlike(hint(sentences)), known_sentences(text, sentences))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(found, F.expr("cast(array() as array<struct<a:int,b:int,names:array<string>>>)")).alias("sentences"))
    far = lambda x, i: (i > 0) & (x["a"] - F.get("sentences", i - 1)["b"] > gap_words)
    sequence = F.transform(
        "sentences", lambda x, i: F.concat(F.when(far(x, i), "/").otherwise(""), F.array_join(F.transform(x["names"], lambda n: F.concat(F.lit("|"), n, F.lit("|"))), ""))
    )
    matched = rows.withColumn(
        "match", F.when(F.size("sentences") > 0, F.aggregate(patterns, F.struct(F.array_join(sequence, "").alias("left"), none.alias("found")), apply))
    )
    other = F.concat("match.found", F.regexp_extract_all("match.left", F.lit(OTHER_ID), F.lit(1)))
    return matched.select(
        "doc_id",
        F.coalesce(F.array_join(F.array_sort(F.array_distinct(other)), ","), F.lit("")).alias("licences"),
        F.aggregate("sentences", F.lit(0), lambda n, x: n + F.size(x["names"])).cast("long").alias("n_known"),
        F.coalesce(F.length(F.regexp_replace(F.regexp_replace("match.left", OTHER_ID, "#"), "[^|]", "")) / 2, F.lit(0)).cast("long").alias("n_unmatched"),
        "sentences",
    )


def op4_sentence_rule_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned(table(spark, sf_dir, "documents")).drop("sentences")


def _oracle() -> str:
    known = ", ".join(f"('{s}', '|{name}|')" for name, s in SENTENCES.items())
    ids = ", ".join(f"('{name.lower()}', '{name}')" for name in IDENTIFIERS)
    steps, last = [], "s0"
    for k, (licence, names) in enumerate(sorted(RULES, key=lambda rule: -len(rule[1])), 1):
        p = _pattern(names)
        steps.append(
            f"s{k} AS (SELECT doc_id, n_known, replace(seq, '{p}', '#') AS seq, "
            f"CASE WHEN contains(seq, '{p}') THEN list_append(found, '{licence}') ELSE found END AS found FROM {last})"
        )
        last = f"s{k}"
    cut = r"""string_split(translate(regexp_replace(regexp_replace(regexp_replace(marked, '\r?\n[ \t]*([a-z(])', ' \1', 'g'),
    ',[ \t]*\r?\n', ', ', 'g'), '([.!?;:])[ \t]+', '\1' || chr(10), 'g'), chr(13), chr(10)), chr(10))"""
    return rf"""
WITH known(sentence, names) AS (VALUES {known}), ids(low, id) AS (VALUES {ids}), pieces AS (
  SELECT doc_id, unnest({cut}) AS piece, generate_subscripts({cut}, 1) AS i
  FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '{TAGGED}', '\1.' || chr(10), 'g') AS marked FROM documents)
), plain AS (
  SELECT doc_id, i, piece, trim(regexp_replace(lower(piece), '[^\p{{L}}\p{{N}}]+', ' ', 'g')) AS s FROM pieces
), placed AS (
  SELECT *, lag(s) OVER (PARTITION BY doc_id ORDER BY i) = 'spdx license identifier' AS tagged,
    sum(CASE WHEN s = '' THEN 0 ELSE length(s) - length(replace(s, ' ', '')) + 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS b,
    CASE WHEN s = '' THEN 0 ELSE length(s) - length(replace(s, ' ', '')) + 1 END AS w
  FROM plain WHERE s <> ''
), found AS (
  SELECT doc_id, i, b - w AS a, b, CASE WHEN tagged THEN '|SPDX||id:' || coalesce(id, regexp_extract(piece, '[A-Za-z0-9.+-]*[A-Za-z0-9+]', 0)) || '|' ELSE names END AS names
  FROM placed LEFT JOIN known ON sentence = s AND NOT coalesce(tagged, FALSE) LEFT JOIN ids ON tagged AND low = lower(regexp_extract(piece, '[A-Za-z0-9.+-]*[A-Za-z0-9+]', 0))
  WHERE coalesce(tagged, FALSE) OR sentence IS NOT NULL
), parted AS (
  SELECT *, CASE WHEN a - lag(b) OVER (PARTITION BY doc_id ORDER BY i) > {GAP_WORDS} THEN '/' ELSE '' END AS part FROM found
), named AS (
  SELECT doc_id, string_agg(part || names, '' ORDER BY i) AS seq, sum(length(regexp_replace(names, '[^|]', '', 'g')) / 2) AS n FROM parted GROUP BY doc_id
), s0 AS (
  SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_known, coalesce(seq, '') AS seq, CAST([] AS VARCHAR[]) AS found
  FROM documents d LEFT JOIN named USING (doc_id)
), {", ".join(steps)}
SELECT doc_id, array_to_string(list_sort(list_distinct(list_concat(found, regexp_extract_all(seq, '[|]SPDX[|][|]id:([^|]+)[|]', 1)))), ',') AS licences, n_known,
  CAST(length(regexp_replace(regexp_replace(seq, '[|]SPDX[|][|]id:([^|]+)[|]', '#', 'g'), '[^|]', '', 'g')) / 2 AS BIGINT) AS n_unmatched
FROM {last}
"""


ORACLE = _oracle()
