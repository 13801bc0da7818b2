"""License scans by sentence-rule recognition.

A text is cut into sentences, each sentence is normalised and looked up among known
license sentences, and the resulting sequence of identifiers is matched against ordered
rules. A rule names a license by a run of adjacent identifiers; a run that matched is
consumed, so a later, more general rule cannot claim it again. Sentences that are not
known stand as one ``?`` however many follow each other. A line end closes a sentence, since
titles stand on lines of their own, but a known sentence is also found wrapped over lines.
The tables of sentences and rules are configuration of a fixed size, so they travel inside
the plan. Built-in functions only, and no shuffle: a row is scanned where it is read.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from monthgrid.llm.common import text_or_empty

# Sentences of public license texts and notices, normalised, and what they stand for.
SENTENCES: dict[str, str] = {
    "released under the mit license": "MIT_GRANT",
    "licensed under the mit license": "MIT_GRANT",
    "the mit license mit": "MIT_TITLE",
    "the mit license": "MIT_TITLE",
    "mit license": "MIT_TITLE",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "MIT_NOTICE",
    "licensed under the apache license version 2.0": "APACHE_2",
    "licensed under the apache license version 2.0 the license": "APACHE_2",
    "you may not use this file except in compliance with the license": "APACHE_COMPLY",
    "you may obtain a copy of the license at": "APACHE_COPY",
    "see the license for the specific language governing permissions and limitations under the license": "APACHE_SEE",
    "apache license": "APACHE_TITLE",
    "this work is licensed under the gnu general public license version 3": "GPL_3",
    "this work is licensed under the gnu general public license version 2": "GPL_2",
    "this program is free software": "FREE_SOFTWARE",
    "this library is free software": "FREE_SOFTWARE",
    "you should have received a copy of the gnu general public license along with this program": "GPL_RECEIVED",
    "you should have received a copy of the gnu lesser general public license along with this library": "LGPL_RECEIVED",
    "this work is licensed under the gnu lesser general public license version 3": "LGPL_3",
    "this work is licensed under the gnu affero general public license version 3": "AGPL_3",
    "gnu general public license": "GPL_TITLE",
    "licensed under cc by nc 4.0": "CC_BY_NC_4",
    "licensed under cc by 4.0": "CC_BY_4",
    "licensed under cc by sa 4.0": "CC_BY_SA_4",
    "licensed under cc by nd 4.0": "CC_BY_ND_4",
    "licensed under cc by nc sa 4.0": "CC_BY_NC_SA_4",
    "licensed under cc by nc nd 4.0": "CC_BY_NC_ND_4",
    "licensed under cc0 1.0": "CC0_1",
    "this work is licensed under a creative commons attribution 4.0 international license": "CC_BY_4",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "BSD_SOURCE",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "BSD_BINARY",
    "licensed under the bsd 2 clause license": "BSD_2",
    "licensed under the bsd 3 clause license": "BSD_3",
    "licensed under the mozilla public license version 2.0": "MPL_2",
    "this source code form is subject to the terms of the mozilla public license v 2.0": "MPL_2",
    "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla.org mpl 2.0": "MPL_OBTAIN",
    "licensed under the isc license": "ISC",
    "this is free and unencumbered software released into the public domain": "UNLICENSE",
    "this work is in the public domain": "PUBLIC_DOMAIN",
    "all rights reserved": "ALL_RIGHTS",
}

# Rules in the order they are tried; longer runs come before the runs they contain.
RULES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("Apache-2.0", ("APACHE_2", "APACHE_COMPLY", "APACHE_COPY")),
    ("Apache-2.0", ("APACHE_2", "APACHE_COMPLY")),
    ("Apache-2.0", ("APACHE_2",)),
    ("MIT", ("MIT_TITLE", "?", "MIT_NOTICE")),
    ("MIT", ("MIT_TITLE", "MIT_NOTICE")),
    ("MIT", ("MIT_NOTICE",)),
    ("MIT", ("MIT_GRANT",)),
    ("LGPL", ("FREE_SOFTWARE", "?", "LGPL_RECEIVED")),
    ("LGPL", ("LGPL_RECEIVED",)),
    ("LGPL-3.0", ("LGPL_3",)),
    ("AGPL-3.0", ("AGPL_3",)),
    ("GPL", ("FREE_SOFTWARE", "?", "GPL_RECEIVED")),
    ("GPL", ("GPL_RECEIVED",)),
    ("GPL-3.0", ("GPL_3",)),
    ("GPL-2.0", ("GPL_2",)),
    ("BSD", ("BSD_SOURCE", "BSD_BINARY")),
    ("BSD-2-Clause", ("BSD_2",)),
    ("BSD-3-Clause", ("BSD_3",)),
    ("MPL-2.0", ("MPL_2", "MPL_OBTAIN")),
    ("MPL-2.0", ("MPL_2",)),
    ("CC-BY-NC-ND-4.0", ("CC_BY_NC_ND_4",)),
    ("CC-BY-NC-SA-4.0", ("CC_BY_NC_SA_4",)),
    ("CC-BY-NC-4.0", ("CC_BY_NC_4",)),
    ("CC-BY-ND-4.0", ("CC_BY_ND_4",)),
    ("CC-BY-SA-4.0", ("CC_BY_SA_4",)),
    ("CC-BY-4.0", ("CC_BY_4",)),
    ("CC0-1.0", ("CC0_1",)),
    ("ISC", ("ISC",)),
    ("Unlicense", ("UNLICENSE",)),
    ("Public-Domain", ("PUBLIC_DOMAIN",)),
)

# Heads of license files, which give the version on a line of its own.
FILE_SENTENCES: dict[str, str] = {
    "apache license version 2.0 january 2004": "APACHE_2_HEAD",
    "gnu general public license version 2 june 1991": "GPL_2_HEAD",
    "gnu general public license version 3 29 june 2007": "GPL_3_HEAD",
    "gnu lesser general public license version 2.1 february 1999": "LGPL_2_1_HEAD",
    "gnu lesser general public license version 3 29 june 2007": "LGPL_3_HEAD",
    "gnu affero general public license version 3 19 november 2007": "AGPL_3_HEAD",
    "mozilla public license version 2.0": "MPL_2_HEAD",
    "bsd 2 clause license": "BSD_2_HEAD",
    "bsd 3 clause license": "BSD_3_HEAD",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "BSD_GRANT",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "BSD_ENDORSE",
}

# These come before ``RULES``. A number of a clause stands as ``?`` before it.
FILE_RULES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("Apache-2.0", ("APACHE_2_HEAD",)),
    ("GPL-2.0", ("GPL_2_HEAD",)),
    ("GPL-3.0", ("GPL_3_HEAD",)),
    ("LGPL-2.1", ("LGPL_2_1_HEAD",)),
    ("LGPL-3.0", ("LGPL_3_HEAD",)),
    ("AGPL-3.0", ("AGPL_3_HEAD",)),
    ("MPL-2.0", ("MPL_2_HEAD",)),
    ("BSD-3-Clause", ("BSD_SOURCE", "?", "BSD_BINARY", "?", "BSD_ENDORSE")),
    ("BSD-3-Clause", ("BSD_SOURCE", "BSD_BINARY", "BSD_ENDORSE")),
    ("BSD-3-Clause", ("BSD_3_HEAD",)),
    ("BSD-2-Clause", ("BSD_2_HEAD",)),
    ("BSD", ("BSD_SOURCE", "?", "BSD_BINARY")),
)

UNKNOWN = "?"
#: Ends of sentences: line ends, or closing marks before white space or the end of the text.
SENTENCE_END = r"[\n\r]+|[.!?;:]+(?:[ \t\n\r\f]+|\z)"
NOT_KEPT = r"[^a-z0-9.]+"
#: A line end and what stands before the first word of the next line, such as indents and comment marks.
LINE_START = r"(?:\r\n|[\n\r])[^a-z0-9.\n\r]*"
#: Short forms whose dot does not end a sentence.
SHORT_FORM = r"\b(v|ver|no|inc|ltd|co|corp)\.(?:[ \t\f]+\n?|\n)(?!\n)"


def sentences(text: Column) -> Column:
    """Normalised non-empty sentences: lower case, letters, digits and dots, single spaces."""
    cut = F.split(text, SENTENCE_END, -1)
    return F.filter(F.transform(cut, lambda s: F.trim(F.regexp_replace(F.lower(s), NOT_KEPT, " "))), lambda s: s != "")


def unwrapped(text: Column, known: dict[str, str]) -> Column:
    """As ``sentences``, but a known sentence is one entry even if it is wrapped over lines.

    A sentence runs on over a single line end, comment marks of the next line included, and over the dot
    of a short form, not over a blank line or another closing mark.
    """
    # "|" is a sure end, "\n" one that a known sentence may run over.
    marked = F.regexp_replace(F.translate(F.lower(text), "|", " "), LINE_START, "\n")
    marked = F.regexp_replace(F.regexp_replace(marked, SHORT_FORM, "$1\n"), r"[.!?;:]+(?:[ \t\n\r\f]+|\z)|\n\n+", "|")
    marked = F.regexp_replace(F.regexp_replace(marked, r"[^a-z0-9.\n|]+", " "), r" *([\n|]) *", "$1")
    longest = sorted(known, key=len, reverse=True)
    either = "|".join("[ \n]".join(re.escape(w) for w in s.split(" ")) for s in longest)
    # The entries at odd places are known sentences.
    parts = F.split(F.regexp_replace(F.trim(marked), rf"(?<![^\n|])(?:{either})(?![^\n|])", "\x01$0\x01"), "\x01", -1)
    lists = F.transform(parts, lambda p, i: F.when(i % 2 == 1, F.array(F.translate(p, "\n", " "))).otherwise(F.split(p, r"[\n|]", -1)))
    return F.filter(F.transform(F.flatten(lists), lambda s: F.trim(s)), lambda s: s != "")


def identify(found: Column, known: dict[str, str]) -> Column:
    """Identifiers of normalised sentences, ``?`` for those not known."""
    by_id: dict[str, list[str]] = {}
    for sentence, name in known.items():
        by_id.setdefault(name, []).append(sentence)
    listed = list(known)

    def one(s: Column) -> Column:
        name = F.coalesce(*[F.when(s.isin(texts), F.lit(i)) for i, texts in by_id.items()])
        return F.when(s.isin(listed), name).otherwise(F.lit(UNKNOWN))

    return F.transform(found, one)


def scan_licenses(docs: DataFrame, id_cols: list[str], text_col: str = "text", known: dict[str, str] = SENTENCES | FILE_SENTENCES,
                  rules: tuple[tuple[str, tuple[str, ...]], ...] = FILE_RULES + RULES) -> DataFrame:
    """``id_cols`` with n_sentences, sentence_ids (known ones in order), licenses and unclaimed.

    ``n_sentences`` counts every line end as an end; a known sentence wrapped over lines is one identifier.
    ``licenses`` holds each license once, in the order of the rules; ``unclaimed`` the known
    identifiers that no rule consumed, in order. One row per input row, also for repeated
    rows; NULL and empty texts have no sentences and empty lists; NULL ids are carried; other
    columns are not read, so their names cannot clash. An empty table gives an empty result.
    """
    df = docs.select(*id_cols, text_or_empty(text_col).alias("_text"))
    df = df.withColumn("_found", sentences(F.col("_text"))).withColumn("_flat", F.array_join("_found", " "))
    # Only a text that holds the words of a known sentence, wrapped or not, is read a second time.
    holds = reduce(lambda a, b: a | b, [F.contains("_flat", F.lit(s)) for s in known], F.lit(False))
    whole = F.when(holds, unwrapped(F.col("_text"), known)).otherwise(F.col("_found"))
    df = df.withColumn("_whole", whole).withColumn("_ids", identify(F.col("_whole"), known))
    tagged = F.concat(F.lit("<"), F.array_join("_ids", "><"), F.lit(">"))
    df = df.select(
        *id_cols,
        F.size("_found").cast("bigint").alias("n_sentences"),
        F.filter("_ids", lambda x: x != UNKNOWN).alias("sentence_ids"),
        F.regexp_replace(F.when(F.size("_ids") == 0, "").otherwise(tagged), r"(<\?>)+", "<?>").alias("_left"),
    )
    # Texts without a known sentence need no rule.
    left, hits = F.col("_left"), []
    for name, run in rules:
        tag = "<" + "><".join(run) + ">"
        hits.append(F.when(left.contains(tag), F.lit(name)))
        left = F.replace(left, F.lit(tag), F.lit("<#>"))
    some = F.size("sentence_ids") > 0
    none = F.array().cast("array<string>")
    rest = F.filter(F.split(F.regexp_replace(left, r"^<|>$", ""), "><"), lambda x: ~x.isin("", "?", "#"))
    return df.select(
        *id_cols,
        "n_sentences",
        "sentence_ids",
        F.when(some, F.array_distinct(F.array_compact(F.array(*hits)))).otherwise(none).alias("licenses"),
        F.when(some, rest).otherwise(none).alias("unclaimed"),
    )
