"""Licence scans by sentence rules.

A text is cut into sentences; each is normalised and looked up among the known licence sentences. The text
is then a short sequence of identifiers, one letter per sentence, and a licence is found where its rule, an
ordered list of identifiers with few other sentences between them, matches that sequence. Texts are read twice:
by lines, where every line break ends a sentence, and by paragraphs, where a single one is white space, since
notices are wrapped. A rule may match either reading. All of it is one projection: no shuffle, no join, whatever
the sizes of texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stationloom.llm.text import whole_text

# Sentences that name or make up public licences, by identifier (a letter), normalised.
SENTENCES = {
    "a": "licensed under the apache license version 2 0",
    "b": "released under the mit license",
    "c": "licensed under cc by nc 4 0",
    "d": "this work is licensed under the gnu general public license version 3",
    "e": "all rights reserved",
    "f": "licensed under the mit license",
    "g": "licensed under cc by 4 0",
    "h": "licensed under cc by sa 4 0",
    "i": "this work is licensed under the gnu general public license version 2",
    "j": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "k": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "l": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "m": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "n": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "o": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "p": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "q": "you may not use this file except in compliance with the license",
    "r": "you may obtain a copy of the license at",
    "s": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "t": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "u": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
}
# Licences, whether they allow training use, and their rules as ordered identifiers.
RULES = [
    ("apache-2.0", True, "a"),
    ("apache-2.0-notice", True, "aqrs"),
    ("bsd-2-clause", True, "mno"),
    ("bsd-3-clause", True, "mnop"),
    ("cc-by-4.0", True, "g"),
    ("cc-by-nc-4.0", False, "c"),
    ("cc-by-sa-4.0", False, "h"),
    ("gpl-2.0", False, "i"),
    ("gpl-3.0", False, "d"),
    ("gpl-3.0-or-later", False, "tu"),
    ("mit", True, "b"),
    ("mit", True, "f"),
    ("mit-text", True, "jkl"),
    ("proprietary", False, "e"),
]
#: Other sentences that may stand between two of a rule.
GAP = 2
SPLIT = r"[.!?:]+[ \t\r\n]+|[\r\n]+"
#: In paragraphs, sentences end at punctuation and at lines that are blank but for comment signs.
PARAGRAPH_SPLIT = r"[.!?:]+[ \t\r\n]+|\r?\n[ \t\r*#/;%-]*\n|\r[ \t*#/;%-]*\r"
OTHER = "-"
# Sentences as the notices really have them, which only whole paragraphs show, and their identifiers.
NOTICE_SENTENCES = {
    "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license": "aq",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "t",
}
# End of fixed values.


def rule_pattern(rule: str) -> str:
    """A rule over the letters of a text's sentences."""
    return f".{{0,{GAP}}}".join(rule)


def sentence_letters(text: Column, split: str = SPLIT, more: dict[str, str] | None = None) -> Column:
    """One letter per sentence: its identifier, or ``-``; sentences in ``more`` stand for all their letters."""
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sentences = {sentence: letter for letter, sentence in SENTENCES.items()} | (more or {})
    known = F.create_map(*[F.lit(x) for pair in sentences.items() for x in pair])
    shortest, longest = min(map(len, sentences)), max(map(len, sentences))

    def letter(sentence: Column) -> Column:
        plain = F.trim(F.regexp_replace(sentence, "[^a-z0-9]+", " "))
        # a sentence that is too short for any known one needs no normalising
        return F.when(F.length(sentence) < shortest, F.lit(OTHER)).otherwise(
            F.when(F.length(plain).between(shortest, longest), F.coalesce(F.try_element_at(known, plain), F.lit(OTHER))).otherwise(OTHER))

    return F.array_join(F.transform(F.split(lower, split), letter), "")


def scan_licences(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_sentences, n_licence_sentences, licences, restricted``.

    ``licences`` are the names of all rules that match, sorted and comma-joined (empty: none); ``restricted``
    is whether one of them doesn't allow training use. Sentences are counted by lines. Null texts are empty and have no sentence. Repeated
    rows each give a row; other columns aren't read.
    """
    text = whole_text(text_column)
    rows = docs.select(F.col(id_column).alias("doc_id"), F.when(text == "", "").otherwise(sentence_letters(text)).alias("_letters"),
                       sentence_letters(text, PARAGRAPH_SPLIT, NOTICE_SENTENCES).alias("_wrapped"))
    found = F.array_sort(F.array_distinct(F.array_compact(F.array(
        *[F.when(F.col("_letters").rlike(rule_pattern(rule)) | F.col("_wrapped").rlike(rule_pattern(rule)), F.lit(name)) for name, _, rule in RULES]))))
    bad = F.array(*[F.lit(x) for x in sorted({name for name, free, _ in RULES if not free})])
    return rows.select(
        "doc_id",
        F.length("_letters").cast("long").alias("n_sentences"),
        F.length(F.regexp_replace("_letters", OTHER, "")).cast("long").alias("n_licence_sentences"),
        F.array_join(found, ",").alias("licences"),
        F.arrays_overlap(found, bad).alias("restricted"),
    )


def oracle_sql() -> str:
    """The same in DuckDB's SQL."""
    known = "MAP {" + ", ".join(f"'{s}': '{letter}'" for letter, s in SENTENCES.items()) + "}"
    names = sorted({name for name, _, _ in RULES})
    tests = ", ".join(
        "CASE WHEN " + " OR ".join(f"regexp_matches(letters, '{rule_pattern(r)}')" for n, _, r in RULES if n == name) + f" THEN '{name}' END"
        for name in names)
    bad = ", ".join(f"'{x}'" for x in sorted({name for name, free, _ in RULES if not free}))
    return rf"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
s AS (SELECT doc_id, t, list_transform(string_split_regex(t, '{SPLIT}'),
        lambda x: coalesce(({known})[trim(regexp_replace(x, '[^a-z0-9]+', ' ', 'g'))], '{OTHER}')) AS l FROM d),
j AS (SELECT doc_id, CASE WHEN t = '' THEN '' ELSE array_to_string(l, '') END AS letters FROM s),
f AS (SELECT doc_id, letters, list_filter([{tests}], lambda x: x IS NOT NULL) AS found FROM j)
SELECT doc_id, length(letters) AS n_sentences, length(replace(letters, '{OTHER}', '')) AS n_licence_sentences,
       array_to_string(found, ',') AS licences, list_has_any(found, [{bad}]) AS restricted FROM f"""
