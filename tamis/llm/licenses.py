"""License scan by sentence rules.

A known licence sentence is recognised where it begins a line or a sentence of the text, by all
its words, on one line or wrapped over several lines of a paragraph; the sentence may go on after
it. The recognised identifiers, in order, are matched against rules, each an ordered sequence
of identifiers with at most ``GAP`` other recognised sentences between two of them; a
rule that needs more sentences goes first where rules begin at one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamis.llm.common import payload

GAP = 2

# Known licence sentences, normalised, by identifier. One letter each.
SENTENCES = {
    "M": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
    "N": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "W": "the software is provided as is without warranty of any kind express or implied",
    "m": "released under the mit license",
    "b": "licensed under the bsd license",
    "R": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "S": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "B": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "E": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "a": "licensed under the apache license version 2 0",
    "u": "you may not use this file except in compliance with the license",
    "o": "you may obtain a copy of the license at",
    "g": "this work is licensed under the gnu general public license version 3",
    "F": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "G": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "D": "this program is distributed in the hope that it will be useful but without any warranty",
    "c": "licensed under cc by nc 4 0",
    "d": "licensed under cc by 4 0",
    "e": "licensed under cc by sa 4 0",
    "z": "licensed under cc0 1 0",
    "p": "this source code form is subject to the terms of the mozilla public license v 2 0",
}
# Ordered rules, licence and class; the sentences that a rule needs, in order.
RULES = [
    ("MNW", "MIT", "permissive"),
    ("m", "MIT", "permissive"),
    ("RSBE", "BSD-3-Clause", "permissive"),
    ("RSB", "BSD-2-Clause", "permissive"),
    ("b", "BSD", "permissive"),
    ("auo", "Apache-2.0", "permissive"),
    ("a", "Apache-2.0", "permissive"),
    ("FD", "GPL-3.0-or-later", "copyleft"),
    ("GD", "GPL-2.0-or-later", "copyleft"),
    ("g", "GPL-3.0", "copyleft"),
    ("p", "MPL-2.0", "copyleft"),
    ("c", "CC-BY-NC-4.0", "non-commercial"),
    ("d", "CC-BY-4.0", "permissive"),
    ("e", "CC-BY-SA-4.0", "copyleft"),
    ("z", "CC0-1.0", "permissive"),
]


# Further official wordings of these sentences.
WORDINGS = [
    ("N", "the above copyright notice and this permission notice including the next paragraph shall be included in all copies or substantial portions of the software"),
    ("c", "this work is licensed under cc by nc 4 0"),
    ("c", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("c", "this work is licensed under the creative commons attribution noncommercial 4 0 international license"),
    ("d", "this work is licensed under cc by 4 0"),
    ("d", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("d", "this work is licensed under the creative commons attribution 4 0 international license"),
    ("e", "this work is licensed under cc by sa 4 0"),
    ("e", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("e", "this work is licensed under the creative commons attribution sharealike 4 0 international license"),
]
HOLDER = "the copyright holder"  # in E, where texts may name the holder
SOFT, HARD = "\n", "\x02"  # marks of a line's or sentence's end, and of a paragraph's


def marked(text: Column) -> Column:
    """Words of letters and digits, split by one space, or by SOFT where a line ends or white space follows . ! ? ; : or by HARD at blank lines."""
    t = F.translate(F.lower(text), "\x01\x02", "  ")
    # every pattern begins at one character or at a run's begin, so long runs cost one pass
    for pattern, mark in (
        (r"\r\n?", "\n"),
        (r"[.!?;:][ \t]", "\x01"),
        (r"[^a-z0-9\n\x01]+", " "),
        (r"(?<![ \n\x01])[ \x01]*+\n[ \x01]*+\n[ \n\x01]*+", HARD),
        (r"(?<![ \n\x01]) ?[\n\x01][ \n\x01]*+", SOFT),
    ):
        t = F.regexp_replace(t, pattern, mark)
    return F.trim(t)


def known_pattern() -> str:
    """The known sentences at a line's or sentence's begin, the longest first."""
    gap = f"[ {SOFT}]"

    def one(letter: str, s: str) -> str:
        wide = s.replace(" ", gap)
        if letter == "E":
            wide = wide.replace(HOLDER.replace(" ", gap), f"[a-z0-9]+(?:{gap}[a-z0-9]+){{0,15}}?")
        if letter == "g":  # "or later" is another licence
            wide += f"(?!{gap}or{gap}(?:at{gap}your{gap}option{gap})?(?:any{gap})?later)"
        return wide

    every = sorted([*SENTENCES.items(), *WORDINGS], key=lambda x: -len(x[1]))
    return f"(?:^|(?<=[{SOFT}{HARD}]))(?:{'|'.join(one(*x) for x in every)})(?![a-z0-9])"


def identifiers(text: Column) -> Column:
    """The letters of the recognised sentences, in order."""
    known = F.create_map(*(F.lit(x) for letter, s in [*SENTENCES.items(), *WORDINGS] for x in (s, letter)))
    # a text without any of these words holds no known sentence
    gate = text.rlike("(?i)licensed|license|redistribut|permission|copyright|warranty|free software")
    found = F.regexp_extract_all(marked(text), F.lit(known_pattern()), 0)
    holder = SENTENCES["E"].split(HOLDER)[0]
    plain = F.transform(found, lambda s: F.translate(s, SOFT, " "))
    letters = F.transform(plain, lambda s: F.when(s.startswith(holder), F.lit("E")).otherwise(F.element_at(known, s)))
    return F.when(gate, F.array_join(letters, "")).otherwise("")


def rule_pattern(needs: str) -> str:
    return f".{{0,{GAP}}}".join(needs)


def scan(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, sentence_ids, licenses (in order of their place) and classes (sorted, distinct).

    Null and empty texts have no licences. Rules are tried from the left; a rule's sentences
    are used up, and of rules that begin at one place the longest in ``RULES`` wins. Null and
    repeated doc_ids are kept as they are. Other input columns are ignored.
    """
    slim = payload(docs, "doc_id", "text").select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    held = slim.select("doc_id", identifiers(F.col("text")).alias("sentence_ids"))
    ordered = sorted(RULES, key=lambda r: -len(r[0]))
    every = "|".join(rule_pattern(needs) for needs, _, _ in ordered)
    matches = F.regexp_extract_all("sentence_ids", F.lit(every), 0)

    def named(which: int):
        def name(match: Column) -> Column:
            found = F.lit(None).cast("string")
            for rule in reversed(ordered):
                found = F.when(match.rlike(f"^(?:{rule_pattern(rule[0])})$"), F.lit(rule[which])).otherwise(found)
            return found

        return name

    return held.withColumn("matches", matches).select(
        "doc_id", "sentence_ids", F.transform("matches", named(1)).alias("licenses"),
        F.array_sort(F.array_distinct(F.transform("matches", named(2)))).alias("classes"),
    )


def digest(scanned: DataFrame) -> DataFrame:
    return scanned.select(
        "doc_id", "sentence_ids", F.size("licenses").cast("long").alias("n_licenses"), F.array_join("licenses", ",").alias("licenses"),
        F.array_join("classes", ",").alias("classes"),
    )
