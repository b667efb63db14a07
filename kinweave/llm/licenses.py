"""Licence recognition by sentence rules, with DataFrame functions alone.

A text is cut into sentences; a sentence that is not known is cut into its lines. Each is normalised and looked up among
the known licence sentences; the identifiers, in the order of the text, form a sequence. Rules are sequences of
identifiers, tried in order; what a rule has matched no later rule can match.

Every known sentence holds one of CUES, so a text without a cue has no known sentence and is not cut at all.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Known sentences by identifier.
SENTENCES = {
    "apache-by": "Licensed under the Apache License, Version 2.0.",
    "apache-the": 'Licensed under the Apache License, Version 2.0 (the "License");',
    "apache-may": 'you may not use this file except in compliance with the License.',
    "apache-copy": "You may obtain a copy of the License at",
    "apache-as-is": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "apache-see": "See the License for the specific language governing permissions and limitations under the License.",
    "mit-released": "Released under the MIT License.",
    "mit-licensed": "Licensed under the MIT License.",
    "mit-title": "The MIT License (MIT)",
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "gpl3-work": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-copy": "You should have received a copy of the GNU General Public License along with this program.",
    "lgpl-free": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
    "lgpl2-free": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Library General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "lgpl21-free": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "lgpl3-free": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version.",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-names": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "mpl2-form": "This Source Code Form is subject to the terms of the Mozilla Public License, v.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "cc-by": "Licensed under CC BY 4.0.",
    "cc-by-sa": "Licensed under CC BY-SA 4.0.",
    "cc-by-nc": "Licensed under CC BY-NC 4.0.",
    "cc-by-nd": "Licensed under CC BY-ND 4.0.",
    "cc-by-long": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-long": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc-by-nc-long": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "cc0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "spdx-mit": "SPDX-License-Identifier: MIT",
    "spdx-apache": "SPDX-License-Identifier: Apache-2.0",
    "spdx-gpl3": "SPDX-License-Identifier: GPL-3.0-or-later",
    "spdx-bsd3": "SPDX-License-Identifier: BSD-3-Clause",
    "reserved": "All rights reserved.",
}

# Ordered rules, a licence and a sequence of sentence identifiers.
RULES = (
    ("MIT", ("mit-title", "mit-grant", "mit-notice")),
    ("MIT", ("mit-grant", "mit-notice")),
    ("Apache-2.0", ("apache-the", "apache-may", "apache-copy", "apache-as-is", "apache-see")),
    ("Apache-2.0", ("apache-the", "apache-may")),
    ("GPL-3.0", ("gpl-free", "gpl-copy")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("Apache-2.0", ("apache-by",)),
    ("Apache-2.0", ("apache-the",)),
    ("Apache-2.0", ("spdx-apache",)),
    ("MIT", ("mit-released",)),
    ("MIT", ("mit-licensed",)),
    ("MIT", ("mit-title",)),
    ("MIT", ("mit-grant",)),
    ("MIT", ("spdx-mit",)),
    ("GPL-3.0", ("gpl3-work",)),
    ("GPL-3.0", ("gpl-free",)),
    ("GPL-3.0", ("spdx-gpl3",)),
    ("LGPL", ("lgpl-free",)),
    ("BSD-3-Clause", ("spdx-bsd3",)),
    ("MPL-2.0", ("mpl2-form",)),
    ("ISC", ("isc-grant",)),
    ("CC-BY-NC-4.0", ("cc-by-nc",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-long",)),
    ("CC-BY-SA-4.0", ("cc-by-sa",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-long",)),
    ("CC-BY-ND-4.0", ("cc-by-nd",)),
    ("CC-BY-4.0", ("cc-by",)),
    ("CC-BY-4.0", ("cc-by-long",)),
    ("CC0-1.0", ("cc0",)),
    ("Proprietary", ("reserved",)),
    ("LGPL", ("lgpl2-free",)),
    ("LGPL", ("lgpl21-free",)),
    ("LGPL", ("lgpl3-free",)),
)

#: Every known sentence has one of these once it is normalised.
CUES = ("licen", "copyright", "rights", "redistribution")
#: Between sentences: an end sign before white space, or an empty line. Within, a line may end anywhere.
SENTENCE_END = r"[.!?]+[ \t\r]*\n|[.!?]+[ \t\r]+|\n[ \t\r]*\n"
_OTHER = r"[^a-z0-9]+"


def normal(sentence: str) -> str:
    """Lower-case ASCII letters and digits, all else one space between words."""
    return re.sub(_OTHER, " ", sentence.lower()).strip(" ")


KNOWN = {normal(s): k for k, s in SENTENCES.items()}
assert len(KNOWN) == len(SENTENCES) and all(any(c in s for c in CUES) for s in KNOWN)


def _normal(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), _OTHER, " "))


def scan(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_sentences, sentence_ids (comma-joined, in order of the text), licenses (sorted, comma-joined) and
    first_rule (number of the first rule that matches, -1 if none) of every whole text.

    Null and empty texts have no sentences. A repeated sentence counts each time. One row in, one row out.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    low = F.lower(text)
    cue = F.lit(False)
    for c in CUES:
        cue = cue | F.contains(low, F.lit(c))
    known = F.create_map(*[F.lit(x) for kv in sorted(KNOWN.items()) for x in kv])

    def ids(sentence: Column) -> Column:
        whole = F.try_element_at(known, _normal(sentence))
        lines = F.filter(F.transform(F.split(sentence, "\n"), lambda x: F.try_element_at(known, _normal(x))), lambda x: x.isNotNull())
        return F.when(whole.isNotNull(), F.array(whole)).otherwise(lines)

    cued = documents.select(F.col(id_col).alias("id"), F.when(cue, text).otherwise(F.lit("")).alias("text"))
    found = cued.select("id", F.when(F.length("text") > 0, F.flatten(F.transform(F.split("text", SENTENCE_END), ids))).otherwise(F.array().cast("array<string>")).alias("found"))
    found = found.select("id", "found", F.array_join(F.transform("found", lambda x: F.concat(F.lit("<"), x, F.lit(">"))), "").alias("left"))
    names, first = [], []
    for i, (name, rule) in enumerate(RULES):
        pattern = "".join(f"<{x}>" for x in rule)
        hit = F.contains(F.col("left"), F.lit(pattern))
        found = found.withColumn(f"hit{i}", hit).withColumn("left", F.replace(F.col("left"), F.lit(pattern), F.lit("|")))
        names.append(F.when(F.col(f"hit{i}"), F.lit(name)))
        first.append(F.when(F.col(f"hit{i}"), F.lit(i)))
    return found.select(
        F.col("id").alias(id_col),
        F.size("found").cast("long").alias("n_sentences"),
        F.array_join("found", ",").alias("sentence_ids"),
        F.array_join(F.array_sort(F.array_distinct(F.filter(F.array(*names), lambda x: x.isNotNull()))), ",").alias("licenses"),
        F.coalesce(*first, F.lit(-1)).cast("long").alias("first_rule"),
    )


def oracle_sql() -> str:
    """The same for DuckDB over `documents`, from the same tables of sentences and rules."""

    def q(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    known = ", ".join(f"{q(s)}: {q(k)}" for s, k in sorted(KNOWN.items()))
    low = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"
    cues = " or ".join(f"contains(lower(text), {q(c)})" for c in CUES)
    steps, last = [], "t"
    for i, (_, rule) in enumerate(RULES):
        pattern = q("".join(f"<{x}>" for x in rule))
        steps.append(f"r{i} as (select * exclude (rest), contains(rest, {pattern}) as hit{i}, replace(rest, {pattern}, '|') as rest from {last})")
        last = f"r{i}"
    names = ", ".join(f"case when hit{i} then {q(name)} end" for i, (name, _) in enumerate(RULES))
    first = " ".join(f"when hit{i} then {i}" for i in range(len(RULES)))
    return rf"""
with k as (select map {{{known}}} as known),
 s as (select doc_id, unnest(list_zip(range(len(parts)), parts), recursive := false) as p
       from (select doc_id, regexp_split_to_array(text, '{SENTENCE_END}') as parts from documents where {cues})),
 w as (select doc_id, p[1] as i, p[2] as sentence, known[{low.format("p[2]")}] as whole, known from s, k),
 f as (select doc_id, i, case when whole is not null then [whole]
         else list_filter(list_transform(string_split(sentence, chr(10)), lambda x: known[{low.format("x")}]), lambda x: x is not null) end as ids from w),
 g as (select doc_id, flatten(list(ids order by i)) as found from f group by doc_id),
 t as (select doc_id, coalesce(found, []) as found, array_to_string(list_transform(coalesce(found, []), lambda x: '<' || x || '>'), '') as rest from documents left join g using (doc_id)),
 {", ".join(steps)}
select doc_id, cast(len(found) as bigint) as n_sentences, array_to_string(found, ',') as sentence_ids,
       array_to_string(list_sort(list_distinct(list_filter([{names}], lambda x: x is not null))), ',') as licenses,
       cast(case {first} else -1 end as bigint) as first_rule
from {last}
"""
