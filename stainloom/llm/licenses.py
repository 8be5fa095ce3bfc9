"""License scans by sentence rules.

A text is cut into sentences twice: with wrapped lines joined up to the end of their paragraph, and
with each line for itself. Sentences are normalised and looked up among known sentences of licences.
What is left is a short sequence of whole-number identifiers, and ordered rules say which sequences
make which licence: of the rules that fit at the earliest place the longest takes its span, and the
search goes on behind it. Built-in functions only, within one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stainloom.llm.common import text_of

#: Known sentences by name, normalised: lower case, words of letters and digits joined by one space.
#: Sentences of the public texts of the licences and of customary notices.
SENTENCES = {
    "mit notice": ["released under the mit license", "licensed under the mit license", "this project is licensed under the mit license", "distributed under the mit license"],
    "mit title": ["the mit license", "mit license", "the mit license mit"],
    "mit grant": ["permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"],
    "mit condition": ["the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "the above copyright notice and this permission notice including the next paragraph shall be included in all copies or substantial portions of the software"],
    "mit as is": ["the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement", "the software is provided as is without warranty of any kind express or implied"],
    "mit no liability": ["in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"],
    "bsd permitted": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "bsd source": ["redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"],
    "bsd binary": ["redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"],
    "bsd no endorsement": [
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
        "neither the name of the university nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
        "the name of the author may not be used to endorse or promote products derived from this software without specific prior written permission",
    ],
    "bsd advertising": ["all advertising materials mentioning features or use of this software must display the following acknowledgement"],
    "bsd as is": [
        "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
        "this software is provided by the regents and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
        "this software is provided by the author as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    ],
    "isc grant": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"],
    "isc as is": ["the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness"],
    "zlib as is": ["this software is provided as is without any express or implied warranty"],
    "zlib grant": ["permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"],
    "unlicense": ["this is free and unencumbered software released into the public domain"],
    "apache notice": ["licensed under the apache license version 2 0", "released under the apache license version 2 0", "this project is licensed under the apache license version 2 0"],
    "apache header": ["licensed under the apache license version 2 0 the license"],
    "apache compliance": ["you may not use this file except in compliance with the license"],
    "apache copy": ["you may obtain a copy of the license at", "you may obtain a copy of the license at http www apache org licenses license 2 0", "you may obtain a copy of the license at https www apache org licenses license 2 0"],
    "apache title": ["apache license version 2 0 january 2004 http www apache org licenses", "apache license version 2 0 january 2004", "apache license"],
    "apache terms": ["terms and conditions for use reproduction and distribution"],
    "apache contributions": ["submission of contributions"],
    "mpl notice": ["this source code form is subject to the terms of the mozilla public license v 2 0"],
    "gpl 3 notice": ["this work is licensed under the gnu general public license version 3", "released under the gnu general public license version 3", "licensed under the gnu general public license version 3"],
    "gpl 2 notice": ["this work is licensed under the gnu general public license version 2", "released under the gnu general public license version 2", "licensed under the gnu general public license version 2"],
    "gpl 3 redistribute": [
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
        "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    ],
    "gpl free software": ["this program is free software", "this file is free software", "this library is free software"],
    "gpl redistribute": ["you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"],
    "gpl version 2": ["either version 2 of the license or at your option any later version"],
    "gpl version 3": ["either version 3 of the license or at your option any later version"],
    "gpl 2 redistribute": ["this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"],
    "lgpl redistribute": ["you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"],
    "lgpl version": ["either version 2 1 of the license or at your option any later version"],
    "agpl redistribute": ["this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version"],
    "gpl hope": ["this program is distributed in the hope that it will be useful but without any warranty", "this library is distributed in the hope that it will be useful but without any warranty"],
    "gpl received": [
        "you should have received a copy of the gnu general public license along with this program", "if not see https www gnu org licenses", "if not see http www gnu org licenses",
        "if not write to the free software foundation inc 51 franklin street fifth floor boston ma 02110 1301 usa",
    ],
    "gpl 3 title": ["gnu general public license version 3 29 june 2007"],
    "gpl 2 title": ["gnu general public license version 2 june 1991"],
    "gpl verbatim": [
        "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed",
        "https fsf org everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed",
        "http fsf org everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed",
        "copyright c 1989 1991 free software foundation inc 51 franklin street fifth floor boston ma 02110 1301 usa everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed",
    ],
    "cc by nc": ["licensed under cc by nc 4 0", "this work is licensed under cc by nc 4 0", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"],
    "cc by": ["licensed under cc by 4 0", "this work is licensed under cc by 4 0", "this work is licensed under a creative commons attribution 4 0 international license"],
    "cc by sa": ["licensed under cc by sa 4 0", "this work is licensed under cc by sa 4 0", "this work is licensed under a creative commons attribution sharealike 4 0 international license"],
    "public domain": ["this work is dedicated to the public domain", "this work is in the public domain"],
    "reserved": ["all rights reserved"],
}
#: Parts of words, of which every known sentence has one; a text without any needs no cutting.
ANCHORS = ["licens", "permi", "warrant", "copyright", "redistribut", "domain", "reserved", "software", "submission", "advertising", "reproduction"]
#: Other known sentences that may stand between two of a rule; any number of unknown ones may.
GAP = 2
#: Licence, kind, and the names of the sentences that make it, in order. Of rules with as many
#: sentences the earlier one wins.
RULES = [
    ("BSD-4-Clause", "permissive", ["bsd permitted", "bsd source", "bsd binary", "bsd advertising", "bsd no endorsement", "bsd as is"]),
    ("BSD-3-Clause", "permissive", ["bsd permitted", "bsd source", "bsd binary", "bsd no endorsement", "bsd as is"]),
    ("BSD-2-Clause", "permissive", ["bsd permitted", "bsd source", "bsd binary", "bsd as is"]),
    ("GPL-2.0", "copyleft", ["gpl free software", "gpl redistribute", "gpl version 2"]),
    ("GPL-3.0", "copyleft", ["gpl free software", "gpl redistribute", "gpl version 3"]),
    ("LGPL-2.1", "copyleft", ["gpl free software", "lgpl redistribute", "lgpl version"]),
    ("MIT", "permissive", ["mit grant", "mit condition", "mit as is"]),
    ("Apache-2.0", "permissive", ["apache header", "apache compliance", "apache copy"]),
    ("Apache-2.0", "permissive", ["apache title", "apache terms", "apache contributions"]),
    ("ISC", "permissive", ["isc grant", "isc as is"]),
    ("Zlib", "permissive", ["zlib as is", "zlib grant"]),
    ("GPL-3.0", "copyleft", ["gpl 3 redistribute", "gpl hope"]),
    ("GPL-2.0", "copyleft", ["gpl 2 redistribute", "gpl hope"]),
    ("AGPL-3.0", "copyleft", ["agpl redistribute", "gpl hope"]),
    ("GPL-3.0", "copyleft", ["gpl 3 title", "gpl verbatim"]),
    ("GPL-2.0", "copyleft", ["gpl 2 title", "gpl verbatim"]),
    *[
        (name, kind, [sentence])
        for name, kind, sentence in [
            ("MIT", "permissive", "mit notice"), ("Apache-2.0", "permissive", "apache notice"), ("Apache-2.0", "permissive", "apache header"), ("MPL-2.0", "copyleft", "mpl notice"),
            ("GPL-3.0", "copyleft", "gpl 3 notice"), ("GPL-2.0", "copyleft", "gpl 2 notice"), ("CC-BY-NC-4.0", "restricted", "cc by nc"), ("CC-BY-4.0", "permissive", "cc by"),
            ("CC-BY-SA-4.0", "copyleft", "cc by sa"), ("Unlicense", "permissive", "unlicense"), ("Public-Domain", "permissive", "public domain"), ("All-Rights-Reserved", "restricted", "reserved"),
        ]
    ],
]
KINDS = ["restricted", "copyleft", "permissive"]
#: The end of a line that is no wrapped one: a line without letters and digits follows, or a colon stands before.
PARAGRAPH = "\\n(?=[^\\p{L}\\p{N}\\n]*(?:\\n|$))|(?<=:)\\n|(?<=: )\\n"
#: One character of white space that ends a sentence.
CUT = "(?<=[.!?;])\\s"


def normal(sentence: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(sentence), "[^\\p{L}\\p{N}]+", " "))


def _hits(parts: Column, known: Column) -> Column:
    """Known sentences of the parts of a text, which lie one character apart: (place, id)."""
    start = {"n": F.lit(0), "h": F.array().cast("array<struct<place:int,id:int>>")}
    step = lambda s, x: F.struct(
        (s["n"] + F.length(x["s"]) + 1).alias("n"), F.when(x["k"].isNotNull(), F.concat(s["h"], F.array(F.struct((s["n"] + x["b"]).cast("int").alias("place"), x["k"].alias("id"))))).otherwise(s["h"]).alias("h")
    )
    blank = lambda x: F.length(x) - F.length(F.regexp_replace(x, "^[^\\p{L}\\p{N}]+", ""))
    looked = F.transform(parts, lambda x: F.struct(x.alias("s"), F.try_element_at(known, normal(x)).alias("k"), blank(x).alias("b")))
    return F.aggregate(looked, F.struct(*[v.alias(k) for k, v in start.items()]), step, lambda s: s["h"])


def license_scan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sentences: dict[str, list[str]] | None = None, rules: list[tuple[str, str, list[str]]] | None = None, anchors: list[str] | None = None
) -> DataFrame:
    """Licences of every whole text; one row for each row of docs.

    Returns doc_id, sentence_ids (identifiers in order of the text: the place of the sentence's
    name among the known ones, from 1), sentence_places (the characters at which those sentences
    begin, from 0), licenses (names in order of the text, each rule's span once, joined by ``,``;
    empty for none), kind (the strictest: restricted, copyleft, permissive, or none). Null and
    empty texts have none, repeated rows are judged each for itself, other columns are ignored,
    and an empty table gives no rows. Other tables of sentences and rules can be given; ``anchors``
    are parts of words that let a text be skipped, so every sentence has to have one of them.
    """
    sentences, rules, anchors = sentences or SENTENCES, rules or RULES, anchors or ANCHORS
    ids = {name: i for i, name in enumerate(sentences, 1)}
    rules = sorted(rules, key=lambda r: -len(r[2]))
    spans = [f"(?:(?<![0-9]){f'(?:[0-9]+,){{0,{GAP}}}?'.join(f'{ids[x]},' for x in of)})" for _, _, of in rules]
    d = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("_t")).withColumn("_low", F.lower("_t"))
    may = F.col("_low").contains(anchors[0])
    for x in anchors[1:]:
        may = may | F.col("_low").contains(x)
    known = F.create_map(*[F.lit(x) for name, texts in sentences.items() for t in texts for x in (t, ids[name])])
    none = F.array().cast("array<struct<place:int,id:int>>")
    # A mark stands for the end of a paragraph, so that both ways of cutting have the same places.
    joined = F.split(F.translate(F.regexp_replace("_t", PARAGRAPH, "\x00"), "\n", " "), f"\\x00|{CUT}", -1)
    lines = F.split("_t", f"\\n|{CUT}", -1)
    d = d.select("doc_id", F.when(may, F.array_sort(F.array_union(_hits(joined, known), _hits(lines, known)))).otherwise(none).alias("_h"))
    d = d.select("doc_id", F.col("_h.place").alias("sentence_places"), F.col("_h.id").alias("_ids"))
    d = d.withColumn("_s", F.concat_ws("", F.transform("_ids", lambda x: F.concat(x.cast("string"), F.lit(",")))))
    d = d.withColumn("_m", F.when(F.col("_s") == "", F.array().cast("array<string>")).otherwise(F.regexp_extract_all("_s", F.lit("|".join(spans)), F.lit(0))))

    def which(span: Column, said: int) -> Column:
        out = F.when(span.rlike(f"^{spans[0]}$"), rules[0][said])
        for pattern, rule in zip(spans[1:], rules[1:], strict=True):
            out = out.when(span.rlike(f"^{pattern}$"), rule[said])
        return out

    d = d.withColumns({"_names": F.array_distinct(F.transform("_m", lambda x: which(x, 0))), "_kinds": F.transform("_m", lambda x: which(x, 1))})
    kind = F.lit("none")
    for k in reversed(KINDS):
        kind = F.when(F.array_contains("_kinds", k), k).otherwise(kind)
    return d.select("doc_id", F.concat_ws(",", F.transform("_ids", lambda x: x.cast("string"))).alias("sentence_ids"), "sentence_places", F.concat_ws(",", "_names").alias("licenses"), kind.alias("kind"))
