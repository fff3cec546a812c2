"""Licences in texts by their sentences.

A text is cut into sentences, each sentence is normalised (case, marks, decoration, white space)
and looked up among known licence sentences, which gives an identifier.  The identifiers in order
of appearance are matched against rules, each an ordered sequence of identifiers; longer rules go
first and use up what they match.  A sentence that speaks of licensing but is unknown is counted.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Known licence sentences (fixed values, from the public texts).  ``{v}`` is a version number
#: and becomes part of the identifier.
SENTENCES = {
    "released under the mit license": "mit-ref",
    "licensed under the mit license": "mit-ref",
    "this project is licensed under the mit license": "mit-ref",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
    "documentation files the software to deal in the software without restriction including without limitation the "
    "rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit "
    "persons to whom the software is furnished to do so subject to the following conditions": "mit-grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions "
    "of the software": "mit-notice",
    "licensed under the apache license version {v}": "apache-ref",
    "licensed under the apache license version {v} the license": "apache-ref",
    "you may not use this file except in compliance with the license": "apache-comply",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed "
    "on an as is basis without warranties or conditions of any kind either express or implied": "apache-warranty",
    "this work is licensed under the gnu general public license version {v}": "gpl-ref",
    "licensed under the gnu general public license version {v}": "gpl-ref",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public "
    "license as published by the free software foundation either version {v} of the license or at your option any "
    "later version": "gpl-later",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general "
    "public license as published by the free software foundation either version {v} of the license or at your option "
    "any later version": "lgpl-later",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied "
    "warranty of merchantability or fitness for a particular purpose": "gpl-warranty",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the "
    "following conditions are met": "bsd-grant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following "
    "disclaimer": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the "
    "following disclaimer in the documentation and or other materials provided with the distribution": "bsd-binary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
    "products derived from this software without specific prior written permission": "bsd-endorse",
    "this source code form is subject to the terms of the mozilla public license v {v}": "mpl-ref",
    "licensed under cc by {v}": "cc-by-ref",
    "licensed under cc by sa {v}": "cc-by-sa-ref",
    "licensed under cc by nc {v}": "cc-by-nc-ref",
    "licensed under cc by nd {v}": "cc-by-nd-ref",
    "this is free and unencumbered software released into the public domain": "unlicense-ref",
}
#: Licence -> ordered identifiers; ``{v}`` takes the version of the first of them.
RULES = {
    "BSD-3-Clause": ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"],
    "BSD-2-Clause": ["bsd-grant", "bsd-source", "bsd-binary"],
    "Apache-{v} ": ["apache-ref", "apache-comply", "apache-warranty"],
    "MIT ": ["mit-grant", "mit-notice"],
    "GPL-{v}-or-later": ["gpl-later", "gpl-warranty"],
    "Apache-{v}": ["apache-ref"],
    "MIT": ["mit-ref"],
    "GPL-{v}": ["gpl-ref"],
    "GPL-{v}-or-later ": ["gpl-later"],
    "LGPL-{v}-or-later": ["lgpl-later"],
    "MPL-{v}": ["mpl-ref"],
    "CC-BY-{v}": ["cc-by-ref"],
    "CC-BY-SA-{v}": ["cc-by-sa-ref"],
    "CC-BY-NC-{v}": ["cc-by-nc-ref"],
    "CC-BY-ND-{v}": ["cc-by-nd-ref"],
    "Unlicense": ["unlicense-ref"],
}
#: Words by which a sentence speaks of licensing.
CUE = r"(?i)licen[cs]|redistribut|permission|warrant|public domain|unencumbered"
DECORATION = r"[^\p{L}\p{N}.\n]+"
VERSION = r"[0-9]+(?:\.[0-9]+)*"


def normalised(sentence):
    """Lower case, decoration and full stops that are not inside a number removed, one blank."""
    s = F.regexp_replace(F.lower(sentence), r"\.(?![0-9])|(?<![0-9])\.", " ")
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def sentences(text):
    """Sentences of a text, in order, that speak of licensing: each as an array of the sentence,
    its lines joined, of the lines by themselves, and of what follows from each line on, since a
    line without a full stop runs on into the next."""
    plain = F.regexp_replace(text, DECORATION, " ")
    ends = F.split(plain, r"\.+(?=\s|$)")
    ends = F.filter(ends, lambda s: s.rlike(CUE))

    def parts(s):
        lines = F.split(s, "\n")
        rest = F.transform(lines, lambda x, i: F.when(x.rlike(CUE), F.array_join(F.slice(lines, i + 1, F.size(lines)), "\n")))
        return F.filter(F.concat(F.array(s), lines, rest), lambda x: x.rlike(CUE))

    return F.transform(ends, lambda s: F.array_distinct(F.transform(parts(s), normalised)))


def scan(docs: DataFrame, known: dict[str, str] = SENTENCES, rules: dict[str, list[str]] = RULES,
         text_col: str = "text") -> DataFrame:
    """``docs`` with ``sentence_ids`` (known licence sentences in order, ``id:version``),
    ``licenses`` (array, in rule order,
    the versions of a rule in order of appearance) and ``n_unknown`` (sentences about licensing of which
    neither the whole nor a line is known).

    Known sentences and rules are parameters of the plan, not data.  Null and empty texts have no
    licence; rows are independent, nothing is shuffled; result columns replace equal names."""
    plain = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    out = docs.withColumn("__said", F.when(text.rlike(CUE), sentences(text)).otherwise(F.array().cast("array<array<string>>")))
    form = lambda s: F.regexp_replace(s, VERSION, "{v}")

    def identify(s):
        exact, shaped = F.try_element_at(plain, s), F.try_element_at(plain, form(s))
        return F.coalesce(exact, F.concat(shaped, F.lit(":"), F.regexp_extract(s, VERSION, 0)))

    out = out.withColumn("__found", F.transform("__said", lambda parts: F.filter(
        F.transform(parts, identify), lambda x: x.isNotNull())))
    out = out.withColumn("sentence_ids", F.flatten("__found"))
    left, licenses = F.concat(F.lit(" "), F.array_join("sentence_ids", "  "), F.lit(" ")), []
    for number, (name, ids) in enumerate(rules.items()):
        sequence = r"\s+".join(re.escape(i) + rf"(:{VERSION})?" if j == 0 else re.escape(i) + rf"(?::{VERSION})?"
                               for j, i in enumerate(ids))
        pattern = rf" {sequence} "
        step = f"__left{number}"
        out = out.withColumn(step, left)
        title = lambda hit: F.concat(*[F.lit(p) if p != "{v}" else F.substring(hit, 2, 99)
                                       for p in re.split(r"(\{v\})", name.strip()) if p])
        licenses.append(F.transform(F.regexp_extract_all(F.col(step), F.lit(pattern), F.lit(1)), title))
        left = F.regexp_replace(F.col(step), pattern, " ")
    out = out.withColumn("licenses", F.array_distinct(F.concat(*licenses)))
    unknown = F.size(F.filter("__found", lambda x: F.size(x) == 0))
    return out.withColumn("n_unknown", unknown.cast("bigint")).drop("__said", "__found", *[f"__left{n}" for n in range(len(rules))])
