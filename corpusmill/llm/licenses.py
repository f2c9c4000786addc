"""License scans: a positional index of rare template words.

The words of license templates that are not function words form a fixed
vocabulary, with postings: template and place in it.  In each file that holds a
template's mandatory phrases, the file's words of the highest inverse document
frequency over the whole corpus that the template has too are its anchors; each
votes, through the postings, for the place at which the template would begin.
Enough votes for the place where the mandatory phrases stand make a label.

Frequencies are counted over all documents; the table has at most one row for
each vocabulary word, a fixed number.  Votes are grouped by document, template
and place, so no document's hits are held together.  Texts are not shuffled.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.text import free_name, lower_ascii, settle
from corpusmill.storage import cut

#: What separates words, once A-Z are a-z: the other ASCII characters.
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: The contract's phrases and labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Label, mandatory phrases, and the notice or license (from the licenses' own texts).
TEMPLATES = (
    ("gpl-3.0", ("gnu general public license",), "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-notice", ("gnu general public license", "free software foundation"),
     "is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("gpl-warranty", ("without even the implied warranty of", "gnu general public license"),
     "is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. "
     "See the GNU General Public License for more details."),
    ("lgpl", ("gnu lesser general public license",), "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("agpl", ("gnu affero general public license",), "under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("apache-2.0", ("apache license",), "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0-header", ("apache license", "you may not use this file except in compliance", "without warranties or conditions of any kind"),
     "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
     "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
     "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("mit", ("mit license",), "Released under the MIT License"),
    ("mit-grant", ("permission is hereby granted free of charge",),
     "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mit-text", ("permission is hereby granted free of charge", "the above copyright notice and this permission notice", "the software is provided as is"),
     "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without "
     "restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
     "Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the "
     "Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR "
     "PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, "
     "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("isc", ("permission to use copy modify and or distribute this software", "the software is provided as is"),
     "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission "
     "notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY "
     "AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
     "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("bsd", ("redistribution and use in source and binary forms",),
     "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd-2-clause", ("redistribution and use in source and binary forms", "redistributions in binary form must reproduce", "this software is provided by the copyright holders"),
     "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must "
     "retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of "
     "conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "
     "\"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."),
    ("bsd-3-clause", ("redistribution and use in source and binary forms", "neither the name of the copyright holder", "this software is provided by the copyright holders"),
     "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must "
     "retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of "
     "conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its "
     "contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND "
     "CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."),
    ("zlib", ("this software is provided as is without any express or implied warranty", "must not be misrepresented"),
     "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
     "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following "
     "restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software."),
    ("unlicense", ("released into the public domain",),
     "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code "
     "form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("boost-1.0", ("boost software license",), "Distributed under the Boost Software License, Version 1.0"),
    ("mpl-2.0", ("mozilla public license",), "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc0-1.0", ("cc0 1 0 universal",), "CC0 1.0 Universal public domain dedication"),
    ("cc-by-nc-4.0", ("cc by nc",), "licensed under CC BY-NC 4.0"),
    ("cc-by-sa-4.0", ("cc by sa",), "licensed under CC BY-SA 4.0"),
    ("cc-by-4.0", ("cc by 4 0",), "licensed under CC BY 4.0"),
    ("cc-by-long", ("creative commons attribution",), "This work is licensed under a Creative Commons Attribution 4.0 International License"),
)
#: Words too frequent to anchor anything.
COMMON = frozenset("a all an and any are as at be but by can do for from if in is it may no not of on or out other that the this to under use with you without v 0 1 2 3 4 sa nc".split())

#: Anchors of a template in a file at most; the share of them that must agree on a place; words by which later phrases may be shifted.
ANCHORS, LEAST_SHARE, SLACK = 8, 0.6, 8


def norm(text: str) -> list[str]:
    """A template's words by the same rule as a file's."""
    return [w for w in re.split(BREAK, text.translate({c: c + 32 for c in range(65, 91)})) if w]


def template_words(templates=TEMPLATES, phrases=PHRASES) -> list[str]:
    """The vocabulary: words of templates and phrases that can anchor them."""
    texts = [*phrases, *(p for _, must, _ in templates for p in must), *(t for *_, t in templates)]
    return sorted({w for t in texts for w in norm(t) if w not in COMMON})


def find_words(text: Column) -> Column:
    """The words of a text; null has none."""
    return F.filter(F.split(lower_ascii(F.coalesce(text, F.lit(""))), BREAK), lambda w: w != "")


def _places(phrase: str, words: Column, hits: Column) -> Column:
    """Where a phrase's words stand consecutively, by its first vocabulary word."""
    parts = phrase.split()
    lead = next(i for i, w in enumerate(parts) if w not in COMMON)

    def here(h: Column) -> Column:
        ok = (h["w"] == parts[lead]) & (h["p"] >= lead)
        for i, w in enumerate(parts):
            if i != lead:
                ok = ok & F.coalesce(F.get(words, h["p"] + (i - lead)) == w, F.lit(False))
        return ok

    return F.transform(F.filter(hits, here), lambda h: h["p"] - lead)


def license_scan(df: DataFrame, key: str = "doc_id", text: str = "text", templates=TEMPLATES, phrases=PHRASES, anchors: int = ANCHORS, least_share: float = LEAST_SHARE) -> DataFrame:
    """One row for each row of ``df``: ``key`` and what was found.

    ``n_words``; ``places`` (map from each phrase's label to its places);
    ``matches``: array of (label, place, share), the templates found by their
    anchors and verified by their mandatory phrases, ``share`` being the part of
    ``anchors`` (or of the template's words, if these are fewer) that voted for
    the place.

    Defined results: null text counts as empty, and has no words; very long
    texts are scanned whole; rows that repeat are scanned one by one, and rows
    of one label at several places give it as often; a key may be null or
    repeat; other columns are not read; an empty table gives an empty one.
    """
    vocabulary = template_words(templates, phrases)
    needed = list(dict.fromkeys([*phrases, *(p for _, must, _ in templates for p in must)]))
    leads = sorted({next(x for x in p.split() if x not in COMMON) for p in needed})
    w, hits, found = (free_name([key], x) for x in ("_words", "_hits", "_found"))
    rows = df.select(F.col(f"`{key}`").alias(key), find_words(F.col(f"`{text}`")).alias(w))
    # The places only of files with a word of that kind; the test is a pass without copies.
    placed = lambda words: F.when(F.exists(w, lambda x: x.isin(words)), F.filter(F.transform(w, lambda x, i: F.struct(x.alias("w"), i.alias("p"))), lambda h: h["w"].isin(words)))
    some = lambda c: F.coalesce(c, F.expr("CAST(array() AS array<struct<w:string,p:int>>)"))
    rows = settle(rows, {hits: some(placed(leads)), w: F.col(w)})
    rows = settle(rows, {found: F.array(*[_places(p, F.col(w), F.col(hits)) for p in needed]), w: F.col(w)}).drop(hits)
    complete = [F.forall(F.array(*[F.size(F.get(found, needed.index(p))) > 0 for p in must]), lambda x: x) for must in dict.fromkeys(must for _, must, _ in templates)]
    marked = F.exists(F.array(*complete), lambda x: x)
    rows = cut(settle(rows, {
        "n_words": F.size(w).cast("long"), "found": F.col(found), "has": F.array_distinct(F.filter(w, lambda x: x.isin(vocabulary))),
        "hits": some(F.when(marked, placed(vocabulary)))}).drop(w, found).withColumn("row", F.monotonically_increasing_id()), "licenses")

    total = rows.count()
    frequency = {r["w"]: r["n"] for r in rows.select(F.explode("has").alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()}
    idf = {x: math.log((total + 1) / (frequency.get(x, 0) + 1)) + 1 for x in vocabulary}
    rank = {x: i for i, x in enumerate(sorted(vocabulary, key=lambda x: (-idf[x], x)))}
    words = [norm(t) for *_, t in templates]
    ranked = [sorted({x for x in t if x in rank}, key=rank.get) for t in words]
    postings = {(t, x): [q for q, y in enumerate(words[t]) if y == x] for t, r in enumerate(ranked) for x in r}

    strings = lambda xs: F.array(*[F.lit(x) for x in xs])
    seen = rows.where("size(hits) > 0")
    # The file's own rarest words among those of each template whose phrases it holds.
    def anchored(t: int) -> Column:
        chosen = F.slice(F.array_intersect(strings(ranked[t]), F.col("has")), 1, anchors)
        mine = F.filter("hits", lambda h: F.array_contains(chosen, h["w"]))
        held = F.forall(F.array(*[F.size(F.get("found", needed.index(p))) > 0 for p in templates[t][1]]), lambda x: x)
        return F.when(held, F.transform(mine, lambda h: F.struct(F.lit(t).alias("t"), h["w"].alias("w"), h["p"].alias("p")))).otherwise(F.expr("CAST(array() AS array<struct<t:int,w:string,p:int>>)"))

    by_word = F.create_map(*[c for (t, x), at in postings.items() for c in (F.lit(f"{t}:{x}"), F.array(*[F.lit(q) for q in at]))])
    votes = seen.select("row", F.explode(F.flatten(F.array(*[anchored(t) for t in range(len(templates))]))).alias("v")).select("row", "v.*")
    votes = votes.select("row", "t", "w", "p", F.explode(F.element_at(by_word, F.concat(F.col("t").cast("string"), F.lit(":"), F.col("w")))).alias("q"))
    votes = votes.select("row", "t", (F.col("p") - F.col("q")).alias("place"), "w", F.lit(0).alias("must"))

    def verified(t: int) -> Column:
        at = [(needed.index(p), next(j for j in range(len(words[t])) if words[t][j : j + len(p.split())] == p.split())) for p in templates[t][1]]
        first, begin = at[0]
        near = lambda i, q, place: F.exists(F.get("found", i), lambda y: F.abs(y - q - place) <= SLACK)
        ok = lambda place: F.forall(F.array(F.lit(True), *[near(i, q, place) for i, q in at[1:]]), lambda x: x)
        return F.transform(F.filter(F.get("found", first), lambda x: ok(x - begin)), lambda x: F.struct(F.lit(t).alias("t"), (x - begin).alias("place")))

    marks = seen.select("row", F.explode(F.flatten(F.array(*[verified(t) for t in range(len(templates))]))).alias("m"))
    marks = marks.select("row", "m.t", "m.place", F.lit(None).cast("string").alias("w"), F.lit(1).alias("must"))
    size = F.element_at(F.create_map(*[c for t, r in enumerate(ranked) for c in (F.lit(t), F.lit(min(anchors, len(r))))]), F.col("t"))
    label = F.get(strings([x for x, *_ in templates]), F.col("t"))
    good = votes.union(marks).groupBy("row", "t", "place").agg(F.count_distinct("w").alias("votes"), F.max("must").alias("must")).where("must = 1")
    good = good.select("row", F.struct(label.alias("label"), "place", (F.col("votes") / size).alias("share")).alias("x")).where(F.col("x.share") >= least_share)
    good = good.groupBy("row").agg(F.sort_array(F.collect_list("x")).alias("matches"))
    out = rows.select("row", key, "n_words", "found").join(good, "row", "left")
    places = F.map_from_arrays(strings(phrases.values()), F.slice("found", 1, len(phrases)))
    none = F.expr("CAST(array() AS array<struct<label:string,place:int,share:double>>)")
    return out.select(key, "n_words", places.alias("places"), F.coalesce("matches", none).alias("matches"))


def op9_license_scan(spark, sf_dir: str) -> DataFrame:
    """The contract's digest over all documents."""
    found = license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    every = F.flatten(F.map_values("places"))
    base = F.map_keys(F.map_filter("places", lambda k, v: F.size(v) > 0))
    shares = F.transform("matches", lambda m: m["share"])
    found = found.withColumns({"_every": every, "_base": base})
    return found.select(
        "doc_id", "n_words", F.size("_every").cast("long").alias("n_base"), F.array_min("_every").cast("long").alias("first_word"), F.array_max("_every").cast("long").alias("last_word"),
        F.array_join(F.sort_array("_base"), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.array_distinct(F.concat("_base", F.transform("matches", lambda m: m["label"])))), ",").alias("labels"),
        F.greatest(F.coalesce(F.array_max(shares), F.lit(0.0)), F.when(F.size("_every") > 0, 0.5).otherwise(0.0)).alias("score"))
