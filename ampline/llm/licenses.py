"""License scan by a positional index of rare licence words.

One pass over the texts counts in how many of them each word of the templates occurs. By these inverse document
frequencies every template's rarest words, and the rarest of its mandatory phrase, are posted with their places. A
second pass looks up each file's words among the postings; a word at place i that a template has at place p votes for
that template at i - p. Where at least two votes meet, the mandatory phrase is verified word by word, and the template
counts if enough of its whole weight stands in line there.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ampline.llm.common import words

# Base phrases with their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

# Passages of well-known licences as lower-cased words, mandatory phrases in brackets. A licence of several
# paragraphs has a passage for each, named label/paragraph; any of them gives its label.
TEMPLATES = {
    "mit/grant": "[permission is hereby granted free of charge] to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit/notice": "the above copyright notice and this permission notice shall be [included in all copies or substantial portions of the software]",
    "mit/warranty": "[the software is provided as is without warranty of any kind express or implied] including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "mit/name": "released under the [mit license]",
    "isc/grant": "[permission to use copy modify and or distribute this software] for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "isc/warranty": "[the software is provided as is and the author disclaims all warranties] with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
    "bsd/grant": "[redistribution and use in source and binary forms] with or without modification are permitted provided that the following conditions are met",
    "bsd/source": "[redistributions of source code must retain the above copyright notice] this list of conditions and the following disclaimer",
    "bsd/binary": "[redistributions in binary form must reproduce the above copyright notice] this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd/names": "neither the name of the copyright holder nor the names of its contributors may be [used to endorse or promote products derived from this software] without specific prior written permission",
    "zlib/grant": "permission is granted to anyone to use this software for any purpose including commercial applications and to [alter it and redistribute it freely] subject to the following restrictions",
    "apache/header": "[licensed under the apache license] version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0",
    "apache/warranty": "unless required by applicable law or agreed to in writing software [distributed under the license is distributed on an as is basis] without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
    "apache/name": "[apache license version] 2 0",
    "gpl/terms": "this program is free software you can [redistribute it and or modify it under the terms of the gnu general public license] as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl/copy": "you should have [received a copy of the gnu general public license] along with this program if not see http www gnu org licenses",
    "gpl/name": "[gnu general public license version] 3",
    "lgpl/terms": "this library is free software you can [redistribute it and or modify it under the terms of the gnu lesser general public license] as published by the free software foundation either version 2 1 of the license or at your option any later version",
    "agpl/terms": "you can [redistribute it and or modify it under the terms of the gnu affero general public license] as published by the free software foundation either version 3 of the license or at your option any later version",
    "mpl/header": "this source code form is [subject to the terms of the mozilla public license] v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0",
    "epl/header": "this program and the accompanying materials are [made available under the terms of the eclipse public license] 2 0 which is available at https www eclipse org legal epl 2 0",
    "cc-by/name": "this work is [licensed under a creative commons attribution] 4 0 international license",
    "cc-by-nc/name": "[licensed under cc by nc] 4 0",
    "cc0/name": "[cc0 1 0 universal] public domain dedication",
    "unlicense/grant": "this is [free and unencumbered software released into the public domain] anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
}
#: Share of a template's weight that must stand in line; postings of a template: of its rarest words, and of its phrase's.
COVERAGE, RAREST, PHRASE = 0.6, 8, 2
#: Places by which a template may begin before a file does; votes pack the template above it.
REACH = 1 << 10


def parsed() -> list[tuple[str, list[str], list[int]]]:
    """Label, words and the places of mandatory words of each template."""
    out = []
    for name, text in TEMPLATES.items():
        before, inside, after = text.replace("]", "[").split("[")
        a, b, c = before.split(), inside.split(), after.split()
        out.append((name.split("/")[0], a + b + c, list(range(len(a), len(a) + len(b)))))
    return out


def document_frequencies(df: DataFrame, text_col: str = "text") -> tuple[int, dict[str, int]]:
    """Texts of the whole table, and how many hold each of the templates' words (as many rows as there are such words)."""
    vocabulary = sorted({w for _, t, _ in parsed() for w in t})
    own = df.select(words(F.col(text_col)).alias("__w")).select(F.array_append(F.array_distinct(F.filter("__w", lambda w: w.isin(*vocabulary))), F.lit("")).alias("__w"))
    n = {r["w"]: r["n"] for r in own.select(F.explode("__w").alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()}
    return n.pop("", 0), n


def postings(total: int, freq: dict[str, int]) -> tuple[dict[str, list[tuple[int, int]]], list[list[float]]]:
    """Places (template, place) of each posted word, and the shares of weight of each template's words."""
    weight = lambda w: math.log((total + 1) / (freq.get(w, 0) + 0.5)) + 1e-3
    posts: dict[str, list[tuple[int, int]]] = {}
    shares = []
    for n, (_, t, must) in enumerate(parsed()):
        known = [weight(w) for w in t]
        shares.append([x / sum(known) for x in known])
        rank = sorted((p for p in range(len(t)) if freq.get(t[p])), key=lambda p: (-known[p], p))
        phrase = sorted(must, key=lambda p: (-known[p], p))
        for p in sorted({*rank[:RAREST], *phrase[:PHRASE]}):
            posts.setdefault(t[p], []).append((n, p))
    return posts, shares


def _literal(values: list, kind: str) -> Column:
    return F.expr(f"array({', '.join(map(str, values))})").cast(f"array<{kind}>")


def scan_licenses(df: DataFrame, keep: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """keep (default: all), n_words, n_base, first_word, last_word, base_labels, labels, score.

    n_base: places of base phrases, with their least and greatest first word. labels: the base ones and those of
    templates that the index finds and the phrase confirms. score: the best such template's share of weight in line, at
    least 0.5 with a base phrase; 0 without any. Null and empty texts have none. Columns of df named like a result are
    replaced; repeated rows stay. Nothing is shuffled but the words' counts; a file's lookups sort its votes.
    """
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    keep = [c for c in (keep or df.columns) if c not in names]
    posts, shares = postings(*document_frequencies(df, text_col))
    known = parsed()
    inside = ", ".join(f"'{w}'" for w in sorted({*posts, *(p.split()[0] for p in BASE)}))
    w = df.select(*[F.col(c).alias(f"__k_{c}") for c in keep], words(F.col(text_col)).alias("__w"))
    w = w.withColumn("__at", F.expr(f"if(size(__w) > 0, filter(sequence(0, size(__w) - 1), i -> get(__w, i) in ({inside})), cast(array() as array<int>))"))
    base = []
    for phrase, label in BASE.items():
        test = " and ".join(f"get(__w, i + {j}) <=> '{p}'" for j, p in enumerate(phrase.split()))
        base.append(f"transform(filter(__at, i -> {test}), i -> named_struct('label', '{label}', 'i', i))")
    w = w.withColumn("__base", F.expr(f"concat({', '.join(base)})"))
    # votes for (template, where it would begin), packed into one number and sorted; equal neighbours meet
    width = 1 << 40
    index = F.create_map(*[x for word, at in posts.items() for x in (F.lit(word), _literal([n * width - p + REACH for n, p in at], "bigint"))]) if posts else F.expr("cast(map() as map<string, array<bigint>>)")
    looked = F.transform("__at", lambda i: F.transform(F.coalesce(F.element_at(index, F.get("__w", i)), F.array().cast("array<bigint>")), lambda v: v + i))
    w = w.withColumn("__votes", F.sort_array(F.flatten(looked)))
    met = F.array_distinct(F.filter("__votes", lambda v, i: v == F.get("__votes", i - 1)))
    w = w.withColumn("__met", F.when(F.size("__votes") > 1, F.transform(met, lambda v: F.struct(F.floor(v / F.lit(width)).cast("int").alias("t"), (v % F.lit(width) - REACH).cast("int").alias("d")))))
    lists = F.array(*[F.array(*map(F.lit, t)) for _, t, _ in known])
    musts = F.array(*[_literal(m, "int") for _, _, m in known])
    weights = F.array(*[_literal(s, "double") for s in shares])

    def confirmed(x: Column) -> Column:
        t = F.get(lists, x["t"])
        return F.forall(F.get(musts, x["t"]), lambda p: F.get("__w", x["d"] + p).eqNullSafe(F.get(t, p)))

    def share(x: Column) -> Column:
        own = F.transform(F.get(lists, x["t"]), lambda word, p: F.when(F.get("__w", x["d"] + p).eqNullSafe(word), F.get(F.get(weights, x["t"]), p)).otherwise(0.0))
        return F.aggregate(own, F.lit(0.0), lambda a, b: a + b)

    found = F.transform(F.filter("__met", confirmed), lambda x: F.struct(F.get(F.array(*[F.lit(label) for label, _, _ in known]), x["t"]).alias("label"), share(x).alias("share")))
    w = w.withColumn("__found", F.coalesce(F.when(F.size("__met") > 0, found), F.expr("cast(array() as array<struct<label:string,share:double>>)")))
    own, place = F.transform("__base", lambda b: b["label"]), F.transform("__base", lambda b: b["i"])
    more = F.transform(F.filter("__found", lambda x: x["share"] >= COVERAGE), lambda x: x["label"])
    best = F.coalesce(F.array_max(F.transform("__found", lambda x: x["share"])), F.lit(0.0))
    out = {
        "n_words": F.size("__w").cast("long"),
        "n_base": F.size("__base").cast("long"),
        "first_word": F.array_min(place).cast("long"),
        "last_word": F.array_max(place).cast("long"),
        "base_labels": F.array_join(F.array_sort(F.array_distinct(own)), ","),
        "labels": F.array_join(F.array_sort(F.array_union(own, more)), ","),
        "score": F.least(F.greatest(best, F.when(F.size("__base") > 0, 0.5).otherwise(0.0)), F.lit(1.0)),
    }
    return w.select(*[F.col(f"__k_{c}").alias(c) for c in keep], *[c.alias(n) for n, c in out.items()])
