"""License scans: normalised sentences become identifiers, identifier sequences are matched against ordered rules. DataFrame functions only."""

from __future__ import annotations

from functools import reduce
from itertools import chain
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import materialize

# Sentences of public licence texts and notices, normalised (lower case, runs of other than letters and digits are one space).
SENTENCES = {
    "mit-name": "the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "as-is": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "apache2-head": "under apache license version 2 0 the license",
    "apache2-comply": "you may not use this file except in compliance with the license",
    "apache2-copy": "you may obtain a copy of the license at",
    "apache2-asis": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache2-see": "see the license for the specific language governing permissions and limitations under the license",
    "gpl-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl2-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl-hope": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "gpl-see": "see the gnu general public license for more details",
    "bsd-redist": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-names": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "mpl2-head": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "agpl3-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "agpl-see": "see the gnu affero general public license for more details",
    "lgpl3-free": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "lgpl21-free": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    "lgpl-hope": "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "lgpl-see": "see the gnu lesser general public license for more details",
    "bsd-as-is": "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    "bsd4-advert": "all advertising materials mentioning features or use of this software must display the following acknowledgement",
    "0bsd-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "unlicense-free": "this is free and unencumbered software released into the public domain",
    "unlicense-anyone": "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    "zlib-as-is": "this software is provided as is without any express or implied warranty",
    "zlib-grant": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "zlib-origin": "the origin of this software must not be misrepresented you must not claim that you wrote the original software",
    "bsl1-grant": "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following",
    "epl2-terms": "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0",
    "cc0-dedicated": "to the extent possible under law the author s have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide",
    "cc0-warranty": "this software is distributed without any warranty",
    "x11-advert": "except as contained in this notice the name of the x consortium shall not be used in advertising or otherwise to promote the sale use or other dealings in this software without prior written authorization from the x consortium",
}
# Names by which a text refers to a licence, normalised, after "licensed under (the)" and the like.
NAMES = {
    "MIT": ("mit license", "mit licence", "mit"),
    "Apache-2.0": ("apache license version 2 0", "apache license 2 0", "apache 2 0 license", "apache 2 0"),
    "GPL-3.0-only": ("gnu general public license version 3", "gnu general public license v3", "gnu gpl version 3", "gnu gpl v3", "gpl v3", "gplv3"),
    "GPL-2.0-only": ("gnu general public license version 2", "gnu general public license v2", "gnu gpl version 2", "gnu gpl v2", "gpl v2", "gplv2"),
    "AGPL-3.0-only": ("gnu affero general public license version 3", "gnu affero general public license v3", "gnu agpl v3", "agpl v3", "agplv3"),
    "LGPL-3.0-only": ("gnu lesser general public license version 3", "gnu lesser general public license v3", "gnu lgpl v3", "lgpl v3", "lgplv3"),
    "LGPL-2.1-only": ("gnu lesser general public license version 2 1", "gnu lesser general public license v2 1", "gnu lgpl v2 1", "lgpl v2 1", "lgplv2 1"),
    "MPL-2.0": ("mozilla public license version 2 0", "mozilla public license 2 0", "mpl 2 0"),
    "BSD-2-Clause": ("bsd 2 clause license", "2 clause bsd license", "simplified bsd license"),
    "BSD-3-Clause": ("bsd 3 clause license", "3 clause bsd license", "new bsd license", "modified bsd license"),
    "ISC": ("isc license", "isc licence"),
    "EPL-2.0": ("eclipse public license version 2 0", "eclipse public license 2 0", "epl 2 0"),
    "BSL-1.0": ("boost software license version 1 0", "boost software license 1 0"),
    "Zlib": ("zlib license", "zlib libpng license"),
    "CC0-1.0": ("cc0 1 0", "cc0 1 0 universal", "creative commons zero v1 0 universal license", "creative commons cc0 1 0 universal license"),
    "CC-BY-4.0": ("cc by 4 0", "creative commons attribution 4 0 international license"),
    "CC-BY-SA-4.0": ("cc by sa 4 0", "creative commons attribution sharealike 4 0 international license"),
    "CC-BY-ND-4.0": ("cc by nd 4 0", "creative commons attribution noderivatives 4 0 international license"),
    "CC-BY-NC-4.0": ("cc by nc 4 0", "creative commons attribution noncommercial 4 0 international license"),
    "CC-BY-NC-SA-4.0": ("cc by nc sa 4 0", "creative commons attribution noncommercial sharealike 4 0 international license"),
    "CC-BY-NC-ND-4.0": ("cc by nc nd 4 0", "creative commons attribution noncommercial noderivatives 4 0 international license"),
}
#: How a reference begins; the beginning is cut to "under", so that one sentence stands for all its variants.
UNDER = "^((this|the) (project|work|software|program|code|library|file|document|package|text|dataset|content)( is)? )?(is )?(dual )?(licensed|released|distributed|available|published|provided|made available) under (the terms of )?(the |a )?"
KNOWN = SENTENCES | {f"ref-{name}-{k}": f"under {text}" for name, texts in NAMES.items() for k, text in enumerate(texts)}
# Rules, each a licence and the sentences that must occur in this order, others between them allowed.
RULES = (
    ("MIT", "text", ("mit-grant", "mit-notice", "as-is")),
    ("X11", "text", ("mit-grant", "mit-notice", "as-is", "x11-advert")),
    ("MIT", "title", ("mit-name",)),
    ("Apache-2.0", "notice", ("apache2-head", "apache2-comply", "apache2-copy", "apache2-asis", "apache2-see")),
    ("Apache-2.0", "notice", ("apache2-head", "apache2-comply", "apache2-asis", "apache2-see")),
    ("GPL-3.0-or-later", "notice", ("gpl-free", "gpl-hope", "gpl-see")),
    ("GPL-2.0-or-later", "notice", ("gpl2-free", "gpl-hope", "gpl-see")),
    ("AGPL-3.0-or-later", "notice", ("agpl3-free", "gpl-hope", "agpl-see")),
    ("LGPL-3.0-or-later", "notice", ("lgpl3-free", "lgpl-hope", "lgpl-see")),
    ("LGPL-2.1-or-later", "notice", ("lgpl21-free", "lgpl-hope", "lgpl-see")),
    ("BSD-4-Clause", "text", ("bsd-redist", "bsd-source", "bsd-binary", "bsd4-advert", "bsd-names")),
    ("BSD-3-Clause", "text", ("bsd-redist", "bsd-source", "bsd-binary", "bsd-names")),
    ("BSD-2-Clause", "text", ("bsd-redist", "bsd-source", "bsd-binary", "bsd-as-is")),
    ("BSD-2-Clause", "text", ("bsd-redist", "bsd-source", "bsd-binary")),
    ("ISC", "text", ("isc-grant",)),
    ("0BSD", "text", ("0bsd-grant",)),
    ("MPL-2.0", "notice", ("mpl2-head",)),
    ("Unlicense", "text", ("unlicense-free", "unlicense-anyone")),
    ("Zlib", "text", ("zlib-as-is", "zlib-grant", "zlib-origin")),
    ("BSL-1.0", "text", ("bsl1-grant", "as-is")),
    ("BSL-1.0", "text", ("bsl1-grant",)),
    ("EPL-2.0", "notice", ("epl2-terms",)),
    ("CC0-1.0", "notice", ("cc0-dedicated", "cc0-warranty")),
    *((name, "reference", (f"ref-{name}-{k}",)) for name, texts in NAMES.items() for k in range(len(texts))),
)
#: A licence isn't reported where a longer text that holds its own was found.
HIDDEN_BY = {"BSD-2-Clause": ("BSD-3-Clause", "BSD-4-Clause"), "BSD-3-Clause": ("BSD-4-Clause",), "MIT": ("X11",)}
#: Sentences of a rule are that many lines and sentences apart at most.
GAP = 12
#: Sentences above whose real notices hold a . ; or : before white space: the splitter cuts them, so they are put together again from the pieces.
BROKEN = ("gpl-free", "gpl2-free", "gpl-hope", "mpl2-head", "agpl3-free", "lgpl3-free", "lgpl21-free", "lgpl-hope", "zlib-origin")
#: Every sentence above holds one of these, so a text without them needs no splitting.
HINTS = "licen|permi|copyright|redistribut|warrant|public domain|anyone is free|advertising|origin of this software|(released|distributed|available|published|provided) under"


def normalised(sentence: Column) -> Column:
    """Lower case, runs of other than letters and digits one space; the beginning of a reference cut to "under"."""
    return F.regexp_replace(F.trim(F.regexp_replace(F.lower(sentence), "[^a-z0-9]+", " ")), UNDER, "under ")


def _known(normal: Column) -> Column:
    names = F.create_map(*chain.from_iterable((F.lit(text), F.lit(name)) for name, text in KNOWN.items()))
    return F.try_element_at(names, normal)


def _joined(pieces: Column) -> Column:
    """Identifiers of normalised pieces in order with their places, those of BROKEN put together from adjacent pieces.

    The run is what the last pieces have of a broken sentence; a piece that doesn't continue it ends it.
    """
    broken = {name: KNOWN[name] for name in BROKEN}

    def begins(text):
        return reduce(or_, (F.startswith(F.lit(whole), F.concat(text, F.lit(" "))) for whole in broken.values()))

    def step(held, piece):
        longer = F.when(held["run"] == "", piece).otherwise(F.concat_ws(" ", held["run"], piece))
        name = F.when(held["run"] != "", reduce(lambda rest, n: F.when(longer == broken[n], n).otherwise(rest), broken, F.lit(None).cast("string")))
        run = F.when(name.isNotNull(), "").when(begins(longer), longer).when(begins(piece), piece).otherwise("")
        name = F.coalesce(name, _known(piece))
        found = F.when(name.isNotNull(), F.array(F.struct(name.alias("id"), held["at"].alias("at")))).otherwise(F.array().cast(_IDS))
        return F.struct(F.concat(held["ids"], found).alias("ids"), run.alias("run"), (held["at"] + 1).alias("at"))

    start = F.struct(F.array().cast(_IDS).alias("ids"), F.lit("").alias("run"), F.lit(0).alias("at"))
    return F.aggregate(pieces, start, step)["ids"]


_IDS = "array<struct<id:string,at:int>>"


def sentence_ids(text: Column) -> Column:
    """Identifiers of the known sentences of a text, in order, each with its place among the text's sentences and lines.

    Sentences end at . ; : ! ? before white space and at empty lines; lines of a paragraph belong together. A
    sentence that isn't known as a whole is looked up line by line. Those of BROKEN hold such an end themselves
    and may also run over several sentences and lines.
    """
    wrapped = F.split(F.regexp_replace(text, r"([.;:!?])[ \t\r\n]+|\r?\n[ \t]*\r?\n", "$1\x00"), "\x00")

    def pieces(sentence):
        lines = F.transform(F.split(sentence, "\n"), normalised)
        return F.when(_known(normalised(sentence)).isNotNull(), F.array(normalised(sentence))).otherwise(lines)

    split = F.filter(F.flatten(F.transform(wrapped, pieces)), lambda x: x != "")
    starts = "|".join(dict.fromkeys(SENTENCES[name].split()[0] + " " + SENTENCES[name].split()[1] for name in BROKEN))
    places = F.transform(split, lambda x, k: F.struct(_known(x).alias("id"), k.alias("at")))
    plain = F.filter(places, lambda x: x["id"].isNotNull())
    return F.when(F.lower(text).rlike(starts.replace(" ", "[^a-z0-9]+")), _joined(split)).otherwise(plain)


def scan_licenses(docs: DataFrame) -> DataFrame:
    """(doc_id, license, kind, sentences) for every licence that a text carries; a licence is reported once, by its longest fitting rule.

    sentences lists the identifiers of that rule; they occur in this order, each at most ``GAP`` sentences or lines
    after the one before. Of rules of equal length the first wins. A licence that ``HIDDEN_BY`` names is not reported
    beside the one that holds its text. Null and empty texts carry none, texts of any length are scanned whole;
    repeated rows are reported each; rows without a doc_id are reported with null. Other columns are ignored. Nothing
    is shuffled.
    """
    hinted = docs.select("doc_id", "text").where(F.lower("text").rlike(HINTS))
    # Written down, as every rule reads the identifiers: few texts have any.
    found = materialize(hinted.select("doc_id", sentence_ids(F.col("text")).alias("ids")), "sentences").where(F.size("ids") > 0)
    single = F.transform("ids", lambda x: x["id"])
    found = found.withColumn("names", single)
    texts = [r for r in RULES if r[1] != "reference"]
    rules = []
    for name in dict.fromkeys(r[0] for r in texts):
        best = F.lit(None).cast("struct<license:string,kind:string,sentences:string>")
        for license_, kind, needed in sorted((r for r in reversed(texts) if r[0] == name), key=lambda r: len(r[2])):
            rule = F.struct(F.lit(license_).alias("license"), F.lit(kind).alias("kind"), F.lit(" ".join(needed)).alias("sentences"))
            best = F.when(_in_order(needed), rule).otherwise(best)
        rules.append(best)
    # A reference names its licence in its identifier: of each licence the first name listed.
    named = F.array_sort(F.array_distinct(F.transform(F.filter("names", lambda x: x.startswith("ref-")), _reference)))
    found = found.withColumn("whole", F.filter(F.array(*rules), lambda x: x.isNotNull())).withColumn("named", named)
    beside = F.filter("named", lambda x, k: ~F.exists("whole", lambda w: w["license"] == x["license"]) & ((k == 0) | (F.get("named", k - 1)["license"] != x["license"])))
    hits = found.select("doc_id", F.concat("whole", beside).alias("found"))
    hits = hits.withColumn("all", F.transform("found", lambda x: x["license"]))
    hits = hits.select("doc_id", "all", F.explode("found").alias("r"))
    hidden = F.lit(False)
    for name, others in HIDDEN_BY.items():
        hidden = hidden | ((F.col("r.license") == name) & F.arrays_overlap("all", F.array(*map(F.lit, others))))
    return hits.where(~hidden).select("doc_id", "r.license", "r.kind", "r.sentences")


def _reference(name: Column) -> Column:
    return F.struct(F.regexp_extract(name, "^ref-(.*)-[0-9]+$", 1).alias("license"), F.lit("reference").alias("kind"), name.alias("sentences"))


def _in_order(needed: tuple[str, ...]) -> Column:
    """Whether the sentences follow one another within GAP: for each of them the last place where a chain up to it ends."""
    if len(needed) == 1:
        return F.array_contains("names", needed[0])
    none = F.array(*[F.lit(-1)] * len(needed))

    def step(ends, x):
        grown = []
        for k, name in enumerate(needed):
            fits = x["id"] == name
            if k:
                fits = fits & (F.get(ends, F.lit(k - 1)) >= 0) & (x["at"] - F.get(ends, F.lit(k - 1)) <= GAP)
            grown.append(F.when(fits, x["at"]).otherwise(F.get(ends, F.lit(k))))
        return F.array(*grown)

    return F.array_contains("names", needed[-1]) & (F.get(F.aggregate("ids", none, step), F.lit(len(needed) - 1)) >= 0)


def op10_license_scan(spark, sf_dir: str) -> DataFrame:
    """Every licence that a document carries."""
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _op10_sql() -> str:
    entries = ", ".join(f"('{name}', '{text}')" for name, text in KNOWN.items())
    rules = ", ".join(f"({k}, '{name}', '{kind}', '{' '.join(needed)}', {j}, '{one}', {len(needed)})" for k, (name, kind, needed) in enumerate(RULES) for j, one in enumerate(needed))
    hidden = " OR ".join(f"(license = '{name}' AND doc_id IN (SELECT doc_id FROM hit WHERE license IN ({', '.join(map(repr, others))})))" for name, others in HIDDEN_BY.items())
    normal = lambda x: f"regexp_replace(trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g')), '{UNDER}', 'under ')"
    return rf"""
WITH RECURSIVE names AS (SELECT * FROM (VALUES {entries}) t(id, sentence)), rules AS (SELECT * FROM (VALUES {rules}) t(rule, license, kind, sentences, step, id, n)),
s AS (SELECT doc_id, k, ss[k] AS whole FROM (SELECT doc_id, ss, unnest(range(1, len(ss) + 1)) AS k FROM
  (SELECT doc_id, string_split(regexp_replace(regexp_replace(text, '([.;:!?])[ \t\r\n]+', '\1' || chr(1), 'g'), '\r?\n[ \t]*\r?\n', chr(1), 'g'), chr(1)) AS ss FROM documents))),
w AS (SELECT doc_id, k, 0 AS j, {normal('whole')} AS sentence, whole FROM s),
whole AS (SELECT doc_id, k, j, sentence FROM w WHERE sentence IN (SELECT sentence FROM names)),
lines AS (SELECT doc_id, k, j, {normal('ls[j]')} AS sentence FROM
  (SELECT doc_id, k, ls, unnest(range(1, len(ls) + 1)) AS j FROM (SELECT doc_id, k, string_split(whole, chr(10)) AS ls FROM w WHERE (doc_id, k) NOT IN (SELECT doc_id, k FROM whole)))),
pieces AS (SELECT doc_id, sentence, row_number() OVER (PARTITION BY doc_id ORDER BY k, j) AS place FROM (SELECT * FROM whole UNION ALL SELECT * FROM lines) WHERE sentence <> ''),
ids AS (SELECT doc_id, place, id FROM pieces JOIN names USING (sentence)),
chain AS (SELECT doc_id, rule, step, place FROM ids JOIN rules USING (id) WHERE step = 0
  UNION SELECT c.doc_id, c.rule, r.step, i.place FROM chain c JOIN rules r ON r.rule = c.rule AND r.step = c.step + 1 JOIN ids i ON i.doc_id = c.doc_id AND i.id = r.id AND i.place > c.place AND i.place - c.place <= {GAP}),
hit AS (SELECT DISTINCT c.doc_id, license, kind, sentences, n, rule FROM chain c JOIN rules r USING (rule, step) WHERE step = n - 1 QUALIFY row_number() OVER (PARTITION BY c.doc_id, license ORDER BY n DESC, rule) = 1)
SELECT doc_id, license, kind, sentences FROM hit WHERE NOT ({hidden})"""


OP10_SQL = _op10_sql()
