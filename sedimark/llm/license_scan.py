"""License scans in DataFrame functions only.

Every file is compared with licence templates by the cosine of sparse TF-IDF vectors, in three kinds of units: its whole text, its header (the
lines before the first blank one, at most `HEADER_LINES`) and each of its segments (lines, and sentences within them). Templates are short notices, standard headers and whole licence
texts. Frequent English words are left out everywhere, and terms that no template has count one by one. A file's own licence is that of its best unit with a cosine of
`LEAST` or more (ties: the lesser name). A file of which licence segments make up `FILE_SHARE` of the words or more, or whose
whole text is a licence, is its directory's licence file. Long licence texts (GPL, AGPL, LGPL, Apache, MPL, CC0, GFDL, Artistic) are known by the counts of their heaviest
terms: a text of `LONG_TEXT` words or more with a cosine of `LEAST_TEXT` or more to them is that licence, whatever notices it quotes. A file without a licence of its own gets that of the
nearest directory at or above it that has a licence file (several: the largest share, then the least licence and path).

Two bounds save work and lose nothing: a unit within reach of a template holds one of the template's heaviest terms (the others together can't
make up the cosine), and the terms it shares with all templates weigh enough against its other terms.

Comparing needs no shuffle: it is an expression of the row, and its small result is written once. Directories are resolved on their distinct paths: licence
files by directory, joined to each directory's ancestors, the deepest taken; that small table is joined to the files, by broadcast for the
directories that hold a large part of all rows.

Defined results: null text counts as empty; null parts of a path are left out, and a file without directories is in the root ''; rows that
repeat are scanned one by one; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spread_join, written

LEAST, FILE_SHARE, HEADER_LINES = 0.6, 0.15, 25
#: A text of so many words may be a long licence's text; it is that of the best cosine with the counts below, from LEAST_TEXT on.
LONG_TEXT, LEAST_TEXT = 250, 0.75

#: Short notices, standard headers and whole texts by licence (SPDX names).
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_WAIVER = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} General Public License as published by the Free Software Foundation, either version {n} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} General Public License for more details. You should have received a copy of the GNU {name} General Public License along with this program."
TEMPLATES = (
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. SPDX-License-Identifier: 0BSD"),
    ("AGPL-3.0", "SPDX-License-Identifier: AGPL-3.0-only"),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", _GNU.format(name="Affero", n=3)),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("BSD-2-Clause", f"{_BSD} {_BSD_WAIVER}"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted."),
    ("BSD-3-Clause", f"{_BSD} 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. {_BSD_WAIVER}"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("EPL-2.0", "SPDX-License-Identifier: EPL-2.0"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0"),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", _GNU.format(name="", n=2)),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-3.0", _GNU.format(name="", n=3)),
    ("ISC", "SPDX-License-Identifier: ISC"),
    ("ISC", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", _GNU.format(name="Lesser", n=3)),
    ("MIT", "Released under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely."),
)
#: The terms that weigh most in long licence texts, and how often each stands there. (AGPL-3.0 is GPL-3.0's text but for the word that its name adds.)
TEXT_TERMS = {
    "AGPL-3.0": "work 97 license 102 program 52 covered 41 source 42 under 44 convey 26 product 21 terms 32 code 34 corresponding 23 conveying 15 may 31 general 23 patent 23 copyright 30 software 27 gnu 22 object 21 affero 18",
    "Apache-2.0": "work 34 license 35 derivative 18 mean 10 works 19 licensor 10 contribution 8 contributor 10 entity 10 apache 6 source 12 conditions 13 copyright 13 form 13 owner 6 within 8 reproduction 4 submitted 4 including 9",
    "Artistic-1.0-Perl": "package 35 standard 15 may 15 holder 10 copyright 13 provided 11 distribution 10 version 10 subroutines 4 executables 4 fee 6 modifications 7 executable 5 make 6 manual 3 files 5 image 3 item 3 commercial 4",
    "CC0-1.0": "affirmer 17 work 26 rights 22 related 11 cc0 7 commons 8 creative 7 waiver 7 copyright 11 s 11 action 4 including 9 law 8 person 4 future 5 purpose 8 applicable 7 causes 3 iv 3",
    "GFDL-1.3": "cover 32 license 75 document 74 invariant 23 title 27 texts 20 section 36 version 38 entitled 15 may 36 sections 29 text 18 preserve 13 copy 28 front 12 publisher 12 transparent 11 under 23 covers 9",
    "GPL-2.0": "program 71 license 46 software 35 free 28 work 24 general 15 copy 18 terms 18 source 16 distribute 19 under 19 distribution 16 public 16 warranty 13 may 17 code 16 show 8 based 12 conditions 13",
    "GPL-3.0": "work 97 license 102 program 52 covered 41 source 42 under 44 convey 26 product 21 terms 32 code 34 corresponding 23 conveying 15 may 31 general 23 patent 23 copyright 30 software 27 gnu 22 object 21 affero 3",
    "LGPL-2.1": "library 140 license 76 work 58 free 36 software 35 general 27 copy 30 public 29 terms 26 must 23 version 25 we 17 under 24 uses 13 code 23 distribute 23 gnu 17 lesser 15 may 21",
    "LGPL-3.0": "library 34 combined 21 gnu 21 version 27 work 24 license 25 application 14 gpl 10 general 11 corresponding 9 lesser 9 public 12 code 11 copy 10 under 10 convey 6 source 8 may 9 terms 8",
    "MPL-2.0": "license 69 contributor 35 covered 36 software 39 under 35 1 30 form 29 2 27 secondary 12 source 20 3 22 terms 20 code 21 means 18 licenses 13 version 17 rights 14 may 16 liability 9",
}
#: Of long licence texts each has one of these.
TEXT_GATE = ("copyright", "license")
#: Words that say nothing about a licence.
STOP = frozenset("a all an and any are as at be but by can do for from has have if in into is it its more no not of on one only or other out see shall should so such that the these this to use used was way which will with you your".split())
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _terms(text: str) -> list[str]:
    return [t for t in re.findall("[a-z0-9]+", text.lower()) if t not in STOP]


def idf() -> tuple[dict[str, float], float]:
    """Weights of the templates' terms, and of a term that none has."""
    n = len(TEMPLATES)
    found = sorted({t for _, text in TEMPLATES for t in _terms(text)})
    weight = lambda df: math.log((1 + n) / (1 + df)) + 1
    return {t: weight(sum(t in _terms(text) for _, text in TEMPLATES)) for t in found}, weight(0)


def template_vectors() -> list[tuple[str, dict[str, float]]]:
    """Unit vectors of the templates."""
    known, _ = idf()
    out = []
    for name, text in TEMPLATES:
        terms = _terms(text)
        raw = {t: terms.count(t) * known[t] for t in sorted(set(terms))}
        norm = math.sqrt(sum(v * v for v in raw.values()))
        out.append((name, {t: v / norm for t, v in raw.items()}))
    return out


def text_counts() -> dict[str, dict[str, int]]:
    return {name: {t: int(n) for t, n in zip(row.split()[::2], row.split()[1::2])} for name, row in TEXT_TERMS.items()}


def text_idf() -> tuple[dict[str, float], float]:
    """Weights of the long texts' terms, and of a term that none has."""
    counts = text_counts()
    weight = lambda df: math.log((1 + len(counts)) / (1 + df)) + 1
    return {t: weight(sum(t in c for c in counts.values())) for t in sorted({t for c in counts.values() for t in c})}, weight(0)


def text_vectors() -> list[tuple[str, dict[str, float]]]:
    known, _ = text_idf()
    out = []
    for name, counts in sorted(text_counts().items()):
        raw = {t: n * known[t] for t, n in sorted(counts.items())}
        norm = math.sqrt(sum(v * v for v in raw.values()))
        out.append((name, {t: v / norm for t, v in raw.items()}))
    return out


def _text_match() -> str:
    """SQL: the best long text (score, name) of an array of tokens, null where none is near enough; the score is rounded and negated."""
    known, other = text_idf()
    listed = lambda terms: ", ".join(f"'{t}'" for t in terms)
    scores = ", ".join(f"named_struct('score', -round(aggregate(g.v, 0D, (a, x) -> a + x.w * coalesce(element_at({_map(vector)}, x.t), 0D)) / g.norm, 6), 'name', '{name}')" for name, vector in text_vectors())
    counted = f"transform(array(filter(tokens, y -> y in ({listed(known)}))), u -> transform(array_sort(array_distinct(u)), x -> named_struct('t', x, 'w', size(filter(u, y -> y = x)) * element_at({_map(known)}, x))))[0]"
    rest = f"size(filter(tokens, y -> y not in ({listed(['', *sorted(STOP), *sorted(set(known) - STOP)])})))"
    best = f"transform(array(named_struct('v', {counted}, 'o', {rest})), g -> named_struct('v', g.v, 'norm', sqrt(aggregate(g.v, 0D, (a, x) -> a + x.w * x.w) + g.o * {other * other!r}D)))"
    return f"""case when arrays_overlap(tokens, array({listed(TEXT_GATE)})) and size(filter(tokens, y -> y <> '')) >= {LONG_TEXT}
        then get(filter(transform({best}, g -> array_min(array({scores}))), m -> m.score <= -{LEAST_TEXT}), 0) end"""


def key_terms() -> list[str]:
    """Terms of which any text with a cosine of LEAST to some template has one: without these terms of a template, what is left of it weighs less.

    Numbers and short terms, which stand in any text, are taken last.
    """
    out: set[str] = set()
    for _, vector in template_vectors():
        rest = 1.0
        for term, w in sorted(vector.items(), key=lambda x: (len(x[0]) < 3 or x[0].isdigit(), -x[1], x[0])):
            if rest < LEAST**2 - 1e-9:
                break
            out.add(term)
            rest -= w * w
    return sorted(out)


def _map(values: dict[str, float]) -> str:
    return "map(" + ", ".join(f"'{k}', {v!r}D" for k, v in values.items()) + ")"


def _matches(units: str) -> str:
    """SQL: from an array of units (kind, s), those that match a template as structs (kind, n, best (score, name)); scores are rounded and negated."""
    known, other = idf()
    listed = lambda terms: ", ".join(f"'{t}'" for t in terms)
    scores = ", ".join(
        f"named_struct('score', -round(aggregate(g.v, 0D, (a, x) -> a + x.w * coalesce(element_at({_map(vector)}, x.t), 0D)) / g.norm, 6), 'name', '{name}')" for name, vector in template_vectors()
    )
    return f"""
      filter(
        transform(
          filter(
            transform(
              transform(
                filter(
                  {units},
                  u -> arrays_overlap(u.t, array({listed(key_terms())}))),
                u -> named_struct('kind', u.kind, 'n', size(filter(u.t, y -> y <> '')), 'm', size(filter(u.t, y -> y not in ({listed(['', *sorted(STOP)])}))), 't', filter(u.t, y -> y in ({listed(known)})))),
              u -> named_struct('kind', u.kind, 'n', u.n, 'm', u.m, 'v', transform(array_sort(array_distinct(u.t)),
                x -> named_struct('t', x, 'c', size(filter(u.t, y -> y = x)), 'w', size(filter(u.t, y -> y = x)) * element_at({_map(known)}, x))))),
            u -> aggregate(u.v, 0D, (a, x) -> a + x.w * x.w) >= {LEAST**2 - 1e-5} * (aggregate(u.v, 0D, (a, x) -> a + x.w * x.w) + (u.m - aggregate(u.v, 0, (a, x) -> a + x.c)) * {other * other!r}D)),
          u -> transform(array(named_struct('v', u.v, 'norm', sqrt(aggregate(u.v, 0D, (a, x) -> a + x.w * x.w) + (u.m - aggregate(u.v, 0, (a, x) -> a + x.c)) * {other * other!r}D))),
            g -> named_struct('kind', u.kind, 'n', u.n, 'best', array_min(array({scores}))))[0]),
        m -> m.best.score <= -{LEAST})
    """


def as_files(docs: DataFrame) -> DataFrame:
    """Documents as files: their directory is source/lang."""
    return docs.select(F.col("doc_id"), F.concat_ws("/", "source", "lang").alias("dir"), "text")


def notices(files: DataFrame) -> DataFrame:
    """(doc_id, dir, n_words, own_license, own_score, license_words): each file with its own licence, null where none matches."""
    low = files.select(
        "doc_id", "dir", F.coalesce(F.translate(F.col("text").cast("string"), _UPPER, _LOWER), F.lit("")).alias("low"),
    ).withColumn("n_words", F.regexp_count("low", F.lit("[^ \\t-\\r]+")).cast("long"))
    cut = lambda text: f"split({text}, '[^a-z0-9]+')"
    header = "array_join(slice(split(split(low, '\\n[ \\t]*\\n', 2)[0], '\\n'), 1, %d), '\\n')" % HEADER_LINES
    segments = f"transform(split(regexp_replace(low, '([.!?])[ \\\\t]+', '$1\\n'), '\\n'), s -> named_struct('kind', 's', 't', {cut('s')}))"
    units = f"concat(array(named_struct('kind', 'w', 't', tokens), named_struct('kind', 'h', 't', {cut(header)})), {segments})"
    keys = "array(" + ", ".join(f"'{t}'" for t in key_terms()) + ")"
    return (
        low.withColumn("tokens", F.expr(cut("low"))).withColumn("matched", F.expr(f"case when arrays_overlap(tokens, {keys}) then {_matches(units)} end"))
        .withColumn("whole", F.expr(_text_match())).withColumn("top", F.coalesce("whole", F.expr("array_min(transform(matched, m -> m.best))")))
        .select(
            "doc_id", "dir", "n_words", F.col("top.name").alias("own_license"), (-F.col("top.score")).alias("own_score"),
            F.expr("if(whole is not null, n_words, coalesce(greatest(aggregate(matched, 0L, (a, m) -> a + if(m.kind = 's', m.n, 0)), aggregate(matched, 0L, (a, m) -> a + if(m.kind = 'w', m.n, 0))), 0L))").alias("license_words"),
        )
    )


def directory_licenses(found: DataFrame) -> DataFrame:
    """(dir, dir_license, license_dir): each directory with the licence of the nearest directory, at or above it, that has a licence file."""
    file = found.where(F.col("own_license").isNotNull() & (F.col("license_words") >= FILE_SHARE * F.col("n_words")))
    held = file.groupBy("dir").agg(F.min(F.struct((-F.round(F.col("license_words") / F.col("n_words"), 6)).alias("s"), F.col("own_license").alias("name"))).alias("f")).select(F.col("dir").alias("at"), F.col("f.name").alias("name"))
    parts = F.split("dir", "/")
    up = found.select("dir").distinct().withColumn("depth", F.explode(F.sequence(F.lit(0), F.size(parts)))).withColumn("at", F.array_join(F.slice(parts, F.lit(1), F.col("depth")), "/"))
    return up.join(held, "at").groupBy("dir").agg(F.max(F.struct("depth", "at", "name")).alias("m")).select("dir", F.col("m.name").alias("dir_license"), F.col("m.at").alias("license_dir"))


def scanned(files: DataFrame) -> DataFrame:
    """A row for each file: own licence and score, and the licence it has in the end, with the directory it comes from."""
    found = written(notices(files))
    joined = spread_join(found, written(directory_licenses(found)), ["dir"])
    own = F.col("own_license").isNotNull()
    return joined.select(
        "doc_id", "dir", "n_words", "license_words", "own_license", F.round("own_score", 4).alias("own_score"),
        F.coalesce("own_license", "dir_license").alias("license"),
        F.when(own, "own").when(F.col("dir_license").isNotNull(), "inherited").otherwise("none").alias("origin"),
        F.when(~own, F.col("license_dir")).alias("license_dir"),
    )


def _oracle() -> str:
    known, other = idf()
    rows = lambda it: ", ".join(f"({', '.join(x)})" for x in it)
    terms = rows((f"'{t}'", f"{w!r}::double") for t, w in known.items())
    vectors = rows((str(k), f"'{name}'", f"'{t}'", f"{w!r}::double") for k, (name, v) in enumerate(template_vectors()) for t, w in v.items())
    text_known, text_other = text_idf()
    text_terms = rows((f"'{t}'", f"{w!r}::double") for t, w in text_known.items())
    texts = rows((f"'{name}'", f"'{t}'", f"{w!r}::double") for name, v in text_vectors() for t, w in v.items())
    stop = ", ".join(f"'{t}'" for t in sorted(STOP - set(text_known)))
    return f"""
    with known(t, w) as (values {terms}), vectors(k, name, t, w) as (values {vectors}), text_known(t, w) as (values {text_terms}), texts(name, t, w) as (values {texts}),
    low as (select row_number() over () as r, doc_id, concat_ws('/', source, lang) as dir,
              coalesce(translate(text, '{_UPPER}', '{_LOWER}'), '') as low from documents),
    files as (select *, len(regexp_extract_all(low, '[^ \\t-\\r]+'))::bigint as n_words from low),
    units as (select r, 's' as kind, unnest(string_split(regexp_replace(low, '([.!?])[ \\t]+', '\\1' || chr(10), 'g'), chr(10))) as s from low union all select r, 'w', low from low
              union all select r, 'h', array_to_string(string_split(regexp_split_to_array(low, '\\n[ \\t]*\\n')[1], chr(10))[1:{HEADER_LINES}], chr(10)) from low),
    numbered as (select row_number() over () as g, r, kind, s from units),
    terms as (select g, r, kind, unnest(regexp_extract_all(s, '[a-z0-9]+')) as t from numbered),
    tf as materialized (select g, any_value(r) as r, any_value(kind) as kind, t, count(*) as n from terms group by g, t),
    weighed as (select g, r, kind, t, n, w, n * w as x from tf left join known using (t)),
    norms as (select g, any_value(r) as r, any_value(kind) as kind, sum(n) as n, sqrt(sum(case when t in ({", ".join(f"'{t}'" for t in sorted(STOP))}) then 0 when w is null then n * {other * other!r}::double else x * x end)) as norm from weighed group by g),
    dots as (select g, k, any_value(name) as name, sum(x.x * v.w) as dot from weighed x join vectors v using (t) group by g, k),
    best as (select g, min(struct_pack(score := -round(dot / norm, 6), name := name)) as b from dots join norms using (g) group by g),
    matched as (select r, kind, n, b from best join norms using (g) where b.score <= -{LEAST}),
    longs as (select g, any_value(r) as r from tf where kind = 'w' group by g having sum(n) >= {LONG_TEXT} and bool_or(t in ({", ".join(f"'{t}'" for t in TEXT_GATE)}))),
    text_tf as (select g, longs.r as r, t, n, w from longs join tf using (g) left join text_known using (t)),
    text_norms as (select g, any_value(r) as r, sqrt(sum(case when w is not null then n * w * n * w when t in ({stop}) then 0 else n * {text_other * text_other!r}::double end)) as norm from text_tf group by g),
    text_best as (select any_value(r) as r, min(struct_pack(score := -round(dot / norm, 6), name := name)) as b from (select g, name, sum(x.n * x.w * v.w) as dot from text_tf x join texts v using (t) group by g, name) join text_norms using (g) group by g having min(-round(dot / norm, 6)) <= -{LEAST_TEXT}),
    own_units as (select r, min(b) as b, greatest(coalesce(sum(n) filter (kind = 's'), 0), coalesce(sum(n) filter (kind = 'w'), 0))::bigint as license_words from matched group by r),
    own as (select r, coalesce(t.b, o.b) as b, case when t.b is not null then null else license_words end as license_words from own_units o full join text_best t using (r)),
    found as (select f.r, doc_id, dir, n_words, case when b is not null and license_words is null then n_words else coalesce(license_words, 0) end::bigint as license_words, b.name as own_license, -b.score as own_score from files f left join own using (r)),
    held as (select dir as place, min(struct_pack(s := -round(license_words / n_words, 6), name := own_license)).name as name from found
             where own_license is not null and license_words >= {FILE_SHARE} * n_words group by dir),
    dirs as (select dir, unnest(range(0, len(string_split(dir, '/')) + 1)) as depth from (select distinct dir from found)),
    up as (select dir, depth, array_to_string(string_split(dir, '/')[1:depth], '/') as place from dirs),
    held_by as (select dir, max(struct_pack(depth := depth, place := place, name := name)) as m from up join held using (place) group by dir)
    select doc_id, found.dir as dir, n_words, license_words, own_license, round(own_score, 4) as own_score, coalesce(own_license, m.name) as license,
      case when own_license is not null then 'own' when m.name is not null then 'inherited' else 'none' end as origin,
      case when own_license is null then m.place end as license_dir
    from found left join held_by on found.dir = held_by.dir
    """


ORACLE_SQL = _oracle()
