"""License scan by a positional rare-token index.

Templates are the words of licence notices and of whole licence texts (in parts, where a text has blanks to fill in).
The index lists (word, template, position) for the words of each template that are rarest by inverse document frequency
over all files: KEYS of its key phrases and OTHERS of the rest. A file is looked up by its own indexed words, which are
the highest-IDF licence words that it has. Each place of one proposes, by its postings, starts of templates; a start
that two different words agree on (one, where a template has one key word) stands if the template's key phrases do and
at least COVERAGE of its words are in their places. Since all words of a key phrase are mandatory, no place is lost by
looking up only the rarest.

A file's words are kept for that only if it has all words of some key phrase; the others (nearly all) end after one set
operation. Texts are cut into words once.

Base labels are places of three phrases and don't depend on the templates.

Words are runs of digits, a-z (A-Z lower-cased) and characters beyond ASCII. score is the largest share of a template's
words that stand at its place, or 1.0 where a base label stands, else 0.0.

Defined results: a null or empty text has no words, no labels ('') and null places; a template may begin before the
file's first word; repeated rows and null ids are files like others; an empty table gives an empty result; extra columns
are ignored; all places count, overlapping ones too.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .fingerprints import bound

NOT_A_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
KEYS, OTHERS = 2, 3
COVERAGE = 0.5

# The base phrases and labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Notices by label; key phrases stand between square brackets.
NOTICES = {
    "agpl": "[gnu affero general public license]",
    "apache-2.0": "licensed under the [apache license version 2 0]",
    "bsd": "[redistribution and use in source and binary forms] with or without modification are permitted",
    "cc-by-nc": "licensed under [cc by nc] 4 0",
    "cc-by-nd": "licensed under [cc by nd] 4 0",
    "cc-by-sa": "licensed under [cc by sa] 4 0",
    "cc0": "dedicated to the public domain under [cc0]",
    "epl-2.0": "[eclipse public license] v 2 0",
    "gpl-2.0": "this work is licensed under the [gnu general public license version 2]",
    "gpl-3.0": "this work is licensed under the [gnu general public license version 3]",
    "isc": "[permission to use copy modify and or distribute this software] for any purpose",
    "lgpl": "[gnu lesser general public license]",
    "mit": "released under [the mit license]",
    "mpl-2.0": "subject to the terms of the [mozilla public license v 2 0]",
    "unlicense": "this is [free and unencumbered software released into the public domain]",
}

# Licence texts and the headers that licences ask for, by label, as public licences have them. A text with blanks is given in parts.
TEXTS = {
    "mit": [
        "[Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files] (the \"Software\"), to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        "[THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND], EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE "
        "OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ],
    "isc": [
        "[Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted], provided that the above copyright notice and this permission notice appear in all copies. "
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR "
        "ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, "
        "ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. [Redistributions of source code must retain the above copyright notice], "
        "this list of conditions and the following disclaimer. 2. [Redistributions in binary form must reproduce the above copyright notice], this list of conditions and the following disclaimer in the documentation and/or "
        "other materials provided with the distribution.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A "
        "PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
        "[PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION]) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE "
        "OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ],
    "apache-2.0": [
        "[Licensed under the Apache License, Version 2.0] (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
        "See the License for the specific language governing permissions and limitations under the License.",
        "[Apache License Version 2.0, January 2004] http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",
    ],
    "gpl-2.0": [
        "This program is free software; you can redistribute it and/or modify it under the terms of the [GNU General Public License as published by the Free Software Foundation; either version 2] of the License, or (at your "
        "option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. "
        "See the GNU General Public License for more details."
    ],
    "gpl-3.0": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the [GNU General Public License as published by the Free Software Foundation, either version 3] of the License, or (at your "
        "option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. "
        "See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program."
    ],
    "lgpl": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the [GNU Lesser General Public License as published by the Free Software Foundation]; either version 2.1 of the License, or "
        "(at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."
    ],
    "agpl": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the [GNU Affero General Public License as published by the Free Software Foundation], either version 3 of the License, or "
        "(at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."
    ],
    "mpl-2.0": [
        "[This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0]. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."
    ],
    "epl-2.0": [
        "[This program and the accompanying materials are made available under the terms of the Eclipse Public License] 2.0 which is available at http://www.eclipse.org/legal/epl-2.0"
    ],
    "unlicense": [
        "This is [free and unencumbered software released into the public domain]. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, "
        "for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the "
        "public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all "
        "present and future rights to this software under copyright law."
    ],
    "zlib": [
        "This software is provided 'as-is', without any express or implied warranty. [In no event will the authors be held liable for any damages arising from the use of this software]. Permission is granted to anyone to use "
        "this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must "
        "not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be "
        "plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."
    ],
    "bsl-1.0": [
        "[Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license] (the \"Software\") to use, reproduce, display, "
        "distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so"
    ],
    "wtfpl": ["[DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE] TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION"],
    "cc0": [
        "To the extent possible under law, the author has [waived all copyright and related or neighboring rights to this work]",
        "[CC0 1.0 Universal] Creative Commons Legal Code",
    ],
}


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[str, ...]
    phrases: tuple[tuple[int, int], ...]  # start and end of each key phrase


def _template(label: str, text: str) -> Template:
    words, phrases = [], []
    for part in re.split(r"(\[[^]]*\])", text):
        own = [w for w in re.split(NOT_A_WORD, part.lower()) if w]
        if part.startswith("["):
            phrases.append((len(words), len(words) + len(own)))
        words += own
    return Template(label, tuple(words), tuple(phrases))


def templates(notices: dict[str, str] = NOTICES, texts: dict[str, list[str]] = TEXTS) -> list[Template]:
    return [_template(k, t) for k, t in sorted(notices.items())] + [_template(k, t) for k, ts in sorted(texts.items()) for t in ts]


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(common.ascii_lower(text), NOT_A_WORD), "")


def _listed(words: list[str] | tuple[str, ...]) -> Column:
    return F.split(F.lit(" ".join(words)), " ")


def _keys(t: Template) -> list[int]:
    return [k for a, b in t.phrases for k in range(a, b)]


def postings(known: list[Template], idf: dict[str, float]) -> list[tuple[str, int, int, int]]:
    """(word, template, position, words that have to agree) of every template's rarest words; of a word that stands twice, the first place."""
    out = []
    for n, t in enumerate(known):
        keys = _keys(t)
        rarest = lambda places: sorted({t.words[k]: k for k in reversed(places)}.values(), key=lambda k: (-idf[t.words[k]], k))  # noqa: E731, B023
        own = rarest(keys)[:KEYS]
        rest = [k for k in rarest([k for k in range(len(t.words)) if k not in keys]) if t.words[k] not in {t.words[x] for x in own}][:OTHERS]
        out += [(t.words[k], n, k, min(2, len(own))) for k in own + rest]
    return out


def _candidates(words: Column, hits: Column, index: Column) -> Column:
    """array<(t, start)>: the starts that enough different words agree on. Sorted, the votes for one start are neighbours."""
    here = lambda i: F.transform(F.filter(index, lambda p: p["word"] == F.get(words, i)), lambda p: F.struct(p["t"].alias("t"), (i - p["k"]).alias("s"), p["k"].alias("k"), p["votes"].alias("votes")))
    votes = F.array_sort(F.flatten(F.transform(hits, here)))

    def counted(v: Column) -> Column:
        same = lambda x, j: F.coalesce((F.get(v, j)["t"] == x["t"]) & (F.get(v, j)["s"] == x["s"]), F.lit(False))
        enough = lambda x, j: F.when(x["votes"] == 1, ~same(x, j - 1)).otherwise(same(x, j - 1) & ~same(x, j - 2))
        return F.filter(v, enough)

    return bound(votes, counted)


def _share(words: Column, start: Column, t: Column) -> Column:
    """Share of the template's words that are in their places, or null if a key phrase isn't there."""
    piece = lambda of, a, b: F.slice(of, F.greatest(a, F.lit(0)) + 1, b - a)
    stands = F.forall(t["phrases"], lambda p: (start + p["a"] >= 0) & (piece(words, start + p["a"], start + p["b"]) == piece(t["words"], p["a"], p["b"])))
    in_place = lambda k: F.coalesce((start + k >= 0) & (F.get(words, F.greatest(start + k, F.lit(0))) == F.get(t["words"], k)), F.lit(False))
    n = F.size(t["words"])
    share = F.size(F.filter(F.sequence(F.lit(0), n - 1), in_place)) / n
    return F.when(stands, bound(share, lambda x: F.when(x >= COVERAGE, x)))


def scan(docs: DataFrame, notices: dict[str, str] = NOTICES, text: str = "text", doc_id: str = "doc_id", texts: dict[str, list[str]] = TEXTS) -> DataFrame:
    known = templates(notices, texts)
    base = {label: phrase.split() for phrase, label in BASE.items()}
    vocabulary = sorted({w for t in known for w in t.words} | {w for p in base.values() for w in p})
    required = F.array(*[_listed(sorted({t.words[k] for k in _keys(t)})) for t in known], *[_listed(p) for p in base.values()])

    def cut(words: Column) -> Column:
        found = F.array_intersect(words, _listed(vocabulary))
        may = lambda f: (F.size(f) > 0) & F.exists(required, lambda r: F.size(F.array_except(r, f)) == 0)
        return bound(found, lambda f: F.struct(F.size(words).cast("long").alias("n_words"), f.alias("found"), F.when(may(f), words).alias("words")))

    rows = docs.select(F.col(doc_id).alias("doc_id"), bound(words_of(common.text_or_empty(text)), cut).alias("r"))
    rows = common.materialize(rows.select("doc_id", "r.*"), "license-words")
    counts = {r["w"]: r["count"] for r in rows.select(F.explode(F.concat("found", F.array(F.lit("")))).alias("w")).groupBy("w").count().collect()}  # the vocabulary at most
    n = counts.pop("", 0)
    listed = postings(known, {w: math.log((n + 1) / (counts.get(w, 0) + 1)) for w in vocabulary})

    indexed = _listed(sorted({p[0] for p in listed} | {p[0] for p in base.values()}))
    fields = lambda **c: F.struct(*[(v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in c.items()])
    index = F.array(*[fields(word=w, t=t, k=k, votes=v) for w, t, k, v in listed])
    every = F.array(*[fields(label=t.label, words=_listed(t.words), phrases=F.array(*[fields(a=a, b=b) for a, b in t.phrases])) for t in known])
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")

    def read(words: Column) -> Column:
        hits = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.array_contains(indexed, F.get(words, i)))

        def places(h: Column) -> Column:
            at = lambda p: F.filter(h, lambda i: F.slice(words, i + 1, F.lit(len(p))) == _listed(p))
            standing = F.transform(_candidates(words, h, index), lambda c: fields(label=F.get(every, c["t"])["label"], share=_share(words, c["s"], F.get(every, c["t"]))))
            return fields(**{f"b{k}": at(p) for k, p in enumerate(base.values())}, more=F.filter(standing, lambda x: x["share"].isNotNull()))

        def shaped(f: Column) -> Column:
            all_base = F.concat(*[f[f"b{k}"] for k in range(len(base))])
            own = F.array_compact(F.array(*[F.when(F.size(f[f"b{k}"]) > 0, F.lit(x)) for k, x in enumerate(base)]))
            score = F.greatest(F.when(F.size(all_base) > 0, F.lit(1.0)), F.array_max(F.transform(f["more"], lambda x: x["share"])))
            return fields(
                n_base=F.size(all_base).cast("long"), first_word=F.array_min(all_base).cast("long"), last_word=F.array_max(all_base).cast("long"), base_labels=joined(own),
                labels=joined(F.concat(own, F.transform(f["more"], lambda x: x["label"]))), score=F.coalesce(score, F.lit(0.0)),
            )

        return bound(hits, lambda h: bound(places(h), shaped))

    nothing = fields(n_base=F.lit(0).cast("long"), first_word=F.lit(None).cast("long"), last_word=F.lit(None).cast("long"), base_labels="", labels="", score=0.0)
    return rows.select("doc_id", "n_words", F.when(F.col("words").isNotNull(), read(F.col("words"))).otherwise(nothing).alias("f")).select("doc_id", "n_words", "f.*")


def oracle(notices: dict[str, str] = NOTICES, texts: dict[str, list[str]] = TEXTS) -> str:
    """DuckDB SQL for scan() over documents, without an index: a template stands where its key phrases do, with COVERAGE of its words."""
    quoted = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    rows = ", ".join(f"({n}, '{t.label}', {quoted(t.words)}, [{', '.join(f'[{a}, {b}]' for a, b in t.phrases)}])" for n, t in enumerate(templates(notices, texts)))
    places = ", ".join(f"list_filter(range(len(w)), lambda i: w[i + 1:i + {len(p.split())}] = {quoted(p.split())}) AS b{k}" for k, p in enumerate(BASE))
    own = ", ".join(f"CASE WHEN len(b{k}) > 0 THEN '{x}' END" for k, x in enumerate(BASE.values()))
    joined = lambda x: f"array_to_string(list_sort(list_distinct(list_filter({x}, lambda x: x IS NOT NULL))), ',')"
    every = "list_concat(list_concat(b0, b1), b2)"
    return f"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM documents),
tm(t, label, tw, ph) AS (VALUES {rows}),
st AS (SELECT d.id, d.w, tm.*, unnest(list_filter(range(len(w)), lambda i: w[i + 1:i + ph[1][2] - ph[1][1]] = tw[ph[1][1] + 1:ph[1][2]])) - ph[1][1] AS s
  FROM d, tm WHERE list_has_all(w, tw[ph[1][1] + 1:ph[1][2]])),
ok AS (SELECT id, label, len(list_filter(range(len(tw)), lambda k: s + k >= 0 AND w[s + k + 1] = tw[k + 1])) / len(tw)::DOUBLE AS share FROM st
  WHERE len(list_filter(ph, lambda p: s + p[1] < 0 OR w[s + p[1] + 1:s + p[2]] <> tw[p[1] + 1:p[2]])) = 0),
m AS (SELECT id, list(label) AS more, max(share) AS share FROM ok WHERE share >= {COVERAGE} GROUP BY 1),
b AS (SELECT id, doc_id, w, {places} FROM d)
SELECT doc_id, len(w)::BIGINT AS n_words, len({every})::BIGINT AS n_base, list_min({every})::BIGINT AS first_word, list_max({every})::BIGINT AS last_word,
  {joined(f"[{own}]")} AS base_labels, {joined(f"list_concat([{own}], coalesce(more, []))")} AS labels,
  CASE WHEN len({every}) > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0.0::DOUBLE) END AS score
FROM b LEFT JOIN m USING (id)"""
