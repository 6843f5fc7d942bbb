"""Licence scan: units of text against licence notices, by the Dice coefficient over word bigrams.

Units are the lines of a text, its paragraphs of more than one line (parted by blank lines), and the whole text if it has
several paragraphs. Words are runs of [a-z0-9] of the lower-cased text. A unit matches a notice if
``2 |A & B| / (|A| + |B|)`` of their sets of word bigrams is ``DICE`` percent or more. Within longer lines, paragraphs and
comments, runs of words of a notice's length are compared as well (``windows``; the SQL twin has only the units).

Two exact bounds come before any comparison. Size: with threshold t a match needs |A| between |B| t / (2 - t) and
|B| (2 - t) / t, so a unit meets only notices of its size, and none if it is longer than all allow. Anchors: a match shares
at least |B| t / (2 - t) bigrams with the notice, hence one of any |B| - ceil(|B| t / (2 - t)) + 1 of them; of the rarest
such choice the longer word of each bigram must be in the unit, so a unit without an anchor word goes unread.

All of it is SQL expressions within a row: no shuffle, no Python. The notices are a constant of the plan: customary
wordings, titles, and the texts of MIT, ISC, BSD, Apache, GPL, LGPL, MPL and CC0 by paragraph; of AGPL and CC what differs
from the GPL or names the licence.

Edge cases: a null or empty text, and units of fewer than two words, match nothing. Repeated rows are scanned alike. Equal
Dice values: the notice that comes first by name. An empty table gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulens.llm import licence_texts
from tabulens.llm.common import col

DICE = 80

# Notices of well-known licences; WORDINGS and the paragraphs of their texts join them below.
NOTICES = {
    "agpl-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    "bsd-2-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-notice": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "bsl-1.0": "Distributed under the Boost Software License, Version 1.0.",
    "cc-by-4.0": "This work is licensed under the Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-nc-4.0-long": "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License.",
    "cc-by-sa-4.0": "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc-by-short": "Licensed under CC BY 4.0.",
    "cc-by-sa-short": "Licensed under CC BY-SA 4.0.",
    "cc0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "epl-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "gpl-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "lgpl-2.1": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "mit": "Released under the MIT License.",
    "mit-permission": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction',
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
}

_MIT_WARRANTY = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_BSD_SOURCE = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
_BSD_BINARY = "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_NAMES = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_WARRANTY = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_CC = "By exercising the Licensed Rights (defined below), You accept and agree to be bound by the terms and conditions of this Creative Commons {} 4.0 International Public License (\"Public License\"). To the extent this Public License may be interpreted as a contract, You are granted the Licensed Rights in consideration of Your acceptance of these terms and conditions, and the Licensor grants You such rights in consideration of benefits the Licensor receives from making the Licensed Material available under these terms and conditions."
_CC_KINDS = {"by": "Attribution", "by-sa": "Attribution-ShareAlike", "by-nc": "Attribution-NonCommercial", "by-nd": "Attribution-NoDerivatives", "by-nc-sa": "Attribution-NonCommercial-ShareAlike", "by-nc-nd": "Attribution-NonCommercial-NoDerivatives"}
_SPDX = "MIT ISC Apache-2.0 BSD-2-Clause BSD-3-Clause MPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later AGPL-3.0-only AGPL-3.0-or-later CC0-1.0 CC-BY-4.0 CC-BY-SA-4.0 BSL-1.0 EPL-2.0 Unlicense Zlib"

# Customary wordings, and the paragraphs of short licences; a paragraph of BSD-2 and BSD-3 is ``bsd-shared``.
WORDINGS = {
    "agpl-3.0-licensed": "Licensed under the GNU Affero General Public License v3.0.",
    "agpl-3.0-preamble": "The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software.",
    "agpl-3.0-network": "Notwithstanding any other provision of this License, if you modify the Program, your modified version must prominently offer all users interacting with it remotely through a computer network (if your version supports such interaction) an opportunity to receive the Corresponding Source of your version by providing access to the Corresponding Source from a network server at no charge, through some standard or customary means of facilitating copying of software.",
    "agpl-3.0-title": "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
    "agpl-title": "GNU AFFERO GENERAL PUBLIC LICENSE",
    "apache-2.0-licensed": "Licensed under the Apache License 2.0.",
    "apache-2.0-released": "Released under the Apache License, Version 2.0.",
    "apache-2.0-released-short": "Released under the Apache License 2.0.",
    "apache-2.0-short": "Licensed under Apache 2.0.",
    "apache-2.0-project": "This project is licensed under the Apache License 2.0 - see the LICENSE file for details.",
    "apache-2.0-title": "Apache License Version 2.0, January 2004",
    "apache-2.0-title-short": "Apache License, Version 2.0",
    "apache-2.0-warranty": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "bsd-2-clause-body": f"{NOTICES['bsd-2-clause']} 1. {_BSD_SOURCE} 2. {_BSD_BINARY} {_BSD_WARRANTY}",
    "bsd-2-clause-licensed": "Licensed under the BSD 2-Clause License.",
    "bsd-2-clause-title": "BSD 2-Clause License",
    "bsd-3-clause": _BSD_NAMES,
    "bsd-3-clause-body": f"{NOTICES['bsd-2-clause']} 1. {_BSD_SOURCE} 2. {_BSD_BINARY} 3. {_BSD_NAMES} {_BSD_WARRANTY}",
    "bsd-3-clause-terms": f"{NOTICES['bsd-2-clause']} 1. {_BSD_SOURCE} 2. {_BSD_BINARY} 3. {_BSD_NAMES}",
    "bsd-3-clause-licensed": "Licensed under the BSD 3-Clause License.",
    "bsd-3-clause-title": "BSD 3-Clause License",
    "bsd-licensed": "Licensed under the BSD License.",
    "bsd-shared-binary": _BSD_BINARY,
    "bsd-shared-source": _BSD_SOURCE,
    "bsd-shared-warranty": _BSD_WARRANTY,
    **{f"cc-{k}-4.0-public": _CC.format(v) for k, v in _CC_KINDS.items()},
    **{f"cc-{k}-4.0-title": f"Creative Commons {v} 4.0 International Public License" for k, v in _CC_KINDS.items()},
    **{f"cc-{k}-4.0-work": f"This work is licensed under a Creative Commons {v} 4.0 International License." for k, v in _CC_KINDS.items()},
    "cc0-1.0-title": "CC0 1.0 Universal",
    "gpl-2.0-header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl-2.0-licensed": "Licensed under the GNU General Public License v2.0.",
    "gpl-2.0-title": "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
    "gpl-3.0-licensed": "Licensed under the GNU General Public License v3.0.",
    "gpl-3.0-title": "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "gpl-title": "GNU GENERAL PUBLIC LICENSE",
    "gpl-warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "isc-licensed": "Licensed under the ISC License.",
    "isc-title": "ISC License",
    "isc-warranty": 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "lgpl-2.1-title": "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
    "lgpl-3.0-header": "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "lgpl-3.0-title": "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "lgpl-title": "GNU LESSER GENERAL PUBLIC LICENSE",
    "mit-distributed": "Distributed under the MIT License.",
    "mit-licensed": "Licensed under the MIT License.",
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-permission-full": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "mit-project": "This project is licensed under the MIT License - see the LICENSE file for details.",
    "mit-project-short": "This project is licensed under the MIT License.",
    "mit-title": "MIT License",
    "mit-title-long": "The MIT License (MIT)",
    "mit-title-the": "The MIT License",
    "mit-warranty": _MIT_WARRANTY,
    "mpl-2.0-licensed": "Licensed under the Mozilla Public License 2.0.",
    "mpl-2.0-title": "Mozilla Public License Version 2.0",
    **{f"{k.lower()}-spdx": f"SPDX-License-Identifier: {k}" for k in _SPDX.split()},
}
NOTICES |= WORDINGS | licence_texts.PARAGRAPHS


def bigrams_of(text: str) -> list[str]:
    """The distinct word bigrams of a text, in order."""
    words = re.findall("[a-z0-9]+", text.lower())
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:])))


def _anchor_bigrams(grams: list[str], dice: int) -> list[str]:
    """Bigrams of which every match has one: those with the longest words, as these are rare in ordinary text."""
    shared = math.ceil(len(grams) * dice / (200 - dice))
    return sorted(grams, key=lambda b: (-len(_anchor(b)), b))[: len(grams) - shared + 1]


def _anchor(bigram: str) -> str:
    return max(bigram.split(), key=lambda w: (len(w), w))


def anchors(notices: Mapping[str, str], dice: int = DICE) -> list[str]:
    """Words of which every unit that matches any notice has one."""
    out = {_anchor(b) for text in notices.values() for b in _anchor_bigrams(bigrams_of(text), dice)}
    return sorted(out)


def _grams(w: Column) -> Column:
    return F.array_distinct(F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w) - 1), lambda a, b: F.concat(a, F.lit(" "), b)))


def matches(text: Column, notices: Mapping[str, str] = NOTICES, dice: int = DICE) -> Column:
    """array<struct<kind, unit, licence, dice>> of a text column, in order of units; the first notice by name is first."""
    sets = {name: grams for name, source in sorted(notices.items()) if (grams := bigrams_of(source))}
    if not sets:
        return F.array().cast("array<struct<kind:string,unit:int,licence:string,dice:double>>")
    longest = max(map(len, sets.values())) * (200 - dice) // dice
    # One text that Spark folds into a constant: a literal for each bigram would take minutes to build.
    table = F.from_json(F.lit(json.dumps([{"name": name, "grams": grams} for name, grams in sets.items()])), "array<struct<name:string,grams:array<string>>>")
    low = F.lower(F.coalesce(text, F.lit("")))

    def kind_of(parts: Column, kind: str) -> Column:
        return F.transform(parts, lambda t, i: F.struct(F.lit(kind).alias("kind"), i.alias("unit"), t.alias("t")))

    paragraphs = F.split(low, "\n[ \t]*\n")
    several = F.filter(kind_of(paragraphs, "paragraph"), lambda u: F.contains(u["t"], F.lit("\n")))
    whole = F.filter(kind_of(F.array(low), "text"), lambda u: F.size(paragraphs) > 1)
    units = F.concat(kind_of(F.split(low, "\n"), "line"), several, whole)
    words = F.transform(units, lambda u: F.struct(u["kind"].alias("kind"), u["unit"].alias("unit"), F.split(F.trim(F.regexp_replace(u["t"], "[^a-z0-9]+", " ")), " ").alias("w")))
    read = F.filter(words, lambda u: (F.size(u["w"]) > 1) & F.exists(u["w"], lambda w: w.isin(anchors(notices, dice))))

    sized = F.transform(read, lambda u: F.struct(u["kind"].alias("kind"), u["unit"].alias("unit"), _grams(u["w"]).alias("g")))
    sized = F.filter(sized, lambda u: F.size(u["g"]) <= longest)

    def against(u: Column) -> Column:
        n = F.size(u["g"])
        fits = F.filter(table, lambda t: (n * (200 - dice) >= F.size(t["grams"]) * dice) & (n * dice <= F.size(t["grams"]) * (200 - dice)))
        counted = F.transform(fits, lambda t: F.struct(t["name"].alias("name"), F.size(F.array_intersect(u["g"], t["grams"])).alias("both"), (n + F.size(t["grams"])).alias("all")))
        enough = F.filter(counted, lambda t: t["both"] * 200 >= t["all"] * dice)
        return F.transform(enough, lambda t: F.struct(u["kind"].alias("kind"), u["unit"].alias("unit"), t["name"].alias("licence"), (t["both"] * 2 / t["all"]).alias("dice")))

    return F.flatten(F.transform(sized, against))


def windows(text: Column, notices: Mapping[str, str] = NOTICES, dice: int = DICE) -> Column:
    """array<struct<licence, start, dice>>: runs of words anywhere in a text that match a notice; of overlapping runs for one notice the best.

    A run has as many words as the notice and lies so that it shares one of the notice's anchor bigrams at its place. Titles
    are left out: the name of a licence within prose is no notice.
    """
    table, places = [], {}
    for name, source in sorted(notices.items()):
        grams, words = bigrams_of(source), re.findall("[a-z0-9]+", source.lower())
        if not grams or "-title" in name:
            continue
        for b in _anchor_bigrams(grams, dice):
            places.setdefault(b, []).extend({"k": len(table), "q": q} for q in range(len(words) - 1) if f"{words[q]} {words[q + 1]}" == b)
        table.append({"name": name, "n": len(words), "grams": grams})
    if not table:
        return F.array().cast("array<struct<licence:string,start:int,dice:double>>")
    constant = F.from_json(F.lit(json.dumps(table)), "array<struct<name:string,n:int,grams:array<string>>>")
    where = F.from_json(F.lit(json.dumps(places)), "map<string,array<struct<k:int,q:int>>>")
    words = F.split(F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " ")), " ")
    # A text without an anchor word goes no further.
    read = F.filter(F.array(words), lambda w: (F.size(w) > 1) & F.exists(w, lambda x: x.isin(anchors(notices, dice))))

    def measured(w: Column, c: Column, t: Column) -> Column:
        run = F.slice(w, c["start"] + 1, t["n"])
        return F.transform(F.array(_grams(run)), lambda g: F.struct(t["name"].alias("licence"), c["start"].alias("start"), t["n"].alias("n"), F.size(F.array_intersect(g, t["grams"])).alias("both"), (F.size(g) + F.size(t["grams"])).alias("all")))

    def found(w: Column) -> Column:
        pairs = F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w) - 1), lambda a, b: F.concat(a, F.lit(" "), b))
        known = F.filter(F.transform(pairs, lambda b, i: F.struct(b.alias("b"), i.alias("i"))), lambda x: x["b"].isin(list(places)))
        starts = F.flatten(F.transform(known, lambda x: F.transform(F.element_at(where, x["b"]), lambda t: F.struct(F.greatest(F.lit(0), x["i"] - t["q"]).alias("start"), t["k"].alias("k")))))
        tried = F.flatten(F.transform(F.array_distinct(starts), lambda c: F.flatten(F.transform(F.array(F.get(constant, c["k"])), lambda t: measured(w, c, t)))))
        return F.filter(tried, lambda x: x["both"] * 200 >= x["all"] * dice)

    def best(x: Column, y: Column) -> Column:
        near = (x["licence"] == y["licence"]) & (F.abs(x["start"] - y["start"]) < x["n"])
        ahead = (y["both"] * x["all"] > x["both"] * y["all"]) | ((y["both"] * x["all"] == x["both"] * y["all"]) & (y["start"] < x["start"]))
        return near & ahead

    kept = F.flatten(F.transform(F.transform(read, found), lambda f: F.filter(f, lambda x: ~F.exists(f, lambda y: best(x, y)))))
    return F.transform(kept, lambda x: F.struct(x["licence"].alias("licence"), x["start"].alias("start"), (x["both"] * 2 / x["all"]).alias("dice")))


def license_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_matches, licences (names in order, joined by commas), best, best_dice for every row.

    A notice with more runs of words than matching units counts for each run beyond them.
    """
    found = docs.select(col(doc_id).alias("doc_id"), matches(col(text).cast("string")).alias("u"), windows(col(text).cast("string")).alias("r"))
    units = lambda x: F.size(F.filter("u", lambda y: y["licence"] == x["licence"]))
    earlier = lambda x: F.size(F.filter("r", lambda y: (y["licence"] == x["licence"]) & ((y["dice"] > x["dice"]) | ((y["dice"] == x["dice"]) & (y["start"] < x["start"])))))
    short = lambda x: F.struct(x["licence"].alias("licence"), x["dice"].alias("dice"))
    found = found.select("doc_id", F.concat(F.transform("u", short), F.transform(F.filter("r", lambda x: earlier(x) >= units(x)), short)).alias("m"))
    best = F.array_min(F.transform("m", lambda x: F.struct((-x["dice"]).alias("d"), x["licence"].alias("licence"))))
    return found.select(
        "doc_id", F.size("m").cast("long").alias("n_matches"), F.array_join(F.array_sort(F.array_distinct(F.transform("m", lambda x: x["licence"]))), ",").alias("licences"),
        best["licence"].alias("best"), F.round(F.coalesce(-best["d"], F.lit(0.0)), 6).alias("best_dice"),
    )


_QUOTED = "\n  UNION ALL ".join("SELECT '{}' AS name, '{}' AS t".format(k, v.replace("'", "''")) for k, v in NOTICES.items())
_GRAMS = "list_distinct(list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1]))"

#: The same scan in DuckDB, without the anchors.
SQL = rf"""
WITH notices AS (
  {_QUOTED}
), wanted AS (
  SELECT name, {_GRAMS} AS b FROM (SELECT name, regexp_extract_all(lower(t), '[a-z0-9]+') AS w FROM notices)
), texts AS (
  SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents
), units AS (
  SELECT doc_id, unnest(string_split(t, chr(10))) AS u FROM texts
  UNION ALL SELECT doc_id, u FROM (SELECT doc_id, unnest(string_split_regex(t, '\n[ \t]*\n')) AS u FROM texts) WHERE contains(u, chr(10))
  UNION ALL SELECT doc_id, t FROM texts WHERE len(string_split_regex(t, '\n[ \t]*\n')) > 1
), grams AS (
  SELECT doc_id, {_GRAMS} AS a FROM (SELECT doc_id, regexp_extract_all(u, '[a-z0-9]+') AS w FROM units)
), measured AS (
  SELECT doc_id, name, len(list_intersect(a, b)) AS n, len(a) + len(b) AS m FROM grams, wanted WHERE 3 * len(a) >= 2 * len(b) AND 2 * len(a) <= 3 * len(b)
), found AS (
  SELECT doc_id, count(*) AS n_matches, string_agg(DISTINCT name, ',' ORDER BY name) AS licences,
    arg_min(name, (-2.0 * n / m, name)) AS best, max(2.0 * n / m) AS d FROM measured WHERE 200 * n >= {DICE} * m GROUP BY doc_id
)
SELECT doc_id, coalesce(n_matches, 0) AS n_matches, coalesce(licences, '') AS licences, best, round(coalesce(d, 0.0)::DOUBLE, 6) AS best_dice
FROM documents LEFT JOIN found USING (doc_id)"""
