"""License scans by MinHash bands over text windows, in DataFrame functions only.

Texts and templates become shingles of five words.  Templates fall into size
classes; a class has windows that overlap so that some window holds any
occurrence whole, with a Jaccard similarity of about a third or more to the
template.  With BANDS bands of one MinHash each, such a window meets the
template's signature with probability above 0.9999.  Windows that meet a
template are verified by exact containment of its shingles.

With one MinHash a band, a window can only meet a template if it holds one of
the template's own shingles, so windows without any are not hashed: that
leaves out work, never a collision.  Templates are a fixed list, which bounds
what is sent to the tasks.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import free_name, quoted

SHINGLE = 5
CONTAINMENT = 0.8
BANDS = 24

# Wording of public license texts and notices.
TEMPLATES = {
    "apache-2.0:line": "Licensed under the Apache License, Version 2.0",
    "gpl-3.0:line": "This work is licensed under the GNU General Public License, version 3",
    "mit:line": "Released under the MIT License",
    "mit:line-2": "Licensed under the MIT License",
    "cc-by-nc-4.0:line": "Licensed under CC BY-NC 4.0",
    "cc-by-4.0:line": "Licensed under CC BY 4.0",
    "cc-by-sa-4.0:line": "Licensed under CC BY-SA 4.0",
    "cc-by-4.0:notice": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-sa-4.0:notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "cc-by-nc-4.0:notice": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    "bsd:line": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file",
    "mpl-2.0:notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "apache-2.0:notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "gpl-3.0:notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "gpl-2.0:notice": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "mit:text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "isc:text": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.',
    "bsd-2-clause:text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "unlicense:text": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}
#: Names of licenses in running text, whatever verb comes before; five words at
#: least, for a shorter one is no shingle of a text.
NAMES = {
    "apache-2.0": ["Apache License, Version 2.0", "the Apache License 2.0", "the Apache 2.0 License", "www.apache.org/licenses/LICENSE-2.0"],
    "gpl-2.0": ["GNU General Public License version 2", "GNU General Public License v2", "GNU General Public License 2.0"],
    "gpl-3.0": ["GNU General Public License version 3", "GNU General Public License v3", "GNU General Public License 3.0"],
    "lgpl-2.0": ["GNU Library General Public License version 2", "GNU Library General Public License v2"],
    "lgpl-2.1": ["GNU Lesser General Public License version 2.1", "GNU Lesser General Public License v2.1"],
    "lgpl-3.0": ["GNU Lesser General Public License version 3", "GNU Lesser General Public License v3"],
    "agpl-3.0": ["GNU Affero General Public License version 3", "GNU Affero General Public License v3"],
    "mpl-1.1": ["Mozilla Public License Version 1.1"],
    "mpl-2.0": ["Mozilla Public License Version 2.0", "Mozilla Public License, v. 2.0", "Mozilla Public License 2.0"],
    "epl-1.0": ["Eclipse Public License Version 1.0", "Eclipse Public License v1.0", "Eclipse Public License - v 1.0"],
    "epl-2.0": ["Eclipse Public License Version 2.0", "Eclipse Public License v2.0", "Eclipse Public License - v 2.0"],
    "bsl-1.0": ["Boost Software License, Version 1.0", "Boost Software License 1.0"],
    "artistic-2.0": ["the Artistic License 2.0", "Artistic License, Version 2.0"],
    "cc0-1.0": ["CC0 1.0 Universal Public Domain Dedication", "CC0 1.0 Universal (CC0 1.0) Public Domain Dedication", "creativecommons.org/publicdomain/zero/1.0"],
    "mit": [f"{x} the MIT License" for x in ("terms of", "distributed under", "available under", "published under", "provided under", "is under", "subject to")],
    "isc": [f"{x} the ISC License" for x in ("terms of", "released under", "licensed under", "distributed under")],
    "zlib": [f"{x} the zlib License" for x in ("terms of", "released under", "licensed under", "distributed under")],
    "bsd-2-clause": ["the BSD 2-Clause License", "the 2-clause BSD License", "the Simplified BSD License terms"],
    "bsd-3-clause": ["the BSD 3-Clause License", "the 3-clause BSD License"],
    "bsd": [f"{x} the BSD License" for x in ("terms of", "released under", "licensed under", "distributed under")],
}
TEMPLATES |= {f"{i}:name" + f"-{k}" * (k > 1): t for i, ts in NAMES.items() for k, t in enumerate(ts, 1)}
CC = {"by": "Attribution", "by-sa": "Attribution-ShareAlike", "by-nc": "Attribution-NonCommercial", "by-nd": "Attribution-NoDerivatives", "by-nc-sa": "Attribution-NonCommercial-ShareAlike", "by-nc-nd": "Attribution-NonCommercial-NoDerivatives"}
for _kind, _long in CC.items():
    for _version, _port in (("4.0", "International"), ("3.0", "Unported"), ("2.5", "Generic"), ("2.0", "Generic")):
        TEMPLATES.setdefault(f"cc-{_kind}-{_version}:notice", f"This work is licensed under a Creative Commons {_long} {_version} {_port} License")
        TEMPLATES[f"cc-{_kind}-{_version}:url"] = f"creativecommons.org/licenses/{_kind}/{_version}"
        if _version in ("4.0", "3.0"):
            TEMPLATES.setdefault(f"cc-{_kind}-{_version}:line", f"Licensed under CC {_kind.upper()} {_version}")
_GNU = "{0} is free software; you can redistribute it and/or modify it under the terms of the GNU {1} as published by the Free Software Foundation; either version {2} of the License, or (at your option) any later version. {0} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {1} for more details."
#: Notices, short texts, and passages of long texts that no other license has.
TEMPLATES |= {
    "lgpl-2.0:notice": _GNU.format("This library", "Library General Public License", "2"),
    "lgpl-2.1:notice": _GNU.format("This library", "Lesser General Public License", "2.1"),
    "lgpl-3.0:notice": _GNU.format("This program", "Lesser General Public License", "3"),
    "agpl-3.0:notice": _GNU.format("This program", "Affero General Public License", "3"),
    "gpl-2.0:text": "The licenses for most software are designed to take away your freedom to share and change it. By contrast, the GNU General Public License is intended to guarantee your freedom to share and change free software--to make sure the software is free for all its users. This General Public License applies to most of the Free Software Foundation's software and to any other program whose authors commit to using it.",
    "gpl-3.0:text": "The GNU General Public License is a free, copyleft license for software and other kinds of works. The licenses for most software and other practical works are designed to take away your freedom to share and change the works. By contrast, the GNU General Public License is intended to guarantee your freedom to share and change all versions of a program--to make sure it remains free software for all its users.",
    "lgpl-2.1:text": "This license, the Lesser General Public License, applies to some specially designated software packages--typically libraries--of the Free Software Foundation and other authors who decide to use it. You can use it too, but we suggest you first think carefully about whether this license or the ordinary General Public License is the better strategy to use in any particular case, based on the explanations below.",
    "lgpl-3.0:text": "This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below.",
    "agpl-3.0:text": "The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software.",
    "apache-2.0:text": "Grant of Copyright License. Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form.",
    "mpl-2.0:text": "Covered Software is provided under this License on an \"as is\" basis, without warranty of any kind, either expressed, implied, or statutory, including, without limitation, warranties that the Covered Software is free of defects, merchantable, fit for a particular purpose or non-infringing.",
    "epl:text": 'THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS ECLIPSE PUBLIC LICENSE ("AGREEMENT"). ANY USE, REPRODUCTION OR DISTRIBUTION OF THE PROGRAM CONSTITUTES RECIPIENT\'S ACCEPTANCE OF THIS AGREEMENT.',
    "bsd-3-clause:text": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd-4-clause:text": "All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by",
    "zlib:text": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "bsl-1.0:text": 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so',
    "artistic-2.0:text": "This license establishes the terms under which a given free software Package may be copied, modified, distributed, and/or redistributed. The intent is that the Copyright Holder maintains some artistic control over the development of that Package while still keeping the Package available as open source and free software.",
    "cc0-1.0:text": "To the greatest extent permitted by, but not in contravention of, applicable law, Affirmer hereby overtly, fully, permanently, irrevocably and unconditionally waives, abandons, and surrenders all of Affirmer's Copyright and Related Rights",
    "ofl-1.1:line": "This Font Software is licensed under the SIL Open Font License, Version 1.1",
}
#: Near wordings of one family: in a window only the best of them counts.
FAMILIES = r"^(?:[al]?gpl|cc-by|mpl|epl)"
#: A tag names its licenses itself; ids are joined by and, or, with.
SPDX_ID = r"[a-z0-9](?:[a-z0-9.+-]*[a-z0-9+])?"
SPDX = rf"(?<![a-z0-9])spdx-license-identifier[\"']?\s*[:=][\s\"'(]*({SPDX_ID}(?:[ )]+(?:and|or|with)[ (]+{SPDX_ID})*)"
#: What separates words; the same in Java's and Python's expressions.
GAP = r"[^a-z0-9]+"


def words(text: str) -> list[str]:
    return [w for w in re.split(GAP, text.lower()) if w]


def shingles(tokens: list[str]) -> list[str]:
    """Five-word shingles; fewer words are one shingle."""
    if not tokens:
        return []
    return [" ".join(tokens[i : i + SHINGLE]) for i in range(max(1, len(tokens) - SHINGLE + 1))]


def size_class(n: int) -> int:
    """Smallest power of two that holds ``n`` shingles."""
    return 1 << (n - 1).bit_length()


def window(size: int) -> tuple[int, int]:
    """(stride, length) in shingles of a class: any run of ``size`` shingles
    lies whole in some window."""
    stride = max(1, size // 2)
    return stride, size + stride - 1


def gate_words(templates: dict[str, str]) -> list[str]:
    """Words one of which any match must hold: at least CONTAINMENT of a
    template's shingles are in a match, so words that cover more than the rest
    of each template's shingles suffice.  Greedy, long words first."""
    left = {n: set(s) for n, t in templates.items() if (s := shingles(words(t)))}
    need = {n: len(s) * CONTAINMENT for n, s in left.items()}
    out = []
    while open_ := [n for n in left if len(left[n]) >= need[n]]:
        gain = Counter()
        for n in open_:
            total = len(set(shingles(words(templates[n]))))
            for w in {w for s in left[n] for w in s.split(" ")}:
                gain[w] += sum(w in s.split(" ") for s in left[n]) / total
        best = max(gain, key=lambda w: (min(len(w), 6), gain[w], w))
        out.append(best)
        left = {n: {s for s in ss if best not in s.split(" ")} for n, ss in left.items()}
    return out


def _hash(x: Column, seed: Column | int) -> Column:
    return F.xxhash64(x, F.lit(seed) if isinstance(seed, int) else seed)


class Templates:
    """Shingle hashes and signatures of the templates, computed by the same
    expressions as those of texts (a fixed number of rows)."""

    def __init__(self, spark: SparkSession, templates: dict[str, str] | None = None):
        templates = templates or TEMPLATES
        rows = [(name, sorted(set(shingles(words(t))))) for name, t in templates.items() if words(t)]
        df = spark.createDataFrame(rows, "name string, shingles array<string>").select("name", F.transform("shingles", lambda s: F.xxhash64(s)).alias("h"))
        signed = df.select("name", "h", signature(F.col("h")).alias("sig"))
        self.rows = [(r.name, list(r.h), list(r.sig)) for r in signed.collect()]
        self.by_class: dict[int, list[tuple[str, list[int], list[int]]]] = {}
        for row in self.rows:
            self.by_class.setdefault(size_class(len(row[1])), []).append(row)
        self.gate = gate_words(templates)
        self.known = sorted({h for _, hs, _ in self.rows for h in hs})


def signature(h: Column) -> Column:
    """BANDS MinHashes of an array of hashes."""
    return F.transform(F.sequence(F.lit(1), F.lit(BANDS)), lambda k: F.array_min(F.transform(h, lambda x: _hash(x, k))))


def longs(values: list[int]) -> Column:
    return F.array(*(F.lit(v).cast("bigint") for v in values))


def windows_of(size: int, rows: list[tuple[str, list[int], list[int]]], match: str) -> Column:
    """Verified matches of one size class's templates, over _h and _i."""
    stride, length = window(size)

    def over(i: Column) -> Column:
        return F.sequence(F.greatest(F.lit(0), F.floor((i - length) / stride).cast("int") + 1), F.floor(i / stride).cast("int"))

    def one(w: Column) -> Column:
        part = F.slice(F.col("_h"), (w * stride + 1).cast("int"), length)

        def tests(sig: Column) -> Column:
            out = []
            for name, hashes, own in rows:
                contained = F.size(F.array_intersect(longs(hashes), part)) / F.lit(len(hashes))
                made = F.struct(F.lit(name).alias("name"), (w * stride).cast("int").alias("start"), contained.cast("double").alias("contained"))
                out.append(F.when(F.arrays_overlap(sig, longs(own)) & (contained >= CONTAINMENT), made))
            return F.array_compact(F.array(*out))

        # an array of one element stands for a variable: one signature a window
        return F.flatten(F.transform(F.array(signature(part)), tests))

    # every window that holds a template shingle
    at = F.array_distinct(F.flatten(F.transform(F.col("_i"), over)))
    return F.flatten(F.transform(at, one)).cast(match)


def find(docs: DataFrame, templates: Templates) -> DataFrame:
    """``docs`` with ``licenses``: array of struct(name, start, contained) of
    every verified window, ``start`` in words from 0.

    Rows are independent: no shuffle, repeated rows give repeated results.  A
    null or empty text has no license; texts may be of any length.  Matches of
    one window come in the order of the templates.  All columns of ``docs``
    stay as they are; if one is named ``licenses``, the result's name gets an
    underscore in front (``common.free_name``)."""
    held = docs.select(F.struct(*map(quoted, docs.columns)).alias("_row"), F.col("text").cast("string").alias("_text"))
    text = F.coalesce(F.lower("_text"), F.lit(""))
    likely = F.lit(False)
    for w in templates.gate:
        likely = likely | F.contains(text, F.lit(w))
    empty = "array<bigint>"
    tokens = F.filter(F.split(text, GAP), lambda w: w != "")
    joined = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size("_w") - SHINGLE + 1, F.lit(1))),
        lambda i: F.xxhash64(F.array_join(F.slice(F.col("_w"), i, SHINGLE), " ")),
    )
    df = held.withColumn("_w", F.when(likely, tokens).otherwise(F.array().cast("array<string>")))
    df = df.withColumn("_h", F.when(F.size("_w") > 0, joined).otherwise(F.array().cast(empty)))
    hits = F.filter(F.sequence(F.lit(0), F.size("_h") - 1), lambda i: F.get(F.col("_h"), i).isin([F.lit(v).cast("bigint") for v in templates.known]))
    df = df.withColumn("_i", F.when(F.size("_h") > 0, hits).otherwise(F.array().cast("array<int>")))
    match = "array<struct<name:string,start:int,contained:double>>"
    found = [windows_of(size, rows, match) for size, rows in sorted(templates.by_class.items())]
    none = F.array().cast(match)
    result = F.when(F.size("_i") > 0, F.flatten(F.array(*found))).otherwise(none)
    return df.select("_row", result.alias("_found")).select("_row.*", F.col("_found").alias(free_name(docs, "licenses")))


def spdx_ids(text: Column) -> Column:
    """License ids of a text's SPDX tags in lower case, without -only,
    -or-later and +, and without the exceptions after ``with``."""
    tags = F.regexp_extract_all(F.lower(text), F.lit(SPDX), F.lit(1))
    ids = F.flatten(F.transform(tags, lambda t: F.split(F.regexp_replace(t, rf"[ )]+with[ (]+{SPDX_ID}", ""), r"[ )]+(?:and|or)[ (]+")))
    return F.coalesce(F.transform(ids, lambda i: F.regexp_replace(i, r"(?:-only|-or-later|\+)$", "")), F.array().cast("array<string>"))


def best_of_family(found: Column) -> Column:
    """Matches without those that a nearer wording of their family beats in
    the same window: a notice of the LGPL holds most of the GPL's."""
    family = lambda m: F.regexp_extract(m["name"], FAMILIES, 0)
    kin = lambda a, b: (family(a) != "") & (F.regexp_replace(family(a), "^[al]", "") == F.regexp_replace(family(b), "^[al]", ""))
    kind = lambda m: F.regexp_extract(m["name"], ":([a-z]+)", 1)
    return F.filter(found, lambda m: ~F.exists(found, lambda o: (o["start"] == m["start"]) & (o["contained"] > m["contained"]) & (kind(o) == kind(m)) & kin(m, o)))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_licenses, licenses, templates of every row: the distinct
    license ids (those of SPDX tags too) and template names found, sorted and
    joined by commas."""
    found = find(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), Templates(docs.sparkSession))
    names = F.array_sort(F.array_distinct(F.transform("licenses", lambda m: m["name"])))
    own = F.transform(best_of_family(F.col("licenses")), lambda m: F.element_at(F.split(m["name"], ":"), 1))
    ids = F.array_sort(F.array_distinct(F.concat(own, spdx_ids(F.col("text").cast("string")))))
    return found.select("doc_id", F.size(ids).cast("bigint").alias("n_licenses"), F.array_join(ids, ",").alias("licenses"), F.array_join(names, ",").alias("templates"))
