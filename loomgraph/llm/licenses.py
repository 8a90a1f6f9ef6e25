"""Operator 4, license scans: MinHash bands over overlapping windows of the text find templates, and
exact containment of a template's shingles in the window decides.

Windows of 2 L words start every L words, for each L of 16, 32, 64, ... that some template needs (the
least L of at least its words), so a notice lies whole in some window. A band is one minhash value. Whole
in its window, a template of n shingles has a Jaccard similarity of at least (n - 1) / (2 L + n) with it,
and `bands` is chosen so that all bands miss it with a probability under `miss`.

DataFrame code only, and one scan for all sizes of windows. A document, and then a window, that holds fewer
of the templates' shingles than the containment asks of the smallest template can match none: it is left
out before any band is made. The templates are a fixed, small list, bounded by MOST_TEMPLATE_WORDS, so
their tables are literals in the plan.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import columns_of

_BSD_TWO = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer "
    "in the documentation and/or other materials provided with the distribution. "
)
_BSD_THIRD = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
    "without specific prior written permission. "
)
_BSD_END = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, '
    "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS "
    "BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE "
    "GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT "
    "LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_GNU_HOPE = (
    "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS "
    "FOR A PARTICULAR PURPOSE. See the GNU {0} Public License for more details. "
)
_GNU_GRANT = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0} Public License as published by the Free Software "
    "Foundation, either version {1} of the License, or (at your option) any later version. "
)

#: Well-known license texts and notices, by SPDX-like name.
TEMPLATES = (
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("MIT", "Released under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT-grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("BSD-grant", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("GPL-grant", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("Proprietary", "All rights reserved. No part of this work may be reproduced without the prior written permission of the copyright holder."),
    ("MIT-text", (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the "
        "Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, "
        "and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be "
        "included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT "
        "LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY "
        "CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER "
        "DEALINGS IN THE SOFTWARE."
    )),
    ("BSD-2-Clause", _BSD_TWO + _BSD_END),
    ("BSD-3-Clause", _BSD_TWO + _BSD_THIRD + _BSD_END),
    ("ISC", (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this "
        "permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED "
        "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER "
        "RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR "
        "PERFORMANCE OF THIS SOFTWARE."
    )),
    ("Zlib", (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this "
        "software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to "
        "the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software "
        "in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must "
        "not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."
    )),
    ("Unlicense", (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either "
        "in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
    )),
    ("Apache-2.0-notice", (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" "
        "BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the "
        "License."
    )),
    ("MPL-2.0-notice", (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at "
        "https://mozilla.org/MPL/2.0/."
    )),
    ("EPL-2.0-notice", (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"
    )),
    ("GPL-2.0-notice", _GNU_GRANT.format("General", 2) + _GNU_HOPE.format("General")),
    ("GPL-3.0-notice", _GNU_GRANT.format("General", 3) + _GNU_HOPE.format("General")),
    ("AGPL-3.0-notice", _GNU_GRANT.format("Affero General", 3) + _GNU_HOPE.format("Affero General")),
    ("LGPL-3.0-notice", _GNU_GRANT.format("Lesser General", 3) + _GNU_HOPE.format("Lesser General")),
    ("CC0-1.0-notice", (
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."
    )),
)
MOST_TEMPLATE_WORDS = 10_000
SHINGLE = 3
#: Words are runs of lower-case letters and digits; what stands between them does not count.
TOKEN = r"[a-z0-9]+"


def tokens(text: str) -> list[str]:
    return re.findall(TOKEN, text.lower())


def window_words(n: int) -> int:
    """The step L of the windows that hold a template of n words."""
    step = 16
    while step < n:
        step *= 2
    return step


def bands_needed(words: int, step: int, containment: float, miss: float) -> int:
    """Bands of one row so that a window with that part of the template is missed with probability under miss."""
    n = max(1, words - SHINGLE + 1)
    similarity = containment * n / (2 * step + n)
    return math.ceil(math.log(miss) / math.log(1 - similarity))


def license_scan(docs: DataFrame, templates=TEMPLATES, containment: float = 0.8, miss: float = 1e-6) -> DataFrame:
    """A row (doc_id, license, containment, first_word, windows) per document and template it contains.

    Null and empty texts match nothing; a text is read whole; repeated rows of one doc_id are counted
    together; an empty table gives none. Templates of under SHINGLE words are one shingle.
    """
    if sum(len(tokens(t)) for _, t in templates) > MOST_TEMPLATE_WORDS:
        raise ValueError("the templates exceed the bound on their words")
    spark = docs.sparkSession
    # One transform over a one-element array evaluates its element once; projections alone would be
    # merged and would split the text again for every shingle.
    grams = (
        f"transform(array(regexp_extract_all(lower(text), '{TOKEN}', 0)), w -> named_struct('n', size(w), 'g', "
        f"CASE WHEN size(w) = 0 THEN array() WHEN size(w) < {SHINGLE} THEN array(xxhash64(array_join(w, ' '))) "
        f"ELSE transform(sequence(1, size(w) - {SHINGLE - 1}), i -> xxhash64(element_at(w, i), element_at(w, i + 1), element_at(w, i + 2))) END))"
    )
    rows = []
    for name, text in templates:
        n = len(tokens(text))
        rows.append((name, text, window_words(n), bands_needed(n, window_words(n), containment, miss)))
    most_bands = {step: max(b for _, _, s, b in rows if s == step) for _, _, step, _ in rows}
    known = spark.createDataFrame(rows, "license string, text string, step int, bands int")
    known = known.selectExpr("license", "step", f"array_distinct(element_at({grams}, 1).g) AS g").where("size(g) > 0")
    # The bounded template list is read back once, as literals for the plan over the documents.
    found = known.collect()
    steps = sorted({r["step"] for r in found})
    literal = lambda g: f"{g}L" if g != -(1 << 63) else "bigint('-9223372036854775808')"
    need = lambda n: max(1, math.ceil(containment * n - 1e-9))

    def enough(array: str, rows: list) -> str:
        """SQL: the array holds as many of these templates' shingles as the least demanding one asks for."""
        listed = ", ".join(literal(g) for g in sorted({g for r in rows for g in r["g"]}))
        return f"size(filter({array}, x -> x IN ({listed}))) >= {min(need(len(r['g'])) for r in rows)}"

    def windows(step: int) -> str:
        """SQL: the windows of one size that can match, each with its own shingles."""
        made = f"transform(sequence(0, greatest(0, s.n - 1), {step}), at -> named_struct('step', {step}, 'at', at, 'g', slice(s.g, at + 1, {2 * step - SHINGLE + 1})))"
        return f"filter({made}, w -> {enough('w.g', [r for r in found if r['step'] == step])})"

    if not found:
        return spark.createDataFrame([], out_schema(docs))
    hit = columns_of(docs, "doc_id", "text").selectExpr("doc_id", f"explode(filter({grams}, s -> {enough('s.g', found)})) AS s")
    rows = hit.selectExpr("doc_id", f"explode(concat({', '.join(map(windows, steps))})) AS w").select("doc_id", "w.step", "w.at", "w.g")
    bands_of = "CASE step " + " ".join(f"WHEN {step} THEN {bands}" for step, bands in sorted(most_bands.items())) + " END"
    banded = f"transform(sequence(0, {bands_of} - 1), k -> named_struct('band', k, 'low', array_min(transform(%s, x -> xxhash64(x, k)))))"
    made = rows.selectExpr("doc_id", "step", "at", "g", f"explode({banded % 'g'}) AS key").select("doc_id", "step", "at", "g", "key.band", "key.low")
    ours = spark.createDataFrame([(r["license"], r["step"], r["g"]) for r in found], "license string, step int, tg array<bigint>")
    ours = ours.selectExpr("license", "step", "tg", f"explode({banded % 'tg'}) AS key").select("license", "step", "tg", "key.band", "key.low")
    # Templates times bands: within MOST_TEMPLATE_WORDS, so small enough to broadcast.
    pairs = made.join(F.broadcast(ours), ["step", "band", "low"])
    shared = F.size(F.array_intersect("tg", "g")) / F.size("tg")
    # A band that agrees says only which pair to look at: each window counts once.
    out = pairs.select("doc_id", "license", "at", shared.alias("containment")).where(F.col("containment") >= containment).distinct()
    return out.groupBy("doc_id", "license").agg(F.max("containment").alias("containment"), F.min("at").alias("first_word"), F.count("*").alias("windows"))


def out_schema(docs: DataFrame) -> str:
    kind = columns_of(docs, "doc_id").schema["doc_id"].dataType.simpleString()
    return f"doc_id {kind}, license string, containment double, first_word int, windows bigint"


def op4_license_scan(spark, sf_dir: str) -> DataFrame:
    """Every document's licenses."""
    return license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
