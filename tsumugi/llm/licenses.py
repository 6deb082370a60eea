"""License scans (operator 6): Dice coefficient over word bigrams against license templates, in DataFrame functions only.

A document's lines are cut at sentence ends; its passages are the pieces, runs of pieces (such as a line, or several) and, if it
has several lines, the whole of it. A passage of a distinct
bigrams and a template of b have a Dice coefficient of 2 c / (a + b) with c bigrams in common. As a is c at least, that is t
at least only if c is b t / (2 - t) or more: documents with fewer of a template's bigrams in all of their text are left at once.
In the others a run matters only if each end of it holds one of the template's bigrams: to begin at a piece that has some, and to
end where one is new to the run. The bigrams are those of the whole text, so they go on from piece to piece.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8

#: License notices, by SPDX identifier (fixed values).
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MIT", "Released under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)


_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
_BSD_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_BSD_END = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
#: The short licenses in full, without their title and copyright lines.
FULL_TEXTS: tuple[tuple[str, str], ...] = (
    ("BSD-2-Clause", _BSD + _BSD_END),
    ("BSD-3-Clause", _BSD + _BSD_3 + _BSD_END),
    ("ISC", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
)


def words_of(text: Column) -> Column:
    """Lower-cased runs of a-z and 0-9; all else separates."""
    return F.array_remove(F.split(F.lower(text), "[^a-z0-9]+"), "")


def bigrams(words: Column) -> Column:
    """The pairs of neighbouring words, in order and with repeats."""
    n = F.greatest(F.size(words) - 1, F.lit(0))
    return F.zip_with(F.slice(words, F.lit(1), n), F.slice(words, F.lit(2), n), lambda a, b: F.concat(a, F.lit(" "), b))


def once(c: Column) -> Column:
    """A value that is worked out once a row: as the one element of an array that is exploded. Catalyst would otherwise put
    its expression wherever it is used, and functions with lambdas don't share what they have in common."""
    return F.explode(F.array(c))


def template_literals(templates: tuple[tuple[str, str], ...], threshold: float) -> tuple[Column, Column]:
    """The templates as an array (template, license, size, least number of bigrams in common, bigrams), and all their bigrams."""
    quoted = lambda text: "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"
    rows, every = [], {}
    for k, (name, text) in enumerate(templates):
        words = re.findall("[a-z0-9]+", text.lower())
        own = dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))
        if own:
            every |= own
            least = math.ceil(len(own) * threshold / (2 - threshold) - 1e-9)
            rows.append(f"named_struct('template', {k}, 'license', {quoted(name)}, 'size', {len(own)}, 'least', {least}, 'own', array({', '.join(map(quoted, own))}))")
    none = "slice(array(named_struct('template', 0, 'license', '', 'size', 0, 'least', 0, 'own', array(''))), 1, 0)"
    return F.expr(f"array({', '.join(rows)})" if rows else none), F.expr(f"array({', '.join(map(quoted, every))})" if every else "cast(array() as array<string>)")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value worked out once, where once() can't be: within a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def pieces_of(text: Column) -> Column:
    """The lines of a text, cut at white space after a sentence's end, as structs of text and line (from 0)."""
    cut = lambda line, i: F.transform(F.split(line, r"(?<=[.!?;:])\s+"), lambda t: F.struct(t.alias("text"), i.alias("line")))
    return F.flatten(F.transform(F.split(text, "\n"), cut))


def runs_of(hits: Column, pairs: Column, pieces: Column) -> Column:
    """For one template's hits in a document (p, s, e, start, stop, prev; by p): the runs of pieces that may be near it.

    A hit is a bigram at p whose words are in the pieces s and e, which go from word start on and up to word stop; the same
    bigram was last hit in piece prev. A run (s, e) with its first line and the number of line ends in it (more), its first
    and last hit (lo, hi), c of the template's bigrams and n in all.
    """
    line = lambda k: F.get(pieces, k)["line"]

    def from_line(i: Column) -> Column:
        def to_line(new: Column) -> Column:  # the hits that are new to a run from line i on
            ends = F.array_distinct(F.transform(new, lambda x: F.struct(x["e"].alias("e"), x["stop"].alias("stop"))))
            with_c = F.transform(ends, lambda j: F.struct(j["e"].alias("e"), j["stop"].alias("stop"), F.size(F.filter(new, lambda x: x["e"] <= j["e"])).alias("c")))
            enough = F.filter(with_c, lambda j: j["c"] >= F.col("t.least"))
            size = lambda j: F.size(F.array_distinct(F.slice(pairs, i["start"] + 1, j["stop"] - i["start"] - 1)))
            passage = lambda j: F.xxhash64(F.transform(F.slice(pieces, i["s"] + 1, j["e"] - i["s"] + 1), lambda x: x["text"]))
            return F.transform(enough, lambda j: F.struct(i["s"].alias("s"), j["e"].alias("e"), line(i["s"]).alias("line"), (line(j["e"]) - line(i["s"])).alias("more"), F.get(new, F.lit(0))["p"].alias("lo"), F.get(new, j["c"] - 1)["p"].alias("hi"), j["c"].alias("c"), size(j).alias("n"), passage(j).alias("hash")))

        return let(F.filter(hits, lambda x: (x["s"] >= i["s"]) & (x["prev"] < i["s"])), to_line)

    starts = F.array_distinct(F.transform(hits, lambda x: F.struct(x["s"].alias("s"), x["start"].alias("start"))))
    return F.flatten(F.transform(starts, from_line))


def near_passages(docs: DataFrame, templates: tuple[tuple[str, str], ...], threshold: float) -> DataFrame:
    """doc_id, text_hash, template, license, size and run (as runs_of() gives; s, e and line are -1 for the whole) of what is near a template."""
    table, every = template_literals(templates, threshold)
    worded = docs.select("doc_id", "text", once(words_of(F.col("text"))).alias("words")).where(F.size("words") > 1)
    known = worded.select("doc_id", "text", once(F.array_intersect(bigrams(F.col("words")), every)).alias("known")).where(F.size("known") > 0)
    near = known.select("doc_id", "text", once(F.filter(table, lambda t: F.size(F.array_intersect(t["own"], F.col("known"))) >= t["least"])).alias("near")).where(F.size("near") > 0)
    lined = near.select("doc_id", F.xxhash64("text").alias("text_hash"), "near", once(pieces_of(F.col("text"))).alias("lines"))
    cut_up = lined.select("*", once(F.transform("lines", lambda x: words_of(x["text"]))).alias("words"))
    numbered = F.flatten(F.transform("words", lambda ws, i: F.transform(ws, lambda w, k: F.struct(w.alias("w"), i.alias("line"), k.alias("k"), F.size(ws).alias("n")))))
    placed = cut_up.select("doc_id", "text_hash", "near", "lines", once(numbered).alias("words"))
    after = F.slice("words", F.lit(2), F.size("words") - 1)
    paired = F.zip_with(F.slice("words", F.lit(1), F.size("words") - 1), after, lambda x, y: F.struct(F.concat(x["w"], F.lit(" "), y["w"]).alias("b"), x.alias("x"), y.alias("y")))
    at = F.transform(paired, lambda z, p: F.struct(z["b"].alias("b"), p.alias("p"), z["x"]["line"].alias("s"), z["y"]["line"].alias("e"), (p - z["x"]["k"]).alias("start"), (p + 1 - z["y"]["k"] + z["y"]["n"]).alias("stop")))
    ready = placed.select("doc_id", "text_hash", "near", "lines", once(at).alias("at")).select("*", once(F.col("at.b")).alias("pairs"))
    each = ready.select("doc_id", "text_hash", "lines", "at", "pairs", F.explode("near").alias("t"))
    sorted_ = each.select("*", once(F.array_sort(F.filter("at", lambda x: F.array_contains(F.col("t.own"), x["b"])))).alias("by_bigram"))
    before = lambda x, k: let(F.get("by_bigram", k - 1), lambda y: F.when(y["b"] == x["b"], y["s"]).otherwise(-1))
    hits = F.array_sort(F.transform("by_bigram", lambda x, k: F.struct(x["p"].alias("p"), x["s"].alias("s"), x["e"].alias("e"), x["start"].alias("start"), x["stop"].alias("stop"), before(x, k).alias("prev"))))
    hit = sorted_.select("doc_id", "text_hash", "t", "lines", "pairs", once(hits).alias("hits"))
    whole = F.struct(F.lit(-1).alias("s"), F.lit(-1).alias("e"), F.lit(-1).alias("line"), F.lit(0).alias("more"), F.lit(-1).alias("lo"), F.lit(-1).alias("hi"), F.size(F.array_intersect("pairs", "t.own")).alias("c"), F.size(F.array_distinct("pairs")).alias("n"), F.col("text_hash").alias("hash"))
    runs = F.concat(runs_of(F.col("hits"), F.col("pairs"), F.col("lines")), F.when(F.element_at("lines", -1)["line"] > 0, F.array(whole)).otherwise(F.slice(F.array(whole), 1, 0)))
    return hit.select("doc_id", "text_hash", "t.template", "t.license", "t.size", F.explode(runs).alias("run"))


def scan_licenses(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES + FULL_TEXTS, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, license, n_passages, first_line and dice (the best) of the licenses that documents have.

    A passage counts for its best template, of equal ones the first, if the coefficient is at least threshold. Passages are
    lines cut at sentence ends, and runs of such pieces; of those that share words of their templates the one counts that has most in common beyond what
    the threshold asks (2 c - threshold (a + b)), of equal ones the shortest, then the first. Lines are counted from 0; the
    whole document is line -1, isn't counted in n_passages, and gives way to a better run, while runs give way to it where no
    line or run is better. Null and empty texts, and those of one word, have no license; rows of one doc_id are one document
    (equal passages in the same place count once), rows without a doc_id too; an empty table gives no rows. Texts of any
    length are read whole. The time for one document grows with the square of its pieces that have bigrams of a template
    that it may contain.
    """
    found = near_passages(docs, templates, threshold).select("doc_id", "text_hash", "template", "license", "size", "run.*")
    scored = found.withColumn("dice", 2 * F.col("c") / (F.col("n") + F.col("size"))).where(F.col("dice") >= threshold - 1e-9)
    scored = scored.withColumn("gain", F.round(2 * F.col("c") - threshold * (F.col("n") + F.col("size")), 6))
    best = scored.groupBy("doc_id", "text_hash", "s", "e").agg(F.min_by(F.struct("license", "dice", "gain", "line", "more", "lo", "hi", "hash"), F.struct(-F.col("dice"), "template")).alias("best"))
    ranked = F.struct((-F.col("best.gain")).alias("rank"), "best.more", (F.col("e") - F.col("s")).alias("pieces"), "s", "e", "best.line", "best.lo", "best.hi", "best.license", "best.dice", "best.hash")
    all_ = best.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_list(ranked)).alias("all"))
    split = all_.select("doc_id", "text_hash", once(F.filter("all", lambda x: x["s"] >= 0)).alias("parts"), F.get(F.filter("all", lambda x: x["s"] < 0), F.lit(0)).alias("whole"))
    beaten = F.get("parts", F.lit(0))["rank"] < F.col("whole.rank")
    left = split.select("*", once(F.filter("parts", lambda x: F.col("whole").isNull() | beaten | (x["more"] == 0))).alias("open"))
    apart = F.aggregate("open", F.slice("open", 1, 0), lambda done, x: F.when(F.exists(done, lambda y: (y["lo"] <= x["hi"]) & (y["hi"] >= x["lo"])), done).otherwise(F.concat(done, F.array(x))))
    chosen = left.select("doc_id", "whole", once(apart).alias("chosen"))
    better = F.exists("chosen", lambda x: (x["more"] > 0) & (x["rank"] < F.col("whole.rank")))
    kept = chosen.select("doc_id", F.explode(F.when(F.col("whole").isNull() | better, F.col("chosen")).otherwise(F.concat("chosen", F.array("whole")))).alias("x"))
    passages = kept.select("doc_id", "x.s", "x.e", "x.line", "x.hash", "x.license", "x.dice").distinct()
    return passages.groupBy("doc_id", "license").agg(
        F.sum(F.when(F.col("s") >= 0, 1).otherwise(0)).alias("n_passages"), F.coalesce(F.min(F.when(F.col("s") >= 0, F.col("line"))), F.lit(-1)).alias("first_line"), F.max("dice").alias("dice")
    )
