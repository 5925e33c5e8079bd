"""Licence scan: TF-IDF cosine of lines to templates, and inheritance from the nearest directory above."""

from __future__ import annotations

import json
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_text, stored

_FREE = "This {0} is free software: you can redistribute it and/or modify it under the terms of the {2} as published by the Free Software Foundation, either version {3} of the License, or (at your option) any later version. "
_HOPE = "This {0} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {1} for more details. You should have received a copy of the {1} along with this {0}. If not, see <https://www.gnu.org/licenses/>."
_GRANT = "MIT License Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
_AS_IS = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
_ISC_AS_IS = "THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
_BSD_NAMES = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_BSD_AS_IS = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_FREED = "This is free and unencumbered software released into the public domain. "
_UNLICENSE = "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. For more information, please refer to <https://unlicense.org>"

#: Notices by SPDX name. Fixed values, public texts.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under a Creative Commons Attribution 4.0 International License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("GPL-3.0", _FREE.format("program", "program", "GNU General Public License", "3")),
    ("GPL-2.0", _FREE.format("program", "program", "GNU General Public License", "2")),
    ("LGPL-3.0", _FREE.format("library", "library", "GNU Lesser General Public License", "3")),
    ("LGPL-2.1", _FREE.format("library", "library", "GNU Lesser General Public License", "2.1")),
    ("AGPL-3.0", _FREE.format("program", "program", "GNU Affero General Public License", "3")),
    ("GPL-3.0", _FREE.format("program", "program", "GNU General Public License", "3") + _HOPE.format("program", "GNU General Public License")),
    ("GPL-2.0", _FREE.format("program", "program", "GNU General Public License", "2") + _HOPE.format("program", "GNU General Public License")),
    ("LGPL-3.0", _FREE.format("library", "library", "GNU Lesser General Public License", "3") + _HOPE.format("library", "GNU Lesser General Public License")),
    ("LGPL-2.1", _FREE.format("library", "library", "GNU Lesser General Public License", "2.1") + _HOPE.format("library", "GNU Lesser General Public License")),
    ("AGPL-3.0", _FREE.format("program", "program", "GNU Affero General Public License", "3") + _HOPE.format("program", "GNU Affero General Public License")),
    ("LGPL-2.1", "Licensed under the GNU Lesser General Public License, version 2.1."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("CC-BY-SA-4.0", "Licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("MIT", _GRANT + _AS_IS),
    ("ISC", _ISC),
    ("ISC", _ISC + _ISC_AS_IS),
    ("BSD-2-Clause", _BSD + _BSD_AS_IS),
    ("BSD-3-Clause", _BSD + _BSD_NAMES + _BSD_AS_IS),
    ("Unlicense", _FREED),
    ("Unlicense", _FREED + _UNLICENSE),
)
#: Lines of comments, as a Java pattern.
COMMENT = r"^\s*(?:#|//|/\*|\*|--|;|%|<!--|\"\"\"|'''|(?i:rem)\b)"
#: Least cosine of a line with a template.
THRESHOLD = 0.7
#: A file is a licence file if its name says so or if licence lines hold this share of its words.
LICENSE_NAME = r"(?i)(^|/)(licen[cs]e|copying|notice|unlicense)[^/]*$"
LICENSE_SHARE = 0.5
SEPARATORS = r"[^a-z0-9]+"


def line_words(line: Column) -> Column:
    return F.filter(F.split(F.lower(line), SEPARATORS), lambda w: w != "")


def template_words(templates: tuple[tuple[str, str], ...]) -> dict[int, dict[str, int]]:
    """Word counts of each template."""
    out: dict[int, dict[str, int]] = {}
    for k, (_, text) in enumerate(templates):
        counts: dict[str, int] = {}
        for w in "".join(c if c.isascii() and c.isalnum() else " " for c in text.lower()).split():
            counts[w] = counts.get(w, 0) + 1
        out[k] = counts
    return out


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _units(path: Column) -> Column:
    """What is compared of a file's ``raw`` lines and their words (``lines``): structs of first line, last line and words.

    These are the lines with words, runs of two or more of them, runs of two or more comment lines (with or without
    words), and a file named as a licence file as a whole.
    """

    def runs(keep: Callable[[Column, Column], Column]) -> Column:
        # lines with their numbers; an empty one ends a run
        marked = F.transform(F.arrays_zip("raw", "lines"), lambda x, i: F.when(keep(x["raw"], x["lines"]), F.concat(i.cast("string"), F.lit("|"), F.array_join(x["lines"], " "))).otherwise(""))
        found = F.filter(F.split(F.array_join(marked, "\n"), "\n\n+"), lambda r: r != "")
        found = F.transform(found, lambda r: F.split(F.regexp_replace(r, "^\n|\n$", ""), "\n"))
        found = F.filter(found, lambda r: F.size(r) > 1)
        words = lambda r: F.filter(F.split(F.array_join(F.transform(r, lambda x: F.substring_index(x, "|", -1)), " "), " "), lambda w: w != "")
        return F.transform(found, lambda r: F.struct(F.substring_index(r[0], "|", 1).cast("int").alias("line"), (F.substring_index(r[0], "|", 1).cast("int") + F.size(r) - 1).alias("last"), words(r).alias("w")))

    single = F.filter(F.transform("lines", lambda x, i: F.struct(i.alias("line"), i.alias("last"), x.alias("w"))), lambda u: F.size(u["w"]) > 0)
    whole = F.when(path.rlike(LICENSE_NAME), F.array(F.struct(F.lit(0).alias("line"), (F.size("lines") - 1).alias("last"), F.flatten("lines").alias("w"))))
    return F.array_distinct(F.concat(single, runs(lambda raw, words: F.size(words) > 0), runs(lambda raw, words: raw.rlike(COMMENT)), F.coalesce(whole, F.array().cast("array<struct<line:int,last:int,w:array<string>>>"))))


def needed_words(weights: dict[int, dict[str, float]], idf: dict[str, float], threshold: float) -> list[str]:
    """Words of which a unit must have one to reach the threshold with any template, by the templates' unit vectors.

    A template's commonest words are left out as long as what they have of its length is too little for that cosine.
    """
    out: set[str] = set()
    for vector in weights.values():
        length, rest = 0.0, sorted(vector, key=lambda w: (idf[w], w))
        while rest and length + vector[rest[0]] ** 2 < threshold**2 - 1e-9:
            length += vector[rest.pop(0)] ** 2
        out.update(rest)
    return sorted(out)


def line_counts(lines: DataFrame, words: DataFrame | list[str]) -> DataFrame:
    """(word, n): in how many lines each of the words stands; '' counts the lines that have any word."""
    seen = lines.select(F.explode("lines").alias("x")).filter(F.size("x") > 0)
    if isinstance(words, list):
        kept = F.array_distinct(F.filter("x", lambda w: w.isin(words)))
        seen = seen.select(F.explode(F.concat(F.array(F.lit("")), kept)).alias("word"))
    else:
        seen = seen.select(F.explode(F.array_distinct("x")).alias("word")).join(words, "word", "left_semi")
    return seen.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def license_lines(files: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(key, line, last, license, score, sizes, n_words) of the units of (key, t, path) whose best template reaches the threshold.

    Units are lines, blocks and whole licence files (see _units). Weights are tf x idf; idf is ln((1 + lines) / (1 + lines
    with the word)) + 1 over all lines of all files. Ties go to the first template. Three exact bounds drop units before
    any shuffle: one of a template's rarer words is needed (needed_words), and, as no idf is under 1, a unit's
    cosine is at most the share of its length that words of the templates have if all others had idf 1, and at most what
    its product with the best template gives with that length. Lines are
    counted for the words of the templates and of the units that are left; equal units are compared once. sizes are the
    words of each line, n_words those of the whole file.
    """
    spark = files.sparkSession
    counts = template_words(templates)
    words = sorted({w for c in counts.values() for w in c})
    lines = files.select("key", "path", F.split("t", "\n").alias("raw")).withColumn("lines", F.transform("raw", line_words))
    frequency = {r["word"]: r["n"] for r in line_counts(lines, words).collect()}  # as many as the templates have words
    total = frequency.pop("", 0)
    idf_of = {w: math.log((1 + total) / (1 + frequency.get(w, 0))) + 1 for w in words}
    weights = F.from_json(F.lit(json.dumps(idf_of)), "map<string,double>")
    norms = {k: math.sqrt(sum((n * idf_of[w]) ** 2 for w, n in c.items())) for k, c in counts.items()}
    vectors = {k: {w: n * idf_of[w] / norms[k] for w, n in c.items()} for k, c in counts.items()}
    needed = needed_words(vectors, idf_of, threshold)
    per_word = F.from_json(F.lit(json.dumps({w: [idf_of[w] * vectors[k].get(w, 0.0) for k in sorted(vectors)] for w in words})), "map<string,array<double>>")
    shape = json.dumps([{"word": w, "template": k, "license": templates[k][0], "weight": x} for k, v in vectors.items() for w, x in v.items()])
    shape = stored(spark.range(1).select(F.explode(F.from_json(F.lit(shape), "array<struct<word:string,template:int,license:string,weight:double>>")).alias("r")).select("r.*").coalesce(1), "license-templates")

    least = threshold**2 * (1 - 1e-6)

    def bounds(words_: Column, terms: Column) -> Column:
        """By the number of words and those of the templates among them, with their counts."""
        known = F.aggregate(terms, F.lit(0), lambda n, x: n + x["n"])
        inside = F.aggregate(terms, F.lit(0.0), lambda sum_, x: sum_ + (x["n"] * F.element_at(weights, x["w"])) ** 2)
        dots = F.aggregate(terms, F.array(*[F.lit(0.0)] * len(vectors)), lambda sums, x: F.zip_with(sums, F.element_at(per_word, x["w"]), lambda a, b: a + b * x["n"]))
        length = _let(inside, lambda i: F.struct(i.alias("inside"), (F.size(words_) - known).alias("outside")))
        cheap = lambda x: x["inside"] * (1 - least) >= least * x["outside"]
        return _let(length, lambda x: cheap(x) & _let(F.array_max(dots), lambda d: d * d >= least * (x["inside"] + x["outside"])))

    def may_match(u: Column) -> Column:
        known = F.filter(u["w"], lambda w: w.isin(words))
        counted = lambda k: F.transform(F.array_distinct(k), lambda w: F.struct(w.alias("w"), F.size(F.filter(k, lambda x: x == w)).alias("n")))
        # the cheap test comes first
        return F.exists(u["w"], lambda w: w.isin(needed)) & _let(known, lambda k: _let(counted(k), lambda terms: bounds(u["w"], terms)))

    sizes = F.transform("lines", lambda x: F.size(x))
    near = files.filter(F.exists(line_words(F.col("t")), lambda w: w.isin(needed)))
    near = near.select("key", "path", F.split("t", "\n").alias("raw")).withColumn("lines", F.transform("raw", line_words))
    close = near.select("key", F.aggregate("lines", F.lit(0), lambda n, x: n + F.size(x)).alias("n_words"), sizes.alias("sizes"), F.filter(_units(F.col("path")), may_match).alias("c")).filter(F.size("c") > 0)
    close = close.select("key", "n_words", "sizes", F.explode("c").alias("c")).select("key", "n_words", "c.line", "c.last", "c.w", F.slice("sizes", F.col("c.line") + 1, F.col("c.last") - F.col("c.line") + 1).alias("sizes"))
    close = stored(close.withColumn("unit", F.xxhash64(F.array_join("w", " "))).dropDuplicates(["key", "line", "last"]), "license-lines")
    tf = close.groupBy("unit").agg(F.first("w").alias("w")).select("unit", F.explode("w").alias("word")).groupBy("unit", "word").agg(F.count(F.lit(1)).alias("tf"))
    tf = stored(tf, "license-terms")
    seen = line_counts(lines, stored(tf.select("word").distinct(), "license-vocabulary"))
    idf = seen.select("word", (F.log((F.lit(1.0) + total) / (F.lit(1.0) + F.col("n"))) + 1).alias("idf"))
    weighted = stored(tf.join(idf, "word").select("unit", "word", (F.col("tf") * F.col("idf")).alias("v")), "license-weights")
    norm = weighted.groupBy("unit").agg(F.sqrt(F.sum(F.col("v") ** 2)).alias("norm"))
    dots = weighted.join(F.broadcast(shape), "word").groupBy("unit", "template", "license").agg(F.sum(F.col("v") * F.col("weight")).alias("dot"))
    scored = dots.join(norm, "unit").select("unit", "license", "template", F.round(F.col("dot") / F.col("norm"), 9).alias("score")).filter(F.col("score") >= threshold)
    best = stored(scored.groupBy("unit").agg(F.max(F.struct("score", -F.col("template"), "license")).alias("b")), "license-best")
    return close.drop("w").join(best, "unit").select("key", "n_words", "line", "last", "sizes", F.col("b.license").alias("license"), F.col("b.score").alias("score"))


def scan_licenses(files: DataFrame, doc_id: str = "doc_id", text: str = "text", path: Column | str = "path", templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, path, license, score, n_lines, is_license_file, inherited, from_dir, effective of each file.

    license is that of the file's best line, block of lines or, in a licence file, whole text (ties: the first template),
    score its cosine; n_lines are the lines in any that match. A licence file sets the licence of its
    directory (several: the best score, then the name). A file without a licence of its own inherits from the nearest
    directory at or above its own that has one. Directories are joined by path, each directory once.

    A null text has no lines, a null path is ''. A long text is taken whole, in one row's arrays. Ids may be of any type.
    Repeated rows are kept. Other columns are ignored; an empty table gives an empty result.
    """
    where = F.coalesce((F.col(path) if isinstance(path, str) else path).cast("string"), F.lit(""))
    named = files.select(F.col(doc_id).alias("doc_id"), where.alias("path"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    named = named.withColumn("key", F.xxhash64(id_text(F.col("doc_id")), "path", "t"))
    lines = stored(license_lines(named.select("key", "t", "path"), templates, threshold), "license-units")
    # a line may be in several units that match
    covered = lines.select("key", F.posexplode("sizes").alias("k", "size"), "line").select("key", (F.col("line") + F.col("k")).alias("at"), "size").filter("size > 0").distinct()
    covered = covered.groupBy("key").agg(F.count(F.lit(1)).alias("n_lines"), F.sum("size").alias("license_words"))
    best = lines.groupBy("key").agg(F.max(F.struct("score", -F.col("line"), "license")).alias("b"), F.first("n_words").alias("n_words"))
    found = stored(best.join(covered, "key").select("key", "b.license", "b.score", "n_lines", "license_words", "n_words"), "license-found")
    slim = named.select("doc_id", "path", "key")
    own = slim.join(found, "key", "left").withColumn("dir", F.regexp_replace("path", "/?[^/]*$", ""))
    own = stored(own.withColumn("is_license_file", F.col("license").isNotNull() & (F.col("path").rlike(LICENSE_NAME) | (F.col("license_words") >= LICENSE_SHARE * F.col("n_words")))), "license-own")
    dirs = own.filter("is_license_file").groupBy(F.col("dir").alias("at")).agg(F.max_by("license", F.struct("score", "license")).alias("inherited"))
    parts = F.split("dir", "/")
    above = own.select("dir").distinct().select("dir", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(parts, F.lit(1), k), "/").alias("at")))).alias("a"))
    nearest = above.select("dir", "a.depth", "a.at").join(dirs, "at").groupBy("dir").agg(F.max(F.struct("depth", "at", "inherited")).alias("n"))
    nearest = nearest.select(F.col("dir").alias("of"), F.col("n.at").alias("from_dir"), F.col("n.inherited").alias("inherited"))
    joined = own.join(stored(nearest, "license-dirs"), F.col("dir") == F.col("of"), "left")
    return joined.select("doc_id", "path", "license", "score", F.coalesce("n_lines", F.lit(0)).alias("n_lines"), "is_license_file", "inherited", "from_dir", F.coalesce("license", "inherited").alias("effective"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files named source / id in thousands / id; ids that are no numbers go to folders by a hash."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    number = F.expr("floor(try_cast(doc_id as bigint) / 1000)")
    folder = F.coalesce(number, F.pmod(F.crc32(id_text(F.col("doc_id"))), F.lit(1000))).cast("string")
    return scan_licenses(docs, path=F.concat_ws("/", F.coalesce("source", F.lit("none")), folder, F.concat(id_text(F.col("doc_id")), F.lit(".txt"))))


SQL: dict[str, str] = {}  # tested against brute force
QUERIES = {"op10_license_scan": op10_license_scan}
