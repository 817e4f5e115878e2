"""Licence scan in DataFrame operations only: texts, their lines, paragraphs and sentences against licence templates by Dice coefficient.

Dice of two sets of word bigrams is 2 |A and B| / (|A| + |B|). It can only reach t if the sizes are within a factor of
t / (2 - t) of each other, so a template is a candidate only for texts of such sizes. Bigrams that a text shares with
candidates are found by one join with the templates' bigrams, which is small and broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import written

# Wordings of public licences by SPDX identifier, as they stand in notices.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("MIT", "MIT License Copyright (c) Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("ISC", "ISC License Copyright (c) Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("BSD-2-Clause", "Copyright (c) Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("BSD-3-Clause", "Copyright (c) Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
]
#: Bigrams of all templates together, up to which they are broadcast.
BROADCAST_BIGRAMS = 1_000_000
#: Between paragraphs: line feeds with nothing but lines without letters or digits between them. Sentences end there, too, or with a mark and white space.
PARAGRAPH = r"\n(?:[^\p{L}\p{N}\n]*\n)+"
SENTENCE = r"[.!?][ \t\r\n]+|" + PARAGRAPH
KINDS = ["text", "line", "paragraph", "sentence"]


def normalised_words(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.split(F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")), " ")


def _bigrams(words: str) -> Column:
    """Different pairs of neighbouring words, as hashes of both."""
    pairs = F.transform(words, lambda w, k: F.when(k < F.size(words) - 1, F.xxhash64(w, F.get(words, k + 1))))
    return F.array_distinct(F.filter(pairs, lambda p: p.isNotNull()))


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a column that is computed one time a row: filters on it aren't moved below, where they would compute it again."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def template_table(spark: SparkSession, templates: list[tuple[str, str]] | None = None) -> DataFrame:
    """Templates (license, text) -> (template, license, size, bigram), a row for each bigram."""
    rows = [(k, name, text) for k, (name, text) in enumerate(TEMPLATES if templates is None else templates)]
    table = spark.createDataFrame(rows, "template int, license string, text string")
    table = once(once(table, "words", normalised_words(F.col("text"))), "bigrams", _bigrams("words"))
    return table.select("template", "license", F.size("bigrams").alias("size"), F.explode("bigrams").alias("bigram"))


def _units(text: Column) -> Column:
    """An array (kind, place, unit) of what is compared: the whole text, its lines, paragraphs and sentences, as far as they differ."""
    named = lambda kind, parts: F.transform(parts, lambda u, k: F.struct(F.lit(kind).alias("kind"), (k + 1).cast("int").alias("place"), u.alias("unit")))
    several = F.contains(text, F.lit("\n"))
    none = F.array().cast("array<struct<kind:int,place:int,unit:string>>")
    whole = F.array(F.struct(F.lit(0).alias("kind"), F.lit(0).alias("place"), text.alias("unit")))
    # A paragraph of one line, and a text of one sentence, have been compared already.
    paragraphs = F.filter(named(2, F.split(text, PARAGRAPH)), lambda u: F.contains(u["unit"], F.lit("\n")))
    sentences = named(3, F.split(text, SENTENCE))
    return F.concat(F.when(several, F.concat(whole, paragraphs)).otherwise(none), named(1, F.split(text, "\n")), F.when(F.size(sentences) > 1, sentences).otherwise(none))


def scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None, least: float = 0.8) -> DataFrame:
    """documents (doc_id, text) -> (doc_id, license, dice, line, unit, place): the best match of each text with a Dice of at least ``least``.

    Compared are the whole text, each of its lines, its paragraphs (lines up to one without a letter or digit, so comment marks and wrapped lines do no
    harm) and its sentences, which lines and paragraphs may be full of. ``unit`` says what matched and ``place`` which one, from 1; ``line`` is its number if it is
    a line, 0 for a whole text. Of equal Dice the text wins over lines, these over paragraphs and sentences, then the first place, then the first template.
    Texts that match nothing, null and empty texts among them, have nulls. Rows with equal doc_id and text have equal answers,
    one each. Units of fewer than two words have no bigrams and match nothing. Texts of any length are compared whole.
    """
    spark = docs.sparkSession
    table = written(template_table(spark, templates))
    low, high, total = table.agg(F.min("size"), F.max("size"), F.count("*")).first()
    text = F.col("text").cast("string")
    # Rows are told apart by doc_id and text; one row of those that repeat is compared, all get the answer.
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.struct(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.xxhash64(text)).alias("_row"), text.alias("text"))
    ids = own.select("doc_id", "_row")
    factor = least / (2 - least)
    units = own.where("text is not null").select("_row", F.explode(_units(F.col("text"))).alias("u")).select("_row", "u.*")
    # Sizes first: a unit of so few characters, or words, has not bigrams enough.
    fewest = (low or 0) * factor
    units = once(units.where(F.length("unit") >= 2 * fewest - 1e-9), "words", normalised_words(F.col("unit")))
    units = once(units.where(F.size("words") - 1 >= fewest - 1e-9), "bigrams", _bigrams("words"))
    units = units.withColumn("n", F.size("bigrams")).where(F.col("n").between(fewest - 1e-9, (high or 0) / factor + 1e-9))
    each = units.select("_row", "kind", "place", "n", F.explode("bigrams").alias("bigram"))
    side = F.broadcast(table) if (total or 0) <= BROADCAST_BIGRAMS else table
    within = (F.col("n") >= F.col("size") * factor - 1e-9) & (F.col("n") <= F.col("size") / factor + 1e-9)
    shared = each.join(side, "bigram").where(within).groupBy("_row", "kind", "place", "n", "template", "license", "size").agg(F.count_distinct("bigram").alias("both"))
    matched = shared.withColumn("dice", 2 * F.col("both") / (F.col("n") + F.col("size"))).where(F.col("dice") >= least - 1e-12)
    best = matched.groupBy("_row").agg(F.max_by(F.struct("license", "dice", "kind", "place"), F.struct("dice", -F.col("kind"), -F.col("place"), -F.col("template"))).alias("m"))
    kind, place = F.col("m.kind"), F.col("m.place").cast("long")
    unit = F.get(F.array(*map(F.lit, KINDS)), kind)
    return ids.join(best, "_row", "left").select("doc_id", F.col("m.license").alias("license"), F.col("m.dice").alias("dice"), F.when(kind < 2, place).alias("line"), unit.alias("unit"), place.alias("place"))
