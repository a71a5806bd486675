"""Licence scans: sparse TF-IDF cosine of lines, blocks and files to templates, then inheritance along directories.

All of it is DataFrame expressions. Compared are every line, every block of lines (as a header that
goes over several lines) and every text as a whole, if it has a word that licences are told by;
words weigh by their rarity among all documents and templates, counted over all documents. The
words that licences are told by follow from the templates: by the inequality of Cauchy and Schwarz
a text reaches the threshold with a template only if it has one of any set of its words beside
which the others' squared parts add up to less than the threshold's square; the rarest such set is
taken, so nothing is lost. An SPDX expression is read as such, and all its licences are named. A
document that is a licence file (what matches is half of it or more) licenses its directory, and a
document without a licence of its own takes that of the nearest ancestor directory that has one.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sized, written

#: Notices, standard headers and licence texts as authors write them into files; a licence may have several.
TEMPLATES = {
    "agpl-3.0": (
        "This work is licensed under the GNU Affero General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.",
    ),
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    "bsd-2-clause": (
        "Licensed under the BSD 2-Clause License",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED.",
    ),
    "bsd-3-clause": (
        "Licensed under the BSD 3-Clause License",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED.",
    ),
    "cc-by-4.0": ("Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    "cc-by-nc-4.0": ("Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    "cc-by-sa-4.0": ("Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    "cc0-1.0": "Released under CC0 1.0 Universal Public Domain Dedication",
    "gpl-2.0": (
        "This work is licensed under the GNU General Public License, version 2",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ),
    "gpl-3.0": (
        "This work is licensed under the GNU General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ),
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE",
    "lgpl-2.1": (
        "This work is licensed under the GNU Lesser General Public License, version 2.1",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    ),
    "lgpl-3.0": (
        "This work is licensed under the GNU Lesser General Public License, version 3",
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    ),
    "mit": (
        "Released under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "proprietary": ("All rights reserved", "All rights reserved. No part may be reproduced without permission"),
}
#: Identifiers that a line `SPDX-License-Identifier:` may name, by licence.
SPDX = {
    "agpl-3.0": "AGPL-3.0 AGPL-3.0-only AGPL-3.0-or-later", "apache-2.0": "Apache-2.0", "bsd-2-clause": "BSD-2-Clause", "bsd-3-clause": "BSD-3-Clause", "cc-by-4.0": "CC-BY-4.0", "cc-by-nc-4.0": "CC-BY-NC-4.0", "cc-by-sa-4.0": "CC-BY-SA-4.0", "cc0-1.0": "CC0-1.0",
    "gpl-2.0": "GPL-2.0 GPL-2.0-only GPL-2.0-or-later", "gpl-3.0": "GPL-3.0 GPL-3.0-only GPL-3.0-or-later", "isc": "ISC", "lgpl-2.1": "LGPL-2.1 LGPL-2.1-only LGPL-2.1-or-later", "lgpl-3.0": "LGPL-3.0 LGPL-3.0-only LGPL-3.0-or-later", "mit": "MIT", "mpl-2.0": "MPL-2.0", "unlicense": "Unlicense",
}
#: What marks a line as an SPDX expression, and the expression.
MARK = r"(?i)SPDX-License-Identifier:[\x20\t]*([A-Za-z0-9.+()\x20-]+)"
WORD = r"[\p{L}\p{N}]+(?:[.-][\p{L}\p{N}]+)*"
THRESHOLD, FILE_SHARE = 0.6, 0.5
#: Directories with a licence that may be broadcast: names of some hundred bytes.
DIRECTORIES = 200_000


def words(text: str) -> list[str]:
    return re.findall(r"[^\W_]+(?:[.-][^\W_]+)*", text.lower())


def telling(forms: list[dict[str, float]], met: dict[str, int], threshold: float) -> list[str]:
    """Words of which a text has one at least if its cosine to one of forms (parts of words, at unit length) is `threshold` or more: of each form the rarest that will do."""
    out = set()
    for parts in forms:
        left = sum(p * p for p in parts.values())
        for w in sorted(parts, key=lambda w: (met.get(w, 0), w)):
            if left < (threshold - 1e-6) ** 2:
                break
            out.add(w)
            left -= parts[w] ** 2
    return sorted(out)


def _named(expression):
    """The licences of an SPDX expression, in its order and with its operators; NULL unless all are known."""
    known = F.create_map(*[x for name, ids in SPDX.items() for i in ids.split() for x in (F.lit(i.lower()), F.lit(name))])
    parts = F.filter(F.split(F.regexp_replace(F.trim(expression), r"[()]", " "), " +"), lambda x: x != "")
    names = F.transform(parts, lambda x: F.when(F.upper(x).isin("AND", "OR", "WITH"), F.upper(x)).otherwise(known[F.lower(x)]))
    return F.when((F.size(names) > 0) & ~F.exists(names, lambda x: x.isNull()), F.array_join(names, " "))


def _units(text):
    """Lines (0), blocks of lines (1) and, unless it is one block, the whole (2) of a text, each as (kind, characters, text)."""
    piece = lambda kind: lambda x: F.struct(F.lit(kind).alias("kind"), F.length(x).alias("size"), x.alias("unit"))
    lines = F.split(text, "\n")
    blocks = F.filter(F.split(text, r"\n[^\p{L}\p{N}\n]*(?=\n)"), lambda x: F.contains(F.trim(x), F.lit("\n")))
    return F.concat(F.transform(lines, piece(0)), F.transform(blocks, piece(1)), F.when((F.size(lines) > 1) & (F.size(blocks) != 1), F.array(piece(2)(text))).otherwise(F.array().cast("array<struct<kind:int,size:int,unit:string>>")))


def scanned(files: DataFrame, threshold: float = THRESHOLD, file_share: float = FILE_SHARE, templates: dict[str, str | tuple[str, ...]] | None = None) -> DataFrame:
    """(doc_id, path, licence, score, how, licensed_by) for each row of files (doc_id, path, text, ...).

    path is the directory of a row, with `/` between names. how is `own`, `inherited` or `none`;
    licensed_by is the directory that the licence comes from. The best score of a line, block or
    the whole counts; ties go to the first licence by name. Null texts and paths count as empty,
    texts of any length are read whole; repeated rows are judged each; other columns
    are ignored; an empty table gives no rows. Scores are rounded to six places. A line that is an
    SPDX expression of known licences names them all, as `mit OR apache-2.0`, at score 1.
    """
    spark = files.sparkSession
    known = templates is None
    if known:
        templates = TEMPLATES
    notices = [(name, words(t)) for name, texts in sorted(templates.items()) for t in ([texts] if isinstance(texts, str) else texts)]
    files = files.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("path", F.lit("")).alias("path"), F.coalesce("text", F.lit("")).alias("text"))
    vocabulary = sorted({w for _, t in notices for w in t})
    total = files.count()
    own = F.array_distinct(F.filter(F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0)), lambda w: w.isin(vocabulary)))
    held = {r["word"]: r["met"] for r in files.select(F.explode(own).alias("word")).groupBy("word").agg(F.count("*").alias("met")).collect()}  # a row per word of the templates
    weight = {w: math.log((1 + total + len(notices)) / (1 + held.get(w, 0) + sum(w in t for _, t in notices))) + 1 for w in vocabulary}
    rows, forms = [], []
    for form, (name, own) in enumerate(notices):
        norm = math.sqrt(sum((own.count(w) * weight[w]) ** 2 for w in set(own)))
        forms.append({w: own.count(w) * weight[w] / norm for w in sorted(set(own))})
        rows += [(form, name, w, part) for w, part in forms[-1].items()]
    signs = telling(forms, held, threshold) + (["spdx-license-identifier"] if known else [])
    told = F.lit(r"(?<![\p{L}\p{N}])(?:" + "|".join(map(re.escape, signs)) + r")(?![\p{L}\p{N}])")
    units = files.where(F.regexp_like(F.lower("text"), told)).select("doc_id", F.xxhash64("path", "text").alias("version"), F.explode(_units(F.col("text"))).alias("u")).select("doc_id", "version", "u.*").where(F.regexp_like(F.lower("unit"), told))
    tokens = units.select("doc_id", "version", "kind", "size", F.regexp_extract_all(F.lower("unit"), F.lit(WORD), F.lit(0)).alias("words"), *([_named(F.nullif(F.regexp_extract("unit", MARK, 1), F.lit(""))).alias("said")] if known else [F.lit(None).cast("string").alias("said")]))
    tokens = written(tokens.where(F.size("words") > 0).withColumn("unit", F.xxhash64("words")), "units")
    distinct = tokens.groupBy("unit").agg(F.any_value("words").alias("words"))
    counted = written(distinct.select("unit", F.explode("words").alias("word")).groupBy("unit", "word").agg(F.count("*").alias("n")), "counted")
    ours = spark.createDataFrame([(w, sum(w in t for _, t in notices)) for w in vocabulary], "word string, forms long")
    wanted = counted.select("word").union(ours.select("word")).distinct()
    holders = files.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0)))).alias("word")).groupBy("word").agg(F.count("*").alias("met"))
    holders = written(holders.join(wanted, "word", "left_semi"), "holders")
    table = spark.createDataFrame(rows, "form int, licence string, word string, part double")
    rarity = F.log(F.lit(float(1 + total + len(notices))) / (1 + F.col("met") + F.coalesce("forms", F.lit(0)))) + 1
    counted = counted.join(holders, "word").join(F.broadcast(ours), "word", "left").select("unit", "word", (F.col("n") * rarity).alias("x"))  # the templates are a fixed table
    norms = counted.groupBy("unit").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    dots = counted.join(F.broadcast(table), "word").groupBy("unit", "form", "licence").agg(F.sum(F.col("x") * F.col("part")).alias("dot"))
    best = dots.join(norms, "unit").select("unit", "licence", F.round(F.col("dot") / F.col("norm"), 6).alias("score")).where(F.col("score") >= threshold)
    best = best.groupBy("unit").agg(F.min(F.struct((-F.col("score")).alias("s"), "licence")).alias("x"))
    best = best.select("unit", F.col("x.licence").alias("licence"), (-F.col("x.s")).alias("score"))
    # what matches of a text: its lines together, or its blocks, or the whole
    part = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("size")).otherwise(0))
    said = tokens.where("kind = 0 and said is not null").select("doc_id", "version", "kind", "size", F.col("said").alias("licence"), F.lit(1.0).alias("score"))
    hits = tokens.where("kind <> 0 or said is null").join(best, "unit").select("doc_id", "version", "kind", "size", "licence", "score").union(said)
    found = hits.groupBy("doc_id", "version").agg(F.min(F.struct((-F.col("score")).alias("s"), "licence")).alias("x"), F.greatest(part(0), part(1), part(2)).alias("inside"))
    found = sized(written(found.select(F.col("doc_id").alias("_d"), F.col("version").alias("_v"), F.col("x.licence").alias("own"), (-F.col("x.s")).alias("score"), "inside"), "found"))
    rows = files.select("doc_id", "path", F.length("text").alias("size"), F.xxhash64("path", "text").alias("version"))  # texts themselves are never dealt out
    judged = rows.join(found, rows["doc_id"].eqNullSafe(found["_d"]) & (rows["version"] == found["_v"]), "left")
    judged = written(judged.select("doc_id", "path", "own", "score", (F.col("inside") >= file_share * F.col("size")).alias("whole")), "judged")
    grants = judged.where("whole").groupBy("path").agg(F.min(F.struct((-F.col("score")).alias("s"), "own")).alias("x")).select(F.col("path").alias("dir"), F.col("x.own").alias("granted"), (-F.col("x.s")).alias("granted_score"))
    # directories are joined once each, not once for each document in them
    dirs = judged.where("own is null").select("path").distinct()
    names = F.split("path", "/")
    up = dirs.select("path", F.explode(F.transform(F.sequence(F.lit(0), F.size(names)), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(names, F.lit(1), k), "/").alias("dir")))).alias("a")).select("path", "a.*").distinct()
    nearest = up.join(grants, "dir").groupBy("path").agg(F.max(F.struct("depth", "dir", "granted", "granted_score")).alias("x")).select(F.col("path").alias("_path"), "x.dir", "x.granted", "x.granted_score")
    nearest = sized(written(nearest, "nearest"), DIRECTORIES)
    out = judged.join(nearest, judged["path"] == nearest["_path"], "left")
    own = F.col("own").isNotNull()
    how = F.when(own, "own").when(F.col("granted").isNotNull(), "inherited").otherwise("none")
    return out.select("doc_id", "path", F.coalesce("own", "granted").alias("licence"), F.when(own, F.col("score")).otherwise(F.col("granted_score")).alias("score"), how.alias("how"), F.when(own, F.col("path")).otherwise(F.col("dir")).alias("licensed_by"))
