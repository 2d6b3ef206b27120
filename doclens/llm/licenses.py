"""Licence scans, in DataFrame functions only.

What is compared with the licence templates, by the cosine of sparse TF-IDF vectors: the whole of a licence file; a file's
header, that is its leading comment block with the marks taken off; and any single line. Document frequencies are those of all
such units of the corpus. No unit is ruled out by a list of words: of each template the rarest terms are taken until the rest
of its vector is too short to reach the least cosine of interest, so that a unit without any of these terms can't match it, and
units are looked up by them. An SPDX tag counts as one term, with its identifier. A file has the licence of its best unit. A file
without one inherits that of the licence file in its nearest ancestor directory, found by joining its directory's ancestors,
unless its own text speaks of another licence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from doclens.llm.common import cut, written
from doclens.operators.lines import staged

#: A unit is an instance of a template from this cosine on.
COSINE = 0.6
#: Names of licence files.
LICENSE_FILE = r"(?i)^(licen[cs]e|copying|notice|unlicense)([-.][^.]*)?(\.(txt|md|rst))?$"
#: A line of a comment block: marks at its head, in group 1 what follows them.
COMMENT = r"^\s*(?:#+|//+|/?\*+/?|--+|;+|%+|<!--|rem\b|\x22\x22\x22|dnl\b)\s*(.*?)\s*(?:\*/|-->)?\s*$"
#: From this cosine on, or with an SPDX tag, a file's text speaks of a licence, so that it inherits no other.
HINT = 0.4
#: An SPDX tag, in lower case, with its identifier in group 1.
SPDX = r"spdx-license-identifier:\s*([a-z0-9]+(?:[.-][a-z0-9]+)*[+]?)"
TAG = "spdx-license-identifier"
#: Units are looked up by an array of at most this many terms of templates; by more with a join.
ARRAY_MOST = 2_000
#: Terms with at least this share of all are looked up by broadcast; there are at most 1 / SHARE of them.
SHARE = 1e-5
#: Broadcast templates have at most this many terms in all; more are joined by a shuffle.
BROADCAST_MOST = 200_000
#: Licences by SPDX name: short statements, notices for headers, and whole texts where they are short.
STATEMENTS = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 '
     'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
     "See the License for the specific language governing permissions and limitations under the License."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("MIT", "Released under the MIT License."), ("MIT", "Licensed under the MIT license."), ("MIT", "The MIT License (MIT)"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without '
     "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
     "conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
     'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. '
     "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE "
     "OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."), ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or "
     "(at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. "
     "See the GNU General Public License for more details."),
    ("GPL-2.0", "This program is licensed under the GNU General Public License, version 2."), ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or "
     "(at your option) any later version."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."), ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."), ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."), ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
     "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of "
     "conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
     "promote products derived from this software without specific prior written permission."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
     "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of "
     "conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("ISC", "Licensed under the ISC License."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."), ("CC-BY-4.0", "Creative Commons Attribution 4.0 International License"), ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."), ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Released into the public domain under CC0 1.0."), ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Proprietary", "Copyright. All rights reserved."),
)
_NAMES = sorted({name for name, _ in STATEMENTS} - {"Proprietary"})
#: Every licence's identifier; the GNU ones have forms of their own for later versions.
STATEMENTS += tuple((name, f"SPDX-License-Identifier: {name}{form}") for name in _NAMES for form in (("", "-only", "-or-later", "+") if "GPL" in name else ("",)))
TEMPLATES = "VALUES " + ", ".join(f"('{name}', '{text}')" for name, text in STATEMENTS)
_BREAK = "[^a-z0-9]+"


def _terms(text: Column) -> Column:
    low = F.lower(text)
    tagged = F.concat(F.regexp_replace(low, SPDX, " "), F.lit(" spdx"), F.regexp_replace(F.regexp_replace(F.regexp_extract(low, SPDX, 1), "[+]", "x"), "[.-]", "x"))
    return F.array_remove(F.split(F.when(low.contains(TAG), tagged).otherwise(low), _BREAK), "")


def _header(lines: Column) -> Column:
    """The leading comment lines of a file, without their marks, as one text; empty lines before them are left out."""
    full = F.filter(lines, lambda x: F.trim(x) != "")
    first_other = F.array_position(F.transform(full, lambda x: x.rlike(COMMENT)), F.lit(False))
    head = F.slice(full, F.lit(1), F.when(first_other > 0, first_other - 1).otherwise(F.size(full)).cast("int"))
    return F.trim(F.array_join(F.transform(head, lambda x: F.regexp_extract(x, COMMENT, 1)), " "))


def _units(files: DataFrame) -> DataFrame:
    """(doc_id, path, unit, terms, tagged) of every unit with a term; a unit is known by 128 bits of a hash."""
    ls = F.split("text", "\n")
    whole = F.when(_is_license(), F.array(F.trim(F.regexp_replace("text", r"\s+", " ")))).otherwise(F.array().cast("array<string>"))
    units = F.array_distinct(F.concat(F.transform(ls, lambda x: F.trim(x)), F.array(_header(ls)), whole))
    rows = staged(files.select("doc_id", "path", F.explode(units).alias("u")), terms=_terms(F.col("u")), tagged=F.lower("u").contains(TAG)).where(F.size("terms") > 0)
    return rows.select("doc_id", "path", F.unhex(F.md5("u")).alias("unit"), "terms", "tagged")


def _is_license() -> Column:
    return F.coalesce(F.regexp_extract("path", r"([^/]*)$", 1).rlike(LICENSE_FILE), F.lit(False))


def _with_df(rows: DataFrame, df: DataFrame, total: int, incidences: int) -> DataFrame:
    """rows(term, tf, …) with w. Terms that very many units hold are looked up by broadcast, the others by a shuffle, so that no
    term makes a large key."""
    often = df.where(F.col("df") >= max(1.0, SHARE * incidences)).withColumnRenamed("df", "often")
    met = rows.join(F.broadcast(often), "term", "left")
    rest = met.where("often is null").drop("often").join(df, "term", "left")
    every = met.where("often is not null").withColumnRenamed("often", "df").unionByName(rest)
    return every.withColumn("w", F.col("tf") * (F.log(F.lit(1.0 + total) / (1 + F.coalesce("df", F.lit(0)))) + 1)).drop("df")


def scan(files: DataFrame, templates: DataFrame, cosine: float = COSINE, hint: float = HINT, array_most: int = ARRAY_MOST) -> DataFrame:
    """(doc_id, path, license, basis, score) of each distinct file of files(doc_id, path, text) against templates(license, statement).

    basis is own; inherited; unclear, where the file's text speaks of a licence, by a cosine of at least `hint` or by an SPDX tag
    that no template has, and no like one is inherited; or none. score is the cosine of the unit that the licence, or the hint,
    rests on, rounded to 6 digits. The whole text is read, in lines ending at \\n; a null text has no unit. Of equal scores the
    least licence name holds. A directory's licence is that of the best match in its licence files; a file's own directory is its
    nearest ancestor; a null path has no directory and is no licence file. Files equal in doc_id, path and text come out once.
    Other columns are not read. Different files may hold one unit: each different unit is compared once.
    """
    whole = files.select("doc_id", F.col("path").cast("string"), F.col("text").cast("string"))
    units = _units(whole)
    # a mark in each unit counts the units
    df = written(units.select(F.explode(F.array_append(F.array_distinct("terms"), F.lit(""))).alias("term")).groupBy("term").agg(F.count("*").alias("df")), "frequencies")
    counted = df.agg(F.coalesce(F.max(F.when(F.col("term") == "", F.col("df"))), F.lit(0)).alias("total"), F.coalesce(F.sum("df"), F.lit(0)).alias("all")).collect()[0]
    weighted = lambda rows: _with_df(rows, df, counted["total"], counted["all"])
    statement = templates.select("license", "statement", F.explode(_terms(F.col("statement"))).alias("term")).groupBy("license", "statement", "term").agg(F.count("*").alias("tf"))
    template_w = cut(weighted(statement).select("license", "statement", "term", "w"))
    small = F.broadcast if template_w.count() <= BROADCAST_MOST else (lambda x: x)
    # rarest terms first, while those from here on could still reach the cosine
    of = Window.partitionBy("license", "statement")
    square = F.col("w") * F.col("w")
    on = F.sum(square).over(of.orderBy((F.col("w") / F.col("tf")).desc(), "term").rowsBetween(0, Window.unboundedFollowing))
    tf = template_w.join(statement, ["license", "statement", "term"])
    needed = tf.select("term", on.alias("on"), F.sum(square).over(of).alias("all")).where(F.col("on") >= (hint * hint - 1e-9) * F.col("all")).select("term").distinct()
    if needed.count() <= array_most:
        spoken = units.where(F.col("tagged") | F.arrays_overlap("terms", F.lit([r["term"] for r in needed.collect()]).cast("array<string>")))
    else:
        hits = units.select("unit", F.explode("terms").alias("term")).join(small(needed), "term", "left_semi").select("unit").unionByName(units.where("tagged").select("unit")).distinct()
        spoken = units.join(hits, "unit", "left_semi")
    spoken = written(spoken, "units")
    distinct = spoken.groupBy("unit").agg(F.first("terms").alias("terms"))
    words = distinct.select("unit", F.explode("terms").alias("term")).groupBy("unit", "term").agg(F.count("*").alias("tf"))
    unit_w = written(weighted(words).select("unit", "term", "w"), "weights")
    unit_norm = unit_w.groupBy("unit").agg(F.sqrt(F.sum(square)).alias("unit_norm"))
    template_norm = template_w.groupBy("license", "statement").agg(F.sqrt(F.sum(square)).alias("template_norm"))
    dots = unit_w.alias("l").join(small(template_w).alias("t"), "term").groupBy("unit", "license", "statement").agg(F.sum(F.col("l.w") * F.col("t.w")).alias("dot"))
    scored = dots.join(unit_norm, "unit").join(small(template_norm), ["license", "statement"])
    scored = scored.withColumn("score", F.round(F.col("dot") / (F.col("unit_norm") * F.col("template_norm")), 6)).where(F.col("score") >= hint)
    best = scored.groupBy("unit").agg(F.min(F.struct((-F.col("score")).alias("s"), "license")).alias("b"))
    own = cut(spoken.join(best, "unit", "left").groupBy("doc_id", "path").agg(F.min("b").alias("b"), F.bool_or("tagged").alias("tagged")).where("b is not null or tagged").select(
        "doc_id", "path", (-F.col("b.s")).alias("own_score"), F.col("b.license").alias("hinted"), F.when(-F.col("b.s") >= cosine, F.col("b.license")).alias("own")))
    folder = F.regexp_replace(F.regexp_extract("path", r"^(.*)/[^/]*$", 1), "/+$", "")
    named = own.where(_is_license() & F.col("own").isNotNull()).withColumn("folder", folder)
    of_folder = named.groupBy(F.col("folder").alias("ancestor")).agg(F.min(F.struct((-F.col("own_score")).alias("s"), F.col("own").alias("license"))).alias("f"))
    every = whole.select("doc_id", "path").distinct().withColumn("folder", F.when(F.col("path").isNotNull(), folder))
    folders = every.select("folder").where("folder is not null").distinct()
    steps = F.split("folder", "/")
    up = folders.select("folder", F.explode(F.transform(F.sequence(F.lit(0), F.size(steps)), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(steps, 1, i), "/").alias("ancestor")))).alias("u"))
    near = up.select("folder", "u.depth", "u.ancestor").join(of_folder, "ancestor").groupBy("folder").agg(F.max_by("f", "depth").alias("f"))
    mine = F.col("e.doc_id").eqNullSafe(F.col("o.doc_id")) & F.col("e.path").eqNullSafe(F.col("o.path"))
    out = every.alias("e").join(own.withColumn("speaks", F.lit(True)).alias("o"), mine, "left").join(near, "folder", "left")
    basis = (
        F.when(F.col("own").isNotNull(), "own").when(F.col("f").isNotNull() & (F.col("speaks").isNull() | (F.col("hinted") == F.col("f.license"))), "inherited").when(F.col("speaks"), "unclear").otherwise("none")
    )
    return out.withColumn("basis", basis).select(
        "e.doc_id", "e.path", F.when(F.col("basis") == "own", F.col("own")).when(F.col("basis") == "inherited", F.col("f.license")).alias("license"), "basis",
        F.when(F.col("basis") == "inherited", -F.col("f.s")).otherwise(F.col("own_score")).alias("score"),
    )


#: Documents carry no path: source, package and file name are taken from doc_id; every fifth is its folder's licence file.
PATH = """CASE WHEN doc_id % 50 = 0 THEN source || '/LICENSE' WHEN doc_id % 5 = 0 THEN source || '/pkg' || CAST((doc_id // 25) % 40 AS VARCHAR) || '/LICENSE'
 ELSE source || '/pkg' || CAST((doc_id // 25) % 40 AS VARCHAR) || '/src/' || CAST(doc_id AS VARCHAR) || '.txt' END"""


def query(docs: DataFrame) -> DataFrame:
    path = PATH.replace("(doc_id // 25)", "(doc_id div 25)").replace("VARCHAR", "STRING")
    templates = docs.sparkSession.createDataFrame([*STATEMENTS], "license string, statement string")
    return scan(docs.select("doc_id", F.expr(path).alias("path"), "text"), templates)


_HEADER = rf"""trim(array_to_string(list_transform(f_[1 : CASE WHEN o_ > 0 THEN o_ - 1 ELSE len(f_) END], lambda x: regexp_extract(x, '{COMMENT}', 1)), ' '))"""
_TERMS = f"""list_filter(regexp_split_to_array(CASE WHEN contains(lower({{0}}), '{TAG}') THEN regexp_replace(lower({{0}}), '{SPDX}', ' ', 'g') || ' spdx' || regexp_replace(regexp_extract(lower({{0}}), '{SPDX}', 1), '[+.-]', 'x', 'g') ELSE lower({{0}}) END, '{_BREAK}'), lambda x: x <> '')"""
#: All units against all templates.
ORACLE = rf"""
WITH tpl AS (SELECT * FROM ({TEMPLATES}) AS t(license, statement)),
paths AS (SELECT doc_id, {PATH} AS path, text FROM documents),
files AS (SELECT DISTINCT doc_id, path FROM paths),
cut_ AS (SELECT doc_id, path, text, string_split(text, chr(10)) AS ls, list_filter(ls, lambda x: trim(x, ' ') <> '') AS f_, coalesce(list_position(list_transform(f_, lambda x: regexp_matches(x, '{COMMENT}')), false), 0) AS o_, {_HEADER} AS header FROM paths WHERE text IS NOT NULL),
units AS (SELECT doc_id, path, unit, {_TERMS.format("unit")} AS terms FROM (SELECT doc_id, path, unnest(list_distinct(list_concat(list_transform(ls, lambda x: trim(x, ' ')), [header], CASE WHEN regexp_matches(regexp_extract(path, '([^/]*)$', 1), '{LICENSE_FILE}') THEN [trim(regexp_replace(text, '\s+', ' ', 'g'), ' ')] ELSE [] END))) AS unit FROM cut_)),
spoken AS (SELECT * FROM units WHERE len(terms) > 0),
words AS (SELECT line, term, count(*) AS tf FROM (SELECT line, unnest(terms) AS term FROM (SELECT DISTINCT unit AS line, terms FROM spoken)) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(terms)) AS term FROM spoken) GROUP BY ALL),
total AS (SELECT count(*) AS total FROM spoken),
line_w AS (SELECT line, term, tf * (ln((1 + total) / (1 + coalesce(df, 0))) + 1) AS w FROM words LEFT JOIN df USING (term), total),
stm AS (SELECT license, statement, term, count(*) AS tf FROM (SELECT license, statement, unnest({_TERMS.format("statement")}) AS term FROM tpl) GROUP BY ALL),
tpl_w AS (SELECT license, statement, term, tf * (ln((1 + total) / (1 + coalesce(df, 0))) + 1) AS w FROM stm LEFT JOIN df USING (term), total),
line_norm AS (SELECT line, sqrt(sum(w * w)) AS ln_ FROM line_w GROUP BY ALL),
tpl_norm AS (SELECT license, statement, sqrt(sum(w * w)) AS tn FROM tpl_w GROUP BY ALL),
dots AS (SELECT line, license, statement, sum(l.w * t.w) AS dot FROM line_w l JOIN tpl_w t USING (term) GROUP BY ALL),
scored AS (SELECT line, license, round(dot / (ln_ * tn), 6) AS score FROM dots JOIN line_norm USING (line) JOIN tpl_norm USING (license, statement)),
best AS (SELECT line, license, score FROM scored WHERE score >= {HINT} QUALIFY row_number() OVER (PARTITION BY line ORDER BY score DESC, license) = 1),
own AS (SELECT doc_id, path, license AS hinted, score AS own_score, CASE WHEN score >= {COSINE} THEN license END AS own FROM spoken LEFT JOIN best ON line = unit WHERE score IS NOT NULL OR contains(lower(unit), '{TAG}')
  QUALIFY row_number() OVER (PARTITION BY doc_id, path ORDER BY score DESC NULLS LAST, license) = 1),
of_folder AS (SELECT regexp_replace(path, '/[^/]*$', '') AS ancestor, own AS license, own_score AS score FROM own WHERE own IS NOT NULL AND regexp_matches(regexp_extract(path, '([^/]*)$', 1), '{LICENSE_FILE}')
  QUALIFY row_number() OVER (PARTITION BY regexp_replace(path, '/[^/]*$', '') ORDER BY own_score DESC, own) = 1),
folders AS (SELECT DISTINCT regexp_replace(path, '/[^/]*$', '') AS folder FROM files),
near AS (SELECT folder, license, score FROM (SELECT folder, i AS depth, array_to_string(list_slice(string_split(folder, '/'), 1, i), '/') AS ancestor FROM folders, unnest(range(1, len(string_split(folder, '/')) + 1)) AS r(i))
  JOIN of_folder USING (ancestor) QUALIFY row_number() OVER (PARTITION BY folder ORDER BY depth DESC) = 1),
judged AS (SELECT f.doc_id, f.path, o.own, o.own_score, n.license AS given, n.score AS given_score,
  CASE WHEN o.own IS NOT NULL THEN 'own' WHEN n.license IS NOT NULL AND (o.doc_id IS NULL OR o.hinted = n.license) THEN 'inherited' WHEN o.doc_id IS NOT NULL THEN 'unclear' ELSE 'none' END AS basis
  FROM files f LEFT JOIN own o ON f.doc_id = o.doc_id AND f.path = o.path LEFT JOIN near n ON n.folder = regexp_replace(f.path, '/[^/]*$', ''))
SELECT doc_id, path, CASE basis WHEN 'own' THEN own WHEN 'inherited' THEN given END AS license, basis, CASE basis WHEN 'inherited' THEN given_score ELSE own_score END AS score FROM judged
"""
