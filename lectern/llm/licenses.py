"""License detection by sparse TF-IDF cosine, and inheritance from licence files, in DataFrame operations only.

Templates are the notices, file headers and texts or title blocks of licence files that the licenses prescribe. Texts are
sequences of tokens, so that line ends, comment signs and indentation do not count. A header or notice
may stand anywhere: a template is compared with windows of its own length, the cosine being that of TF-IDF vectors whose
document frequencies are those of the templates.

Which windows can reach MIN_COSINE is settled by two bounds that lose none. What a stretch of text shares with a
template is at most the norm of the template's weights on the tokens that it holds (Cauchy and Schwarz); stretches under the bound are
left out. And a window must hold one of the template's KEYS: its heaviest tokens, so many that the rest alone
is too light. Every key is laid on each place that it has in the template, and the window is what the template would cover.

A window and its template hold the same MARKS, words that tell similar licenses apart. A document's own license is that
of its best window; ties go to the longer template, then to the name. RESERVED, which stands in free licenses
too, counts only where nothing else is found. Licence files, known by name, speak for their directory; a document
without a license of its own takes that of its nearest ancestor directory that has one, found by joining directories, not
documents, with their ancestors.

Distinct windows are scored once, so that a notice that many documents share costs one row.

Cases: null and empty texts have no tokens; a null path has no directory and inherits nothing; repeated rows are judged
alike; very long texts are cut into pieces that overlap by the longest template; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import MEMBERS, cut, join_hot

# The wordings that the licenses prescribe for notices, headers and licence files.
_MIT_GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"
_GNU = "This {what} is free software{sign} you can redistribute it and/or modify it under the terms of the GNU {name}General Public License as published by the Free Software Foundation{cut} either version {version} of the License, or (at your option) any later version."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
_BSD_TWO = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT license."),
    ("MIT", "Licensed under the MIT license. See the LICENSE file in the project root for license information."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."),
    ("MIT", _MIT_GRANT),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements. See the NOTICE file distributed with this work for additional information regarding copyright ownership. The ASF licenses this file to you under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", _GNU.format(what="program", sign=":", name="", cut=",", version="3")),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation."),
    ("GPL-2.0", _GNU.format(what="program", sign=";", name="", cut=";", version="2")),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 Free Software Foundation, Inc."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", _GNU.format(what="library", sign=":", name="Lesser ", cut=",", version="3")),
    ("LGPL-3.0", _GNU.format(what="program", sign=":", name="Lesser ", cut=",", version="3")),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc."),
    ("LGPL-2.1", "This library is licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-2.1", _GNU.format(what="library", sign=";", name="Lesser ", cut=";", version="2.1")),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999 Copyright (C) 1991, 1999 Free Software Foundation, Inc."),
    ("LGPL-2.0", _GNU.format(what="library", sign=";", name="Library ", cut=";", version="2")),
    ("AGPL-3.0", "This program is licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", _GNU.format(what="program", sign=":", name="Affero ", cut=",", version="3")),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007 Copyright (C) 2007 Free Software Foundation, Inc."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0."),
    ("MPL-2.0", "Mozilla Public License Version 2.0 1. Definitions 1.1. Contributor means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software."),
    ("BSD-2-Clause", _BSD + _BSD_TWO),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("BSD-3-Clause", _BSD + _BSD_TWO + " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights under CC0 1.0."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Proprietary", "Copyright. All rights reserved. Unauthorized copying of this file is strictly prohibited."),
    ("Proprietary", "All rights reserved."),
)
#: The template that counts only where no other is found.
RESERVED = len(TEMPLATES) - 1
TOKEN = r"[a-z0-9]+(?:\.[0-9]+)*"
FILE = r"(?i)(?:^|/)(?:licen[sc]e|copying|unlicense|notice)[^/]*$"
MIN_COSINE = 0.75
#: Words that tell similar licenses apart (fixed values).
MARKS = ("affero", "lesser", "library", "mozilla", "nc", "noncommercial", "nd", "noderivatives", "sa", "sharealike", "2", "2.1", "3", "3.0", "2.0", "4.0")
#: Tokens of a piece of text, beside the overlap.
PIECE = 512

_TOKENS = [re.findall(TOKEN, text.lower()) for _, text in TEMPLATES]
LONGEST = max(map(len, _TOKENS))


def vectors() -> tuple[list[tuple[int, str, float, float]], float]:
    """(template, token, idf, weight in the unit vector) and the idf of unknown tokens."""
    bags = [Counter(t) for t in _TOKENS]
    df = Counter(t for b in bags for t in b)
    idf = {t: math.log((1 + len(bags)) / (1 + n)) + 1 for t, n in df.items()}
    rows = []
    for i, bag in enumerate(bags):
        norm = math.sqrt(sum((n * idf[t]) ** 2 for t, n in bag.items()))
        rows += [(i, t, idf[t], n * idf[t] / norm) for t, n in sorted(bag.items())]
    return rows, math.log(1 + len(bags)) + 1


def keys() -> list[tuple[int, str, int, int]]:
    """(template, token, place, length): the heaviest tokens of each template, so many that the others cannot reach MIN_COSINE."""
    found = []
    for i, tokens in enumerate(_TOKENS):
        rest = 1.0
        for _, t, _, w in sorted((r for r in vectors()[0] if r[0] == i), key=lambda r: (-r[3], r[1])):
            found += [(i, t, at, len(tokens)) for at, x in enumerate(tokens) if x == t]
            rest -= w * w
            if rest < MIN_COSINE**2 - 1e-9:
                break
    return found


def marks(i: int) -> str:
    return " ".join(sorted({t for t in _TOKENS[i] if t in MARKS}))


def _texts(values) -> Column:
    return F.array(*map(F.lit, values))


def windows(tokens: str) -> Column:
    """Of a piece of text (columns tokens and from): every window that may reach its template, as template and line (tokens joined by spaces)."""
    rows = vectors()[0]
    most: dict[str, float] = {}
    for _, t, _, w in rows:
        most[t] = max(most.get(t, 0.0), w * w)
    vocabulary = sorted(most)
    enough = F.lit(MIN_COSINE**2 - 1e-9)
    heaviest = F.map_from_arrays(_texts(vocabulary), _texts(most[t] for t in vocabulary))

    def known(i: int) -> Column:
        """A template: its number, length, squared weights and keys with their places. All of it is constant."""
        own = [(t, w * w) for n, t, _, w in rows if n == i]
        places: dict[str, list[int]] = {}
        for n, t, at, _ in keys():
            if n == i:
                places.setdefault(t, []).append(at)
        named = F.map_from_arrays(_texts(places), F.array(*(_texts(p) for p in places.values())))
        return F.struct(F.lit(i).alias("i"), F.lit(len(_TOKENS[i])).alias("n"), F.map_from_arrays(_texts(t for t, _ in own), _texts(w for _, w in own)).alias("w"), named.alias("at"))

    def judge(shared: Column) -> Column:
        mass = lambda x: F.aggregate(shared, F.lit(0.0), lambda s, t: s + F.coalesce(F.element_at(x["w"], t), F.lit(0.0)))
        bound = F.aggregate(shared, F.lit(0.0), lambda s, t: s + F.element_at(heaviest, t))
        return F.when(bound >= enough, F.filter(F.array(*map(known, range(len(TEMPLATES)))), lambda x: mass(x) >= enough))

    def lay(x: Column) -> Column:
        held = F.filter(F.transform(tokens, lambda t, p: F.struct(p.alias("p"), F.element_at(x["at"], t).alias("at"))), lambda y: y["at"].isNotNull())
        starts = F.array_distinct(F.flatten(F.transform(held, lambda y: F.transform(y["at"], lambda a: y["p"] - a))))
        # A window that begins before the piece belongs to the piece before, which holds it whole.
        starts = F.filter(starts, lambda s: ((s >= 0) | (F.col("from") == 0)) & (s < PIECE))
        line = lambda s: F.array_join(F.slice(tokens, F.greatest(s, F.lit(0)) + 1, x["n"] + F.least(s, F.lit(0))), " ")
        return F.transform(starts, lambda s: F.struct(x["i"].alias("template"), line(s).alias("line")))

    # Bound as an element, so that the tokens of the vocabulary are looked up once.
    able = F.get(F.transform(F.array(F.array_intersect(tokens, _texts(vocabulary))), judge), F.lit(0))
    return F.flatten(F.transform(able, lay))


def templates(spark: SparkSession) -> DataFrame:
    return spark.sql(f"SELECT * FROM VALUES {_values()} AS t(template, token, idf, weight)")


def _values() -> str:
    return ", ".join(f"({i}, '{t}', {idf!r}D, {w!r}D)" for i, t, idf, w in vectors()[0])


def _per_template(of) -> Column:
    return F.element_at(_texts(of(i) for i in range(len(TEMPLATES))), F.col("template") + 1)


def score_lines(lines: DataFrame) -> DataFrame:
    """template, line, score of every distinct line that reaches MIN_COSINE; lines: line, and template where it is compared with one only."""
    one = "template" in lines.columns
    by = ["template", "line"] if one else ["line"]
    known = templates(lines.sparkSession)
    bags = lines.select(*by).distinct().select(*by, F.explode(F.regexp_extract_all(F.lower("line"), F.lit(TOKEN), F.lit(0))).alias("token"))
    bags = bags.groupBy(*by, "token").agg(F.count("*").alias("tf"))
    # The templates are a fixed table of some thousand rows.
    x = bags.join(F.broadcast(known.select("token", "idf").distinct()), "token", "left").withColumn("x", F.col("tf") * F.coalesce("idf", F.lit(vectors()[1])))
    if one:
        x = x.join(F.broadcast(known.drop("idf")), ["template", "token"], "left")
        both = x.groupBy("template", "line").agg(F.sum(F.col("x") * F.coalesce("weight", F.lit(0.0))).alias("dot"), F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    else:
        norm = x.groupBy("line").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
        both = x.join(F.broadcast(known.drop("idf")), "token").groupBy("template", "line").agg(F.sum(F.col("x") * F.col("weight")).alias("dot")).join(norm, "line")
    scored = both.withColumn("score", F.round(F.col("dot") / F.col("norm"), 6)).where(F.col("score") >= MIN_COSINE)
    own = F.array_join(F.array_sort(F.array_intersect(F.regexp_extract_all(F.lower("line"), F.lit(TOKEN), F.lit(0)), _texts(MARKS))), " ")
    return scored.where(own == _per_template(marks)).select("template", "line", "score")


def best(scored: DataFrame, by: str) -> DataFrame:
    """by, own_license, own_score: the license of the best of scored (by, template, score)."""
    rank = F.struct((F.col("template") == RESERVED).alias("weak"), (-F.col("score")).alias("s"), (-_per_template(lambda i: len(_TOKENS[i]))).alias("n"), _per_template(lambda i: TEMPLATES[i][0]).alias("license"))
    top = scored.groupBy(by).agg(F.min(rank).alias("b"))
    return top.select(by, F.col("b.license").alias("own_license"), (-F.col("b.s")).alias("own_score"))


def scan(files: DataFrame) -> DataFrame:
    """doc_id, path, own_license, own_score, license, license_dir for every row of files (doc_id, path, text).

    license_dir is the directory that the license is inherited from; null where it is the document's own.
    """
    text, path = F.coalesce(F.col("text").cast("string"), F.lit("")), F.col("path").cast("string")
    parent = F.when(path.contains("/"), F.regexp_replace(path, r"/[^/]*$", "")).when(path.isNotNull(), F.lit("."))
    rows = files.count()
    tokens = F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))
    # Tokens and pieces come out of generators, so that they are found once. The number of a row holds, as the plan is cut before it is read.
    slim = files.select(F.col("doc_id").cast("long").alias("doc_id"), path.alias("path"), parent.alias("dir"), F.monotonically_increasing_id().alias("k"), F.explode(F.array(tokens)).alias("all"))
    slim = slim.select("*", F.explode(F.sequence(F.lit(0), F.greatest(F.size("all") - 1, F.lit(0)), F.lit(PIECE))).alias("from")).withColumn("tokens", F.slice("all", F.col("from") + 1, F.lit(PIECE + LONGEST)))
    slim = cut(slim.select("doc_id", "path", "dir", "k", "from", windows("tokens").alias("windows")), rows, 5_000)
    held = slim.where(F.size("windows") > 0).select("k", F.explode("windows").alias("w")).select("k", "w.template", "w.line").distinct()
    members = held.groupBy("template", "line").agg(F.count("*").alias(MEMBERS))
    scored = cut(score_lines(members).join(members, ["template", "line"]))
    found = best(join_hot(held, scored, ["template", "line"], rows), "k")
    own = cut(slim.where("from = 0").select("doc_id", "path", "dir", "k").join(found, "k", "left").drop("k"), rows)

    speaking = own.where(F.col("own_license").isNotNull() & F.col("path").rlike(FILE)).groupBy(F.col("dir").alias("license_dir")).agg(F.min(F.struct((-F.col("own_score")).alias("s"), "own_license")).alias("b"))
    speaking = speaking.select("license_dir", F.col("b.own_license").alias("found"))
    parts = F.split("dir", "/")
    up = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    up = F.when(F.col("dir").startswith("/") | (F.col("dir") == ".") | (F.col("dir") == ""), up).otherwise(F.concat(F.array(F.lit(".")), up))
    dirs = own.where("dir IS NOT NULL").groupBy("dir").agg(F.count("*").alias(MEMBERS))
    ancestors = dirs.select("dir", MEMBERS, F.posexplode(up).alias("depth", "license_dir"))
    above = F.struct("depth", "license_dir", "found")
    nearest = ancestors.join(speaking, "license_dir").groupBy("dir", MEMBERS).agg(F.max(above).alias("b"))
    nearest = nearest.select("dir", MEMBERS, F.col("b.license_dir").alias("license_dir"), F.col("b.found").alias("found"))
    out = join_hot(own, nearest, ["dir"], rows, "left")
    return out.select("doc_id", "path", "own_license", "own_score", F.coalesce("own_license", "found").alias("license"), F.when(F.col("own_license").isNull(), F.col("license_dir")).alias("license_dir"))


def with_paths(docs: DataFrame) -> DataFrame:
    """doc_id, path, text of the driver's documents, which have no paths: a folder for each source and language,
    in it one for every thousand doc_ids; every document whose doc_id is divisible by LICENCE_FILE stands as a licence file beside these."""
    folder = F.concat(F.lit("/"), F.coalesce("source", F.lit("-")), F.lit("/"), F.coalesce("lang", F.lit("-")), F.lit("/"))
    name = F.when(F.col("doc_id") % LICENCE_FILE == 0, F.concat(F.lit("LICENSE-"), F.col("doc_id"))).otherwise(F.concat(F.expr("doc_id div 1000").cast("string"), F.lit("/"), F.col("doc_id"), F.lit(".txt")))
    return docs.select("doc_id", F.concat(folder, name).alias("path"), "text")


LICENCE_FILE = 10

_KEYS = ", ".join(f"({i}, '{t}', {at}, {n})" for i, t, at, n in keys())
_NAMES = ", ".join(f"({i}, '{name}', {len(_TOKENS[i])}, '{marks(i)}')" for i, (name, _) in enumerate(TEMPLATES))
#: Bound of whole texts, in the SQL; the tests also run the SQL without it.
_ABLE = "JOIN able USING (k, template)"
#: The same in plain form, without pieces.
ORACLE = rf"""
WITH tpl(template, token, idf, weight) AS (VALUES {_values().replace("D,", "::DOUBLE,").replace("D)", "::DOUBLE)")}
), named(template, license, n, marks) AS (VALUES {_NAMES}
), keyed(template, token, place, n) AS (VALUES {_KEYS}
), files AS (
  SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '{TOKEN}') AS w, '/' || coalesce(source, '-') || '/' || coalesce(lang, '-') || '/' ||
    CASE WHEN doc_id % {LICENCE_FILE} = 0 THEN 'LICENSE-' || doc_id ELSE (doc_id // 1000) || '/' || doc_id || '.txt' END AS path FROM documents
), f AS (SELECT *, regexp_replace(path, '/[^/]*$', '') AS dir, row_number() OVER () AS k FROM files
), able AS (
  SELECT k, template FROM (SELECT k, unnest(list_distinct(w)) AS token FROM f) JOIN tpl USING (token) GROUP BY k, template HAVING sum(weight * weight) >= {MIN_COSINE**2 - 1e-9!r}
), laid AS (
  SELECT DISTINCT k, template, i - 1 - place AS start, n FROM (SELECT k, unnest(w) AS token, generate_subscripts(w, 1) AS i FROM f) JOIN keyed USING (token) {_ABLE}
), held AS (
  SELECT DISTINCT k, template, w[greatest(start, 0) + 1:start + n] AS line FROM laid JOIN f USING (k)
), bags AS (SELECT template, line, token, count(*) AS tf FROM (SELECT template, line, unnest(line) AS token FROM (SELECT DISTINCT template, line FROM held)) GROUP BY ALL
), x AS (
  SELECT b.template, line, b.token, tf * coalesce(d.idf, {vectors()[1]!r}::DOUBLE) AS x, coalesce(t.weight, 0) AS weight
  FROM bags b LEFT JOIN (SELECT DISTINCT token, idf FROM tpl) d ON d.token = b.token LEFT JOIN tpl t ON t.template = b.template AND t.token = b.token
), scored AS (
  SELECT template, line, license, n, round(sum(x * weight) / sqrt(sum(x * x)), 6) AS score FROM x JOIN named USING (template)
  WHERE array_to_string(list_sort(list_distinct(list_filter(line, lambda t: t IN ({", ".join(repr(m) for m in MARKS)})))), ' ') = marks
  GROUP BY template, line, license, n HAVING round(sum(x * weight) / sqrt(sum(x * x)), 6) >= {MIN_COSINE}
), own AS (
  SELECT f.doc_id, f.path, f.dir, b.license AS own_license, b.score AS own_score FROM f LEFT JOIN (
    SELECT k, license, score FROM held JOIN scored USING (template, line) QUALIFY row_number() OVER (PARTITION BY k ORDER BY template = {RESERVED}, score DESC, n DESC, license) = 1) b USING (k)
), speaking AS (
  SELECT dir AS license_dir, own_license AS found FROM own WHERE own_license IS NOT NULL AND regexp_matches(path, '{FILE}')
  QUALIFY row_number() OVER (PARTITION BY dir ORDER BY own_score DESC, own_license) = 1
), nearest AS (
  SELECT d.dir, s.license_dir, s.found FROM (SELECT DISTINCT dir FROM own) d JOIN speaking s ON d.dir = s.license_dir OR starts_with(d.dir, s.license_dir || '/')
  QUALIFY row_number() OVER (PARTITION BY d.dir ORDER BY length(s.license_dir) DESC) = 1
)
SELECT doc_id, path, own_license, own_score, coalesce(own_license, found) AS license, CASE WHEN own_license IS NULL THEN license_dir END AS license_dir FROM own LEFT JOIN nearest USING (dir)
"""
