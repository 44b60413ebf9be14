"""op8: licence statements in every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .licences import scanned
from .queries import query

# Wording of public licence statements.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"
    ),
    "BSD-3-Clause": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0 header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "MIT": "Released under the MIT License.",
    "MIT permission": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, "
        "sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so."
    ),
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}
LEAST = 0.8

_ROWS = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in TEMPLATES.items())
_WORDS = "list_filter(string_split(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '')"
_BIGRAMS = "list_distinct(CASE WHEN len(w) = 1 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END)"

SQL = f"""
WITH t AS (SELECT licence, {_BIGRAMS} AS b FROM (SELECT licence, {_WORDS.format('x')} AS w FROM (VALUES {_ROWS}) v(licence, x))),
lines AS (
  SELECT doc_id, text, unnest(string_split(text, chr(10))) AS unit, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents
), units AS (
  SELECT doc_id, line::INTEGER AS line, {_WORDS.format('unit')} AS w FROM lines
  UNION ALL
  SELECT doc_id, 0, {_WORDS.format('text')} FROM documents
  WHERE len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(lower(x), '[a-z0-9]'))) > 1
), u AS (SELECT doc_id, line, {_BIGRAMS} AS b FROM units WHERE len(w) > 0),
d AS (
  SELECT doc_id, line, licence, 2 * len(list_intersect(u.b, t.b)) / (len(u.b) + len(t.b))::DOUBLE AS dice
  FROM u JOIN t ON len(u.b) BETWEEN len(t.b) / 2 AND len(t.b) * 2
)
SELECT doc_id, line, licence, dice FROM d WHERE dice >= {LEAST}
"""


@query("op8_licences", SQL)
def licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned(table(spark, sf_dir, "documents"), TEMPLATES, LEAST)
