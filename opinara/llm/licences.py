"""Licence recognition: sentences to identifiers, identifier sequences to licences.

A text is laid out as words with marks where a line or a sentence ends, known licence
sentences are found between two marks however their lines are wrapped, and the sequence
of identifiers found is held against ordered rules.  The tables are small fixed values,
so everything stays in one projection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Identifier -> licence sentence (lower case, letters and digits only).
SENTENCES = {
    "mit-name": "released under the mit license",
    "mit-title": "the mit license",
    "mit-title2": "mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "as-is-mit": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "apache-name": "licensed under the apache license version 2 0",
    "apache-header": "licensed under the apache license version 2 0 the license",
    "apache-use": "you may not use this file except in compliance with the license",
    "apache-copy": "you may obtain a copy of the license at",
    "apache-asis": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "gpl3-name": "this work is licensed under the gnu general public license version 3",
    "gpl-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl-hope": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "ccbync-name": "licensed under cc by nc 4 0",
    "ccby-name": "licensed under cc by 4 0",
    "ccbysa-name": "licensed under cc by sa 4 0",
    "mpl-terms": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "unlicense": "this is free and unencumbered software released into the public domain",
}

# Where a known sentence itself holds a sentence mark, the words before it.
CUTS = {
    "gpl-free": "this program is free software",
    "gpl-hope": "this program is distributed in the hope that it will be useful but without any warranty",
    "mpl-terms": "this source code form is subject to the terms of the mozilla public license v",
}

# Licence, kind of evidence, identifiers that follow one another.
RULES = (
    ("MIT", "notice", ("mit-name",)),
    ("MIT", "text", ("mit-grant", "mit-notice", "as-is-mit")),
    ("MIT", "text", ("mit-title", "mit-grant")),
    ("MIT", "text", ("mit-title2", "mit-grant")),
    ("Apache-2.0", "notice", ("apache-name",)),
    ("Apache-2.0", "header", ("apache-header", "apache-use", "apache-copy")),
    ("GPL-3.0", "notice", ("gpl3-name",)),
    ("GPL-3.0-or-later", "header", ("gpl-free", "gpl-hope")),
    ("CC-BY-NC-4.0", "notice", ("ccbync-name",)),
    ("CC-BY-4.0", "notice", ("ccby-name",)),
    ("CC-BY-SA-4.0", "notice", ("ccbysa-name",)),
    ("MPL-2.0", "header", ("mpl-terms",)),
    ("ISC", "text", ("isc-grant",)),
    ("BSD", "text", ("bsd-grant",)),
    ("Unlicense", "text", ("unlicense",)),
)


def laid_out(text: Column) -> Column:
    """Lower-case words parted by one character: ``S`` where a line ends, ``H`` where a
    sentence (., !, ?, ; or : before white space) or a paragraph ends, else a blank.
    Comment marks at the beginning of a line are not part of it."""
    t = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "\r\n?", "\n")
    t = F.regexp_replace(t, r"(?md)^[^a-z0-9\n]*+(?:(?:dnl|rem)[ \t]++)?", "")
    t = F.regexp_replace(t, r"[.!?;:][ \t]*+\n++|[.!?;:][ \t]++|\n[ \t]*+\n[ \t\n]*+", "H")
    t = F.regexp_replace(F.concat(F.lit("H"), F.regexp_replace(t, "\n", "S"), F.lit("H")), "[^a-z0-9HS]++", " ")
    return F.regexp_replace(F.regexp_replace(t, " ?S[ S]*+", "S"), "[ S]*H[ SH]*+", "H")


def _pattern() -> str:
    """Known sentences between two marks; a line may end anywhere inside, a sentence only
    where the known one has a mark.  Of two with the same beginning the longer is taken."""
    def one(key: str) -> str:
        head = CUTS.get(key, "")
        tail = SENTENCES[key][len(head):].strip().replace(" ", "[ S]")
        return head.replace(" ", "[ S]") + ("[ SH]" if head else "") + tail

    return "(?<=[HS])(?:" + "|".join(map(one, sorted(SENTENCES, key=lambda k: -len(SENTENCES[k])))) + ")(?=[HS])"


def recognise(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``licence_sentences`` (array<string>, identifiers in reading order)
    and ``licences`` (array<struct<licence,evidence>>, in rule order, each once).

    A rule matches where its identifiers follow one another with no other known
    sentence between.  A null or empty text has two empty arrays.
    """
    known = F.create_map(*[F.lit(x) for k, s in SENTENCES.items() for x in (s, k)])
    found = F.regexp_extract_all(laid_out(F.col(text)), F.lit(_pattern()), F.lit(0))
    ids = F.transform(found, lambda s: F.element_at(known, F.translate(s, "HS", "  ")))
    joined = F.concat(F.lit(","), F.concat_ws(",", F.col("licence_sentences")), F.lit(","))
    hit = [F.when(F.contains(joined, F.lit("," + ",".join(seq) + ",")),
                  F.struct(F.lit(name).alias("licence"), F.lit(kind).alias("evidence"))) for name, kind, seq in RULES]
    return docs.withColumn("licence_sentences", ids).withColumn(
        "licences", F.array_distinct(F.filter(F.array(*hit), lambda x: x.isNotNull())))


def _sql_rule(name: str, seq: tuple[str, ...]) -> str:
    return f"CASE WHEN contains(',' || ids || ',', ',{','.join(seq)},') THEN '{name}' END"


#: The op9 query in DuckDB's dialect.
SQL = f"""
WITH known(sentence, id) AS (VALUES {', '.join(f"('{s}', '{k}')" for k, s in SENTENCES.items())}),
lines AS (
  SELECT doc_id, rid, unnest(list) AS line, generate_subscripts(list, 1) AS pos
  FROM (SELECT doc_id, row_number() OVER () AS rid,
               string_split(regexp_replace(coalesce(text, ''), '([.!?;:])[ \\t\\r]+', '\\1' || chr(10), 'g'), chr(10)) AS list
        FROM documents)
), found AS (
  SELECT rid, any_value(doc_id) AS doc_id, coalesce(string_agg(id, ',' ORDER BY pos), '') AS ids, count(id) AS n
  FROM lines LEFT JOIN known ON length(line) BETWEEN 8 AND {2 * max(map(len, SENTENCES.values()))}
    AND sentence = trim(regexp_replace(lower(line), '[^a-z0-9]+', ' ', 'g'))
  GROUP BY rid
)
SELECT doc_id, CAST(n AS BIGINT) AS n_sentences, ids AS sentence_ids,
       array_to_string(list_sort(list_distinct(list_filter([{', '.join(_sql_rule(n, s) for n, _, s in RULES)}],
                                                           lambda x: x IS NOT NULL))), ',') AS licences
FROM found
"""
