"""Licence scan by sentences: normalised sentences become identifiers, identifier sequences are held against ordered rules.

Everything is one projection over a row: split, normalise, look up, match. No shuffle, no Python.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Identifiers of known licence sentences, and the normalised sentences (lower case, words one space apart).
SENTENCES = (
    ("APACHE2", "licensed under the apache license version 2 0( the license)?"),
    ("APACHE2_MAY", "you may not use this file except in compliance with the license"),
    ("APACHE2_COPY", "you may obtain a copy of the license at.*"),
    ("MIT", "(released|licensed|distributed) under the (terms of the )?mit license"),
    ("MIT_GRANT", "permission is hereby granted free of charge to any person obtaining a copy of this software.*"),
    ("MIT_KEEP", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("GPL3", "this (work|program|file|software) is licensed under the gnu general public license version 3( only)?"),
    ("GPL2", "this (work|program|file|software) is licensed under the gnu general public license version 2( only)?"),
    ("GPL_LATER", "(either )?version [23] of the license or at your option any later version"),
    ("GPL_FREE", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license.*"),
    ("LGPL", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license.*"),
    ("CC_BY_NC4", "licensed under (a )?cc by nc 4 0( license)?"),
    ("CC_BY4", "licensed under (a )?cc by 4 0( license)?"),
    ("CC0", "(released|dedicated) (in)?to the public domain( under cc0( 1 0)?)?"),
    ("BSD_REDIST", "redistribution and use in source and binary forms with or without modification are permitted.*"),
    ("BSD_ENDORSE", "neither the name of .* may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("MPL2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("WARRANTY", "(the|this) software is provided as is without warranty of any kind.*"),
    ("ALL_RIGHTS", "(copyright .*)?all rights reserved"),
)
# Licences and the identifier sequences that say them, the more special rule first.
RULES = (
    ("GPL-2.0-or-later", "GPL2 GPL_LATER"),
    ("GPL-3.0-or-later", "GPL3 GPL_LATER"),
    ("GPL-3.0", "GPL3"),
    ("GPL-2.0", "GPL2"),
    ("GPL-2.0-or-later", "GPL_FREE GPL_LATER"),
    ("GPL", "GPL_FREE"),
    ("LGPL", "LGPL"),
    ("Apache-2.0", "APACHE2 APACHE2_MAY APACHE2_COPY"),
    ("Apache-2.0", "APACHE2"),
    ("MIT", "MIT_GRANT MIT_KEEP WARRANTY"),
    ("MIT", "MIT_GRANT MIT_KEEP"),
    ("MIT", "MIT"),
    ("BSD-3-Clause", "BSD_REDIST BSD_ENDORSE WARRANTY"),
    ("BSD-3-Clause", "BSD_REDIST BSD_ENDORSE"),
    ("BSD-2-Clause", "BSD_REDIST"),
    ("CC-BY-NC-4.0", "CC_BY_NC4"),
    ("CC-BY-4.0", "CC_BY4"),
    ("CC0-1.0", "CC0"),
    ("MPL-2.0", "MPL2"),
)
#: Every sentence above holds one of these, so a text without any has no identifiers.
ANCHORS = ("licen", "permission", "copyright", "public domain", "redistribut", "software", "rights reserved")
# Any word of an anchor, for whole texts: an anchor's two words may stand on two lines.
ANCHOR_WORDS = ("licen", "permission", "copyright", "public", "redistribut", "software", "reserved")
# Notices that join clauses which SENTENCES and RULES know apart, tried before them, and their licences.
FREE = "this (program|library|file|work|software) is free software you can redistribute it and or modify it under the terms of the gnu {}general public license as published by the free software foundation"
FAMILIES = (("GPL", "", ("2", "3")), ("LGPL", "lesser ", ("2.1", "3")), ("AGPL", "affero ", ("3",)))
LATER = (("-or-later", " or at your option any later version"), ("", ""))
VERSIONS = [(family, kind, v, suffix, rest) for family, kind, versions in FAMILIES for v in versions for suffix, rest in LATER]
#: Licences that have an identifier of their own in a line of its own kind.
NAMED = ("Unlicense", "EPL-2.0", "BSL-1.0", "Zlib", "Apache-2.0", "MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause", "MPL-2.0", "CC0-1.0", "CC-BY-4.0", "CC-BY-NC-4.0", *(f"{f}-{v if '.' in v else v + '.0'}{s}" for f, _, v, s, _ in VERSIONS))


def token(name: str) -> str:
    return name.upper().replace("-", "_").replace(".", "_")


def full_name(family: str, version: str, suffix: str) -> str:
    return f"{family}-{version if '.' in version else version + '.0'}{suffix}"


# Titles of whole licences with their dates, and how a notice calls a licence.
TITLES = (
    ("Apache-2.0", "apache license version 2 0 january 2004( http www apache org licenses)?"),
    ("GPL-2.0", "gnu general public license version 2 june 1991"),
    ("GPL-3.0", "gnu general public license version 3 29 june 2007"),
    ("LGPL-2.1", "gnu lesser general public license version 2 1 february 1999"),
    ("LGPL-3.0", "gnu lesser general public license version 3 29 june 2007"),
    ("AGPL-3.0", "gnu affero general public license version 3 19 november 2007"),
    ("MPL-2.0", "mozilla public license version 2 0"),
    ("EPL-2.0", "eclipse public license v 2 0"),
    ("BSL-1.0", "boost software license version 1 0 august 17th 2003"),
)
CALLED = (
    ("Apache-2.0", "apache (software )?license (version |v )?2( 0)?"), ("MIT", "mit license"), ("ISC", "isc license"), ("BSD-3-Clause", "bsd 3 clause"), ("BSD-2-Clause", "bsd 2 clause"),
    ("MPL-2.0", "mozilla public license (version |v )?2( 0)?"), ("EPL-2.0", "eclipse public license (version |v )?2( 0)?"), ("BSL-1.0", "boost software license (version |v )?1( 0)?"),
)
THING = "(this|the) (project|software|code|source code|work|repository|package|library|program|module|file)"
#: What stands between the ends of a sentence that has a gap, in characters, at most.
GAP = 300
#: Marks of web pages within a notice.
TAGS = r"(?i)</?(?:br|p|div|span|li|ul|ol|b|i|em|strong|tt|code|pre|h[1-6]|td|tr|a)(?:\s[^<>]{0,200})?/?>"
SPDX = "spdx license identifier "

NOTICES = (
    *((token(full_name(f, v, s)) + "_FREE", f"{FREE.format(kind)} (either )?version {v.replace('.', ' ')} of the license{rest}") for f, kind, v, s, rest in VERSIONS),
    ("MIT_GRANT", "(the )?(mit license )?copyright .* permission is hereby granted free of charge to any person obtaining a copy of this software.*"),
    ("ISC", "((the )?(isc license )?copyright .* )?permission to use copy modify and (or )?distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
)
# Further sentences, tried after SENTENCES.
FURTHER = (
    *((token(name) + "_TITLE", pattern) for name, pattern in TITLES),
    *((token(name) + "_UNDER", f"({THING} )?(is |are )?(released|licensed|distributed|available|published) under (the )?(terms of )?(the )?{said}( license)?( see [^\n]*)?") for name, said in CALLED),
    ("UNLICENSE", "this is free and unencumbered software released into the public domain"),
    ("ZLIB_GRANT", "permission is granted to anyone to use this software for any purpose including commercial applications[^\n]*( and to alter it and redistribute it freely)?[^\n]*"),
    ("BSL1_GRANT", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license[^\n]*"),
)
NOTICE_RULES = (
    *((full_name(f, v, s), token(full_name(f, v, s)) + "_FREE") for f, _, v, s, _ in VERSIONS), ("ISC", "ISC"), *((n, token(n) + "_SPDX") for n in NAMED), *((n, token(n) + "_TITLE") for n, _ in TITLES),
    *((n, token(n) + "_UNDER") for n, _ in CALLED), ("Unlicense", "UNLICENSE"), ("Zlib", "ZLIB_GRANT"), ("BSL-1.0", "BSL1_GRANT"),
)
#: A sentence ends at a stop or mark before white space, but not at that of "v." before a number, and at a line without
#: letters and digits.
SPLIT = r"(?<![^a-zA-Z][vV])[.!?][ \t\r\n]+|\n[^a-zA-Z0-9\n]*\n"


def spread(pattern: str) -> str:
    """A sentence's pattern over several lines: a line may end at each space, what is skipped at the end stays on its line."""
    if "copyright .*" in pattern or pattern.endswith(".*"):
        pattern = pattern.replace(".*", r"[^\n]*")
    return pattern.replace(".*", r"[\s\S]{0,%d}?" % GAP).replace(" ", r"[ \n]")


#: A known sentence from a line's start to a line's end, or an SPDX line.
KNOWN = "(?m)^(?:" + "|".join([spread(SPDX.strip()) + r"[ \n][^\n]*", *[spread(p) for _, p in NOTICES + SENTENCES + FURTHER]]) + ")$"


def sentence_ids(text: Column) -> Column:
    """Identifiers of the known sentences of a text, in order.

    Within a sentence line ends, semicolons and colons are kept as line ends: it may go on behind them, or another begin.
    """

    def trimmed(s: Column) -> Column:
        marked = F.regexp_replace(F.regexp_replace(F.lower(s), r"[;:][ \t\r\n]", "\n"), r"[^a-z0-9\n]+", " ")
        return F.trim(F.regexp_replace(marked, r" ?\n[ \n]*", "\n"))

    one_line = lambda s: F.replace(s, F.lit("\n"), F.lit(" "))
    identify = lambda s: F.coalesce(*[F.when(s.rlike(f"^{pattern}$"), F.lit(name)) for name, pattern in NOTICES + SENTENCES + FURTHER])

    # trimmed sentences stand in a list of their own, so that each is normalised once
    normal = F.transform(F.split(F.when(text.contains("<"), F.regexp_replace(text, TAGS, " ")).otherwise(text), SPLIT), trimmed)
    anchored = F.filter(normal, lambda s: reduce(Column.__or__, [one_line(s).contains(a) for a in ANCHORS]))
    found = F.flatten(F.transform(anchored, lambda s: F.regexp_extract_all(s, F.lit(KNOWN), F.lit(0))))
    # an SPDX line has an expression: names joined by or, and, with; names that aren't known say nothing
    names = F.create_map(*[F.lit(x) for n in NAMED for x in (n.lower().replace("-", " ").replace(".", " "), token(n) + "_SPDX")])
    of_line = lambda s: F.transform(F.split(F.substring(s, len(SPDX) + 1, 1 << 30), " (?:or(?! later)|and|with) "), lambda n: F.element_at(names, F.trim(n)))
    each = F.transform(F.transform(found, one_line), lambda s: F.when(s.startswith(SPDX), of_line(s)).otherwise(F.array(identify(s))))
    return F.filter(F.flatten(each), F.isnotnull)


def licences_of(ids: Column) -> Column:
    """Licences whose rules match a sequence of identifiers; a matched sequence is used up by the first rule."""
    rest, found = F.concat(F.lit(" "), F.array_join(ids, "  "), F.lit(" ")), []
    for name, sequence in NOTICE_RULES + RULES:
        pattern = " " + "  ".join(sequence.split()) + " "
        found.append(F.when(rest.contains(pattern), F.lit(name)))
        rest = F.replace(rest, F.lit(pattern), F.lit(" | "))
    return F.array_sort(F.array_distinct(F.filter(F.array(*found), F.isnotnull)))


def scan(docs: DataFrame) -> DataFrame:
    """For each row of ``docs``: doc_id, n_known long, sentence_ids and licenses (comma-joined strings).

    Null and empty texts, and texts without known sentences, have 0 and empty strings. Sentences end at a full stop
    or mark before white space or a blank line, and may end at a semicolon, a colon or a line's end or go on behind it; case,
    marks (those of comments too) and spacing don't count. Rows that repeat are
    scanned each, a null doc_id stays null.
    """
    text = F.coalesce("text", F.lit(""))
    low = F.lower(text)
    anchored = reduce(Column.__or__, [low.contains(a) for a in ANCHOR_WORDS])
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.when(anchored, sentence_ids(text)).otherwise(F.array().cast("array<string>")).alias("ids"))
    return ids.select(
        "doc_id", F.size("ids").cast("long").alias("n_known"), F.array_join("ids", ",").alias("sentence_ids"), F.array_join(licences_of(F.col("ids")), ",").alias("licenses"),
    )


def oracle_sql() -> str:
    """The same scan as DuckDB SQL, for texts whose known sentences stand on a line each and aren't among NOTICES."""
    known = "coalesce(" + ", ".join(f"CASE WHEN regexp_full_match(s, '{p}') THEN '{n}' END" for n, p in SENTENCES) + ")"
    steps, last = [], "' ' || array_to_string(ids, '  ') || ' '"
    steps.append(f"r0 AS (SELECT *, {last} AS t0 FROM i)")
    for k, (_, sequence) in enumerate(RULES):
        pattern = " " + "  ".join(sequence.split()) + " "
        steps.append(f"r{k + 1} AS (SELECT *, contains(t{k}, '{pattern}') AS m{k}, replace(t{k}, '{pattern}', ' | ') AS t{k + 1} FROM r{k})")
    found = ", ".join(f"CASE WHEN m{k} THEN '{name}' END" for k, (name, _) in enumerate(RULES))
    return f"""
        WITH i AS (
            SELECT doc_id, list_filter(list_transform(list_transform(regexp_split_to_array(coalesce(text, ''), '[.!?;][ \\t\\r\\n]+|\\n'),
                lambda x: trim(regexp_replace(lower(x), '[^a-z0-9]+', ' ', 'g'))), lambda s: {known}), lambda x: x IS NOT NULL) AS ids
            FROM documents),
        {", ".join(steps)}
        SELECT doc_id, len(ids)::BIGINT AS n_known, coalesce(array_to_string(ids, ','), '') AS sentence_ids,
               coalesce(array_to_string(list_sort(list_distinct(list_filter([{found}], lambda x: x IS NOT NULL))), ','), '') AS licenses
        FROM r{len(RULES)}"""
