"""Operator 3, licence scans by sentence rules: normalised sentences become the identifiers of known licence sentences,
and the sequence of identifiers is matched against ordered licence rules. All in column expressions, without an exchange."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crosstally.llm.common import read

# Ways to refer to a licence, and the licences' names, both as normalised text.
LEADS = (
    "governed by", "use of this source code is governed by", "licensed under", "released under", "distributed under", "published under", "available under", "provided under",
    "this work is licensed under", "this software is licensed under", "this project is licensed under", "this file is licensed under",
    "this code is licensed under", "this document is licensed under", "this work is released under", "this software is released under",
    "this project is released under", "this software is distributed under", "this work is distributed under", "this program is released under",
    "this content is licensed under", "this article is licensed under", "the source code is licensed under", "this program is licensed under",
)
NAMES = {
    "MIT": ("mit license", "mit licence", "mit"),
    "Apache-2.0": ("apache license version 2 0", "apache license 2 0", "apache 2 0 license", "apache 2 0"),
    "GPL-2.0": ("gnu general public license version 2", "gnu gpl version 2", "gplv2", "gpl 2 0"),
    "GPL-3.0": ("gnu general public license version 3", "gnu gpl version 3", "gplv3", "gpl 3 0"),
    "LGPL-2.1": ("gnu lesser general public license version 2 1", "lgpl 2 1"),
    "LGPL-3.0": ("gnu lesser general public license version 3", "lgpl 3 0"),
    "AGPL-3.0": ("gnu affero general public license version 3", "agpl 3 0"),
    "MPL-2.0": ("mozilla public license version 2 0", "mozilla public license v 2 0", "mpl 2 0"),
    "BSD-2-Clause": ("bsd 2 clause license", "simplified bsd license"),
    "BSD-3-Clause": ("bsd 3 clause license", "new bsd license", "modified bsd license"),
    "ISC": ("isc license",),
    "Unlicense": ("unlicense",),
    "LicenseRef-BSD-style": ("bsd style license", "bsd license"),
    "CC0-1.0": ("cc0 1 0", "cc0 1 0 universal", "creative commons zero 1 0"),
    "CC-BY-4.0": ("cc by 4 0", "creative commons attribution 4 0 international license"),
    "CC-BY-SA-4.0": ("cc by sa 4 0", "creative commons attribution sharealike 4 0 international license"),
    "CC-BY-NC-4.0": ("cc by nc 4 0", "creative commons attribution noncommercial 4 0 international license"),
    "CC-BY-ND-4.0": ("cc by nd 4 0", "creative commons attribution noderivatives 4 0 international license"),
    "CC-BY-NC-SA-4.0": ("cc by nc sa 4 0", "creative commons attribution noncommercial sharealike 4 0 international license"),
}
# Sentences of the licence texts and of the usual file headers, normalised.
TEXTS = {
    "mitGrant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mitWarranty": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "mitLiability": "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "iscGrant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "apacheYouMay": "you may not use this file except in compliance with the license",
    "apacheUnder": "licensed under the apache license version 2 0 the license",
    "apacheAsIs": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apacheSee": "see the license for the specific language governing permissions and limitations under the license",
    "gpl2OrLater": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl3OrLater": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gplUseful": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "gplSee": "see the gnu general public license for more details",
    "gplCopy": "you should have received a copy of the gnu general public license along with this program",
    "mplSubject": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "mplCopy": "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0",
    "unlicenseFree": "this is free and unencumbered software released into the public domain",
    "allRights": "all rights reserved",
}
#: Ordered rules: the first that matches takes its identifiers; the next ones see what is left.
RULES = (
    ("MIT", ("mitGrant", "mitWarranty", "mitLiability")),
    ("ISC", ("iscGrant",)),
    ("Apache-2.0", ("apacheUnder", "apacheYouMay", "apacheAsIs", "apacheSee")),
    ("Apache-2.0", ("apacheUnder", "apacheYouMay")),
    ("GPL-2.0-or-later", ("gpl2OrLater", "gplUseful", "gplSee", "gplCopy")),
    ("GPL-2.0-or-later", ("gpl2OrLater",)),
    ("GPL-3.0-or-later", ("gpl3OrLater", "gplUseful", "gplSee", "gplCopy")),
    ("GPL-3.0-or-later", ("gpl3OrLater",)),
    ("MPL-2.0", ("mplSubject", "mplCopy")),
    ("MPL-2.0", ("mplSubject",)),
    ("Unlicense", ("unlicenseFree",)),
    ("MIT", ("mitGrant",)),
    *((name, (f"ref{name}",)) for name in NAMES),
    ("Proprietary", ("allRights",)),
)
#: Comment marks at the start of a line, which would hide the blank lines of a commented licence.
MARKS = r"\n[ \t]*(?:#+|//+|\*+|;+|--+|%+)[ \t]*"
BREAK = r"[.!?]+\s+|\n\s*\n"

# Sentences of the BSD texts, and the MIT and Apache sentences as the texts break them.
BSD_PERMIT = "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"
BSD_SOURCE = "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"
BSD_BINARY = "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
BSD_NEITHER = "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"
BSD_ADVERT = "all advertising materials mentioning features or use of this software must display the following acknowledgement"
MIT_PERMIT, MIT_NOTICE = TEXTS["mitGrant"].split(" the above ")
MORE_TEXTS = {
    MIT_PERMIT: "mitPermit",
    f"the above {MIT_NOTICE}": "mitNotice",
    "this source code form is subject to the terms of the mozilla public license v": "mplSubject",  # the break after "v."
    "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0": "mplCopy",
    "the asf licenses this file to you under the apache license version 2 0 the license": "apacheAsf",
    BSD_PERMIT: "bsdPermit",
    f"{BSD_PERMIT} 1": "bsdPermit",
    BSD_SOURCE: "bsdSource",
    f"{BSD_PERMIT} {BSD_SOURCE}": "bsdPermitSource",  # a list with bullets, without a blank line before it
    BSD_BINARY: "bsdBinary",
    BSD_NEITHER: "bsdNeither",
    BSD_ADVERT: "bsdAdvert",
}
#: Sentences with a free part, normalised, and what they count as.
FREE_PARTS = (
    (r"^neither the names? of .{1,120} nor the names of (?:its|their|any) contributors may ", "neither the name of the copyright holder nor the names of its contributors may "),
    (r"^all advertising materials mentioning features or use of this software must display the following acknowledge?ment .*$", BSD_ADVERT),
)
GNU = {
    "GPL-2.0": ("gpl2", "gnu general public license", "2"),
    "GPL-3.0": ("gpl3", "gnu general public license", "3"),
    "LGPL-2.0": ("lgpl2", "gnu library general public license", "2"),
    "LGPL-2.1": ("lgpl21", "gnu lesser general public license", "2 1"),
    "LGPL-3.0": ("lgpl3", "gnu lesser general public license", "3"),
    "AGPL-3.0": ("agpl3", "gnu affero general public license", "3"),
}
_BSD = (("bsdPermit", "bsdSource", "bsdBinary"), ("bsdPermitSource", "bsdBinary"))
#: Tried after the rules of whole texts above and before those of references.
MORE_RULES = (
    ("MIT", ("mitPermit", "mitNotice", "mitWarranty", "mitLiability")),
    ("MIT", ("mitPermit", "mitNotice")),
    ("Apache-2.0", ("apacheAsf", "apacheYouMay", "apacheAsIs", "apacheSee")),
    ("Apache-2.0", ("apacheAsf", "apacheYouMay")),
    *(("BSD-4-Clause", (*first, "bsdAdvert", "bsdNeither")) for first in _BSD),
    *(("BSD-3-Clause", (*first, "bsdNeither")) for first in _BSD),
    *(("BSD-2-Clause", first) for first in _BSD),
    *((f"{name}-{kind}", (f"{stem}{tag}",)) for name, (stem, _, _) in GNU.items() for kind, tag in (("or-later", "OrLater"), ("only", "Only"))),
)


def all_rules() -> tuple:
    at = next(k for k, (_, seq) in enumerate(RULES) if seq[0].startswith("ref"))
    return (*RULES[:at], *MORE_RULES, *RULES[at:])


def all_sentences() -> dict[str, str]:
    """normalised sentence -> identifier: all that are known."""
    found = sentences()
    for text, name in MORE_TEXTS.items():
        found.setdefault(text, name)
    for name, (stem, full, version) in GNU.items():
        for kind in ("program", "library", "software", "file"):
            start = f"this {kind} is free software you can redistribute it and or modify it under the terms of the {full} as published by the free software foundation"
            found.setdefault(f"{start} either version {version} of the license or at your option any later version", f"{stem}OrLater")
            found.setdefault(f"{start} version {version} of the license", f"{stem}Only")
            found.setdefault(f"{start} version {version}", f"{stem}Only")
        for kind, tag in (("or later", "OrLater"), ("only", "Only")):
            found.setdefault(f"spdx license identifier {normal_text(name)} {kind}", f"{stem}{tag}")
    return {normal_text(text): name for text, name in found.items()}


def sentences() -> dict[str, str]:
    """normalised sentence -> identifier: the texts above, every lead with every name, and the SPDX tags."""
    found = {text: name for name, text in TEXTS.items()}
    for licence, names in NAMES.items():
        for name in names:
            for lead in LEADS:
                found.setdefault(f"{lead} {name}", f"ref{licence}")
            found.setdefault(f"license {name}", f"ref{licence}")
        found[f"spdx license identifier {normal_text(licence)}"] = f"ref{licence}"
    return found


#: Between a lead and a name these words say nothing; they are left out, in known sentences too.
FILLING = r"\b(under|governed by) (?:the terms (?:and conditions )?of )?(?:the |an? )"


def normal_text(text: str) -> str:
    plain = " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in text.lower()).split())
    return re.sub(FILLING, r"\1 ", plain)


def normal(sentence: Column) -> Column:
    return F.regexp_replace(F.trim(F.regexp_replace(sentence, "[^a-z0-9]+", " ")), FILLING, "$1 ")


def identifiers(text: Column) -> Column:
    """The identifiers of the known sentences of a whole text, in order. A sentence that runs over several lines is
    tried as a whole first, then line by line, or by what its semicolons part, if that finds more."""
    known = all_sentences()
    table = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    hit = lambda s: s.isin(list(known))

    def whole(sentence: Column) -> Column:
        found = normal(sentence)
        for free, fixed in FREE_PARTS:
            found = F.regexp_replace(found, free, fixed)
        return found

    def of(sentence: Column) -> Column:
        lines = lambda s: F.filter(F.transform(F.split(s, "\n"), normal), hit)
        part = lambda s: F.when(hit(whole(s)), F.array(whole(s))).otherwise(lines(s))
        parts = F.flatten(F.transform(F.split(sentence, r";\s+"), part))
        split = F.when(F.contains(sentence, F.lit(";")) & (F.size(parts) > F.size(lines(sentence))), parts).otherwise(lines(sentence))
        return F.when(hit(whole(sentence)), F.array(whole(sentence))).otherwise(split)

    # Only sentences that can be known are looked at: all hold one of a few words.
    telling = r"licen|spdx|copyright|permission|software|under|mozilla|mpl|gnu|rights|redistribut"
    plain = F.regexp_replace(F.concat(F.lit("\n"), F.lower(F.coalesce(text.cast("string"), F.lit("")))), MARKS, "\n")
    parts = F.filter(F.split(plain, BREAK), lambda s: s.rlike(telling))
    return F.transform(F.flatten(F.transform(parts, of)), lambda s: F.element_at(table, s))


def match(ids: Column) -> Column:
    """The licences of a sequence of identifiers, comma separated, in the order of the rules."""
    state = F.struct(F.concat(F.lit("|"), F.array_join(ids, "|"), F.lit("|")).alias("left"), F.lit("").alias("got"))
    rules = F.array(*[F.struct(F.lit(name).alias("name"), F.lit("|" + "|".join(seq) + "|").alias("seq")) for name, seq in all_rules()])

    def step(acc: Column, rule: Column) -> Column:
        taken = F.replace(acc["left"], rule["seq"], F.lit("|"))
        return F.when(F.contains(acc["left"], rule["seq"]), F.struct(taken.alias("left"), F.concat(acc["got"], F.lit(","), rule["name"]).alias("got"))).otherwise(acc)

    found = F.array_distinct(F.filter(F.split(F.aggregate(rules, state, step, lambda acc: acc["got"]), ","), lambda x: x != ""))
    return F.when(F.size(ids) == 0, F.lit("")).otherwise(F.array_join(found, ","))


def scan(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, n_known, sentence_ids, licenses) of every row; null and empty texts have no sentence and no licence."""
    found = df.select(F.col(key), identifiers(F.col(text)).alias("_ids"))
    return found.select(key, F.size("_ids").cast("long").alias("n_known"), F.array_join("_ids", ",").alias("sentence_ids"), match(F.col("_ids")).alias("licenses"))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known sentences and licences of every document, a row per row. Null and empty texts have none; other columns are
    not read; an empty table gives no row."""
    return scan(read(spark, sf_dir, "documents"), "doc_id")


def _sql() -> str:
    known, rules = all_sentences(), all_rules()
    quoted = ", ".join(f"('{k}', '{v}')" for k, v in known.items())
    norm = lambda c: rf"regexp_replace(trim(regexp_replace({c}, '[^a-z0-9]+', ' ', 'g')), '{FILLING}', '\1 ', 'g')"

    def whole(c: str) -> str:
        found = norm(c)
        for free, fixed in FREE_PARTS:
            found = f"regexp_replace({found}, '{free}', '{fixed}', 'g')"
        return found

    steps = ["m0 AS (SELECT *, '|' || array_to_string(ids, '|') || '|' AS rest, '' AS got FROM found)"]
    for k, (name, seq) in enumerate(rules, 1):
        pattern = "|" + "|".join(seq) + "|"
        steps.append(f"m{k} AS (SELECT rid, doc_id, ids, replace(rest, '{pattern}', '|') AS rest, CASE WHEN contains(rest, '{pattern}') THEN got || ',{name}' ELSE got END AS got FROM m{k - 1})")
    return (
        f"WITH known(s, id) AS (VALUES {quoted}),\n"
        f"docs AS (SELECT row_number() OVER () AS rid, doc_id, regexp_replace(chr(10) || lower(COALESCE(text, '')), '{MARKS}', chr(10), 'g') AS t FROM documents),\n"
        f"cut AS (SELECT rid, p, generate_subscripts(p, 1) AS i, unnest(p) AS s FROM (SELECT rid, regexp_split_to_array(t, '{BREAK}') AS p FROM docs)),\n"
        f"sent AS MATERIALIZED (SELECT rid, i, cut.s AS raw, known.id FROM cut LEFT JOIN known ON {whole('cut.s')} = known.s),\n"
        "clauses AS (SELECT rid, i, generate_subscripts(p, 1) AS k, unnest(p) AS part FROM (SELECT rid, i, regexp_split_to_array(raw, ';\\s+') AS p FROM sent WHERE id IS NULL AND contains(raw, ';'))),\n"
        f"clauses2 AS MATERIALIZED (SELECT rid, i, k, part, known.id FROM clauses LEFT JOIN known ON {whole('part')} = known.s),\n"
        f"lines AS MATERIALIZED (SELECT rid, i, 0 AS k, j, known.id FROM (SELECT rid, i, generate_subscripts(string_split(raw, chr(10)), 1) AS j, unnest(string_split(raw, chr(10))) AS line FROM sent WHERE id IS NULL) JOIN known ON {norm('line')} = known.s),\n"
        "parted AS MATERIALIZED (SELECT rid, i, k, 0 AS j, id FROM clauses2 WHERE id IS NOT NULL UNION ALL "
        f"SELECT rid, i, k, j, known.id FROM (SELECT rid, i, k, generate_subscripts(string_split(part, chr(10)), 1) AS j, unnest(string_split(part, chr(10))) AS line FROM clauses2 WHERE id IS NULL) JOIN known ON {norm('line')} = known.s),\n"
        "more AS (SELECT p.rid, p.i FROM (SELECT rid, i, count(*) AS n FROM parted GROUP BY ALL) p LEFT JOIN (SELECT rid, i, count(*) AS n FROM lines GROUP BY ALL) l ON p.rid = l.rid AND p.i = l.i WHERE p.n > COALESCE(l.n, 0)),\n"
        "rows_ AS (SELECT rid, i, 0 AS k, 0 AS j, id FROM sent WHERE id IS NOT NULL UNION ALL SELECT * FROM lines ANTI JOIN more USING (rid, i) UNION ALL SELECT * FROM parted SEMI JOIN more USING (rid, i)),\n"
        "ids AS (SELECT rid, list(id ORDER BY i, k, j) AS ids FROM rows_ GROUP BY rid),\n"
        "found AS (SELECT d.rid, d.doc_id, COALESCE(ids.ids, []) AS ids FROM docs d LEFT JOIN ids ON d.rid = ids.rid),\n" + ",\n".join(steps) + "\n"
        "SELECT doc_id, CAST(len(ids) AS BIGINT) AS n_known, array_to_string(ids, ',') AS sentence_ids,\n"
        "  array_to_string(list_reduce(list_prepend(CAST([] AS VARCHAR[]), list_transform(list_filter(string_split(got, ','), lambda x: x <> ''), lambda x: [x])), lambda a, b: CASE WHEN list_contains(a, b[1]) THEN a ELSE list_concat(a, b) END), ',') AS licenses "
        f"FROM m{len(rules)}"
    )


OP3_SQL = _sql()
