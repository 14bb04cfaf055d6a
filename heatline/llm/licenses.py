"""Licences of texts by known sentences and ordered rules over their sequence.

A text is brought into a plain form in which cuts are marked. Blank lines and sentence
ends before a capital part sentences for sure. Single line breaks, colons, semicolons
and stops before a small letter or digit may part them: a known sentence can begin or
end there, and can run across. So every run of pieces between cuts is a candidate
sentence, looked up in the map of known ones, the longest run first, whichever way a
notice is wrapped; what is found becomes identifiers in text order. A walk over that
sequence takes, at each place, the longest rule whose identifiers follow on end. Known
sentences that no rule used are reported as left over.

Everything is worked out within a row: no shuffle, so no source or group of copies
can crowd a task. Look-ups are by hash, so time hardly depends on how many sentences
and rules are known; ``register`` reads both from tables.

Defined results: NULL, empty and unlicensed texts have an empty sequence, no licence
and status ``none``. Repeated sentences are repeated identifiers; a licence is named
once, in the order of the rules.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heatline.llm.batches import fresh

# Sentences of public licences in plain form, and their identifiers.
_MIT_WARRANTY = (
    "the software is provided as is without warranty of any kind express or implied including but not limited to "
    "the warranties of merchantability fitness for a particular purpose and noninfringement"
)
_BSD_WARRANTY = (
    "this software is provided by the copyright holders and contributors as is and any express or implied "
    "warranties including but not limited to the implied warranties of merchantability and fitness for a "
    "particular purpose are disclaimed"
)
SENTENCES = {
    "released under the mit license": "mit-name",
    "licensed under the mit license": "mit-name",
    "this software is released under the mit license": "mit-name",
    "this project is licensed under the mit license": "mit-name",
    "the mit license": "mit-title",
    "mit license": "mit-title",
    "the mit license mit": "mit-title",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
    "documentation files the software to deal in the software without restriction including without limitation "
    "the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to "
    "permit persons to whom the software is furnished to do so subject to the following conditions": "mit-grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial "
    "portions of the software": "mit-notice",
    _MIT_WARRANTY: "mit-warranty",
    "in no event shall the authors or copyright holders be liable for any claim damages or other liability "
    "whether in an action of contract tort or otherwise arising from out of or in connection with the software "
    "or the use or other dealings in the software": "mit-liability",
    "licensed under the apache license version 2.0": "apache2-name",
    "licensed under the apache license version 2.0 the license": "apache2-name",
    "released under the apache license version 2.0": "apache2-name",
    "you may not use this file except in compliance with the license": "apache2-condition",
    "you may obtain a copy of the license at": "apache2-copy",
    "unless required by applicable law or agreed to in writing software distributed under the license is "
    "distributed on an as is basis without warranties or conditions of any kind either express or implied":
        "apache2-warranty",
    "see the license for the specific language governing permissions and limitations under the license":
        "apache2-see",
    "this work is licensed under the gnu general public license version 3": "gpl3-name",
    "licensed under the gnu general public license version 3": "gpl3-name",
    "this work is licensed under the gnu general public license version 2": "gpl2-name",
    "licensed under the gnu general public license version 2": "gpl2-name",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
    "public license as published by the free software foundation either version 3 of the license or at your "
    "option any later version": "gpl3-later",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
    "public license as published by the free software foundation either version 2 of the license or at your "
    "option any later version": "gpl2-later",
    "this program is distributed in the hope that it will be useful but without any warranty without even the "
    "implied warranty of merchantability or fitness for a particular purpose": "gpl-warranty",
    "see the gnu general public license for more details": "gpl-see",
    "you should have received a copy of the gnu general public license along with this program": "gpl-copy",
    "licensed under the gnu lesser general public license version 3": "lgpl3-name",
    "licensed under the gnu affero general public license version 3": "agpl3-name",
    "this source code form is subject to the terms of the mozilla public license v. 2.0": "mpl2-name",
    "redistribution and use in source and binary forms with or without modification are permitted provided that "
    "the following conditions are met": "bsd-grant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the "
    "following disclaimer": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the "
    "following disclaimer in the documentation and or other materials provided with the distribution": "bsd-binary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
    "products derived from this software without specific prior written permission": "bsd-endorse",
    _BSD_WARRANTY: "bsd-warranty",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
    "granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "licensed under cc by 4.0": "cc-by4-name",
    "licensed under cc by sa 4.0": "cc-by-sa4-name",
    "licensed under cc by nc 4.0": "cc-by-nc4-name",
    "licensed under cc by nd 4.0": "cc-by-nd4-name",
    "licensed under cc by nc sa 4.0": "cc-by-nc-sa4-name",
    "licensed under cc by nc nd 4.0": "cc-by-nc-nd4-name",
    "this is free and unencumbered software released into the public domain": "unlicense-name",
    "all rights reserved": "rights-reserved",
}
#: Licences by identifiers on end; the first rule that fits takes them.
RULES = [
    ("MIT", ["mit-title", "mit-grant", "mit-notice", "mit-warranty", "mit-liability"]),
    ("MIT", ["mit-grant", "mit-notice", "mit-warranty", "mit-liability"]),
    ("Apache-2.0", ["apache2-name", "apache2-condition", "apache2-copy", "apache2-warranty", "apache2-see"]),
    ("GPL-3.0-or-later", ["gpl3-later", "gpl-warranty", "gpl-see", "gpl-copy"]),
    ("GPL-2.0-or-later", ["gpl2-later", "gpl-warranty", "gpl-see", "gpl-copy"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-warranty"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-warranty"]),
    ("ISC", ["isc-grant"]),
    ("GPL-3.0-or-later", ["gpl3-later"]),
    ("GPL-2.0-or-later", ["gpl2-later"]),
    ("MIT", ["mit-name"]),
    ("MIT", ["mit-title"]),
    ("Apache-2.0", ["apache2-name"]),
    ("GPL-3.0-only", ["gpl3-name"]),
    ("GPL-2.0-only", ["gpl2-name"]),
    ("LGPL-3.0-only", ["lgpl3-name"]),
    ("AGPL-3.0-only", ["agpl3-name"]),
    ("MPL-2.0", ["mpl2-name"]),
    ("CC-BY-4.0", ["cc-by4-name"]),
    ("CC-BY-SA-4.0", ["cc-by-sa4-name"]),
    ("CC-BY-NC-4.0", ["cc-by-nc4-name"]),
    ("CC-BY-ND-4.0", ["cc-by-nd4-name"]),
    ("CC-BY-NC-SA-4.0", ["cc-by-nc-sa4-name"]),
    ("CC-BY-NC-ND-4.0", ["cc-by-nc-nd4-name"]),
    ("Unlicense", ["unlicense-name"]),
    ("LicenseRef-all-rights-reserved", ["rights-reserved"]),
]
#: Names of common licences as SPDX lines give them (a plus at the end is no word).
SPDX = [
    "0BSD", "AFL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-1.1", "Apache-2.0", "Artistic-2.0", "BSD-2-Clause",
    "BSD-3-Clause", "BSD-4-Clause", "BSL-1.0", "CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-NC-ND-4.0", "CC-BY-NC-SA-4.0",
    "CC-BY-ND-4.0", "CC-BY-SA-4.0", "CC0-1.0", "CDDL-1.0", "EPL-1.0", "EPL-2.0", "EUPL-1.2", "GPL-2.0",
    "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later", "ISC", "LGPL-2.1",
    "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0", "LGPL-3.0-only", "LGPL-3.0-or-later", "MIT", "MIT-0",
    "MPL-1.1", "MPL-2.0", "NCSA", "OFL-1.1", "PostgreSQL", "Python-2.0", "Unlicense", "WTFPL", "Zlib",
]
SENTENCES |= {f"spdx license identifier {' '.join(re.findall('[a-z0-9.]+', x.lower()))}": f"spdx-{x}" for x in SPDX}
RULES += [(x, [f"spdx-{x}"]) for x in SPDX]
#: Rows of a register at most.
MOST_KNOWN = 100_000
#: Marks of the plain form: a cut for sure, and one that may be.
_CUT, _MAYBE = "\f", "\r"
#: What becomes what, one after the other, before letters are made small: blank lines and sentence ends
#: before a capital are cuts; other ends may be, and those of web addresses, and line breaks but before a small letter.
CUTS = [
    (r"\n[^a-zA-Z0-9\n]*\n", _CUT),
    (r"(SPDX-License-Identifier:[^\n]*)\n", "$1" + _MAYBE),
    (r"[.!?][\"')\]]*[ \t\n]+(?:[*#/;%>|-]+[ \t]+)?[\"'(\[]*([A-Z])", _CUT + "$1"),
    (r"[.!?:;][\"')\]]*[ \t\n]+", _MAYBE),
    (r"[ \t\n]+(<?[hH][tT][tT][pP][sS]?://[^ \t\n\f\r]*)", _MAYBE + "$1" + _MAYBE),
    (r"\n[ \t]*([a-z])", " $1"),
    (r"\n", _MAYBE),
]
#: The same after it; blanks on end become one at the last. Marks are doubled until a cut for sure takes those beside it.
PLAIN = [
    (r"[^a-z0-9. \f\r]+", " "),
    (r"\.+([ \f\r]|$)", "$1"),
    (r"(^|[ \f\r])\.+", "$1"),
    (r" *\f[ \f\r]*", _CUT * 2),
    (r" *\r[ \r]*", _MAYBE * 2),
    (r"\r\r\f", _CUT),
    (r"  +", " "),
]


def plain(text: Column) -> Column:
    """A text's plain form between two cuts."""
    line = F.translate(text, _CUT + _MAYBE, "  ")
    for old, new in CUTS:
        line = F.regexp_replace(line, old, new)
    line = F.lower(line)
    for old, new in PLAIN:
        line = F.regexp_replace(line, old, new)
    return F.concat(F.lit(_CUT), F.trim(line), F.lit(_CUT))


def _forms(known: dict[str, str]) -> dict[str, str]:
    """Known sentences without the stops at the ends of words, as in the plain form, longest first."""
    words = {" ".join(w.strip(".") for w in form.split() if w.strip(".")): name for form, name in known.items()}
    return {form: words[form] for form in sorted(words, key=lambda f: (-len(f), f)) if re.search("[a-z0-9]", form)}


def pieces(text: Column) -> Column:
    """What stands between cuts, in order; a cut for sure is a piece of its own."""
    marked = F.regexp_replace(plain(text), "\f+", "\r\f\r")
    return F.filter(F.split(marked, "\r+"), lambda p: p != "")


def identifiers(text: Column, known: dict[str, str] | None = None) -> Column:
    """Identifiers of the known sentences of a text, in order; empty for NULL.

    Where a sentence may begin, its first two words are looked up among the known first
    words. Only there longer and longer runs of pieces are, by hash, so that the work
    does not grow with the number of known sentences.
    """
    forms = _forms(known or SENTENCES)
    table = F.create_map(*[F.lit(x) for pair in forms.items() for x in pair])
    starts = sorted({" ".join(f.split()[:2]) for f in forms})
    single = [f for f in forms if " " not in f]
    most = max((len(f.split()) for f in forms), default=1)
    none = F.array().cast("array<string>")

    def known_runs(parts: Column) -> Column:
        n = F.size(parts)

        def may_begin(i: Column) -> Column:
            here = F.get(parts, i)
            first = F.substring_index(F.concat_ws(" ", here, F.get(parts, i + 1)), " ", 2)
            return first.isin(starts) | here.isin(single) if single else first.isin(starts)

        def run(i: Column, size: Column) -> Column:
            return F.array_join(F.slice(parts, i + 1, size), " ")

        def longest(i: Column) -> Column:
            sizes = F.sequence(F.least(n - i, F.lit(most)), F.lit(1), F.lit(-1))
            return F.struct(
                i.alias("at"), F.get(F.filter(sizes, lambda size: run(i, size).isin(list(forms))), F.lit(0)).alias("size")
            )

        found = F.transform(F.filter(F.sequence(F.lit(0), n - 1), may_begin), longest)
        start = F.struct(F.lit(0).alias("free"), none.alias("ids"))
        return F.aggregate(
            F.filter(found, lambda f: f["size"].isNotNull()),
            start,
            lambda state, f: F.when(
                f["at"] >= state["free"],
                F.struct(
                    (f["at"] + f["size"]).alias("free"),
                    F.array_append(state["ids"], F.element_at(table, run(f["at"], f["size"]))).alias("ids"),
                ),
            ).otherwise(state),
        )["ids"]

    # A part of one element makes the pieces once for all that use them.
    once = F.transform(F.array(pieces(text)), known_runs)
    return F.coalesce(F.get(once, F.lit(0)), none)


def register(sentences: DataFrame, rules: DataFrame) -> tuple[dict[str, str], list[tuple[str, list[str]]]]:
    """Known sentences and rules from tables: (sentence, identifier) and (place, license, parts).

    A register is reference data of a bounded size that every task holds; beyond
    ``MOST_KNOWN`` rows it is an error.
    """
    found = [df.limit(MOST_KNOWN + 1).collect() for df in (sentences, rules.orderBy("place"))]
    if max(map(len, found)) > MOST_KNOWN:
        raise ValueError(f"a register has at most {MOST_KNOWN} rows")
    return {r["sentence"]: r["identifier"] for r in found[0]}, [(r["license"], list(r["parts"])) for r in found[1]]


def _by_rules(ids: Column, rules: list[tuple[str, list[str]]]) -> Column:
    """The names and left-over identifiers of a sequence: a walk that takes the longest rule at each place."""
    names: dict[str, str] = {}
    for name, parts in rules:
        names.setdefault(">".join(parts), name)
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    longest = max((len(parts) for _, parts in rules), default=1)
    none = F.array().cast("array<string>")

    def run(i: Column, size: Column) -> Column:
        return F.array_join(F.slice(ids, i + 1, size), ">")

    def step(state: Column, i: Column) -> Column:
        sizes = F.sequence(F.least(F.size(ids) - i, F.lit(longest)), F.lit(1), F.lit(-1))
        size = F.get(F.filter(sizes, lambda size: run(i, size).isin(list(names))), F.lit(0))
        here = F.get(F.transform(F.array(size), lambda size: F.struct(
            (i + F.coalesce(size, F.lit(1))).alias("free"),
            F.when(size.isNull(), state["names"]).otherwise(
                F.array_append(state["names"], F.element_at(table, run(i, size)))
            ).alias("names"),
            F.when(size.isNull(), F.array_append(state["left"], F.get(ids, i))).otherwise(state["left"]).alias("left"),
        )), F.lit(0))
        return F.when(i < state["free"], state).otherwise(here)

    start = F.struct(F.lit(0).alias("free"), none.alias("names"), none.alias("left"))
    return F.aggregate(F.sequence(F.lit(0), F.size(ids) - 1), start, step)


def scan(
    docs: DataFrame,
    text: str = "text",
    known: dict[str, str] | None = None,
    rules: list[tuple[str, list[str]]] | None = None,
    keep: list[str] | None = None,
) -> DataFrame:
    """``keep`` (all columns by default) with the licences of each text.

    Adds ``n_known`` sentences, their ``sequence``, ``licenses`` and ``left_over``
    (each joined by commas), and ``status``: none, matched, partial or unknown.
    """
    keep = docs.columns if keep is None else keep
    rules = rules or RULES
    own = docs.select(*[F.col(f"`{c}`") for c in keep])
    names = {n: fresh(own, n) for n in ("n_known", "sequence", "licenses", "left_over", "status")}
    ids = identifiers(F.col(text).cast("string"), known)
    inner = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep], F.lit(1)).alias("row"), ids.alias("ids"))
    none = F.array().cast("array<string>")
    nothing = F.struct(F.lit(0).alias("free"), none.alias("names"), none.alias("left"))
    matched = F.when(F.size("ids") > 0, _by_rules(F.col("ids"), rules)).otherwise(nothing)
    order = F.array(*[F.lit(n) for n in dict.fromkeys(name for name, _ in rules)])
    found = F.filter(order, lambda n: F.array_contains("matched.names", n))
    status = (
        F.when(F.size("ids") == 0, "none")
        .when(F.size("matched.names") == 0, "unknown")
        .when(F.size("matched.left") == 0, "matched")
        .otherwise("partial")
    )
    results = {
        "n_known": F.size("ids").cast("long"),
        "sequence": F.concat_ws(",", "ids"),
        "licenses": F.when(F.size("matched.names") > 0, F.concat_ws(",", found)).otherwise(""),
        "left_over": F.concat_ws(",", "matched.left"),
        "status": status,
    }
    return inner.withColumn("matched", matched).select(
        *[F.col("row")[c].alias(c) for c in keep], *[v.alias(names[n]) for n, v in results.items()]
    )


def scan_sql(table: str = "documents") -> str:
    """The scan of (doc_id, text) in DuckDB's SQL, with the same cuts and runs; rules one after the other."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    chars = {"\f": "chr(12)", "\r": "chr(13)"}

    def written_out(s: str) -> str:
        return " || ".join(chars.get(c, quote(c)) for c in re.findall(r"[\f\r]|[^\f\r]+", s)) or "''"

    forms = _forms(SENTENCES)
    known = ", ".join(f"{quote(k)}: {quote(v)}" for k, v in forms.items())
    listed = ", ".join(map(quote, forms))
    starts = ", ".join(quote(s) for s in sorted({" ".join(f.split()[:2]) for f in forms}))
    most = max(len(f.split()) for f in forms)
    line = f"translate(text, {written_out(_CUT + _MAYBE)}, '  ')"
    for at, steps in enumerate((CUTS, PLAIN)):
        line = f"lower({line})" if at else line
        for old, new in steps:
            line = f"regexp_replace({line}, {written_out(old)}, {written_out(new.replace('$1', chr(92) + '1'))}, 'g')"
    pieces_sql = f"""list_filter(string_split_regex(regexp_replace(chr(12) || trim({line}) || chr(12), chr(12) || '+',
  chr(13) || chr(12) || chr(13), 'g'), chr(13) || '+'), lambda x: x <> '')"""
    run = "array_to_string(list_slice(p, i, i + {} - 1), ' ')"
    steps = [
        f"t AS (SELECT doc_id, coalesce({pieces_sql}, []) AS p FROM {table})",
        f"""b AS (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i FROM t),
c AS (SELECT *, list_filter(range(least(len(p) - i + 1, {most}), 0, -1), lambda n: {run.format("n")} IN ({listed}))[1] AS n FROM b
  WHERE array_to_string(list_slice(string_split(array_to_string(list_slice(p, i, i + 1), ' '), ' '), 1, 2), ' ') IN ({starts})),
d AS (SELECT doc_id, list({{'at': i, 'free': i + n, 'ids': MAP {{{known}}}[{run.format("n")}]}} ORDER BY i) AS found FROM c WHERE n IS NOT NULL GROUP BY doc_id),
s AS (SELECT doc_id, string_split(list_reduce(found, lambda a, x: CASE WHEN x.at >= a.free
  THEN {{'at': x.at, 'free': x.free, 'ids': a.ids || ',' || x.ids}} ELSE a END).ids, ',') AS found FROM d)""",
        f"""r0 AS (SELECT doc_id, coalesce(found, []) AS ids,
  array_to_string(list_transform(coalesce(found, []), lambda x: '<' || x || '>'), '') AS rest, [] :: VARCHAR[] AS names
  FROM {table} LEFT JOIN s USING (doc_id))""",
    ]
    for k, (name, parts) in enumerate(RULES):
        seen = quote("".join(f"<{x}>" for x in parts))
        steps.append(
            f"""r{k + 1} AS (SELECT doc_id, ids, replace(rest, {seen}, '#') AS rest,
  CASE WHEN contains(rest, {seen}) AND NOT list_contains(names, {quote(name)}) THEN list_append(names, {quote(name)})
  ELSE names END AS names FROM r{k})"""
        )
    last = f"r{len(RULES)}"
    steps.append(
        f"""f AS (SELECT doc_id, CAST(len(ids) AS BIGINT) AS n_known, array_to_string(ids, ',') AS sequence,
  array_to_string(names, ',') AS licenses,
  replace(replace(replace(replace(rest, '#', ''), '><', ','), '<', ''), '>', '') AS left_over FROM {last})"""
    )
    return (
        "WITH "
        + ",\n".join(steps)
        + """
SELECT *, CASE WHEN n_known = 0 THEN 'none' WHEN licenses = '' THEN 'unknown'
  WHEN left_over = '' THEN 'matched' ELSE 'partial' END AS status FROM f"""
    )
