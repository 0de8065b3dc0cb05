"""Licences in texts by sentence rules.

A text is split into sentences (an end mark and white space, or an empty line; line breaks and comment leaders inside a
sentence are white space). A sentence that holds a cue word is normalised: A-Z in lower case, quotes, commas and brackets
to spaces. A sentence of a licence's own text has that one identifier; any other has all notices and mentions in it, by their
place, some with an argument such as a version. Licences known by a short name (MIT, Apache, ISC, BSD) count where a word of
granting comes before them in the sentence. The identifiers of a text, in order, with runs of copyright and
reservation lines taken as one, are matched against ordered rules: leftmost first, at one place the earlier rule, so that a
whole licence text goes before a notice and a notice before a mention. What no rule takes is reported, too.

Everything is a column expression over one row: no shuffle, no Python. Time is linear in the text, whatever it repeats and
however long it is. Nulls are empty texts and hold nothing; rows without a doc_id are kept; repeated rows are judged alike; an
empty table gives an empty result. Extra columns are ignored, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from marlstone.llm.session import table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEADERS = r"\n[ \t]*(?:/\*+|\*+/?|//+|#+|--+|%+|>+|;+)?[ \t]*"
ENDS = r"""[.!?]+["')\]]*[ \t\n]+|\n\n+"""
#: a sentence without one of these has no identifier: each match of a pattern below holds one, before it is normalised, too
CUES = r"licen[sc]|copyright|©|spdx|warrant|permission|redistribut|reserved|domain|cc0|liable|mpl|advertising|endorse|gpl|commons|\bcc[^a-z0-9]+by"
DROPPED = r"""[\x20\t\n"'`*,()<>\[\]{}=“”„«»‘’]+"""
#: read like sentences with another spelling
SPELLED = ((r"creative commons attribution", "cc by"), (r"creative commons zero", "cc0"), (r"[ -]non-?commercial", "-nc"), (r"[ -]share-?alike", "-sa"), (r"[ -]no-?deriv(?:ative)?s(?: works)?", "-nd"))
GRANTED = r"(?:licen[sc]ed|released|distributed|available|published|provided|shared|dual-licensed|governed)"
#: (identifier, pattern in the normalised sentence); a group is the identifier's argument. Earlier ones go first.
#: Whole texts, sentence by sentence: one identifier a sentence.
WHOLE = (
    ("spdx", r"spdx-license-identifier: ?([a-z0-9.+-]+(?: (?:or|and|with) [a-z0-9.+-]+)*)"),
    ("mit_grant", r"permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit_notice", r"the above copyright notice and this permission notice shall be included in all copies"),
    ("mit_asis", r"the software is provided as is without warranty of any kind"),
    ("mit_liable", r"in no event shall the authors or copyright holders be liable"),
    ("isc_grant", r"permission to use copy modify (?:and|and/or|or) distribute this software for any purpose with or without fee is hereby granted"),
    ("isc_asis", r"the software is provided as is and the author disclaims all warranties"),
    ("isc_liable", r"in no event shall the author be liable for any special direct"),
    ("bsd_redistribute", r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd_source", r"redistributions of source code must retain the above copyright notice"),
    ("bsd_binary", r"redistributions in binary form must reproduce the above copyright notice"),
    ("bsd_advertising", r"all advertising materials mentioning features or use of this software must display"),
    ("bsd_endorse", r"(?s)neither the name of .{1,200} be used to endorse or promote products"),
    ("bsd_asis", r"(?s)this software is provided by .{1,120} as is and any express or implied warranties"),
    ("bsd_liable", r"(?s)in no event shall .{1,120} be liable for any direct indirect incidental"),
    ("apache_title", r"apache licen[sc]e version 2\.0 january 2004"),
    ("apache_comply", r"you may not use this file except in compliance with the licen[sc]e"),
    ("apache_copy", r"you may obtain a copy of the licen[sc]e at https?://www\.apache\.org/licenses/license-2\.0"),
    ("apache_asis", r"unless required by applicable law or agreed to in writing software distributed under the licen[sc]e"),
    ("apache_see", r"see the licen[sc]e for the specific language governing permissions"),
    ("gpl_hope", r"is distributed in the hope that it will be useful but without any warranty"),
    ("gpl_details", r"see the gnu (?:lesser |library |affero )?general public licen[sc]e for more details"),
    ("gpl_received", r"you should have received a copy of the gnu (?:lesser |library |affero )?general public licen[sc]e"),
    ("mpl_form", r"this source code form is subject to the terms of the mozilla public licen[sc]e"),
    ("mpl_copy", r"if a copy of the mpl was not distributed with this file"),
    ("zlib_asis", r"this software is provided as-is without any express or implied warranty"),
    ("zlib_grant", r"permission is granted to anyone to use this software for any purpose including commercial applications"),
    ("unlicense", r"free and unencumbered software released into the public domain"),
    ("boost_grant", r"permission is hereby granted free of charge to any person or organization obtaining a copy"),
)
#: notices and mentions: all in a sentence count
FREE = (
    ("agpl_later", r"(?s)gnu affero general public licen[sc]e.{0,80}?version ([0-9](?:\.[0-9])?).{0,60}?any later version"),
    ("agpl", r"(?s)(?:gnu affero general public licen[sc]e|\bagpl).{0,60}?(?:version |v|[ -])([0-9](?:\.[0-9])?)"),
    ("lgpl_later", r"(?s)gnu (?:lesser|library) general public licen[sc]e.{0,80}?version ([0-9](?:\.[0-9])?).{0,60}?any later version"),
    ("lgpl", r"(?s)(?:gnu (?:lesser|library) general public licen[sc]e|\blgpl).{0,60}?(?:version |v|[ -])([0-9](?:\.[0-9])?)"),
    ("gpl_later", r"(?s)gnu general public licen[sc]e.{0,80}?version ([0-9](?:\.[0-9])?).{0,60}?any later version"),
    ("gpl", r"(?s)(?:gnu general public licen[sc]e|\bgpl).{0,60}?(?:version |v|[ -])([0-9](?:\.[0-9])?)"),
    ("cc0", r"\bcc0\b"),
    ("cc", r"\bcc[ -](by(?:-nc)?(?:-sa|-nd)?[ -]?(?:version |v)?(?:[0-9]\.[0-9])?)"),
    ("mit_name", r"^(?:the )?mit licen[sc]e(?: mit)?\.?$"),
    ("mpl", r"(?s)mozilla public licen[sc]e.{0,20}?([12]\.[0-9])"),
    ("epl", r"(?s)eclipse public licen[sc]e.{0,20}?([12]\.0)"),
    ("boost", r"(?s)boost software licen[sc]e.{0,20}?1\.0"),
    ("wtfpl", r"do what the fuck you want to public licen[sc]e"),
    ("public_domain", r"(?:dedicated to|released into|placed in|placed into|is in) the public domain"),
    ("copyright", r"copyright (?:c |© )?[0-9]{4}|©|^copyright "),
    ("reserved", r"all rights reserved"),
)
#: names that count after a word of granting in the same sentence
NAMES = (
    ("apache", r"\bapache(?: software)? licen[sc]e(?: version)? v?2"),
    ("mit", r"\bmit(?:/x11|/expat)? licen[sc]e"),
    ("isc", r"\bisc licen[sc]e"),
    ("bsd_clauses", r"\b([0-4])-clause bsd licen[sc]e"),
    ("bsd", r"\bbsd(?:[ -]([0-4])-clause)?(?:-style)? licen[sc]e"),
)
SENTENCES = (*WHOLE, *FREE, *NAMES)
#: runs of these two as one of each, in three steps
RUNS = (
    (r"(?:<copyright:>)+", "<copyright:>"),
    (r"(?:<reserved:>)+", "<reserved:>"),
    (r"(?:<copyright:><reserved:>)+(?:<copyright:>)?|<reserved:><copyright:>(?:<reserved:><copyright:>)*(?:<reserved:>)?", "<copyright:><reserved:>"),
)
_C = r"(?:<copyright:>)?(?:<reserved:>)?"
#: (licence, rule over identifiers). A + in the licence stands for the argument of the rule's first identifier.
RULES = (
    ("MIT", r"(?:<mit_name:>)?" + _C + r"<mit_grant:><mit_notice:><mit_asis:>(?:<mit_liable:>)?"),
    ("BSL-1.0", r"<boost_grant:>(?:<mit_asis:>)?(?:<mit_liable:>)?"),
    ("ISC", _C + r"<isc_grant:>(?:<isc_asis:>)?(?:<isc_liable:>)?"),
    ("BSD-4-Clause", _C + r"<bsd_redistribute:><bsd_source:><bsd_binary:><bsd_advertising:>(?:<bsd_endorse:>)?(?:<bsd_asis:>)?(?:<bsd_liable:>)?"),
    ("BSD-3-Clause", _C + r"<bsd_redistribute:><bsd_source:><bsd_binary:><bsd_endorse:>(?:<bsd_asis:>)?(?:<bsd_liable:>)?"),
    ("BSD-2-Clause", _C + r"<bsd_redistribute:><bsd_source:><bsd_binary:>(?:<bsd_asis:>)?(?:<bsd_liable:>)?"),
    ("Zlib", _C + r"<zlib_asis:>(?:<zlib_grant:>)?"),
    ("Apache-2.0", r"(?:<apache:>)?<apache_comply:>(?:<apache_copy:>)?<apache_asis:>(?:<apache_see:>)?"),
    ("Apache-2.0", r"<apache_title:>(?:<apache_comply:>|<apache_copy:>|<apache_asis:>|<apache_see:>|<apache:>)*"),
    ("AGPL-+-or-later", r"<agpl_later:[^>]*>(?:<gpl_hope:>)?(?:<gpl_details:>)?(?:<gpl_received:>)?"),
    ("LGPL-+-or-later", r"<lgpl_later:[^>]*>(?:<gpl_hope:>)?(?:<gpl_details:>)?(?:<gpl_received:>)?"),
    ("GPL-+-or-later", r"<gpl_later:[^>]*>(?:<gpl_hope:>)?(?:<gpl_details:>)?(?:<gpl_received:>)?"),
    ("AGPL-+", r"<agpl:[^>]*>(?:<gpl_hope:>)?(?:<gpl_details:>)?(?:<gpl_received:>)?"),
    ("LGPL-+", r"<lgpl:[^>]*>(?:<gpl_hope:>)?(?:<gpl_details:>)?(?:<gpl_received:>)?"),
    ("GPL-+", r"<gpl:[^>]*>(?:<gpl_hope:>)?(?:<gpl_details:>)?(?:<gpl_received:>)?"),
    ("MPL-2.0", r"<mpl_form:>(?:<mpl_copy:>)?"),
    ("Unlicense", r"<unlicense:>"),
    ("+", r"<spdx:[^>]*>"),
    ("CC0-1.0", r"<cc0:>"),
    ("CC-+", r"<cc:[^>]*>"),
    ("Apache-2.0", r"<apache:>"),
    ("MIT", r"<mit:>|<mit_name:>"),
    ("ISC", r"<isc:>"),
    ("BSD-+-Clause", r"<bsd_clauses:[^>]*>|<bsd:[0-4]>"),
    ("BSD", r"<bsd:>"),
    ("MPL-+", r"<mpl:[^>]*>"),
    ("EPL-+", r"<epl:[^>]*>"),
    ("BSL-1.0", r"<boost:>"),
    ("WTFPL", r"<wtfpl:>"),
    ("Public-Domain", r"<public_domain:>"),
    ("All-Rights-Reserved", r"(?:<copyright:>)?<reserved:>"),
)
#: a sentence that speaks of a licence and has no identifier counts as unknown
UNKNOWN = r"(?s)licen[sc]ed under|under the .{0,80}licen[sc]e"
_ANY = "|".join(f"(?:{r})" for _, r in RULES)


def _java(pattern: str) -> str:
    """Repeated groups take what they can and give nothing back: no stack however long the run is."""
    return pattern.replace(")*", ")*+").replace(")+", ")++")


_VERSION = ("agpl", "agpl_later", "lgpl", "lgpl_later", "gpl", "gpl_later")
#: names as they are written, for identifiers that come in lower case
_NAMED = tuple(dict.fromkeys(x for x, _ in RULES if "+" not in x and x.isascii()))


def _grouped(pattern: str) -> bool:
    return "(" in pattern.replace("(?", "").replace(r"\(", "")


def _normal(s: Column) -> Column:
    s = F.btrim(F.regexp_replace(s, DROPPED, " "), F.lit(" "))
    for a, b in SPELLED:
        s = F.regexp_replace(s, a, b)
    return s


def _argument(name: str, x: Column) -> Column:
    """Arguments are written like the licence's own name: a version has two numbers, other parts are joined by dashes."""
    if name in _VERSION:
        return F.when(F.contains(x, F.lit(".")), x).otherwise(F.concat(x, F.lit(".0")))
    if name == "cc":
        return F.btrim(F.regexp_replace(x, "[ -]*(?:version |v|[ -])([0-9])", "-$1"), F.lit(" -"))
    return F.replace(F.rtrim(x, F.lit(".")), F.lit(" "), F.lit("_")) if name == "spdx" else x


def _identifier(s: Column, table) -> Column:
    """The first pattern of a table that is found, as an identifier; null if none is."""
    out = None
    for name, pattern in table:
        value = F.lit(f"<{name}:>")
        if _grouped(pattern):
            value = F.concat(F.lit(f"<{name}:"), _argument(name, F.regexp_extract(s, pattern, 1)), F.lit(">"))
        test = F.rlike(s, F.lit(pattern))
        out = F.when(test, value) if out is None else out.when(test, value)
    return out


def _every(table) -> str:
    """All patterns of a table as one."""
    return "|".join(f"(?:{p})" for _, p in table)


def _identifiers(s: Column) -> Column:
    """A sentence's identifiers; ? for one that speaks of a licence and has none."""
    tail = F.regexp_extract(s, f"(?s)^.*?{GRANTED}(.*)$", 1)
    at = F.length(s) - F.length(tail)
    place = lambda text, table, shift: F.transform(F.regexp_extract_all(text, F.lit(_every(table)), F.lit(0)), lambda m: F.struct((shift + F.instr(text, m)).alias("p"), _identifier(m, table).alias("v")))
    some = F.transform(F.array_sort(F.concat(place(s, FREE, F.lit(0)), place(tail, NAMES, at))), lambda x: x["v"])
    whole = _identifier(s, WHOLE)
    none = F.when(F.rlike(s, F.lit(UNKNOWN)), F.array(F.lit("?"))).otherwise(F.array().cast("array<string>"))
    return F.when(whole.isNotNull(), F.array(whole)).otherwise(F.when(F.size(some) > 0, some).otherwise(none))


def _licence(x: Column) -> Column:
    argument = F.regexp_extract(x, r"^<[a-z_0-9]+:([^>]*)>", 1)
    plain = F.replace(argument, F.lit("_"), F.lit(" "))
    named = None
    for n in _NAMED:
        named = F.when(plain == n.lower(), F.lit(n)) if named is None else named.when(plain == n.lower(), F.lit(n))
    out = None
    for licence, rule in RULES:
        if licence == "+":
            value = named.otherwise(F.translate(plain, LOWER, UPPER))
        elif "+" in licence:
            a, b = licence.split("+", 1)
            value = F.concat(F.lit(a), F.translate(argument, LOWER, UPPER), F.lit(b))
        else:
            value = F.lit(licence)
        test = F.rlike(x, F.lit(f"^(?:{_java(rule)})$"))
        out = F.when(test, value) if out is None else out.when(test, value)
    return out


def scan(docs: DataFrame) -> DataFrame:
    """For each row of ``docs``: doc_id, sentences (identifiers in order), licences (in order, one for each match of a rule), rest (identifiers that no rule took), n_unknown."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    flat = F.regexp_replace(F.regexp_replace(text, r"\r\n?", "\n"), LEADERS, "\n")
    low = F.transform(F.split(flat, ENDS, -1), lambda s: F.translate(s, UPPER, LOWER))
    cued = F.filter(low, lambda s: F.rlike(s, F.lit(CUES)))
    found = F.flatten(F.transform(F.transform(cued, _normal), _identifiers))
    found = F.when(F.rlike(text, F.lit(f"(?i){CUES}")), found).otherwise(F.array().cast("array<string>"))
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), found.alias("found"))
    known = F.filter("found", lambda x: x != "?")
    df = df.select("doc_id", known.alias("sentences"), (F.size("found") - F.size(known)).cast("long").alias("n_unknown"))
    line = F.array_join("sentences", "")
    for a, b in RUNS:
        line = F.regexp_replace(line, _java(a), b)
    df = df.withColumn("line", line)
    taken = F.regexp_extract_all("line", F.lit(f"({_java(_ANY)})"), 1)
    rest = F.regexp_replace("line", _java(_ANY), "")
    return df.select("doc_id", "sentences", F.transform(taken, _licence).alias("licences"), rest.alias("rest"), "n_unknown")


def _sql_text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _sql_identifier(s: str, table) -> str:
    q, cases = _sql_text, []
    for name, p in table:
        value = q(f"<{name}:>")
        if _grouped(p):
            x = f"regexp_extract({s}, {q(p)}, 1)"
            if name in _VERSION:
                x = f"CASE WHEN contains({x}, '.') THEN {x} ELSE {x} || '.0' END"
            elif name == "cc":
                x = f"trim(regexp_replace({x}, '[ -]*(?:version |v|[ -])([0-9])', '-\\1', 'g'), ' -')"
            elif name == "spdx":
                x = f"replace(rtrim({x}, '.'), ' ', '_')"
            value = f"'<{name}:' || {x} || '>'"
        cases.append(f"WHEN regexp_matches({s}, {q(p)}) THEN {value}")
    return f"CASE {' '.join(cases)} END"


def sql() -> str:
    """DuckDB SQL with the rows of ``op2``, written from the same tables."""
    q = _sql_text
    normal = f"trim(regexp_replace(s, {q(DROPPED)}, ' ', 'g'), ' ')"
    for a, b in SPELLED:
        normal = f"regexp_replace({normal}, {q(a)}, {q(b)}, 'g')"
    tail = f"regexp_extract(s, {q(f'(?s)^.*?{GRANTED}(.*)$')}, 1)"
    place = lambda text, table, shift: f"list_transform(regexp_extract_all({text}, {q(_every(table))}, 0), lambda m: {{'p': {shift} + strpos({text}, m), 'v': {_sql_identifier('m', table)}}})"
    some = f"list_transform(list_sort(list_concat({place('s', FREE, '0')}, {place(tail, NAMES, f'length(s) - length({tail})')})), lambda y: y.v)"
    unknown = f"CASE WHEN regexp_matches(s, {q(UNKNOWN)}) THEN ['?'] ELSE [] END"
    whole = _sql_identifier("s", WHOLE)
    every = f"CASE WHEN ({whole}) IS NOT NULL THEN [{whole}] WHEN len({some}) > 0 THEN {some} ELSE {unknown} END"
    run = "array_to_string(list_filter(found, lambda x: x <> '?'), '')"
    for a, b in RUNS:
        run = f"regexp_replace({run}, {q(a)}, {q(b)}, 'g')"
    argument = "regexp_extract(x, '^<[a-z_0-9]+:([^>]*)>', 1)"
    plain = f"replace({argument}, '_', ' ')"
    named = "CASE " + " ".join(f"WHEN {plain} = {q(n.lower())} THEN {q(n)}" for n in _NAMED) + f" ELSE translate({plain}, '{LOWER}', '{UPPER}') END"
    rules = []
    for licence, rule in RULES:
        if licence == "+":
            value = named
        elif "+" in licence:
            a, b = licence.split("+", 1)
            value = f"{q(a)} || translate({argument}, '{LOWER}', '{UPPER}') || {q(b)}"
        else:
            value = q(licence)
        rules.append(f"WHEN regexp_matches(x, {q(f'^(?:{rule})$')}) THEN {value}")
    nl = "chr(10)"
    flat = f"regexp_replace(regexp_replace(coalesce(text, ''), '\\r\\n?', {nl}, 'g'), {q(LEADERS)}, {nl}, 'g')"
    return f"""
WITH cued AS (
  SELECT doc_id, list_transform(list_filter(list_transform(string_split_regex({flat}, {q(ENDS)}), lambda s: translate(s, '{UPPER}', '{LOWER}')), lambda s: regexp_matches(s, {q(CUES)})), lambda s: {normal}) AS cued FROM documents
), found AS (
  SELECT doc_id, flatten(list_transform(cued, lambda s: {every})) AS found FROM cued
), line AS (
  SELECT doc_id, list_filter(found, lambda x: x <> '?') AS sentences, len(found) AS n_found, array_to_string(list_filter(found, lambda x: x <> '?'), '') AS line, {run} AS runs FROM found
)
SELECT CAST(doc_id AS BIGINT) AS doc_id, array_to_string(list_transform(regexp_extract_all(runs, {q(f'({_ANY})')}, 1), lambda x: CASE {' '.join(rules)} END), ',') AS licences,
  line AS sentences, regexp_replace(runs, {q(_ANY)}, '', 'g') AS rest, CAST(len(sentences) AS BIGINT) AS n_sentences, CAST(n_found - len(sentences) AS BIGINT) AS n_unknown
FROM line"""


def op2(spark, sf_dir: str) -> DataFrame:
    out = scan(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.array_join("licences", ",").alias("licences"), F.array_join("sentences", "").alias("sentences"), "rest", F.size("sentences").cast("long").alias("n_sentences"), "n_unknown")
