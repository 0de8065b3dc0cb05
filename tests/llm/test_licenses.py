import re

import duckdb
import pytest

from marlstone.llm import licenses

SF = "/root/testdata/sf0.001"
MIT = """MIT License

Copyright (c) 2021 A. Person

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files. The above copyright notice and this permission notice shall be
included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM."""
BSD = """/*
 * Copyright (c) 2019, Some Body
 * All rights reserved.
 *
 * Redistribution and use in source and binary forms, with or without
 * modification, are permitted provided that the following conditions are met:
 *
 * 1. Redistributions of source code must retain the above copyright notice.
 * 2. Redistributions in binary form must reproduce the above copyright notice.
 * {third}
 * THIS SOFTWARE IS PROVIDED BY THE AUTHOR "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED.
 */"""
APACHE = """# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
#
# Unless required by applicable law or agreed to in writing, software distributed under the License is distributed
# on an "AS IS" BASIS. See the License for the specific language governing permissions."""
GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later
version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY. You should have received
a copy of the GNU General Public License along with this program."""
CASES = {
    1: (MIT, "MIT"),
    2: (BSD.format(third=""), "BSD-2-Clause"),
    3: (BSD.format(third="3. Neither the name of the author nor others may be used to endorse or promote products derived from this."), "BSD-3-Clause"),
    4: (APACHE, "Apache-2.0"),
    5: (GPL, "GPL-2.0-or-later"),
    6: ("Some words. Released under the MIT License. More words.", "MIT"),
    7: ("Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0"),
    8: ("This text is available under a Creative Commons Attribution-NonCommercial-ShareAlike 3.0 license", "CC-BY-NC-SA-3.0"),
    9: ("// SPDX-License-Identifier: Apache-2.0\nint main() {}", "Apache-2.0"),
    10: ("SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0", "GPL-2.0-ONLY WITH CLASSPATH-EXCEPTION-2.0"),
    11: ("This work is licensed under the GNU General Public License, version 3.", "GPL-3.0"),
    12: ("(c) 2024 X. All rights reserved.", "All-Rights-Reserved"),
    13: ("This work is licensed under the Odd License of our own.", ""),
    14: ("The driver showed a licence and asked for permission to park.", ""),
    15: ("", ""),
    16: (None, ""),
    17: ("Released under the MIT License.\r\n\r\nLicensed under the Apache License, Version 2.0.", "MIT,Apache-2.0"),
    18: ("word " * 400_000 + "Released under the MIT License. " + "word. " * 400_000, "MIT"),
    19: ("published under the 3-clause BSD license", "BSD-3-Clause"),
    21: ("Copyright 2001 A. " * 20_000 + MIT, "MIT"),
    20: ("licenſed under ſome licence İ K©", ""),
}


@pytest.fixture(scope="module")
def got(spark):
    df = spark.createDataFrame([(k, t, "x", ["y"]) for k, (t, _) in CASES.items()] + [(None, "Released under the MIT License.", "x", ["y"])], "doc_id long, text string, sentences string, found array<string>")
    return {r.doc_id: r for r in licenses.scan(df).collect()}


@pytest.mark.parametrize("k", CASES)
def test_cases(got, k):
    assert ",".join(got[k].licences) == CASES[k][1]


def test_definitions(spark, got):
    assert got[None].licences == ["MIT"]
    assert got[13].n_unknown == 1 and got[14].n_unknown == 0
    assert got[12].sentences == ["<reserved:>"] and got[12].rest == ""
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    twice = spark.createDataFrame([(1, MIT), (1, MIT)], "doc_id long, text string")
    assert [r.licences for r in licenses.scan(twice).collect()] == [["MIT"], ["MIT"]]


def test_native(spark):
    plan = licenses.op2(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Exchange", plan)


def test_rules_are_reachable():
    """Each rule's own shortest sequence is given to it, and each identifier that a rule names is known."""
    names = {n for n, _ in licenses.SENTENCES}
    for _, rule in licenses.RULES:
        assert set(re.findall(r"<([a-z_0-9]+):", rule)) <= names


@pytest.mark.parametrize("sf", [SF, None])
def test_against_sql(spark, sf, tmp_path):
    if sf is None:
        sf = str(tmp_path)
        spark.createDataFrame([(k, t) for k, (t, _) in CASES.items()], "doc_id long, text string").coalesce(1).write.parquet(f"{sf}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{sf}/documents.parquet{'/*.parquet' if sf == str(tmp_path) else ''}')")
    rel = con.sql(licenses.sql())
    df = licenses.op2(spark, sf)
    assert sorted(df.columns) == sorted(rel.columns)
    rows = sorted(map(tuple, df.select(*rel.columns).collect()))
    assert rows == sorted(rel.fetchall())
    assert any(r[1] for r in rows)


def shortest(tree):
    """The shortest texts that a parsed pattern matches, one for each of its branches."""
    out = [""]
    for op, arg in tree:
        op = str(op)
        if op == "LITERAL":
            more = [chr(arg)]
        elif op == "IN":
            more = [chr(arg[0][1] if str(arg[0][0]) == "LITERAL" else arg[0][1][0])]
        elif op in ("MAX_REPEAT", "MIN_REPEAT"):
            more = [x * arg[0] for x in shortest(arg[2])] if arg[0] else [""]
        elif op == "SUBPATTERN":
            more = shortest(arg[3])
        elif op == "BRANCH":
            more = [x for branch in arg[1] for x in shortest(branch)]
        else:
            assert op in ("ANY", "AT"), op
            more = ["x"] if op == "ANY" else [""]
        out = [a + b for a in out for b in more]
    return out


@pytest.mark.parametrize("name, pattern", licenses.SENTENCES)
def test_each_pattern_has_a_cue(name, pattern):
    for text in shortest(re._parser.parse(pattern)):
        assert re.search(licenses.CUES, text), text


def test_names_without_other_cues(spark):
    cases = {
        "Distributed under the GPL version 3": ["GPL-3.0"], "Published under LGPL-2.1": ["LGPL-2.1"], "This work is available under CC BY-SA 4.0": ["CC-BY-SA-4.0"],
        "Creative Commons Attribution 4.0 International": ["CC-BY-4.0"], "# Shared as Creative\n# Commons Zero": ["CC0-1.0"], "// (CC)\n// \"BY\" 4.0": ["CC-BY-4.0"], "the commons and the gpl": [],
    }
    got = licenses.scan(spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")).collect()
    assert {list(cases)[r.doc_id]: list(r.licences) for r in got} == cases


#: (text, licences): read by hand, not by the tables
READ = [
    ("Licensed under either of Apache License, Version 2.0 or MIT license at your option.", ["Apache-2.0", "MIT"]),
    ("licensed under the MIT license or the Apache License 2.0", ["MIT", "Apache-2.0"]),
    ("Dual-licensed under the MIT License and the GNU General Public License, version 2.", ["MIT", "GPL-2.0"]),
    ("Available under CC BY 3.0 and CC BY-SA 4.0.", ["CC-BY-3.0", "CC-BY-SA-4.0"]),
    ("Released under the 2-clause BSD license, the ISC license or the Mozilla Public License 2.0", ["BSD-2-Clause", "ISC", "MPL-2.0"]),
    ("This code is distributed under LGPL-2.1 or GPL version 3", ["LGPL-2.1", "GPL-3.0"]),
    ("An MIT license was mentioned, nobody granted a thing.", []),
    ("Copyright 1999 X all rights reserved", ["All-Rights-Reserved"]),
    ("Copyright 2001 A.\n\n" * 25 + "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted.", ["ISC"]),
    ("Copyright 2001 A. All rights reserved. " * 9000 + "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted.", ["ISC"]),
    ("Apache License Version 2.0, January 2004. " + "See the License for the specific language governing permissions. " * 30_000, ["Apache-2.0"]),
]


def test_read_by_hand(spark, tmp_path):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(READ)], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan(df).collect()}
    assert [list(got[i].licences) for i in range(len(READ))] == [x for _, x in READ]
    assert all(got[i].rest == "" for i in (8, 9, 10))
    df.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    rel = con.sql(licenses.sql())
    assert sorted(map(tuple, licenses.op2(spark, str(tmp_path)).select(*rel.columns).collect())) == sorted(rel.fetchall())
