from lectern.llm import licenses


def test_own_and_inherited(spark):
    mit, gpl = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3."
    rows = [
        (1, "a/LICENSE", f"{mit}\n"), (2, "a/b/c/code.py", "nothing here"), (3, "a/b/LICENSE.txt", gpl), (4, "a/x/code.py", "some words"), (5, "a/x/own.py", f"words\n  Licensed under CC BY-NC 4.0.\nmore"),
        (6, "z/code.py", "a license of no known kind whatsoever"), (7, None, mit), (8, "a/n.py", None), (9, "a/n2.py", ""), (None, "ab/code.py", "x"), (2, "a/b/c/code.py", "nothing here"), (10, "COPYING", gpl), (11, "top.py", "x"), (12, "a/B.py", f"{mit}\n{gpl}"),
    ]
    files = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, path string, text string, license int")
    got = sorted(((r["doc_id"], r["own_license"], r["license"], r["license_dir"]) for r in licenses.scan(files).collect()), key=str)
    assert got == sorted(
        [
            (1, "MIT", "MIT", None), (2, None, "GPL-3.0", "a/b"), (2, None, "GPL-3.0", "a/b"), (3, "GPL-3.0", "GPL-3.0", None), (4, None, "MIT", "a"), (5, "CC-BY-NC-4.0", "CC-BY-NC-4.0", None),
            (6, None, "GPL-3.0", "."), (7, "MIT", "MIT", None), (8, None, "MIT", "a"), (9, None, "MIT", "a"), (None, None, "GPL-3.0", "."), (10, "GPL-3.0", "GPL-3.0", None), (11, None, "GPL-3.0", "."), (12, "GPL-3.0", "GPL-3.0", None),
        ],
        key=str,
    )
    assert licenses.scan(files.limit(0)).count() == 0


def test_every_template_finds_itself(spark):
    lines = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(licenses.TEMPLATES)], "template int, line string")
    got = {r["template"]: r["score"] for r in licenses.score_lines(lines).collect()}
    assert got == {i: 1.0 for i in range(len(licenses.TEMPLATES))}
    files = lines.selectExpr("template AS doc_id", "template || '/x' AS path", "line AS text")
    assert {r["doc_id"]: r["own_license"] for r in licenses.scan(files).collect()} == {i: name for i, (name, _) in enumerate(licenses.TEMPLATES)}


def test_notices_over_lines_and_within_lines(spark):
    gpl = "# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation, either version 3 of the License, or\n# (at your option) any later version.\n"
    mit = "MIT License\n\nCopyright (c) 2024 Foo\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\n"
    apache = "some long line of other words that goes on and on before it says that all of this is Licensed under the Apache License, Version 2.0. and then goes on with quite different matters again"
    bsd = "Copyright 2024 Foo\n\nRedistribution and use in source and binary\nforms, with or without modification, are\npermitted provided that the following\nconditions are met:\n1. Redistributions of source code must retain\n"
    want = {1: "GPL-3.0", 2: "MIT", 3: "Apache-2.0", 4: "BSD-3-Clause", 5: "GPL-2.0", 6: None, 7: "GPL-3.0"}
    gpl2 = gpl.replace("version 3", "version 2").replace("software:", "software;")
    rows = [(1, gpl), (2, mit), (3, apache), (4, bsd), (5, gpl2), (6, "these words ask for permission to\nredistribute the license fee of 3 people"), (7, "words " * 500 + gpl + "words " * 500)]
    files = spark.createDataFrame([(i, f"{i}/x", t) for i, t in rows], "doc_id long, path string, text string")
    assert {r["doc_id"]: r["own_license"] for r in licenses.scan(files).collect()} == want


def wrapped(text, sign, width):
    """Comment lines of at most this width."""
    lines, line = [], ""
    for w in text.split():
        if line and len(line) + len(w) >= width:
            lines.append(line)
            line = ""
        line = f"{line} {w}".strip()
    return "\n".join(f"{sign} {x}" for x in [*lines, line])


GNU_TAIL = "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name}General Public License for more details. You should have received a copy of the GNU {name}General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."
GNU_HEAD = "Foo - a tool. Copyright (C) 2024 Jane Doe <jane@example.org>\n\nThis {what} is free software{sign} you can redistribute it and/or modify it under the terms of the GNU {name}General Public License as published by the Free Software Foundation{cut} either version {v} of the License, or (at your option) any later version.\n\n"
APACHE_TAIL = "You may obtain a copy of the License at\n\n http://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."


def headers():
    gnu = lambda what, sign, name, cut, v: (GNU_HEAD + GNU_TAIL).format(what=what, sign=sign, name=name, cut=cut, v=v)
    return [
        ("GPL-3.0", gnu("program", ":", "", ",", "3")), ("GPL-2.0", gnu("program", ";", "", ";", "2")), ("LGPL-2.1", gnu("library", ";", "Lesser ", ";", "2.1")), ("LGPL-3.0", gnu("program", ":", "Lesser ", ",", "3")),
        ("LGPL-3.0", gnu("library", ":", "Lesser ", ",", "3")), ("LGPL-2.0", gnu("library", ";", "Library ", ";", "2")), ("AGPL-3.0", gnu("program", ":", "Affero ", ",", "3")),
        ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
        ("Apache-2.0", "Copyright 2024 Jane Doe\n\nLicensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. " + APACHE_TAIL),
        ("Apache-2.0", "Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements. See the NOTICE file distributed with this work for additional information regarding copyright ownership. The ASF licenses this file to You under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. " + APACHE_TAIL),
        ("MIT", "MIT License\n\nCopyright (c) 2024 Jane Doe\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
        ("BSD-3-Clause", "Copyright (c) 2024, Jane Doe. All rights reserved.\n\nRedistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
        ("Proprietary", "Copyright (c) 2024 Foo Inc. All rights reserved."), ("Proprietary", "All rights reserved."), ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
        ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE\n Version 3, 29 June 2007\n\n Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>\n Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."),
        ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE\n Version 3, 19 November 2007\n\n Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>"),
        (None, "Licensed under CC BY-ND 4.0."), (None, "He asked the public for a copy of the general terms, which may be modified at any later date or distributed with this file."), (None, "The work of the free society is licensed by nobody, and no version of it is reserved."),
    ]


def test_headers_as_they_are_written(spark):
    """Wrapped and prefixed by comment signs, between code, and as plain text."""
    signs = [("#", 60), (" *", 72), ("//", 40), ("", 10_000), ("--", 78)]
    cases = [(h, wrapped(text, *s)) for h, text in headers() for s in signs]
    code = "import os\nfor i in range(10):\n    print(i, os.name)\n"
    cases += [(h, code * 300 + wrapped(text, "#", 70) + "\n" + code * 300) for h, text in headers()]
    files = spark.createDataFrame([(i, f"{i}/x", t, {"a": 1}, 2.0) for i, (_, t) in enumerate(cases)], "doc_id long, path string, text string, `a.b` map<string,int>, windows double")
    got = {r["doc_id"]: r["own_license"] for r in licenses.scan(files).collect()}
    assert {i: got[i] for i in got} == {i: h for i, (h, _) in enumerate(cases)}


def test_bounds_lose_nothing():
    """Any bag that lacks a template's keys stays under the threshold, whatever else it holds."""
    rows = licenses.vectors()[0]
    for i in range(len(licenses.TEMPLATES)):
        named = {t for j, t, _, _ in licenses.keys() if j == i}
        rest = sum(w * w for j, t, _, w in rows if j == i and t not in named)
        assert rest**0.5 < licenses.MIN_COSINE


def test_like_its_sql(spark):
    """Here the SQL lays every window over the whole text, without pieces and without any bound."""
    import duckdb

    prose = " ".join(f"w{i % 97} of the license" for i in range(900))
    texts = [t for _, t in headers()] + [None, "", "x", prose + " Licensed under the MIT license. " + prose, "MIT License. " * 500]
    rows = [(i, t, f"s{i % 2}" if i % 7 else None, "en") for i, t in enumerate(texts)] + [(3, "Released under the MIT License.", "s1", "en")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    assert licenses._ABLE in licenses.ORACLE
    want = con.sql(licenses.ORACLE.replace(licenses._ABLE, ""))
    got = licenses.scan(licenses.with_paths(docs)).select(*want.columns)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want.fetchall()))
