from __future__ import annotations

import time

import duckdb
import pytest
from conftest import rows

from tideline.llm import licenses
from tideline.llm.queries import ORACLE_SQL, op5_license_scan

MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and so on. The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
CASES = [
    (1, None, ""), (2, "", ""), (3, "no licence here", ""), (4, "Licensed under the Apache License, Version 2.0.", "Apache-2.0"), (5, MIT, "MIT"),
    (6, "This program is licensed under the GNU General Public License, version 3.\nEither version 3 of the License, or (at your option) any later version.", "GPL-3.0-or-later"),
    (7, "Released under the MIT License.\n\nLicensed under CC BY 4.0.", "CC-BY-4.0,MIT"), (8, "filler. " * 20_000 + "Released under the MIT license.", "MIT"), (9, "the mit licensed under", ""),
]


def test_cases_and_oracle(spark):
    docs = spark.createDataFrame([(d, t, "clash") for d, t, _ in CASES] + [(None, MIT, "c"), (5, MIT, "c")], "doc_id long, text string, licenses string")
    out = licenses.scan(docs)
    assert {r["doc_id"]: r["licenses"] for r in out.filter("doc_id IS NOT NULL").collect()} == {d: x for d, _, x in CASES}
    frame = docs.toPandas()
    con = duckdb.connect()
    con.register("documents", frame)
    assert rows(out) == rows(con.execute(licenses.oracle_sql()).df())
    assert licenses.scan(docs.limit(0)).count() == 0
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["op5_license_scan"])
def test_whole_table(spark, duck, sf_dir, name):
    assert rows(op5_license_scan(spark, sf_dir)) == rows(duck.execute(ORACLE_SQL[name]).df())


MIT_WRAPPED = """Copyright (c) 2024 Someone

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction.

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED."""
BSD_WRAPPED = """Copyright (c) 2024, Someone
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission."""
GPL_WRAPPED = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version."""
APACHE_WRAPPED = """Licensed under the Apache License, Version 2.0 (the "License"); you may not
use this file except in compliance with the License.  You may obtain a copy
of the License at

    http://www.apache.org/licenses/LICENSE-2.0"""


def test_wrapped_notices(spark):
    """Notices as they are distributed, wrapped and behind comment marks."""
    commented = lambda t, mark: "\n".join(f"{mark} {x}" for x in t.splitlines())
    gpl2 = GPL_WRAPPED.replace("software:", "software;").replace("Foundation, either version 3", "Foundation; either version 2")
    cases = {
        1: (MIT_WRAPPED, "MIT"), 2: (BSD_WRAPPED, "BSD-3-Clause"), 3: (GPL_WRAPPED, "GPL-3.0-or-later"), 4: (gpl2, "GPL-2.0-or-later"), 5: (APACHE_WRAPPED, "Apache-2.0"),
        6: (" ".join(GPL_WRAPPED.split()), "GPL-3.0-or-later"), 7: ("released to the public\ndomain", "CC0-1.0"), 8: ("a line without a stop\nReleased under the MIT\nlicense\nanother line", "MIT"),
        9: ("Released under the MIT\n\nlicense", ""), 10: ("Released under the MIT\r\nLicense.\r\n", "MIT"), 11: ("x;" + " " * 1_000_000 + "\n" * 1000 + "licensed under\nCC BY 4.0", "CC-BY-4.0"),
    }
    cases |= {100 * k + d: (commented(cases[d][0], mark), cases[d][1]) for k, mark in enumerate(("//", " *", "#"), 1) for d in range(1, 6)}
    out = licenses.scan(spark.createDataFrame([(d, t) for d, (t, _) in cases.items()], "doc_id long, text string"))
    assert {r["doc_id"]: r["licenses"] for r in out.collect()} == {d: x for d, (_, x) in cases.items()}


FULL_MIT = """MIT License

Copyright (c) 2020 Some Person

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
BSD2 = """Copyright (c) 2015, The Authors
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
BSD3 = BSD2 + """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED.
"""
ISC = """Copyright (c) 2019, Someone <a@example.com>

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS.
"""
GPL = """This program is free software; you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation; either version 2 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.
"""
GPL3 = GPL.replace("software; you","software: you").replace("Foundation; either version 2","Foundation, either version 3")
LGPL = GPL.replace("This program is free","This library is free").replace("GNU General","GNU Lesser General").replace("version 2 of","version 2.1 of")
AGPL = GPL3.replace("GNU General","GNU Affero General")
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at http://mozilla.org/MPL/2.0/.
"""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
"""
TEXTS = {
    "MIT": FULL_MIT, "BSD-2-Clause": BSD2, "BSD-3-Clause": BSD3, "ISC": ISC, "GPL-2.0-or-later": GPL, "GPL-3.0-or-later": GPL3, "LGPL-2.1-or-later": LGPL, "AGPL-3.0-or-later": AGPL, "MPL-2.0": MPL, "Apache-2.0": APACHE,
}


def test_standard_texts_in_every_layout(spark):
    """The standard texts wrapped, with blank lines, behind comment marks, in a block comment and on one line."""
    marked = lambda t, mark: "".join(f"{mark} {x}".rstrip() + "\n" for x in t.splitlines())
    layouts = (lambda t: t, lambda t: "int x;\n\n" + marked(t, "#") + "\nint y;", lambda t: "/*\n" + marked(t, " *") + " */\nint main;", lambda t: marked(t, "//"), lambda t: " ".join(t.split()), lambda t: t.replace("\n", "\r\n"))
    rows = [(len(layouts) * k + j, name, layout(text)) for k, (name, text) in enumerate(TEXTS.items()) for j, layout in enumerate(layouts)]
    rows += [(1000 + k, name, f"// SPDX-License-Identifier: {name}\n") for k, name in enumerate(licenses.NAMED)]
    rows += [(2000, "LGPL-3.0", LGPL.replace("2.1", "3").replace(", or\n(at your option) any later version", "")), (2001, "", "the licence of a driver, v. 2 of it, is free software")]
    out = licenses.scan(spark.createDataFrame([(d, t) for d, _, t in rows], "doc_id long, text string"))
    assert {r["doc_id"]: r["licenses"] for r in out.collect()} == {d: name for d, name, _ in rows}


def test_spacing_and_marks_as_the_oracle_has_them(spark):
    texts = ["Released to the  public  domain.", "All rights-reserved", "ALL RIGHTS\tRESERVED!", "(c) x; all rights reserved", "Licensed under -- CC BY 4.0 --.", "Redistribution and use, in source and binary forms, with or without modification, are permitted!"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    assert rows(licenses.scan(docs)) == rows(con.execute(licenses.oracle_sql()).df())
    assert {r["doc_id"] for r in licenses.scan(docs).filter("n_known > 0").collect()} == {0, 1, 2, 3, 4, 5}


APACHE_FULL = """                                 Apache License
                           Version 2.0, January 2004
                        http://www.apache.org/licenses/

   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION

   1. Definitions.

      "License" shall mean the terms and conditions for use."""
GPL_FULL = """                    GNU GENERAL PUBLIC LICENSE
                       Version 3, 29 June 2007

 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>
 Everyone is permitted to copy and distribute verbatim copies
 of this license document, but changing it is not allowed."""
UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or
distribute this software."""
ZLIB = """This software is provided 'as-is', without any express or implied
warranty.  In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:"""


def test_titles_expressions_and_short_notices(spark):
    cases = [
        (APACHE_FULL, "Apache-2.0"), (GPL_FULL, "GPL-3.0"), (UNLICENSE, "Unlicense"), ("Eclipse Public License - v 2.0\n\nTHE ACCOMPANYING PROGRAM IS PROVIDED", "EPL-2.0"), (ZLIB, "Zlib"),
        ("Boost Software License - Version 1.0 - August 17th, 2003\n\nPermission is hereby", "BSL-1.0"), ("// SPDX-License-Identifier: MIT OR Apache-2.0\n", "Apache-2.0,MIT"),
        ("# SPDX-License-Identifier: (MIT AND BSD-3-Clause)", "BSD-3-Clause,MIT"), ("SPDX-License-Identifier: GPL-2.0-or-later WITH Classpath-exception-2.0", "GPL-2.0-or-later"), ("SPDX-License-Identifier: Other-1.0", ""),
        ("Distributed under the Apache License, Version 2.0.", "Apache-2.0"), ("This project is licensed under the MIT License - see the LICENSE file for details", "MIT"),
        ("Licensed under the Apache License 2.0", "Apache-2.0"), (FULL_MIT.replace("\n", "<br>\n"), "MIT"), (FULL_MIT.replace("\n", "<br/>"), "MIT"), ("The code is available under the BSD 3-Clause license.", "BSD-3-Clause"),
    ]
    got = licenses.scan(spark.createDataFrame([(k, t) for k, (t, _) in enumerate(cases)], "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["licenses"] for r in got} == {k: x for k, (_, x) in enumerate(cases)}


@pytest.mark.parametrize("line", ["neither the name of a software\n", "copyright software ", "copyright software\n", "(<a <b software", "\n \n.;:! licen", "permission is granted to anyone to use this software for any purpose "])
def test_long_texts_take_time_in_proportion(spark, line):
    """Two megabytes of the beginning of a known sentence."""
    began = time.time()
    assert licenses.scan(spark.createDataFrame([(1, line * (2_000_000 // len(line)))], "doc_id long, text string")).first()["licenses"] == ""
    assert time.time() - began < 30
