"""Published licence texts and notices, as they are wrapped and marked in files, and the licences that they state."""

from __future__ import annotations

from tessera.llm.license_scan import license_scan

MIT = """MIT License

Copyright (c) 2020 Jane Doe

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
BSD2 = """Copyright (c) 2020, Jane Doe
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
TAIL = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED.
"""
BSD3 = BSD2 + """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
""" + TAIL
APACHE = """Copyright 2020 Jane Doe

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
"""


def gnu(kind, name, version, later=True):
    end = f"either version {version} of the License, or\n(at your option) any later version." if later else f"version {version}."
    return f"""This {kind} is free software: you can redistribute it and/or modify
it under the terms of the GNU {name}General Public License as published by
the Free Software Foundation, {end}

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU {name}General Public License for more details.

You should have received a copy of the GNU {name}General Public License
along with this program.  If not, see <https://www.gnu.org/licenses/>.
"""
LGPL21 = """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version.
"""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at http://mozilla.org/MPL/2.0/.
"""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.
"""


def marked(text, mark):
    return "\n".join(f"{mark} {line}".rstrip() for line in text.splitlines())


def block(text):
    return f"/*\n{marked(text, ' *')}\n */\nint main;\n"


CASES = [
    (MIT, "MIT"), (BSD2 + TAIL, "BSD-2-Clause"), (BSD3, "BSD-3-Clause"), (APACHE, "Apache-2.0"), (MPL, "MPL-2.0"), (ISC, "ISC"), (LGPL21, "LGPL-2.1-or-later"),
    (gnu("program", "", "3"), "GPL-3.0-or-later"), (gnu("program", "", "2"), "GPL-2.0-or-later"), (gnu("program", "", "2", False), "GPL-2.0"),
    (gnu("program", "Affero ", "3"), "AGPL-3.0-or-later"), (gnu("library", "Lesser ", "3"), "LGPL-3.0-or-later"),
]
SPDX = [
    ("// SPDX-License-Identifier: MIT OR Apache-2.0\nx","Apache-2.0,MIT"),("# SPDX-License-Identifier: GPL-2.0-only","GPL-2.0"),("/* SPDX-License-Identifier: GPL-2.0-or-later */","GPL-2.0-or-later"),
 ("SPDX-License-Identifier: (MIT AND BSD-3-Clause)","BSD-3-Clause,MIT"),("// SPDX-License-Identifier: GPL-2.0 WITH Linux-syscall-note","GPL-2.0"),("# SPDX-License-Identifier: LGPL-2.1+","LGPL-2.1-or-later"),("SPDX-License-Identifier:MIT","MIT"),
 ("-- SPDX-License-Identifier: ISC\n-- more","ISC"),("<!-- SPDX-License-Identifier: CC-BY-SA-4.0 -->","CC-BY-SA-4.0"),("SPDX-License-Identifier: MIT-0","MIT-0")]
NONE = ["He spoke of the MIT license debate.","The GNU General Public License is long. Version 3 came later.","Sublicense fees rise. All copyright questions are open.","See the License for more details."]


def test_published_texts(spark):
    texts = [(form(text), licence) for text, licence in CASES for form in (str, block, lambda t: marked(t, "#"), lambda t: marked(t, "//"), lambda t: marked(t, "   "))]
    texts += [*SPDX, *((t, "") for t in NONE), (MIT + "\n" + APACHE, "Apache-2.0,MIT"), (MIT * 300, "MIT")]
    got = {r.doc_id: r for r in license_scan(spark.createDataFrame([(k, t) for k, (t, _) in enumerate(texts)], "doc_id long, text string")).collect()}
    assert [(k, got[k].licenses) for k in range(len(texts))] == [(k, licence) for k, (_, licence) in enumerate(texts)]
    assert all(r.n_unknown == r.sentence_ids.split(",").count("UNKNOWN") for r in got.values())


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n\n"), (None, "Released under the MIT License."), (4, "Released under the MIT License."), (4, "Released under the MIT License."), (5, "license " * 20_000)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, licenses string")
    got = sorted(((r.doc_id, r.sentence_ids, r.licenses, r.n_unknown) for r in license_scan(docs).collect()), key=str)
    assert got == sorted([(1, "", "", 0), (2, "", "", 0), (3, "", "", 0), (5, "UNKNOWN", "", 1), *[(i, "MIT-NAME", "MIT", 0) for i in (None, 4, 4)]], key=str)
    assert license_scan(docs.limit(0)).count() == 0
