"""Genuine notices and headers, wrapped as their authors wrap them."""

import re

import duckdb
import pytest
from pyspark.sql import functions as F

from headerloom.llm import licenses

MIT = """MIT License

Copyright (c) 2021 A. Nother

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
APACHE = """/*
 * Copyright 2020 A. Nother
 *
 * Licensed under the Apache License, Version 2.0 (the "License");
 * you may not use this file except in compliance with the License.
 * You may obtain a copy of the License at
 *
 *     http://www.apache.org/licenses/LICENSE-2.0
 *
 * Unless required by applicable law or agreed to in writing, software
 * distributed under the License is distributed on an "AS IS" BASIS,
 * WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
 * See the License for the specific language governing permissions and
 * limitations under the License.
 */
"""
BSD_HEAD = """Copyright (c) 2019, A. Nother

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
BSD_NAMES = """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
BSD_TAIL = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY,
OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
"""


def gnu(name, version, what="program"):
    return f"""# This {what} is free software: you can redistribute it and/or modify
# it under the terms of the GNU {name} as published by
# the Free Software Foundation, either version {version} of the License, or
# (at your option) any later version.
#
# This {what} is distributed in the hope that it will be useful,
# but WITHOUT ANY WARRANTY; without even the implied warranty of
# MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
# GNU {name} for more details.
#
# You should have received a copy of the GNU {name}
# along with this {what}.  If not, see <https://www.gnu.org/licenses/>.
"""


TEXTS = {
    "mit": (MIT, "MIT"),
    "apache": (APACHE, "Apache-2.0"),
    "bsd2": (BSD_HEAD + BSD_TAIL, "BSD-2-Clause"),
    "bsd3": (BSD_HEAD + BSD_NAMES + BSD_TAIL, "BSD-3-Clause"),
    "gpl2": (gnu("General Public License", 2), "GPL-2.0"),
    "gpl3": (gnu("General Public License", 3), "GPL-3.0"),
    "lgpl21": (gnu("Lesser General Public License", "2.1", "library"), "LGPL-2.1"),
    "lgpl3": (gnu("Lesser General Public License", 3), "LGPL-3.0"),
    "agpl3": (gnu("Affero General Public License", 3), "AGPL-3.0"),
    "isc": ('Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES\nWITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF\nMERCHANTABILITY AND FITNESS.', "ISC"),
    "mpl": ("// This Source Code Form is subject to the terms of the Mozilla Public\n// License, v. 2.0. If a copy of the MPL was not distributed with this\n// file, You can obtain one at https://mozilla.org/MPL/2.0/.", "MPL-2.0"),
    "epl": ("This program and the accompanying materials are made available under the\nterms of the Eclipse Public License 2.0 which is available at\nhttps://www.eclipse.org/legal/epl-2.0/\n\nSPDX-License-Identifier: EPL-2.0", "EPL-2.0"),
    "unlicense": ("This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or\ndistribute this software, either in source code form or as a compiled\nbinary, for any purpose, commercial or non-commercial, and by any\nmeans.", "Unlicense"),
    "cc": ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0\nInternational License.", "CC-BY-SA-4.0"),
    "spdx": ("# SPDX-License-Identifier: LGPL-2.1-or-later", "LGPL-2.1"),
    "boost": ("Distributed under the Boost Software License, Version 1.0.\n(See accompanying file)", "BSL-1.0"),
    "gpl3 title": ("                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007", "GPL-3.0"),
    "dots": ("." * 300_000 + "x licens " + "!" * 300_000, ""),
    "plain": ("A licensed driver may not use this file.", ""),
}


@pytest.fixture(scope="module")
def found(spark):
    docs = spark.createDataFrame([(k, t) for k, (t, _) in TEXTS.items()], "doc_id string, text string")
    return {r.doc_id: r for r in licenses.licences(docs).collect()}


@pytest.mark.parametrize("name", TEXTS)
def test_a_genuine_text_is_known_and_explained(found, name):
    assert (found[name].licenses, found[name].n_unexplained) == (TEXTS[name][1], 0)


def one_line_a_paragraph(text):
    bare = re.sub(r"(?m)^[ \t]*(?:/\*|\*/|\*|#|//)?[ \t]*", "", text)
    return "\n\n".join(" ".join(p.split()) for p in re.split(r"\n\s*\n", bare))


def test_it_does_not_matter_where_lines_end(spark):
    rows = [(f"{k} {how}", change(t)) for k, (t, _) in TEXTS.items() if k in ("mit", "apache", "bsd3", "gpl3", "mpl") for how, change in (("paragraphs", one_line_a_paragraph), ("words", lambda t: t.replace(" ", "\n")))]
    docs = spark.createDataFrame(rows, "doc_id string, text string").repartition(4)
    got = {r.doc_id: r.licenses for r in licenses.licences(docs).select("doc_id", F.col("licenses")).collect()}
    wrong = {k: v for k, v in got.items() if v != TEXTS[k.rsplit(" ", 1)[0]][1]}
    assert not wrong


#: Tags with expressions, the licences in them and the kind of the strictest.
EXPRESSIONS = {
    "// SPDX-License-Identifier: Apache-2.0 OR MIT": ("Apache-2.0,MIT", "permissive"),
    " * spdx-license-identifier: (MIT AND BSD-3-Clause) */": ("BSD-3-Clause,MIT", "permissive"),
    "# SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0 OR MIT": ("GPL-2.0,MIT", "copyleft"),
    "SPDX-License-Identifier: (GPL-2.0+ WITH MIT)": ("GPL-2.0", "copyleft"),
    "<!-- SPDX-License-Identifier: MIT or unheard-of and more -->": ("MIT", "permissive"),
    "SPDX-License-Identifier: MIT": ("MIT", "permissive"),
    "SPDX-License-Identifier: OR AND WITH": ("", "none"),
    "SPDX-License-Identifier:": ("", "none"),
    "see SPDX-License-Identifier: Apache-2.0 OR MIT": ("", "none"),
    "SPDX-License-Identifier: ((((" + "(" * 250_000: ("", "none"),
    "SPDX-License-Identifier: MIT OR" + " " * 250_000 + "with": ("MIT", "permissive"),
    "SPDX-License-Identifier: a OR b\r\nMIT\nSPDX-License-Identifier: MIT AND ISC": ("ISC,MIT", "permissive"),
}


def test_expressions_of_tags_in_spark_and_sql(spark):
    rows = list(enumerate(EXPRESSIONS))
    got = licenses.licences(spark.createDataFrame(rows, "doc_id long, text string")).toPandas().sort_values("doc_id")
    assert dict(zip(EXPRESSIONS, zip(got.licenses, got.kind, strict=True), strict=True)) == EXPRESSIONS
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    expected = con.execute(licenses.oracle()).df().sort_values("doc_id")
    assert expected.to_dict("list") == got[list(expected.columns)].to_dict("list")
