"""Sentences by which licences are known, and the rules that sequences of them follow."""

from __future__ import annotations

import re
from dataclasses import dataclass

#: Sentences of licence texts, notices and headers, as their authors publish them.
TEXTS = (
    ("MIT-TITLE", "The MIT License (MIT)"),
    ("MIT-REF", "Released under the MIT License"),
    ("MIT-REF", "Licensed under the MIT License"),
    ("MIT-REF", "This project is licensed under the MIT License"),
    ("MIT-REF", "Use of this source code is governed by an MIT-style license that can be found in the LICENSE file"),
    ("MIT-GRANT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MIT-GRANT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    ("MIT-KEEP", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("MIT-KEEP", "The above copyright notice and this permission notice (including the next paragraph) shall be included in all copies or substantial portions of the Software."),
    ("AS-IS", 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND'),
    ("AS-IS", 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.'),
    ("MIT-LIABLE", "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("APACHE2-TITLE", "Apache License Version 2.0, January 2004"),
    ("APACHE2-REF", "Licensed under the Apache License, Version 2.0"),
    ("APACHE2-REF", 'Licensed under the Apache License, Version 2.0 (the "License")'),
    ("APACHE2-REF", "This project is licensed under the Apache License, Version 2.0"),
    ("APACHE2-GRANT", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("APACHE2-GRANT", 'The ASF licenses this file to You under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("APACHE2-FILE", "you may not use this file except in compliance with the License."),
    ("APACHE2-COPY", "You may obtain a copy of the License at"),
    ("APACHE2-COPY", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("APACHE2-COPY", "You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0"),
    ("APACHE2-AS-IS", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'),
    ("APACHE2-SEE", "See the License for the specific language governing permissions and limitations under the License."),
    ("BSD-GRANT", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("BSD-GRANT", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD-KEEP", "Redistributions of source code must retain the above copyright notice"),
    ("BSD-KEEP", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("BSD-BINARY", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD-NAMES", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-NAMES", "Neither the name of the author nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-AS-IS", 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.'),
    ("BSD-LIABLE", "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("ISC-GRANT", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("ISC-GRANT", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("0BSD-GRANT", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("ISC-AS-IS", 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.'),
    ("ISC-LIABLE", "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("MPL2-TITLE", "Mozilla Public License Version 2.0"),
    ("MPL2-GRANT", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL2-COPY", "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("MPL2-COPY", "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("EPL2-TITLE", "Eclipse Public License - v 2.0"),
    ("EPL2-GRANT", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ("EPL2-GRANT", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v2.0 which accompanies this distribution"),
    ("EPL2-GRANT", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("EPL1-GRANT", "All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html"),
    ("UNLICENSE-GRANT", "This is free and unencumbered software released into the public domain."),
    ("UNLICENSE-ANYONE", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("BOOST-TITLE", "Boost Software License - Version 1.0 - August 17th, 2003"),
    ("BOOST-REF", "Distributed under the Boost Software License, Version 1.0."),
    ("CC0-REF", "CC0 1.0 Universal (public domain dedication, no license fee)"),
    ("CC0-REF", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("ALL-RIGHTS", "All rights reserved."),
    ("ALL-RIGHTS", "Unauthorized copying of this file, via any medium is strictly prohibited proprietary and confidential, all rights reserved"),
)

#: Names of the GNU licences, their short forms and versions.
GNU = (("GPL", "GNU General Public License", ("2", "3")), ("LGPL", "GNU Lesser General Public License", ("2.1", "3")), ("AGPL", "GNU Affero General Public License", ("3",)))
GNU_TITLES = {"GPL2": "Version 2, June 1991", "GPL3": "Version 3, 29 June 2007", "LGPL2.1": "Version 2.1, February 1999", "LGPL3": "Version 3, 29 June 2007", "AGPL3": "Version 3, 19 November 2007"}
#: What may follow CC BY, and how the long form says it.
CC_TERMS = {"": "Attribution", "-SA": "Attribution-ShareAlike", "-NC": "Attribution-NonCommercial", "-ND": "Attribution-NoDerivatives", "-NC-SA": "Attribution-NonCommercial-ShareAlike", "-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
#: Identifiers of the SPDX list, with the licence and kind that they stand for here.
SPDX = {
    "MIT": "permissive", "Apache-2.0": "permissive", "BSD-2-Clause": "permissive", "BSD-3-Clause": "permissive", "0BSD": "permissive", "ISC": "permissive", "MPL-2.0": "copyleft", "EPL-1.0": "copyleft", "EPL-2.0": "copyleft",
    "Unlicense": "permissive", "BSL-1.0": "permissive", "CC0-1.0": "permissive",
}


def _gnu_sentences() -> list[tuple[str, str]]:
    out = []
    for short, name, versions in GNU:
        for version in versions:
            key = f"{short}{version}"
            out.append((f"{key}-TITLE", f"{name} {GNU_TITLES[key]}"))
            out += [(f"{key}-REF", f"This work is licensed under the {name}, version {version}"), (f"{key}-REF", f"Licensed under the {name}, version {version}"), (f"{key}-REF", f"This project is licensed under the {name} v{version}.0" if "." not in version else f"This project is licensed under the {name} v{version}")]
            for what in ("program", "library", "file"):
                head = f"This {what} is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation"
                out += [(f"{key}-LATER", f"{head}, either version {version} of the License, or (at your option) any later version."), (f"{key}-ONLY", f"{head}, version {version}."), (f"{key}-ONLY", f"{head}, version {version} of the License.")]
        for what in ("program", "library", "file"):
            out.append((f"{short}-GRANT", f"This {what} is free software: you can redistribute it and/or modify it under the terms of the {name}"))
            out.append(("GNU-WARRANTY", f"This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY"))
            out.append(("GNU-WARRANTY", f"This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."))
            out.append(("GNU-RECEIVED", f"You should have received a copy of the {name} along with this {what}."))
            for address in ("51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA", "59 Temple Place, Suite 330, Boston, MA 02111-1307 USA"):
                out.append(("GNU-RECEIVED", f"You should have received a copy of the {name} along with this {what}; if not, write to the Free Software Foundation, Inc., {address}"))
        out.append(("GNU-SEE", f"See the {name} for more details."))
    for scheme in ("http", "https"):
        out.append(("GNU-IF-NOT", f"If not, see <{scheme}://www.gnu.org/licenses/>."))
    return out


def _cc_sentences() -> list[tuple[str, str]]:
    out = []
    for term, name in CC_TERMS.items():
        for version, scope in (("3.0", "Unported"), ("4.0", "International")):
            key = f"CC-BY{term}-{version}-REF"
            short = f"CC BY{term} {version}"
            out += [(key, f"Licensed under {short}"), (key, f"This work is licensed under {short}"), (key, f"This work is licensed under a Creative Commons {name} {version} {scope} License."), (key, f"Creative Commons {name} {version} {scope} Public License")]
    return out


def _spdx_sentences() -> list[tuple[str, str]]:
    gnu = [f"{short}-{version}{'' if '.' in version else '.0'}" for short, _, versions in GNU for version in versions]
    names = [*SPDX, *[f"{g}{end}" for g in gnu for end in ("", "-only", "-or-later")], *[f"CC-BY{t}-{v}" for t in CC_TERMS for v in ("3.0", "4.0")]]
    return [(f"SPDX-{n.removesuffix('-only').removesuffix('-or-later')}", f"SPDX-License-Identifier: {n}") for n in names]


def plain(text: str) -> str:
    """Words in lower case with single spaces between them."""
    return " ".join(re.sub("[^a-z0-9]+", " ", text.lower()).split())


SENTENCES = {plain(text): name for name, text in [*TEXTS, *_gnu_sentences(), *_cc_sentences(), *_spdx_sentences()]}
#: Their first word, sentences with somebody's name in them, and the form with a fixed name under which they are known. Names have at most 16 words.
NAMED = (("neither", r"(?i)neither\W+the\W+names?\W+of\W+(?:\w+\W+){1,16}?nor\W+the\W+names?\W+of\W+(?:its|their|his)\W+contributors", "Neither the name of the copyright holder nor the names of its contributors"),)
#: A word of each known sentence contains one of these; no line end can split them.
KEYWORDS = ("licens", "copyright", "reserved", "warrant", "hereby", "distribut", "unencumbered", "liable", "endorse")


@dataclass(frozen=True)
class Rule:
    """A licence, its kind, and the sentence identifiers in a row that show it."""

    licence: str
    kind: str
    sentences: tuple[str, ...]


def _rules() -> tuple[Rule, ...]:
    out: list[Rule] = []

    def rule(licence: str, kind: str, *rows: str) -> None:
        out.extend(Rule(licence, kind, tuple(r.split())) for r in rows)

    mit = ("MIT-GRANT MIT-KEEP AS-IS MIT-LIABLE", "MIT-GRANT MIT-KEEP AS-IS", "MIT-GRANT MIT-KEEP", "MIT-GRANT")
    rule("MIT", "permissive", *[f"MIT-TITLE {r}" for r in mit], *mit, "MIT-TITLE", "MIT-REF")
    tail = ("APACHE2-COPY APACHE2-AS-IS APACHE2-SEE", "APACHE2-COPY APACHE2-AS-IS", "APACHE2-COPY", "")
    rule("Apache-2.0", "permissive", *[f"{head} {t}" for head in ("APACHE2-GRANT", "APACHE2-REF APACHE2-FILE", "APACHE2-REF") for t in tail], "APACHE2-TITLE")
    end = ("BSD-AS-IS BSD-LIABLE", "BSD-AS-IS", "")
    rule("BSD-3-Clause", "permissive", *[f"BSD-GRANT BSD-KEEP BSD-BINARY BSD-NAMES {e}" for e in end])
    rule("BSD-2-Clause", "permissive", *[f"BSD-GRANT BSD-KEEP BSD-BINARY {e}" for e in end])
    rule("BSD", "permissive", "BSD-GRANT BSD-KEEP", "BSD-GRANT")
    rule("ISC", "permissive", "ISC-GRANT ISC-AS-IS ISC-LIABLE", "ISC-GRANT ISC-AS-IS", "ISC-GRANT")
    rule("0BSD", "permissive", "0BSD-GRANT ISC-AS-IS ISC-LIABLE", "0BSD-GRANT ISC-AS-IS", "0BSD-GRANT")
    notice = ("GNU-WARRANTY GNU-SEE GNU-RECEIVED GNU-IF-NOT", "GNU-WARRANTY GNU-SEE GNU-RECEIVED", "GNU-WARRANTY GNU-SEE", "GNU-WARRANTY", "")
    for short, _, versions in GNU:
        for version in versions:
            licence = f"{short}-{version}{'' if '.' in version else '.0'}"
            key = f"{short}{version}"
            rule(licence, "copyleft", *[f"{key}-{head} {n}" for head in ("LATER", "ONLY") for n in notice], f"{key}-TITLE", f"{key}-REF", f"SPDX-{licence}")
        rule(short, "copyleft", *[f"{short}-GRANT {n}" for n in notice])
    rule("MPL-2.0", "copyleft", "MPL2-GRANT MPL2-COPY", "MPL2-GRANT", "MPL2-TITLE")
    rule("EPL-2.0", "copyleft", "EPL2-GRANT", "EPL2-TITLE")
    rule("EPL-1.0", "copyleft", "EPL1-GRANT")
    rule("Unlicense", "permissive", "UNLICENSE-GRANT UNLICENSE-ANYONE", "UNLICENSE-GRANT")
    rule("BSL-1.0", "permissive", "BOOST-TITLE", "BOOST-REF")
    rule("CC0-1.0", "permissive", "CC0-REF")
    for term in CC_TERMS:
        kind = "noncommercial" if "-NC" in term else "copyleft" if "-SA" in term else "noderivatives" if "-ND" in term else "permissive"
        for version in ("3.0", "4.0"):
            name = f"CC-BY{term}-{version}"
            rule(name, kind, f"{name}-REF", f"SPDX-{name}")
    for name, kind in SPDX.items():
        rule(name, kind, f"SPDX-{name}")
    rule("Proprietary", "proprietary", "ALL-RIGHTS")
    return tuple(out)


#: In order: a longer rule comes before its parts.
RULES = _rules()
#: The strictest kind comes first.
KINDS = ("proprietary", "noncommercial", "noderivatives", "copyleft", "permissive")
