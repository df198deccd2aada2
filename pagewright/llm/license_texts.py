"""Public licence texts and the one-line notices that name a licence."""

from __future__ import annotations

import re
from importlib.resources import files

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""

_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""

_ZERO_BSD = _ISC.replace(", provided that the above copyright notice and this permission notice appear in all copies", "")

_BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""

_BSD_THIRD = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""

_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""

#: (licence, text)
LICENSES = [
    ("0BSD", _ZERO_BSD),
    ("BSD-2-Clause", f"{_BSD_HEAD}\n{_BSD_TAIL}"),
    ("BSD-3-Clause", f"{_BSD_HEAD}{_BSD_THIRD}\n{_BSD_TAIL}"),
    ("ISC", _ISC),
    ("MIT", _MIT),
    ("MIT", f"MIT License\n\n{_MIT}"),
    ("Zlib", _ZLIB),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MPL-2.0", "Licensed under the Mozilla Public License, version 2.0."),
]

#: (spelling, the one it counts as), in lower case, as whole words.
SPELLINGS = [
    ("licence", "license"),
    ("licences", "licenses"),
    ("licenced", "licensed"),
    ("sub license", "sublicense"),
    ("organisation", "organization"),
    ("organisations", "organizations"),
    ("authorised", "authorized"),
    ("acknowledgement", "acknowledgment"),
    ("favour", "favor"),
    ("non commercial", "noncommercial"),
    ("non infringement", "noninfringement"),
    ("per cent", "percent"),
    ("whilst", "while"),
    ("fulfil", "fulfill"),
    ("judgement", "judgment"),
    ("copyright owner", "copyright holder"),
    ("https", "http"),
]

#: Customary titles above the short texts of LICENSES.
TITLES = {
    "0BSD": ["BSD Zero Clause License", "Zero-Clause BSD", "BSD Zero Clause License (0BSD)", "0BSD License"],
    "BSD-2-Clause": ["BSD 2-Clause License", "The BSD 2-Clause License", "The 2-Clause BSD License", "BSD 2-Clause \"Simplified\" License", "Simplified BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "The BSD 3-Clause License", "The 3-Clause BSD License", "BSD 3-Clause \"New\" or \"Revised\" License", "New BSD License", "Modified BSD License", "BSD License"],
    "ISC": ["ISC License", "The ISC License", "ISC License (ISC)"],
    "MIT": ["MIT License", "The MIT License", "MIT License (MIT)", "The MIT License (MIT)"],
    "Zlib": ["zlib License", "The zlib License", "zlib/libpng License", "The zlib/libpng License"],
}

#: Whole texts as files of ``known``, and what may be missing before or after: (licence, file, starts, ends).
_TERMS = "END OF TERMS AND CONDITIONS"
WHOLE = [
    ("Apache-2.0", "Apache-2.0", [], [_TERMS]),
    ("Artistic-1.0-Perl", "Artistic", [], []),
    ("BSD-3-Clause", "BSD", [], []),
    ("CC0-1.0", "CC0-1.0", ["CC0 1.0 Universal"], []),
    ("GFDL-1.2", "GFDL-1.2", [], []),
    ("GFDL-1.3", "GFDL-1.3", [], []),
    ("GPL-1.0", "GPL-1", [], [_TERMS]),
    ("GPL-2.0", "GPL-2", [], [_TERMS]),
    ("GPL-3.0", "GPL-3", [], [_TERMS]),
    ("LGPL-2.0", "LGPL-2", [], [_TERMS]),
    ("LGPL-2.1", "LGPL-2.1", [], [_TERMS]),
    ("LGPL-3.0", "LGPL-3", [], []),
    ("MPL-1.1", "MPL-1.1", [], []),
    ("MPL-2.0", "MPL-2.0", [], ["Exhibit A - Source Code Form License Notice"]),
]


def all_known() -> list[tuple[str, str]]:
    """LICENSES, their texts under customary titles, and the whole texts of the files."""
    out = dict.fromkeys(LICENSES)
    for name, text in LICENSES:
        if "\n" in text and not text.startswith(name):
            forms = [text, text.replace("and/or distribute", "and distribute")]
            forms += [re.sub(r"(?m)^[0-9]\. ", "* ", form) for form in forms]
            out |= dict.fromkeys((name, f"{title}{form}") for form in forms for title in ["", *(f"{t}\n\n" for t in TITLES[name])])
    for name, file, starts, ends in WHOLE:
        text = files("pagewright.llm").joinpath("known", f"{file}.txt").read_text("utf-8")
        bodies = [text, *(text[text.index(x) :] for x in starts)]
        out |= dict.fromkeys((name, x) for body in bodies for x in [body, *(body[: body.index(e)] for e in ends), *(body[: body.index(e) + len(e)] for e in ends if e == _TERMS)])
        if file == "BSD":
            out |= dict.fromkeys((name, f"{t}\n\n{form}") for t in TITLES[name] for form in (text, re.sub(r"(?m)^[0-9]\. ", "* ", text)))
    return list(out)
