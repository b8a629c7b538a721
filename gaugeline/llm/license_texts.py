"""Templates of the registered license scan: notices, file headers, SPDX
lines, Creative Commons lines and whole texts (``licenses/<id>.txt``)."""

from __future__ import annotations

from pathlib import Path

_PERMIT = ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
           "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the "
           "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
           "persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and "
           "this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "
           "\"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
           "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS "
           "BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, "
           "OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.")
_BSD_HEAD = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
             "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of "
             "conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, "
             "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
             "distribution. ")
_BSD_THIRD = ("3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
              "products derived from this software without specific prior written permission. ")
_BSD_END = ("THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, "
            "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
            "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
            "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; "
            "LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN "
            "CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS "
            "SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")
_GNU = ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} Public License as "
        "published by the Free Software Foundation, either version {v} of the License, or (at your option) any later version.")

TEXTS: list[tuple[str, str]] = [
    ("MIT", _PERMIT),
    ("BSD-2-Clause", _BSD_HEAD + _BSD_END),
    ("BSD-3-Clause", _BSD_HEAD + _BSD_THIRD + _BSD_END),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
            "provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS "
            "IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF "
            "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL "
            "DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, "
            "NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable "
             "for any damages arising from the use of this software. Permission is granted to anyone to use this software for any "
             "purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following "
             "restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original "
             "software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but "
             "is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the "
             "original software. 3. This notice may not be removed or altered from any source distribution."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, "
                  "compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, "
                  "commercial or non-commercial, and by any means."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with "
                   "the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by "
                   "applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
                   "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language "
                   "governing permissions and limitations under the License."),
]

# Lines that only name a license; ``TELLING`` applies to them.
NOTICES: list[tuple[str, str]] = [
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
]

_NAMES = {"MIT": ["MIT License"], "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0"], "ISC": ["ISC License"],
          "BSD-2-Clause": ["BSD 2-Clause License"], "BSD-3-Clause": ["BSD 3-Clause License"], "Zlib": ["zlib License"],
          "MPL-1.1": ["Mozilla Public License, version 1.1"], "MPL-2.0": ["Mozilla Public License, version 2.0"],
          "EPL-1.0": ["Eclipse Public License, version 1.0"], "EPL-2.0": ["Eclipse Public License, version 2.0"],
          "BSL-1.0": ["Boost Software License, version 1.0"], "Artistic-2.0": ["Artistic License 2.0"],
          "CC0-1.0": ["CC0 1.0 Universal", "CC0 1.0"], "Unlicense": ["Unlicense"]}
_SPDX = {"GPL-1.0", "GFDL-1.2", "GFDL-1.3", "Artistic-1.0-Perl", *_NAMES}
for _id, _name, _v, _also in (("GPL", "General", "2", "2"), ("GPL", "General", "3", "3"), ("LGPL", "Library General", "2", "2"),
                              ("LGPL", "Lesser General", "2.1", "2.1"), ("LGPL", "Lesser General", "3", "3"),
                              ("AGPL", "Affero General", "3", "3")):
    _key = f"{_id}-{_v}" if "." in _v else f"{_id}-{_v}.0"
    NOTICES.append((_key, _GNU.format(name=_name, v=_v)))
    _NAMES[_key] = [f"GNU {_name} Public License, version {_v}", f"GNU {_name} Public License v{_v}"]
    _SPDX |= {_key}
    NOTICES += [(_key, f"SPDX-License-Identifier: {_key}{end}") for end in ("-only", "-or-later")]
for _id, _all in _NAMES.items():
    for _n in _all:
        NOTICES += [(_id, f"{lead} the {_n}") for lead in ("Licensed under", "Released under", "Distributed under the terms of")]
        NOTICES.append((_id, f"This work is licensed under the {_n}."))
NOTICES += [(_id, f"SPDX-License-Identifier: {_id}") for _id in sorted(_SPDX)]

_LONG = {"by": "Attribution", "nc": "NonCommercial", "sa": "ShareAlike", "nd": "NoDerivatives"}
for _code in ("by", "by-sa", "by-nc", "by-nd", "by-nc-sa", "by-nc-nd"):
    for _v in ("1.0", "2.0", "2.5", "3.0", "4.0"):
        _key, _long = f"CC-{_code.upper()}-{_v}", "-".join(_LONG[x] for x in _code.split("-"))
        NOTICES += [(_key, t) for t in (f"Licensed under CC {_code} {_v}.", f"CC {_code} {_v}", f"Creative Commons {_long} {_v}",
                                      f"creativecommons.org/licenses/{_code}/{_v}", f"SPDX-License-Identifier: {_key}")]
        if "nd" in _code:
            NOTICES.append((_key, f"Creative Commons {_long.replace('NoDerivatives', 'NoDerivs')} {_v}"))

# Notices must match these words and every number; without them a
# sibling (another version, another Creative Commons variant) would fit too.
TELLING = frozenset("cc cc0 by nc sa nd attribution noncommercial sharealike noderivatives noderivs creativecommons mit apache bsd isc "
                    "zlib mozilla eclipse boost artistic unlicense universal gnu general lesser library affero mpl epl bsl lgpl gpl agpl gfdl "
                    "spdx v1 v2 v3".split())


def library() -> list[tuple[str, str]]:
    """(license, text) of every registered template."""
    whole = [(f.name[:-4], f.read_text(encoding="utf-8")) for f in sorted((Path(__file__).parent / "licenses").glob("*.txt"))]
    return TEXTS + NOTICES + whole
