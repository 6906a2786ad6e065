"""Licence identifiers of the public SPDX list, and texts that stand for them.

Of short licences the whole text, of long ones the title and the notice that they ask for, and the ways in which headers name them.
"""

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_NAMES = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
_BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."""
_ISC_TAIL = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."""
_UNLICENSE = """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_GNU = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details."""
_MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""
_BOOST = """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so"""

#: GNU licences: identifier, full name, version, date, short name.
_GNU_LICENSES = [
    ("GPL-2.0", "General Public License", "2", "June 1991", "gpl"), ("GPL-3.0", "General Public License", "3", "29 June 2007", "gpl"), ("LGPL-2.1", "Lesser General Public License", "2.1", "February 1999", "lgpl"),
    ("LGPL-3.0", "Lesser General Public License", "3", "29 June 2007", "lgpl"), ("AGPL-3.0", "Affero General Public License", "3", "19 November 2007", "agpl"),
]
#: Creative Commons licences: identifier, what follows Attribution in the full name, short name.
_CC_LICENSES = [("CC-BY-4.0", "", "by"), ("CC-BY-SA-4.0", "-ShareAlike", "by-sa"), ("CC-BY-NC-4.0", "-NonCommercial", "by-nc"), ("CC-BY-ND-4.0", "-NoDerivatives", "by-nd"), ("CC-BY-NC-SA-4.0", "-NonCommercial-ShareAlike", "by-nc-sa")]
#: Licences that headers call by a plain name: identifier, names, version.
_NAMED = [
    ("MIT", ["MIT License"], None), ("ISC", ["ISC License"], None), ("BSD-2-Clause", ["BSD 2-Clause License", "Simplified BSD License"], None), ("BSD-3-Clause", ["BSD 3-Clause License", "New BSD License", "BSD-style license"], None),
    ("Apache-2.0", ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 license"], "2"), ("MPL-2.0", ["Mozilla Public License, version 2.0", "Mozilla Public License 2.0"], "2"), ("Zlib", ["zlib License"], None), ("BSL-1.0", ["Boost Software License, Version 1.0"], "1"),
    ("EPL-2.0", ["Eclipse Public License, Version 2.0", "Eclipse Public License 2.0"], "2"), ("Unlicense", ["Unlicense"], None), ("CC0-1.0", ["CC0 1.0 Universal"], "1"), ("WTFPL", ["Do What The Fuck You Want To Public License"], None),
]


def _made() -> list[tuple[str, str | None, str]]:
    out = [
        ("MIT", None, _MIT), ("MIT", None, _MIT.split(" subject to")[0]), ("MIT", None, f"MIT License {_MIT}"), ("ISC", None, f"{_ISC} {_ISC_TAIL}"), ("ISC", None, _ISC), ("ISC", None, f"ISC License {_ISC} {_ISC_TAIL}"),
        ("BSD-2-Clause", None, f"{_BSD_HEAD} {_BSD_TAIL}"), ("BSD-3-Clause", None, f"{_BSD_HEAD} {_BSD_NAMES} {_BSD_TAIL}"), ("BSD-3-Clause", None, f"{_BSD_HEAD} {_BSD_NAMES}"), ("Zlib", None, _ZLIB),
        ("Unlicense", None, _UNLICENSE), ("Unlicense", None, _UNLICENSE.split(".")[0]), ("Apache-2.0", "2", _APACHE), ("Apache-2.0", "2", _APACHE.split(" You may")[0]),
        ("Apache-2.0", "2", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"), ("MPL-2.0", "2", _MPL), ("MPL-2.0", "2", _MPL.split(" If")[0]), ("MPL-2.0", "2", "Mozilla Public License Version 2.0"),
        ("BSL-1.0", None, _BOOST), ("BSL-1.0", "1", "Boost Software License - Version 1.0 - August 17th, 2003"), ("EPL-2.0", "2", "Eclipse Public License - v 2.0"), ("CC0-1.0", "1", "Dedicated to the public domain under CC0 1.0."), ("CC0-1.0", "1", "Creative Commons Legal Code CC0 1.0 Universal"),
    ]
    for name, title, version, date, short in _GNU_LICENSES:
        notice = _GNU.format(name=title, version=version)
        out += [(name, version, t) for t in (notice, notice.split(" This program is distributed")[0], f"GNU {title} Version {version}", f"GNU {title} Version {version}, {date}", f"This work is licensed under the GNU {title}, version {version}.", f"Licensed under the {short} v{version}", f"Licensed under {short}v{version}")]
    for name, title, short in _CC_LICENSES:
        out += [(name, "4", t) for t in (f"This work is licensed under a Creative Commons Attribution{title} 4.0 International License.", f"Creative Commons Attribution{title} 4.0 International", f"Licensed under CC {short} 4.0.", f"Licensed under CC-{short}-4.0")]
    for name, titles, version in _NAMED:
        out += [(name, version, t.format(x)) for x in titles for t in ("{}", "Licensed under the {}.", "Released under the {}.", "This project is licensed under the {}, see the LICENSE file for details.")]
    return out


#: (licence, version that a text has to name or None, text)
TEMPLATES = list(dict.fromkeys(_made()))
