"""Known licence texts and notices: (id, kind, text). Kind "text": a whole licence; "notice": a statement that names one."""

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_1 = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
_BSD_2 = "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_3 = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_0BSD = _ISC.replace(", provided that the above copyright notice and this permission notice appear in all copies", "")
_APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

This notice may not be removed or altered from any source distribution."""

_UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <http://unlicense.org/>"""
_BOOST = """Boost Software License - Version 1.0 - August 17th, 2003

Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:

The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""

_CC = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
_GNU = {"GPL": ("General Public License", ("2.0", "3.0")), "LGPL": ("Lesser General Public License", ("2.1", "3.0")), "AGPL": ("Affero General Public License", ("3.0",)), "FDL": ("Free Documentation License", ("1.2", "1.3"))}


def _names() -> dict[str, list[str]]:
    """Names by which lines call a licence."""
    out = {
        "MIT": ["MIT", "MIT License", "Expat License"], "ISC": ["ISC", "ISC License"], "Unlicense": ["Unlicense"], "Zlib": ["zlib", "zlib License"], "0BSD": ["0BSD", "Zero-Clause BSD License"],
        "Apache-2.0": ["Apache-2.0", "Apache 2.0 License", "Apache License 2.0", "Apache License, Version 2.0", "Apache Software License, Version 2.0", "Apache License v2.0"],
        "BSD-2-Clause": ["BSD-2-Clause", "BSD 2-Clause License", "2-Clause BSD License", "Simplified BSD License"], "BSD-3-Clause": ["BSD-3-Clause", "BSD 3-Clause License", "3-Clause BSD License", "New BSD License", "Modified BSD License"],
        "MPL-2.0": ["MPL-2.0", "MPL 2.0", "Mozilla Public License 2.0", "Mozilla Public License, Version 2.0", "Mozilla Public License, v. 2.0"], "EPL-2.0": ["EPL-2.0", "Eclipse Public License 2.0", "Eclipse Public License, Version 2.0", "Eclipse Public License - v 2.0"],
        "BSL-1.0": ["BSL-1.0", "Boost Software License 1.0", "Boost Software License, Version 1.0"], "Artistic-2.0": ["Artistic-2.0", "Artistic License 2.0"],
        "CC0-1.0": ["CC0", "CC0 1.0", "CC0 1.0 Universal", "Creative Commons CC0 1.0 Universal", "Creative Commons Zero v1.0 Universal"],
    }
    for short, (name, versions) in _GNU.items():
        for v in versions:
            n = v.removesuffix(".0")
            both = dict.fromkeys(x for w in dict.fromkeys((v, n)) for x in (f"GNU {name}, version {w}", f"GNU {name} v{w}", f"GNU {name} {w}", f"GNU {short} v{w}", f"GNU {short} {w}", f"GNU {short}v{w}", f"{short}v{w}", f"{short} v{w}", f"{short}-{w}", f"GNU {short} version {w}"))
            out[f"{'G' * (short == 'FDL')}{short}-{v}"] = list(both)
            for suffix in ("only", "or-later"):
                out[f"{'G' * (short == 'FDL')}{short}-{v}-{suffix}"] = [f"{short}-{v}-{suffix}"] + [f"{x} or later" for x in both if suffix == "or-later"] + [f"{x} or any later version" for x in both if suffix == "or-later"]
    for short, name in _CC.items():
        for v in ("3.0", "4.0"):
            out[f"CC-{short}-{v}"] = [f"CC {short} {v}", f"Creative Commons {short} {v}", *(f"Creative Commons {name} {v}{x}" for x in ("", " License", " International", " International License", " Unported License")), f"CC {short} {v} License"]
    return out


KNOWN = [
    ("MIT", "text", _MIT),
    ("MIT", "text", "MIT License\n\n" + _MIT),
    ("BSD-2-Clause", "text", "\n".join((_BSD_HEAD, "1. " + _BSD_1, "2. " + _BSD_2, _BSD_TAIL))),
    ("BSD-2-Clause", "text", "\n".join((_BSD_HEAD, _BSD_1, _BSD_2, _BSD_TAIL))),
    ("BSD-3-Clause", "text", "\n".join((_BSD_HEAD, "1. " + _BSD_1, "2. " + _BSD_2, "3. " + _BSD_3, _BSD_TAIL))),
    ("BSD-3-Clause", "text", "\n".join((_BSD_HEAD, _BSD_1, _BSD_2, _BSD_3, _BSD_TAIL))),
    ("ISC", "text", _ISC),
    ("ISC", "text", "ISC License\n\n" + _ISC),
    ("0BSD", "text", _0BSD),
    ("Zlib", "text", _ZLIB),
    ("Unlicense", "text", _UNLICENSE),
    ("BSL-1.0", "text", _BOOST),
    ("BSL-1.0", "text", _BOOST.split("\n\n", 1)[1]),
    ("Apache-2.0", "text", _APACHE_NOTICE),
    ("CC0-1.0", "notice", "This work is dedicated to the public domain."),
    ("Unlicense", "notice", "This is free and unencumbered software released into the public domain."),
    ("all-rights-reserved", "notice", "All rights reserved."),
    *((i, "name", n) for i, ns in _names().items() for n in ns),
    *((i, "notice", n) for i, ns in _names().items() for n in ns if "License" in n),
]
