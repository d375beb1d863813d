"""License statements and notices that a scan looks for.

The texts are fixed values: the notices as their publishers ask for them to be put on files, the whole text of the
short licenses, and the statements by which a license is commonly named. Names and years of copyright
holders are left out.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    #: Templates of one family are rivals: they share most of their words, and the better match counts.
    family: str = ""


_GNU = """is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the"""
_BSD_DISCLAIMER = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL,
EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE,
DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT
LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF
THE POSSIBILITY OF SUCH DAMAGE."""
_BSD_TERMS = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of
conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list
of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""


def _creative_commons(label: str, name: str, code: str) -> Template:
    return Template(
        label,
        f"""This work is licensed under the Creative Commons {name} 4.0 International License. To view a copy of this license,
        visit http://creativecommons.org/licenses/{code}/4.0/ or send a letter to Creative Commons, PO Box 1866, Mountain View,
        CA 94042, USA.""",
        "cc",
    )


def _gnu(label: str, thing: str, license_: str, version: str, end: str) -> Template:
    return Template(
        label,
        f"""This {thing} is free software; you can redistribute it and/or modify it under the terms of the {license_} as published
        by the Free Software Foundation; either version {version} of the License, or (at your option) any later version. This {thing}
        {_GNU} {license_} for more details. You should have received a copy of the {license_} along with this {thing}{end}""",
        "gnu",
    )


_WRITE = "; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA."
_SEE = ". If not, see <https://www.gnu.org/licenses/>."

NOTICES: tuple[Template, ...] = (
    Template("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to
use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the
Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall
be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY
KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND
NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER
IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS
IN THE SOFTWARE."""),
    Template("bsd-2-clause", _BSD_TERMS + _BSD_DISCLAIMER, "bsd"),
    Template("bsd-3-clause", _BSD_TERMS + """ 3. Neither the name of the copyright holder nor the names of its contributors may be
used to endorse or promote products derived from this software without specific prior written permission.""" + _BSD_DISCLAIMER, "bsd"),
    Template("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS"
AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND
FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES
WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION,
ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""", "isc"),
    Template("0bsd", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT,
NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""", "isc"),
    Template("apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by
applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES
OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and
limitations under the License.""", "apache"),
    _gnu("gpl-2.0", "program", "GNU General Public License", "2", _WRITE),
    _gnu("gpl-3.0", "program", "GNU General Public License", "3", _SEE),
    _gnu("lgpl-2.1", "library", "GNU Lesser General Public License", "2.1", _WRITE),
    _gnu("lgpl-3.0", "library", "GNU Lesser General Public License", "3", _SEE),
    _gnu("agpl-3.0", "program", "GNU Affero General Public License", "3", _SEE),
    Template("gfdl-1.3", """Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free
Documentation License, Version 1.3 or any later version published by the Free Software Foundation; with no Invariant Sections, no
Front-Cover Texts, and no Back-Cover Texts. A copy of the license is included in the section entitled "GNU Free Documentation
License"."""),
    Template("mpl-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was
not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""),
    Template("epl-2.0", """This program and the accompanying materials are made available under the terms of the Eclipse Public License
2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"""),
    Template("bsl-1.0", """Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at
https://www.boost.org/LICENSE_1_0.txt)"""),
    Template("zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin
of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a
product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be
plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered
from any source distribution."""),
    Template("unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify,
publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose,
commercial or non-commercial, and by any means."""),
    Template("cc0-1.0", """To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights
to this software to the public domain worldwide. This software is distributed without any warranty. You should have received a copy
of the CC0 Public Domain Dedication along with this software. If not, see <http://creativecommons.org/publicdomain/zero/1.0/>."""),
    Template("ofl-1.1", """This Font Software is licensed under the SIL Open Font License, Version 1.1. This license is copied below, and is
also available with a FAQ at: https://openfontlicense.org"""),
    Template("odbl-1.0", """is made available under the Open Database License: http://opendatacommons.org/licenses/odbl/1.0/. Any rights in
individual contents of the database are licensed under the Database Contents License:
http://opendatacommons.org/licenses/dbcl/1.0/"""),
    _creative_commons("cc-by-4.0", "Attribution", "by"),
    _creative_commons("cc-by-sa-4.0", "Attribution-ShareAlike", "by-sa"),
    _creative_commons("cc-by-nc-4.0", "Attribution-NonCommercial", "by-nc"),
    _creative_commons("cc-by-nd-4.0", "Attribution-NoDerivatives", "by-nd"),
    _creative_commons("cc-by-nc-sa-4.0", "Attribution-NonCommercial-ShareAlike", "by-nc-sa"),
    _creative_commons("cc-by-nc-nd-4.0", "Attribution-NonCommercial-NoDerivatives", "by-nc-nd"),
)

STATEMENTS: tuple[Template, ...] = (
    Template("mit", "under the MIT License"),
    Template("mit", "under the terms of the MIT license"),
    Template("bsd", "under the BSD License"),
    Template("apache-2.0", "Apache License, Version 2.0", "apache"),
    Template("apache-2.0", "Apache License 2.0", "apache"),
    Template("gpl-2.0", "GNU General Public License, version 2", "gnu"),
    Template("gpl-2.0", "GNU General Public License v2.0", "gnu"),
    Template("gpl-3.0", "GNU General Public License, version 3", "gnu"),
    Template("gpl-3.0", "GNU General Public License v3.0", "gnu"),
    Template("lgpl-2.1", "GNU Lesser General Public License, version 2.1", "gnu"),
    Template("lgpl-3.0", "GNU Lesser General Public License, version 3", "gnu"),
    Template("agpl-3.0", "GNU Affero General Public License, version 3", "gnu"),
    Template("mpl-2.0", "Mozilla Public License, version 2.0"),
    Template("epl-2.0", "Eclipse Public License, version 2.0"),
    Template("cc-by-4.0", "CC BY 4.0", "cc"),
    Template("cc-by-sa-4.0", "CC BY-SA 4.0", "cc"),
    Template("cc-by-nc-4.0", "CC BY-NC 4.0", "cc"),
    Template("cc-by-nd-4.0", "CC BY-ND 4.0", "cc"),
    Template("cc-by-nc-sa-4.0", "CC BY-NC-SA 4.0", "cc"),
    Template("cc-by-nc-nd-4.0", "CC BY-NC-ND 4.0", "cc"),
    Template("all-rights-reserved", "All rights reserved"),
)

#: Phrase to label.
PHRASES: dict[str, str] = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
