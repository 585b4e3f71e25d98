"""Licence headers as they are usually written: wrapped over lines, in comments, with lists and abbreviations."""

import pytest

from tessera.llm.licenses import find_licences

ASIS = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE."""
MIT = f"""Copyright (c) 2020 Someone Inc. and others

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

{ASIS}"""
ISC = """Copyright (c) 2019, Someone

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES
WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR
ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES."""
BSD = """Copyright 2018 Someone
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
{third}
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL DAMAGES (INCLUDING, BUT NOT LIMITED TO,
LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED."""
THIRD = """3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
GPL = """This {what} is free software{mark} you can redistribute it and/or modify
it under the terms of the GNU {kind}General Public License as published by
the Free Software Foundation; either version {version} of the License, or
(at your option) any later version.

This {what} is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU {kind}General Public License for more details.

You should have received a copy of the GNU {kind}General Public License
along with this {what}; if not, write to the Free Software Foundation, Inc.,
51 Franklin Street, Boston."""
APACHE = """Copyright 2021 Someone

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/."""
HEADERS = {
    "MIT": MIT, "ISC": ISC, "BSD-2-Clause": BSD.format(third=""), "BSD-3-Clause": BSD.format(third=THIRD), "Apache-2.0": APACHE, "MPL-2.0": MPL,
    "GPL-2.0-or-later": GPL.format(what="program", mark=";", kind="", version="2"), "GPL-3.0-or-later": GPL.format(what="program", mark=":", kind="", version="3"),
    "LGPL-2.1-or-later": GPL.format(what="library", mark=";", kind="Lesser ", version="2.1"), "AGPL-3.0-or-later": GPL.format(what="program", mark=":", kind="Affero ", version="3"),
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons\nAttribution-ShareAlike 4.0 International License.", "Public-Domain": "This is free and unencumbered software released into\nthe public domain.",
}
SHORT = {
    "Apache-2.0": "This file is licensed under the\nApache License, Version 2.0.", "MPL-1.1": "This Source Code Form is subject to the terms of the Mozilla Public License, v.\n1.1.", "LGPL-2.1": "Released under the GNU Lesser\nGeneral Public License, version 2.1.",
    "GPL-3.0-or-later": "Released under the GNU General Public License v3\nor later.", "BSD-3-Clause": "Distributed under the 3-clause\nBSD license.", "MIT": "Released under the terms of the\nMIT license.", "CC-BY-NC-4.0": "Licensed under Creative Commons\nBY-NC 4.0.",
    "SPDX:mit": "SPDX-License-Identifier: MIT\nimport this", "GPL-2.0-only": GPL.split("\n\n")[0].format(what="program", mark=";", kind="", version="2").replace("either ", "").replace(", or\n(at your option) any later version", ""),
}
MARKS = {"plain": ("", "", ""), "block": ("/*\n", " * ", "\n */"), "hash": ("#!/bin/sh\n", "# ", ""), "slashes": ("", "// ", ""), "dashes": ("", "-- ", ""), "indented": ("", "    ", "")}


def written(text, marks):
    head, mark, tail = MARKS[marks]
    return head + "\n".join((mark + line).rstrip() for line in text.split("\n")) + tail + "\n\nint main;\n"


@pytest.mark.parametrize("marks", MARKS)
def test_full_headers(marks):
    for name, text in [*HEADERS.items(), *SHORT.items()]:
        whole = written(text, marks)
        found, known, unknown = find_licences(whole)
        assert ([x[0] for x in found], unknown) == ([name], 0) and known, (name, marks)
        assert 0 <= found[0][1] < found[0][2] <= len(whole)
        assert find_licences(whole.replace("\n", "\r\n"))[0][0][0] == name


def test_one_after_another():
    text = "\n\n".join(HEADERS.values())
    assert [x[0] for x in find_licences(text)[0]] == list(HEADERS)


def test_lines_without_stops_stay_apart():
    text = "Copyright Someone\nReleased under the MIT license\nSPDX-License-Identifier: MIT\nsome other words\nCopyright 2020 A Inc. Licensed under the Apache License, Version 2.0; more words follow"
    assert [x[0] for x in find_licences(text)[0]] == ["MIT", "SPDX:mit", "Apache-2.0"]
    assert find_licences("Copyright 2020 A\nA license of our own applies")[1:] == (1, 1)
