"""More licences as they are written, and the rules against a plain matcher of sequences."""

import itertools
import random

import pytest

from tessera.llm.licenses import NEUTRAL, RULES, find_licences
from tests.llm.test_whole_licences import BSD, HEADERS, ISC, MARKS, written

AD = "3. All advertising materials mentioning features or use of this software\n   must display the following acknowledgement: This product includes software\n   developed by Someone.\n4. Neither the name of the copyright holder nor the names of its\n   contributors may be used to endorse or promote products derived from\n   this software without specific prior written permission.\n"
MORE = {
    "Unlicense": "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or\ndistribute this software, either in source code form or as a compiled\nbinary, for any purpose, commercial or non-commercial, and by any\nmeans.",
    "Zlib": "This software is provided 'as-is', without any express or implied\nwarranty. In no event will the authors be held liable for any damages\narising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose,\nincluding commercial applications, and to alter it and redistribute it\nfreely, subject to the following restrictions:",
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0.", "0BSD": ISC.replace(", provided that the above\ncopyright notice and this permission notice appear in all copies", ""), "BSD-4-Clause": BSD.format(third=AD),
    "WTFPL": "0. You just DO WHAT THE FUCK YOU WANT TO.", "EPL-2.0": "This program and the accompanying materials are made available under the\nterms of the Eclipse Public License 2.0 which is available at\nhttps://www.eclipse.org/legal/epl-2.0", "CDDL-1.0": "The contents of this file are subject to the terms of the\nCommon Development and Distribution License (the \"License\").",
    "GFDL-1.3": "Permission is granted to copy, distribute and/or modify this document\nunder the terms of the GNU Free Documentation License, Version 1.3\nor any later version published by the Free Software Foundation.", "OFL-1.1": "This Font Software is licensed under the SIL Open Font License, Version 1.1.",
    "Artistic-2.0": "This software is licensed under the Artistic License 2.0.", "CC0-1.0": "To the extent possible under law, Someone has waived all copyright and\nrelated or neighboring rights to this work.",
}


@pytest.mark.parametrize("marks", MARKS)
def test_more_licences(marks):
    for name, text in MORE.items():
        assert [x[0] for x in find_licences(written(text, marks))[0]] == [name], (name, marks)


def matched(sequence):
    """The rules' identifiers taken from a sequence by trying every rule at every place, in order, with a list of what is left."""
    left, found = list(sequence), []
    for ids, _ in RULES:
        for at in range(len(left)):
            if tuple(left[at : at + len(ids)]) == ids:
                found.append((at, ids))
                left[at : at + len(ids)] = [object() for _ in ids]
    return [ids for _, ids in sorted(found, key=lambda x: x[0])]


def test_sequences_of_whole_licences_by_brute_force():
    """Licences in any order, parted by other words: each is found where the plain matcher finds it."""
    texts = {**HEADERS, **{k: v for k, v in MORE.items() if k not in ("0BSD",)}}
    names, rng = list(texts), random.Random(7)
    for _ in range(30):
        chosen = rng.sample(names, 4)
        assert [x[0] for x in find_licences("\n\n".join(texts[c] for c in chosen))[0]] == chosen
    for ids, _ in itertools.islice(RULES, 12):
        doubled = [*ids, *ids]
        assert matched(doubled)[:1] == [ids] and not set(ids) & NEUTRAL
