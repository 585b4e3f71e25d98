"""License scans by sentence rules: normalised sentences map to identifiers, and identifier sequences to licences.

A document's sentences are normalised (case, comment marks, spelling, quotes, spaces) and looked up among known licence sentences, however
they are wrapped over lines; a sentence may carry parameters such as a version. The sequence of identifiers is then matched against ordered rules, the
longest and most specific first; what a rule has matched is taken out before the next is tried.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import LOWER, slices, utf8

#: Only texts with one of these are cut into sentences.
HINT = re.compile(rb"licen[sc]|copyright|warrant|redistribut|permission|public domain|unencumbered|\bspdx\b")

#: Known sentences, as patterns of normalised sentences, and their identifiers.
SENTENCES = [
    ("SPDX", r"spdx-license-identifier:? (?P<spdx>[a-z0-9.+-]+)"),
    ("CCBY", r"(this (work|document|text|page) is )?licensed under (the )?(cc|creative commons) (?P<cc>by(-nc)?(-nd|-sa)?|zero|0) ?(license )?(version )?(?P<ccv>\d\.\d)?( (international|unported))?( license)?"),
    ("CCLONG", r"this work is licensed under (a|the) creative commons (?P<ccl>attribution[a-z\s-]*?) (?P<cclv>\d\.\d)( [a-z]+)? license"),
    ("PUBDOM", r"this (work|file|software|is free and unencumbered software) (is|has been)? ?(released|placed|dedicated)? ?(in|into|to) the public domain"),
    ("APACHEREF", r"((this work|this file|this software) is )?(licensed|released|distributed) under the apache license, version (?P<av>\d(\.\d)?)( \(the license\))?"),
    ("APACHEUSE", r"you may not use this file except in compliance with the license"),
    ("APACHECOPY", r"you may obtain a copy of the license at .*"),
    ("APACHEDIST", r"unless required by applicable law or agreed to in writing, software distributed under the license is distributed on an as is basis, without warranties or conditions of any kind, either express or implied"),
    ("APACHESEE", r"see the license for the specific language governing permissions and limitations under the license"),
    ("MITREF", r"((this work|this file|this software) is )?(licensed|released|distributed) under the (terms of the )?mit license"),
    ("MITPERM", r"permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files \(the software\), to deal in the software without restriction.*"),
    ("MITNOTICE", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("ASIS", r"(the|this) software is provided as is, without warranty of any kind, express or implied.*"),
    ("NOLIAB", r"in no event shall .* be liable for any .*"),
    ("OBSDPERM", r"permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("ISCPERM", r"permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.*"),
    ("ISCASIS", r"the software is provided as is and the author disclaims all warranties.*"),
    ("BSDREF", r"((this work|this file|this software) is )?(licensed|released|distributed) under the (?P<bsd>[23])-clause bsd license"),
    ("BSDPRE", r"redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:?.*"),
    ("BSDSRC", r"(1. )?redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    ("BSDBIN", r"(2. )?redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"),
    ("BSDAD", r"(3. )?all advertising materials mentioning features or use of this software must display the following acknowledgement:? this product includes software developed by .*"),
    ("BSDEND", r"([34]. )?neither the name .* may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("BSDASIS", r"this software is provided by .* as is and any express or implied warranties.* are disclaimed"),
    ("GPLREF", r"((this (work|file|software|program)) is )?(licensed|released|distributed) under the gnu (?P<g>lesser |library |affero )?general public license,? (version )?v?(?P<gv>\d(\.\d)?)(?P<gp> or later)?"),
    ("GPLFREE", r"(this program|this library|this file|.{1,60}) is free software[:;] you can redistribute it and/or modify it under the terms of the gnu (?P<gf>lesser |library |affero )?general public license as published by the free software foundation[,;] (either version (?P<gfv>\d(\.\d)?) of the license, or \(at your option\) any later version|version (?P<gfo>\d(\.\d)?) of the license)"),
    ("GPLHOPE", r"(this program|this library|.{1,60}) is distributed in the hope that it will be useful, but without any warranty.*"),
    ("GPLSEE", r"see the gnu (lesser |library |affero )?general public license for more details"),
    ("GPLCOPY", r"you should have received a copy of the gnu (lesser |library |affero )?general public license along with .*"),
    ("MPLREF", r"this source code form is subject to the terms of the mozilla public license, (v\. ?|version )(?P<mv>\d\.\d)"),
    ("MPLCOPY", r"if a copy of the mpl was not distributed with this file, you can obtain one at .*"),
    ("UNLANY", r"anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or noncommercial, and by any means"),
    ("ZLIBASIS", r"this software is provided as-is, without any express or implied warranty"),
    ("ZLIBLIAB", r"in no event will the authors? be held liable for any damages arising from the use of this software"),
    ("ZLIBPERM", r"permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:?"),
    ("BOOSTREF", r"((this work|this file|this software) is )?(licensed|released|distributed) under the boost software license, version (?P<bv>\d\.\d)"),
    ("BOOSTPERM", r"permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license \(the software\) to use, reproduce, display, distribute, execute, and transmit the software.*"),
    ("WTFPL", r"(0. )?you just do what the fuck you want to"),
    ("EPLREF", r"this program and the accompanying materials are made available under the terms of the eclipse public license,? (v\. ?|version )?(?P<ev>\d\.\d).*"),
    ("CDDLREF", r"the contents of this file are subject to the terms of the common development and distribution license.*"),
    ("GFDLREF", r"permission is granted to copy, distribute and/or modify this document under the terms of the gnu free documentation license, version (?P<fv>\d\.\d).*"),
    ("OFLREF", r"this font software is licensed under the sil open font license, version (?P<ov>\d\.\d)"),
    ("ARTREF", r"((this work|this file|this software) is )?(licensed|released|distributed) under the (terms of the )?artistic license,? (version )?(?P<arv>\d\.\d)"),
    ("CC0WAIVE", r"to the extent possible under law, .* waived all copyright and related or neighboring rights to .*"),
    ("COPYRIGHT", r"copyright (\(c\) |© )?.*\d{4}.*"),
    ("RIGHTS", r"all rights reserved"),
]
#: In a sentence of joined lines, words are parted by a space or, at a line's end, by a mark; a known sentence ends before such a mark.
BREAK = "\x1f"
_KNOWN = [(name, re.compile(rf"(?:{pattern.replace('.*', '.*?').replace(' ', chr(92) + 's')})[ .;!*/]*(?={BREAK}|\Z)")) for name, pattern in SENTENCES]
#: Known sentences that hold any words at all, and those that go on with any words.
_WILD, _OPEN = {name for name, p in SENTENCES if ".*" in p or ".{" in p}, {name for name, p in SENTENCES if p.endswith(".*")}

#: Ordered rules, identifiers in sequence and the licence; braces take a sentence's parameters.
RULES = [
    (("BSDPRE", "BSDSRC", "BSDBIN", "BSDAD", "BSDEND", "BSDASIS", "NOLIAB"), "BSD-4-Clause"),
    (("BSDPRE", "BSDSRC", "BSDBIN", "BSDAD", "BSDEND", "BSDASIS"), "BSD-4-Clause"),
    (("BSDPRE", "BSDSRC", "BSDBIN", "BSDEND", "BSDASIS", "NOLIAB"), "BSD-3-Clause"),
    (("BSDPRE", "BSDSRC", "BSDBIN", "BSDEND", "BSDASIS"), "BSD-3-Clause"),
    (("BSDPRE", "BSDSRC", "BSDBIN", "BSDASIS", "NOLIAB"), "BSD-2-Clause"),
    (("BSDPRE", "BSDSRC", "BSDBIN", "BSDASIS"), "BSD-2-Clause"),
    (("APACHEREF", "APACHEUSE", "APACHECOPY", "APACHEDIST", "APACHESEE"), "Apache-{av}"),
    (("APACHEREF", "APACHEUSE", "APACHECOPY"), "Apache-{av}"),
    (("GPLFREE", "GPLHOPE", "GPLSEE", "GPLCOPY"), "{gf}GPL-{gfv}{gfo}"),
    (("GPLFREE", "GPLHOPE", "GPLSEE"), "{gf}GPL-{gfv}{gfo}"),
    (("MITPERM", "MITNOTICE", "ASIS", "NOLIAB"), "MIT"),
    (("MITPERM", "MITNOTICE", "ASIS"), "MIT"),
    (("ISCPERM", "ISCASIS", "NOLIAB"), "ISC"),
    (("ISCPERM", "ISCASIS"), "ISC"),
    (("OBSDPERM", "ISCASIS", "NOLIAB"), "0BSD"),
    (("OBSDPERM", "ISCASIS"), "0BSD"),
    (("ZLIBASIS", "ZLIBLIAB", "ZLIBPERM"), "Zlib"),
    (("PUBDOM", "UNLANY"), "Unlicense"),
    (("MPLREF", "MPLCOPY"), "MPL-{mv}"),
    (("GPLFREE",), "{gf}GPL-{gfv}{gfo}"),
    (("APACHEREF",), "Apache-{av}"),
    (("MPLREF",), "MPL-{mv}"),
    (("GPLREF",), "{g}GPL-{gv}{gp}"),
    (("BSDREF",), "BSD-{bsd}-Clause"),
    (("MITREF",), "MIT"),
    (("CCBY",), "CC-{cc}-{ccv}"),
    (("CCLONG",), "CC-{ccl}-{cclv}"),
    (("BOOSTREF",), "BSL-{bv}"),
    (("BOOSTPERM",), "BSL-1.0"),
    (("WTFPL",), "WTFPL"),
    (("EPLREF",), "EPL-{ev}"),
    (("CDDLREF",), "CDDL-1.0"),
    (("GFDLREF",), "GFDL-{fv}"),
    (("OFLREF",), "OFL-{ov}"),
    (("ARTREF",), "Artistic-{arv}"),
    (("CC0WAIVE",), "CC0-1.0"),
    (("PUBDOM",), "Public-Domain"),
    (("SPDX",), "SPDX:{spdx}"),
]
#: Sentences that stand beside licences without naming one.
NEUTRAL = {"COPYRIGHT", "RIGHTS"}
_GPL = {"lesser ": "L", "library ": "L", "affero ": "A"}
_CC = {"attribution": "BY", "noncommercial": "NC", "sharealike": "SA", "noderivatives": "ND", "noderivs": "ND"}

_OPEN -= NEUTRAL
_COMMENT = re.compile(r"\s*(?:(?://+!?|/?\*+/?|#+|;+|--+|%+|>+|<!--+|dnl\b|rem\b)\s*)*", re.I)
_LIST = re.compile(r"(?:\(?(?:\d{1,2}|[abd-h])[.)]|[-•–])\s+")
_CUT = re.compile(r"[.!?;](?=\s)")
_SHORT = re.compile(r"\b(?:[a-z]|vs|ver|vol|no|cf|inc|ltd|corp|co|llc|dr|mrs?|ms|st)\.$", re.I)
_ADDRESS = re.compile(r"<?(?:https?://|www\.)")
_VERSION_BEFORE = re.compile(r"\bv(?:ersion|\.)?$")
_SPACE = re.compile(r"\s+")
_VERSION = re.compile(rf"\b(?:version[ {BREAK}])?v\.?[ {BREAK}]?(?=\d)")


@dataclass
class Piece:
    """A line, or a part of one up to a mark, of a sentence: its span and normalised text."""

    start: int
    end: int
    plain: str


def normalise(piece: str) -> str:
    s = piece.lower().replace("licence", "license").replace("’", "'")
    s = re.sub(r"[\"'`“”„«»]", "", s).replace("non-commercial", "noncommercial")
    s = re.sub(r"\s[*#|/]+\s*$", "", s)  # a box's right side
    return _SPACE.sub(" ", s).strip().lstrip(" .;!*/")


def sentences(text: str) -> list[list[Piece]]:
    """The sentences, each as its pieces.

    A sentence ends at a mark before white space, unless that stands after an abbreviation, at a blank line (one of comment marks alone
    too) without an address after it, and before a list's item. Inside it, pieces end at line feeds, semicolons and abbreviations.
    """
    out, own, blank = [], [], False
    for line in re.finditer(r"[^\n]*\n?", text):
        start, end = line.span()
        at = _COMMENT.match(text, start, end).end()
        if not re.search(r"\w", text[at:end]):
            blank = True
            continue
        if item := _LIST.match(text, at, end):
            at = item.end()
        if own and ((blank and not _ADDRESS.match(text, at, end)) or (item and not _VERSION_BEFORE.search(own[-1].plain))):
            out.append(own)
            own = []
        blank = False
        for cut in [*(m.end() for m in _CUT.finditer(text, at, end)), end]:
            if plain := normalise(text[at:cut]):
                own.append(Piece(start, cut, plain))
            if own and text[cut - 1] in ".!?" and not _SHORT.search(text, max(at, cut - 8), cut):
                out.append(own)
                own = []
            start, at = cut, _COMMENT.match(text, cut, end).end()
    return [*out, own] if own else out


def identify(joined: str, begins: list[int]) -> list[tuple[str, dict[str, str], int] | None]:
    """For each piece of a joined sentence the known one that begins there: identifier, parameters, and its last piece."""
    found = []
    for at in begins:
        hits = ((name, m) for name, pattern in _KNOWN if (m := pattern.match(joined, at)))
        name, m = next(hits, (None, None))
        found.append(m and (name, {k: v.replace(BREAK, " ") for k, v in m.groupdict().items() if v}, bisect_left(begins, m.end()) - 1))
    return found


def licence_name(template: str, values: dict[str, str]) -> str:
    def value(m: re.Match) -> str:
        key, v = m[1], values.get(m[1], "")
        if key in ("g", "gf"):
            return _GPL.get(v, "")
        if key in ("av", "gv", "mv") and v:
            return v if "." in v else f"{v}.0"
        if key == "gfv" and v:
            return (v if "." in v else f"{v}.0") + "-or-later"
        if key == "gfo" and v:
            return (v if "." in v else f"{v}.0") + "-only"
        if key == "gp":
            return "-or-later" if v else ""
        if key == "ccl":
            return "-".join(_CC[x] for x in re.split(r"[^a-z]+", v) if x in _CC)
        if key == "cc":
            return {"zero": "0", "0": "0"}.get(v, v.upper())
        return v

    return re.sub(r"\{(\w+)\}", value, template).rstrip("-")


def find_licences(text: str) -> tuple[list[tuple[str, int, int]], int, int]:
    """(licence, start, end) in the text's order, how many sentences are known, and how many speak of licences but are not."""
    known, unknown = [], 0
    for pieces in sentences(text):
        joined = _VERSION.sub(lambda m: "version" + (BREAK * m[0].count(BREAK) or " "), BREAK.join(p.plain for p in pieces))
        begins = [0, *(m.end() for m in re.finditer(BREAK, joined))]
        found, left, i = identify(joined, begins), [], 0
        while i <= len(pieces):
            here = found[i] if i < len(pieces) else None
            if here and here[0] in _WILD and any(found[k] and found[k][2] <= here[2] for k in range(i + 1, here[2] + 1)):
                here = None  # any words would take in another known sentence
            if here or i == len(pieces):
                unknown += bool(HINT.search(" ".join(left).encode()))
                left = []
            elif i < len(pieces):
                left.append(pieces[i].plain)
            if here:
                last = here[2]
                while here[0] in _OPEN and last + 1 < len(pieces) and not found[last + 1]:
                    last += 1
                known.append((here[0], here[1], pieces[i].start, pieces[last].end))
                i = last
            i += 1
    n = len(known)
    sequence, licences = [k for k in known if k[0] not in NEUTRAL], []
    for ids, template in RULES:
        at = 0
        while at + len(ids) <= len(sequence):
            part = sequence[at : at + len(ids)]
            if None not in part and tuple(p[0] for p in part) == ids:
                licences.append((licence_name(template, {k: v for p in part for k, v in p[1].items()}), part[0][2], part[-1][3]))
                sequence[at : at + len(ids)] = [None]  # the gap keeps its neighbours apart
            at += 1
    unknown += sum(s is not None for s in sequence)
    return sorted(licences, key=lambda x: x[1]), n, unknown


def scan_licences(docs: DataFrame) -> DataFrame:
    """(doc_id, licences array<struct<licence, start, end>>, n_known, n_unknown) of each row's whole text; spans count characters.

    n_unknown counts sentences that speak of licences or copyright but are not known, or known ones that no rule takes. Null and empty
    texts have none. Repeated rows are scanned each; extra columns are ignored; an empty table gives an empty one.
    """
    kind = pa.list_(pa.struct([("licence", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                data, offsets = utf8(part.column("text"))
                hits = np.fromiter((m.start() for m in HINT.finditer(LOWER[data].tobytes())), np.int64)
                found = [([], 0, 0)] * part.num_rows
                for row in np.unique(np.searchsorted(offsets, hits, "right") - 1).tolist():
                    found[row] = find_licences(part.column("text")[row].as_py())
                lists = [[{"licence": a, "start": s, "end": e} for a, s, e in x[0]] for x in found]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(lists, kind), pa.array([x[1] for x in found], pa.int64()), pa.array([x[2] for x in found], pa.int64())], ["doc_id", "licences", "n_known", "n_unknown"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, licences array<struct<licence:string,start:long,end:long>>, n_known long, n_unknown long")
