"""License scans by ordered signature rules.

Signatures are regexes over the text's words (lower case, ASCII punctuation dropped, one space
between), each with a label, a priority and a keyword gate. Some spell sentences of license bodies; the others are
built from a table of licenses (names as regexes, versions, identifier) and a table of wordings. One Aho-Corasick pass
finds which keywords a text has; a regex is tried only where all keywords of one of its alternatives are there.
Where detections overlap, one whose words lie within those of a detection of higher priority (or of equal priority and
greater length) is suppressed; an index of the kept intervals by start answers that in logarithmic time. Base
phrases are always reported, whatever the rules say.

Score: the chance that some kept detection is right, 1 - prod(1 - priority / 100); 0 without any.

Edge cases: a null text is empty; a text without words has nothing; very long and repetitive texts take time in
proportion to their length, but for a logarithm; of two equal detections (same words, priority and length) the label
first in the alphabet stays; null ids, repeated rows and further columns pass.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import words as W

#: The base phrases and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: label -> (names, versions or "", identifier words)
LICENSES: dict[str, tuple[str, str, str]] = {
    "gpl": (r"gnu general public licen[sc]e|gnu gpl|gpl", r"[123](?: 0)?", r"gpl [123] 0(?: only| or later)?"),
    "lgpl": (r"gnu (?:lesser|library) general public licen[sc]e|gnu lgpl|lgpl", r"[23](?: [01])?", r"lgpl [23] [01](?: only| or later)?"),
    "agpl": (r"gnu affero general public licen[sc]e|affero general public licen[sc]e|gnu agpl|agpl", r"[13](?: 0)?", r"agpl [13] 0(?: only| or later)?"),
    "gfdl": (r"gnu free documentation licen[sc]e|gfdl", r"1 [123]", r"gfdl 1 [123](?: only| or later)?"),
    "apache": (r"apache(?: software)? licen[sc]e|asl", r"(?:1 [01]|2(?: 0)?)", r"apache (?:1 [01]|2 0)"),
    "mit": (r"mit(?: expat| x11)? licen[sc]e|expat licen[sc]e", r"", r"mit(?: 0)?"),
    "bsd-2-clause": (r"(?:simplified|freebsd|2 clause) bsd licen[sc]e|bsd 2 clause(?: licen[sc]e)?", r"", r"bsd 2 clause"),
    "bsd-3-clause": (r"(?:new|revised|modified|3 clause) bsd licen[sc]e|bsd 3 clause(?: licen[sc]e)?", r"", r"bsd 3 clause"),
    "bsd-4-clause": (r"(?:original|4 clause) bsd licen[sc]e|bsd 4 clause(?: licen[sc]e)?", r"", r"bsd 4 clause"),
    "bsd": (r"bsd licen[sc]e|berkeley software distribution licen[sc]e", r"", r"0bsd"),
    "mpl": (r"mozilla public licen[sc]e|mpl", r"(?:1 [01]|2 0)", r"mpl (?:1 [01]|2 0)"),
    "epl": (r"eclipse public licen[sc]e|epl", r"[12] 0", r"epl [12] 0"),
    "edl": (r"eclipse distribution licen[sc]e", r"1 0", r"bsd 3 clause eclipse"),
    "cddl": (r"common development and distribution licen[sc]e|cddl", r"1 [01]", r"cddl 1 [01]"),
    "cpl": (r"common public licen[sc]e", r"1 0", r"cpl 1 0"),
    "isc": (r"isc licen[sc]e", r"", r"isc"),
    "zlib": (r"zlib(?: libpng)? licen[sc]e", r"", r"zlib"),
    "libpng": (r"libpng licen[sc]e", r"2 0", r"libpng 2 0"),
    "boost": (r"boost software licen[sc]e|boost licen[sc]e", r"1 0", r"bsl 1 0"),
    "unlicense": (r"the unlicen[sc]e", r"", r"unlicense"),
    "wtfpl": (r"do what the fuck you want to public licen[sc]e|wtfpl", r"2", r"wtfpl"),
    "artistic": (r"artistic licen[sc]e", r"(?:1 0|2 0)", r"artistic (?:1 0|2 0)(?: perl| cl8)?"),
    "perl": (r"same terms as perl(?: itself)?", r"", r"perl 5"),
    "python": (r"python software foundation licen[sc]e|psf licen[sc]e|python licen[sc]e", r"2(?: 0)?", r"(?:psf|python) 2 0"),
    "php": (r"php licen[sc]e", r"3(?: 0[01]?)?", r"php 3 0[01]?"),
    "ruby": (r"ruby licen[sc]e", r"", r"ruby"),
    "openssl": (r"openssl licen[sc]e", r"", r"openssl"),
    "ssleay": (r"ssleay licen[sc]e", r"", r"ssleay"),
    "ms-pl": (r"microsoft public licen[sc]e|ms pl", r"", r"ms pl"),
    "ms-rl": (r"microsoft reciprocal licen[sc]e|ms rl", r"", r"ms rl"),
    "eupl": (r"european union public licen[sc]e|eupl", r"1 [012]", r"eupl 1 [012]"),
    "cecill": (r"cecill(?: [bc])?(?: free software)? licen[sc]e", r"[12](?: [01])?", r"cecill (?:[bc]|[12] [01])"),
    "osl": (r"open software licen[sc]e", r"[123] 0", r"osl [123] 0"),
    "afl": (r"academic free licen[sc]e", r"[123] [01]", r"afl [123] [01]"),
    "upl": (r"universal permissive licen[sc]e", r"1 0", r"upl 1 0"),
    "ncsa": (r"(?:university of illinois )?ncsa(?: open source)? licen[sc]e", r"", r"ncsa"),
    "w3c": (r"w3c software(?: notice and)? licen[sc]e", r"", r"w3c"),
    "ofl": (r"sil open font licen[sc]e|open font licen[sc]e", r"1 [01]", r"ofl 1 [01]"),
    "postgresql": (r"postgresql licen[sc]e", r"", r"postgresql"),
    "vim": (r"vim licen[sc]e", r"", r"vim"),
    "tcl": (r"tcl(?: tk)? licen[sc]e", r"", r"tcl"),
    "curl": (r"curl licen[sc]e", r"", r"curl"),
    "ijg": (r"independent jpeg group licen[sc]e", r"", r"ijg"),
    "ftl": (r"freetype(?: project)? licen[sc]e", r"", r"ftl"),
    "unicode": (r"unicode(?: terms of use)? licen[sc]e", r"", r"unicode dfs 201[56]"),
    "icu": (r"icu licen[sc]e", r"", r"icu"),
    "json": (r"json licen[sc]e", r"", r"json"),
    "beerware": (r"beer ?ware licen[sc]e", r"42", r"beerware"),
    "qpl": (r"q public licen[sc]e", r"1 0", r"qpl 1 0"),
    "sleepycat": (r"sleepycat licen[sc]e", r"", r"sleepycat"),
    "sspl": (r"server side public licen[sc]e|sspl", r"1(?: 0)?", r"sspl 1 0"),
    "busl": (r"business source licen[sc]e", r"1 1", r"busl 1 1"),
    "elastic": (r"elastic licen[sc]e", r"2(?: 0)?", r"elastic 2 0"),
    "odbl": (r"open database licen[sc]e|odbl", r"1 0", r"odbl 1 0"),
    "odc-by": (r"open data commons attribution licen[sc]e", r"1 0", r"odc by 1 0"),
    "pddl": (r"public domain dedication and licen[sc]e", r"1 0", r"pddl 1 0"),
    "cc0": (r"cc0|creative commons zero(?: licen[sc]e)?", r"1 0", r"cc0 1 0"),
    "cc-by": (r"cc by|creative commons attribution(?: licen[sc]e)?", r"[1-4] [05]", r"cc by [1-4] [05]"),
    "cc-by-sa": (r"cc by sa|creative commons attribution share ?alike(?: licen[sc]e)?", r"[1-4] [05]", r"cc by sa [1-4] [05]"),
    "cc-by-nd": (r"cc by nd|creative commons attribution no ?deriv(?:ative)?s(?: licen[sc]e)?", r"[1-4] [05]", r"cc by nd [1-4] [05]"),
    "cc-by-nc": (r"cc by nc|creative commons attribution non ?commercial(?: licen[sc]e)?", r"[1-4] [05]", r"cc by nc [1-4] [05]"),
    "cc-by-nc-sa": (r"cc by nc sa|creative commons attribution non ?commercial share ?alike(?: licen[sc]e)?", r"[1-4] [05]", r"cc by nc sa [1-4] [05]"),
    "cc-by-nc-nd": (r"cc by nc nd|creative commons attribution non ?commercial no ?deriv(?:ative)?s(?: licen[sc]e)?", r"[1-4] [05]", r"cc by nc nd [1-4] [05]"),
    "public-domain": (r"public domain", r"", r"public domain"),
    "proprietary": (r"all rights reserved|proprietary and confidential", r"", r"proprietary"),
}

#: (regex around {name}, {version}, {spdx}; priority)
WORDINGS: list[tuple[str, int]] = [
    (r"spdx licen[sc]e identifier {spdx}", 98),
    (r"licen[sc]ed(?: to you)? under (?:the )?(?:terms of (?:the )?)?(?:{name}){version}", 95),
    (r"(?:released|distributed|available|published|provided|redistribute it(?: and or modify it)?) under (?:the )?(?:terms of (?:the )?)?(?:{name}){version}", 90),
    (r"(?:subject|according) to (?:the )?(?:terms (?:and conditions )?of (?:the )?)?(?:{name}){version}", 85),
    (r"(?:see|read) (?:the )?(?:file )?(?:{name}){version}(?: for (?:more )?details)?", 70),
    (r"(?:{name}){version}", 60),
]

#: (label, sentence of the license's body or its usual notice as a regex, priority)
BODIES: list[tuple[str, str, int]] = [
    ("mit", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", 94),
    ("mit", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", 92),
    ("mit", r"to deal in the software without restriction including without limitation the rights to use copy modify merge publish", 93),
    ("x11", r"except as contained in this notice the name of (?:[^ ]+ ){1,6}shall not be used in advertising or otherwise to promote", 95),
    ("isc", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", 94),
    ("bsd", r"redistribution and use in source and binary forms with or without modification are permitted", 88),
    ("bsd", r"redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", 86),
    ("bsd", r"redistributions in binary form must reproduce the above copyright notice this list of conditions", 86),
    ("bsd", r"this software is provided by the (?:copyright holders?|author|regents)(?: and contributors)? as is and any express or implied warranties", 84),
    ("bsd-3-clause", r"neither the names? of (?:[^ ]+ ){1,8}nor the names of (?:its|their|the) contributors may be used to endorse or promote products derived from this software", 95),
    ("bsd-4-clause", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment", 96),
    ("0bsd", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is", 96),
    ("apache", r"you may not use this file except in compliance with the licen[sc]e you may obtain a copy of the licen[sc]e at", 93),
    ("apache", r"each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright licen[sc]e", 95),
    ("apache", r"unless required by applicable law or agreed to in writing software distributed under the licen[sc]e is distributed on an as is basis", 92),
    ("gpl", r"you can redistribute it and or modify it under the terms of the gnu general public licen[sc]e", 96),
    ("gpl", r"the gnu general public licen[sc]e is a free copyleft licen[sc]e for software and other kinds of works", 97),
    ("gpl", r"the licen[sc]es for most software are designed to take away your freedom to share and change it", 95),
    ("gpl", r"you should have received a copy of the gnu general public licen[sc]e along with this program", 94),
    ("lgpl", r"you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public licen[sc]e", 97),
    ("lgpl", r"you should have received a copy of the gnu (?:lesser|library) general public licen[sc]e along with this", 95),
    ("agpl", r"you can redistribute it and or modify it under the terms of the gnu affero general public licen[sc]e", 97),
    ("agpl", r"specifically designed to ensure cooperation with the community in the case of network server software", 96),
    ("gfdl", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[sc]e", 97),
    ("mpl", r"this source code form is subject to the terms of the mozilla public licen[sc]e", 97),
    ("mpl", r"the contents of this file are subject to the mozilla public licen[sc]e", 96),
    ("mpl", r"if a copy of the mpl was not distributed with this file you can obtain one at", 95),
    ("epl", r"this program and the accompanying materials are made available under the terms of the eclipse public licen[sc]e", 97),
    ("epl", r"the accompanying program is provided under the terms of this eclipse public licen[sc]e", 97),
    ("cpl", r"the accompanying program is provided under the terms of this common public licen[sc]e", 97),
    ("cddl", r"the contents of this file are subject to the terms of the common development and distribution licen[sc]e", 97),
    ("zlib", r"this software is provided as is without any express or implied warranty in no event will the authors be held liable", 91),
    ("zlib", r"altered source versions must be plainly marked as such and must not be misrepresented as being the original software", 94),
    ("zlib", r"the origin of this software must not be misrepresented you must not claim that you wrote the original software", 94),
    ("boost", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation", 96),
    ("unlicense", r"this is free and unencumbered software released into the public domain", 97),
    ("unlicense", r"anyone is free to copy modify publish use compile sell or distribute this software", 95),
    ("wtfpl", r"everyone is permitted to copy and distribute verbatim or modified copies of this licen[sc]e document and changing it is allowed", 93),
    ("wtfpl", r"you just do what the fuck you want to", 94),
    ("cc0", r"to the extent possible under law (?:[^ ]+ ){1,10}has waived all copyright and related or neighboring rights", 96),
    ("cc0", r"the person who associated a work with this deed has dedicated the work to the public domain", 95),
    ("cc-by", r"you are free to share copy and redistribute the material in any medium or format", 80),
    ("cc-by", r"you must give appropriate credit provide a link to the licen[sc]e and indicate if changes were made", 85),
    ("cc-by-sa", r"if you remix transform or build upon the material you must distribute your contributions under the same licen[sc]e as the original", 94),
    ("cc-by-nc", r"you may not use the material for commercial purposes", 90),
    ("cc-by-nd", r"if you remix transform or build upon the material you may not distribute the modified material", 94),
    ("artistic", r"the intent of this document is to state the conditions under which a package may be copied", 95),
    ("artistic", r"everyone is permitted to copy and distribute verbatim copies of this licen[sc]e document but changing it is not allowed this licen[sc]e establishes the terms", 95),
    ("ncsa", r"to deal with the software without restriction including without limitation the rights to use", 94),
    ("postgresql", r"permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted", 95),
    ("openssl", r"this product includes software developed by the openssl project for use in the openssl toolkit", 96),
    ("ssleay", r"this product includes cryptographic software written by eric young", 95),
    ("ofl", r"the goals of the open font licen[sc]e (?:ofl )?are to stimulate worldwide development of collaborative font projects", 97),
    ("ofl", r"this font software is licen[sc]ed under the sil open font licen[sc]e", 97),
    ("ms-pl", r"this licen[sc]e governs use of the accompanying software if you use the software you accept this licen[sc]e", 93),
    ("eupl", r"licen[sc]ed under the eupl version (?:[^ ]+ ){1,8}you may not use this work except in compliance with the licence", 97),
    ("osl", r"licen[sc]ed under the open software licen[sc]e version", 96),
    ("afl", r"licen[sc]ed under the academic free licen[sc]e version", 96),
    ("php", r"this product includes php software freely available from", 94),
    ("python", r"psf is making python available to licensee on an as is basis", 96),
    ("python", r"psf hereby grants licensee a nonexclusive royalty free world ?wide licen[sc]e", 96),
    ("w3c", r"permission to copy modify and distribute this work with or without modification for any purpose and without fee or royalty is hereby granted", 95),
    ("curl", r"permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice", 94),
    ("ijg", r"this software is based in part on the work of the independent jpeg group", 96),
    ("ftl", r"portions of this software are copyright (?:[^ ]+ ){1,6}the freetype project", 95),
    ("unicode", r"permission is hereby granted free of charge to any person obtaining a copy of the unicode data files and any associated documentation", 97),
    ("icu", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction provided that", 95),
    ("json", r"the software shall be used for good not evil", 97),
    ("beerware", r"if we meet some day and you think this stuff is worth it you can buy me a beer in return", 97),
    ("sspl", r"if you make the functionality of the program or a modified version available to third parties as a service", 95),
    ("busl", r"the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use", 96),
    ("elastic", r"you may not provide the software to third parties as a hosted or managed service", 95),
    ("odbl", r"this database is made available under the open database licen[sc]e", 97),
    ("public-domain", r"(?:has been|is hereby|is) (?:released|placed|dedicated) (?:in|into|to) the public domain", 85),
    ("public-domain", r"the authors? (?:hereby )?disclaims? copyright to this source code", 92),
    ("proprietary", r"unauthori[sz]ed (?:copying|reproduction|use)(?: or distribution)? of this (?:file|software|document|program)(?: via any medium)? is strictly prohibited", 90),
    ("proprietary", r"no part of this (?:publication|document|book|work) may be reproduced(?: stored in a retrieval system)?(?: distributed)? or transmitted in any form", 90),
    ("proprietary", r"this (?:document|software|file) contains (?:confidential and )?proprietary information", 88),
    ("no-license", r"all rights (?:are )?reserved no licen[sc]e is granted", 88),
]

_TABLE = bytes((c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32) for c in range(256))
_WORD = np.array([c != 32 for c in _TABLE])
#: words that are no keywords where there are others
_COMMON = frozenset("a all an and any are as at be by for if in is it its nd not of on or see that the this to under version with you".split())


def _keywords(pattern: str) -> frozenset[str]:
    """Leading letters of the words that every match of an alternative must have; the three longest."""
    plain = pattern
    while (shorter := re.sub(r"\((?:\?:)?[^()]*\)(?:\?|\{[^}]*\})?", " ", plain)) != plain:
        plain = shorter
    stems = [m[0] for w in plain.split() if (m := re.match(r"[a-z0-9]{2,}(?![?])|[a-z0-9]{2,}(?=[a-z0-9]\?)", re.sub(r"[a-z0-9]\?.*|\[.*", "", w))) is not None]
    rare = [x for x in stems if x not in _COMMON]
    return frozenset(sorted(rare or stems, key=lambda x: (-len(x), x))[:3])


def _alternatives(pattern: str) -> list[str]:
    depth, out = 0, [""]
    for c in pattern:
        depth += (c in "([") - (c in ")]")
        if c == "|" and not depth:
            out.append("")
        else:
            out[-1] += c
    return out


def signatures() -> list[tuple[str, int, list[frozenset[str]], re.Pattern]]:
    """(label, priority, gates, regex) of every rule; all keywords of some gate must be in a text."""
    out = []
    for label, (name, versions, spdx) in LICENSES.items():
        version = rf"(?:,? ?(?:version |v)?(?:{versions})(?: or (?:any )?(?:later|newer)(?: version)?)?)?" if versions else ""
        for wording, priority in WORDINGS:
            text = wording.replace("{spdx}", f"(?:{spdx})").replace("{name}", name).replace("{version}", version)
            lead = wording.split("(?:{name})")[0] if "{name}" in wording else "spdx"
            gates = [_keywords(f"{lead} {x}") | _keywords(x) for x in (_alternatives(name) if "{name}" in wording else [""])]
            out.append((label, priority, gates, re.compile(b" (?:" + text.encode() + b")(?= )")))
    for label, text, priority in BODIES:
        out.append((label, priority, [_keywords(text)], re.compile(b" (?:" + text.encode() + b")(?= )")))
    return sorted(out, key=lambda s: (-s[1], s[0]))


_state: dict = {}


def _rules():
    """Rules, and the automaton of their keywords and the base phrases' words, once a process."""
    if not _state:
        _state["rules"] = signatures()
        words = {k for _, _, gates, _ in _state["rules"] for g in gates for k in g} | {max(p.split(), key=lambda w: (w not in _COMMON, len(w))) for p in BASE}
        found = ahocorasick.Automaton()
        for w in sorted(words):
            found.add_word(" " + w, w)
        found.make_automaton()
        _state["keywords"] = found
    return _state["rules"], _state["keywords"]


class _Kept:
    """Intervals with distinct starts known beforehand; whether one contains another (a tree of greatest ends by start)."""

    def __init__(self, starts: list[int]):
        self.starts, self.ends = starts, [-1] * (len(starts) + 1)

    def covers(self, start: int, end: int) -> bool:
        i = bisect_left(self.starts, start) + 1
        while i > 0:
            if self.ends[i] >= end:
                return True
            i -= i & -i
        return False

    def add(self, start: int, end: int) -> None:
        i = bisect_left(self.starts, start) + 1
        while i < len(self.ends):
            self.ends[i] = max(self.ends[i], end)
            i += i & -i


def detections(norm: bytes, keywords: set[str] | frozenset[str]) -> list[tuple[int, int, int, str]]:
    """(start byte, end byte, priority, label) kept from words joined by spaces, a space on both sides."""
    found = set()
    for label, priority, gates, pattern in _rules()[0]:
        if any(g <= keywords for g in gates):
            found.update((m.start(), m.end(), priority, label) for m in pattern.finditer(norm))
    kept, index = [], _Kept(sorted({d[0] for d in found}))
    for d in sorted(found, key=lambda d: (-d[2], d[0] - d[1], d[0], d[3])):
        if not index.covers(d[0], d[1]):
            kept.append(d)
            index.add(d[0], d[1])
    return kept


def scan(raw: bytes, keywords: set[str] | frozenset[str] | None = None) -> tuple[list[int], set[str], set[str], float]:
    """Starts of base phrases, base labels, all labels, score. ``keywords`` are those that the text has, if known."""
    low = raw.translate(_TABLE)
    if keywords is None:
        keywords = {w for _, w in _rules()[1].iter(" " + low.decode("latin-1"))}
    norm = b" " + b" ".join(low.split()) + b" "
    hits, base = [], set()
    for phrase, label in BASE.items():
        needle, at = b" " + phrase.encode() + b" ", -1
        while (at := norm.find(needle, at + 1)) >= 0:
            hits.append(at)
            base.add(label)
    places, number, last = [], 0, 0
    for at in sorted(hits):
        number, last = number + norm.count(b" ", last, at), at
        places.append(number)
    kept = detections(norm, keywords)
    miss = 1.0
    for d in kept:
        miss *= 1 - d[2] / 100
    return places, base, base | {d[3] for d in kept}, 1 - miss


def _found(low: bytes, offs: np.ndarray) -> dict[int, set[str]]:
    """Keywords of the texts of a block that have any; one that starts with a text is looked for by itself."""
    out: dict[int, set[str]] = {}
    hits = list(_rules()[1].iter(low.decode("latin-1")))
    if hits:
        at = np.fromiter((i for i, _ in hits), np.int64, len(hits))
        for doc, (_, w) in zip((np.searchsorted(offs, at, side="right") - 1).tolist(), hits, strict=True):
            out.setdefault(doc, set()).add(w)
    longest = max(map(len, _rules()[1].values()))
    for doc, (a, z) in enumerate(zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)):
        head = low[a : min(z, a + longest)]
        if head[:1] not in (b" ", b""):
            for i, w in _rules()[1].iter(" " + head.decode("latin-1")):
                if i == len(w):
                    out.setdefault(doc, set()).add(w)
    return out


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offs = W.buffers(batch.column(1))
        n = np.zeros(batch.num_rows, np.int64)
        cols: list[list] = [[] for _ in range(6)]
        for a, z in W.blocks(offs):
            own, o = data[offs[a] : offs[z]], offs[a : z + 1] - offs[a]
            if len(own):
                inside = _WORD[own]
                first = inside.copy()
                first[1:] &= ~inside[:-1]
                lead = o[:-1][o[1:] > o[:-1]]
                first[lead] = inside[lead]
                sums = np.zeros(len(own) + 1, np.int64)
                np.cumsum(first, out=sums[1:])
                n[a:z] = sums[o[1:]] - sums[o[:-1]]
            raw = own.tobytes()
            found = _found(raw.translate(_TABLE), o)
            for doc, (s, e) in enumerate(zip(o[:-1].tolist(), o[1:].tolist(), strict=True)):
                places, base, labels, score = scan(raw[s:e], found[doc]) if doc in found else ([], (), (), 0.0)
                for c, v in zip(cols, (len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score), strict=True):
                    c.append(v)
        kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.float64()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])


def licenses(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text")).mapInArrow(_scan, f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
