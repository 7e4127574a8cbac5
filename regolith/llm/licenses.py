"""License scans: ordered signature rules, gated by keywords, with suppression of overlapping detections.

A text is reduced to its words, A-Z lower-cased, joined by single spaces; the rules are regular expressions over
that. Each rule has keywords, one of which must occur before its expression is tried, and a priority: the text of a
license tells more than a notice, a notice more than a tag or an address, and these more than a mere name. Of
detections that lie within each other only the best is kept.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regolith.llm.common import table

#: The phrases that are always reported, with every place.
BASE = ((b"mit license", "mit"), (b"apache license", "apache"), (b"general public license", "gpl"))
#: Priorities, best first, and the relevance of a detection of each.
SIGNATURE, NOTICE, TAG, ADDRESS, NAME = range(5)
RELEVANCE = (1.0, 0.95, 0.9, 0.8, 0.6)
#: No expression matches more words.
SPAN = 1024

#: SPDX id of each license, and an expression for its name in words. Of a name's versions the more
#: exact come first; V stands for an optional word for "version".
NAMES = {
    "Apache-1.0": "apache (?:software )?license V1 0",
    "Apache-1.1": "apache (?:software )?license V1 1",
    "Apache-2.0": "apache (?:software )?license V2(?: 0)?",
    "AFL-2.1": "academic free license V2 1",
    "AFL-3.0": "academic free license V3(?: 0)?",
    "AGPL-1.0": "affero general public license V1(?: 0)?",
    "AGPL-3.0": "(?:gnu )?affero general public license V3(?: 0)?|agpl ?v?3(?: 0)?",
    "APSL-2.0": "apple public source license V2(?: 0)?",
    "Artistic-1.0": "artistic license V1(?: 0)?",
    "Artistic-2.0": "artistic license V2(?: 0)?",
    "0BSD": "zero clause bsd|bsd zero clause license|0bsd",
    "BSD-2-Clause": "(?:2|two) clause (?:simplified )?bsd(?: license)?|simplified bsd license|freebsd license|bsd 2 clause(?: license)?",
    "BSD-3-Clause": "(?:3|three) clause (?:new |revised )?bsd(?: license)?|(?:new|modified|revised) bsd license|bsd 3 clause(?: license)?",
    "BSD-4-Clause": "(?:4|four) clause bsd(?: license)?|original bsd license|bsd 4 clause(?: license)?",
    "BSD": "bsd (?:style )?licen[cs]e",
    "BSL-1.0": "boost software license(?: V1 0)?",
    "BUSL-1.1": "business source license(?: V1 1)?",
    "CC0-1.0": "(?:creative commons )?cc0(?: 1 0)?(?: universal)?|creative commons zero(?: V1 0)?",
    "CC-BY-1.0": "(?:creative commons attribution|cc by) V1 0",
    "CC-BY-2.0": "(?:creative commons attribution|cc by) V2 0",
    "CC-BY-2.5": "(?:creative commons attribution|cc by) V2 5",
    "CC-BY-3.0": "(?:creative commons attribution|cc by) V3 0",
    "CC-BY-4.0": "(?:creative commons attribution|cc by)(?: international)? V4 0(?: international)?",
    "CC-BY-SA-2.0": "(?:creative commons attribution share ?alike|cc by sa) V2 0",
    "CC-BY-SA-2.5": "(?:creative commons attribution share ?alike|cc by sa) V2 5",
    "CC-BY-SA-3.0": "(?:creative commons attribution share ?alike|cc by sa) V3 0",
    "CC-BY-SA-4.0": "(?:creative commons attribution share ?alike|cc by sa)(?: international)? V4 0",
    "CC-BY-NC-3.0": "(?:creative commons attribution non ?commercial|cc by nc) V3 0",
    "CC-BY-NC-4.0": "(?:creative commons attribution non ?commercial|cc by nc)(?: international)? V4 0",
    "CC-BY-ND-3.0": "(?:creative commons attribution no ?derivatives|cc by nd) V3 0",
    "CC-BY-ND-4.0": "(?:creative commons attribution no ?derivatives|cc by nd)(?: international)? V4 0",
    "CC-BY-NC-SA-3.0": "(?:creative commons attribution non ?commercial share ?alike|cc by nc sa) V3 0",
    "CC-BY-NC-SA-4.0": "(?:creative commons attribution non ?commercial share ?alike|cc by nc sa)(?: international)? V4 0",
    "CC-BY-NC-ND-3.0": "(?:creative commons attribution non ?commercial no ?derivatives|cc by nc nd) V3 0",
    "CC-BY-NC-ND-4.0": "(?:creative commons attribution non ?commercial no ?derivatives|cc by nc nd)(?: international)? V4 0",
    "CC-BY-SA": "creative commons attribution share ?alike(?: license)?|cc by sa",
    "CC-BY-NC": "creative commons attribution non ?commercial(?: license)?|cc by nc",
    "CC-BY": "creative commons attribution(?: license)?|cc by",
    "CC": "creative commons(?: license)?",
    "CDDL-1.0": "common development and distribution license V1 0|cddl V1 0",
    "CDDL-1.1": "common development and distribution license V1 1|cddl V1 1",
    "CECILL-2.1": "cecill(?: free software license)?(?: agreement)? V2 1",
    "CPL-1.0": "common public license(?: V1 0)?",
    "EPL-1.0": "eclipse public license V1 0|epl V1 0",
    "EPL-2.0": "eclipse public license V2 0|epl V2 0",
    "EUPL-1.1": "european union public licen[cs]e V1 1|eupl V1 1",
    "EUPL-1.2": "european union public licen[cs]e V1 2|eupl V1 2",
    "ECL-2.0": "educational community license V2 0",
    "EFL-2.0": "eiffel forum license V2",
    "Elastic-2.0": "elastic license V2(?: 0)?",
    "FTL": "freetype (?:project )?license",
    "GFDL-1.1": "gnu free documentation license V1 1",
    "GFDL-1.2": "gnu free documentation license V1 2",
    "GFDL-1.3": "gnu free documentation license V1 3",
    "GFDL": "gnu free documentation license",
    "GPL-1.0": "(?:gnu )?general public license V1(?: 0)?|gpl ?v1",
    "GPL-2.0": "(?:gnu )?general public license V2(?: 0)?|gpl ?v2(?: 0)?|gnu gpl 2(?: 0)?",
    "GPL-2.0-or-later": "(?:gnu )?general public license V2(?: 0)? or (?:at your option )?(?:any )?later|gpl ?v2 or later",
    "GPL-3.0": "(?:gnu )?general public license V3(?: 0)?|gpl ?v3(?: 0)?|gnu gpl 3(?: 0)?",
    "GPL-3.0-or-later": "(?:gnu )?general public license V3(?: 0)? or (?:any )?later|gpl ?v3 or later",
    "GPL": "gnu general public license|gnu gpl",
    "HPND": "historical permission notice and disclaimer",
    "ICU": "icu license",
    "IJG": "independent jpeg group(?: s)? license",
    "IPL-1.0": "ibm public license V1 0",
    "ISC": "isc license|internet systems consortium license",
    "JSON": "json license",
    "LGPL-2.0": "(?:gnu )?(?:library|lesser) general public license V2(?: 0)?|lgpl ?v?2(?: 0)?",
    "LGPL-2.1": "(?:gnu )?lesser general public license V2 1|lgpl ?v?2 1",
    "LGPL-3.0": "(?:gnu )?lesser general public license V3(?: 0)?|lgpl ?v?3(?: 0)?",
    "LGPL": "gnu (?:library|lesser) general public license|gnu lgpl",
    "Libpng": "libpng license",
    "LPL-1.02": "lucent public license V1 02",
    "LPPL-1.3c": "latex project public license(?: V1 3c?)?",
    "MirOS": "miros licen[cs]e",
    "MIT": "mit (?:style )?licen[cs]e|expat license|x11 license",
    "MIT-0": "mit no attribution(?: license)?",
    "MPL-1.0": "mozilla public license V1 0|mpl V1 0",
    "MPL-1.1": "mozilla public license V1 1|mpl V1 1",
    "MPL-2.0": "mozilla public license V2(?: 0)?|mpl V2 0",
    "MPL": "mozilla public license",
    "MS-PL": "microsoft public license",
    "MS-RL": "microsoft reciprocal license",
    "MulanPSL-2.0": "mulan permissive software license V2",
    "NASA-1.3": "nasa open source agreement(?: V1 3)?",
    "NCSA": "university of illinois ncsa open source license|ncsa open source license",
    "NPL-1.1": "netscape public license V1 1",
    "ODbL-1.0": "open data commons open database license|open database license",
    "ODC-By-1.0": "open data commons attribution license",
    "OFL-1.1": "sil open font license(?: V1 1)?",
    "OLDAP-2.8": "openldap public license(?: V2 8)?",
    "OpenSSL": "openssl license",
    "OSL-2.1": "open software license V2 1",
    "OSL-3.0": "open software license V3 0",
    "PDDL-1.0": "(?:open data commons )?public domain dedication and license",
    "PHP-3.01": "php license(?: V3 01)?",
    "PostgreSQL": "postgresql licen[cs]e",
    "PSF-2.0": "python software foundation license(?: V2)?",
    "Python-2.0": "python license V2(?: 0)?",
    "QPL-1.0": "q public license(?: V1 0)?",
    "RPL-1.5": "reciprocal public license V1 5",
    "RPSL-1.0": "realnetworks public source license V1 0",
    "Ruby": "ruby license",
    "SISSL": "sun industry standards source license",
    "SSPL-1.0": "server side public license",
    "Sleepycat": "sleepycat license",
    "SPL-1.0": "sun public license V1 0",
    "TCL": "tcl tk license",
    "Unicode-DFS-2016": "unicode (?:inc )?license agreement",
    "Unlicense": "the unlicense",
    "UPL-1.0": "universal permissive license(?: V1 0)?",
    "Vim": "vim license",
    "W3C": "w3c software (?:notice and )?license",
    "WTFPL": "do what the f\\w* you want to public license|wtfpl",
    "X11": "x consortium license",
    "Zlib": "zlib (?:libpng )?license",
    "ZPL-2.1": "zope public license V2 1",
}

#: Sentences of the licenses' own texts.
SIGNATURES = (
    ("MIT", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("MIT", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("MIT-0", "permission is hereby granted free of charge to any person obtaining a copy of this software.{0,400}?merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so the software is provided"),
    ("ISC", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice"),
    ("0BSD", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided"),
    ("BSD-4-Clause", "all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("BSD-3-Clause", "neither the name of .{1,120}? nor the names of its contributors may be used to endorse or promote products"),
    ("BSD-2-Clause", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("Apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("Apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("Apache-1.1", "the end user documentation included with the redistribution if any must include the following acknowledge?ment"),
    ("GPL-2.0-or-later", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("GPL-3.0-or-later", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("GPL-2.0", "under the terms of the gnu general public license version 2 as published by the free software foundation"),
    ("GPL-3.0", "everyone is permitted to copy and distribute verbatim copies of this license document.{0,200}?the gnu general public license is a free copyleft license"),
    ("LGPL-2.1", "under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1"),
    ("LGPL-3.0", "under the terms of the gnu lesser general public license as published by the free software foundation either version 3"),
    ("AGPL-3.0", "under the terms of the gnu affero general public license as published by the free software foundation either version 3"),
    ("MPL-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("MPL-1.1", "the contents of this file are subject to the mozilla public license version 1 1"),
    ("EPL-2.0", "this program and the accompanying materials are made available under the terms of the eclipse public license(?: v| version)? 2 0"),
    ("EPL-1.0", "this program and the accompanying materials are made available under the terms of the eclipse public license v1 0"),
    ("BSL-1.0", "boost software license version 1 0 august 17th 2003"),
    ("Zlib", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    ("Unlicense", "this is free and unencumbered software released into the public domain"),
    ("WTFPL", "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed"),
    ("CC0-1.0", "to the extent possible under law .{1,120}? has waived all copyright and related or neighboring rights"),
    ("OFL-1.1", "this font software is licensed under the sil open font license version 1 1"),
    ("Artistic-2.0", "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed.{0,200}?artistic license 2 0"),
    ("PostgreSQL", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement"),
    ("JSON", "the software shall be used for good not evil"),
    ("public-domain", "(?:is|are|been|hereby) (?:hereby )?(?:placed|released|dedicated|put) (?:in|into|to) the public domain"),
    ("all-rights-reserved", "all rights reserved"),
    ("proprietary", "(?:proprietary and confidential|confidential and proprietary)"),
    ("proprietary", "unauthorized (?:copying|reproduction|distribution|use) of this (?:file|document|material|work|software).{0,60}? (?:strictly )?prohibited"),
)

#: Words of the addresses under which the licenses are published.
ADDRESSES = (
    ("Apache-2.0", "www apache org licenses license 2 0"),
    ("Apache-1.1", "www apache org licenses license 1 1"),
    ("MIT", "opensource org licenses mit"),
    ("BSD-2-Clause", "opensource org licenses bsd 2 clause"),
    ("BSD-3-Clause", "opensource org licenses bsd 3 clause"),
    ("ISC", "opensource org licenses isc"),
    ("GPL-2.0", "gnu org licenses (?:old licenses )?gpl 2 0"),
    ("GPL-3.0", "gnu org licenses gpl 3 0"),
    ("GPL", "gnu org (?:licenses|copyleft) gpl"),
    ("LGPL-2.1", "gnu org licenses (?:old licenses )?lgpl 2 1"),
    ("LGPL-3.0", "gnu org licenses lgpl 3 0"),
    ("AGPL-3.0", "gnu org licenses agpl 3 0"),
    ("GFDL", "gnu org (?:licenses|copyleft) fdl"),
    ("MPL-2.0", "mozilla org (?:en us )?mpl 2 0"),
    ("MPL-1.1", "mozilla org mpl mpl 1 1"),
    ("EPL-2.0", "eclipse org legal epl (?:2 0|v20)"),
    ("EPL-1.0", "eclipse org legal epl v10"),
    ("BSL-1.0", "boost org license 1 0"),
    ("CC0-1.0", "creativecommons org publicdomain zero 1 0"),
    ("CC-BY-4.0", "creativecommons org licenses by 4 0"),
    ("CC-BY-3.0", "creativecommons org licenses by 3 0"),
    ("CC-BY-SA-4.0", "creativecommons org licenses by sa 4 0"),
    ("CC-BY-SA-3.0", "creativecommons org licenses by sa 3 0"),
    ("CC-BY-NC-4.0", "creativecommons org licenses by nc 4 0"),
    ("CC-BY-ND-4.0", "creativecommons org licenses by nd 4 0"),
    ("CC-BY-NC-SA-4.0", "creativecommons org licenses by nc sa 4 0"),
    ("CC-BY-NC-ND-4.0", "creativecommons org licenses by nc nd 4 0"),
    ("Unlicense", "unlicense org"),
    ("WTFPL", "wtfpl net"),
    ("OFL-1.1", "scripts sil org ofl"),
)

#: Words before a license's name that make a notice of it.
UNDER = "(?:licensed|released|distributed|available|published|provided|covered|governed|dual licensed|sublicensed|redistributed|modif\\w+|subject)"


class Rule(NamedTuple):
    label: str
    priority: int
    keywords: tuple[bytes, ...]  # one of them occurs in every match
    match: re.Pattern[bytes]


def keywords(expression: str) -> tuple[bytes, ...]:
    """For each alternative of an expression its longest plain run outside of groups, one of which occurs in every
    match; nothing, if an alternative has no run of three characters."""
    if whole := re.fullmatch(r"\(\?:([^()]*)\)", expression):
        expression = whole[1]
    runs = [[""]]
    depth, skip = 0, ""
    for c in re.sub(r"\\.", ".", expression):
        if skip:
            skip = "" if c == skip else skip
        elif c in "[{":
            skip = "]" if c == "[" else "}"
            runs[-1].append("")
        elif c in "()":
            depth += 1 if c == "(" else -1
            runs[-1].append("")
        elif depth:
            continue
        elif c == "|":
            runs.append([""])
        elif c in "?*+":
            runs[-1][-1] = runs[-1][-1][:-1]
            runs[-1].append("")
        elif c in ".V":
            runs[-1].append("")
        else:
            runs[-1][-1] += c
    best = [max((x.strip() for x in r), key=len).encode() for r in runs]
    return tuple(best) if all(len(x) > 2 for x in best) else ()


@functools.cache
def rules() -> list[Rule]:
    """All rules in the order in which they are tried; each kind's in the order of its table."""

    def rule(label: str, priority: int, expression: str, gate: str = "") -> Rule:
        spelled = expression.replace("V", "(?:version |v(?:er)? ?)?")
        return Rule(label, priority, keywords(gate or expression), re.compile(f" (?:{spelled})(?= )".encode()))

    out = [rule(label, SIGNATURE, x) for label, x in SIGNATURES]
    for label, name in NAMES.items():
        out.append(rule(label, NOTICE, f"{UNDER}(?: (?:\\w+ ){{0,4}}?(?:under|by|to|with))(?: (?:the|an?|terms|of|conditions|this|open source|following)){{0,6}} (?:{name})", name))
    for label in NAMES:
        words = " ".join(re.findall(r"[0-9a-z]+", label.lower()))
        out.append(rule(label, TAG, f"spdx license identifier {words}(?: only)?"))
    out += [rule(label, ADDRESS, x) for label, x in ADDRESSES]
    return out + [rule(label, NAME, name) for label, name in NAMES.items()]


@functools.cache
def gate() -> re.Pattern[bytes] | None:
    """One of the rules' keywords; no rule matches a text without one. None, if a rule has no keywords."""
    every = {k for r in rules() for k in r.keywords}
    # a keyword that holds another is found with it
    least = sorted(k for k in every if not any(o != k and o in k for o in every))
    return re.compile(b"|".join(map(re.escape, least))) if all(r.keywords for r in rules()) else None


class Found(NamedTuple):
    label: str
    priority: int
    start: int  # words, from 0
    end: int  # exclusive


def suppressed(found: list[Found]) -> list[Found]:
    """Leaves out every detection that lies within a kept one; those of the best priority come first, of these the
    longest, of these the first in the list. By start. No detection is longer than SPAN words."""
    kept: dict[int, list[Found]] = {}
    for d in sorted(found, key=lambda d: (d.priority, d.start - d.end)):
        block = d.start // SPAN
        if not any(o.start <= d.start and d.end <= o.end for at in (block - 1, block) for o in kept.get(at, ())):
            kept.setdefault(block, []).append(d)
    return sorted((d for own in kept.values() for d in own), key=lambda d: (d.start, d.end))


def scan(text: str | None) -> tuple[int, list[tuple[str, int]], list[Found]]:
    """The number of words, the base phrases' places as (label, first word), and the detections."""
    words = (text or "").encode().translate(WORD_BYTES).split()
    line = b" " + b" ".join(words) + b" "
    spaces = None

    def index(at: int) -> int:
        nonlocal spaces
        if spaces is None:
            spaces = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
        return int(np.searchsorted(spaces, at))

    base = []
    for phrase, label in BASE:
        at = line.find(b" " + phrase + b" ")
        while at >= 0:
            base.append((label, index(at)))
            at = line.find(b" " + phrase + b" ", at + 1)
    found = []
    if gate() is None or gate().search(line):
        seen: dict[bytes, bool] = {}
        for r in rules():
            for k in r.keywords:
                if k not in seen:
                    seen[k] = k in line
            if not r.keywords or any(map(seen.__getitem__, r.keywords)):
                found += [Found(r.label, r.priority, index(m.start()), index(m.end())) for m in r.match.finditer(line)]
    return len(words), sorted(base, key=lambda b: b[1]), suppressed(found)


#: Bytes of words stay, A-Z as a-z; all others become spaces.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def scan_licenses(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, n_words, base (label, start) and detections (label, priority, relevance, start and end word) of every
    row's whole text; a null or empty text has no words. Each row is scanned on its own, without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, base, found = [], [], []
            for t in map(pa.StringScalar.as_py, b.column(1)):
                words, places, detections = scan(t)
                n.append(words)
                base.append([{"label": label, "start": at} for label, at in places])
                found.append([{"label": d.label, "priority": d.priority, "relevance": RELEVANCE[d.priority], "start": d.start, "end": d.end} for d in detections])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(base, BASE_TYPE), pa.array(found, FOUND_TYPE)], ["key", "n_words", "base", "detections"])

    source = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = source.schema["key"].dataType.simpleString()
    out = source.mapInArrow(run, f"key {kind}, n_words long, base array<struct<label: string, start: long>>, detections array<struct<label: string, priority: int, relevance: double, start: long, end: long>>")
    return out.withColumnRenamed("key", key)


BASE_TYPE = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64())]))
FOUND_TYPE = pa.list_(pa.struct([("label", pa.string()), ("priority", pa.int32()), ("relevance", pa.float64()), ("start", pa.int64()), ("end", pa.int64())]))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scan of every document, with the base phrases' places and all labels. The score is that of the most
    relevant detection; of a base phrase alone, that of a name."""
    done = scan_licenses(table(spark, sf_dir, "documents"), "doc_id", "text")
    labels = lambda x: F.array_join(F.array_sort(F.array_distinct(x)), ",")
    base, starts = F.col("base.label"), F.col("base.start")
    return done.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.concat(base, F.col("detections.label"))).alias("labels"),
        F.coalesce(F.array_max("detections.relevance"), F.when(F.size("base") > 0, F.lit(RELEVANCE[NAME])), F.lit(0.0)).alias("score"),
    )
