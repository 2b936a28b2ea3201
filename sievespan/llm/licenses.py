"""License detection with ordered signature rules.

A text is reduced to its words: runs of ASCII letters and digits and of all
characters beyond ASCII, A-Z in lower case, one space between. Rules are
regular expressions over that form. A rule is tried only if its keyword occurs.
Rules have priorities: a detection that lies within another one of higher
priority is dropped; of equal priority, within a longer one. Base phrases are
rules that are never dropped.

Rows are independent: a null or empty text has no words and no detections,
repeated rows get the same result, columns other than the text pass through.
"""

import re
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .words import word_list

RESULT = ("struct<n_words: bigint, found: array<struct<label: string, start: bigint, end: bigint, "
          "priority: int, base: boolean>>>")
CONFIDENCE = [0.5, 0.4, 0.6, 0.8, 0.95]    # by priority: how surely a detection means a license
NAME, NOTICE, VERSIONED, TAG = 1, 2, 3, 4

BASE = {    # phrase -> label; fixed by the contract of the query
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

LICENSE = "licen[sc]e"
# label, regex of the name, keywords of which one must occur, versions, regex of the address ({v}: version)
FAMILIES = [
    ("gpl", f"(?:gnu )?(?:general public {LICENSE}|gpl)", "general public|gpl", "1.0 2.0 3.0", "gnu org licenses (?:old licenses )?gpl {v}"),
    ("lgpl", f"(?:gnu )?(?:(?:lesser|library) general public {LICENSE}|lgpl)", "general public|lgpl", "2.0 2.1 3.0", "gnu org licenses (?:old licenses )?lgpl {v}"),
    ("agpl", f"(?:gnu )?(?:affero general public {LICENSE}|agpl)", "general public|agpl", "1.0 3.0", "gnu org licenses agpl {v}"),
    ("gfdl", f"(?:gnu )?(?:free documentation {LICENSE}|gfdl)", "free documentation|gfdl", "1.1 1.2 1.3", "gnu org licenses fdl {v}"),
    ("apache", f"apache(?: software)? {LICENSE}", "apache", "1.0 1.1 2.0", "apache org licenses license {v}"),
    ("mit", f"(?:the )?mit {LICENSE}|expat {LICENSE}", "mit|expat", "", "opensource org licenses mit"),
    ("mit-0", "mit no attribution", "no attribution", "", "opensource org licenses mit 0"),
    ("bsd", f"bsd(?: style)? {LICENSE}", "bsd", "", "opensource org licenses bsd license"),
    ("bsd-2-clause", f"(?:bsd 2 clause|(?:simplified|freebsd) bsd)(?: {LICENSE})?", "bsd", "", "opensource org licenses bsd 2 clause"),
    ("bsd-3-clause", f"(?:bsd 3 clause|(?:new|modified|revised) bsd)(?: {LICENSE})?", "bsd", "", "opensource org licenses bsd 3 clause"),
    ("bsd-4-clause", f"(?:bsd 4 clause|original bsd)(?: {LICENSE})?", "bsd", "", "spdx org licenses bsd 4 clause"),
    ("0bsd", f"(?:0bsd|zero clause bsd)(?: {LICENSE})?", "bsd", "", "opensource org licenses 0bsd"),
    ("isc", f"isc {LICENSE}", "isc", "", "opensource org licenses isc"),
    ("mpl", f"mozilla public {LICENSE}|mpl", "mozilla|mpl", "1.0 1.1 2.0", "mozilla org mpl {v}"),
    ("epl", f"eclipse public {LICENSE}|epl", "eclipse|epl", "1.0 2.0", "eclipse org legal epl v?{v}"),
    ("edl", f"eclipse distribution {LICENSE}", "eclipse", "1.0", "eclipse org org documents edl v?{v}"),
    ("cddl", f"common development and distribution {LICENSE}|cddl", "common development|cddl", "1.0 1.1", "opensource org licenses cddl {v}"),
    ("cpl", f"common public {LICENSE}", "common public", "1.0", "opensource org licenses cpl {v}"),
    ("epl-ibm", f"ibm public {LICENSE}", "ibm public", "1.0", "opensource org licenses ipl {v}"),
    ("eupl", f"european union public {LICENSE}|eupl", "european union|eupl", "1.0 1.1 1.2", "joinup ec europa eu software page eupl"),
    ("artistic", f"artistic {LICENSE}", "artistic", "1.0 2.0", "opensource org licenses artistic {v}"),
    ("bsl", f"boost software {LICENSE}", "boost", "1.0", "boost org license {v}"),
    ("zlib", f"zlib(?: libpng)? {LICENSE}", "zlib", "", "zlib net zlib license"),
    ("libpng", f"(?:lib)?png {LICENSE}", "png", "", "libpng org pub png src libpng license"),
    ("openssl", f"openssl {LICENSE}", "openssl", "", "openssl org source license"),
    ("ssleay", f"ssleay {LICENSE}", "ssleay", "", "ssleay org license"),
    ("php", f"php {LICENSE}", "php", "3.0 3.01", "php net license {v}"),
    ("python", f"python(?: software foundation)? {LICENSE}|psf {LICENSE}", "python|psf", "2.0", "docs python org license"),
    ("ruby", f"ruby {LICENSE}", "ruby", "", "ruby lang org en about license"),
    ("wtfpl", f"wtfpl|do what the fuck you want to public {LICENSE}", "wtfpl|do what", "2.0", "wtfpl net"),
    ("unlicense", "the unlicense", "unlicense", "", "unlicense org"),
    ("ncsa", f"(?:university of illinois )?ncsa(?: open source)? {LICENSE}", "ncsa", "", "opensource org licenses ncsa"),
    ("ofl", f"(?:sil )?open font {LICENSE}", "open font", "1.0 1.1", "scripts sil org ofl"),
    ("osl", f"open software {LICENSE}", "open software", "1.0 2.0 2.1 3.0", "opensource org licenses osl {v}"),
    ("afl", f"academic free {LICENSE}", "academic free", "1.1 2.0 2.1 3.0", "opensource org licenses afl {v}"),
    ("ms-pl", f"(?:microsoft|ms) public {LICENSE}", "public", "", "opensource org licenses ms pl"),
    ("ms-rl", f"(?:microsoft|ms) reciprocal {LICENSE}", "reciprocal", "", "opensource org licenses ms rl"),
    ("odbl", f"open (?:data commons )?(?:open )?database {LICENSE}|odbl", "open d|odbl", "1.0", "opendatacommons org licenses odbl {v}"),
    ("odc-by", "open data commons attribution", "open data commons", "1.0", "opendatacommons org licenses by {v}"),
    ("pddl", "public domain dedication and licen[sc]e", "public domain", "1.0", "opendatacommons org licenses pddl {v}"),
    ("cc0", "cc0|cc zero|creative commons zero", "cc0|cc zero|creative commons", "1.0", "creativecommons org publicdomain zero {v}"),
    ("cc-by", "cc by|creative commons attribution", "cc by|creative commons", "1.0 2.0 2.5 3.0 4.0", "creativecommons org licenses by {v}"),
    ("cc-by-sa", "cc by sa|creative commons attribution share ?alike", "cc by|creative commons", "1.0 2.0 2.5 3.0 4.0", "creativecommons org licenses by sa {v}"),
    ("cc-by-nd", "cc by nd|creative commons attribution no ?deriv(?:ative)?s(?: works)?", "cc by|creative commons", "1.0 2.0 2.5 3.0 4.0", "creativecommons org licenses by nd {v}"),
    ("cc-by-nc", "cc by nc|creative commons attribution non ?commercial", "cc by|creative commons", "1.0 2.0 2.5 3.0 4.0", "creativecommons org licenses by nc {v}"),
    ("cc-by-nc-sa", "cc by nc sa|creative commons attribution non ?commercial share ?alike", "cc by|creative commons", "1.0 2.0 2.5 3.0 4.0", "creativecommons org licenses by nc sa {v}"),
    ("cc-by-nc-nd", "cc by nc nd|creative commons attribution non ?commercial no ?deriv(?:ative)?s", "cc by|creative commons", "1.0 2.0 2.5 3.0 4.0", "creativecommons org licenses by nc nd {v}"),
    ("upl", f"universal permissive {LICENSE}", "universal permissive", "1.0", "opensource org licenses upl"),
    ("blueoak", f"blue oak model {LICENSE}", "blue oak", "1.0.0", "blueoakcouncil org license {v}"),
    ("elastic", f"elastic {LICENSE}", "elastic", "2.0", "elastic co licensing elastic license"),
    ("sspl", f"server side public {LICENSE}|sspl", "server side|sspl", "1.0", "mongodb com licensing server side public license"),
    ("busl", f"business source {LICENSE}", "business source", "1.1", "mariadb com bsl{v}"),
    ("vim", f"vim {LICENSE}", "vim", "", "vimdoc sourceforge net htmldoc uganda"),
    ("w3c", f"w3c (?:software (?:notice and )?)?{LICENSE}", "w3c", "", "w3 org consortium legal copyright software"),
    ("x11", f"x11 {LICENSE}", "x11", "", "spdx org licenses x11"),
    ("openrail", f"(?:creativeml |bigscience )?open ?rail(?: m)?(?: {LICENSE})?", "openrail|open rail", "", "licenses ai"),
]
# names that plain prose has too ("artistic license was taken"): they count beside a word that speaks of licensing
PROSE = {"artistic", "elastic", "python", "ruby", "php", "vim", "bsl", "x11", "zlib", "libpng", "w3c", "afl", "osl"}
BEFORE = "(?:under|per|see|with|of|to|dual|also) (?:the |both the |an? )?"
AFTER = " (?:version|v|text|agreement|terms|file|applies|\\d+)"
# sentences that notices, headers and bodies hold: label, regex, keyword
TEXTS = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy", "hereby granted"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions", "substantial portions"),
    ("mit", "without restriction including without limitation the rights to use copy modify merge publish distribute sublicense", "merge publish"),
    ("mit-0", "to permit persons to whom the software is furnished to do so the software is provided as is", "furnished to do so"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose", "permission to use"),
    ("isc", "provided that the above copyright notice and this permission notice appear in all copies", "appear in all copies"),
    ("0bsd", "with or without fee is hereby granted the software is provided as is and the author disclaims all warranties", "without fee"),
    ("bsd", "redistribution and use in source and binary forms with or without modification", "redistribution"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions", "redistributions of source"),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice", "redistributions in binary"),
    ("bsd-3-clause", "neither the name of .{1,120}? nor the names of its contributors", "neither the name"),
    ("bsd-3-clause", "may be used to endorse or promote products derived from this software without specific prior", "endorse or promote"),
    ("bsd-4-clause", "all advertising materials mentioning features or use of this software", "advertising materials"),
    ("bsd-2-clause-patent", "each copyright holder and contributor hereby grants to those receiving rights under this license", "those receiving rights"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered"),
    ("unlicense", "in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest", "in jurisdictions"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event", "provided as is"),
    ("zlib", "altered source versions must be plainly marked as such and must not be misrepresented", "plainly marked"),
    ("zlib", "the origin of this software must not be misrepresented", "the origin of"),
    ("libpng", "this copyright notice may not be removed or altered from any source or altered source distribution", "altered source distribution"),
    ("apache-2.0", "unless required by applicable law or agreed to in writing software", "applicable law"),
    ("apache-2.0", "you may not use this file except in compliance with the license", "except in compliance"),
    ("apache-2.0", "grant of patent license subject to the terms and conditions of this license each contributor hereby grants", "grant of patent"),
    ("apache-1.1", "this product includes software developed by the apache software foundation", "apache software foundation"),
    ("apache-1.1", "products derived from this software may not be called apache", "may not be called"),
    ("php-3.01", "products derived from this software may not be called php", "may not be called"),
    ("openssl", "this product includes software developed by the openssl project", "openssl project"),
    ("ssleay", "this product includes cryptographic software written by eric young", "cryptographic software"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public", "redistribute it"),
    ("gpl", "you should have received a copy of the gnu general public license", "you should have received"),
    ("gpl-2.0", "the licenses for most software are designed to take away your freedom to share and change it", "take away your freedom"),
    ("gpl-2.0", "you must cause the modified files to carry prominent notices stating that you changed the files", "prominent notices"),
    ("gpl-3.0", "the gnu general public license is a free copyleft license for software and other kinds of works", "copyleft license"),
    ("gpl-3.0", "to propagate a work means to do anything with it that without permission would make you", "to propagate"),
    ("lgpl", "you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public", "redistribute it"),
    ("lgpl", "you should have received a copy of the gnu (?:lesser|library) general public license", "you should have received"),
    ("lgpl-3.0", "a combined work is a work produced by combining or linking an application with the library", "combined work"),
    ("agpl", "you can redistribute it and or modify it under the terms of the gnu affero general public", "redistribute it"),
    ("agpl-3.0", "interacting with it remotely through a computer network", "interacting with it remotely"),
    ("gfdl", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation", "modify this document"),
    ("gfdl", "with no invariant sections no front cover texts and no back cover texts", "invariant sections"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license", "source code form"),
    ("mpl-2.0", "if a copy of the mpl was not distributed with this file", "copy of the mpl"),
    ("mpl-1.1", "the contents of this file are subject to the mozilla public license version 1 1", "contents of this file"),
    ("mpl-1.1", "software distributed under the license is distributed on an as is basis without warranty of any kind either express or implied", "distributed on an"),
    ("cddl-1.0", "the contents of this file are subject to the terms of the common development and distribution license", "contents of this file"),
    ("cddl-1.0", "when distributing covered code include this cddl header in each file", "cddl header"),
    ("epl-2.0", "this program and the accompanying materials are made available under the terms of the eclipse public license v?(?:ersion )?2", "accompanying materials"),
    ("epl-1.0", "this program and the accompanying materials are made available under the terms of the eclipse public license v?(?:ersion )?1", "accompanying materials"),
    ("cpl-1.0", "the accompanying program is provided under the terms of this common public license", "common public"),
    ("eupl", "this european union public licence the eupl applies to the work", "european union"),
    ("artistic-2.0", "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed the intent", "verbatim copies"),
    ("artistic-1.0", "the intent of this document is to state the conditions under which a package may be copied", "the intent of"),
    ("bsl-1.0", "permission is hereby granted free of charge to any person or organization obtaining a copy", "hereby granted"),
    ("bsl-1.0", "must be included in all copies of the software in whole or in part and all derivative works of the software unless", "in whole or in part"),
    ("python-2.0", "psf is making python available to licensee on an as is basis", "psf is making"),
    ("ruby", "you may make and give away verbatim copies of the source form of the software without restriction", "give away verbatim"),
    ("wtfpl", "you just do what the fuck you want to", "do what"),
    ("wtfpl", "terms and conditions for copying distribution and modification 0 you just do what", "do what"),
    ("ncsa", "the software without restriction including .{1,160}? names of .{1,80}? nor the names of its contributors may be used", "deal with the software|names of its"),
    ("ncsa", "to deal with the software without restriction", "deal with the software"),
    ("ofl-1.1", "this font software is licensed under the sil open font license", "font software"),
    ("ofl-1.1", "the goals of the open font license ofl are to stimulate worldwide development of collaborative font projects", "collaborative font"),
    ("ofl-1.1", "neither the font software nor any of its individual components in original or modified versions may be sold by itself", "font software"),
    ("osl-3.0", "licensed under the open software license version 3 0", "open software"),
    ("afl-3.0", "licensed under the academic free license version 3 0", "academic free"),
    ("ms-pl", "if you use the software you accept this license if you do not accept the license do not use the software", "accept this license"),
    ("ms-rl", "for any file you distribute that contains code from the software in source code or binary format you must provide recipients the source", "you must provide recipients"),
    ("odbl-1.0", "this database is made available under the open database license", "open database"),
    ("odbl-1.0", "any rights in individual contents of the database are licensed under the database contents license", "database contents"),
    ("cc0-1.0", "to the extent possible under law .{1,120}? has waived all copyright and related or neighboring rights", "extent possible under law"),
    ("cc0-1.0", "affirmer hereby overtly fully permanently irrevocably and unconditionally waives", "affirmer"),
    ("cc-by", "this work is licensed under (?:a|the) creative commons attribution \\d", "creative commons"),
    ("cc-by-sa", "this work is licensed under (?:a|the) creative commons attribution share ?alike", "creative commons"),
    ("cc-by-nc", "this work is licensed under (?:a|the) creative commons attribution non ?commercial", "creative commons"),
    ("cc-by-nd", "this work is licensed under (?:a|the) creative commons attribution no ?deriv", "creative commons"),
    ("upl-1.0", "a license is hereby granted to any person obtaining a copy of this software associated documentation and or data", "associated documentation"),
    ("blueoak-1.0.0", "each contributor licenses you to do everything with this software that would otherwise infringe", "otherwise infringe"),
    ("elastic-2.0", "you may not provide the software to third parties as a hosted or managed service", "hosted or managed"),
    ("sspl-1.0", "if you make the functionality of the program or a modified version available to third parties as a service", "as a service"),
    ("busl-1.1", "the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use", "non production use"),
    ("busl-1.1", "effective on the change date or the fourth anniversary of the first publicly available distribution", "change date"),
    ("w3c", "this work is being provided by the copyright holders under the following license", "copyright holders"),
    ("x11", "except as contained in this notice the names? of the (?:above copyright holders|x consortium) shall not be used in advertising", "shall not be used in advertising"),
    ("openrail", "use based restrictions as referenced in paragraph 5 must be included as an enforceable provision", "use based restrictions"),
    ("public-domain", "(?:released|placed|dedicated|is) (?:in|into|to) the public domain", "public domain"),
    ("public-domain", "this (?:work|file|code|software) has been (?:released|placed|dedicated) (?:in|into|to) the public domain", "public domain"),
    ("proprietary", "this (?:file|document|software) (?:contains|is) (?:confidential and )?proprietary (?:and confidential )?information", "proprietary"),
    ("proprietary", "unauthori[sz]ed (?:copying|use|reproduction|distribution) of this (?:file|software|document|material)", "unauthori"),
    ("proprietary", "no part of this (?:publication|work|document) may be reproduced", "no part of this"),
    ("all-rights-reserved", "all rights reserved", "all rights reserved"),
]


class Rule(NamedTuple):
    label: str
    pattern: re.Pattern
    keywords: tuple[bytes, ...]    # one of them must occur
    priority: int
    base: bool = False
    raw: bool = False    # over the text in lower case and not over its words


def _words(text: str) -> str:
    return re.sub("[^0-9a-z]+", " ", text)


@cache
def rules() -> tuple[Rule, ...]:
    """All rules, base ones first."""
    out = [Rule(label, _compiled(phrase), (phrase.encode(),), 0, True) for phrase, label in BASE.items()]

    def add(label, pattern, keywords, priority):
        out.append(Rule(label, _compiled(pattern), keywords, priority))

    for label, name, keyword, versions, address in FAMILIES:
        own = tuple(k.encode() for k in keyword.split("|"))
        tag = _words(label)
        if label in PROSE:
            add(label, f"{BEFORE}(?:{name})|(?:{name}){AFTER}", own, NAME)
        else:
            add(label, name, own, NAME)
        add(label, "(?:licensed|released|distributed|available|published|provided|made available) under "
                   f"(?:the )?(?:terms (?:and conditions )?of )?(?:the )?(?:{name})", own, NOTICE)
        add(label, f"spdx license identifier {tag}", (b"spdx license identifier",), NOTICE)
        # in prose a name may follow the word by chance; a tag has its sign between
        out.append(Rule(label, re.compile(rf"(?<![\w\x80-\xff])licen[sc]e\"?'?\s*[:=]\s*[\"'(]?{_words(label).replace(' ', '[ -]')}(?![\w\x80-\xff+-]|\.\w)".encode("latin-1")),
                        (_words(label).split(" ")[0].encode(),), NOTICE, raw=True))
        if "{v}" not in address:
            add(label, address, (address.split(" ")[0].encode(),), NOTICE)
        for version in versions.split():
            v = _words(version)
            short = v.removesuffix(" 0")
            number = f"{v}|{short}" if short != v else v
            full = f"{label}-{version}"
            add(full, f"(?:{name})(?: (?:version|v|international|unported))? v?(?:{number})", own, VERSIONED)
            add(full, f"(?:licensed|released|distributed|available) under (?:the )?(?:terms of )?(?:the )?"
                      f"(?:{name})(?: (?:version|v))? v?(?:{number})", own, VERSIONED)
            add(full, f"{tag} (?:{number})(?: only| or later)?", (tag.encode(),), NOTICE)
            add(full, f"spdx license identifier {tag} (?:{v}|{short})(?: only| or later)?", (b"spdx",), TAG)
            if "{v}" in address:
                add(full, address.replace("{v}", f"(?:{number})"), (address.split(" ")[0].encode(),), VERSIONED)
    for label, pattern, keyword in TEXTS:
        add(label, pattern, tuple(k.encode() for k in keyword.split("|")), VERSIONED)
    return tuple(out)


def _compiled(pattern: str) -> re.Pattern:
    return re.compile(f"(?<= )(?:{pattern})(?= )".encode())


@cache
def _gate() -> dict[bytes, list[int]]:
    """Keyword -> the rules that wait for it."""
    waiting: dict[bytes, list[int]] = {}
    for i, rule in enumerate(rules()):
        for word in rule.keywords:
            waiting.setdefault(word, []).append(i)
    return waiting


def suppress(found: list[tuple[int, int, int, bool, str]]) -> list[tuple[int, int, int, bool, str]]:
    """Of (start, end, priority, base, label) those that stay, in order of start."""
    found = sorted(set(found), key=lambda d: (d[0], -d[1], -d[2], d[4]))
    furthest: dict[int, int] = {}    # by priority: the furthest end so far
    kept = []
    for d in found:
        # what came before starts no later; what ends no earlier too contains d
        inside = any(end >= d[1] for p, end in furthest.items() if p >= d[2])
        if d[3] or not inside:
            kept.append(d)
        if not d[3]:
            furthest[d[2]] = max(furthest.get(d[2], -1), d[1])
    return kept


def scan(text: bytes) -> tuple[int, list[dict]]:
    """Number of words and detections (start and end in words) of one text."""
    words = word_list(text)
    line = b" %b " % b" ".join(words)
    wanted = {i for word, own in _gate().items() if word in line for i in own}
    found, lower = [], None
    for i in sorted(wanted):
        rule = rules()[i]
        if rule.raw:
            lower = text.lower() if lower is None else lower    # A-Z only, so places are those of the text
            for m in rule.pattern.finditer(lower):
                # as a place in the line of words: these before it, and its own
                start = sum(len(w) + 1 for w in word_list(text[:m.start()])) + 1
                found.append((start, start + len(b" ".join(word_list(m.group()))), rule.priority, False, rule.label))
            continue
        found += [(m.start(), m.end(), rule.priority, rule.base, rule.label) for m in rule.pattern.finditer(line)]
    out, place, at = [], 0, 0
    for start, end, priority, base, label in suppress(found):
        place += line.count(b" ", at, start)    # spaces before a word: its place and one more
        at = start
        out.append({"label": label, "start": place - 1, "end": place + line.count(b" ", start, end),
                    "priority": priority, "base": base})
    return len(words), out


def detect(docs: DataFrame, text: str = "text", name: str = "licenses") -> DataFrame:
    """``docs`` with column ``name``: number of words and the detections, each
    with its label, its words (from 0, end exclusive), priority and base flag."""

    @F.pandas_udf(RESULT)
    def scanned(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([scan(t) for t in texts], columns=["n_words", "found"])

    return docs.withColumn(name, scanned(F.coalesce(F.col(text), F.lit("")).cast("binary")))


def confidence(found: Column) -> Column:
    """How surely a text carries a license: no detection errs independently of the others."""
    misses = F.aggregate(found, F.lit(1.0), lambda acc, d: acc * F.element_at(
        F.array(*[F.lit(1 - c) for c in CONFIDENCE]), d["priority"] + 1))
    return 1 - misses
