"""Signature rules for licence texts, in order of priority.

Rules stand for normalised text: lower-case words joined by one blank.  A rule
has a label, a keyword (or several, parted by "|") of which one must begin at some
word before its regex is tried, a priority and a confidence.  Full notices come before names, names before short forms;
families of rules are written once for a list of licences and expanded.
"""

from __future__ import annotations

import re
from typing import NamedTuple


class Rule(NamedTuple):
    label: str
    keyword: str
    pattern: str
    priority: int
    confidence: float


#: Places that every scan counts: phrase of words and label.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Names as they are written in notices: label, keyword, name pattern.  Words are
# parted by one blank, so "1.1" is "1 1".
_VERSION = r"(?: (?:version|v|ver))? ?"
NAMED = [
    ("apache-1.0", "apache", r"apache(?: software)? licen[cs]e" + _VERSION + r"1 0"),
    ("apache-1.1", "apache", r"apache(?: software)? licen[cs]e" + _VERSION + r"1 1"),
    ("apache-2.0", "apache", r"apache(?: software)? licen[cs]e" + _VERSION + r"2(?: 0)?"),
    ("gpl-1.0", "general public", r"(?:gnu )?general public licen[cs]e" + _VERSION + r"1(?: 0)?"),
    ("gpl-2.0", "general public", r"(?:gnu )?general public licen[cs]e" + _VERSION + r"2(?: 0)?"),
    ("gpl-3.0", "general public", r"(?:gnu )?general public licen[cs]e" + _VERSION + r"3(?: 0)?"),
    ("lgpl-2.0", "general public", r"(?:library|lesser) general public licen[cs]e" + _VERSION + r"2(?: 0)?(?! 1)"),
    ("lgpl-2.1", "general public", r"lesser general public licen[cs]e" + _VERSION + r"2 1"),
    ("lgpl-3.0", "general public", r"lesser general public licen[cs]e" + _VERSION + r"3(?: 0)?"),
    ("agpl-1.0", "affero", r"affero general public licen[cs]e" + _VERSION + r"1(?: 0)?"),
    ("agpl-3.0", "affero", r"affero general public licen[cs]e" + _VERSION + r"3(?: 0)?"),
    ("gfdl-1.1", "documentation", r"gnu free documentation licen[cs]e" + _VERSION + r"1 1"),
    ("gfdl-1.2", "documentation", r"gnu free documentation licen[cs]e" + _VERSION + r"1 2"),
    ("gfdl-1.3", "documentation", r"gnu free documentation licen[cs]e" + _VERSION + r"1 3"),
    ("mpl-1.0", "mozilla", r"mozilla public licen[cs]e" + _VERSION + r"1 0"),
    ("mpl-1.1", "mozilla", r"mozilla public licen[cs]e" + _VERSION + r"1 1"),
    ("mpl-2.0", "mozilla", r"mozilla public licen[cs]e" + _VERSION + r"2(?: 0)?"),
    ("epl-1.0", "eclipse", r"eclipse public licen[cs]e" + _VERSION + r"1(?: 0)?"),
    ("epl-2.0", "eclipse", r"eclipse public licen[cs]e" + _VERSION + r"2(?: 0)?"),
    ("edl-1.0", "eclipse", r"eclipse distribution licen[cs]e" + _VERSION + r"1(?: 0)?"),
    ("cpl-1.0", "common public", r"common public licen[cs]e" + _VERSION + r"1(?: 0)?"),
    ("ipl-1.0", "ibm", r"ibm public licen[cs]e" + _VERSION + r"1(?: 0)?"),
    ("cddl-1.0", "distribution", r"common development and distribution licen[cs]e" + _VERSION + r"1 0"),
    ("cddl-1.1", "distribution", r"common development and distribution licen[cs]e" + _VERSION + r"1 1"),
    ("cecill-1.0", "cecill", r"cecill" + _VERSION + r"1 0"),
    ("cecill-2.0", "cecill", r"cecill" + _VERSION + r"2 0"),
    ("cecill-2.1", "cecill", r"cecill" + _VERSION + r"2 1"),
    ("cecill-b", "cecill", r"cecill b"),
    ("cecill-c", "cecill", r"cecill c"),
    ("eupl-1.1", "european union", r"european union public licen[cs]e" + _VERSION + r"1 1"),
    ("eupl-1.2", "european union", r"european union public licen[cs]e" + _VERSION + r"1 2"),
    ("artistic-1.0", "artistic", r"artistic licen[cs]e" + _VERSION + r"1 0"),
    ("artistic-2.0", "artistic", r"artistic licen[cs]e" + _VERSION + r"2(?: 0)?"),
    ("bsl-1.0", "boost", r"boost software licen[cs]e" + _VERSION + r"1(?: 0)?"),
    ("busl-1.1", "business source", r"business source licen[cs]e" + _VERSION + r"1 1"),
    ("sspl-1.0", "server side", r"server side public licen[cs]e" + _VERSION + r"1"),
    ("elastic-2.0", "elastic", r"elastic licen[cs]e" + _VERSION + r"2(?: 0)?"),
    ("osl-3.0", "open software", r"open software licen[cs]e" + _VERSION + r"3 0"),
    ("afl-3.0", "academic free", r"academic free licen[cs]e" + _VERSION + r"3 0"),
    ("afl-2.1", "academic free", r"academic free licen[cs]e" + _VERSION + r"2 1"),
    ("ofl-1.0", "open font", r"sil open font licen[cs]e" + _VERSION + r"1 0"),
    ("ofl-1.1", "open font", r"sil open font licen[cs]e" + _VERSION + r"1 1"),
    ("zpl-2.1", "zope", r"zope public licen[cs]e" + _VERSION + r"2 1"),
    ("php-3.01", "php", r"php licen[cs]e" + _VERSION + r"3 01"),
    ("python-2.0", "python", r"python software foundation licen[cs]e" + _VERSION + r"2"),
    ("ruby", "ruby", r"ruby licen[cs]e"),
    ("qpl-1.0", "q public", r"q public licen[cs]e" + _VERSION + r"1 0"),
    ("apsl-2.0", "apple", r"apple public source licen[cs]e" + _VERSION + r"2 0"),
    ("ms-pl", "microsoft", r"microsoft public licen[cs]e"),
    ("ms-rl", "microsoft", r"microsoft reciprocal licen[cs]e"),
    ("ncsa", "illinois", r"university of illinois(?: ncsa)? open source licen[cs]e"),
    ("bsd-2-clause", "bsd|freebsd", r"(?:bsd 2 clause|2 clause bsd|simplified bsd|freebsd)(?: licen[cs]e)?"),
    ("bsd-3-clause", "bsd", r"(?:bsd 3 clause|3 clause bsd|new bsd|modified bsd|revised bsd)(?: licen[cs]e)?"),
    ("bsd-4-clause", "bsd", r"(?:bsd 4 clause|4 clause bsd|original bsd)(?: licen[cs]e)?"),
    ("0bsd", "bsd|0bsd", r"(?:0bsd|bsd zero clause|zero clause bsd)(?: licen[cs]e)?"),
    ("mit", "mit licen", r"mit licen[cs]e"),
    ("mit-0", "mit no", r"mit no attribution(?: licen[cs]e)?"),
    ("x11", "x11", r"x11 licen[cs]e"),
    ("isc", "isc", r"isc licen[cs]e"),
    ("zlib", "zlib", r"zlib(?: libpng)? licen[cs]e"),
    ("libpng", "libpng", r"libpng licen[cs]e"),
    ("openssl", "openssl", r"openssl licen[cs]e"),
    ("curl", "curl", r"curl licen[cs]e"),
    ("postgresql", "postgresql", r"postgresql licen[cs]e"),
    ("unlicense", "unlicense", r"(?:the )?unlicense"),
    ("wtfpl", "what the", r"do what the [a-z]+ you want to public licen[cs]e"),
    ("beerware", "beer", r"beer ?ware licen[cs]e"),
    ("upl-1.0", "universal permissive", r"universal permissive licen[cs]e" + _VERSION + r"1 0"),
    ("bluoak-1.0", "blue oak", r"blue oak model licen[cs]e" + _VERSION + r"1 0 0"),
    ("mulan-psl-2.0", "mulan", r"mulan psl" + _VERSION + r"2"),
    ("odbl-1.0", "database", r"open (?:data commons open )?database licen[cs]e" + _VERSION + r"1 0"),
    ("odc-by-1.0", "data commons", r"open data commons attribution licen[cs]e" + _VERSION + r"1 0"),
    ("pddl-1.0", "public domain dedication", r"public domain dedication and licen[cs]e" + _VERSION + r"1 0"),
    ("openrail", "rail", r"open rail(?: m)? licen[cs]e"),
    ("llama-community", "llama", r"llama(?: [0-9 ]+)? community licen[cs]e"),
]

#: Notices that are whole sentences of a licence: label, keyword, pattern.
TEXTS = [
    ("mit", "permission is hereby granted", r"permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("isc", "permission to use copy modify", r"permission to use copy modify and or distribute this software for any purpose"),
    ("bsd", "redistribution and use", r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3-clause", "endorse or promote", r"neither the name of .{1,120}? may be used to endorse or promote products"),
    ("bsd-4-clause", "advertising materials", r"all advertising materials mentioning features or use of this software must display"),
    ("apache-2.0", "compliance with the licen", r"you may not use this file except in compliance with the licen[cs]e"),
    ("gpl-or-later", "any later version", r"either version [23] of the licen[cs]e or at your option any later version"),
    ("gpl", "free software foundation", r"published by the free software foundation"),
    ("mpl-2.0", "mozilla public", r"this source code form is subject to the terms of the mozilla public licen[cs]e"),
    ("zlib", "altered source versions", r"altered source versions must be plainly marked as such"),
    ("bsl-1.0", "machine executable", r"in the form of machine executable object code generated by a source language processor"),
    ("unlicense", "public domain", r"free and unencumbered software released into the public domain"),
    ("wtfpl", "you just do what", r"you just do what the [a-z]+ you want to"),
    ("public-domain", "public domain", r"(?:placed|released|dedicated) (?:in|into|to) the public domain"),
    ("proprietary", "all rights reserved", r"all rights reserved"),
    ("proprietary", "confidential", r"(?:proprietary and confidential|confidential and proprietary)"),
    ("no-redistribution", "may not be", r"may not be (?:copied|reproduced|redistributed|republished)(?: or [a-z]+)? without"),
    ("non-commercial", "non commercial", r"(?:for )?non commercial (?:use|purposes) only"),
]

# Creative Commons: parts of the name in words and letters.
CC_PARTS = {
    "by": "attribution", "by-sa": "attribution share ?alike", "by-nd": "attribution no ?deriv(?:ative)?s?(?: works)?",
    "by-nc": "attribution non ?commercial", "by-nc-sa": "attribution non ?commercial share ?alike",
    "by-nc-nd": "attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?",
}
CC_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")

# Openings of a grant; each is tried with each licence name.
GRANTS = r"(?:(?:is |are )?(?:licen[cs]ed|released|distributed|available|provided|published|redistributed) under(?: the)?(?: terms of)?(?: the)?|subject to(?: the)?(?: terms of)?(?: the)?)"


def _words(name: str) -> str:
    return r" ".join(re.findall(r"[a-z0-9]+", name))


def rules() -> list[Rule]:
    """All rules, best first."""
    made: list[Rule] = []
    for label, keyword, pattern in TEXTS:
        made.append(Rule(label, keyword, pattern, 10, 1.0))
    for label, keyword, pattern in NAMED:
        made.append(Rule(label, keyword, f"{GRANTS} (?:gnu )?(?:the )?{pattern}", 20, 0.95))
        made.append(Rule(label, keyword, pattern, 40, 0.8))
        made.append(Rule(label, "spdx", f"spdx license identifier {_words(label)}(?: only| or later)?", 15, 1.0))
    for letters, spoken in CC_PARTS.items():
        short = _words(letters)
        for version in CC_VERSIONS:
            v = _words(version)
            label = f"cc-{letters}-{version}"
            made.append(Rule(label, "spdx", f"spdx license identifier cc {short} {v}", 15, 1.0))
            made.append(Rule(label, "creativecommons", f"creativecommons org licenses {short} {v}", 20, 1.0))
            made.append(Rule(label, "creative commons", f"creative commons {spoken} {v}(?: international| unported| generic)?", 30, 0.95))
            made.append(Rule(label, "cc", f"cc {short} {v}", 40, 0.9))
        made.append(Rule(f"cc-{letters}", "creative commons", f"creative commons {spoken}(?: licen[cs]e)?", 50, 0.7))
        made.append(Rule(f"cc-{letters}", "cc", f"cc {short}", 60, 0.6))
    made.append(Rule("cc0-1.0", "cc0", r"cc0(?: 1 0)?(?: universal)?", 40, 0.9))
    made.append(Rule("cc0-1.0", "creativecommons", r"creativecommons org publicdomain zero 1 0", 20, 1.0))
    for label, keyword, pattern in (
        ("gpl", "general public", r"gnu general public licen[cs]e"), ("lgpl", "general public", r"gnu (?:lesser|library) general public licen[cs]e"),
        ("agpl", "affero", r"(?:gnu )?affero general public licen[cs]e"), ("apache", "apache", r"apache licen[cs]e"),
        ("mpl", "mozilla", r"mozilla public licen[cs]e"), ("epl", "eclipse", r"eclipse public licen[cs]e"),
        ("gfdl", "documentation", r"gnu free documentation licen[cs]e"), ("bsd", "bsd", r"bsd(?: style)? licen[cs]e"),
        ("artistic", "artistic", r"artistic licen[cs]e"), ("cddl", "distribution", r"common development and distribution licen[cs]e"),
        ("ofl", "open font", r"open font licen[cs]e"), ("public-domain", "public domain", r"public domain"),
    ):
        made.append(Rule(label, keyword, pattern, 70, 0.6))
    # The base phrases are found by every scan; as rules they lend confidence.
    for phrase, label in BASE.items():
        made.append(Rule(label, phrase, re.escape(phrase), 80, 0.6))
    return sorted(made, key=lambda r: r.priority)
