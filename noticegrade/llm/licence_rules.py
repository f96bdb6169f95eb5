"""Signature rules for licence mentions: label, priority, keyword, regular expression.

A rule's expression is matched against words (0-9, a-z and what isn't ASCII) with one space
between them, from the place of the rule's keyword, its first word; so "CC BY-NC 4.0" is
``cc by nc 4 0``. Priority 1 is best. Rules of families that come in versions are built from
the families; the others are listed.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

TAG, VERSIONED, NAMED, NOTICE = 1, 2, 3, 4
#: How sure a match of each priority makes it that the text states a licence.
CONFIDENCE = {TAG: 1.0, VERSIONED: 0.95, NAMED: 0.8, NOTICE: 0.4}
#: Words that a match can have at most.
LONGEST = 24


@dataclass(frozen=True)
class Rule:
    label: str
    priority: int
    keyword: str
    pattern: str


#: Fixed values. Phrases that always count, with their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Fixed values. Families with versions: label, names, versions.
_GNU = (
    ("gpl", ("gnu general public license", "gnu gpl", "gpl"), ("1", "2", "3")),
    ("lgpl", ("gnu lesser general public license", "gnu library general public license", "gnu lgpl", "lgpl"), ("2", "2.1", "3")),
    ("agpl", ("gnu affero general public license", "affero general public license", "gnu agpl", "agpl"), ("1", "3")),
    ("gfdl", ("gnu free documentation license", "gnu fdl", "gfdl"), ("1.1", "1.2", "1.3")),
)
_CC_PARTS = {"by": "attribution", "nc": "non ?commercial", "sa": "share ?alike", "nd": "no ?deriv(?:ative)?s?(?: works)?"}
_CC = (("by",), ("by", "sa"), ("by", "nc"), ("by", "nd"), ("by", "nc", "sa"), ("by", "nc", "nd"))
_CC_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")
_VERSIONED = (
    ("apache", ("apache license", "apache software license", "apache", "asl"), ("1.0", "1.1", "2.0")),
    ("mpl", ("mozilla public license", "mpl"), ("1.0", "1.1", "2.0")),
    ("epl", ("eclipse public license", "epl"), ("1.0", "2.0")),
    ("cddl", ("common development and distribution license", "cddl"), ("1.0", "1.1")),
    ("cpl", ("common public license", "cpl"), ("1.0",)),
    ("eupl", ("european union public licence", "european union public license", "eupl"), ("1.0", "1.1", "1.2")),
    ("osl", ("open software license", "osl"), ("1.0", "2.0", "2.1", "3.0")),
    ("afl", ("academic free license", "afl"), ("1.1", "2.0", "2.1", "3.0")),
    ("artistic", ("artistic license", "perl artistic license"), ("1.0", "2.0")),
    ("ofl", ("sil open font license", "open font license", "ofl"), ("1.0", "1.1")),
    ("psf", ("python software foundation license", "psf license"), ("2",)),
    ("php", ("php license",), ("3.0", "3.01")),
    ("bsl", ("business source license", "busl"), ("1.1",)),
    ("odbl", ("open database license", "odbl"), ("1.0",)),
    ("cecill", ("cecill license", "cecill"), ("1.0", "2.0", "2.1")),
    ("boost", ("boost software license", "bsl"), ("1.0",)),
)
#: Fixed values. Rules of their own: label, priority, expression.
_OWN = (
    ("mit", NAMED, "mit license"),
    ("mit", NAMED, "mit licence"),
    ("mit", NAMED, "expat license"),
    ("x11", NAMED, "x11 license"),
    ("mit-0", NAMED, "mit no attribution"),
    ("isc", NAMED, "isc licen[cs]e"),
    ("bsd-0-clause", NAMED, "(?:zero|0) clause bsd(?: licen[cs]e)?"),
    ("bsd-0-clause", NAMED, "bsd (?:zero|0) clause(?: licen[cs]e)?"),
    ("bsd-2-clause", NAMED, "bsd (?:2|two) clause(?: licen[cs]e)?"),
    ("bsd-3-clause", NAMED, "bsd (?:3|three) clause(?: licen[cs]e)?"),
    ("bsd-4-clause", NAMED, "bsd (?:4|four) clause(?: licen[cs]e)?"),
    ("bsd-2-clause", NAMED, "2 clause bsd(?: licen[cs]e)?"),
    ("bsd-3-clause", NAMED, "3 clause bsd(?: licen[cs]e)?"),
    ("bsd-4-clause", NAMED, "4 clause bsd(?: licen[cs]e)?"),
    ("bsd-2-clause", NAMED, "simplified bsd licen[cs]e"),
    ("bsd-3-clause", NAMED, "new bsd licen[cs]e"),
    ("bsd-3-clause", NAMED, "modified bsd licen[cs]e"),
    ("bsd-3-clause", NAMED, "revised bsd licen[cs]e"),
    ("bsd-4-clause", NAMED, "original bsd licen[cs]e"),
    ("bsd", NAMED, "bsd (?:style )?licen[cs]e"),
    ("zlib", NAMED, "zlib(?: libpng)? licen[cs]e"),
    ("unlicense", NAMED, "unlicense"),
    ("wtfpl", NAMED, "wtfpl"),
    ("wtfpl", NAMED, "do what the fuck you want to public license"),
    ("beerware", NAMED, "beer ware license"),
    ("openssl", NAMED, "openssl license"),
    ("ruby", NAMED, "ruby license"),
    ("ms-pl", NAMED, "microsoft public license"),
    ("ms-rl", NAMED, "microsoft reciprocal license"),
    ("ncsa", NAMED, "university of illinois ncsa open source license"),
    ("postgresql", NAMED, "postgresql licen[cs]e"),
    ("vim", NAMED, "vim license"),
    ("cc0", NAMED, "cc0(?: 1 0)?(?: universal)?"),
    ("cc0", NAMED, "cc zero"),
    ("cc0", NAMED, "creative commons (?:cc0|zero)(?: 1 0)?(?: universal)?"),
    ("creative-commons", NOTICE, "creative commons(?: licen[cs]e)?"),
    ("public-domain", NAMED, "public domain(?: dedication)?"),
    ("public-domain", NAMED, "dedicated to the public domain"),
    ("mit", VERSIONED, "permission is hereby granted free of charge to any person obtaining a copy"),
    ("isc", VERSIONED, "permission to use copy modify and (?:or )?distribute this software for any purpose"),
    ("bsd", VERSIONED, "redistribution and use in source and binary forms with or without modification are permitted"),
    ("gpl", NAMED, "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("boost", VERSIONED, "permission is hereby granted free of charge to any person or organization obtaining a copy"),
    ("zlib", VERSIONED, "this software is provided as is without any express or implied warranty in no event"),
    ("proprietary", NOTICE, "all rights reserved"),
    ("proprietary", NOTICE, "proprietary and confidential"),
    ("notice", NOTICE, "licensed under (?:the )?(?:terms of )?[^ ]+"),
    ("notice", NOTICE, "released under (?:the )?(?:terms of )?[^ ]+ licen[cs]e"),
    ("notice", NOTICE, "distributed under (?:the )?(?:terms of )?[^ ]+ licen[cs]e"),
    ("notice", NOTICE, "see (?:the )?license(?: file)? for details"),
)


def _version(text: str) -> str:
    """2.1 as ``2 1``; a version without a part after the dot may have ``0`` there."""
    parts = text.split(".")
    if len(parts) == 1:
        return f"{parts[0]}(?: 0)?"
    return f"{parts[0]}(?: 0)?" if parts[1] == "0" else " ".join(parts)


def _versioned(label: str, names: tuple[str, ...], versions: tuple[str, ...], or_later: bool) -> list[Rule]:
    out = []
    for name in names:
        glue = "" if " " not in name else " "
        for version in versions:
            # "gplv3" is a word of its own, with a keyword of its own
            number = f"(?: licen[cs]e)? (?:v|v |ver |version )?{_version(version)}"
            ends = {"": ""}
            if or_later:
                ends |= {"-or-later": " (?:or|and) (?:at your option )?(?:any )?later(?: version)?", "-only": " only"}
            for suffix, words in ends.items():
                out.append(Rule(f"{label}-{version}{suffix}", VERSIONED, name.split(" ")[0], name + number + words))
                if not glue:
                    head = f"{name}v{version.split('.')[0]}"
                    rest = f" {version.split('.')[1]}" if "." in version and version.split(".")[1] != "0" else "(?: 0)?"
                    out.append(Rule(f"{label}-{version}{suffix}", VERSIONED, head, head + rest + words))
        if glue or label in ("gpl", "lgpl", "agpl"):
            out.append(Rule(label, NAMED, name.split(" ")[0], f"{name}(?: licen[cs]e)?"))
    return out


def _creative_commons() -> list[Rule]:
    out = []
    for parts in _CC:
        label = "cc-" + "-".join(parts)
        short = " ".join(parts)
        long = " ".join(_CC_PARTS[p] for p in parts)
        for form in (f"cc {short}", f"creative commons {short}", f"creative commons {long}"):
            key = form.split(" ")[0]
            out.append(Rule(label, NAMED, key, form))
            out += [Rule(f"{label}-{v}", VERSIONED, key, f"{form}(?: licen[cs]e)?(?: v| version)? {_version(v)}") for v in _CC_VERSIONS]
    return out


@lru_cache
def rules() -> tuple[Rule, ...]:
    """All rules, in the order that settles ties of priority."""
    out = [r for label, names, versions in _GNU for r in _versioned(label, names, versions, label != "gfdl")]
    out += [r for label, names, versions in _VERSIONED for r in _versioned(label, names, versions, False)]
    out += _creative_commons()
    for label, priority, pattern in _OWN:
        heads = ["zero", "0"] if pattern.startswith("(?:zero|0)") else [pattern.split(" ")[0].split("(")[0]]
        out += [Rule(label, priority, head, pattern) for head in heads]
    tags = dict.fromkeys(r.label for r in out if r.priority in (VERSIONED, NAMED))
    out += [Rule(t, TAG, "spdx", f"spdx license identifier {t.replace('-', ' ').replace('.', ' ')}") for t in tags]
    return tuple(dict.fromkeys(out))


def anchor(pattern: str) -> str:
    """A word, or ``licen`` for any that begins so, or two words, that every match has in it."""
    fixed = re.sub(r"\(\?:(?:[^()]|\([^()]*\))*\)\??", "  ", pattern)
    if "licen" in fixed:
        return "licen"
    words = [w for w in fixed.split(" ") if w.isalnum() and len(w) >= 3]
    return max(words, key=len) if words else " ".join(fixed.split(" ")[:2])


@lru_cache
def gate() -> str:
    """An expression that finds an anchor in a text as it is; a text without one has no match."""
    anchors = {anchor(r.pattern) for r in rules()} | {anchor(phrase) for phrase in BASE}
    word, other = r"[0-9A-Za-z\x{80}-\x{10FFFF}]", r"[^0-9A-Za-z\x{80}-\x{10FFFF}]+"
    whole = "|".join(sorted(a.replace(" ", other) for a in anchors - {"licen"}))
    return f"(?i)licen|(?<!{word})(?:{whole})(?!{word})"
