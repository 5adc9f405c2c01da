"""Licence scans by sentence rules.

A text is cut into sentences, which are normalised and looked up among known
licence sentences. That turns a text into a short sequence of sentence
identifiers with their places. Ordered rules, longer ones first, then look for
their identifiers in that order within the sequence, each at most ``APART``
identified sentences after the one before; what a rule has matched no later
rule can use. Identifiers that no rule matches are reported as such.

Sentences that grant a licence by name ("licensed under the ...") share one
normal form: subject and verb are dropped, and the longest name that the rest
begins with is looked up; further names may follow after "or" and "and". SPDX
expressions give each identifier that they name, deprecated ones too. Each line
is normalised once, and a place is looked up by a bounded number of words.

Cases: a null text counts as empty; texts without licence sentences have empty
results; very long texts and sentences go the same way; a sentence is recognised when wrapped over lines and behind comment
marks; a licence that stands twice is named once, at its first place; repeated
rows repeat; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

APART = 6

#: Names of licences, in normal form, by SPDX identifier.
NAMES = {
    "MIT": ("mit license", "mit", "expat license"),
    "Apache-2.0": ("apache license version 2 0", "apache license 2 0", "apache 2 0", "apache 2 0 license", "apache license v2 0"),
    "Apache-1.1": ("apache license version 1 1", "apache license 1 1"),
    "BSD-2-Clause": ("bsd 2 clause license", "2 clause bsd license", "simplified bsd license", "bsd 2 clause"),
    "BSD-3-Clause": ("bsd 3 clause license", "3 clause bsd license", "new bsd license", "bsd 3 clause", "modified bsd license"),
    "ISC": ("isc license", "isc"),
    "Zlib": ("zlib license",),
    "Unlicense": ("unlicense",),
    "MPL-2.0": ("mozilla public license version 2 0", "mozilla public license 2 0", "mpl 2 0", "mozilla public license v 2 0"),
    "EPL-2.0": ("eclipse public license version 2 0", "eclipse public license 2 0", "eclipse public license v 2 0"),
    "GPL-2.0-only": ("gnu general public license version 2", "gnu general public license v2", "gpl version 2", "gplv2", "gnu gpl version 2", "gpl 2 0", "gpl v2", "gnu gpl v2"),
    "GPL-2.0-or-later": ("gnu general public license version 2 or later", "gnu general public license version 2 or any later version"),
    "GPL-3.0-only": ("gnu general public license version 3", "gnu general public license version 3 0", "gnu general public license v3", "gpl version 3", "gplv3", "gnu gpl version 3", "gpl 3 0", "gpl v3", "gnu gpl v3"),
    "GPL-3.0-or-later": ("gnu general public license version 3 or later", "gnu general public license version 3 or any later version"),
    "LGPL-2.0-only": ("gnu library general public license version 2", "lgpl 2 0"),
    "LGPL-2.0-or-later": ("gnu library general public license version 2 or later",),
    "LGPL-2.1-only": ("gnu lesser general public license version 2 1", "lgpl 2 1", "lgpl v2 1", "gnu lgpl version 2 1"),
    "LGPL-2.1-or-later": ("gnu lesser general public license version 2 1 or later",),
    "LGPL-3.0-only": ("gnu lesser general public license version 3", "gnu lesser general public license version 3 0", "lgpl 3 0", "lgpl v3", "gnu lgpl version 3"),
    "LGPL-3.0-or-later": ("gnu lesser general public license version 3 or later",),
    "AGPL-3.0-only": ("gnu affero general public license version 3", "gnu affero general public license version 3 0", "agpl 3 0", "agpl v3", "gnu agpl version 3"),
    "AGPL-3.0-or-later": ("gnu affero general public license version 3 or later",),
    "CC0-1.0": ("cc0 1 0", "cc0", "cc0 1 0 universal", "creative commons zero"),
    "CC-BY-4.0": ("cc by 4 0", "creative commons attribution 4 0 international license", "creative commons attribution 4 0"),
    "CC-BY-SA-4.0": ("cc by sa 4 0", "creative commons attribution sharealike 4 0 international license"),
    "CC-BY-ND-4.0": ("cc by nd 4 0", "creative commons attribution noderivatives 4 0 international license"),
    "CC-BY-NC-4.0": ("cc by nc 4 0", "creative commons attribution noncommercial 4 0 international license"),
    "CC-BY-NC-SA-4.0": ("cc by nc sa 4 0", "creative commons attribution noncommercial sharealike 4 0 international license"),
    "CC-BY-3.0": ("cc by 3 0", "creative commons attribution 3 0 unported license", "creative commons attribution 3 0"),
    "CC-BY-SA-3.0": ("cc by sa 3 0", "creative commons attribution sharealike 3 0 unported license", "creative commons attribution sharealike 3 0"),
    "MPL-1.1": ("mozilla public license version 1 1", "mozilla public license 1 1", "mpl 1 1"),
    "EPL-1.0": ("eclipse public license version 1 0", "eclipse public license 1 0", "eclipse public license v 1 0", "eclipse public license v1 0"),
    "GPL-1.0-only": ("gnu general public license version 1", "gpl 1 0"),
    "GPL-1.0-or-later": ("gnu general public license version 1 or later", "gnu general public license", "gnu gpl", "gpl"),
    "0BSD": ("zero clause bsd license", "bsd zero clause license", "0bsd"),
    "BSD-4-Clause": ("bsd 4 clause license", "4 clause bsd license", "original bsd license", "bsd 4 clause"),
    "BSL-1.0": ("boost software license version 1 0", "boost software license 1 0", "boost software license"),
    "Artistic-1.0": ("artistic license 1 0", "artistic license version 1 0"),
    "Artistic-2.0": ("artistic license 2 0", "artistic license version 2 0"),
    "OFL-1.1": ("sil open font license version 1 1", "sil open font license 1 1", "sil open font license"),
    "PSF-2.0": ("python software foundation license version 2", "python software foundation license", "psf license"),
    "CDDL-1.0": ("common development and distribution license version 1 0", "common development and distribution license 1 0", "cddl 1 0", "common development and distribution license"),
    "CDDL-1.1": ("common development and distribution license version 1 1", "cddl 1 1"),
    "EUPL-1.2": ("european union public licence version 1 2", "european union public license version 1 2", "european union public license 1 2", "eupl 1 2", "eupl v 1 2"),
    "WTFPL": ("wtfpl", "do what the fuck you want to public license"),
    "MS-PL": ("microsoft public license", "ms pl"),
    "NCSA": ("university of illinois ncsa open source license", "ncsa license"),
    "PostgreSQL": ("postgresql license",),
    "OpenSSL": ("openssl license",),
    "CC-BY-NC-ND-4.0": ("cc by nc nd 4 0", "creative commons attribution noncommercial noderivatives 4 0 international license"),
}

#: Sentences of licence texts, in normal form, by identifier. A trailing star stands for any rest.
SENTENCES = {
    "mit.grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files*",
    "mit.notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "asis": "the software is provided as is without warranty of any kind*",
    "liable": "in no event shall the authors or copyright holders be liable*",
    "isc.grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted*",
    "bsd.grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met*",
    "bsd.source": "redistributions of source code must retain the above copyright notice*",
    "bsd.binary": "redistributions in binary form must reproduce the above copyright notice*",
    "bsd.endorse": "neither the name of*",
    "bsd.asis": "this software is provided by the copyright holders and contributors as is*",
    "apache.comply": "you may not use this file except in compliance with the license",
    "apache.copy": "you may obtain a copy of the license at*",
    "apache.asis": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis*",
    "gpl.free": "this program is free software*",
    "gpl.2later": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl.3later": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl.library": "this library is free software*",
    "gpl.hope": "this program is distributed in the hope that it will be useful*",
    "mpl.subject": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "unlicense": "this is free and unencumbered software released into the public domain",
    "bsd.advert": "all advertising materials mentioning features or use of this software must display the following acknowledgement*",
    "apache.conditions": "terms and conditions for use reproduction and distribution*",
    "apache.define": "license shall mean the terms and conditions for use reproduction and distribution as defined by sections 1 through 9 of this document",
    "apache.copyright": "subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license*",
    "gnu.verbatim": "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed*",
    "gpl2.purpose": "the licenses for most software are designed to take away your freedom to share and change it*",
    "gpl2.apply": "this license applies to any program or other work which contains a notice placed by the copyright holder saying it may be distributed under the terms of this general public license*",
    "gpl3.purpose": "the gnu general public license is a free copyleft license for software and other kinds of works*",
    "lgpl21.purpose": "this license the lesser general public license applies to some specially designated software packages*",
    "lgpl3.purpose": "this version of the gnu lesser general public license incorporates the terms and conditions of version 3 of the gnu general public license*",
    "agpl3.purpose": "the gnu affero general public license is a free copyleft license for software and other kinds of works*",
    "mpl2.covered": "covered software means source code form to which the initial contributor has attached the notice in exhibit a*",
    "mpl2.grants": "each contributor hereby grants you a world wide royalty free non exclusive license*",
    "epl.provided": "the accompanying program is provided under the terms of this eclipse public license agreement",
    "artistic2.terms": "this license establishes the terms under which a given free software package may be copied modified distributed and or redistributed",
    "bsl.grant": "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license*",
    "ofl.goals": "the goals of the open font license ofl are to stimulate worldwide development of collaborative font projects*",
    "ofl.grant": "permission is hereby granted free of charge to any person obtaining a copy of the font software*",
    "psf.between": "this license agreement is between the python software foundation psf*",
    "wtfpl.changing": "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed",
    "zlib.asis": "this software is provided as is without any express or implied warranty*",
    "zlib.grant": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely*",
    "postgres.grant": "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted*",
    "openssl.advert": "this product includes software developed by the openssl project for use in the openssl toolkit*",
    "cc0.waive": "to the greatest extent permitted by but not in contravention of applicable law affirmer hereby overtly fully permanently irrevocably and unconditionally waives abandons and surrenders*",
    "public": "this work is in the public domain",
    "all": "all rights reserved",
}

#: The family, name and versions in the headers of the GNU licences.
GNU = (("gpl", "GPL", "gnu general public license", ("2", "3")), ("lgpl", "LGPL", "gnu lesser general public license", ("2 1", "3")), ("lgpl.old", "LGPL", "gnu library general public license", ("2",)), ("agpl", "AGPL", "gnu affero general public license", ("3",)))
_terms = "you can redistribute it and or modify it under the terms of the {} as published by the free software foundation"
_later = "either version {} of the license or at your option any later version"


def _gnu() -> list[tuple[str, tuple[str, ...]]]:
    """The licences that GNU headers name, by sentences. A header is one sentence, or split at its semicolons."""
    out = []
    for family, spdx, name, versions in GNU:
        SENTENCES[f"{family}.terms"] = _terms.format(name)
        for v in versions:
            key, license = v.replace(" ", "_"), f"{spdx}-{v.replace(' ', '.') if ' ' in v else v + '.0'}"
            SENTENCES.setdefault(f"either.{key}", _later.format(v))
            SENTENCES.setdefault(f"version.{key}", f"version {v} of the license")
            SENTENCES.setdefault(f"{family}.{key}later", f"{_terms.format(name)} {_later.format(v)}")
            SENTENCES[f"{family}.{key}only"] = _terms.format(f"{name} version {v}")
            out += [(f"{license}-or-later", (f"{family}.{key}later",)), (f"{license}-or-later", (f"{family}.terms", f"either.{key}")), (f"{license}-only", (f"{family}.{key}only",)), (f"{license}-only", (f"{family}.terms", f"version.{key}"))]
    return out


@dataclass(frozen=True)
class Rule:
    """A licence, and the sentence identifiers that show it, in order."""

    license: str
    sentences: tuple[str, ...]


_headers = _gnu()
#: Earlier rules win. Rules for a licence by its name come last.
RULES = (
    Rule("MIT", ("mit.grant", "mit.notice", "asis")),
    Rule("BSD-4-Clause", ("bsd.grant", "bsd.source", "bsd.binary", "bsd.advert")),
    Rule("BSD-3-Clause", ("bsd.grant", "bsd.source", "bsd.binary", "bsd.endorse", "bsd.asis")),
    Rule("BSD-3-Clause", ("bsd.grant", "bsd.source", "bsd.binary", "bsd.endorse")),
    Rule("BSD-2-Clause", ("bsd.grant", "bsd.source", "bsd.binary")),
    Rule("Apache-2.0", ("name:Apache-2.0", "apache.comply", "apache.copy", "apache.asis")),
    Rule("Apache-2.0", ("name:Apache-2.0", "apache.comply")),
    Rule("Apache-2.0", ("apache.conditions", "apache.define", "apache.copyright")),
    Rule("Apache-2.0", ("apache.define", "apache.copyright")),
    Rule("LGPL-2.1-only", ("gnu.verbatim", "gpl2.purpose", "lgpl21.purpose")),
    Rule("GPL-2.0-only", ("gnu.verbatim", "gpl2.purpose", "gpl2.apply")),
    Rule("GPL-2.0-only", ("gnu.verbatim", "gpl2.purpose")),
    Rule("GPL-3.0-only", ("gnu.verbatim", "gpl3.purpose")),
    Rule("LGPL-2.1-only", ("gnu.verbatim", "lgpl21.purpose")),
    Rule("LGPL-3.0-only", ("gnu.verbatim", "lgpl3.purpose")),
    Rule("AGPL-3.0-only", ("gnu.verbatim", "agpl3.purpose")),
    Rule("Artistic-2.0", ("gnu.verbatim", "artistic2.terms")),
    Rule("MPL-2.0", ("mpl2.covered", "mpl2.grants")),
    Rule("OFL-1.1", ("ofl.goals", "ofl.grant")),
    Rule("Zlib", ("zlib.asis", "zlib.grant")),
    Rule("OpenSSL", ("bsd.grant", "openssl.advert")),
    *(Rule(x, (free, *ids)) for free in ("gpl.free", "gpl.library") for x, ids in _headers),
    *(Rule(x, ids) for x, ids in _headers),
    Rule("MIT", ("mit.grant",)),
    Rule("ISC", ("isc.grant",)),
    Rule("BSL-1.0", ("bsl.grant",)),
    Rule("OFL-1.1", ("ofl.grant",)),
    Rule("Zlib", ("zlib.grant",)),
    Rule("EPL-2.0", ("epl.provided",)),
    Rule("PSF-2.0", ("psf.between",)),
    Rule("WTFPL", ("wtfpl.changing",)),
    Rule("PostgreSQL", ("postgres.grant",)),
    Rule("CC0-1.0", ("cc0.waive",)),
    Rule("MPL-2.0", ("mpl.subject",)),
    Rule("Unlicense", ("unlicense",)),
    Rule("Public-Domain", ("public",)),
    *(Rule(x, (f"name:{x}",)) for x in NAMES),
)

HINT = re.compile(r"licen[sc]e|spdx|permission|redistribut|warrant|rights reserved|public domain|free software|copyright|liable|endorse|neither the name|obtain a copy|advertising materials|this product includes|covered software|font projects|terms and conditions|in the hope that|waives abandons|waives, abandons|(?:released|distributed|published|available|provided|shared)\W+under", re.I)
#: Parts of words, one of which is in whatever ``HINT`` finds; most texts are passed over by these alone.
HINTED = ("licen", "spdx", "permission", "redistribut", "warrant", "reserved", "domain", "free", "copyright", "liable", "endorse", "neither", "obtain", "advertising", "includes", "covered", "font", "conditions", "hope", "abandons", "under")
PIECE = re.compile(r"[^\n]+")
ENDS = re.compile(r"(?<=[.!?;])(?<!\bv\.)\s+|(?<=:)(?<!dentifier:)\s+")
MARKS = re.compile(r"^[\s#/*;%<!-]+")
APART_FROM_WORDS = re.compile(r"[^a-z0-9]+")
GRANT = re.compile(r"^(?:(?:this|the|all|these|our) (?:[a-z]+ ){1,4}?(?:is|are) )?(?:dual )?(?:licensed|released|distributed|published|available|provided|made available|shared) under (?:the )?(?:terms of )?(?:the |a |an )?(.+)$")
PLUS = re.compile(r"(?<=\d)\+(?!\w)")
LATER_WORDS = 12  # more than a match of the following can have
LATER = re.compile(r"(?: of the license)? or (?:at your option )?(?:any )?(?:later|newer)(?: versions?)?(?= |$)")
#: What makes another name of one, and what may follow a name that is a single word.
UNLIKE = {"style", "like", "type", "compatible", "derived", "inspired", "based", "variant"}
FOLLOWS = {"license", "see", "and", "or", "the", "for", "c", "copyright", "as", "with", "https", "http", "except", "unless", "you", "if", "terms", "by"}

_whole = {s: i for i, s in SENTENCES.items() if not s.endswith("*")}
_begins = [(s[:-1].strip(), i) for i, s in SENTENCES.items() if s.endswith("*")]
_names = {n: x for x, names in NAMES.items() for n in names} | {APART_FROM_WORDS.sub(" ", x.lower()).strip(): x for x in NAMES}

_words = max(n.count(" ") + 1 for n in _names)
#: The words of the longest known sentence; a grant's words before its name are fewer.
_longest = max(s.count(" ") + 1 for s in SENTENCES.values()) + 16


def normal(sentence: str) -> str:
    """Lower case, without comment marks, and with single spaces for all but letters and digits."""
    lines = (MARKS.sub("", x) for x in PLUS.sub(" or later", sentence.lower()).replace("licence", "license").split("\n"))
    return APART_FROM_WORDS.sub(" ", " ".join(lines)).strip()


def named(words: list[str], at: int = 0) -> tuple[str | None, int]:
    """The licence whose name the words from a place on begin with, and the number of words it takes. The longest name counts."""
    for n in range(min(_words, len(words) - at), 0, -1):
        name = _names.get(" ".join(words[at : at + n]))
        after, then = [*words[at + n : at + n + 2], "", ""][:2]
        if name is None or after in UNLIKE or (after == "license" and then in UNLIKE):
            continue
        if (n == 1 and after and words[at].isalpha() and words[at] != "unlicense" and after not in FOLLOWS) or (words[at + n - 1][-1].isdigit() and re.fullmatch(r"\d\d?", after)):
            continue
        later = LATER.match(" " + " ".join(words[at + n : at + n + LATER_WORDS]))
        if later and name.endswith("-only"):
            return name.removesuffix("-only") + "-or-later", n + len(later[0].split())
        return name, n
    return None, 0


def expression(words: list[str], at: int, whole: bool) -> list[str]:
    """The licences that the words from a place on name, joined by "or" and "and".

    In a ``whole`` expression unknown names and exceptions are passed over.
    """
    out: dict[str, None] = {}
    while at < len(words):
        name, n = named(words, at)
        if name:
            out[name] = None
        at += n
        if name and words[at : at + 1] == ["license"]:
            at += 1
        if at < len(words) and words[at] not in ("or", "and"):
            if not whole or (name and words[at] != "with"):
                break
            while at < len(words) and words[at] not in ("or", "and"):
                at += 1
        at += 1
        while at < len(words) and words[at] in ("the", "a", "under", "terms", "of"):
            at += 1
    return list(out)


def _spdx_ends(words: list[str]) -> list[int]:
    """The places after each "SPDX license identifier" that something follows."""
    return [i + 3 for i in range(len(words) - 3) if words[i + 1] == "license" and words[i + 2] == "identifier" and words[i].endswith("spdx")]


def identifiers(words: list[str], at: int = 0, tags: list[int] | None = None) -> list[str]:
    """The identifiers of the normalised sentence that begins at a place among words and goes on to their end.

    Gives that of a known sentence, or those of the licences that it names.
    ``tags`` are the places after SPDX tags, if known. Only as many words are
    read as a sentence or name can have, so all places cost about the same.
    """
    left = len(words) - at
    known = _whole.get(" ".join(words[at:])) if left <= _longest else None
    if known:
        return [known]
    begin = " ".join(words[at : at + _longest])
    grant = GRANT.match(begin)
    if grant:
        # the name's words stand at the end of what was read
        return [f"name:{x}" for x in expression(words, at + min(left, _longest) - len(grant[1].split()), False)]
    tags = [t for t in (_spdx_ends(words) if tags is None else tags) if t - 3 >= at]
    found: dict[str, None] = {}
    for i, t in enumerate(tags):
        found |= dict.fromkeys(expression(words[t : tags[i + 1] - 3 if i + 1 < len(tags) else len(words)], 0, True))
    if found:
        return [f"name:{x}" for x in found]
    return [i for start, i in _begins if begin.startswith(start)][:1]


def identify(sentence: str) -> str | None:
    """The first identifier of a normalised sentence, if it is a known one."""
    return next(iter(identifiers(sentence.split())), None)


def sequence(text: str | None) -> list[tuple[int, str]]:
    """The places (code points) and identifiers of a text's known sentences.

    A sentence may end with its line, or go on over lines; both are looked up.
    """
    low = (text or "").lower()
    if not any(part in low for part in HINTED) or not HINT.search(text):
        return []
    found: dict[int, list[str]] = {}
    at = 0
    for gap in [*ENDS.finditer(text), None]:
        sentence = text[at : gap.start() if gap else len(text)]
        if HINT.search(sentence):
            place = at + len(sentence) - len(sentence.lstrip())
            lines = [(x.start(), x[0], normal(x[0]).split()) for x in PIECE.finditer(sentence)]
            words = [w for _, _, own in lines for w in own]
            tags = _spdx_ends(words)
            known = identifiers(words, 0, tags)
            several = "\n" in sentence.strip()
            if known and not (several and tags):
                found.setdefault(place, known)
            # a name may be followed by other words, among them further lines
            if several and (not known or known[0].startswith("name:")):
                # lines of marks before the first words belong to it
                begin = next((start for start, _, own in lines if own), 0) if known else -1
                for start, line, own in lines:
                    known = HINT.search(line) and identifiers(own)
                    if known:
                        found.setdefault(place if start == begin else max(place, at + start), known)
                # a line break may have ended the sentence before, and the last sentence go on over lines
                first = 0
                for start, _, own in lines:
                    if own and not (tags and tags[-1] - 3 >= first):
                        known = identifiers(words, first, [])
                        if known:
                            found[place if start == begin else max(place, at + start)] = known
                            break
                    first += len(own)
        at = gap.end() if gap else len(text)
    return [(k, i) for k, ids in sorted(found.items()) for i in ids]


def match(ids: list[str], rules: tuple[Rule, ...] = RULES) -> tuple[list[tuple[int, str]], list[int]]:
    """The rules' licences with the place of their first sentence in the sequence, and the places that no rule used."""
    free = [True] * len(ids)
    out = []
    for rule in rules:
        start = 0
        while start < len(ids):
            if not (free[start] and ids[start] == rule.sentences[0]):
                start += 1
                continue
            used = [start]
            for want in rule.sentences[1:]:
                nxt = next((j for j in range(used[-1] + 1, min(len(ids), used[-1] + 1 + APART)) if free[j] and ids[j] == want), None)
                if nxt is None:
                    break
                used.append(nxt)
            if len(used) == len(rule.sentences):
                for j in used:
                    free[j] = False
                out.append((start, rule.license))
            start += 1
    return sorted(out), [j for j, f in enumerate(free) if f]


def scan(docs: DataFrame) -> DataFrame:
    """One row a document: the licences in order of place, the sentence sequence, and what no rule used."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, places, sequences, rest = [], [], [], []
            for text in batch.column("text"):
                found = sequence(text.as_py())
                ids = [i for _, i in found]
                hits, left = match(ids)
                first: dict[str, int] = {}
                for at, name in hits:
                    first.setdefault(name, found[at][0])
                names.append(list(first))
                places.append(list(first.values()))
                sequences.append(",".join(f"{i}@{at}" for at, i in found))
                rest.append(",".join(ids[j] for j in left))
            counts = pa.array([s.count("@") for s in sequences], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([",".join(n) for n in names], pa.string()), counts, pa.array(sequences, pa.string()), pa.array(rest, pa.string()), pa.array(places, pa.list_(pa.int64()))],
                names=["doc_id", "licenses", "n_sentences", "sentences", "unmatched", "places"],
            )

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, licenses string, n_sentences long, sentences string, unmatched string, places array<long>")
