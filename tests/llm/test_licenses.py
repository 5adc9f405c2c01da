import random
import time

import pytest

from palimpsest.llm import licenses

MIT = """Copyright (c) 2020 X

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction.

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED."""
BSD3 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
# Redistributions of source code must retain the above copyright notice.
# Redistributions in binary form must reproduce the above copyright notice.
# Neither the name of X nor the names of its contributors may be used."""


def names(text):
    found = licenses.sequence(text)
    return [n for _, n in licenses.match([i for _, i in found])[0]]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        (MIT, ["MIT"]), (BSD3, ["BSD-3-Clause"]), (BSD3.rsplit("\n", 1)[0], ["BSD-2-Clause"]), ("Released under the MIT License.", ["MIT"]),
        ("words before\nLicensed under the Apache License, Version 2.0.\nwords after.", ["Apache-2.0"]),
        ("Licensed under CC BY-NC 4.0.", ["CC-BY-NC-4.0"]), ("This work is licensed under the GNU General Public License, version 3.", ["GPL-3.0-only"]),
        ("// SPDX-License-Identifier: MPL-2.0", ["MPL-2.0"]), ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", ["GPL-3.0-or-later"]),
        ("Licensed under the Apache\nLicense, Version 2.0.", ["Apache-2.0"]), ("He lost his driving licence.", []), ("Licensed under the Moon License.", []), ("", []), (None, []),
        ("Released under the MIT License. Words. Licensed under CC BY 4.0.", ["MIT", "CC-BY-4.0"]),
    ],
)
def test_licences(text, want):
    assert names(text) == want


APACHE = """/*
 * Copyright 2020 X
 *
 * Licensed under the Apache License, Version 2.0 (the "License");
 * you may not use this file except in compliance with the License.
 * You may obtain a copy of the License at
 *
 *     http://www.apache.org/licenses/LICENSE-2.0
 *
 * Unless required by applicable law or agreed to in writing, software
 * distributed under the License is distributed on an "AS IS" BASIS,
 * WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
 */"""


def gnu(thing, name, version, mark=";"):
    return f"""# This {thing} is free software{":" if mark == "," else ";"} you can redistribute it and/or modify
# it under the terms of the GNU {name} as published by
# the Free Software Foundation{mark} either version {version} of the License, or
# (at your option) any later version.
#
# This {thing} is distributed in the hope that it will be useful,
# but WITHOUT ANY WARRANTY."""


@pytest.mark.parametrize(
    ("text", "want"),
    [
        (APACHE, ["Apache-2.0"]), (gnu("program", "General Public License", 2), ["GPL-2.0-or-later"]), (gnu("program", "General Public License", 3, ","), ["GPL-3.0-or-later"]),
        (gnu("library", "Lesser General Public License", "2.1"), ["LGPL-2.1-or-later"]), (gnu("library", "Library General Public License", 2), ["LGPL-2.0-or-later"]), (gnu("program", "Affero General Public License", 3, ","), ["AGPL-3.0-or-later"]),
        ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.", ["GPL-2.0-only"]),
        ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", ["MPL-2.0"]),
        ("This project is licensed under the MIT License - see the LICENSE file for details.", ["MIT"]), ("Released under MIT.", ["MIT"]), ("Available under CC BY 4.0.", ["CC-BY-4.0"]),
        ("SPDX-License-Identifier: GPL-2.0", ["GPL-2.0-only"]), ("// SPDX-License-Identifier: GPL-2.0+\n// x", ["GPL-2.0-or-later"]), ("# SPDX-License-Identifier: (MIT OR Apache-2.0)", ["MIT", "Apache-2.0"]),
        ("/* SPDX-License-Identifier: GPL-2.0 WITH Linux-syscall-note OR BSD-3-Clause */", ["GPL-2.0-only", "BSD-3-Clause"]), ("SPDX-License-Identifier: LicenseRef-X AND MIT", ["MIT"]),
        ("Licensed under the GPL version 2 or (at your option) any later version.", ["GPL-2.0-or-later"]), ("Licensed under either the MIT-style license.", []), ("Licensed under an MIT-style license.", []),
        ("Published under MIT Press rules.", []), ("Released under the MIT License\nLicensed under CC BY 4.0\nwords", ["MIT", "CC-BY-4.0"]), ("Licensed under the MIT license or the Apache License, Version 2.0.", ["MIT", "Apache-2.0"]),
    ],
)
def test_headers_as_they_stand(text, want):
    assert names(text) == want


def test_order_matters_and_sentences_are_used_once():
    rule = licenses.Rule("R", ("a", "b"))
    assert licenses.match(["b", "a"], (rule,)) == ([], [0, 1])
    assert licenses.match(["a", "x", "b", "a"], (rule, licenses.Rule("S", ("a",)))) == ([(0, "R"), (3, "S")], [1])
    far = ["a", *["x"] * licenses.APART, "b"]
    assert licenses.match(far, (rule,))[0] == []


def test_every_rule_can_match():
    known = {*licenses.SENTENCES, *(f"name:{n}" for n in licenses.NAMES)}
    for rule in licenses.RULES:
        assert set(rule.sentences) <= known
    for spdx, own in licenses.NAMES.items():
        assert all(licenses.identify(f"licensed under the {n}") == f"name:{spdx}" for n in own)


def test_awkward_rows(awkward, nothing):
    rows = licenses.scan(awkward)
    assert rows.count() == awkward.count() and {r["licenses"] for r in rows.collect()} == {""}
    assert licenses.scan(nothing).count() == 0


def test_places(spark):
    row = licenses.scan(spark.createDataFrame([(1, "é x.\nReleased under the MIT License.\nAgain. Released under the MIT License.")], "doc_id long, text string")).first()
    assert (row["licenses"], row["places"], row["n_sentences"]) == ("MIT", [5], 2)


def plain_match(ids, rules):
    """All places of a rule's sentences, tried one by one from the left; the nearest next place counts."""
    used, hits = set(), []
    for rule in rules:
        for start in range(len(ids)):
            places = []
            for want in rule.sentences:
                options = [start] if not places else range(places[-1] + 1, places[-1] + 1 + licenses.APART)
                at = [j for j in options if j < len(ids) and j not in used and ids[j] == want]
                if not at:
                    break
                places.append(at[0])
            if len(places) == len(rule.sentences):
                used |= set(places)
                hits.append((start, rule.license))
    return sorted(hits), [j for j in range(len(ids)) if j not in used]


def test_match_as_brute_force():
    rng = random.Random(5)
    rules = tuple(licenses.Rule(f"L{i}", tuple(rng.choice("abcd") for _ in range(n))) for i, n in enumerate((4, 3, 3, 2, 2, 1)))
    for _ in range(3000):
        ids = [rng.choice("abcdx") for _ in range(rng.randrange(16))]
        assert licenses.match(ids, rules) == plain_match(ids, rules)


WHOLE = {
    "Apache-2.0": 'Apache License\nVersion 2.0, January 2004\n\nTERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION\n\n1. Definitions.\n\n"License" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document.\n\n"You" shall mean an individual.\n\n2. Grant of Copyright License. Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce.',
    "GPL-2.0-only": "GNU GENERAL PUBLIC LICENSE\nVersion 2, June 1991\n\nEveryone is permitted to copy and distribute verbatim copies\nof this license document, but changing it is not allowed.\n\nPreamble\n\nThe licenses for most software are designed to take away your\nfreedom to share and change it.  By contrast, more.",
    "GPL-3.0-only": "GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007\n\nEveryone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.\n\nThe GNU General Public License is a free, copyleft license for\nsoftware and other kinds of works.",
    "LGPL-2.1-only": "Everyone is permitted to copy and distribute verbatim copies\nof this license document, but changing it is not allowed.\n\nThe licenses for most software are designed to take away your freedom to share and change it.\n\nThis license, the Lesser General Public License, applies to some\nspecially designated software packages--typically libraries--of the Free Software Foundation.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable.\n\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "BSL-1.0": 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use.',
    "BSD-4-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n1. Redistributions of source code must retain the above copyright notice.\n2. Redistributions in binary form must reproduce the above copyright notice.\n3. All advertising materials mentioning features or use of this software must display the following acknowledgement:\nThis product includes software.",
    "WTFPL": "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.",
}


def test_whole_texts():
    for want, text in WHOLE.items():
        found = licenses.sequence(text)
        hits, _ = licenses.match([i for _, i in found])
        assert [name for _, name in hits][:1] == [want] and len({n for _, n in hits}) == 1, (want, found)


def test_long_texts():
    began = time.monotonic()
    for text in ("\n".join(f"copyright of line {i} here" for i in range(30_000)), "\n".join(f"licensed under the MIT license {i}" for i in range(20_000)), "licensed under " + " or ".join(["MIT", "Apache-2.0"] * 50_000), "SPDX-License-Identifier: MIT " * 30_000):
        licenses.match([i for _, i in licenses.sequence(text)])
    assert time.monotonic() - began < 20


def test_every_known_sentence_has_a_hint():
    assert [i for i, x in licenses.SENTENCES.items() if not licenses.HINT.search(x)] == []


def test_every_hint_has_a_part_that_is_looked_for_first():
    # "waives, abandons" and its like: one branch of the pattern after the other
    for branch in licenses.HINT.pattern.split("|"):
        words = branch.replace("[sc]", "s").replace("(?:", "").replace(")", "").replace(r"\W+", " ")
        assert any(part in words for part in licenses.HINTED) or words in ("released", "distributed", "published", "available", "provided"), branch
