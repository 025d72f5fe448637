"""Every shipped licence rule on its canonical text, wrapped and unwrapped, and rules against brute force."""

import random
import re
import textwrap

from lakeforge.llm.licenses import RULES, SPDX, scan_licenses, sentences

APACHE = [
    'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at',
    "http://www.apache.org/licenses/LICENSE-2.0",
    'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
]
MIT = [
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE.',
]
HOPE = "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU General Public License for more details."
GPL3 = ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", HOPE]
GPL2 = [GPL3[0].replace("software:", "software;").replace("Foundation, either version 3", "Foundation; either version 2"), HOPE]
BSD2 = [
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
]
BSD3 = [*BSD2, "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."]
CANONICAL = {
    "apache-2.0.header": APACHE,
    "apache-2.0.notice": ["Licensed under the Apache License, Version 2.0."],
    "apache-2.0.spdx": ["SPDX-License-Identifier: Apache-2.0"],
    "mit.text": MIT,
    "mit.notice": ["Released under the MIT License."],
    "mit.licensed": ["Licensed under the MIT License."],
    "mit.spdx": ["SPDX-License-Identifier: MIT"],
    "gpl-3.0.header": GPL3,
    "gpl-3.0.notice": ["This work is licensed under the GNU General Public License, version 3."],
    "gpl-3.0.spdx": ["SPDX-License-Identifier: GPL-3.0-or-later"],
    "gpl-2.0.header": GPL2,
    "bsd-3-clause.text": BSD3,
    "bsd-2-clause.text": BSD2,
    "cc-by-4.0.notice": ["Licensed under CC BY 4.0."],
    "cc-by-4.0.work": ["This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc-by-nc-4.0.notice": ["Licensed under CC BY-NC 4.0."],
    "cc-by-sa-4.0.notice": ["Licensed under CC BY-SA 4.0."],
    "cc0-1.0.notice": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "mit.project": ["This project is licensed under the MIT License - see the LICENSE file for details."],
    "mit.project_short": ["This project is licensed under the MIT License."],
    "mit.title": ["The MIT License", "Copyright (c) Foo"],
    "gpl-2.0-only.header": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.", HOPE],
    **{n: [GPL3[0].replace("General", f"{kind} General").replace("version 3", f"version {v}"), HOPE.replace("GNU", f"GNU {kind}")] for n, kind, v in (("lgpl-2.1.header", "Lesser", "2.1"), ("lgpl-3.0.header", "Lesser", "3"), ("agpl-3.0.header", "Affero", "3"))},
    "isc.text": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.',
    ],
    "epl-2.0.notice": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at", "https://www.eclipse.org/legal/epl-2.0/"],
    **{f"spdx.{i.lower()}": [f"SPDX-License-Identifier: {i}"] for i in SPDX},
    "mpl-2.0.notice": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
}


def test_each_rule_holds_in_its_canonical_text(spark):
    assert CANONICAL.keys() == RULES.keys()
    rows, names = [], {}
    for name, paragraphs in CANONICAL.items():
        lines = {w: "\n\n".join(textwrap.fill(p, w, break_long_words=False) for p in paragraphs) for w in (80, 40, 17)}
        forms = ["\n\n".join(paragraphs), " ".join(paragraphs), textwrap.fill(" ".join(paragraphs), 61), *lines.values(), lines[80].replace("\n", "\r\n")]
        forms += [re.sub("(?m)^", mark, lines[80]) for mark in (" * ", "# ", "// ", ";; ", "! ")]
        for text in forms:
            for around in ("{}", "Some words first.\n\n{}\n\nSome words after."):
                names[len(rows)] = name
                rows.append((len(rows), around.format(text)))
    got = {(r.doc_id, r.rule) for r in scan_licenses(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    missing = {(n, rows[i][1]) for i, n in names.items() if (i, n) not in got}
    assert not missing
    # and nothing but the shorter rules that are part of it
    part = {"apache-2.0.header": {"apache-2.0.notice"}}
    part |= {n: {"mit.licensed", "mit.project_short"} for n in ("mit.licensed", "mit.notice", "mit.project", "mit.project_short")}
    assert all(r == names[i] or r in part.get(names[i], ()) for i, r in got)


def test_words_around_a_sentence_and_gaps_do_not_hold(spark):
    rows = [(1, "not licensed under the MIT license"), (2, "Licensed under the MIT license of old"), (3, "SPDX-License-Identifier: MIT AND Zlib"), (4, " ".join(GPL3).replace("; without even", "; nor even")), (5, None), (6, ""), (None, "Licensed under the\n\nMIT License")]
    assert [(r.doc_id, r.rule) for r in scan_licenses(spark.createDataFrame(rows, "doc_id int, text string")).collect()] == [(None, "mit.licensed")]


def test_rules_against_brute_force(spark):
    rng = random.Random(8)
    known = {"a": "x", "b": "x y", "c": "y z", "d": "z", "e": "x y z x"}
    rules = {f"r{i}": ("L", [rng.choice("abcde") for _ in range(rng.randint(1, 3))]) for i in range(25)}
    rows = [(i, "".join(rng.choice(["x", "y", "z", "q", "x", "y"]) + rng.choice([" ", ". ", "\n", "; ", ".\n\n"]) for _ in range(rng.randint(0, 9)))) for i in range(150)]
    pairs = {p for _, ids in rules.values() for p in zip(ids, ids[1:], strict=False)}
    want = set()
    for i, text in rows:
        words, frag, cuts, n = [], [], {0}, 0
        for part in re.split(r"[.!?;:]+(?:\s+|$)|[\r\n]+", text):
            cuts.add(len(words))
            words += part.split()
            frag += [n] * len(part.split())
            n += 1
        cuts.add(len(words))
        at = lambda j, s, w=words: w[j : j + len(s.split())] == s.split()
        for p, q in pairs:
            cuts |= {j + len(known[p].split()) for j in range(len(words)) if at(j, known[p]) and at(j + len(known[p].split()), known[q])}
        hits = [(j, j + len(s.split()), k) for k, s in known.items() for j in range(len(words)) if at(j, s) and j in cuts and j + len(s.split()) in cuts]
        def grown(chains, ids, hits=hits):
            for k in ids:
                chains = [(f, y) for f, x in chains for y in hits if y[2] == k and y[0] >= x[1] and not any(z[0] >= x[1] and z[1] <= y[0] for z in hits)]
            return chains

        for name, (_, ids) in rules.items():
            chains = grown([(h[0], h) for h in hits if h[2] == ids[0]], ids[1:])
            rests = [other[len(ids) :] for _, other in rules.values() if len(other) > len(ids) and other[: len(ids)] == ids]
            chains = [c for c in chains if not any(grown([c], rest) for rest in rests)]
            if chains:
                want.add((i, name, frag[min(f for f, _ in chains)]))
    got = scan_licenses(spark.createDataFrame(rows, "doc_id int, text string"), known=known, rules=rules).collect()
    assert len(got) == len(want) and {(r.doc_id, r.rule, r.first_sentence) for r in got} == want


def test_names_fill_slots(spark):
    free = "{} is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    hope = HOPE.replace("This program", "{}")
    bsd = "\n".join(BSD2) + "\n3. Neither the name of {} may be used to endorse or promote products derived from this software without specific prior written permission."
    forms = {
        (free + "\n\n" + hope).format("Foo", "Foo"): {"gpl-3.0.header"},
        textwrap.indent(textwrap.fill((free + " " + hope).format("The Foo++ tool set", "Foo"), 70), " * "): {"gpl-3.0.header"},
        free.format("Foo"): set(),
        bsd.format("Foo, Inc. nor the names of its contributors"): {"bsd-3-clause.text"},
        bsd.format("the University of X\nnor the\n   names of any other contributors"): {"bsd-3-clause.text"},
        bsd.format("the copyright holder nor its contributors"): {"bsd-3-clause.text"},
        bsd.format("Foo nor its contributors") + "\n\n" + "\n".join(BSD2): {"bsd-2-clause.text", "bsd-3-clause.text"},
        bsd.format("x" * 121 + " nor the names of its contributors"): {"bsd-2-clause.text"},
        "/* SPDX-License-Identifier: GPL-2.0-only */": {"spdx.gpl-2.0-only"},
        "# SPDX-License-Identifier: GPL-3.0-only\nimport x": {"spdx.gpl-3.0-only"},
        "SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0": set(),
        "MIT License\n\nCopyright (c) 2020 Foo": {"mit.title"},
        "This project is licensed under the MIT License - see the [LICENSE](LICENSE.md) file for details": {"mit.project"},
        "Neither the name of the game nor its contributors matter. Foo is free software.": set(),
    }
    rows = list(enumerate(forms))
    got = {i: set() for i, _ in rows}
    for r in scan_licenses(spark.createDataFrame(rows, "doc_id int, text string")).collect():
        got[r.doc_id].add(r.rule)
    assert got == dict(enumerate(forms.values()))


def test_slots_and_sentences_are_numbered_alike(spark):
    text = "One. Two.\nNeither the name of A. B. Inc. nor the names of its\ncontributors.\nMIT License\n\nCopyright 2020 X"
    row = spark.createDataFrame([(1, text)], "doc_id int, text string")
    hit = scan_licenses(row).first()
    assert row.select(sentences(row.text).alias("s")).first().s[hit.first_sentence] == "mit license copyright"
