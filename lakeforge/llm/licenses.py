"""Licence scans by sentence rules: known sentences to identifiers, identifier sequences to licences.

A text is cut into fragments at marks and line ends, which are normalised (lower case,
letters and digits, single spaces). A known sentence stands in a text where fragments in
a row make it up, be it one or many: sentences hold marks (`; without`, `v. 2.0`) and
wrapped lines, with comment marks or without. Names of projects and organisations fill slots
of known sentences, and a title stands before a line of copyright. A rule is an ordered list of identifiers; it
holds where the text's sentences have that list in a row (fragments that are no part of a
known sentence may stand between) and don't go on as a longer rule with that beginning: three
clauses aren't two. Built-in functions on one row at a time: no shuffle, no
Python on the executors.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Normalised sentences of public licences and the usual notices, by identifier.
SENTENCES = {
    "apache2.notice": "licensed under the apache license version 2 0",
    "apache2.header": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license",
    "apache2.copy": "you may obtain a copy of the license at http www apache org licenses license 2 0",
    "apache2.as_is": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache2.see": "see the license for the specific language governing permissions and limitations under the license",
    "apache2.spdx": "spdx license identifier apache 2 0",
    "mit.notice": "released under the mit license",
    "mit.licensed": "licensed under the mit license",
    "mit.title": "mit license copyright",
    "mit.grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit.keep": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit.as_is": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "mit.spdx": "spdx license identifier mit",
    "gpl3.notice": "this work is licensed under the gnu general public license version 3",
    "gpl3.free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl2.free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl.hope": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "gpl.see": "see the gnu general public license for more details",
    "gpl3.spdx": "spdx license identifier gpl 3 0 or later",
    "bsd.redistribute": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd.source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd.binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd.endorse": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "ccby.notice": "licensed under cc by 4 0",
    "ccbync.notice": "licensed under cc by nc 4 0",
    "ccbysa.notice": "licensed under cc by sa 4 0",
    "ccby.work": "this work is licensed under a creative commons attribution 4 0 international license",
    "cc0.notice": "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work",
    "mit.project": "this project is licensed under the mit license see the license file for details",
    "mit.project_short": "this project is licensed under the mit license",
    "gpl2only.free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation",
    "lgpl21.free": "this program is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    "lgpl3.free": "this program is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "lgpl.see": "see the gnu lesser general public license for more details",
    "agpl3.free": "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "agpl.see": "see the gnu affero general public license for more details",
    "isc.grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "isc.as_is": "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    "epl2.terms": "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at",
    "epl2.at": "https www eclipse org legal epl 2 0",
    "mpl2.notice": "this source code form is subject to the terms of the mozilla public license v 2 0",
}
# Identifiers of the SPDX list that are looked for behind its tag, beside the three above.
SPDX = (
    "0BSD", "AFL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later", "Artistic-2.0", "BlueOak-1.0.0", "BSD-2-Clause", "BSD-3-Clause", "BSD-4-Clause", "BSL-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC0-1.0",
    "CDDL-1.0", "EPL-1.0", "EPL-2.0", "EUPL-1.2", "GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0", "GPL-3.0-only", "ISC", "LGPL-2.1", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only",
    "LGPL-3.0-or-later", "MIT-0", "MPL-1.1", "MPL-2.0", "MS-PL", "NCSA", "OFL-1.1", "PostgreSQL", "Python-2.0", "Unlicense", "UPL-1.0", "WTFPL", "Zlib",
)
_TAG = "spdx license identifier"
SENTENCES |= {f"spdx.{i.lower()}": f"{_TAG} {' '.join(re.findall(r'[a-z0-9]+', i.lower()))}" for i in SPDX}
# Rules, each a licence and its sentence identifiers in order.
RULES = {
    "apache-2.0.header": ("Apache-2.0", ["apache2.header", "apache2.copy", "apache2.as_is", "apache2.see"]),
    "apache-2.0.notice": ("Apache-2.0", ["apache2.notice"]),
    "apache-2.0.spdx": ("Apache-2.0", ["apache2.spdx"]),
    "mit.text": ("MIT", ["mit.grant", "mit.keep", "mit.as_is"]),
    "mit.notice": ("MIT", ["mit.notice"]),
    "mit.licensed": ("MIT", ["mit.licensed"]),
    "mit.spdx": ("MIT", ["mit.spdx"]),
    "gpl-3.0.header": ("GPL-3.0", ["gpl3.free", "gpl.hope", "gpl.see"]),
    "gpl-3.0.notice": ("GPL-3.0", ["gpl3.notice"]),
    "gpl-3.0.spdx": ("GPL-3.0", ["gpl3.spdx"]),
    "gpl-2.0.header": ("GPL-2.0", ["gpl2.free", "gpl.hope", "gpl.see"]),
    "bsd-3-clause.text": ("BSD-3-Clause", ["bsd.redistribute", "bsd.source", "bsd.binary", "bsd.endorse"]),
    "bsd-2-clause.text": ("BSD-2-Clause", ["bsd.redistribute", "bsd.source", "bsd.binary"]),
    "cc-by-4.0.notice": ("CC-BY-4.0", ["ccby.notice"]),
    "cc-by-4.0.work": ("CC-BY-4.0", ["ccby.work"]),
    "cc-by-nc-4.0.notice": ("CC-BY-NC-4.0", ["ccbync.notice"]),
    "cc-by-sa-4.0.notice": ("CC-BY-SA-4.0", ["ccbysa.notice"]),
    "cc0-1.0.notice": ("CC0-1.0", ["cc0.notice"]),
    "mpl-2.0.notice": ("MPL-2.0", ["mpl2.notice"]),
    "mit.project": ("MIT", ["mit.project"]),
    "mit.project_short": ("MIT", ["mit.project_short"]),
    "mit.title": ("MIT", ["mit.title"]),
    "gpl-2.0-only.header": ("GPL-2.0-only", ["gpl2only.free", "gpl.hope", "gpl.see"]),
    "lgpl-2.1.header": ("LGPL-2.1", ["lgpl21.free", "gpl.hope", "lgpl.see"]),
    "lgpl-3.0.header": ("LGPL-3.0", ["lgpl3.free", "gpl.hope", "lgpl.see"]),
    "agpl-3.0.header": ("AGPL-3.0", ["agpl3.free", "gpl.hope", "agpl.see"]),
    "isc.text": ("ISC", ["isc.grant", "isc.as_is"]),
    "epl-2.0.notice": ("EPL-2.0", ["epl2.terms", "epl2.at"]),
}
RULES |= {f"spdx.{i.lower()}": (i, [f"spdx.{i.lower()}"]) for i in SPDX}
_W = r"[^\p{L}\p{N}]+"
_WORD = r"[\p{L}\p{N}](?:[\p{L}\p{N}_.-]{0,38}[\p{L}\p{N}])?\+{0,2}"
_NAME = rf"{_WORD}(?:[ \t]+{_WORD}){{0,4}}?[ \t]+is"
#: Slots: (words that a text needs for it, pattern, what it becomes). A name, an organisation or a project stands where the known sentence has its usual words; one of a project has up to five words of up to 40 letters, one of an organisation up to 120 characters.
SLOTS = (
    (("neither", "contributors"), _W.join(["neither", "the", "names?", "of", "(?s:.{1,120}?)", "nor", "the", "names", "of", f"(?:its|their|other|any{_W}other)", "contributors"]), "neither the name of the copyright holder nor the names of its contributors"),
    (("neither", "contributors"), _W.join(["neither", "the", "names?", "of", "(?s:.{1,120}?)", "nor", "its", "contributors"]), "neither the name of the copyright holder nor the names of its contributors"),
    (("software", "redistribute"), _W.join([_NAME, "free", "software", "you", "can", "redistribute"]), "this program is free software you can redistribute"),
    (("see", "license", "file"), _W.join(["see", "the", rf"license(?:{_W}(?:license|md|txt))*", "file"]), "see the license file"),
    (("mit", "license", "copyright"), rf"(?:^|[\r\n])[^\p{{L}}\p{{N}}\r\n]*(?:the{_W})?mit{_W}license(?:[^\p{{L}}\p{{N}}\r\n]*[\r\n][^\p{{L}}\p{{N}}]*|[ \t]+)copyright[^\r\n]*", "\nmit license copyright"),
    (("distributed", "hope"), _W.join([_NAME, "distributed", "in", "the", "hope"]), "this program is distributed in the hope"),
)
_BREAK, _SOFT = "\u0001", "\u0002"
_FAR = 2**31 - 1
_END = r"[.!?;:]+(?:\s+|$)|[\r\n]+"


def _filled(text: Column) -> Column:
    """The text in lower case, null as empty, with what stands in a slot replaced by the known sentence's words."""
    out = F.array(F.lower(F.coalesce(text, F.lit(""))))  # a lambda's text is worked out once, however often it is named
    for needs, pattern, words in SLOTS:
        out = F.transform(out, lambda t: F.when(reduce(and_, (F.contains(t, F.lit(w)) for w in needs)), F.regexp_replace(t, pattern, words)).otherwise(t))
    return F.get(out, 0)


def sentences(text: Column) -> Column:
    """Normalised sentences, slots filled: cut at `.!?;:` before space or at line ends; only letters and digits count."""
    cut = F.regexp_replace(_filled(text), _END, _BREAK)
    return F.transform(F.split(F.regexp_replace(cut, rf"[^\p{{L}}\p{{N}}{_BREAK}]+", " "), _BREAK), lambda s: F.trim(s))


def scan_licenses(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", known: dict[str, str] | None = None, rules: dict[str, tuple[str, list[str]]] | None = None) -> DataFrame:
    """Each rule that holds in a text: id_col, rule, license, first_sentence (from 0, at its first match), n_sentences.

    A known sentence starts and ends at cuts, or where a rule's next sentence follows without one (a text on a single
    line). All that stand in a text count, also one within another; the next sentence of a rule must start after the
    last one's end, and no known sentence may stand between. first_sentence is the number of the fragment, as
    `sentences` numbers them, at which the rule's first sentence starts.

    Every rule that holds is returned, once a text. Where a rule's list goes on to that of a longer rule which begins
    with it, the longer one holds there and the shorter one doesn't (it may elsewhere in the text). A null or empty text has
    no sentence. One set of rows per input row, whatever its id; other columns don't take part; an empty table, or
    no rules, gives no rows.
    """
    known, rules = known if known is not None else SENTENCES, rules if rules is not None else RULES
    by_text = {v: k for k, v in known.items()}
    if not by_text or not rules:
        return df.select(id_col, F.lit("").alias("rule"), F.lit("").alias("license"), F.lit(0).alias("first_sentence"), F.lit(0).alias("n_sentences")).where("false")
    table = F.create_map(*(F.lit(x) for kv in by_text.items() for x in kv))
    texts = lambda ids: F.array(*map(F.lit, ids)).cast("array<string>")
    rests = lambda ids: F.array(*map(texts, _rests(ids, rules))).cast("array<array<string>>")
    listed = F.array(*(F.struct(F.lit(name).alias("rule"), F.lit(lic).alias("license"), texts(ids).alias("ids"), rests(ids).alias("rests"), F.lit(len(ids)).alias("n_sentences")) for name, (lic, ids) in rules.items()))
    # Only texts whose words hold a known sentence's, whatever stands between them, go on.
    short = {_TAG if k.startswith(_TAG) else k for k in by_text}
    least = sorted(k for k in short if not any(o != k and o in k for o in short))
    df = df.select(F.col(id_col), _filled(F.col(text_col)).alias(text_col))
    plain = F.regexp_replace(F.col(text_col), r"[^\p{L}\p{N}]+", " ")
    some = df.where(F.exists(F.array(plain), lambda p: reduce(or_, (F.contains(p, F.lit(k)) for k in least))))
    held = some.select(F.col(id_col).alias("id"), F.explode(F.transform(F.array(_hits(_pieces(F.col(text_col), known, rules), table, by_text)), _with_next)).alias("hits"))
    held = held.select("id", "hits", F.explode(F.filter(listed, lambda r: F.size(F.array_except(r["ids"], F.col("hits")["id"])) == 0)).alias("r"))
    held = held.select("id", "r.rule", "r.license", F.array_min(_ended(F.col("hits"), _chains(F.col("hits"), F.col("r.ids")), F.col("r.rests"))["at"]).alias("first_sentence"), "r.n_sentences")
    return held.where("first_sentence is not null").withColumnRenamed("id", id_col)


def _pieces(text: Column, known: dict[str, str], rules: dict[str, tuple[str, list[str]]]) -> Column:
    """(at, s): fragments of a text with filled slots, with their numbers, without empty ones, also cut where a rule's next sentence follows."""
    cut = F.regexp_replace(text, _END, _BREAK)
    cut = F.regexp_replace(cut, rf"[^\p{{L}}\p{{N}}{_BREAK}]+", " ")
    loose = lambda sid: f"[ {_BREAK}]+".join(map(re.escape, known[sid].split()))
    for a, b in sorted({p for _, ids in rules.values() for p in zip(ids, ids[1:]) if p[0] in known and p[1] in known}):
        cut = F.regexp_replace(cut, rf"(?<![\p{{L}}\p{{N}}])({loose(a)}) (?={loose(b)}(?![\p{{L}}\p{{N}}]))", f"$1{_SOFT}")
    parts = F.transform(F.split(cut, _BREAK), lambda s, i: F.transform(F.split(s, _SOFT), lambda x: F.struct(i.alias("at"), F.trim(x).alias("s"))))
    return F.filter(F.flatten(parts), lambda x: x["s"] != "")


def _hits(pieces: Column, table: Column, by_text: dict[str, str]) -> Column:
    """(lo, hi, at, id) of each run of pieces lo to hi that is a known sentence."""
    keys, most = F.array(*map(F.lit, by_text)), max(len(k.split()) for k in by_text)

    def runs(all_pieces: Column, lo: Column) -> Column:
        made = F.transform(F.sequence(F.lit(1), F.least(F.lit(most), F.size(all_pieces) - lo)), lambda n: F.struct(lo.alias("lo"), (lo + n - 1).alias("hi"), F.get(all_pieces, lo)["at"].alias("at"), table[F.array_join(F.slice(all_pieces, lo + 1, n)["s"], " ")].alias("id")))
        return F.filter(made, lambda h: h["id"].isNotNull())

    def of(all_pieces: Column) -> Column:
        begun = F.filter(F.transform(all_pieces, lambda x, i: F.struct(i.alias("i"), x["s"].alias("s"))), lambda x: F.exists(keys, lambda k: F.startswith(F.concat(k, F.lit(" ")), F.concat(x["s"], F.lit(" ")))))
        return F.flatten(F.transform(begun["i"], lambda i: runs(all_pieces, i)))

    return F.flatten(F.transform(F.array(pieces), of))


def _with_next(hits: Column) -> Column:
    """Hits with `next`: up to there the next sentence of a row starts."""
    ends = lambda y: F.array_min(F.filter(hits, lambda z: z["lo"] > y["hi"])["hi"])
    return F.transform(hits, lambda y: F.struct(y["lo"].alias("lo"), y["hi"].alias("hi"), y["at"].alias("at"), y["id"].alias("id"), F.coalesce(ends(y), F.lit(_FAR)).alias("next")))


def _rests(ids: list[str], rules: dict[str, tuple[str, list[str]]]) -> list[list[str]]:
    """What the longer rules that begin with these ids have after them."""
    return sorted({tuple(other[len(ids) :]) for _, other in rules.values() if len(other) > len(ids) and other[: len(ids)] == ids})


def _ended(hits: Column, chains: Column, rests: Column) -> Column:
    """Rows of hits that don't go on with any of the rests."""
    return F.filter(chains, lambda c: ~F.exists(rests, lambda rest: F.size(_chains(hits, rest, F.array(c))) > 0))


def _chains(hits: Column, ids: Column, after: Column | None = None) -> Column:
    """Rows of hits with these ids, by last hit: (at of the first hit, where a next hit may start). They begin anywhere, or go on from the rows `after`."""

    def step(chains: Column, sid: Column) -> Column:
        def longer(y: Column) -> Column:
            first = F.array_min(F.transform(F.filter(chains, lambda x: (y["lo"] >= x["least"]) & (y["lo"] <= x["most"])), lambda x: F.coalesce(x["at"], y["at"])))
            return F.struct(first.alias("at"), (y["hi"] + 1).alias("least"), y["next"].alias("most"))

        return F.filter(F.transform(F.filter(hits, lambda y: y["id"] == sid), longer), lambda x: x["at"].isNotNull())

    anywhere = F.array(F.struct(F.lit(None).cast("int").alias("at"), F.lit(0).alias("least"), F.lit(_FAR).alias("most")))
    start = (anywhere if after is None else after).cast("array<struct<at:int,least:int,most:int>>")
    return F.aggregate(ids, start, step)


def oracle() -> str:
    """DuckDB SQL for `scan_licenses(documents)`."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    known = ", ".join(f"({q(k)}, {q(v)})" for k, v in SENTENCES.items())
    steps, last = "filled0 AS (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents)", "filled0"
    for i, (needs, pattern, words) in enumerate(SLOTS, 1):
        held = " AND ".join(f"contains(t, {q(w)})" for w in needs)
        steps += f",\nfilled{i} AS (SELECT doc_id, CASE WHEN {held} THEN regexp_replace(t, {q(pattern)}, {q(words)}, 'g') ELSE t END AS t FROM {last})"
        last = f"filled{i}"
    listed = lambda ids: "".join(f"|{i}|" for i in ids)
    rules = ", ".join(f"({q(n)}, {q(lic)}, {q(listed(ids))}, {len(ids)})" for n, (lic, ids) in RULES.items())
    # where a rule's last sentence is followed by the rest of a longer rule, it is marked and stands for no rule's end
    ends = "ids"
    longer = {(i, ids[-1], tuple(r)) for i, ids in ((n, ids) for n, (_, ids) in RULES.items()) for r in _rests(ids, RULES)}
    for name, last_id, rest in sorted(longer):
        ends = f"CASE WHEN rule = {q(name)} THEN replace({ends}, {q(listed([last_id, *rest]))}, {q(listed([last_id + '+', *rest]))}) ELSE {ends} END"
    return f"""
WITH known(sid, s) AS (VALUES {known}),
rules(rule, license, rule_ids, n_sentences) AS (VALUES {rules}),
{steps},
cut AS (
  SELECT row_number() OVER () AS r, doc_id,
         string_split(regexp_replace(regexp_replace(t, '[.!?;:]+(?:[\\s\\v]+|$)|[\\r\\n]+', chr(1), 'g'),
                                     '[^\\p{{L}}\\p{{N}}\\x01]+', ' ', 'g'), chr(1)) AS parts
  FROM {last}),
sentence AS (SELECT r, doc_id, generate_subscripts(parts, 1) - 1 AS place, trim(unnest(parts)) AS s FROM cut),
seq AS (
  SELECT r, any_value(doc_id) AS doc_id, list(place ORDER BY place) AS places, string_agg('|' || sid || '|', '' ORDER BY place) AS ids
  FROM sentence JOIN known USING (s) GROUP BY r),
asked AS (SELECT doc_id, places, {ends} AS ids, rule, license, rule_ids, n_sentences FROM seq JOIN rules ON contains(ids, rule_ids)),
held AS (SELECT doc_id, rule, license, places, substr(ids, 1, strpos(ids, rule_ids)) AS before, n_sentences FROM asked WHERE contains(ids, rule_ids))
SELECT doc_id, rule, license, CAST(places[(length(before) - length(replace(before, '|', '')) + 1) // 2] AS INTEGER) AS first_sentence, n_sentences
FROM held"""
