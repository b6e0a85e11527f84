"""Licence scans by sentence rules, after the published method of German, Manabe and Inoue (2010).

A text is cut into sentences; a sentence is normalised and mapped to the identifier of a known licence sentence, with what
its open places hold. The sequence of identifiers of a text is then read against an ordered list of rules, longest first:
a rule takes the first run of identifiers that equals its own, and what it took can't be taken again. Licence
sentences that no rule takes are counted as unexplained.

A null text is empty. A text without a licence sentence has an empty list. Every row gives a row; repeated rows are answered
one by one; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Known sentences in normalised form, by identifier. (v) is an open place for a version, (x) for any words,
# and what stands in brackets may be left out.
SENTENCES = {
    "spdx": "spdx-license-identifier: (x)",
    "copyright": "copyright (x)",
    "all-rights": "all rights reserved",
    "public-domain": "this is free and unencumbered software released into the public domain",
    "cc": "licensed under cc (x)",
    "cc-long": "this work is licensed under a creative commons (x)",
    "cc-the": "this work is licensed under the creative commons (x)",
    "apache": "licensed under the apache license, version (v)[ (the license)]",
    "apache-exception": "you may not use this file except in compliance with the license",
    "apache-copy": "you may obtain a copy of the license at (x)",
    "apache-as-is": "unless required by applicable law or agreed to in writing, software distributed under the license is distributed on an as is basis, "
    "without warranties or conditions of any kind, either express or implied",
    "apache-see": "see the license for the specific language governing permissions and limitations under the license",
    "mit-short": "released under the mit license",
    "mit-under": "licensed under the mit license",
    "mit-title": "the mit license (mit)",
    "mit-title-short": "mit license",
    "mit-grant": "permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
    "(the software), to deal in the software without restriction, including without limitation the rights to use, copy, modify, merge, publish, "
    "distribute, sublicense, and/or sell copies of the software, and to permit persons to whom the software is furnished to do so, subject to the "
    "following conditions",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit-as-is": "the software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of "
    "merchantability, fitness for a particular purpose and noninfringement",
    "mit-liability": "in no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of "
    "contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software",
    "isc-grant": "permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
    "above copyright notice and this permission notice appear in all copies",
    "bsd-short": "use of this source code is governed by a bsd-style license that can be found in the license file",
    "bsd-under": "released under the bsd license",
    "bsd-grant": "redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution",
    "bsd-endorse": "neither the name of (x) nor the names of its contributors may be used to endorse or promote products derived from this software without "
    "specific prior written permission",
    "gpl-work": "this work is licensed under the gnu general public license, version (v)",
    "gpl-under": "licensed under the gnu general public license, version (v)",
    "gpl-free": "this program is free software: you can redistribute it and/or modify it under the terms of the gnu general public license as published by "
    "the free software foundation, either version (v) of the license, or (at your option) any later version",
    "gpl-hope": "this program is distributed in the hope that it will be useful, but without any warranty; without even the implied warranty of "
    "merchantability or fitness for a particular purpose",
    "gpl-see": "see the gnu general public license for more details",
    "gpl-copy": "you should have received a copy of the gnu general public license along with this program",
    "lgpl-under": "licensed under the gnu lesser general public license, version (v)",
    "mpl": "this source code form is subject to the terms of the mozilla public license, v. (v)",
    "mpl-copy": "if a copy of the mpl was not distributed with this file, you can obtain one at (x)",
}

# Licences by sequence of identifiers, the longest first; {v} and {x} stand for what the open places hold.
RULES = [
    ("MIT", ["mit-title", "mit-grant", "mit-notice", "mit-as-is", "mit-liability"]),
    ("MIT", ["mit-title-short", "mit-grant", "mit-notice", "mit-as-is", "mit-liability"]),
    ("Apache-{v}", ["apache", "apache-exception", "apache-copy", "apache-as-is", "apache-see"]),
    ("MIT", ["mit-grant", "mit-notice", "mit-as-is", "mit-liability"]),
    ("GPL-{v}-or-later", ["gpl-free", "gpl-hope", "gpl-see", "gpl-copy"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("GPL-{v}-or-later", ["gpl-free", "gpl-hope", "gpl-see"]),
    ("MPL-{v}", ["mpl", "mpl-copy"]),
    ("ISC", ["isc-grant"]),
    ("Apache-{v}", ["apache"]),
    ("GPL-{v}-or-later", ["gpl-free"]),
    ("GPL-{v}", ["gpl-work"]),
    ("GPL-{v}", ["gpl-under"]),
    ("LGPL-{v}", ["lgpl-under"]),
    ("MPL-{v}", ["mpl"]),
    ("MIT", ["mit-short"]),
    ("MIT", ["mit-under"]),
    ("BSD", ["bsd-under"]),
    ("BSD", ["bsd-short"]),
    ("CC-{x}", ["cc"]),
    ("CC-{x}", ["cc-long"]),
    ("CC-{x}", ["cc-the"]),
    ("Unlicense", ["public-domain"]),
    ("{x}", ["spdx"]),
]

# What a notice of reserved rights means where no licence is found.
RESERVED = "All-Rights-Reserved"
# Notices that may stand between the sentences of a licence.
NOTICES = {"copyright", "all-rights"}
# Sentences that are one line by their nature; the open places of others may go on in the next lines.
ONE_LINE = {"copyright", "spdx"}
# A known sentence holds at least one of these words, so other sentences need no further look.
KEYWORDS = ("licen", "copyright", "rights reserved", "public domain", "warrant", "permission", "redistribut", "liable", "mpl")
SENTENCE_END = re.compile(r"(?<=[.!?;:])\s+(?=\S)|\n+")
COMMENT = re.compile(r"^[\s/*#;%\-]+|[\s*/]+$", re.MULTILINE)
QUOTES = re.compile(r"[\"'`“”‘’]")


def sentences(text: str) -> list[tuple[int, int]]:
    """Bounds of the sentences of a text: line ends, and closing marks before white space."""
    cuts, at = [], 0
    for m in SENTENCE_END.finditer(text):
        cuts.append((at, m.start()))
        at = m.end()
    cuts.append((at, len(text)))
    return [(a, b) for a, b in cuts if b > a]


def normalised(sentence: str) -> str:
    """Lower case, no comment signs or quotes, single spaces, one spelling, no closing mark."""
    s = QUOTES.sub("", COMMENT.sub(" ", sentence.lower())).replace("licence", "license")
    return " ".join(s.split()).rstrip(".!?;:,").strip()


@dataclass
class Found:
    licence: str
    first: int
    last: int


class SentenceRules:
    """Known sentences compiled to a table of exact sentences and patterns for those with open places."""

    def __init__(self, known: dict[str, str] = SENTENCES, rules: list[tuple[str, list[str]]] = RULES) -> None:
        self.exact = {normalised(s): name for name, s in known.items() if "(v)" not in s and "(x)" not in s}
        self.open = []
        for name, s in known.items():
            if not any(k in s for k in KEYWORDS):
                raise ValueError(f"sentence {name} holds no keyword")
            if "(v)" in s or "(x)" in s:
                pattern = re.escape(s).replace(re.escape("(v)"), r"(?P<v>\d+(?:\.\d+)*)").replace(re.escape("(x)"), "(?P<x>.+)")
                pattern = re.sub(r"\\\[(.*?)\\\]", r"(?:\1)?", pattern)
                self.open.append((name, re.compile(pattern)))
        # what no run of parts that is a known sentence can exceed without its open place, and the words it can start with
        self.longest = max(len(x) for x in known.values())
        self.starts = {x.split()[0].rstrip(".!?;:,") for x in known.values()}
        self.rules = rules

    def identify(self, sentence: str) -> tuple[str, str] | None:
        """Identifier and open part of a normalised sentence."""
        name = self.exact.get(sentence)
        if name is not None:
            return name, ""
        for name, pattern in self.open:
            m = pattern.fullmatch(sentence)
            if m:
                return name, next(iter(m.groupdict().values()))
        return None

    def scan(self, text: str) -> tuple[list[tuple[str, str, int, int]], list[Found], int]:
        """Identified sentences, licences with their places, and sentences no rule explains."""
        low = text.lower()
        if not any(k in low for k in KEYWORDS):
            return [], [], 0
        cuts, out, k = sentences(text), [], 0
        parts = [normalised(text[a:b]) for a, b in cuts]
        while k < len(cuts):
            step = 1
            # a known sentence may hold marks or line ends, so runs of parts are tried, longest first
            for n in reversed(self._runs(parts, k)):
                a, b = cuts[k][0], cuts[k + n - 1][1]
                part = text[a:b]
                if not any(w in part.lower() for w in KEYWORDS):
                    continue
                found = self.identify(normalised(part))
                if found and "\n" in part and SENTENCES.get(found[0], "").endswith("(x)"):
                    if found[0] in ONE_LINE:
                        continue
                    found, n = self._wrapped(text, cuts, parts, k, found[0])
                    b = cuts[k + n - 1][1]
                if found:
                    out.append((*found, a, b))
                    step = n
                    break
            k += step
        taken = [name in NOTICES for name, *_ in out]
        licences = []
        for name, wanted in self.rules:
            places = [i for i in range(len(out)) if not taken[i]]
            at = 0
            while at + len(wanted) <= len(places):
                some = places[at : at + len(wanted)]
                if [out[i][0] for i in some] == wanted and all(taken[i] and out[i][0] in NOTICES for i in range(some[0], some[-1]) if i not in some):
                    held = {"v": "", "x": ""}
                    for i in some:
                        held["v" if "{v}" in name else "x"] = held["v" if "{v}" in name else "x"] or out[i][1]
                    licences.append(Found(name.format(v=held["v"], x=held["x"].upper().replace(" ", "-")), out[some[0]][2], out[some[-1]][3]))
                    for i in some:
                        taken[i] = True
                    places = [i for i in places if not taken[i]]
                else:
                    at += 1
        if not licences:
            # a reservation says something of its own only where nothing is granted
            licences = [Found(RESERVED, a, b) for name, _, a, b in out if name == "all-rights"]
        return out, sorted(licences, key=lambda f: (f.first, f.last)), taken.count(False)

    def _runs(self, parts: list[str], k: int) -> list[int]:
        """Lengths of the runs of parts from ``k`` on that can be a known sentence."""
        if not parts[k] or parts[k].split()[0].rstrip(".!?;:,") not in self.starts:
            return []
        out, size = [], 0
        for n, part in enumerate(parts[k:], 1):
            size += len(part)
            if size > self.longest and n > 1:
                break
            if part:
                out.append(n)
        return out

    def _wrapped(self, text: str, cuts: list[tuple[int, int]], parts: list[str], k: int, name: str) -> tuple[tuple[str, str], int]:
        """The sentence ``name`` at part ``k`` and its parts; its open place ends at a closing mark, a blank line or a known sentence."""
        of = lambda n: self.identify(normalised(text[cuts[k][0] : cuts[k + n - 1][1]]))
        n = next(n for n in self._runs(parts, k) if (of(n) or ("",))[0] == name)
        while k + n < len(cuts) and parts[k + n]:
            end, start = cuts[k + n - 1][1], cuts[k + n][0]
            if text[end - 1] in ".!?;:" or text[end:start].count("\n") > 1:
                break
            if any(self.identify(normalised(text[start : cuts[k + n + m - 1][1]])) for m in self._runs(parts, k + n)):
                break
            n += 1
        return of(n), n


def _scanner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rules = SentenceRules()
    for batch in batches:
        ids, places, unknown = [], [], []
        for text in batch.column(1).to_pylist():
            known, found, rest = rules.scan(text or "")
            ids.append([name for name, *_ in known])
            places.append([{"licence": f.licence, "first": f.first, "last": f.last} for f in found])
            unknown.append(rest)
        span = pa.struct([("licence", pa.string()), ("first", pa.int64()), ("last", pa.int64())])
        made = [pa.array(ids, pa.list_(pa.string())), pa.array(places, pa.list_(span)), pa.array(unknown, pa.int64())]
        yield pa.RecordBatch.from_arrays([batch.column(0), *made], ["doc_id", "sentence_ids", "found", "n_unexplained"])


def scan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, sentence_ids, found (licence, first, last code point), n_unexplained`` of every row."""
    named = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    kind = named.schema["doc_id"].dataType.simpleString()
    return named.mapInArrow(_scanner, f"doc_id {kind}, sentence_ids array<string>, found array<struct<licence: string, first: long, last: long>>, n_unexplained long")


def report(found: DataFrame) -> DataFrame:
    """Counts and the distinct licences of each text, in order of name."""
    return found.select(
        "doc_id",
        F.size("sentence_ids").cast("long").alias("n_sentences"),
        F.array_join("sentence_ids", ",").alias("sentence_ids"),
        F.size("found").cast("long").alias("n_licences"),
        F.array_join(F.array_sort(F.array_distinct("found.licence")), ",").alias("licences"),
        "n_unexplained",
    )


# The sentences that the synthetic documents hold, each a line of its own.
SQL = r"""
WITH l AS (SELECT doc_id, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x,
  '^(All rights reserved|Licensed under CC BY-NC 4\.0|This work is licensed under the GNU General Public License, version 3|Licensed under the Apache License, Version 2\.0|Released under the MIT License)\.$')) AS ls FROM documents),
n AS (SELECT doc_id, list_transform(ls, lambda x: CASE WHEN x LIKE 'All %' THEN 'all-rights' WHEN x LIKE '% CC %' THEN 'cc' WHEN x LIKE '%GNU%' THEN 'gpl-work'
        WHEN x LIKE '%Apache%' THEN 'apache' ELSE 'mit-short' END) AS ids FROM l),
k AS (SELECT *, list_filter(ids, lambda x: x <> 'all-rights') AS given FROM n),
f AS (SELECT *, CASE WHEN len(given) > 0 THEN given ELSE ids END AS found FROM k)
SELECT doc_id, len(ids)::BIGINT AS n_sentences, array_to_string(ids, ',') AS sentence_ids, len(found)::BIGINT AS n_licences,
       array_to_string(list_sort(list_distinct(list_transform(found, lambda x: CASE x WHEN 'all-rights' THEN 'All-Rights-Reserved' WHEN 'cc' THEN 'CC-BY-NC-4.0'
         WHEN 'gpl-work' THEN 'GPL-3' WHEN 'apache' THEN 'Apache-2.0' ELSE 'MIT' END))), ',') AS licences, 0::BIGINT AS n_unexplained
FROM f"""
