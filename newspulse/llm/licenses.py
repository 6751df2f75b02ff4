"""License scan: ordered signature rules behind a keyword prefilter.

A text becomes its sequence of lower-case words joined by single spaces. A
rule is a regular expression over that sequence with a label, a priority and
a keyword; it runs only where its keyword occurs. Overlapping detections are
resolved in order of priority, then length: a detection whose interval lies
inside one that was kept is suppressed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame

from newspulse.llm.common import slices, utf8

# --- Fixed values: the base phrases and their labels, in the query's words ---
BASE = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

# --- Signature families: label, names (regex alternatives), versions ---------
# Names are written over normalised words: lower case, punctuation dropped.
FAMILIES = (
    ("agpl", r"(?:gnu )?affero general public license|gnu agpl|agpl", "3"),
    ("lgpl", r"(?:gnu )?(?:lesser|library) general public license|gnu lgpl|lgpl", "2 2.1 3"),
    ("gfdl", r"(?:gnu )?free documentation license|gfdl", "1.1 1.2 1.3"),
    ("gpl", r"(?:gnu )?general public license|gnu gpl|gpl", "1 2 3"),
    ("apache", r"apache software license|apache license|apache", "1.0 1.1 2.0"),
    ("mit", r"mit x11 license|mit license|expat license", ""),
    ("bsd", r"bsd license|bsd (?:2|3|4) clause license|(?:new|modified|simplified|revised) bsd license", ""),
    ("mpl", r"mozilla public license|mpl", "1.0 1.1 2.0"),
    ("epl", r"eclipse public license|epl", "1.0 2.0"),
    ("cpl", r"common public license", "1.0"),
    ("cddl", r"common development and distribution license|cddl", "1.0 1.1"),
    ("eupl", r"european union public licen[cs]e|eupl", "1.0 1.1 1.2"),
    ("cecill", r"cecill(?: b| c)?(?: free software license)?", "1 2 2.1"),
    ("artistic", r"(?:perl )?artistic license", "1.0 2.0"),
    ("isc", r"isc license", ""),
    ("zlib", r"zlib(?: libpng)? license", ""),
    ("boost", r"boost software license", "1.0"),
    ("wtfpl", r"do what the fuck you want to public license|wtfpl", "1 2"),
    ("unlicense", r"the unlicense|unlicense", ""),
    ("openssl", r"openssl license|ssleay license", ""),
    ("python", r"python software foundation license|psf license", "2"),
    ("php", r"php license", "3.0 3.01"),
    ("ruby", r"ruby license", ""),
    ("postgresql", r"postgresql license", ""),
    ("ncsa", r"(?:university of illinois )?ncsa open source license", ""),
    ("ms-pl", r"microsoft public license|ms pl", ""),
    ("ms-rl", r"microsoft reciprocal license|ms rl", ""),
    ("osl", r"open software license|osl", "1.0 2.0 2.1 3.0"),
    ("afl", r"academic free license|afl", "1.2 2.0 2.1 3.0"),
    ("qpl", r"q public license", "1.0"),
    ("ipl", r"ibm public license", "1.0"),
    ("ofl", r"sil open font license|open font license", "1.0 1.1"),
    ("odbl", r"open database license|odbl", "1.0"),
    ("odc-by", r"open data commons attribution license", "1.0"),
    ("pddl", r"public domain dedication and license|pddl", "1.0"),
    ("beerware", r"beerware license|beer ware license", "42"),
    ("vim", r"vim license", ""),
    ("bsl", r"business source license", "1.0 1.1"),
    ("sspl", r"server side public license|sspl", "1"),
    ("elastic", r"elastic license", "2.0"),
    ("upl", r"universal permissive license", "1.0"),
    ("ecl", r"educational community license", "1.0 2.0"),
    ("w3c", r"w3c software (?:notice and )?license", ""),
    ("openrail", r"openrail(?: m)?(?: license)?|creativeml open rail(?: m)?(?: license)?", ""),
    ("llpl", r"latex project public license|lppl", "1.0 1.1 1.2 1.3"),
)
#: Attribution licenses: label and the words after "cc" or "creative commons".
CREATIVE = (
    ("cc-by-nc-nd", r"(?:by nc nd|attribution non ?commercial no ?deriv(?:s|atives|ative works))"),
    ("cc-by-nc-sa", r"(?:by nc sa|attribution non ?commercial share ?alike)"),
    ("cc-by-nc", r"(?:by nc|attribution non ?commercial)"),
    ("cc-by-nd", r"(?:by nd|attribution no ?deriv(?:s|atives|ative works))"),
    ("cc-by-sa", r"(?:by sa|attribution share ?alike)"),
    ("cc-by", r"(?:by|attribution)"),
    ("cc0", r"(?:0|zero)(?: universal)?"),
)
CREATIVE_VERSIONS = "1.0 2.0 2.5 3.0 4.0"
#: Notices and clauses of the license texts themselves: label, keyword, pattern.
CLAUSES = (
    ("gpl", "free software", r"this (?:program|library|file) is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "free software", r"this (?:program|library|file) is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license"),
    ("agpl", "free software", r"this (?:program|library|file) is free software you can redistribute it and or modify it under the terms of the gnu affero general public license"),
    ("gpl", "general public license", r"either version \d of the license or (?:at your option )?any later version"),
    ("mit", "permission is hereby", r"permission is hereby granted free of charge to any person obtaining a copy"),
    ("isc", "permission to use", r"permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", "redistribution and use", r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", "neither the name", r"neither the name of .{1,80}? nor the names of (?:its|the) contributors may be used"),
    ("apache", "you may not use this file", r"you may not use this file except in compliance with the license"),
    ("boost", "permission is hereby", r"permission is hereby granted free of charge to any person or organization obtaining a copy"),
    ("zlib", "as is without any express", r"this software is provided as is without any express or implied warranty in no event will the authors"),
    ("mpl", "mozilla", r"this source code form is subject to the terms of the mozilla public license"),
    ("epl", "eclipse", r"made available under the terms of the eclipse public license"),
    ("unlicense", "unencumbered", r"this is free and unencumbered software released into the public domain"),
    ("public-domain", "public domain", r"(?:released|placed|dedicated|put|is) (?:in|into|to) the public domain"),
    ("public-domain", "copyright disclaimer", r"copyright disclaimer"),
    ("warranty-disclaimer", "as is", r"(?:the software is )?provided (?:by .{1,60}? )?as is (?:and|without) (?:any )?(?:express|warrant)"),
    ("warranty-disclaimer", "warrant", r"without (?:even the implied )?warrant(?:y|ies) (?:of merchantability|or conditions of any kind)"),
    ("proprietary", "all rights reserved", r"all rights reserved"),
    ("proprietary", "confidential", r"(?:proprietary and confidential|confidential and proprietary)"),
    ("proprietary", "unauthori", r"unauthori[sz]ed (?:copying|use|reproduction|distribution) .{0,60}?(?:is )?(?:strictly )?prohibited"),
    ("proprietary", "end user license", r"end user license agreement"),
    ("non-commercial", "commercial", r"(?:for )?non ?commercial (?:use|purposes) only"),
    ("no-derivatives", "derivative", r"no derivative works"),
)
GRANT = (r"(?:licensed|released|distributed|available|provided|published|covered|redistributed|used|governed)"
         r"(?: by| under)(?: the)?(?: terms(?: and conditions)? of(?: the)?)? (?:{0})")
CONTEXT = r"(?:licen[cs]e(?:d|s)?|identifier)(?: is| the| by| under| under the)* {0}|{0} (?:licen[cs]e(?:d|s)?|only|or later|compatible)"
NOTICE, GRANTED, VERSIONED, CREATIVE_RULE, PLAIN = 5, 4, 3, 3, 1


class Rule(NamedTuple):
    label: str
    priority: int
    keyword: str
    pattern: str


def _keyword(name: str) -> list[str]:
    """A literal stretch of every alternative of ``name``."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(name + "|"):
        depth += (c == "(") - (c == ")")
        if c == "|" and not depth:
            literal = re.sub(r"\([^()]*(?:\([^()]*\)[^()]*)*\)\??|\[[^]]*\]|\w\?", "\0", name[start:i])
            out.append(max(literal.split("\0"), key=len).strip())
            start = i + 1
    return out


def rules() -> list[Rule]:
    """Some hundreds of rules: families by form and version, and the clauses."""
    out = []
    for label, names, versions in FAMILIES:
        for keyword, name in zip(_keyword(names), _split(names), strict=True):
            out.append(Rule(label, GRANTED, keyword, GRANT.format(name)))
            # One word alone is also the name of other things, so it needs a word about licenses next to it.
            out.append(Rule(label, PLAIN, keyword, name if " " in name or "license" in name else CONTEXT.format(name)))
            for v in versions.split():
                number = v.replace(".", " ").removesuffix(" 0")
                at = rf"(?:{name}) (?:version |v|v )?{number}(?: 0)?(?: only| or (?:any )?later(?: version)?)?"
                out.append(Rule(label, VERSIONED, keyword, at))
    for label, name in CREATIVE:
        for keyword, lead in (("cc", "cc"), ("creative commons", "creative commons")):
            out.append(Rule(label, CREATIVE_RULE, keyword, rf"{lead} {name}(?: (?:international|unported))?(?: license)?"))
            for v in CREATIVE_VERSIONS.split():
                out.append(Rule(label, CREATIVE_RULE, keyword, rf"{lead} {name} {v.replace('.', ' ')}(?: (?:international|unported|generic))?(?: license)?"))
    out += [Rule(label, NOTICE, keyword, pattern) for label, keyword, pattern in CLAUSES]
    return out


def _split(names: str) -> list[str]:
    out, depth, start = [], 0, 0
    for i, c in enumerate(names + "|"):
        depth += (c == "(") - (c == ")")
        if c == "|" and not depth:
            out.append(names[start:i])
            start = i + 1
    return out


@lru_cache
def compiled() -> dict[bytes, list[tuple[str, int, re.Pattern]]]:
    """Rules by keyword, each as a pattern over whole words."""
    out: dict[bytes, list] = {}
    for r in rules():
        out.setdefault(r.keyword.encode(), []).append((r.label, r.priority, re.compile(rb"(?<![^ ])(?:%s)(?![^ ])" % r.pattern.encode())))
    return out


WORD_BYTES = bytes(c if chr(c).isalnum() and c < 0x80 or c >= 0x80 else 0x20 for c in range(256))


def base_places(line: bytes) -> list[tuple[int, int, str]]:
    """(first word, words, label) of every place of a base phrase in joined words."""
    out = []
    for phrase, label in BASE:
        key = phrase.encode()
        at = line.find(key)
        while at >= 0:
            end = at + len(key)
            if (at == 0 or line[at - 1] == 0x20) and (end == len(line) or line[end] == 0x20):
                out.append((line.count(b" ", 0, at), key.count(b" ") + 1, label))
            at = line.find(key, at + 1)
    return sorted(out)


def detections(line: bytes) -> list[tuple[int, int, int, str]]:
    """(start, end, priority, label) of the detections that are not suppressed."""
    found = []
    for keyword, some in compiled().items():
        if keyword in line:
            for label, priority, pattern in some:
                found += [(*m.span(), priority, label) for m in pattern.finditer(line)]
    return suppress(found)


def suppress(found: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    """Drop each detection that lies inside one of higher rank.

    Furthest end by start is kept in a binary indexed tree, so a text with
    many detections takes n log n steps.
    """
    starts = {s: i + 1 for i, s in enumerate(sorted({d[0] for d in found}))}
    furthest = [0] * (len(starts) + 1)
    kept: list[tuple[int, int, int, str]] = []
    for start, end, priority, label in sorted(set(found), key=lambda d: (-d[2], d[0] - d[1], d[0], d[3])):
        i, reach = starts[start], 0
        while i:
            reach, i = max(reach, furthest[i]), i & (i - 1)
        if reach < end:
            kept.append((start, end, priority, label))
            i = starts[start]
            while i < len(furthest):
                furthest[i] = max(furthest[i], end)
                i += i & -i
    return sorted(kept)


SCHEMA = ("doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
          "score double, spans array<struct<first_word:long,words:long,label:string>>")


def scan(docs: DataFrame) -> DataFrame:
    """One row per document with its base places and the rules' detections.

    ``score`` is 1 minus the product over detections of (1 - strength), a
    strength of priority / 6 each: one granted license gives 2/3, base places
    count like plain names. Null and empty texts give zero counts, null word
    positions and empty labels. Repeated rows each give a row; an empty table
    gives none. Texts are read whole, in bounded pieces of a batch. Other
    columns are not looked at.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in slices(frames, "text", 8_000_000):
            rows = []
            for doc_id, text in zip(frame["doc_id"], frame["text"], strict=True):
                words = utf8(text).lower().translate(WORD_BYTES).split(b" ")
                words = [w for w in words if w]
                line = b" ".join(words)
                base, spans = base_places(line), detections(line)
                labels = {b[2] for b in base}
                doubt = (5 / 6) ** len(base)
                for s in spans:
                    doubt *= 1 - s[2] / 6
                rows.append((
                    doc_id, len(words), len(base), base[0][0] if base else None, base[-1][0] if base else None,
                    ",".join(sorted(labels)), ",".join(sorted(labels | {s[3] for s in spans})), 1 - doubt,
                    [{"first_word": line.count(b" ", 0, a), "words": line.count(b" ", a, b) + 1, "label": k} for a, b, _, k in spans]))
            out = pd.DataFrame(rows, columns=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])
            for c in ("doc_id", "first_word", "last_word"):
                out[c] = out[c].astype("Int64")
            yield out

    return docs.select("doc_id", "text").mapInPandas(run, SCHEMA)
