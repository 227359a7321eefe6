"""Licence scans by sentence-rule recognition.

Texts are cut into sentences, each sentence is normalised, known sentences are
replaced by identifiers, and the sequence of identifiers is matched against
ordered rules: a rule holds where its identifiers follow one another, with at
most ``gap`` other sentences between two of them.
"""

from __future__ import annotations

import re
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, lean, steps

# Licence sentences (normalised: words of letters, digits and dots in lower case) and their identifiers.
SENTENCES = {
    "released under the mit license": "mit-notice",
    "licensed under the mit license": "mit-notice",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit-grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit-condition",
    "licensed under the apache license version 2.0": "apache-notice",
    "licensed under the apache license version 2.0 the license": "apache-notice",
    "you may not use this file except in compliance with the license": "apache-use",
    "you may obtain a copy of the license at": "apache-copy",
    "this work is licensed under the gnu general public license version 3": "gpl3-notice",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "gpl3-grant",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "gpl-warranty",
    "see the gnu general public license for more details": "gpl-details",
    "licensed under cc by nc 4.0": "cc-by-nc-4-notice",
    "licensed under cc by 4.0": "cc-by-4-notice",
    "licensed under cc by sa 4.0": "cc-by-sa-4-notice",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-grant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd-binary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-names",
}
# Licences and the ordered identifiers of their rules, longer rules first.
RULES = (
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("Apache-2.0", ("apache-notice", "apache-use", "apache-copy")),
    ("GPL-3.0-or-later", ("gpl3-grant", "gpl-warranty", "gpl-details")),
    ("MIT", ("mit-grant", "mit-condition")),
    ("GPL-3.0-or-later", ("gpl3-grant",)),
    ("GPL-3.0-only", ("gpl3-notice",)),
    ("Apache-2.0", ("apache-notice",)),
    ("MIT", ("mit-notice",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-4-notice",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-4-notice",)),
    ("CC-BY-4.0", ("cc-by-4-notice",)),
)
# SPDX name and the names by which notices call each licence (normalised as above), "l" standing for "license".
NAMES = {
    "MIT": ("mit l", "mit", "expat l"),
    "Apache-2.0": ("apache l version 2.0", "apache l 2.0", "apache 2.0 l", "apache 2.0", "apache software l version 2.0", "apache l v2.0", "apache 2 l"),
    "BSD-2-Clause": ("bsd 2 clause l", "2 clause bsd l", "simplified bsd l", "bsd 2 clause simplified l", "freebsd l", "two clause bsd l"),
    "BSD-3-Clause": ("bsd 3 clause l", "3 clause bsd l", "new bsd l", "modified bsd l", "bsd 3 clause new or revised l", "three clause bsd l", "revised bsd l"),
    "ISC": ("isc l", "isc"),
    "MPL-2.0": ("mozilla public l version 2.0", "mozilla public l 2.0", "mozilla public l v2.0", "mozilla public l v 2.0", "mpl 2.0", "mpl 2.0 l"),
    "EPL-2.0": ("eclipse public l version 2.0", "eclipse public l 2.0", "eclipse public l v2.0", "eclipse public l v 2.0", "epl 2.0"),
    "EPL-1.0": ("eclipse public l version 1.0", "eclipse public l 1.0", "eclipse public l v1.0", "epl 1.0"),
    "BSL-1.0": ("boost software l version 1.0", "boost software l 1.0"),
    "Zlib": ("zlib l", "zlib libpng l"),
    "Unlicense": ("unlicense", "unlicense l"),
    "WTFPL": ("wtfpl", "wtfpl l"),
    "CC0-1.0": ("cc0", "cc0 1.0", "cc0 1.0 universal", "creative commons zero", "creative commons zero v1.0 universal", "creative commons cc0 1.0 universal l", "creative commons cc0 l", "cc0 l", "cc0 1.0 l"),
}
for _spdx, _short, _long, _oldest in (("GPL", "gpl", "general public l", 2), ("LGPL", "lgpl", "lesser general public l", 2), ("AGPL", "agpl", "affero general public l", 3)):
    for _v in ("2.0", "2.1", "3.0"):
        if (_spdx, _v) in (("GPL", "2.1"), ("AGPL", "2.0"), ("AGPL", "2.1")):
            continue
        _call = [_v, _v[0]] if _v.endswith(".0") else [_v]
        _full = [f"{g}{_long}{w} {v}" for v in _call for g in ("gnu ", "") for w in (" version", " v", "")] + [f"{g}{_long} v{v}" for v in _call for g in ("gnu ", "")]
        _brief = [f"{g}{_short}{sep}{v}" for v in _call for g in ("gnu ", "") for sep in (" v", " ", "v", " version ")]
        _all = [*_full, *_brief, *(f"{b} l" for b in _brief)]
        NAMES[f"{_spdx}-{_v}-only"] = (*_all, *(f"{n} only" for n in _all))
        NAMES[f"{_spdx}-{_v}-or-later"] = tuple(f"{n}{x}" for n in _all for x in (" or later", " or any later version", " or at your option any later version", " or later version"))
for _kind, _word in (("BY", ("attribution",)), ("BY-SA", ("attribution sharealike", "attribution share alike")), ("BY-NC", ("attribution noncommercial", "attribution non commercial")), ("BY-ND", ("attribution noderivatives", "attribution noderivs", "attribution no derivatives")), ("BY-NC-SA", ("attribution noncommercial sharealike", "attribution non commercial sharealike", "attribution non commercial share alike")), ("BY-NC-ND", ("attribution noncommercial noderivatives", "attribution noncommercial noderivs", "attribution non commercial noderivatives"))):
    for _v, _port in (("4.0", "international"), ("3.0", "unported"), ("2.5", "generic"), ("2.0", "generic")):
        _brief = f"cc {_kind.lower().replace('-', ' ')} {_v}"
        NAMES[f"CC-{_kind}-{_v}"] = (_brief, f"{_brief} l", *(f"creative commons {w} {x}" for w in _word for x in (_v, f"{_v} l", f"{_v} {_port}", f"{_v} {_port} l", f"l {_v}")))
#: How notices begin and go on behind the licence's name.
_SUBJECTS = ("", "this project is ", "this software is ", "this work is ", "this program is ", "this code is ", "this library is ", "this package is ", "this file is ", "this repository is ", "the code is ", "the source code is ", "all code is ", "it is ")
_VERBS = ("licensed under ", "released under ", "distributed under ", "available under ", "made available under ", "published under ", "provided under ", "covered by ")
_TERMS = ("", "the ", "a ", "an ", "the terms of the ", "the terms and conditions of the ")
_FILES = ("the license file", "license", "license file", "the license", "the license md file", "license md", "the license md license md file", "license md license md", "the license txt file", "license txt", "the license license file", "the file license")
_TAILS = {"", "the license", *(f"see {f}{w}" for f in _FILES for w in ("", " for details", " for more details", " for more information", " for the full text"))}
# Sentences of the texts and grants of further licences.
SENTENCES |= {
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "gpl2-grant",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation": "gpl2-only",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation version 2": "gpl2-only",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation version 3": "gpl3-notice",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu library general public license as published by the free software foundation either version 2 of the license or at your option any later version": "lgpl2-grant",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2.1 of the license or at your option any later version": "lgpl21-grant",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version": "lgpl3-grant",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version": "lgpl3-grant",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version": "agpl3-grant",
    "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "gpl-warranty",
    "see the gnu lesser general public license for more details": "gpl-details",
    "see the gnu affero general public license for more details": "gpl-details",
    "this source code form is subject to the terms of the mozilla public license v 2.0": "mpl2-grant",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "this is free and unencumbered software released into the public domain": "unlicense-grant",
    "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means": "unlicense-terms",
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions": "zlib-grant",
    "this program and the accompanying materials are made available under the terms of the eclipse public license 2.0": "epl2-grant",
    "this program and the accompanying materials are made available under the terms of the eclipse public license v1.0": "epl1-grant",
}
RULES += (
    ("GPL-2.0-or-later", ("gpl2-grant", "gpl-warranty", "gpl-details")),
    ("GPL-2.0-only", ("gpl2-only", "gpl-warranty", "gpl-details")),
    ("LGPL-2.0-or-later", ("lgpl2-grant", "gpl-warranty", "gpl-details")),
    ("LGPL-2.1-or-later", ("lgpl21-grant", "gpl-warranty", "gpl-details")),
    ("LGPL-3.0-or-later", ("lgpl3-grant", "gpl-warranty", "gpl-details")),
    ("AGPL-3.0-or-later", ("agpl3-grant", "gpl-warranty", "gpl-details")),
    ("Unlicense", ("unlicense-grant", "unlicense-terms")),
    *((licence, (grant,)) for licence, grant in (("GPL-2.0-or-later", "gpl2-grant"), ("GPL-2.0-only", "gpl2-only"), ("LGPL-2.0-or-later", "lgpl2-grant"), ("LGPL-2.1-or-later", "lgpl21-grant"), ("LGPL-3.0-or-later", "lgpl3-grant"), ("AGPL-3.0-or-later", "agpl3-grant"), ("MPL-2.0", "mpl2-grant"), ("ISC", "isc-grant"), ("Unlicense", "unlicense-grant"), ("Zlib", "zlib-grant"), ("EPL-2.0", "epl2-grant"), ("EPL-1.0", "epl1-grant"))),
)
#: Identifiers that notices of these licences had before ``NAMES``.
_OLD = {"MIT": "mit-notice", "Apache-2.0": "apache-notice", "GPL-3.0-only": "gpl3-notice", "CC-BY-NC-4.0": "cc-by-nc-4-notice", "CC-BY-4.0": "cc-by-4-notice", "CC-BY-SA-4.0": "cc-by-sa-4-notice"}
_NOTICES = {spdx: _OLD.get(spdx, f"{spdx.lower()}-notice") for spdx in NAMES}
RULES += tuple((spdx, (ident,)) for spdx, ident in _NOTICES.items() if spdx not in _OLD)
_HEAD = re.compile(f"({'|'.join(_SUBJECTS)})({'|'.join(_VERBS)})({'|'.join(sorted(_TERMS, reverse=True))})")
_CALLED = {" ".join("license" if w == "l" else w for w in name.split()): ident for spdx, ident in _NOTICES.items() for name in NAMES[spdx]}
#: Characters of the longest notice.
_LONGEST = max(map(len, _SUBJECTS)) + max(map(len, _VERBS)) + max(map(len, _TERMS)) + max(map(len, _CALLED)) + max(map(len, _TAILS)) + 1
SENTENCES |= {f"spdx license identifier {spdx.lower().replace('-', ' ')}": ident for spdx, ident in _NOTICES.items()}
SENTENCES |= {f"spdx license identifier {old}": _NOTICES[f"{old.upper().replace(' ', '-')}-only"] for old in ("gpl 2.0", "gpl 3.0", "lgpl 2.1", "lgpl 3.0", "agpl 3.0")}


def notice(text: str) -> str | None:
    """The identifier of a notice: a head, a licence's name and a tail."""
    if not (head := _HEAD.match(text)):
        return None
    words = text[head.end() :].split()
    return next((known for n in range(len(words), 0, -1) if (known := _CALLED.get(" ".join(words[:n]))) and " ".join(words[n:]) in _TAILS), None)


#: A sentence ends at a stop, colon or question mark before white space, or at a line of its own.
_CUT = re.compile(rb"(?<=[.!?:;])[\x20\t]+|\n")
_BLANK = b"\x20\t\r"
_STOPS = (b".", b"!", b"?", b":", b";")
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+(?:\.[0-9]+)*")


def normal(sentence: bytes) -> str:
    return b" ".join(_WORD.findall(sentence.lower())).decode("utf-8", "replace")


def reader(sentences: dict[str, str], notices: bool):
    """A function of normalised words: the identifier of a known sentence, and whether they begin one (which bounds what lines are joined)."""
    begun = {" ".join(words[:n]) for words in map(str.split, [*sentences, *(f"{s}{v}" for s in _SUBJECTS for v in _VERBS if notices)]) for n in range(1, len(words) + 1)}

    def look(text: str) -> tuple[str | None, bool]:
        ident, begins = sentences.get(text), text in begun
        if notices and len(text) <= _LONGEST and _HEAD.match(f"{text} "):
            return ident or notice(text), True
        return ident, begins

    return look


def recognise(text: bytes, look, rules, gap: int, probe) -> tuple[list[str], list[str], list[tuple[int, int]]]:
    """Identifiers in order, licences in order of their first sentence, and the byte span of each licence.

    Sentences that a licence's text breaks over lines are joined: a line is tried
    together with the following ones as long as ``look`` says that they begin a known sentence.  Gaps are counted in sentences, however many lines they take.
    """
    if not probe(text):
        return [], [], []
    parts, names, sentence = [], [], []  # byte span, words and sentence number of each part with words
    start, number = 0, 0
    for m in [*_CUT.finditer(text), None]:
        end = m.start() if m else len(text)
        part = text[start:end]
        if name := normal(part):
            parts.append((start + len(part) - len(part.lstrip(_BLANK)), start + len(part.rstrip(_BLANK))))
            names.append(name)
            sentence.append(number)
        # A single line break after no stop is a wrapped line; a part without words ends a sentence too.
        if m and (not name or m[0] != b"\n" or part.rstrip(_BLANK)[-1:] in _STOPS):
            number += 1
        start = m.end() if m else end
    found: list[tuple[int, int, str]] = []  # first part, last part, identifier
    i = 0
    while i < len(parts):
        joined, took = "", None
        for j in range(i, len(parts)):
            joined = f"{joined} {names[j]}" if joined else names[j]
            name, begins = look(joined)
            if name:
                took, ident = j, name
            if not begins:
                break
        if took is None:
            i += 1
        else:
            found.append((i, took, ident))
            i = took + 1

    def far(k: int, q: int) -> bool:
        first, last = found[k][1] + 1, found[q][0] - 1
        return last >= first and sentence[last] - sentence[first] + 1 > gap

    places: dict[str, list[int]] = {}
    rank = []  # of each found sentence among those of its name
    for q, (_, _, ident) in enumerate(found):
        rank.append(len(places.setdefault(ident, [])))
        places[ident].append(q)
    free = {ident: list(range(len(at) + 1)) for ident, at in places.items()}  # from a rank to the next one not yet taken

    def unused(ident: str, r: int) -> int:
        way = free[ident]
        while way[r] != r:
            way[r] = way[way[r]]
            r = way[r]
        return r

    def after(k: int, ident: str) -> int | None:
        """The first sentence of that name after ``k`` that no licence has taken; gaps only grow, so no later one can be nearer."""
        at = places.get(ident, [])
        r = unused(ident, bisect_right(at, k)) if at else 0
        return at[r] if r < len(at) and not far(k, at[r]) else None

    licences, spans = [], []
    for licence, wanted in rules:
        for at in places.get(wanted[0], []):
            if free[wanted[0]][rank[at]] != rank[at]:
                continue
            chain = [at]
            for want in wanted[1:]:
                if (nxt := after(chain[-1], want)) is None:
                    break
                chain.append(nxt)
            else:
                for q in chain:
                    free[found[q][2]][rank[q]] = rank[q] + 1
                licences.append(licence)
                spans.append((parts[found[at][0]][0], parts[found[chain[-1]][1]][1]))
    order = sorted(range(len(spans)), key=spans.__getitem__)
    return [f[2] for f in found], [licences[i] for i in order], [spans[i] for i in order]


_HINTS = ("license", "permission", "redistribution", "software", "permitted", "copyright", "warranty", "gnu", "cc")


def hints(sentences: dict[str, str], notices: bool) -> set[str]:
    """Words one of which every known sentence (and, with ``notices``, every notice) holds; its longest word where no common one does."""
    found = {next((h for h in _HINTS if h in words), max(words, key=len, default="")) for words in map(str.split, sentences)}
    return (found | {"under", "covered"} if notices else found) or {""}


def _scan(sentences: dict[str, str], rules, gap: int, notices: bool):
    probe = re.compile(b"|".join(re.escape(h.encode()) for h in sorted(hints(sentences, notices))), re.IGNORECASE).search

    def run(batches):
        look = reader(sentences, notices)
        for b in steps(batches):
            ids, names, spans = [], [], []
            for t in column(b, "text").to_pylist():
                i, n, s = recognise(t, look, rules, gap, probe)
                ids.append(i)
                names.append(n)
                at = np.cumsum(np.concatenate(([0], (np.frombuffer(t, np.uint8) & 0xC0) != 0x80))) if s else ()  # code points before each byte
                spans.append(",".join(f"{k}:{at[a]}:{at[e]}" for k, (a, e) in zip(n, s, strict=True)))
            yield pa.RecordBatch.from_arrays([column(b, "doc_id"), pa.array([len(i) for i in ids], pa.int64()), pa.array([",".join(i) for i in ids], pa.string()), pa.array([",".join(n) for n in names], pa.string()), pa.array(spans, pa.string())], names=["doc_id", "n_sentences", "sentences", "licenses", "spans"])

    return lean(run)


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sentences: dict[str, str] | None = None, rules=None, gap: int = 2) -> DataFrame:
    """``doc_id, n_sentences, sentences, licenses, spans`` for each row.

    ``sentences`` are the identifiers of known licence sentences in order,
    ``licenses`` the rules that hold, by first sentence, and ``spans`` are
    ``licence:start:end`` in code points.  A null or empty text has none; repeated rows and
    null ids keep a row each; rules that could use the same sentence take it in
    the order of ``rules``; a very long text is read whole, in time in proportion to its
    length; an empty table gives no rows; other columns are not read, whatever their names.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    return rows.mapInArrow(_scan(sentences or SENTENCES, rules or RULES, gap, sentences is None), "doc_id long, n_sentences long, sentences string, licenses string, spans string")


def op5(spark, sf_dir: str) -> DataFrame:
    """``scan_licenses`` over all documents."""
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
