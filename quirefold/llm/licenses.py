"""Licence scans by sentence rules.

A text is normalised and its sentences are looked up among known licence sentences, which gives a sequence of sentence
identifiers in text order. A known sentence of a few words (a notice, a title) must be a whole line, or several whole
lines, or the end or all of a sentence that is wrapped over lines; it never reaches beyond a full stop or a blank line.
A long one may stand anywhere, as licences are also pasted into one line. Ordered licence rules are then matched against
that sequence: a rule names the identifiers that must come one after the other, other known sentences may lie between
them. For each rule the sequence is read once, name after name, whatever its length. All native and row-local: no
shuffle, so neither skew nor lost executors matter; memory is one row's sentences.

Sentences may have slots (a holder's or a program's name). Notices are sentences made by a rule: a licence's name, or
several, after `licensed under` and its like, with a subject and a pointer to a file around them; a licence's name as a
whole line is its title. After an SPDX tag stands an expression: each name in it gives an identifier, its text is kept.
Texts without any word that a known sentence must have are passed over.

Defined results: a null or empty text, or one without known sentences, has no identifiers and no licence; a sentence
that repeats gives its identifier each time; several rules may match, each is listed once, in the order of the rules,
but for those that a more special licence rules out; known sentences that no matched rule uses leave `unresolved` true;
a name in an SPDX expression that is not known gives the identifier `spdx-unknown`, which no
rule uses; `+` and exceptions are kept in the expression only; very long texts are read whole; repeated rows are judged alike; an empty table gives an empty result; extra columns are
not read, whatever their names.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Opening and operative sentences of public licences and licence notices, normalised (lower case, other
# characters than letters and digits as one blank).
SENTENCES = {
    "apache2-notice": "licensed under the apache license version 2 0",
    "apache2-long": "licensed under the apache license version 2 0 the license",
    "apache2-compliance": "you may not use this file except in compliance with the license",
    "apache2-copy": "you may obtain a copy of the license at",
    "mit-notice": "released under the mit license",
    "mit-licensed": "licensed under the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
    "mit-condition": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit-asis": "the software is provided as is without warranty of any kind express or implied",
    "gpl3-notice": "this work is licensed under the gnu general public license version 3",
    "gpl-redistribute": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license",
    "gpl-nowarranty": "this program is distributed in the hope that it will be useful but without any warranty",
    "gpl-received": "you should have received a copy of the gnu general public license along with this program",
    "bsd-redistribution": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer",
    "ccbync4-notice": "licensed under cc by nc 4 0",
    "ccby4-notice": "licensed under cc by 4 0",
    "ccbysa4-notice": "licensed under cc by sa 4 0",
    "cc0-notice": "to the extent possible under law the author has waived all copyright and related rights",
    "mpl2-notice": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "all-rights": "all rights reserved",
}


#: End of a sentence or paragraph in normalised text; a line's end is a newline.
STOP = "\x01"
# Fixed values: (identifiers, sentence), the complete wordings of licence texts where SENTENCES has only their beginning,
# or another wording. `v. 2.0` is cut as if a sentence ended there.
_GPL_FREE = "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation "
_GPL_COPY = "you should have received a copy of the gnu general public license along with this program if not "
FULL_SENTENCES = (
    (("mit-grant",), SENTENCES["mit-grant"] + " the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"),
    (("mit-condition",), "the above copyright notice and this permission notice including the next paragraph shall be included in all copies or substantial portions of the software"),
    (("mit-asis",), SENTENCES["mit-asis"] + " including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    *((("gpl-redistribute",), _GPL_FREE + end) for v in "32" for end in (f"either version {v} of the license or at your option any later version", f"version {v} of the license")),
    (("gpl-nowarranty",), SENTENCES["gpl-nowarranty"] + " without even the implied warranty of merchantability or fitness for a particular purpose"),
    *((("gpl-received",), _GPL_COPY + f"see {scheme} www gnu org licenses") for scheme in ("http", "https")),
    *(
        (("gpl-received",), _GPL_COPY + f"write to the free software foundation inc {place} usa")
        for place in ("51 franklin street fifth floor boston ma 02110 1301", "51 franklin st fifth floor boston ma 02110 1301", "59 temple place suite 330 boston ma 02111 1307", "675 mass ave cambridge ma 02139")
    ),
    (("bsd-binary",), SENTENCES["bsd-binary"] + " in the documentation and or other materials provided with the distribution"),
    (("apache2-long", "apache2-compliance"), SENTENCES["apache2-long"] + " " + SENTENCES["apache2-compliance"]),
    *((("apache2-copy",), SENTENCES["apache2-copy"] + f" {scheme} www apache org licenses license 2 0") for scheme in ("http", "https")),
    (("cc0-notice",), "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    (("cc0-notice",), "to the extent possible under law the author s have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide"),
    (("mpl2-notice",), f"this source code form is subject to the terms of the mozilla public license v{STOP}2 0"),
)


def normal(sentence: str) -> str:
    """A sentence as `normal_text` leaves it."""
    ended = re.sub(r"[.!?]\s+", STOP, sentence.lower())
    return re.sub(rf" ?{STOP} ?", STOP, re.sub(rf"[^a-z0-9{STOP}]+", " ", ended)).strip()


# Identifiers and wordings of further public licences, as they print them.
_LESSER, _AFFERO = "GNU Lesser General Public License", "GNU Affero General Public License"
_FREE = "This {what} is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation, {end}"
_HOPE = "This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE"
_COPY = "You should have received a copy of the {name} along with this {what}{end}"
_COPY_ENDS = (". If not, see <https://www.gnu.org/licenses/>", "; if not, see <https://www.gnu.org/licenses/>", ". If not, see <http://www.gnu.org/licenses/>", "; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA")
MORE_SENTENCES = (
    ("bsd-endorse", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-endorse", "The name of the author may not be used to endorse or promote products derived from this software without specific prior written permission"),
    ("isc-grant", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("isc-grant", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("zlib-grant", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"),
    ("zlib-origin", "The origin of this software must not be misrepresented; you must not claim that you wrote the original software"),
    ("unlicense-free", "This is free and unencumbered software released into the public domain"),
    ("unlicense-anyone", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means"),
    ("boost-notice", "Distributed under the Boost Software License, Version 1.0"),
    ("boost-grant", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following"),
    ("epl2-notice", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("lgpl-title", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("lgpl-title", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("agpl-title", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("gpl-title", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("gpl-title", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("gnu-verbatim", "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed"),
    ("apache2-title", "Apache License Version 2.0, January 2004"),
    ("apache2-terms", "TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("mpl2-title", "Mozilla Public License Version 2.0"),
    ("mpl2-covered", "\"Contributor\" means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software"),
    ("cc0-title", "Creative Commons Legal Code CC0 1.0 Universal"),
    *((f"{i}-redistribute", _FREE.format(what=w, name=n, end=end)) for i, w, n in (("lgpl", "library", _LESSER), ("lgpl", "program", _LESSER), ("agpl", "program", _AFFERO)) for end in (f"either version {v} of the License, or (at your option) any later version" for v in (("3",) if i == "agpl" else ("2.1", "3")))),
    ("lgpl-nowarranty", _HOPE.format(what="library")),
    *((f"{i}-received", _COPY.format(name=n, what=w, end=end)) for i, w, n in (("lgpl", "library", _LESSER), ("lgpl", "program", _LESSER), ("agpl", "program", _AFFERO)) for end in _COPY_ENDS),
)
# Parts of the names of the Creative Commons licences.
CC_PARTS = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
CC_VERSIONS = {"4.0": "4.0 International", "3.0": "3.0 Unported"}
_CC = [(f"CC-{k}-{v}", f"cc{k.lower().replace('-', '')}{v[0]}", f"{name} {full}", f"CC {k} {v}") for v, full in CC_VERSIONS.items() for k, name in CC_PARTS.items()]
CC_SENTENCES = tuple(
    (i + part, text)
    for _, i, name, short in _CC
    for part, text in (
        ("-work", f"This work is licensed under a Creative Commons {name} License"),
        ("-work", f"This work is licensed under the Creative Commons {name} License"),
        ("-work", f"This work is licensed under {short}"),
        ("-title", f"Creative Commons {name} Public License"),
        ("-notice", f"Licensed under {short}"),
    )
    if i + part not in SENTENCES
)


@dataclass(frozen=True)
class LicenceRule:
    """Sentence identifiers in their order, and more special licences that rule this one out."""

    licence: str
    sequence: tuple[str, ...]
    unless: tuple[str, ...] = ()


#: Ordered rules: longer sequences of the same licence come before shorter ones. A parameter.
RULES = (
    LicenceRule("Apache-2.0", ("apache2-long", "apache2-compliance", "apache2-copy")),
    LicenceRule("Apache-2.0", ("apache2-notice",)),
    LicenceRule("MIT", ("mit-grant", "mit-condition", "mit-asis")),
    LicenceRule("MIT", ("mit-notice",)),
    LicenceRule("MIT", ("mit-licensed",)),
    LicenceRule("GPL-3.0", ("gpl3-notice",)),
    LicenceRule("GPL", ("gpl-redistribute", "gpl-nowarranty", "gpl-received")),
    LicenceRule("BSD-3-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-endorse")),
    LicenceRule("BSD", ("bsd-redistribution", "bsd-source", "bsd-binary"), ("BSD-3-Clause",)),
    LicenceRule("CC-BY-NC-4.0", ("ccbync4-notice",)),
    LicenceRule("CC-BY-4.0", ("ccby4-notice",)),
    LicenceRule("CC-BY-SA-4.0", ("ccbysa4-notice",)),
    LicenceRule("CC0-1.0", ("cc0-notice",)),
    LicenceRule("MPL-2.0", ("mpl2-notice",)),
    LicenceRule("Apache-2.0", ("apache2-title", "apache2-terms")),
    LicenceRule("LGPL", ("lgpl-redistribute", "lgpl-nowarranty", "lgpl-received")),
    LicenceRule("LGPL", ("lgpl-redistribute", "gpl-nowarranty", "lgpl-received")),
    LicenceRule("AGPL-3.0", ("agpl-redistribute", "gpl-nowarranty", "agpl-received")),
    LicenceRule("LGPL", ("lgpl-title", "gnu-verbatim")),
    LicenceRule("AGPL-3.0", ("agpl-title", "gnu-verbatim")),
    LicenceRule("GPL", ("gpl-title", "gnu-verbatim")),
    LicenceRule("ISC", ("isc-grant",)),
    LicenceRule("Zlib", ("zlib-grant", "zlib-origin")),
    LicenceRule("Unlicense", ("unlicense-free", "unlicense-anyone")),
    LicenceRule("BSL-1.0", ("boost-notice",)),
    LicenceRule("BSL-1.0", ("boost-grant",)),
    LicenceRule("EPL-2.0", ("epl2-notice",)),
    LicenceRule("MPL-2.0", ("mpl2-title", "mpl2-covered")),
    LicenceRule("CC0-1.0", ("cc0-title",)),
    *(LicenceRule(licence, (i + part,)) for licence, i, _, _ in _CC for part in ("-work", "-title", "-notice") if i + part not in SENTENCES),
)
# Names of licences and of exceptions in SPDX expressions.
SPDX_NAMES = (
    "0BSD", "Apache-1.1", "Apache-2.0", "Artistic-2.0", "BlueOak-1.0.0", "BSD-2-Clause", "BSD-3-Clause", "BSD-4-Clause", "BSL-1.0", "CDDL-1.0", "CECILL-2.1", "ECL-2.0", "EPL-1.0", "EPL-2.0", "EUPL-1.2",
    "ISC", "MIT", "MIT-0", "MPL-1.1", "MPL-2.0", "MS-PL", "MulanPSL-2.0", "NCSA", "OFL-1.1", "OSL-3.0", "PostgreSQL", "PSF-2.0", "Python-2.0", "Unicode-3.0", "Unlicense", "UPL-1.0", "Vim", "W3C", "WTFPL", "X11", "Zlib",
    *(f"{family}-{version}{end}" for family, versions in (("GPL", ("2.0", "3.0")), ("LGPL", ("2.0", "2.1", "3.0")), ("AGPL", ("3.0",))) for version in versions for end in ("", "-only", "-or-later")),
    "CC0-1.0", *(licence for licence, *_ in _CC),
)
SPDX_EXCEPTIONS = ("Autoconf-exception-3.0", "Bison-exception-2.2", "Bootloader-exception", "Classpath-exception-2.0", "Font-exception-2.0", "GCC-exception-2.0", "GCC-exception-3.1", "Linux-syscall-note", "LLVM-exception", "OpenSSL-exception")
SPDX_TAG = "spdx license identifier"
SPDX_EXPRESSION = r"SPDX-License-Identifier:[ \t]*([A-Za-z0-9.+() \t-]*)"


def _versions(licence: str, bases: tuple[str, ...], versions: tuple[str, ...]) -> list[tuple[str, str]]:
    """(licence, name) for each way in which names write a version; with `or later` too where licences have that form."""
    plain = [f"{base}{sep}{v}" for base in bases for v in versions for sep in (" ", " v", " version ", "v", " Version v")]
    later = [f"{name} {end}" for name in plain for end in ("or later", "or any later version", "or at your option any later version")]
    return [(licence, name) for name in plain] + [(f"{licence}-or-later", name) for name in later if "GPL" in licence]


# Names of licences in notices and titles.
NAMES = tuple(
    (licence, normal(name))
    for licence, name in (
        ("MIT", "MIT"), ("MIT", "MIT License"), ("MIT", "Expat License"), ("ISC", "ISC"), ("ISC", "ISC License"), ("Zlib", "zlib License"), ("Unlicense", "Unlicense"), ("Unlicense", "The Unlicense"),
        ("WTFPL", "WTFPL"), ("WTFPL", "Do What The Fuck You Want To Public License"), ("BSD", "BSD License"),
        *(("BSD-3-Clause", name) for name in ("BSD-3-Clause", "BSD 3-Clause License", "3-Clause BSD License", "New BSD License", "Modified BSD License", "BSD 3-Clause New or Revised License")),
        *(("BSD-2-Clause", name) for name in ("BSD-2-Clause", "BSD 2-Clause License", "2-Clause BSD License", "Simplified BSD License", "BSD 2-Clause Simplified License", "FreeBSD License")),
        *_versions("Apache-2.0", ("Apache", "Apache License", "Apache Software License"), ("2", "2.0")), ("Apache-2.0", "Apache-2.0"), ("Apache-2.0", "Apache 2.0 License"),
        *(
            pair
            for family, title in (("GPL", "General Public License"), ("LGPL", "Lesser General Public License"), ("AGPL", "Affero General Public License"))
            for version, ways in (("2.0", ("2", "2.0")), ("2.1", ("2.1",)), ("3.0", ("3", "3.0")))
            if (family, version) not in {("GPL", "2.1"), ("AGPL", "2.0"), ("AGPL", "2.1")}
            for pair in _versions(f"{family}-{version}", (family, f"GNU {family}", f"GNU {title}", f"GNU {title} {family}"), ways)
        ),
        *_versions("MPL-2.0", ("MPL", "Mozilla Public License"), ("2.0",)), *_versions("EPL-2.0", ("EPL", "Eclipse Public License"), ("2.0",)), *_versions("EPL-1.0", ("EPL", "Eclipse Public License"), ("1.0",)),
        *_versions("BSL-1.0", ("Boost Software License",), ("1.0",)), *_versions("OFL-1.1", ("SIL Open Font License",), ("1.1",)), *_versions("Artistic-2.0", ("Artistic License",), ("2.0",)),
        ("CC0-1.0", "CC0"), ("CC0-1.0", "CC0 1.0"), ("CC0-1.0", "CC0 1.0 Universal"),
        *((licence, name) for licence, _, full, short in _CC for name in (short, f"Creative Commons {full}", full, f"Creative Commons {full} Public License")),
    )
)
RULES = (*RULES, LicenceRule("MIT", ("mit-grant", "mit-condition")), LicenceRule("WTFPL", ("wtfpl-terms",)))
RULES = (*RULES, *(LicenceRule(name, (f"{kind}-{name}",)) for kind, names in (("spdx", SPDX_NAMES), ("notice", [licence for licence, _ in NAMES])) for name in dict.fromkeys(names)))
MORE_SENTENCES = (*MORE_SENTENCES, ("wtfpl-terms", "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed"))
#: All wordings besides SENTENCES: (identifiers, normalised sentence).
WORDINGS = (*FULL_SENTENCES, *(((i,), normal(text)) for i, text in (*MORE_SENTENCES, *CC_SENTENCES)))
#: Where a sentence has a name of its own.
SLOT = "{}"
# Fixed values: (identifiers, sentence with slots). GNU's sentences have a program's name for "this program".
_ENDORSE = "may be used to endorse or promote products derived from this software without specific prior written permission"
SLOTTED = (
    *((("bsd-endorse",), f"neither the name of {SLOT} nor the names of {whose} contributors {_ENDORSE}") for whose in ("its", "the", "any", "other", "their")),
    *((("bsd-endorse",), f"the {name} of {SLOT} may not be {_ENDORSE[7:]}") for name in ("name", "names")),
    *(
        (names, sentence.replace(own, SLOT, 1))
        for names, sentence in (*((("gpl-" + part,), SENTENCES["gpl-" + part]) for part in ("redistribute", "nowarranty", "received")), *WORDINGS)
        if names[0].rpartition("-")[2] in {"redistribute", "nowarranty", "received"}
        for own in ("this program", "this library")
        if own in sentence
    ),
)
#: Known sentences of so many words or more may stand anywhere in a text.
LONG_WORDS = 9

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Of the SQL form, which looks at each line by itself: a sentence ends at a line's end, or at a full stop, question or
# exclamation mark before white space. Both agree on texts without wrapped or complete licence sentences.
SENTENCE_END = r"([.!?])[ \t\r]+"
NOT_NORMAL = "[^a-z0-9]+"


def normal_text(text: Column) -> Column:
    """Words of letters and digits between single blanks; a newline for a line's end, STOP for the end of a sentence or
    paragraph (a line without letters and digits parts paragraphs), without blanks around either."""
    lower = F.translate(F.coalesce(text, F.lit("")), UPPER + STOP, LOWER + " ")
    ended = F.regexp_replace(lower, r"[.!?](?:[ \t\r]+|\n)", STOP)
    parted = F.regexp_replace(ended, r"\n[^a-z0-9\x01]*\n", STOP)
    words = F.regexp_replace(parted, r"[^a-z0-9\n\x01]+", " ")
    return F.trim(F.regexp_replace(words, r" ?([\n\x01]) ?", "$1"))


def _any_of(sentences: list[str]) -> str:
    """A pattern for the longest of the sentences that begin at one place. Sentences are tried by their first word."""
    by_word: dict[str, list[str]] = {}
    for sentence in sorted(sentences, key=len, reverse=True):
        word, _, rest = sentence.partition(" ")
        by_word.setdefault(word, []).append(f" {rest}" if rest else "")
    groups = [word + "(?:" + "|".join(rests).replace(" ", r"[ \n]") + ")" for word, rests in by_word.items()]
    return "(?:" + "|".join(groups) + ")"


#: A slot's words; a name may have an abbreviation's full stop in it.
SLOT_WORDS = r"[a-z0-9]+(?:[ \n\x01][a-z0-9]+){0,11}?"
AT_START, AT_END = r"(?<![^\n\x01])", r"(?![^\n\x01])"


def _slot_pattern(sentence: str) -> str:
    start = AT_START if sentence.startswith(SLOT) else "(?<![a-z0-9])"
    pieces = [piece.replace(" ", r"[ \n]") for piece in re.split(f"{SLOT} ?", sentence)]
    ended = SLOT_WORDS + (r"[ \n\x01]" if pieces[-1] else "")
    return start + ended.join(pieces) + "(?![a-z0-9])"


def _names_pattern(names: list[str]) -> str:
    return "(?:" + "|".join(sorted(dict.fromkeys(names), key=lambda n: (-len(n), n))).replace("license", "licen[cs]e") + ")"


def notice_pattern(names: tuple[tuple[str, str], ...] = NAMES) -> str:
    """Notices and titles, as whole lines or sentences; blanks may be the ends of lines. A title begins with `the` only
    where its short name stands behind it, as other such lines go on from what is above them."""
    named = [n for _, n in names if "license" in n]
    bare = [n for _, n in names if "license" not in n]
    full = f"(?:{_names_pattern(named)}|{_names_pattern(bare)} licen[cs]e)" if bare else _names_pattern(named)
    some = f"(?:{_names_pattern([n for _, n in names])}(?: licen[cs]e)?)"
    subject = "(?:(?:this|the|our|all) (?:[a-z0-9]+ ){1,6}?(?:is|are) )?(?:dual )?"
    under = " under (?:the )?(?:terms (?:and conditions )?of )?(?:either (?:of )?)?(?:the |an? )?"
    pointer = "(?: at your option)?(?: see (?:the )?(?:[a-z0-9]+ ){1,6}?for (?:more )?(?:details|information))?"

    def listed(name: str) -> str:
        return f"{name}(?: (?:or|and) (?:the )?{name}){{0,4}}"

    forms = (f"{subject}licensed{under}{listed(some)}{pointer}", f"{subject}(?:released|distributed|published|provided|(?:made )?available){under}{listed(full)}{pointer}", f"{full}(?: (?:mit|isc))?", f"the {full} (?:mit|isc)")
    return AT_START + "(?:" + "|".join(forms).replace(" ", r"[ \n]") + ")" + AT_END


def sentence_pattern(sentences: list[str], slotted: list[str] = (), names: tuple[tuple[str, str], ...] = ()) -> str:
    long = [x for x in sentences if len(x.split()) >= LONG_WORDS]
    short = [x for x in sentences if len(x.split()) < LONG_WORDS]
    parts = [rf"(?<![a-z0-9]){_any_of(long)}(?![a-z0-9])"] if long else []
    parts += [AT_START + _any_of(short) + AT_END] if short else []
    parts += [_slot_pattern(x) for x in sorted(slotted, key=len, reverse=True)]
    parts += [notice_pattern(names), AT_START + SPDX_TAG.replace(" ", r"[ \n]") + r" [^\n\x01]+"] if names else []
    return "|".join(parts)


def hints(sentences: list[str]) -> list[str]:
    """A few words of which each sentence has at least one."""
    left, found = [set(re.findall("[a-z0-9]+", x)) for x in sentences], []
    while left := [words for words in left if words]:
        count: dict[str, int] = {}
        for word in (w for words in left for w in words):
            count[word] = count.get(word, 0) + 1
        best = max(count, key=lambda w: (len(w) > 5, count[w], len(w), w))
        found.append(best)
        left = [words for words in left if best not in words]
    return found


def _constant(value: object, of_type: str) -> Column:
    """A list or map as one literal, which the optimiser reads once."""
    return F.from_json(F.lit(json.dumps(value)), of_type)


def _names_in(text: Column, ids: dict[str, str]) -> Column:
    """Identifiers of the names that stand in a text, longer names first where several begin at one place."""
    of = _constant(ids, "map<string,string>")
    found = F.regexp_extract_all(text, F.lit(rf"(?<![a-z0-9]){_names_pattern(list(ids))}(?![a-z0-9])"), F.lit(0))
    return F.array_distinct(F.transform(found, lambda n: of[F.replace(n, F.lit("licence"), F.lit("license"))]))


def _spdx_ids(hit: Column) -> Column:
    """Identifiers of an expression's names; what else but operators and exceptions stands in it is not known."""
    ids = {normal(name): f"spdx-{name}" for name in SPDX_NAMES}
    known = rf"(?<![a-z0-9])(?:{_names_pattern([*ids, *map(normal, SPDX_EXCEPTIONS)])}|or|and|with)(?![a-z0-9])"
    expression = F.substr(hit, F.lit(len(SPDX_TAG) + 2))
    rest = F.trim(F.regexp_replace(expression, known, " "))
    return F.concat(_names_in(expression, ids), F.when(rest == "", F.array().cast("array<string>")).otherwise(F.array(F.lit("spdx-unknown"))))


def sentence_ids(text: Column, known: dict[str, str] = SENTENCES, more: tuple[tuple[tuple[str, ...], str], ...] = WORDINGS, slotted: tuple[tuple[tuple[str, ...], str], ...] = SLOTTED, names: tuple[tuple[str, str], ...] = NAMES) -> Column:
    """Identifiers of the known sentences, in text order: `known` by identifier, `more` and `slotted` (identifiers,
    sentence), and the notices of the licences in `names` (licence, name)."""
    of = {sentence: (name,) for name, sentence in known.items()} | {sentence: found for found, sentence in more}
    none = F.array().cast("array<string>")
    if not of:
        return none
    pattern = sentence_pattern(list(of), [x for _, x in slotted], names)
    words = hints([x for x in (*of, *(x for _, x in slotted)) if not (names and "licen" in x)]) + (["licen"] if names else [])
    lower = F.lower(text)
    slots = _constant([{"ids": found, "pattern": f"^{_slot_pattern(x)}$"} for found, x in sorted(slotted, key=lambda s: -len(s[1]))], "array<struct<ids:array<string>,pattern:string>>")
    exact = _constant(of, "map<string,array<string>>")

    def identified(hit: Column) -> Column:
        line = F.translate(hit, "\n", " ")
        ways = [exact[line]]
        ways += [F.get(F.filter(slots, lambda s: F.rlike(line, s["pattern"])), F.lit(0))["ids"]]
        if names:
            ways += [F.when(line.startswith(SPDX_TAG), _spdx_ids(line)), _names_in(F.regexp_replace(line, "^.*? under ", ""), {n: f"notice-{licence}" for licence, n in names})]
        return F.coalesce(*ways)

    hits = F.regexp_extract_all(normal_text(text), F.lit(pattern), F.lit(0))
    return F.when(reduce(Column.__or__, [F.contains(lower, F.lit(w)) for w in words]), F.flatten(F.transform(hits, identified))).otherwise(none)


def matches(ids: Column, sequence: Column) -> Column:
    """Whether a rule's identifiers are among ids, one after the other: each step leaves what comes after a name."""

    def after(rest: Column, name: Column) -> Column:
        at = F.array_position(rest, name).cast("int")
        return F.when(at > 0, F.slice(rest, at + 1, F.size(rest)))

    return F.aggregate(sequence, ids, after).isNotNull()


def rule_pattern(rule: LicenceRule) -> str:
    """A regular expression over identifiers that each have a blank before and after, for the SQL form. Engines that
    recurse on each repetition (the JVM's) must not run it over long sequences."""
    return "(?: [^ ]+ )*?".join(f" {name} " for name in rule.sequence)


def _rule_numbers(ids: Column, rules: tuple[LicenceRule, ...]) -> Column:
    """Places of the rules whose identifiers are there, ascending. Rules of one identifier are looked up together."""
    single: dict[str, list[int]] = {}
    for k, rule in enumerate(rules):
        if len(rule.sequence) == 1:
            single.setdefault(rule.sequence[0], []).append(k)
    several = _constant([{"k": k, "sequence": rule.sequence} for k, rule in enumerate(rules) if len(rule.sequence) > 1], "array<struct<k:int,sequence:array<string>>>")
    parts = [F.transform(F.filter(several, lambda rule: matches(ids, rule["sequence"])), lambda rule: rule["k"])]
    if single:
        of = _constant(single, "map<string,array<int>>")
        parts.append(F.flatten(F.filter(F.transform(ids, lambda i: of[i]), lambda x: x.isNotNull())))
    return F.array_sort(F.array_distinct(F.concat(*parts)))


def expressions(text: Column) -> Column:
    """SPDX expressions as they stand in a text, blanks squeezed, joined by `; `; null if there is none."""
    found = F.regexp_extract_all(text, F.lit(SPDX_EXPRESSION), F.lit(1))
    plain = F.transform(found, lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, r"[ \t]+", " "), "[ -]+$", "")))
    return F.when(F.contains(text, F.lit("SPDX")), F.nullif(F.array_join(F.filter(plain, lambda x: x != ""), "; "), F.lit("")))


def scan(
    df: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    known: dict[str, str] = SENTENCES,
    rules: tuple[LicenceRule, ...] = RULES,
    more: tuple[tuple[tuple[str, ...], str], ...] = WORDINGS,
    slotted: tuple[tuple[tuple[str, ...], str], ...] = SLOTTED,
    names: tuple[tuple[str, str], ...] = NAMES,
) -> DataFrame:
    """(id, n_known long, sentence_ids, licences, expressions, unresolved); lists of names are joined by one blank, null
    if empty."""
    ids = df.select(F.col(id_col), sentence_ids(F.col(text), known, more, slotted, names).alias("_ids"), expressions(F.col(text)).alias("expressions"))
    some = F.size("_ids") > 0
    hits = ids.select(id_col, "_ids", "expressions", F.when(some, _rule_numbers(F.col("_ids"), rules)).alias("_hits"))
    barred = _constant([[o for o, other in enumerate(rules) if other.licence in r.unless] for r in rules], "array<array<int>>")
    kept = hits.select("*", F.filter("_hits", lambda k: ~F.arrays_overlap(F.col("_hits"), barred[k])).alias("_kept"))
    licence = _constant([r.licence for r in rules], "array<string>")
    sequence = _constant([r.sequence for r in rules], "array<array<string>>")
    found = F.array_distinct(F.transform("_kept", lambda k: licence[k]))
    used = F.flatten(F.transform("_kept", lambda k: sequence[k]))
    return kept.select(
        id_col,
        F.size("_ids").cast("long").alias("n_known"),
        F.when(some, F.array_join("_ids", " ")).alias("sentence_ids"),
        F.when(some, F.nullif(F.array_join(found, " "), F.lit(""))).alias("licences"),
        "expressions",
        F.when(some, F.size(F.array_except("_ids", used)) > 0).otherwise(F.lit(False)).alias("unresolved"),
    )
