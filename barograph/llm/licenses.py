"""Licence scan by sentence rules.

A text is cut into sentences; each is normalised (lower case, no punctuation, single spaces) and looked up in a table
of known licence sentences. A line break may end a sentence or only wrap it, so consecutive lines of a paragraph are
looked up together as well, the longest known run first. The identifiers found, in the order of the text, are matched against ordered licence rules:
a rule is a sequence of identifiers that must follow each other with nothing known between them; longer rules go first
and what they cover is not matched again.

Everything is DataFrame functions. Defined results: a null or empty text has no sentences and no licences; repeated rows
are scanned each for itself; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Licence sentences, normalised, with their identifiers.
SENTENCES = {
    "licensed under the apache license version 2 0": "apache-2.0-ref",
    'licensed under the apache license version 2 0 the license': "apache-2.0-ref",
    "you may not use this file except in compliance with the license": "apache-2.0-use",
    "you may obtain a copy of the license at http www apache org licenses license 2 0": "apache-2.0-url",
    "spdx license identifier apache 2 0": "apache-2.0-ref",
    "released under the mit license": "mit-ref",
    "licensed under the mit license": "mit-ref",
    "this project is licensed under the mit license": "mit-ref",
    "spdx license identifier mit": "mit-ref",
    "the software is provided as is without warranty of any kind": "mit-warranty",
    "this work is licensed under the gnu general public license version 3": "gpl-3.0-ref",
    "licensed under the gnu general public license version 3": "gpl-3.0-ref",
    "spdx license identifier gpl 3 0": "gpl-3.0-ref",
    "spdx license identifier gpl 3 0 only": "gpl-3.0-ref",
    "licensed under cc by nc 4 0": "cc-by-nc-4.0-ref",
    "this work is licensed under cc by nc 4 0": "cc-by-nc-4.0-ref",
    "licensed under cc by 4 0": "cc-by-4.0-ref",
    "licensed under cc by sa 4 0": "cc-by-sa-4.0-ref",
    "all rights reserved": "rights-reserved",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd-grant",
    "licensed under the mozilla public license version 2 0": "mpl-2.0-ref",
}
# Names of licences as they stand in headings and references; the first is the SPDX identifier.
NAMES = {
    "mit": ("MIT", "mit", "mit license", "expat license"),
    "apache-2.0": ("Apache-2.0", "apache 2 0", "apache license 2 0", "apache license version 2 0", "apache 2 0 license",
                   "apache software license 2 0", "apache license v2 0"),
    "bsd-2-clause": ("BSD-2-Clause", "bsd 2 clause", "bsd 2 clause license", "2 clause bsd license", "simplified bsd license"),
    "bsd-3-clause": ("BSD-3-Clause", "bsd 3 clause", "bsd 3 clause license", "3 clause bsd license", "new bsd license",
                     "modified bsd license"),
    "isc": ("ISC", "isc", "isc license"),
    "mpl-2.0": ("MPL-2.0", "mpl 2 0", "mozilla public license 2 0", "mozilla public license version 2 0",
                "mozilla public license v 2 0"),
    "unlicense": ("Unlicense", "unlicense"),
    "cc0-1.0": ("CC0-1.0", "cc0 1 0", "cc0 1 0 universal", "creative commons zero v1 0 universal", "cc0 1 0 license",
                "creative commons cc0 1 0 universal license"),
    **{f"{short}gpl-{v}": (f"{short.upper()}GPL-{v}", f"{short}gpl {w}", f"gnu {short}gpl {w}", f"gnu {short}gpl version {x}",
                           f"gnu {name}general public license {w}", f"gnu {name}general public license version {x}",
                           f"gnu {name}general public license v{w}", f"{short}gpl v{x}", f"{short}gplv{x}",
                           f"gnu {name}general public license v{x}", f"gnu {short}gpl v{x}", f"{short}gpl {w} only",
                           f"{short}gpl {w} or later")
       for short, name, v in (("", "", "2.0"), ("", "", "3.0"), ("l", "lesser ", "2.1"), ("l", "lesser ", "3.0"),
                              ("a", "affero ", "3.0"))
       for w, x in [(v.replace(".", " "), v.removesuffix(".0").replace(".", " "))]},
    **{f"cc-{'-'.join(terms)}-{v}": (f"CC-{'-'.join(terms).upper()}-{v}", f"cc {' '.join(terms)} {w}", f"cc {' '.join(terms)} {w} license",
                                     f"creative commons {full} {w} international license", f"creative commons {full} {w} international")
       for terms, full in ((("by",), "attribution"), (("by", "sa"), "attribution sharealike"), (("by", "nd"), "attribution noderivatives"),
                           (("by", "nc"), "attribution noncommercial"), (("by", "nc", "sa"), "attribution noncommercial sharealike"),
                           (("by", "nc", "nd"), "attribution noncommercial noderivatives"))
       for v in ("3.0", "4.0") for w in [v.replace(".", " ")]},
}
#: Sentences that only name a licence.
REFERENCES = ("licensed under {}", "licensed under the {}", "released under {}", "released under the {}", "distributed under the {}",
              "available under the {}", "this work is licensed under {}", "this work is licensed under the {}",
              "this work is licensed under a {}", "this project is licensed under {}", "this project is licensed under the {}",
              "this software is licensed under the {}", "this software is released under the {}",
              "this software is distributed under the {}", "this program is licensed under the {}", "this file is licensed under the {}",
              "this package is licensed under the {}", "this library is licensed under the {}", "license {}", "license the {}",
              "spdx license identifier {}", "this project is licensed under the {} see the license file for details",
              "this project is licensed under the {} see the license md file for details")
# Texts of licences and their notices by the beginning of their identifiers; a sentence that differs in the
# common variants stands once for each.
_BSD = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met:")
_FSF = ("as published by the Free Software Foundation", "(at your option) any later version.")
TEXTS = {
    "mit-grant": ('Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated '
                  'documentation files (the "Software"), to deal in the Software without restriction, including without limitation the '
                  'rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to '
                  'permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    "mit-notice": ("The above copyright notice and this permission notice shall be included in all copies or substantial portions of the "
                   "Software.",
                   "The above copyright notice and this permission notice (including the next paragraph) shall be included in all copies "
                   "or substantial portions of the Software."),
    "mit-warranty": ('THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO '
                     'THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
                     'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO '
                     'THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NON-INFRINGEMENT.'),
    "mit-liability": tuple(f"IN NO EVENT SHALL {who} BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF "
                           "CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER "
                           "DEALINGS IN THE SOFTWARE." for who in ("THE AUTHORS OR COPYRIGHT HOLDERS", "THE AUTHORS")),
    "bsd-grant": _BSD,
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": ("Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following "
                   "disclaimer in the documentation and/or other materials provided with the distribution."),
    "bsd-name": tuple(f"Neither the name of {who} nor the names of its contributors may be used to endorse or promote products derived "
                      "from this software without specific prior written permission."
                      for who in ("the copyright holder", "the organization", "the author")),
    "bsd-warranty": ('THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, '
                     'INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE '
                     'DISCLAIMED.'),
    "isc-grant": tuple(f"Permission to use, copy, modify, {both} distribute this software for any purpose with or without fee is hereby "
                       "granted, provided that the above copyright notice and this permission notice appear in all copies."
                       for both in ("and", "and/or")),
    "unlicense-grant": "This is free and unencumbered software released into the public domain.",
    "mpl-2.0-ref": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
                    "This Source Code Form is subject to the terms of the Mozilla Public License, v.2.0."),
    "cc0-1.0-ref": ("To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to "
                    "this software to the public domain worldwide."),
    "apache-2.0-ref": 'Licensed under the Apache License, Version 2.0 (the "License")',
    "apache-2.0-url": "You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0",
    "apache-2.0-head": "Apache License Version 2.0, January 2004",
    "apache-2.0-warranty": ('Unless required by applicable law or agreed to in writing, software distributed under the License is '
                            'distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'),
    **{f"{short}gpl-{v}-ref": tuple(
        f"{subject} is free software: you can redistribute it and/or modify it under the terms of the GNU {name}General Public License "
        f"{_FSF[0]}, either version {v.removesuffix('.0')} of the License, or {_FSF[1]}"
        for subject in ("This program", "This library", "This file", "This software"))
       + (f"GNU {name}GENERAL PUBLIC LICENSE Version {v.removesuffix('.0')}, {month}",)
       for short, name, v, month in (("", "", "3.0", "29 June 2007"), ("l", "Lesser ", "3.0", "29 June 2007"),
                                     ("a", "Affero ", "3.0", "19 November 2007"), ("", "", "2.0", "June 1991"),
                                     ("l", "Lesser ", "2.1", "February 1999"))},
    # The older notices have semicolons, which end sentences: who may what, and which version.
    **{f"{short}gpl-terms": f"you can redistribute it and/or modify it under the terms of the GNU {name}General Public License {_FSF[0]}"
       for short, name in (("", ""), ("l", "Lesser "))},
    **{f"version-{v}-or-later": f"either version {v} of the License, or {_FSF[1]}" for v in ("2", "2.1", "3")},
    **{f"{short}gpl-{v}-ref-comma": f"you can redistribute it and/or modify it under the terms of the GNU {name}General Public License "
                                    f"{_FSF[0]}, either version {v.removesuffix('.0')} of the License, or {_FSF[1]}"
       for short, name, v in (("", "", "2.0"), ("", "", "3.0"), ("l", "Lesser ", "2.1"), ("l", "Lesser ", "3.0"))},
}


def _words(sentence: str) -> str:
    return " ".join(re.sub(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ", sentence.lower()).split())


def _all_sentences() -> dict[str, str]:
    out = dict(SENTENCES)
    for key, variants in TEXTS.items():
        for sentence in (variants,) if isinstance(variants, str) else variants:
            out.setdefault(_words(sentence), key.removesuffix("-comma"))
    # A colon doesn't end a sentence: on one line, the grant and the notice of MIT are one.
    out[_words(TEXTS["mit-grant"] + " " + TEXTS["mit-notice"][0])] = "mit-grant"
    for key, (_, *names) in NAMES.items():
        for name in names:
            for sentence in [form.format(name) for form in REFERENCES] + ([name, f"the {name}"] if "licen" in name else []):
                out.setdefault(sentence, f"{key}-ref")
    return out


SENTENCES = _all_sentences()
# Ordered rules, longest first.
RULES = (
    (("apache-2.0-ref", "apache-2.0-use", "apache-2.0-url"), "Apache-2.0"),
    (("mit-grant", "mit-notice", "mit-warranty", "mit-liability"), "MIT"),
    (("bsd-grant", "bsd-source", "bsd-binary", "bsd-name"), "BSD-3-Clause"),
    (("bsd-grant", "bsd-source", "bsd-binary"), "BSD-2-Clause"),
    (("mit-ref", "mit-warranty"), "MIT"),
    (("mit-warranty", "mit-liability"), "MIT"),
    (("gpl-terms", "version-2-or-later"), "GPL-2.0"),
    (("gpl-terms", "version-3-or-later"), "GPL-3.0"),
    (("lgpl-terms", "version-2.1-or-later"), "LGPL-2.1"),
    (("lgpl-terms", "version-3-or-later"), "LGPL-3.0"),
    (("apache-2.0-ref",), "Apache-2.0"),
    (("mit-ref",), "MIT"),
    (("gpl-3.0-ref",), "GPL-3.0"),
    (("cc-by-nc-4.0-ref",), "CC-BY-NC-4.0"),
    (("cc-by-4.0-ref",), "CC-BY-4.0"),
    (("cc-by-sa-4.0-ref",), "CC-BY-SA-4.0"),
    (("mpl-2.0-ref",), "MPL-2.0"),
    (("bsd-grant",), "BSD"),
    (("rights-reserved",), "all-rights-reserved"),
    (("mit-grant",), "MIT"),
    (("apache-2.0-head",), "Apache-2.0"),
    (("isc-grant",), "ISC"),
    (("unlicense-grant",), "Unlicense"),
)
RULES += tuple(((f"{key}-ref",), spdx) for key, (spdx, *_) in NAMES.items() if ((f"{key}-ref",) not in [r for r, _ in RULES]))


def sentences(text: Column) -> Column:
    """Sentences end at a line break, or at . ! ? or ; before white space."""
    return F.split(text, r"(?<=[.!?;])[\x20\x09]+|[\n\r]+")


def normalised(sentence: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(sentence, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"),
                                   r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))


#: A text without any of these holds no sentence of the table.
HINT = r"(?i)licen[sc]e|rights|redistribut|warrant|permission|in no event|public domain|liable|licensed|released under|distributed under|available under|either\s+[\W_]*version"
#: A known sentence between two ends of lines or sentences, with or without line breaks inside; longest first.
KNOWN = r"(?<=\| )(?:" + "|".join(x.replace(" ", r" (?:\| )?") for x in sorted(SENTENCES, key=len, reverse=True)) + r")(?= \|)"


#: The clause of BSD that names somebody, however many words the name has; it then reads like that of a copyright holder.
NAMED = "neither the name of {}nor the names of its contributors"


def unnamed(text: Column) -> Column:
    """A marked text with the holder's name out of the BSD clause; "Inc." in a name ends no sentence there."""
    broken = lambda x: x.replace(" ", r" (?:\| )?")
    return F.regexp_replace(text, broken("neither the name of ") + r"(?:[^ |]+ (?:\|\|? )?){1,20}?" + broken("nor the names of its contributors"),
                            NAMED.format("the copyright holder "))


def marked(text: Column) -> Column:
    """The normalised text with | at a line break inside a paragraph and || where a sentence or a paragraph ends."""
    ends = F.split(text, r"(?<=[.!?;])[\x20\x09]*[\n\r]+|(?<=[.!?;])[\x20\x09]+|(?:\r?\n|\r)[\x20\x09]*(?:\r?\n|\r)[\x20\x09\n\r]*")
    lines = F.transform(ends, lambda e: F.array_join(F.transform(F.split(e, r"[\n\r]+"), normalised), " | "))
    return F.concat(F.lit("|| "), F.array_join(lines, " || "), F.lit(" ||"))


def licences(docs: DataFrame) -> DataFrame:
    """doc_id, n_sentences, sentence_ids (in the order of the text), licences (sorted, distinct) of every document."""
    pieces = F.filter(sentences(F.coalesce("text", F.lit(""))), lambda s: F.length(F.trim(s)) > 0)
    known = F.create_map(*[F.lit(x) for pair in SENTENCES.items() for x in pair])
    found = F.when(F.coalesce("text", F.lit("")).rlike(HINT), F.transform(
        F.regexp_extract_all(unnamed(marked(F.col("text"))), F.lit(KNOWN), F.lit(0)), lambda m: known[F.replace(m, F.lit(" | "), F.lit(" "))]))
    found = F.coalesce(found, F.array().cast("array<string>"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), pieces.alias("pieces"), found.alias("found"))
    rows = rows.select("doc_id", F.size("pieces").cast("long").alias("n_sentences"),
                       F.col("found").alias("ids"))
    left, hits = F.concat(F.lit(" "), F.array_join("ids", "  "), F.lit(" ")), []
    for sequence, name in RULES:
        mark = " " + "  ".join(sequence) + " "
        hits.append(F.when(left.contains(mark), F.lit(name)))
        left = F.replace(left, F.lit(mark), F.lit(" / "))
    names = F.array_sort(F.array_distinct(F.array_compact(F.array(*hits))))
    return rows.select("doc_id", "n_sentences", F.array_join("ids", ",").alias("sentence_ids"),
                       F.array_join(names, ",").alias("licences"))
