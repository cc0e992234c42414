"""Licence scan by canonical digest lookup.

A unit of text is normalised (case, copyright lines, punctuation, equivalent
spellings, white space) and digested; the digest is joined with the digests
of known licence texts. Units are the document's entire text, each of its
entire lines, and runs of neighbouring lines: a document may be a licence, or
carry a licence statement, wrapped over any number of lines or not. Statements
are derived from templates and a table of licence names. The names that fill
places of the BSD texts are normalised in entire texts, whatever their length.

Scale: every step is one projection; the known digests are fixed tables of
some hundred rows, broadcast, so no document is shuffled. A line is normalised
once and the entire text is put together from its lines; runs of lines that
read like a known statement are found by one pattern (all statements as a tree
of words, tried at line starts only) and looked up by digest in a literal map,
which keeps the row whole without exploding it and grouping it again. The
patterns are possessive or start at line starts only: linear on any text.

Edge cases: null and empty texts match nothing (the digest of nothing is not
a licence); a text of copyright lines only normalises to nothing and matches
nothing; repeated rows each get their own result; row order is irrelevant.
"""

from __future__ import annotations

import hashlib
import re
from importlib import resources

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seedgrow.llm.common import read_table, text_or_empty

# Equivalent spellings (left is written as right).
SPELLINGS = [
    ("licence", "license"), ("licenced", "licensed"), ("licences", "licenses"), 
    ("authorisation", "authorization"), ("organisation", "organization"), ("acknowledgement", "acknowledgment"),
    ("analogue", "analog"), ("analyse", "analyze"), ("artefact", "artifact"), ("catalogue", "catalog"),
    ("centre", "center"), ("emphasised", "emphasized"), ("favour", "favor"), ("favourite", "favorite"),
    ("fulfil", "fulfill"), ("fulfilment", "fulfillment"), ("initialise", "initialize"), ("judgement", "judgment"),
    ("labelling", "labeling"), ("labour", "labor"), ("modelling", "modeling"),
    ("noncommercial", "non commercial"), ("optimisation", "optimization"), ("practise", "practice"),
    ("programme", "program"), ("realise", "realize"), ("recognise", "recognize"), ("sublicence", "sublicense"),
    ("utilisation", "utilization"), ("whilst", "while"), ("wilful", "willful"), ("gpl", "gnu general public license"),
]

_WARRANTY_UPPER = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED '
    "TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL "
    "THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF "
    "CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER "
    "DEALINGS IN THE SOFTWARE."
)
_ISC_GRANT = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
    "granted"
)
_ISC_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING '
    "ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, "
    "DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR "
    "PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION "
    "WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
# Known licence texts and statements by their SPDX names.
KNOWN = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    (
        "MIT",
        "MIT License\nCopyright (c) <year> <holder>\nPermission is hereby granted, free of charge, to any person "
        'obtaining a copy of this software and associated documentation files (the "Software"), to deal in the '
        "Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, "
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is "
        "furnished to do so, subject to the following conditions:\nThe above copyright notice and this permission "
        "notice shall be included in all copies or substantial portions of the Software.\n" + _WARRANTY_UPPER,
    ),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in '
        "compliance with the License. You may obtain a copy of the License at\nhttp://www.apache.org/licenses/"
        "LICENSE-2.0\nUnless required by applicable law or agreed to in writing, software distributed under the "
        'License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or '
        "implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "Licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0-only", "SPDX-License-Identifier: GPL-2.0-only"),
    ("LGPL-3.0-only", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0-only", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Licensed under CC0 1.0."),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    (
        "ISC",
        "ISC License\nCopyright (c) <year> <holder>\n" + _ISC_GRANT + ", provided that the above copyright notice and "
        "this permission notice appear in all copies.\n" + _ISC_WARRANTY,
    ),
    ("0BSD", "BSD Zero Clause License\nCopyright (c) <year> <holder>\n" + _ISC_GRANT + ".\n" + _ISC_WARRANTY),
]

# Licences by their SPDX names, and what statements call them.
LICENSE_NAMES = {
    "MIT": ["MIT License", "MIT"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache 2.0", "Apache License v2.0"],
    "GPL-2.0-only": ["GNU General Public License, version 2", "GNU General Public License v2.0", "GNU GPL v2", "GPL v2", "GPLv2"],
    "GPL-2.0-or-later": ["GNU General Public License, version 2 or later", "GPL v2 or later", "GPLv2+ or later"],
    "GPL-3.0-only": ["GNU General Public License, version 3", "GNU General Public License v3.0", "GNU GPL v3", "GPL v3", "GPLv3"],
    "GPL-3.0-or-later": ["GNU General Public License, version 3 or later", "GPL v3 or later"],
    "LGPL-2.1-only": ["GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License v2.1", "LGPL v2.1", "LGPLv2.1"],
    "LGPL-2.1-or-later": ["GNU Lesser General Public License, version 2.1 or later", "LGPL v2.1 or later"],
    "LGPL-3.0-only": ["GNU Lesser General Public License, version 3", "GNU Lesser General Public License v3.0", "LGPL v3", "LGPLv3"],
    "LGPL-3.0-or-later": ["GNU Lesser General Public License, version 3 or later", "LGPL v3 or later"],
    "AGPL-3.0-only": ["GNU Affero General Public License, version 3", "GNU Affero General Public License v3.0", "AGPL v3", "AGPLv3"],
    "AGPL-3.0-or-later": ["GNU Affero General Public License, version 3 or later", "AGPL v3 or later"],
    "MPL-2.0": ["Mozilla Public License, v. 2.0", "Mozilla Public License 2.0", "Mozilla Public License, version 2.0", "MPL 2.0"],
    "BSD-2-Clause": ["BSD 2-Clause License", "2-Clause BSD License", "Simplified BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "3-Clause BSD License", "New BSD License", "Revised BSD License"],
    "ISC": ["ISC License", "ISC"],
    "0BSD": ["BSD Zero Clause License", "Zero-Clause BSD License", "0BSD License"],
    "Unlicense": ["Unlicense"],
    "Zlib": ["zlib License"],
    "BSL-1.0": ["Boost Software License 1.0", "Boost Software License, Version 1.0"],
    "EPL-2.0": ["Eclipse Public License 2.0", "Eclipse Public License, version 2.0", "Eclipse Public License v2.0"],
    "CC0-1.0": ["CC0 1.0", "CC0 1.0 Universal", "Creative Commons Zero 1.0"],
    "CC-BY-4.0": ["CC BY 4.0", "Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-ND-4.0": ["CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"],
    "CC-BY-NC-SA-4.0": ["CC BY-NC-SA 4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"],
    "CC-BY-NC-ND-4.0": ["CC BY-NC-ND 4.0", "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"],
}
# Older identifiers.
_OLD_IDS = {"GPL-2.0": "GPL-2.0-only", "GPL-3.0": "GPL-3.0-only", "LGPL-2.1": "LGPL-2.1-only", "LGPL-3.0": "LGPL-3.0-only", "AGPL-3.0": "AGPL-3.0-only"}
# How statements begin.
_SUBJECTS = ["", *(f"{a} {b} is " for a in ("This", "The") for b in ("project", "program", "work", "software", "file", "code", "library", "package"))]
_VERBS = ["licensed under", "released under", "distributed under"]


def statements() -> list[tuple[str, str]]:
    """(SPDX name, statement) from the templates and the names."""
    out = [(i, f"SPDX-License-Identifier: {i}") for i in LICENSE_NAMES]
    out += [(i, f"SPDX-License-Identifier: {old}") for old, i in _OLD_IDS.items()]
    for i, names in LICENSE_NAMES.items():
        out += [(i, f"{who}{verb} {the}{n}") for n in names for who in _SUBJECTS for verb in _VERBS
                for the in (("", "the ") if "icense" in n else ("",))]
    return out


# A copyright line: its first word or sign claims copyright.
_COPYRIGHT_LINE = r"^[\W_]*(copyright\b|©|\(c\)|all rights reserved).*$"
_PUNCTUATION = r"[^0-9a-zß-ÿ]+"


# A copyright line beyond doubt: year or placeholder follows. Wrapped anew, a
# line of a licence's own text may start with the word alone.
_DATED_LINE = (
    r"^[\W_]*(?:(?:(?:copyright|©|\(c\))\W*)+(?:\d{4}|y{4}|year)\b|all rights reserved).*$"
)
_BREAK = "\r\n|[\n\r\u0085\u2028\u2029]"
# Names that fill the places of a licence text, in canonical form.
_NAMES = [
    (r"neither the names? of (?:(?! nor the names of | neither the name).)++ nor the names of (?:its|their|his|her|any|other)? ?contributors",
     "neither the name of the copyright holder nor the names of its contributors"),
    (r"software is provided by (?:(?! as is and any express| software is provided by ).)++ as is and any express",
     "software is provided by the copyright holders and contributors as is and any express"),
    (r"in no event shall (?:(?! be liable for any direct| in no event shall ).)++ be liable for any direct",
     "in no event shall the copyright holder or contributors be liable for any direct"),
]


def _normal(text: Column) -> Column:
    """The normalised form, copyright lines included (JVM expressions only)."""
    t = F.trim(F.regexp_replace(F.lower(text), _PUNCTUATION, " "))
    # Padded, with doubled blanks, so that neighbouring words both match.
    t = F.concat(F.lit(" "), F.replace(t, F.lit(" "), F.lit("  ")), F.lit(" "))
    for a, b in SPELLINGS:
        if a != b:
            t = F.replace(t, F.lit(f" {a} "), F.lit(f" {b} "))
    return F.trim(F.replace(t, F.lit("  "), F.lit(" ")))


def _normal_py(text: str) -> str:
    t = re.sub(_PUNCTUATION, " ", text.lower()).strip(" ")
    t = " " + t.replace(" ", "  ") + " "
    for a, b in SPELLINGS:
        if a != b:
            t = t.replace(f" {a} ", f" {b} ")
    return t.replace("  ", " ").strip(" ")


def canonical_py(text: str) -> str:
    """The normalised form without copyright lines, of the fixed texts."""
    return _normal_py(re.sub(_COPYRIGHT_LINE, "", text.lower(), flags=re.M | re.A))


def _named(t: Column) -> Column:
    out = t
    for a, b in _NAMES:
        out = F.regexp_replace(out, a, b)
    return F.when(t.contains("software is provided by"), out).otherwise(t)


def _named_py(t: str) -> str:
    if "software is provided by" in t:
        for a, b in _NAMES:
            t = re.sub(a, b, t)
    return t


def known_digests() -> dict[str, str]:
    """sha256 of the canonical form -> SPDX name, of KNOWN and the statements."""
    out = {hashlib.sha256(canonical_py(t).encode()).hexdigest(): name for name, t in KNOWN}
    for name, t in statements():
        out.setdefault(hashlib.sha256(canonical_py(t).encode()).hexdigest(), name)
    return out


def _tree(texts: list[list[str]]) -> str:
    """Pattern of the given word lists, longest first, words being parted by a
    blank or one line break, up to the end of a line."""
    prefix: list[str] = []
    while texts and all(t and t[0] == texts[0][0] for t in texts):
        prefix.append(texts[0][0])
        texts = [t[1:] for t in texts]
    heads: dict[str, list[list[str]]] = {}
    for t in texts:
        if t:
            heads.setdefault(t[0], []).append(t)
    ways = [_tree(heads[h]) for h in sorted(heads)]
    gap = "[ \n]" if prefix else ""
    if not all(texts):
        rest = f"(?:{gap}(?:{'|'.join(ways)})|$)" if ways else "$"
    else:
        rest = f"{gap}(?:{'|'.join(ways)})"
    return "[ \n]".join(prefix) + rest


def statement_pattern() -> str:
    """What finds every known statement of whole lines, wrapped or not."""
    texts = {canonical_py(t) for _, t in [*KNOWN, *statements()]}
    return "(?m)^(?:" + _tree([t.split(" ") for t in sorted(texts)]) + ")"


# Titles that whole texts come with.
_TITLES = {
    "MIT": ["MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)", "License: MIT"],
    "ISC": ["ISC License", "The ISC License", "ISC License (ISC)"],
    "0BSD": ["BSD Zero Clause License", "Zero-Clause BSD", "0BSD"],
    "BSD-2-Clause": ["BSD 2-Clause License", "The BSD 2-Clause License", "The 2-Clause BSD License", "Simplified BSD License",
                     'BSD 2-Clause "Simplified" License', "BSD License", "The BSD License", "FreeBSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "The BSD 3-Clause License", "The 3-Clause BSD License", "New BSD License",
                     "The New BSD License", 'BSD 3-Clause "New" or "Revised" License', "Revised BSD License",
                     "Modified BSD License", "BSD License", "The BSD License"],
}


def whole_texts() -> list[tuple[str, str]]:
    """(SPDX name, text) of whole licences, in their usual variants: as
    shipped in ``license_texts``, without the title and address above the
    first rule, without the appendix; short ones under each title and without,
    with numbers, letters or bullets."""
    out = []
    for f in sorted(resources.files("seedgrow.llm").joinpath("license_texts").iterdir(), key=lambda f: f.name):
        if f.name.endswith(".txt"):
            name = f.name.removesuffix(".txt").removesuffix(".spdx")
            out.append((name, f.read_text(encoding="utf-8")))
    out += [(name, t.split("\n", 1)[1]) for name, t in KNOWN if name in _TITLES and "<holder>" in t]
    texts = []
    for name, t in out:
        cuts = {t}
        for mark in (r"END OF TERMS AND CONDITIONS", r"APPENDIX: How to apply", r"How to Apply These Terms", r"Exhibit A - Source Code Form"):
            for x in list(cuts):
                # The mark stands at a line's start, and may stay itself.
                if m := re.search(rf"^[ \t]*{mark}.*$", x, re.M):
                    cuts |= {x[: m.start()], x[: m.end()]}
        if m := re.search(r"^\s*(?:Preamble|TERMS AND CONDITIONS FOR USE|1\. Definitions|Statement of Purpose)", t, re.M):
            head = [x for x in t[: m.start()].strip().splitlines() if x.strip()]
            cuts |= {"\n".join([*head[:n], x[m.start():]]) for x in list(cuts) for n in range(len(head)) if len(x) > m.start()}
        if name in _TITLES:
            # Items under numbers, letters, bullets.
            for marks in (("", "", ""), ("a. ", "b. ", "c. ")):
                items = iter(marks)
                cuts.add(re.sub(r"^[ \t]*[1-3]\. ", lambda m: next(items), t, flags=re.M))
            cuts |= {f"{title}\n{x}" for x in list(cuts) for title in _TITLES[name]}
        texts += [(name, x) for x in sorted(cuts)]
    return texts


def whole_digests() -> dict[str, str]:
    """sha256 of a whole text's forms -> SPDX name. A text has two forms:
    without any copyright line, and without those that bear a year."""
    out = {}
    for name, t in [*KNOWN, *whole_texts(), *statements()]:
        for form in (canonical_py(t), _normal_py(re.sub(_DATED_LINE, "", t.lower(), flags=re.M | re.A))):
            out.setdefault(hashlib.sha256(_named_py(form).encode()).hexdigest(), name)
    return out


def scan(docs: DataFrame) -> DataFrame:
    """``docs`` plus ``license`` (the whole text is this licence, else null),
    ``line_licenses`` (sorted licences stated by whole lines, or runs of
    lines, comma-joined) and ``n_license_lines`` (such statements; a wrapped
    one counts once)."""
    spark = docs.sparkSession
    wholes = sorted(whole_digests().items())
    rows = docs.drop("license")
    lines = F.split(text_or_empty(), _BREAK)
    line = F.transform(lines, lambda x: F.struct(
        _normal(x).alias("t"), F.lower(x).rlike(_COPYRIGHT_LINE).alias("c"), F.lower(x).rlike(_DATED_LINE).alias("d")))
    rows = rows.withColumn("__sg_lines", line)

    def joined(dropped):
        kept = F.filter("__sg_lines", lambda x: ~x[dropped] & (x["t"] != ""))
        return F.sha2(_named(F.array_join(F.transform(kept, lambda x: x["t"]), " ")), 256)

    rows = rows.withColumns(
        {"__sg_loose": joined("c"), "__sg_dated": joined("d"),
         "__sg_lines": F.transform("__sg_lines", lambda x: F.when(x["c"], "").otherwise(x["t"]))}
    )
    for key in ("loose", "dated"):
        known = spark.createDataFrame(wholes, f"__sg_k{key} string, __sg_l{key} string")
        rows = rows.join(F.broadcast(known), rows[f"__sg_{key}"] == known[f"__sg_k{key}"], "left")
    names = F.create_map(*[F.lit(x) for kv in sorted(known_digests().items()) for x in kv])
    runs = F.regexp_extract_all(F.array_join("__sg_lines", "\n"), F.lit(statement_pattern()), F.lit(0))
    found = F.transform(runs, lambda x: names[F.sha2(F.translate(x, "\n", " "), 256)])
    found = F.filter(found, lambda x: x.isNotNull())
    rows = rows.withColumn("__sg_found", found).withColumns(
        {
            "license": F.coalesce("__sg_lloose", "__sg_ldated"),
            "line_licenses": F.array_join(F.sort_array(F.array_distinct("__sg_found")), ","),
            "n_license_lines": F.size("__sg_found").cast("long"),
        }
    )
    return rows.drop(*[c for c in rows.columns if c.startswith("__sg_")])


def op6_license(spark, sf_dir: str) -> DataFrame:
    d = scan(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select("doc_id", "license", "line_licenses", "n_license_lines")
