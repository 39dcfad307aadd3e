"""Licence recognition by sentences and ordered rules, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentences of public licence texts and notices, as they are written; compared after normalisation.
# <name> stands for the name of a holder.
SENTENCES = {
    "mit-notice": "Released under the MIT License.",
    "mit-notice-2": "Licensed under the MIT License.",
    "mit-notice-3": "This project is licensed under the MIT License.",
    "mit-title": "The MIT License (MIT)",
    "mit-title-2": "MIT License",
    "mit-title-3": "The MIT License",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "mit-condition": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "as-is": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "no-event": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "isc-title": "ISC License",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "isc-grant-2": "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "isc-as-is": "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
    "isc-no-event": "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "apache-title": "Apache License Version 2.0, January 2004",
    "apache-terms": "TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",
    "apache-notice": "Licensed under the Apache License, Version 2.0.",
    "apache-notice-2": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    "apache-copy": "You may obtain a copy of the License at",
    "apache-basis": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "apache-limits": "See the License for the specific language governing permissions and limitations under the License.",
    "gpl3-notice": "This work is licensed under the GNU General Public License, version 3.",
    "gpl2-notice": "This work is licensed under the GNU General Public License, version 2.",
    "gpl3-title": "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "gpl2-title": "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
    "lgpl3-title": "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "lgpl21-title": "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
    "agpl3-title": "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
    "gnu-copies": "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.",
    "gnu-warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "gnu-warranty-lib": "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "cc-by-nc-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-notice": "Licensed under CC BY 4.0.",
    "cc-by-sa-notice": "Licensed under CC BY-SA 4.0.",
    "cc-by-long": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-long": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc-by-nc-long": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "cc0-notice": "This work is dedicated to the public domain under the CC0 1.0 Universal license.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "unlicense-2": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "bsd-intro": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-names": "Neither the name of <name> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd-names-2": "The name of <name> may not be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd-as-is": "THIS SOFTWARE IS PROVIDED BY <name> \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    "bsd-no-event": "IN NO EVENT SHALL <name> BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "mpl-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "mpl-copy": "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "epl-notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0.",
    "bsl-title": "Boost Software License - Version 1.0 - August 17th, 2003",
    "bsl-notice": "Distributed under the Boost Software License, Version 1.0.",
    "reserved": "All rights reserved.",
}
# Names of licences in machine-readable tags.
TAGS = "MIT ISC Apache-2.0 BSD-2-Clause BSD-3-Clause GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later AGPL-3.0-only AGPL-3.0-or-later MPL-2.0 EPL-2.0 BSL-1.0 Unlicense CC0-1.0 CC-BY-4.0 CC-BY-SA-4.0 CC-BY-NC-4.0".split()
SENTENCES |= {f"tag-{t}": f"SPDX-License-Identifier: {t}" for t in TAGS}
# Exceptions that tags name behind "with".
EXCEPTIONS = ["Classpath-exception-2.0", "GCC-exception-3.1", "LLVM-exception", "Linux-syscall-note"]
#: The notices of the GNU licences differ in few words.
GNU = [("GPL-2.0", "2", "General"), ("GPL-3.0", "3", "General"), ("LGPL-2.1", "2.1", "Lesser General"), ("LGPL-3.0", "3", "Lesser General"), ("AGPL-3.0", "3", "Affero General")]
for _name, _version, _kind in GNU:
    for _what in ("program", "library"):
        _terms = f"This {_what} is free software: you can redistribute it and/or modify it under the terms of the GNU {_kind} Public License as published by the Free Software Foundation, "
        SENTENCES[f"{_name}-{_what}"] = _terms + f"either version {_version} of the License, or (at your option) any later version."
        SENTENCES[f"{_name}-{_what}-only"] = _terms + f"version {_version} of the License."
    SENTENCES[f"details-{_kind}"] = f"See the GNU {_kind} Public License for more details."

#: (licence, identifiers in order). A rule that comes first takes its sentences before later ones.
RULES = [
    ("Apache-2.0", ["apache-notice-2", "apache-copy", "apache-basis", "apache-limits"]),
    ("Apache-2.0", ["apache-title", "apache-terms"]),
    ("Apache-2.0", ["apache-notice-2"]),
    ("BSD-3-Clause", ["bsd-intro", "bsd-source", "bsd-binary", "bsd-names", "bsd-as-is", "bsd-no-event"]),
    ("BSD-3-Clause", ["bsd-intro", "bsd-source", "bsd-binary", "bsd-names-2", "bsd-as-is", "bsd-no-event"]),
    ("BSD-3-Clause", ["bsd-intro", "bsd-source", "bsd-binary", "bsd-names"]),
    ("BSD-3-Clause", ["bsd-intro", "bsd-source", "bsd-binary", "bsd-names-2"]),
    ("BSD-2-Clause", ["bsd-intro", "bsd-source", "bsd-binary", "bsd-as-is", "bsd-no-event"]),
    ("BSD-2-Clause", ["bsd-intro", "bsd-source", "bsd-binary"]),
    *[(f"{n}-or-later", [f"{n}-{w}", f"gnu-warranty{x}", f"details-{kind}"]) for n, _, kind in GNU for w, x in (("program", ""), ("library", "-lib"))],
    *[(f"{n}-only", [f"{n}-{w}-only", f"gnu-warranty{x}", f"details-{kind}"]) for n, _, kind in GNU for w, x in (("program", ""), ("library", "-lib"))],
    *[(f"{n}-or-later", [f"{n}-{w}"]) for n, _, _ in GNU for w in ("program", "library")],
    *[(f"{n}-only", [f"{n}-{w}-only"]) for n, _, _ in GNU for w in ("program", "library")],
    ("MIT", ["mit-title", "mit-grant", "mit-condition", "as-is", "no-event"]),
    ("MIT", ["mit-title-2", "mit-grant", "mit-condition", "as-is", "no-event"]),
    ("MIT", ["mit-title-3", "mit-grant", "mit-condition", "as-is", "no-event"]),
    ("MIT", ["mit-grant", "mit-condition", "as-is", "no-event"]),
    ("MIT", ["mit-grant", "mit-condition"]),
    ("ISC", ["isc-title", "isc-grant", "isc-as-is", "isc-no-event"]),
    ("ISC", ["isc-title", "isc-grant-2", "isc-as-is", "isc-no-event"]),
    ("ISC", ["isc-grant"]),
    ("ISC", ["isc-grant-2"]),
    ("GPL-3.0-only", ["gpl3-title", "gnu-copies"]),
    ("GPL-2.0-only", ["gpl2-title", "gnu-copies"]),
    ("LGPL-3.0-only", ["lgpl3-title", "gnu-copies"]),
    ("LGPL-2.1-only", ["lgpl21-title", "gnu-copies"]),
    ("AGPL-3.0-only", ["agpl3-title", "gnu-copies"]),
    ("MIT", ["mit-notice"]),
    ("MIT", ["mit-notice-2"]),
    ("MIT", ["mit-notice-3"]),
    ("Apache-2.0", ["apache-notice"]),
    ("GPL-3.0-only", ["gpl3-notice"]),
    ("GPL-2.0-only", ["gpl2-notice"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-notice"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-long"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-notice"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-long"]),
    ("CC-BY-4.0", ["cc-by-notice"]),
    ("CC-BY-4.0", ["cc-by-long"]),
    ("CC0-1.0", ["cc0-notice"]),
    ("Unlicense", ["unlicense", "unlicense-2"]),
    ("Unlicense", ["unlicense"]),
    ("MPL-2.0", ["mpl-notice", "mpl-copy"]),
    ("MPL-2.0", ["mpl-notice"]),
    ("EPL-2.0", ["epl-notice"]),
    ("BSL-1.0", ["bsl-title"]),
    ("BSL-1.0", ["bsl-notice"]),
    *[(t, [f"tag-{t}"]) for t in TAGS],
    ("proprietary", ["reserved"]),
]
#: Every known sentence has one of these, so a text without any has no known sentence.
CUES = "licen|permi|copyright|warrant|redistribut|public domain|reserved|disclaim|damage|for any purpose|terms and conditions|copy of the mpl"
#: Marks of comments and list items at the start of a line, and of comments at its end.
_LINE_START = r"(?m)^[ \t]*(?://+!?|/\*+!?|\*+/?|#+!?|;+|--+|%+|<!--+|\(\*|\.\.|>+|(?i:rem|dnl)[ \t])*[ \t]*(?:\(?(?:[0-9]{1,2}|[a-zA-Z])[.)][ \t]|[*-][ \t])?"
_LINE_END = r"(?m)[ \t]*(?:\*+/|--+>|\*\))[ \t]*$"
_SENTENCE_END = r"[.!?;:]+[)\]\"'’”]*[ \t]"


def _words(text: str) -> str:
    return " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in text.lower()).split())


#: Words that a holder's name may have.
NAME_WORDS = 12
_STEP = " (?:> < )?"


def _alternatives(words: list[str], step: str) -> str:
    return "(?:" + "|".join(w.replace(" ", step) for w in sorted(words, key=lambda w: (-len(w), w))) + ")"


def _parts(sentence: str) -> list[str]:
    """The words of a sentence, before and behind its name if it has one."""
    return [_words(x) for x in sentence.split("<name>")]


def sentence_pattern() -> str:
    """A unit of the stream, or several in a row, whose words are those of a known sentence (the longest first) or of a licence tag,
    which may join several licences by "or" and "and"."""
    name = f"[a-z0-9]+(?:{_STEP}[a-z0-9]+){{0,{NAME_WORDS - 1}}}"
    known = sorted({tuple(_parts(s)) for k, s in SENTENCES.items() if not k.startswith("tag-")}, key=lambda x: (-len("".join(x)), x))
    tag = _alternatives([_words(t) for t in TAGS], _STEP) + f"(?:{_STEP}with{_STEP}{_alternatives([_words(e) for e in EXCEPTIONS], _STEP)})?"
    tags = _STEP.join(["spdx", "license", "identifier", tag]) + f"(?:{_STEP}(?:or|and){_STEP}{tag})*"
    return "< (?:" + "|".join([tags, *[f"{_STEP}{name}{_STEP}".join(w.replace(" ", _STEP) for w in x) for x in known]]) + ") >"


def unit_stream(text: Column) -> Column:
    """The units of a text as "< word word >< word >": lines and sentences, lower case, ASCII letters and digits only.

    Comment marks and the numbers of list items at the start of a line are left out.
    """
    lines = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), _LINE_END, ""), _LINE_START, "")
    cut = F.regexp_replace(F.concat(lines, F.lit("\n")), _SENTENCE_END, "\n")
    words = F.trim(F.regexp_replace(F.regexp_replace(F.lower(cut), "[^a-z0-9\n]+", " "), " *\n[ \n]*", "\n"), F.lit(" \n"))
    return F.concat(F.lit("< "), F.regexp_replace(words, "\n", " > < "), F.lit(" >"))


def rule_patterns(gap: int) -> list[tuple[str, str]]:
    """(licence, regular expression over a sequence of identifiers) in the order of the rules.

    A sequence has an identifier and ";" for a known sentence, and "." for each unknown unit. That all rights are reserved may stand
    between the sentences of any licence.
    """
    code = {name: f"{k:03d}" for k, name in enumerate(SENTENCES)}
    return [(lic, f"(?:\\.|{code['reserved']};){{0,{gap}}}".join(code[s] + ";" for s in seq)) for lic, seq in RULES]


def scan_licenses(docs: DataFrame, gap: int = 6) -> DataFrame:
    """Add n_license_sentences, license_sentences (identifiers in text order) and licenses to the columns of ``docs``.

    A text is cut into units at line ends and after . ! ? ; : (comment marks and list numbers at a
    line's start don't count), which are normalised. A known sentence is recognised where one or more whole units
    in a row have just its words, so it may be wrapped over lines in any way; of several that
    start at one unit the longest counts, and the next is looked for behind it. A holder's name in it may be any of up to ``NAME_WORDS``
    words; a tag may name several licences, each of which counts. A rule matches
    where its identifiers follow each other in order, with at most ``gap`` unknown units between two. Rules take
    their sentences in the order of the list, so a full text is not also a notice. "All rights reserved." counts as proprietary only in a text
    without a licence. licenses holds licence:count, sorted by name.

    Null, empty or unknown text: 0, an empty array and an empty string. Null doc_id: scanned like any
    other. Repeated rows: each gets the same answer. Empty table: no rows. Columns of
    ``docs`` with an added name are replaced; any others may have any name. Texts of any length are scanned whole.
    """
    added = ["n_license_sentences", "license_sentences", "licenses"]
    docs = docs.select(*[c for c in docs.columns if c not in added])
    plain = [(_words(s), f"{k:03d}") for k, s in enumerate(SENTENCES.values()) if "<name>" not in s]
    code = F.create_map(*[F.lit(x) for pair in plain for x in pair])
    pattern = sentence_pattern()

    def codes(found: Column) -> Column:
        """Identifiers of a recognised sentence: one, or that of each licence of a tag."""
        x = F.trim(F.regexp_replace(found, "[ <>]+", " "))
        one = F.try_element_at(code, x)
        for k, s in enumerate(SENTENCES.values()):
            if "<name>" in s:
                before, behind = _parts(s)
                one = F.when(F.startswith(x, F.lit(before + " ")) & F.endswith(x, F.lit(" " + behind)), f"{k:03d}").otherwise(one)
        tag = F.transform(F.regexp_extract_all(x, F.lit(f" ({_alternatives([_words(t) for t in TAGS], ' ')})(?= |$)"), F.lit(1)), lambda t: F.try_element_at(code, F.concat(F.lit("spdx license identifier "), t)))
        return F.when(F.startswith(x, F.lit("spdx ")), tag).otherwise(F.array(one))

    # One row a document throughout: no shuffle. Texts without a cue skip the patterns.
    stream = F.when(F.col("text").rlike(f"(?i){CUES}"), unit_stream(F.col("text")))
    found = F.regexp_extract_all("s_", F.lit(f"({pattern})"), F.lit(1))
    between = F.transform(F.split("s_", pattern, -1), lambda x: F.repeat(F.lit("."), F.regexp_count(x, F.lit("<"))))
    seq = F.concat(F.element_at("b_", 1), F.array_join(F.zip_with("c_", F.slice("b_", 2, F.size("c_")), lambda c, b: F.concat(F.array_join(c, ";"), F.lit(";"), b)), ""))
    one = {"s_": stream, "f_": found, "c_": F.transform("f_", codes), "b_": between, "q_": seq, "i_": F.flatten("c_")}
    rows = docs.select(F.struct(*docs.columns).alias("row_"), "text")
    for name, column in one.items():
        rows = rows.withColumn(name, column)
    rows = rows.select("row_", "i_", "q_")
    rules = F.array(*[F.struct(F.lit(rule[:4]).alias("first"), F.lit(rule).alias("rule"), F.lit(f"~{lic}~").alias("mark")) for lic, rule in rule_patterns(gap)])
    marked = F.aggregate(rules, F.col("q_"), lambda q, r: F.when(q.contains(r["first"]), F.regexp_replace(q, r["rule"], r["mark"])).otherwise(q))
    rows = rows.withColumn("l_", F.when(F.size("i_") > 0, F.array_sort(F.regexp_extract_all(marked, F.lit("~([^~]+)~"), F.lit(1)))))
    named = F.filter("l_", lambda x: x != "proprietary")  # reserved rights are a licence of their own only where there is no other
    rows = rows.withColumn("l_", F.when(F.size(named) > 0, named).otherwise(F.col("l_")))
    listed = F.array_join(F.transform(F.array_distinct("l_"), lambda x: F.concat(x, F.lit(":"), F.size(F.filter("l_", lambda y: y == x)).cast("string"))), ",")
    ids = F.coalesce("i_", F.array().cast("array<string>"))
    return rows.select("row_.*", F.size(ids).cast("long").alias("n_license_sentences"), ids.alias("license_sentences"), F.coalesce(listed, F.lit("")).alias("licenses"))


def oracle(gap: int = 6) -> str:
    """DuckDB SQL for (doc_id, n_license_sentences, licenses) over ``documents``: words and unit borders by position."""

    def quoted(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    listed = [(f"{k:03d}", s.split("<name>")) for k, s in enumerate(SENTENCES.values()) if not s.startswith("SPDX")]
    known = ", ".join(f"({quoted(k)}, {quoted(x[0])}, {quoted(x[1] if len(x) > 1 else '')}, {int(len(x) > 1)})" for k, x in listed)
    tags = ", ".join(f"({quoted(f'{k:03d}')}, {quoted(s.split(': ')[1])})" for k, s in enumerate(SENTENCES.values()) if s.startswith("SPDX"))
    more = ", ".join(f"({quoted(e)})" for e in EXCEPTIONS)
    split = "string_split(trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g')), ' ')"
    seq = "seq"
    for lic, rule in rule_patterns(gap):
        seq = f"regexp_replace({seq}, '{rule}', '~{lic}~', 'g')"
    return f"""
WITH RECURSIVE known AS (SELECT k AS sentence_id, {split.format("a")} AS p, CASE WHEN named = 1 THEN {split.format("b")} ELSE [] END AS q, unnest(range(named, 1 + {NAME_WORDS} * named)) AS g FROM (VALUES {known}) v(k, a, b, named)),
tags AS (SELECT k AS sentence_id, {split.format("s")} AS w FROM (VALUES {tags}) v(k, s)),
exceptions AS (SELECT {split.format("s")} AS w FROM (VALUES {more}) v(s)),
lines AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), {quoted(_LINE_END)}, '', 'g'), {quoted(_LINE_START)}, '', 'g') || chr(10) AS t FROM documents),
cut AS (SELECT doc_id, string_split(regexp_replace(t, {quoted(_SENTENCE_END)}, chr(10), 'g'), chr(10)) AS a FROM lines),
raw AS (SELECT doc_id, generate_subscripts(a, 1) AS i, trim(regexp_replace(lower(unnest(a)), '[^a-z0-9]+', ' ', 'g')) AS u FROM cut),
units AS (SELECT doc_id, row_number() OVER w AS unit, len(string_split(u, ' ')) AS n, CAST(sum(len(string_split(u, ' '))) OVER w AS BIGINT) AS stop, string_split(u, ' ') AS words FROM raw WHERE u <> '' WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
texts AS (SELECT doc_id, flatten(list(words ORDER BY unit)) AS words FROM units GROUP BY doc_id),
may AS (SELECT u.doc_id, u.unit, u.stop - u.n AS start, k.sentence_id, k.p, k.q, k.g, u.stop - u.n + len(k.p) + k.g + len(k.q) AS stop FROM units u JOIN known k ON u.words[1] = k.p[1]),
named AS (SELECT m.doc_id, m.unit, start, sentence_id || ';' AS codes, 1 AS n, m.stop FROM may m JOIN texts t USING (doc_id) WHERE t.words[start + 1 : start + len(p)] = p AND t.words[start + len(p) + g + 1 : m.stop] = q),
chains AS (SELECT u.doc_id, u.unit, u.stop - u.n AS start, sentence_id || ';' AS codes, 1 AS n, u.stop - u.n + 3 + len(k.w) AS stop, false AS done FROM units u JOIN texts t USING (doc_id), tags k
  WHERE t.words[u.stop - u.n + 1 : u.stop - u.n + 3] = ['spdx', 'license', 'identifier'] AND t.words[u.stop - u.n + 4 : u.stop - u.n + 3 + len(k.w)] = k.w
  UNION ALL SELECT * FROM (SELECT c.doc_id, c.unit, start, codes || sentence_id || ';', n + 1, c.stop + 1 + len(k.w), false FROM chains c JOIN texts t USING (doc_id), tags k WHERE t.words[c.stop + 1] IN ('or', 'and') AND t.words[c.stop + 2 : c.stop + 1 + len(k.w)] = k.w
  UNION ALL SELECT c.doc_id, c.unit, start, codes, n, c.stop + 1 + len(e.w), true FROM chains c JOIN texts t USING (doc_id), exceptions e WHERE NOT c.done AND t.words[c.stop + 1] = 'with' AND t.words[c.stop + 2 : c.stop + 1 + len(e.w)] = e.w)),
hits AS (SELECT m.*, e.unit AS last_unit FROM (SELECT * FROM named UNION ALL SELECT doc_id, unit, start, codes, n, stop FROM chains) m JOIN units e ON e.doc_id = m.doc_id AND e.stop = m.stop),
longest AS (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY doc_id, start ORDER BY stop DESC, codes) = 1),
apart AS (SELECT * FROM longest QUALIFY coalesce(max(stop) OVER (PARTITION BY doc_id ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) <= start),
gaps AS (SELECT *, unit - 1 - coalesce(lag(last_unit) OVER (PARTITION BY doc_id ORDER BY start), 0) AS gap FROM apart),
seqs AS (SELECT doc_id, CAST(sum(n) AS BIGINT) AS n, string_agg(repeat('.', CAST(gap AS INT)) || codes, '' ORDER BY start) AS seq FROM gaps GROUP BY doc_id),
marks AS (SELECT doc_id, n, list_sort(regexp_extract_all({seq}, '~([^~]+)~', 1)) AS a FROM seqs),
marked AS (SELECT doc_id, n, CASE WHEN len(list_filter(a, lambda x: x <> 'proprietary')) > 0 THEN list_filter(a, lambda x: x <> 'proprietary') ELSE a END AS l FROM marks),
counted AS (SELECT doc_id, lic, count(*) AS c FROM (SELECT doc_id, unnest(l) AS lic FROM marked) GROUP BY ALL),
listed AS (SELECT doc_id, string_agg(lic || ':' || c, ',' ORDER BY lic) AS licenses FROM counted GROUP BY doc_id)
SELECT d.doc_id, coalesce(m.n, 0) AS n_license_sentences, coalesce(l.licenses, '') AS licenses
FROM documents d LEFT JOIN marked m USING (doc_id) LEFT JOIN listed l USING (doc_id)
"""
