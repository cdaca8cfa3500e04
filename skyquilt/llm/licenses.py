"""Licence recognition: normalised sentences to identifiers, identifier sequences to ordered rules. DataFrame functions only."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentences of public licence texts and notices, lower-case, with every run of other characters as one space.
SENTENCES = {
    "apache-notice": "licensed under the apache license version 2 0",
    "apache-header": "licensed under the apache license version 2 0 the license",
    "apache-comply": "you may not use this file except in compliance with the license",
    "apache-copy": "you may obtain a copy of the license at http www apache org licenses license 2 0",
    "apache-limits": "see the license for the specific language governing permissions and limitations under the license",
    "mit-notice": "released under the mit license",
    "mit-notice-2": "licensed under the mit license",
    "mit-title": "the mit license mit",
    "mit-title-2": "mit license",
    "mit-condition": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "gpl-2": "this work is licensed under the gnu general public license version 2",
    "gpl-3": "this work is licensed under the gnu general public license version 3",
    "gpl-header-2": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl-header-3": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl-warranty": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "lgpl-3": "this work is licensed under the gnu lesser general public license version 3",
    "agpl-3": "this work is licensed under the gnu affero general public license version 3",
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-names": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-notice": "licensed under the bsd license",
    "cc-by": "licensed under cc by 4 0",
    "cc-by-sa": "licensed under cc by sa 4 0",
    "cc-by-nc": "licensed under cc by nc 4 0",
    "cc-by-nd": "licensed under cc by nd 4 0",
    "cc0": "licensed under cc0 1 0",
    "mpl": "this source code form is subject to the terms of the mozilla public license v",
    "mpl-copy": "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0",
    "mpl-notice": "licensed under the mozilla public license 2 0",
    "apache-header-whole": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license",
    "apache-copy-at": "you may obtain a copy of the license at",
    "apache-url": "http www apache org licenses license 2 0",
    "apache-url-s": "https www apache org licenses license 2 0",
    "apache-as-is": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-as-is": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "mit-liability": "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "isc-title": "isc license",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "isc-as-is": "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    "isc-liability": "in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
    "0bsd-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "bsd-as-is": "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    "bsd-liability": "in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage",
    "gpl-details": "see the gnu general public license for more details",
    "gpl-received": "you should have received a copy of the gnu general public license along with this program",
    "lgpl-header-2": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    "lgpl-header-3": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "lgpl-warranty": "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "lgpl-details": "see the gnu lesser general public license for more details",
    "agpl-header-3": "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "agpl-details": "see the gnu affero general public license for more details",
    "unlicense-free": "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    "zlib-as-is": "this software is provided as is without any express or implied warranty",
    "zlib-liability": "in no event will the authors be held liable for any damages arising from the use of this software",
    "zlib-grant": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "zlib-origin": "the origin of this software must not be misrepresented you must not claim that you wrote the original software",
    "zlib-altered": "altered source versions must be plainly marked as such and must not be misrepresented as being the original software",
    "boost-title": "boost software license version 1 0 august 17th 2003",
    "boost-notice": "distributed under the boost software license version 1 0",
    "epl-notice": "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0",
    "wtfpl-title": "do what the fuck you want to public license",
    "isc-notice": "licensed under the isc license",
    "unlicense": "this is free and unencumbered software released into the public domain",
    "all-rights": "all rights reserved",
}

# SPDX identifiers that a file may declare.
SPDX = [
    "0BSD", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-NC-ND-4.0", "CC-BY-NC-SA-4.0", "CC-BY-ND-4.0", "CC-BY-SA-4.0", "CC0-1.0",
    "EPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "ISC", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "MIT", "MPL-2.0", "Unlicense", "WTFPL", "Zlib",
]
# Names of the Creative Commons licences of version 4.
COMMONS = {"by": "attribution", "by-sa": "attribution sharealike", "by-nd": "attribution noderivatives", "by-nc": "attribution noncommercial", "by-nc-sa": "attribution noncommercial sharealike", "by-nc-nd": "attribution noncommercial noderivatives"}


def _plain(name: str) -> str:
    return re.sub("[^a-z0-9]+", " ", name.lower()).strip()


SENTENCES |= {f"spdx-{x.lower()}": f"spdx license identifier {_plain(x)}" for x in SPDX}
SENTENCES |= {f"cc-{k}-notice": f"licensed under cc {_plain(k)} 4 0" for k in COMMONS if f"cc-{k}" not in SENTENCES}
SENTENCES |= {f"cc-{k}-named": f"this work is licensed under a creative commons {v} 4 0 international license" for k, v in COMMONS.items()}

# Ordered rules, the more specific first; a rule takes the sentences it matches from those after it.
RULES = [
    ("Apache-2.0", ["apache-header-whole", "apache-copy-at", "apache-url", "apache-as-is", "apache-limits"]),
    ("Apache-2.0", ["apache-header", "apache-comply", "apache-copy-at", "apache-url"]),
    ("Apache-2.0", ["apache-header", "apache-comply", "apache-copy-at", "apache-url-s"]),
    ("Apache-2.0", ["apache-header-whole"]),
    ("MIT", ["mit-title", "mit-grant", "mit-condition", "mit-as-is", "mit-liability"]),
    ("MIT", ["mit-title-2", "mit-grant", "mit-condition", "mit-as-is", "mit-liability"]),
    ("MIT", ["mit-grant", "mit-condition", "mit-as-is", "mit-liability"]),
    ("MIT", ["mit-grant", "mit-condition"]),
    ("ISC", ["isc-title", "isc-grant", "isc-as-is", "isc-liability"]),
    ("ISC", ["isc-grant", "isc-as-is", "isc-liability"]),
    ("ISC", ["isc-grant"]),
    ("0BSD", ["0bsd-grant", "isc-as-is", "isc-liability"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-names", "bsd-as-is", "bsd-liability"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-as-is", "bsd-liability"]),
    ("AGPL-3.0-or-later", ["agpl-header-3", "gpl-warranty", "agpl-details"]),
    ("AGPL-3.0-or-later", ["agpl-header-3"]),
    ("LGPL-2.1-or-later", ["lgpl-header-2", "lgpl-warranty", "lgpl-details"]),
    ("LGPL-2.1-or-later", ["lgpl-header-2"]),
    ("LGPL-3.0-or-later", ["lgpl-header-3", "lgpl-warranty", "lgpl-details"]),
    ("LGPL-3.0-or-later", ["lgpl-header-3"]),
    ("GPL-2.0-or-later", ["gpl-header-2", "gpl-warranty", "gpl-details", "gpl-received"]),
    ("GPL-3.0-or-later", ["gpl-header-3", "gpl-warranty", "gpl-details", "gpl-received"]),
    ("Unlicense", ["unlicense", "unlicense-free"]),
    ("Zlib", ["zlib-as-is", "zlib-liability", "zlib-grant", "zlib-origin", "zlib-altered"]),
    ("Zlib", ["zlib-grant"]),
    ("MPL-2.0", ["mpl", "mpl-copy"]),
    ("MPL-2.0", ["mpl-notice"]),
    ("BSL-1.0", ["boost-title"]),
    ("BSL-1.0", ["boost-notice"]),
    ("EPL-2.0", ["epl-notice"]),
    ("WTFPL", ["wtfpl-title"]),
    ("Apache-2.0", ["apache-header", "apache-comply", "apache-copy"]),
    ("Apache-2.0", ["apache-header", "apache-comply"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-names"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("GPL-2.0-or-later", ["gpl-header-2", "gpl-warranty"]),
    ("GPL-2.0-or-later", ["gpl-header-2"]),
    ("GPL-3.0-or-later", ["gpl-header-3", "gpl-warranty"]),
    ("GPL-3.0-or-later", ["gpl-header-3"]),
    ("MIT", ["mit-title", "mit-condition"]),
    ("MIT", ["mit-title-2", "mit-condition"]),
    ("MIT", ["mit-condition"]),
    ("MIT", ["mit-notice"]),
    ("MIT", ["mit-notice-2"]),
    ("Apache-2.0", ["apache-header"]),
    ("Apache-2.0", ["apache-notice"]),
    ("GPL-2.0-only", ["gpl-2"]),
    ("GPL-3.0-only", ["gpl-3"]),
    ("LGPL-3.0-only", ["lgpl-3"]),
    ("AGPL-3.0-only", ["agpl-3"]),
    ("BSD-3-Clause", ["bsd-notice"]),
    ("CC-BY-NC-4.0", ["cc-by-nc"]),
    ("CC-BY-SA-4.0", ["cc-by-sa"]),
    ("CC-BY-ND-4.0", ["cc-by-nd"]),
    ("CC-BY-4.0", ["cc-by"]),
    ("CC0-1.0", ["cc0"]),
    ("MPL-2.0", ["mpl"]),
    ("ISC", ["isc-notice"]),
    ("Unlicense", ["unlicense"]),
    ("LicenseRef-All-Rights-Reserved", ["all-rights"]),
]

RULES += [(x, [f"spdx-{x.lower()}"]) for x in SPDX]
RULES += [(f"CC-{k.upper()}-4.0", [f"cc-{k}-{kind}"]) for k in sorted(COMMONS, key=len, reverse=True) for kind in ("notice", "named") if f"cc-{k}-{kind}" in SENTENCES]

# Every known sentence holds one of these, so a text without any of them has no known sentence.
ANCHORS = ["licen", "permission", "redistribut", "warrant", "liab", "the mpl", "source versions", "must not be misrepresented", "this software", "public domain", "rights reserved"]

#: Where a sentence ends: by lines, and across wrapped lines.
BREAKS = ["[.!?]+[ \\t\\n\\r\\f]+|\\n+", "[.!?]+[ \\t\\n\\r\\f]+|\\n[ \\t\\r]*\\n+"]


def _sequence(text: Column, breaks: str) -> Column:
    marked = F.regexp_replace(F.regexp_replace(F.lower(text), breaks, "\x01"), "[^a-z0-9\x01]+", " ")
    known = F.create_map(*[F.lit(x) for k, s in SENTENCES.items() for x in (s, f"<{k}>")])
    ids = F.transform(F.split(marked, "\x01"), lambda s: F.try_element_at(known, F.trim(s)))
    return F.array_join(F.filter(ids, lambda x: x.isNotNull()), "")


def scan_licenses(docs: DataFrame) -> DataFrame:
    """For each row of ``docs`` the licences its text declares.

    Adds nothing to the input's columns but returns doc_id, n_known int (known licence sentences, by
    lines) and licenses string (distinct identifiers in order, joined by a comma; empty for none). A
    sentence ends at its mark or line; a second reading lets sentences run over single line ends, for
    wrapped texts. Known sentences, in order and without those unknown between them, form a sequence; rules
    are tried in order, and a match takes its sentences away from later rules. One pass, no exchange; a
    null or empty text has no licence. Repeated rows get a row each, an empty table gives none; a long text is read whole
    like others.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    lower = F.lower(text)
    maybe = F.lit(False)
    for a in ANCHORS:
        # words of an anchor may stand apart by other characters than a blank
        maybe = maybe | (lower.rlike(a.replace(" ", "[^a-z0-9]+")) if " " in a else lower.contains(a))
    by_line, wrapped = (F.when(maybe, _sequence(text, b)).otherwise("") for b in BREAKS)
    rules = F.array(*[F.struct(F.lit("".join(f"<{s}>" for s in seq)).alias("pattern"), F.lit(lic).alias("license")) for lic, seq in RULES])
    start = F.struct(F.col("sequence"), F.array().cast("array<string>").alias("found"))

    def step(acc: Column, rule: Column) -> Column:
        rest = F.replace(acc["sequence"], rule["pattern"], F.lit("|")).alias("sequence")
        return F.when(
            F.contains(acc["sequence"], rule["pattern"]),
            F.struct(rest, F.concat(acc["found"], F.array(rule["license"])).alias("found")),
        ).otherwise(acc)

    seen = docs.select("doc_id", by_line.alias("by_line"), wrapped.alias("wrapped"))
    seen = seen.withColumn("sequence", F.concat_ws("|", "by_line", "wrapped"))
    found = F.aggregate(rules, start, step, lambda acc: F.array_join(F.array_sort(F.array_distinct(acc["found"])), ","))
    n_known = F.length("by_line") - F.length(F.replace(F.col("by_line"), F.lit("<"), F.lit("")))
    return seen.select("doc_id", n_known.cast("int").alias("n_known"), F.when(F.col("sequence") != "|", found).otherwise("").alias("licenses"))


def op2_license_scan(spark, sf_dir: str) -> DataFrame:
    """The licences declared in every document."""
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def oracle() -> str:
    """The same rows in DuckDB."""
    keys = ", ".join(f"'{s}'" for s in SENTENCES.values())
    ids = ", ".join(f"'<{k}>'" for k in SENTENCES)

    def seq(breaks: str) -> str:
        b = breaks.replace("\\t", "\t").replace("\\n", "\n").replace("\\r", "\r").replace("\\f", "\f").replace("'", "''")
        return (
            f"array_to_string(list_filter(list_transform(string_split(regexp_replace(regexp_replace(lower(coalesce(text, '')), '{b}', chr(1), 'g'), '[^a-z0-9' || chr(1) || ']+', ' ', 'g'), chr(1)), "
            f"lambda x: list_extract([{ids}], list_position([{keys}], trim(x)))), lambda x: x is not null), '')"
        )

    steps, last = [], "s0"
    for i, (lic, names) in enumerate(RULES, 1):
        p = "".join(f"<{n}>" for n in names)
        steps.append(f"s{i} as (select doc_id, n_known, replace(seq, '{p}', '|') as seq, case when contains(seq, '{p}') then list_append(found, '{lic}') else found end as found from {last})")
        last = f"s{i}"
    return (
        f"with s as (select doc_id, {seq(BREAKS[0])} as a, {seq(BREAKS[1])} as b from documents), "
        "s0 as (select doc_id, cast(length(a) - length(replace(a, '<', '')) as integer) as n_known, a || '|' || b as seq, cast([] as varchar[]) as found from s), "
        + ", ".join(steps)
        + f" select doc_id, n_known, array_to_string(list_sort(list_distinct(found)), ',') as licenses from {last}"
    )
