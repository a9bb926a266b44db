"""Licence scans by canonical digest lookup.

A text is reduced to a canonical form (case, punctuation, title and copyright
lines and equivalent spellings) and its SHA-256 is joined to the digests of
known licences.  The built-in table has a row for each whole text here and in
``license_texts``, and one for each notice that a few phrases make of the
licences' names; it is broadcast, as any table is up to ``BROADCAST_DIGESTS``
rows.  No Python runs on the executors.
"""

from __future__ import annotations

from functools import reduce
from importlib import resources

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm.common import fold, materialize

# Equivalent spellings, (variant, canonical), after the matching guidelines for licences published by SPDX.
EQUIVALENT = [
    ("acknowledgement", "acknowledgment"),
    ("analogue", "analog"),
    ("analyse", "analyze"),
    ("artefact", "artifact"),
    ("authorisation", "authorization"),
    ("authorised", "authorized"),
    ("calibre", "caliber"),
    ("cancelled", "canceled"),
    ("capitalisations", "capitalizations"),
    ("catalogue", "catalog"),
    ("categorise", "categorize"),
    ("centre", "center"),
    ("emphasised", "emphasized"),
    ("favour", "favor"),
    ("favourite", "favorite"),
    ("fulfil", "fulfill"),
    ("fulfilment", "fulfillment"),
    ("initialise", "initialize"),
    ("judgement", "judgment"),
    ("labelling", "labeling"),
    ("labour", "labor"),
    ("licence", "license"),
    ("licenced", "licensed"),
    ("maximise", "maximize"),
    ("modelled", "modeled"),
    ("modelling", "modeling"),
    ("offence", "offense"),
    ("optimise", "optimize"),
    ("organisation", "organization"),
    ("organise", "organize"),
    ("practise", "practice"),
    ("programme", "program"),
    ("realise", "realize"),
    ("recognise", "recognize"),
    ("signalling", "signaling"),
    ("utilisation", "utilization"),
    ("whilst", "while"),
    ("wilful", "wilfull"),
    ("http", "https"),
]

# Whole texts of short licences; longer ones lie in license_texts.
TEXTS = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "BSL-1.0": """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:
The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "MIT-0": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "Unlicense": """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
For more information, please refer to <https://unlicense.org/>""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
}
# Names of licences as notices state them, by identifier; and the phrases notices are made of.
NAMES = {
    "0BSD": ["BSD Zero Clause License", "0BSD License", "Zero-Clause BSD License"],
    "AGPL-3.0": ["GNU Affero General Public License, version 3", "GNU Affero General Public License v3.0", "AGPL version 3", "AGPLv3", "AGPL-3.0"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache-2.0 License", "Apache 2.0", "Apache License"],
    "Artistic-2.0": ["Artistic License 2.0", "Artistic License, Version 2.0"],
    "BSD-2-Clause": ["BSD 2-Clause License", "Simplified BSD License", "2-Clause BSD License", "FreeBSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "New BSD License", "Modified BSD License", "3-Clause BSD License", "BSD License"],
    "BSL-1.0": ["Boost Software License, Version 1.0", "Boost Software License 1.0", "Boost Software License"],
    "CC0-1.0": ["CC0 1.0 Universal License", "CC0 1.0", "CC0", "Creative Commons Zero v1.0 Universal License"],
    "CC-BY-3.0": ["CC BY 3.0", "Creative Commons Attribution 3.0 License", "Creative Commons Attribution 3.0 Unported License"],
    "CC-BY-4.0": ["CC BY 4.0", "Creative Commons Attribution 4.0 International License", "Creative Commons Attribution 4.0 License"],
    "CC-BY-SA-3.0": ["CC BY-SA 3.0", "Creative Commons Attribution-ShareAlike 3.0 License", "Creative Commons Attribution-ShareAlike 3.0 Unported License"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-NC-ND-4.0": ["CC BY-NC-ND 4.0", "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"],
    "CC-BY-NC-SA-4.0": ["CC BY-NC-SA 4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"],
    "CC-BY-ND-4.0": ["CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"],
    "EPL-2.0": ["Eclipse Public License 2.0", "Eclipse Public License, Version 2.0", "Eclipse Public License v2.0"],
    "GPL-2.0": ["GNU General Public License, version 2", "GNU General Public License v2.0", "GNU GPL version 2", "GPL version 2", "GPLv2", "GPL v2"],
    "GPL-3.0": ["GNU General Public License, version 3", "GNU General Public License v3.0", "GNU GPL version 3", "GPL version 3", "GPLv3", "GPL v3"],
    "ISC": ["ISC License"],
    "LGPL-2.1": ["GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License v2.1", "LGPL version 2.1", "LGPLv2.1"],
    "LGPL-3.0": ["GNU Lesser General Public License, version 3", "GNU Lesser General Public License v3.0", "LGPL version 3", "LGPLv3"],
    "MIT": ["MIT License", "MIT Licence (MIT)", "MIT license"],
    "MIT-0": ["MIT No Attribution License", "MIT-0 License"],
    "MPL-2.0": ["Mozilla Public License, Version 2.0", "Mozilla Public License 2.0", "Mozilla Public License, v. 2.0", "MPL 2.0"],
    "Unlicense": ["Unlicense", "Unlicense License"],
    "WTFPL": ["WTFPL License", "Do What The F*ck You Want To Public License"],
    "Zlib": ["zlib License", "zlib/libpng License"],
}
PHRASES = ["Licensed under {}", "Released under {}", "Distributed under {}", "Published under {}", "Available under {}", "This {} is licensed under", "This {} is released under", "This {} is distributed under", "This {} is available under"]
OBJECTS = ["work", "project", "software", "program", "code", "library", "package", "document", "article", "text", "file", "content", "repository"]
SPDX_SUFFIXES = ["", "-only", "-or-later"]
#: Rows of a table of digests that may be broadcast, some 100 bytes each.
BROADCAST_DIGESTS = 500_000
#: What the words of every notice of the built-in table begin with.
STEM = "licen[cs]e|released|distributed|published|available|spdx"


def whole_texts() -> list[tuple[str, str]]:
    """(licence, its whole text) of the built-in table."""
    files = resources.files(__package__).joinpath("license_texts")
    long = [(f.name.removesuffix(".txt"), f.read_text("utf-8")) for f in files.iterdir() if f.name.endswith(".txt")]
    return sorted([*TEXTS.items(), *long])


def notices() -> list[tuple[str, str]]:
    """(licence, a line that stands for it): every phrase with every name, with and without an article or "the terms of"; SPDX tags."""
    out = []
    for licence, names in NAMES.items():
        openings = [p.format("") for p in PHRASES[:5]] + [p.format(o) + " " for p in PHRASES[5:] for o in OBJECTS]
        for name in names:
            out += [(licence, f"{opening}{article}{name}") for opening in openings for article in ("", "the ", "the terms of the ")]
        suffixes = SPDX_SUFFIXES if "GPL" in licence else SPDX_SUFFIXES[:1]
        out += [(licence, f"SPDX-License-Identifier: {licence}{suffix}") for suffix in suffixes]
    return out


#: A line that begins so holds a copyright statement and nothing of the licence.
COPYRIGHT_LINE = r"(?md)^[ \t/*#;-]*(copyright|\(c\)|©|all rights reserved)[^\n]*$"
#: Up to two short first lines that name a licence, with a line after them, are a title.
TITLE = r"^([ \t\r\n]*([^\n]{0,60}[^a-z\n])?licen[cs]e([^a-z\n][^\n]{0,40})?\n){1,2}"


def canonical(text: Column) -> Column:
    """Lower case without title and copyright lines or punctuation, two spaces between words (each word has its own two sides), one spelling of each word."""
    t = F.regexp_replace(F.regexp_replace(fold(F.coalesce(text, F.lit(""))), COPYRIGHT_LINE, " "), TITLE, " ")
    t = F.concat(F.lit(" "), F.trim(F.regexp_replace(t, r"[\x00-\x2F\x3A-\x60\x7B-\x7F©‘’“”–—]+", "  ")), F.lit(" "))
    t = reduce(lambda c, p: F.replace(c, F.lit(f" {p[0]} "), F.lit(f" {p[1]} ")), EQUIVALENT, t)
    return F.trim(t)


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def known_digests(spark: SparkSession) -> DataFrame:
    """license, kind (text or notice), digest, stem (a pattern that some word of a line must match for the row to equal it): one row per digest."""
    rows = [(k, "text", v) for k, v in whole_texts()] + [(k, "notice", v) for k, v in notices()]
    known = spark.createDataFrame(rows, "license string, kind string, body string")
    return known.select("license", "kind", digest(F.col("body")).alias("digest"), F.when(F.col("kind") == "notice", F.lit(STEM)).alias("stem")).dropDuplicates(["kind", "digest"])


def scan_licenses(docs: DataFrame, known: DataFrame | None = None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document row: doc_id, text_digest, license, notices.

    ``license`` is that of the known text whose digest equals the digest of the
    whole document, else null; ``notices`` the sorted distinct licences of the
    document's lines that are, as a whole, known notices, comma-joined (empty
    if none).  Null and empty texts have the digest of the empty text and no
    licence; very long texts cost in proportion to their length; repeated rows
    and rows with null ids each keep a row; an empty table of digests finds
    nothing.  Other columns are not read.  ``known`` has license, kind, digest
    and, if lines can be told from notices by a pattern, stem; lines that match
    no stem aren't hashed if every notice has one.
    """
    known = materialize(known_digests(docs.sparkSession) if known is None else known, "known")
    most = known.count() <= BROADCAST_DIGESTS
    whole = known.where("kind = 'text'").select(F.col("digest").alias("text_digest"), "license")
    notice = known.where("kind = 'notice'").select(F.col("digest").alias("line_digest"), F.col("license").alias("notice"))
    stems = [r[0] for r in known.where("kind = 'notice'").select("stem").distinct().limit(9).collect()] if "stem" in known.columns else [None]
    stem = "|".join(stems) if all(stems) and len(stems) < 9 else ""
    lines = F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")
    lines = F.filter(lines, lambda s: fold(s).rlike(stem)) if stem else lines
    base = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("doc_id"), digest(F.col(text_col)).alias("text_digest"), lines.alias("lines"))
    flat = base.select("rid", "doc_id", "text_digest", F.explode_outer("lines").alias("line")).withColumn("line_digest", F.when(F.col("line").isNotNull(), digest(F.col("line"))))
    found = flat.join(F.broadcast(notice) if most else notice, "line_digest", "left")
    per_doc = found.groupBy("rid").agg(F.max("doc_id").alias("doc_id"), F.max("text_digest").alias("text_digest"), F.array_join(F.sort_array(F.collect_set("notice")), ",").alias("notices"))
    return per_doc.join(F.broadcast(whole) if most else whole, "text_digest", "left").select("doc_id", "text_digest", "license", "notices")
