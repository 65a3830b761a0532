"""Licence scans by canonical digests.

A text is brought to a canonical form: lower case, without copyright lines and list
marks, with equivalent spellings made one, and with every run of other characters
than letters and digits as one blank. The digest of a whole document, of each of its
blocks between blank lines and of each of its lines is joined with the digests of
known licence texts and notices, and so are runs of blocks: where a block is the first of
a known text of several, as many blocks as that text has are digested together. Only
entire texts match, so a licence that is quoted in part doesn't. The known texts are few and bring their number with them;
they are hash-joined whatever their size.

A word that every known text has one of (``MARKERS``) is looked for first, so other
lines needn't be brought to canonical form; that a registry has such words is
checked when it is made.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Public licence texts and the usual notices, by their SPDX names.
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_REST = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_1 = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\nRedistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\nRedistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_2 = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_3 = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_APACHE = 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'
_GPL = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
KNOWN = (
    ("MIT", _MIT), ("MIT", "MIT License\n" + _MIT), ("MIT", "The MIT License (MIT)\n" + _MIT), ("MIT", "Released under the MIT License."), ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."), ("MIT", "This work is licensed under the MIT License."), ("MIT", "SPDX-License-Identifier: MIT"),
    ("ISC", f"{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.\n{_ISC_REST}"), ("ISC", f"ISC License\n{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.\n{_ISC_REST}"),
    ("ISC", "SPDX-License-Identifier: ISC"), ("0BSD", f"{_ISC_GRANT}.\n{_ISC_REST}"), ("0BSD", "SPDX-License-Identifier: 0BSD"),
    ("BSD-2-Clause", f"{_BSD_1}\n{_BSD_3}"), ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"), ("BSD-3-Clause", f"{_BSD_1}\n{_BSD_2}\n{_BSD_3}"), ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("Apache-2.0", _APACHE), ("Apache-2.0", "Licensed under the Apache License, Version 2.0."), ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("Apache-2.0", "This work is licensed under the Apache License, Version 2.0."), ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0-or-later", _GPL), ("GPL-3.0-or-later", "SPDX-License-Identifier: GPL-3.0-or-later"), ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "Licensed under the GNU General Public License, version 3."), ("GPL-3.0-only", "Released under the GNU General Public License, version 3."), ("GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-only"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."), ("CC-BY-NC-4.0", "This work is licensed under CC BY-NC 4.0."), ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."), ("CC-BY-4.0", "This work is licensed under CC BY 4.0."), ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."), ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"),
)
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
_UNLICENSE = """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
#: Names that notices give to licences, by SPDX names. A whole GNU text doesn't say whether later versions hold; it has the name without that.
NAMES = {
    "MIT": ("MIT", "MIT License"), "ISC": ("ISC License",), "0BSD": ("0BSD", "Zero-Clause BSD License"), "Zlib": ("zlib License",), "Unlicense": ("Unlicense",), "BSL-1.0": ("Boost Software License, Version 1.0", "Boost Software License 1.0"),
    "BSD-2-Clause": ("BSD 2-Clause License", "2-Clause BSD License", "Simplified BSD License"), "BSD-3-Clause": ("BSD 3-Clause License", "3-Clause BSD License", "New BSD License", "Modified BSD License"),
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0", "Apache 2.0 License"), "MPL-1.1": ("Mozilla Public License, Version 1.1", "MPL 1.1"), "MPL-2.0": ("Mozilla Public License, Version 2.0", "Mozilla Public License 2.0", "MPL 2.0"),
    "EPL-1.0": ("Eclipse Public License 1.0", "Eclipse Public License, Version 1.0", "EPL 1.0"), "EPL-2.0": ("Eclipse Public License 2.0", "Eclipse Public License, Version 2.0", "EPL 2.0"), "CC0-1.0": ("CC0 1.0", "CC0 1.0 Universal"),
    **{f"{k}-{v}-only": (f"{long}, version {v}", f"{long} version {v}", f"{long} v{v}", f"{long}, version {v[:-2]}" if v.endswith(".0") else f"{k} {v}", f"{long} v{v[:-2]}" if v.endswith(".0") else f"{k}-{v}", f"{k} v{v[:-2]}" if v.endswith(".0") else f"{k} v{v}")
       for k, long, versions in (("GPL", "GNU General Public License", ("2.0", "3.0")), ("LGPL", "GNU Lesser General Public License", ("2.1", "3.0")), ("AGPL", "GNU Affero General Public License", ("3.0",))) for v in versions},
    **{f"CC-{k}-{v}": (f"CC {k} {v}", f"CC-{k}-{v}", f"Creative Commons {long} {v} International License" if v == "4.0" else f"Creative Commons {long} {v} Unported License")
       for k, long in (("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"), ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives")) for v in ("3.0", "4.0")},
}
VERBS = ("Released under", "Licensed under", "Distributed under", *(f"This {x} is {y} under" for x in ("work", "project", "software", "program", "code", "file") for y in ("licensed", "released", "distributed")))
SPDX = (*NAMES, *(f"{x}-or-later" for x in ("GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0")), "LGPL-2.0-only", "LGPL-2.0-or-later", "GPL-1.0-only", "GPL-1.0-or-later", "Artistic-1.0-Perl", "Artistic-2.0", "GFDL-1.2-only", "GFDL-1.3-only", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0")
#: Words of which every known text has one, in any case; spellings that count as one.
MARKERS = ("licen", "permission", "redistribut")
SPELLINGS = (
    ("licence", "license"), ("sub license", "sublicense"), ("non infringement", "noninfringement"), ("non commercial", "noncommercial"), ("organisation", "organization"), ("authoris", "authoriz"),
    ("favour", "favor"), ("copyright owner", "copyright holder"), ("http www", "https www"), ("http mozilla", "https mozilla"), ("v 2 0", "version 2 0"), ("v3", "version 3"), ("ver 2 0", "version 2 0"),
)
#: The same of the whole registry, whose notices say 'released' or 'distributed' without more.
MARKS = ("licen", "permission", "distribut", "released")
#: Patterns that both engines' regular expressions read alike.
COPYRIGHT = r"(?m)^[ \t#/*-]*(copyright[ \t]*(\(c\)|©|[0-9<\[{])|\(c\)|©|all rights reserved)[^\n]*$"
LIST_MARK = r"(?m)^[ \t]*([0-9]{1,2}[.)]|[*-])[ \t]+"
OTHER = r"[^\p{L}\p{N}]+"


def canonical(text: Column) -> Column:
    out = F.regexp_replace(F.lower(text), COPYRIGHT, "")
    out = F.trim(F.regexp_replace(F.regexp_replace(out, LIST_MARK, ""), OTHER, " "))
    for a, b in SPELLINGS:
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def canonical_text(text: str) -> str:
    """The same of one text."""
    import regex

    out = regex.sub(OTHER, " ", re.sub(LIST_MARK, "", re.sub(COPYRIGHT, "", text.lower()))).strip(" ")
    for a, b in SPELLINGS:
        out = out.replace(a, b)
    return out


def digests(known=KNOWN) -> list[tuple[str, str]]:
    """(digest, licence) of every known text."""
    for name, text in known:
        if not any(m in text.lower() for m in MARKS):
            raise ValueError(f"a text of {name} has none of the words {MARKS}")
    return sorted({(hashlib.sha256(canonical_text(text).encode()).hexdigest(), name) for name, text in known})


BLANK = r"\r?\n[ \t]*\r?\n"


def runs(known=KNOWN) -> list[tuple[str, str, str, int]]:
    """(digest, licence, digest of the first block, number of blocks) of every known text of several blocks: between blank lines, or its lines."""
    found = set()
    for name, text in known:
        parts = re.split(BLANK, text)
        blocks = [c for c in map(canonical_text, parts if len(parts) > 1 else text.split("\n")) if c]
        if len(blocks) > 1:
            digest, first = (hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(blocks), blocks[0]))
            found.add((digest, name, first, len(blocks)))
    return sorted(found)


@lru_cache(1)
def registry() -> tuple[tuple[str, str], ...]:
    """All known texts: ``KNOWN``, notices by every name, and the entire texts in the folder ``licences`` (with and without what follows their terms)."""
    found = dict.fromkeys((*KNOWN, ("Zlib", _ZLIB), ("Zlib", "zlib License\n" + _ZLIB), ("Unlicense", _UNLICENSE), *(("Unlicense", f"{_UNLICENSE}\nFor more information, please refer to {x}://unlicense.org{y}") for x in ("http", "https") for y in ("", "/"))))
    known = {canonical_text(text) for _, text in KNOWN}
    for name, text in [(k, f"{verb} {the}{x}.") for k, names in NAMES.items() for x in names for verb in VERBS for the in ("", "the ")] + [(k, f"SPDX-License-Identifier: {k}") for k in SPDX]:
        if canonical_text(text) not in known:
            found[name, text] = None
    for path in sorted((Path(__file__).parent / "licences").iterdir()):
        text = path.read_text()
        found[path.name, text] = None
        end = text.find("END OF TERMS AND CONDITIONS")
        if end >= 0:
            found[path.name, text[: end + 27]] = None
            found[path.name, text[:end]] = None
    return tuple(found)


#: First blocks of known texts that are looked for in place; of more of them all blocks are joined.
FIRSTS = 10_000


def scan(docs: DataFrame, known: DataFrame | None = None, doc_id: str = "doc_id", text: str = "text", known_runs: DataFrame | None = None) -> DataFrame:
    """(doc_id, whole, licences, n_units): the licence that a document is as a whole (or null), all that are in it, sorted and
    comma-joined, and how many of its units (itself, blocks of several lines, lines, runs of some of its blocks) are known texts.

    ``known`` has the columns digest and licence, ``known_runs`` also first and blocks (as ``runs`` gives them; only the built-in ones by
    default, and none with another ``known``). Of several licences of one digest all are found, and the least is the ``whole``. Null texts are
    empty and match nothing. Rows stay rows; rows that share a doc_id have the finds of all of them, counted for each row.
    """
    spark: SparkSession = docs.sparkSession
    schema = "digest string, licence string, first string, blocks int"
    if known_runs is None:
        known_runs = spark.createDataFrame(runs(registry()) if known is None else [], schema)
    marks = MARKS if known is None else None  # another registry may have texts without these words
    known = known if known is not None else spark.createDataFrame(digests(registry()), "digest string, licence string")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    marked = (lambda x: F.lower(x).rlike("|".join(marks))) if marks else (lambda x: F.lit(True))
    kept = rows.where(marked(F.col("text")))
    blocks = F.filter(F.split("text", BLANK), lambda x: F.contains(x, F.lit("\n")) & (x != F.col("text")))
    parts = F.filter(F.split("text", r"\n"), lambda x: x != F.col("text"))
    units = F.concat(F.array(F.struct(F.lit(True).alias("whole"), F.col("text").alias("unit"))), F.transform(F.filter(F.concat(blocks, parts), marked), lambda x: F.struct(F.lit(False).alias("whole"), x.alias("unit"))))
    found = kept.select("doc_id", F.explode(units).alias("u")).select("doc_id", "u.whole", F.sha2(canonical(F.col("u.unit")), 256).alias("digest"))
    found = found.join(known.select("digest", "licence"), "digest").select("doc_id", "whole", "licence")

    # runs of blocks begin where a block is the first of a known text
    firsts = [r[0] for r in known_runs.select("first").distinct().limit(FIRSTS + 1).collect()]
    own = kept.select("doc_id", F.filter(F.transform(F.split("text", BLANK), canonical), lambda x: x != "").alias("b")).where(F.size("b") > 2)
    hashed = F.transform("b", lambda x, k: F.struct(k.alias("at"), F.sha2(x, 256).alias("first")))
    begins = hashed if len(firsts) > FIRSTS else F.filter(hashed, lambda x: F.array_contains(F.array(*map(F.lit, firsts)).cast("array<string>"), x["first"]))
    own = own.select("doc_id", "b", F.explode(begins).alias("x")).join(known_runs, F.col("x.first") == F.col("first"))
    own = own.where((F.col("blocks") < F.size("b")) & (F.sha2(F.array_join(F.slice("b", F.col("x.at") + 1, F.col("blocks")), " "), 256) == F.col("digest")))
    found = found.unionByName(own.select("doc_id", F.lit(False).alias("whole"), "licence"))

    found = found.groupBy("doc_id").agg(F.min(F.when(F.col("whole"), F.col("licence"))).alias("whole"), F.array_join(F.array_sort(F.collect_set("licence")), ",").alias("licences"), F.count("*").alias("n_units"))
    found = found.withColumnRenamed("doc_id", "found_id")
    joined = rows.select("doc_id").join(found, F.col("doc_id").eqNullSafe(F.col("found_id")), "left")
    return joined.select("doc_id", "whole", F.coalesce("licences", F.lit("")).alias("licences"), F.coalesce("n_units", F.lit(0)).cast("long").alias("n_units"))
