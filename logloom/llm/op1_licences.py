"""License scans by canonical digests, with DataFrame functions only."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Equivalent spellings, each replaced by the second in lower-case text.
SPELLINGS = (
    ("licence", "license"), ("sub license", "sublicense"), ("merchantibility", "merchantability"), ("cc by", "ccby"),
    ("non infringement", "noninfringement"), ("non commercial", "noncommercial"), ("per cent", "percent"), ("judgement", "judgment"),
    ("acknowledgement", "acknowledgment"), ("favour", "favor"), ("behaviour", "behavior"), ("organisation", "organization"),
    ("authorisation", "authorization"), ("authorised", "authorized"), ("modelled", "modeled"), ("copyright holder", "copyright owner"),
    ("https", "http"), ("whilst", "while"), ("fulfil ", "fulfill "), ("v2 0", "version 2 0"),
)

#: The bound of the broadcast table.
MAX_KNOWN = 10_000

# Known licence texts and notices, by SPDX identifier.
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_ZERO_BSD = _ISC.replace(", provided that the above copyright notice and this permission notice appear in all copies", "")
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_NAME = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
_BSD_TAIL = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_MIT_NO_NOTICE = _MIT.replace(", subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", ".")
_UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org>"""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""
_BOOST = """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:

The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD_2, _BSD_3 = _BSD_HEAD + _BSD_TAIL, _BSD_HEAD + _BSD_NAME + _BSD_TAIL
# Identifier, the titles that stand before the text, the text.
WHOLE = (
    ("MIT", ("MIT License", "The MIT License", "The MIT License (MIT)"), _MIT),
    ("MIT-0", ("MIT No Attribution", "MIT No Attribution License"), _MIT_NO_NOTICE),
    ("ISC", ("ISC License", "The ISC License", "ISC License (ISC)"), _ISC),
    ("0BSD", ("BSD Zero Clause License", "Zero-Clause BSD"), _ZERO_BSD),
    ("BSD-2-Clause", ("BSD 2-Clause License", "The BSD 2-Clause License", 'BSD 2-Clause "Simplified" License'), _BSD_2),
    ("BSD-3-Clause", ("BSD 3-Clause License", "The BSD 3-Clause License", 'BSD 3-Clause "New" or "Revised" License', "BSD License"), _BSD_3),
    ("Unlicense", ("The Unlicense",), _UNLICENSE),
    ("Zlib", ("zlib License", "The zlib License", "zlib/libpng License"), _ZLIB),
    ("BSL-1.0", ("Boost Software License - Version 1.0 - August 17th, 2003", "Boost Software License 1.0"), _BOOST),
)
# One-line notices.
NOTICES = (
    ("MIT", "Released under the MIT License."), ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."), ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."), ("CC0-1.0", "Released under CC0 1.0."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."), ("MPL-2.0", "Licensed under the Mozilla Public License, Version 2.0."),
)


def variants(titles: tuple[str, ...], text: str) -> list[str]:
    """The text alone and under each title, with numbers before its clauses or without."""
    plain = re.sub(r"(?m)^[0-9]\. ", "", text)
    return [f"{t}\n\n{x}" if t else x for x in dict.fromkeys((text, plain)) for t in ("", *titles)]


KNOWN = tuple((name, x) for name, titles, text in WHOLE for x in variants(titles, text)) + NOTICES
# SHA-256 of the canonical form of long public texts, whole, and up to the end of
# their terms where instructions follow.
KNOWN_DIGESTS = (
    ("Apache-2.0", "75acde0fb516a7ba4597dfc23680cf78281f7fae7f3b74a78e06ef83c1c375c6"),
    ("Apache-2.0", "f9138026e58bdb767e6c6e974637ff9aacbaedf2695e30fef144e5d7d84448ff"),
    ("CC0-1.0", "cccf7894e1b9f4ba9f97728bf0c5baf9e07bc2ac93da7a51556451b1fb2b868e"),
    ("GFDL-1.2", "66919c3537107c2c9f5219f6ba4c41fe9c0d7c14d885087e3db69494463a778e"),
    ("GFDL-1.3", "e5184cec15480f1e92fb0fd73493a6a30f3fffedf3ad12844566cd9e5c4f5c27"),
    ("GPL-1.0", "37f380f152339f34a15db620545eb53f0b5c7d9e6a9542aa09ed0d22f186920f"),
    ("GPL-1.0", "3b5b36de4a3801680b9eb44e80739b3aeb71c4bf6ca623ee5f87b2e2b03d3ed9"),
    ("GPL-2.0", "a76cc6ce70778ba70e43b9b1838f9e3f88b3fc7c5acbb3b8a9847918003b63e0"),
    ("GPL-2.0", "ae2be2aaa68f5e52ef402874fc8c7c691879b445cb12e49d84f88168cc2d7dd6"),
    ("GPL-3.0", "4a9083dfa89bea4f460e373a4c7a4645205d5e3d3be775d544b10357e357f57b"),
    ("GPL-3.0", "ee0d2b91860148fdc6916d4fbea5723c7b0c7330d7a45ee71fabe123ce7175f8"),
    ("LGPL-2.0", "7d5246cc24a9d78fffd01a07fbc2e71edd1e94ad8d403f3180a4cf5fef43d389"),
    ("LGPL-2.0", "bea988245c65edbddad6f43ff12ca2472c232324e916d42648b90eac944d833e"),
    ("LGPL-2.1", "65484d3c9f900f96945bd4e6c5397aaa24f93bdc8f720eae06fbd377c62cfe97"),
    ("LGPL-2.1", "ed875dac9045cba09a17867210991f3a4a82f80b82096b054560a3a8dae9d692"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "a1b36de49a400e3d3385d5987188db954a084f9876243aa7207cd91de3f24a7b"),
    ("MPL-2.0", "f82071285728ca3ec7685ee9bc4acdae0b8267142a4d20b8f1805eabedb4a98a"),
)

#: A line that states a copyright: it begins as one and has a year, a mark or a reservation. It
#: is applied to the text after a newline is put before it, so that each line begins with one.
COPYRIGHT_LINE = r"\n[ \t]*(?i:(?:copyright|\(c\)|©)[^\n]*(?:[0-9]{4}|\(c\)|©|<year>|\[yyyy\]|all rights reserved)|all rights reserved)[^\n]*"
#: Of the texts' characters, letters and digits alone count.
OTHER = r"[^\p{L}\p{N}\n]+"


def _spelled(t: Column, spellings) -> Column:
    for one, other in spellings:
        t = F.replace(t, F.lit(one), F.lit(other))
    return t


def canonical_lines(text: Column) -> Column:
    """Lower case without copyright statements, in each line words parted by one space and spellings made one."""
    t = F.lower(F.regexp_replace(F.concat(F.lit("\n"), text), COPYRIGHT_LINE, ""))
    t = F.regexp_replace(F.replace(t, F.lit("&"), F.lit(" and ")), OTHER, " ")
    return _spelled(t, SPELLINGS)


#: Spellings of two words, which the end of a line may part.
PARTED = tuple(x for x in SPELLINGS if " " in x[0])


def joined(lines: Column) -> Column:
    """The lines' canonical form as a whole: however a text is wrapped, it is the same."""
    return _spelled(F.trim(F.regexp_replace(lines, r"[ \n]+", " ")), PARTED)


def canonical(text: Column) -> Column:
    return joined(canonical_lines(text))


def _spelled_sql(t: str, spellings) -> str:
    quote = lambda x: x.replace("'", "''")
    for one, other in spellings:
        t = f"replace({t}, '{quote(one)}', '{quote(other)}')"
    return t


def canonical_lines_sql(text: str) -> str:
    t = f"lower(regexp_replace(chr(10) || {text}, '{COPYRIGHT_LINE}', '', 'g'))"
    return _spelled_sql(f"regexp_replace(replace({t}, '&', ' and '), '{OTHER}', ' ', 'g')", SPELLINGS)


def joined_sql(lines: str) -> str:
    return _spelled_sql(f"trim(regexp_replace({lines}, '[ \\n]+', ' ', 'g'))", PARTED)


def digest(canonical_text: Column) -> Column:
    return F.sha2(canonical_text.cast("binary"), 256)


def known_digests(spark: SparkSession, known=KNOWN, digests=KNOWN_DIGESTS) -> DataFrame:
    """(digest, licence), a row a known text. The table is part of the program, so it is small."""
    if len(known) + len(digests) > MAX_KNOWN:
        raise ValueError("too many known licences to broadcast")
    table = spark.createDataFrame(list(known), "licence string, text string").select(digest(canonical(F.col("text"))).alias("digest"), "licence")
    return table.unionByName(spark.createDataFrame(list(digests), "licence string, digest string")).groupBy("digest").agg(F.min("licence").alias("licence"))


def scan_licences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", known=KNOWN, digests=KNOWN_DIGESTS) -> DataFrame:
    """One row per row of ``docs``: doc_id, text_digest, licence, line_licences.

    licence: that of the known text with the whole text's digest, else null. line_licences:
    the sorted distinct licences of lines that are a known text, a notice for instance,
    joined by commas. Null counts as empty, which no known text equals. All comparisons are
    by SHA-256 of the canonical form: texts and lines are joined to the known digests, a
    broadcast hash table of at most ``MAX_KNOWN`` rows. Rows that repeat are told apart; no
    rows: no rows.
    """
    names = sorted({name for name, _ in (*known, *digests)})
    spark = docs.sparkSession
    # a bit a licence, 63 to a long, so that plain hash aggregates combine before the shuffle
    numbers = spark.createDataFrame([(name, i, i // 63, 1 << i % 63) for i, name in enumerate(names)], "licence string, number int, word int, bit long")
    table = F.broadcast(known_digests(spark, known, digests).join(F.broadcast(numbers), "licence").select(F.unhex("digest").alias("digest"), "number", "word", "bit"))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("row"), canonical_lines(F.coalesce(F.col(text_col), F.lit(""))).alias("lines"))
    rows = rows.select("doc_id", "row", F.unhex(digest(joined(F.col("lines")))).alias("text_digest"), "lines")
    lines = F.filter(F.transform(F.split("lines", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    parts = F.concat(F.array(F.struct(F.lit(True).alias("whole"), F.col("text_digest").alias("digest"))), F.transform(lines, lambda x: F.struct(F.lit(False).alias("whole"), F.unhex(digest(x)).alias("digest"))))
    met = rows.select("doc_id", "row", "text_digest", F.explode(parts).alias("p")).select("doc_id", "row", "text_digest", "p.*").join(table, "digest", "left")
    bits = lambda k: F.bit_or(F.when(~F.col("whole") & (F.col("word") == k), F.col("bit")).otherwise(F.lit(0).cast("long"))).alias(f"bits{k}")
    found = met.groupBy("row", "doc_id", "text_digest").agg(F.max(F.when(F.col("whole"), F.col("number"))).alias("number"), *[bits(k) for k in range(len(names) // 63 + 1)])
    named = [F.when(F.col(f"bits{i // 63}").bitwiseAND(F.lit(1 << i % 63)) != 0, F.lit(name)) for i, name in enumerate(names)]
    return found.select("doc_id", F.lower(F.hex("text_digest")).alias("text_digest"), F.get(F.array(*map(F.lit, names)), F.col("number")).alias("licence"), F.concat_ws(",", *named).alias("line_licences"))


def oracle_sql() -> str:
    values = ", ".join("('{}', '{}')".format(a, b.replace("'", "''")) for a, b in KNOWN)
    digests = ", ".join(f"('{a}', '{b}')" for a, b in KNOWN_DIGESTS)
    return f"""
WITH known AS (SELECT digest, min(licence) AS licence FROM (
  SELECT l AS licence, sha256({joined_sql(canonical_lines_sql("t"))}) AS digest FROM (VALUES {values}) v(l, t) UNION ALL SELECT * FROM (VALUES {digests}) w(licence, digest)) GROUP BY 1),
docs AS (SELECT doc_id, {canonical_lines_sql("coalesce(text, '')")} AS t FROM documents),
whole AS (SELECT doc_id, sha256({joined_sql("t")}) AS text_digest FROM docs),
lines AS (SELECT doc_id, trim(unnest(string_split(t, chr(10)))) AS line FROM docs),
found AS (SELECT doc_id, string_agg(DISTINCT licence, ',' ORDER BY licence) AS names
          FROM (SELECT doc_id, sha256(line) AS digest FROM lines WHERE line <> '') JOIN known USING (digest) GROUP BY doc_id)
SELECT w.doc_id, w.text_digest, k.licence, coalesce(f.names, '') AS line_licences
FROM whole w LEFT JOIN known k ON k.digest = w.text_digest LEFT JOIN found f ON f.doc_id = w.doc_id
"""
