"""License scans by canonical digests; DataFrame functions only.

A text is made canonical: lower case, copyright lines taken out, equivalent spellings made one, all
ASCII signs and white space between words one space. The SHA-256 of the whole canonical text, and
of each of its lines, is joined by hash to the digests of known licence texts and notices, which go
through the same steps.

Defined cases: a null text is empty; an empty canonical text matches nothing; a null doc_id is kept;
repeated rows are kept; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spellings that count as equal (British first).
SPELLINGS = [
    ("licence", "license"), ("licencing", "licensing"), ("organisation", "organization"), ("authoris", "authoriz"),
    ("recognis", "recogniz"), ("favour", "favor"), ("honour", "honor"), ("labour", "labor"), ("judgement", "judgment"),
    ("acknowledgement", "acknowledgment"), ("fulfilment", "fulfillment"), ("modifyed", "modified"), ("non-infringement", "noninfringement"),
    ("copyright holder", "copyright owner"), ("http://", "https://"),
]

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_NAME = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
_BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""

#: Known licence texts and notices, by SPDX identifier.
KNOWN = [
    ("MIT", _MIT), ("MIT", "MIT License\n" + _MIT), ("MIT", "The MIT License (MIT)\n" + _MIT), ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."), ("MIT", "This project is licensed under the MIT License."), ("MIT", "SPDX-License-Identifier: MIT"),
    ("ISC", _ISC), ("ISC", "ISC License\n" + _ISC), ("ISC", "SPDX-License-Identifier: ISC"),
    ("BSD-2-Clause", _BSD_HEAD + _BSD_TAIL), ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("BSD-3-Clause", _BSD_HEAD + _BSD_NAME + _BSD_TAIL), ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("Zlib", _ZLIB), ("Apache-2.0", _APACHE), ("Apache-2.0", "Licensed under the Apache License, Version 2.0."), ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."), ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0"), ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."), ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."), ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."), ("All-Rights-Reserved", "All rights reserved."),
]

#: SHA-256 of the canonical form (see whole) of full licence texts as Debian has them in /usr/share/common-licenses.
DIGESTS = [
    ("Apache-2.0", "bb9b9809799dde483dd255c759a87cd240b7c00fdd56de34e1e2af5eba9be6f7"),
    ("Artistic-1.0-Perl", "842d1d7843c0e8fa9d9fc60e2e1e785750f849881896afdeab8b3bcccd224479"),
    ("BSD-3-Clause", "3d151449461c0c776e892a4dc41cac0d251eb00c9fc49d2d48802d9bed818fe9"),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GFDL-1.2", "87c71d035f42e6959a1fb4600d4fcd28ce1443fdf0466a7207557492baa6cc0e"),
    ("GFDL-1.3", "cb2184027defdb94f76a52a960857d9e69fc476b5f76d8506d1cc0195b2463f7"),
    ("GPL-1.0", "37f380f152339f34a15db620545eb53f0b5c7d9e6a9542aa09ed0d22f186920f"),
    ("GPL-2.0", "5147a46525fc36b30edbb3469564d4930add19b5b86c56d8d58e084575fd474a"),
    ("GPL-3.0", "215debb7a19305d23905a73b68831a18b4124b5de20c9a12139e958b95ddb2a0"),
    ("LGPL-2.0", "82b9c718a1edbbe60a4f5828e6e8c8390d714f09bfee18638761bb3f8fdff504"),
    ("LGPL-2.1", "8972cc10118fe8a142e8b2d34ba122d3a2c710126a256b6786246af9ae4cd5a6"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "fbe9a0b96f52e03cb474f9a7083781399c011279e85b548118563ec96e659354"),
    ("MPL-2.0", "3dacd2c104719e7227969cbdcc7d581518827199e830b9379627eec0a32f8ab7"),
]

#: All identifiers in a fixed order.
NAMES = list(dict.fromkeys(x for x, _ in KNOWN + DIGESTS))

COPYRIGHT = r"(^|\n)[ \t\r>*#/;-]*(copyright|\(c\)|©)[^\n]*"
SIGNS = r"[\x00-\x09\x0b-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+"


def canonical(text: Column) -> Column:
    """The canonical text; lines stay apart by \\n."""
    text = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), COPYRIGHT, "$1")
    for one, other in SPELLINGS:
        text = F.replace(text, F.lit(one), F.lit(other))
    return F.regexp_replace(text, SIGNS, " ")


def whole(canonical_text: Column) -> Column:
    return F.trim(F.regexp_replace(canonical_text, "[ \n]+", " "))


def known(spark: SparkSession) -> DataFrame:
    """digest, bit and license of the known texts: a fixed, small table."""
    order = {x: i for i, x in enumerate(NAMES)}
    rows = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(x).alias("license"), F.lit(order[x]).alias("no"), F.lit(t).alias("text")) for x, t in KNOWN])).alias("x")).select("x.*")
    rows = rows.select(F.sha2(whole(canonical(F.col("text"))), 256).alias("digest"), "license", "no")
    full = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(d).alias("digest"), F.lit(x).alias("license"), F.lit(order[x]).alias("no")) for x, d in DIGESTS])).alias("x")).select("x.*")
    return rows.union(full).distinct()


def scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """doc_id, text_digest (of the whole canonical text), text_license (null: none known), n_license_lines,
    line_licenses (identifiers of the lines' licences, in order, by commas; empty: none) of every document."""
    spark = docs.sparkSession
    names = F.array(*map(F.lit, NAMES))
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), canonical(F.col(text_col)).alias("text"))
    digest = F.sha2(whole(F.col("text")), 256)
    d = d.select("doc_id", "row", digest.alias("text_digest"), F.split("text", "\n").alias("lines"))
    units = F.concat(F.array(F.struct(F.lit(True).alias("all"), F.col("text_digest").alias("digest"))), F.transform(F.filter("lines", lambda x: F.trim(x) != ""), lambda x: F.struct(F.lit(False).alias("all"), F.sha2(F.trim(F.regexp_replace(x, " +", " ")), 256).alias("digest"))))
    units = d.select("doc_id", "row", "text_digest", F.explode(units).alias("u")).select("doc_id", "row", "text_digest", "u.*")
    units = units.join(F.broadcast(known(spark)), "digest", "left")  # a fixed table of a few dozen rows
    # A document's units stand together in one task: the partial aggregate leaves a row for each.
    bit = F.expr("shiftleft(1L, no)")
    found = units.groupBy("row", "doc_id", "text_digest").agg(F.max(F.when(F.col("all"), F.col("no"))).alias("no"), F.sum(F.when(~F.col("all") & F.col("no").isNotNull(), 1).otherwise(0)).alias("n_license_lines"), F.bit_or(F.when(~F.col("all"), bit)).alias("bits"))
    listed = F.array_join(F.array_compact(F.array(*[F.when(F.coalesce("bits", F.lit(0)).bitwiseAND(F.lit(1 << i)) != 0, F.lit(x)) for i, x in enumerate(NAMES)])), ",")
    return found.select("doc_id", "text_digest", F.get(names, F.col("no")).alias("text_license"), F.col("n_license_lines").cast("long").alias("n_license_lines"), listed.alias("line_licenses"))


def scan_sql() -> str:
    """The same in DuckDB SQL."""
    def sql(text: str) -> str:
        return "'" + text.replace("'", "''") + "'"

    def canon(x: str) -> str:
        x = f"regexp_replace(lower(coalesce({x}, '')), {sql(COPYRIGHT)}, '\\1', 'g')"
        for one, other in SPELLINGS:
            x = f"replace({x}, {sql(one)}, {sql(other)})"
        return f"regexp_replace({x}, {sql(SIGNS)}, ' ', 'g')"

    order = {x: i for i, x in enumerate(NAMES)}
    rows = ", ".join(f"({sql(x)}, {order[x]}, {sql(t)})" for x, t in KNOWN)
    full = ", ".join(f"({sql(x)}, {order[x]}, {sql(d)})" for x, d in DIGESTS)
    return f"""
WITH known AS (SELECT DISTINCT license, no, sha256(trim(regexp_replace({canon('t')}, '[ \\n]+', ' ', 'g'))) AS digest FROM (VALUES {rows}) v(license, no, t) UNION SELECT * FROM (VALUES {full}) v(license, no, digest)),
docs AS (SELECT doc_id, {canon('text')} AS c FROM documents),
whole AS (SELECT doc_id, sha256(trim(regexp_replace(c, '[ \\n]+', ' ', 'g'))) AS text_digest FROM docs),
parts AS (SELECT doc_id, sha256(trim(regexp_replace(x, ' +', ' ', 'g'))) AS digest FROM (SELECT doc_id, unnest(string_split(c, chr(10))) AS x FROM docs) WHERE trim(x) <> ''),
hits AS (SELECT doc_id, count(*) AS n, list_sort(list(DISTINCT no)) AS nos FROM parts JOIN known USING (digest) GROUP BY doc_id)
SELECT w.doc_id, w.text_digest, k.license AS text_license, CAST(coalesce(h.n, 0) AS BIGINT) AS n_license_lines,
coalesce(array_to_string(list_transform(h.nos, lambda i: [{', '.join(sql(x) for x in order)}][i + 1]), ','), '') AS line_licenses
FROM whole w LEFT JOIN known k ON k.digest = w.text_digest LEFT JOIN hits h ON h.doc_id = w.doc_id"""
