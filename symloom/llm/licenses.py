"""License scans by canonical digests: whole texts are normalised, hashed and joined.

Normalising drops copyright lines, case, punctuation, white space runs and equivalent spellings;
what is left of two copies of one licence is the same string, and its SHA-256 finds the licence
in a table of known digests. A line is a copyright line if a year, a copyright sign, ``by`` or
nothing but capitalised names follow the word; legal text that happens to be wrapped before
"copyright" stays. Everything is DataFrame functions.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spellings that licences use for the same word, as (found, taken).
SPELLINGS = [
    ("licence", "license"), ("licenced", "licensed"), ("licences", "licenses"), ("sublicence", "sublicense"), ("sub license", "sublicense"),
    ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("analyse", "analyze"), ("artefact", "artifact"), ("authorisation", "authorization"),
    ("authorised", "authorized"), ("calibre", "caliber"), ("cancelled", "canceled"), ("capitalisations", "capitalizations"), ("catalogue", "catalog"),
    ("categorise", "categorize"), ("centre", "center"), ("copyright holder", "copyright owner"), ("emphasised", "emphasized"), ("favour", "favor"),
    ("favourite", "favorite"), ("fulfil", "fulfill"), ("fulfilment", "fulfillment"), ("initialise", "initialize"), ("judgement", "judgment"),
    ("labelling", "labeling"), ("labour", "labor"), ("maximise", "maximize"), ("modelled", "modeled"), ("modelling", "modeling"), ("offence", "offense"),
    ("optimise", "optimize"), ("organisation", "organization"), ("organise", "organize"), ("per cent", "percent"), ("practise", "practice"),
    ("programme", "program"), ("realise", "realize"), ("recognise", "recognize"), ("signalling", "signaling"), ("utilisation", "utilization"),
    ("whilst", "while"), ("wilful", "willful"), ("non commercial", "noncommercial"), ("merchantibility", "merchantability"), ("unlicence", "unlicense"),
]
#: Marks before the first word of a line.
_LEAD = r"(^|\n)[^A-Za-z0-9\n(©]*"
#: What a copyright line starts with, in ASCII lower case.
_HOLDER = r"(?:copyright[ \t:]*(?:\(c\)|©|&copy;|[0-9]|by[ \t])|\(c\)[ \t]*(?:copyright|[0-9])|©)"
#: Lines of names alone, as written: legal words go on in lower case or are all capitals.
NAME_LINE = _LEAD + r"[Cc]opyright[ \t]+(?:[Tt]he[ \t]+)?[A-Z][a-z][A-Za-z.,&'-]*(?:[ \t]+(?:and|of|the|contributors|authors|[A-Z][a-z][A-Za-z.,&'-]*))*[ \t.\r]*(?:\n|$)"
#: A text that goes on in the holder's line: the line up to it is cut.
_STARTS = r"(permission is hereby|permission to use|redistribution and use|this software is provided|everyone is permitted|licensed under|released under)"
HOLDER_CLAUSE = _LEAD + _HOLDER + r"[^\n]*?" + _STARTS
COPYRIGHT_LINE = _LEAD + _HOLDER + r"[^\n]*"
RESERVED_LINE = _LEAD + r"all rights reserved[^A-Za-z0-9\n]*"
NOT_WORD = r"[\x00-/:-`{-\x7F]+"

_MIT_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
"""
_MIT_NONE = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
"""
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_NONE = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.
"""
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n"
_BSD_TWO = """1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_THREE = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"
_BSD_NONE = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
"""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.
"""
_WTFPL = """Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.

DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE
TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION

0. You just DO WHAT THE FUCK YOU WANT TO.
"""
_UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
"""
_UNLICENSE_LINK = "For more information, please refer to <{}>\n"
_APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.
"""
#: Fixed values: (licence, what the text is, text) of known licences and short notices.
KNOWN = [
    ("MIT", "text", _MIT_GRANT + _MIT_NONE),
    ("MIT-0", "text", _MIT_GRANT.split(", subject to")[0] + ".\n" + _MIT_NONE),
    ("ISC", "text", _ISC_GRANT + ", provided that the above copyright notice and this permission notice appear in all copies.\n" + _ISC_NONE),
    ("0BSD", "text", _ISC_GRANT + ".\n" + _ISC_NONE),
    ("BSD-2-Clause", "text", _BSD_HEAD + _BSD_TWO + _BSD_NONE),
    ("BSD-3-Clause", "text", _BSD_HEAD + _BSD_TWO + _BSD_THREE + _BSD_NONE),
    ("Zlib", "text", _ZLIB), ("WTFPL", "text", _WTFPL),
    ("Unlicense", "text", _UNLICENSE), ("Unlicense", "text", _UNLICENSE + _UNLICENSE_LINK.format("http://unlicense.org/")), ("Unlicense", "text", _UNLICENSE + _UNLICENSE_LINK.format("https://unlicense.org")),
    ("Apache-2.0", "notice", _APACHE_NOTICE),
    ("MIT", "notice", "Released under the MIT License."), ("Apache-2.0", "notice", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0-only", "notice", "This work is licensed under the GNU General Public License, version 3."), ("CC-BY-NC-4.0", "notice", "Licensed under CC BY-NC 4.0."),
]


#: Digests of the canonical forms of long licences, as their stewards publish them.
LONG_TEXTS = [
    ("Apache-2.0", "95f35d79ea3bab75c250549d6a03cef242e0547d78c99e26fcede49936fb0184"),
    ("Artistic-1.0-Perl", "bc4d0c00d493021b9f3b1041689fa28b4bf980cf2e37601f7cb475a7265e3b93"),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GPL-1.0", "a39d7cceab675e14bdc24e269448ac0ed44fdef25178b183064cd4b35b8d2e7b"),
    ("GPL-2.0", "cf74dfa78ca9ac981c7ae9e50c4ecfb828df2e5ef2f1646368388676215766b5"),
    ("GPL-3.0", "68ca42869e9a3e25843be66c6f296ce2b1f3629ac71d77465db0636dc8781c06"),
    ("LGPL-2.0", "1862ecc2c3c5e3b9e88481e95603c88e089c43e9d5702b2ec01391491b606a9e"),
    ("LGPL-2.1", "ac0856eb11aebb30c08445444c942c1ddcde9d0a0447c9ed2b8a19ab7d51eba5"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("GFDL-1.2", "8446e2329e3fe2b35501056164a645d74fef33dc1b8a2a132629bf1935fa72e7"),
    ("GFDL-1.3", "961b6d8afa12e353079f8676ad28084c800a46123e76f7f4f7e7f81df82289dc"),
    ("MPL-1.1", "26ba73e836ecb04fe87d5eca80ca27cff1afa2d7683455be1517bd23b8d27986"),
    ("MPL-2.0", "f82071285728ca3ec7685ee9bc4acdae0b8267142a4d20b8f1805eabedb4a98a"),
]


#: Titles that may stand above a licence, in canonical form.
TITLES = {
    "MIT": ["mit license", "the mit license", "the mit license mit", "mit license mit", "the mit license expat"],
    "MIT-0": ["mit no attribution", "mit 0", "mit no attribution license"],
    "ISC": ["isc license", "the isc license", "isc license isc", "the isc license isc"],
    "0BSD": ["bsd zero clause license", "zero clause bsd", "zero clause bsd license", "0bsd license"],
    "BSD-2-Clause": ["bsd 2 clause license", "the bsd 2 clause license", "bsd 2 clause simplified license", "simplified bsd license", "the simplified bsd license"],
    "BSD-3-Clause": ["bsd 3 clause license", "the bsd 3 clause license", "bsd 3 clause new or revised license", "new bsd license", "the new bsd license", "modified bsd license"],
    "Zlib": ["zlib license", "the zlib license", "zlib libpng license", "the zlib libpng license"],
    "Unlicense": ["the unlicense", "unlicense"],
}
_OF_TITLE = {t: k for k, own in TITLES.items() for t in own}
#: What may follow a title: the licences' first words.
_FIRST = "permission is hereby|permission to use|redistribution and use|this software is provided|this is free and"
TITLE_PATTERN = "^(" + "|".join(sorted(_OF_TITLE, key=lambda t: (-len(t), t))) + f") (?:{_FIRST})"


def canonical(text: Column) -> Column:
    """The canonical form of whole texts; null stays null."""
    lower = lambda c: F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    plain = lower(text)
    held = lower(F.regexp_replace(text, NAME_LINE, "$1"))
    held = F.regexp_replace(held, HOLDER_CLAUSE, "$1$2")
    held = F.regexp_replace(F.regexp_replace(held, COPYRIGHT_LINE, "$1"), RESERVED_LINE, "$1")
    # most texts name no holder: their lines need not be looked through
    named = plain.contains("copyright") | plain.contains("(c)") | plain.contains("©") | plain.contains("all rights reserved")
    own = F.concat(F.lit(" "), F.regexp_replace(F.when(named, held).otherwise(plain), NOT_WORD, " "), F.lit(" "))
    for found, taken in SPELLINGS:
        own = F.replace(own, F.lit(f" {found} "), F.lit(f" {taken} "))
    return F.btrim(own)


def canonical_of(text: str) -> str:
    """The same form of one text, for the table of known digests."""
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t)
    own = lower(re.sub(NAME_LINE, r"\1", text))
    own = re.sub(HOLDER_CLAUSE, r"\1\2", own)
    own = re.sub(RESERVED_LINE, r"\1", re.sub(COPYRIGHT_LINE, r"\1", own))
    own = " " + re.sub(NOT_WORD, " ", own) + " "
    for found, taken in SPELLINGS:
        own = own.replace(f" {found} ", f" {taken} ")
    return own.strip(" ")


def untitled(form: Column, title: Column) -> Column:
    """A canonical form without its title."""
    return F.when(title != "", F.substr(form, F.length(title) + 2)).otherwise(form)


def known_rows(known: list[tuple[str, str, str]] | None = None) -> dict[str, tuple[str, str]]:
    """(licence, kind) by digest of known texts, the first one named; by default all that this
    module knows."""
    rows: dict[str, tuple[str, str]] = {}
    for license_id, kind, text in KNOWN if known is None else known:
        form = canonical_of(text)
        if m := re.match(TITLE_PATTERN, form):  # as documents' forms are
            form = form[m.end(1) + 1 :]
        rows.setdefault(hashlib.sha256(form.encode()).hexdigest(), (license_id, kind))
    for license_id, digest in LONG_TEXTS if known is None else []:
        rows.setdefault(digest, (license_id, "text"))
    return rows


def known_digests(spark: SparkSession, known: list[tuple[str, str, str]] | None = None) -> DataFrame:
    """``k_digest, license, kind`` of known texts, one row a digest."""
    return spark.createDataFrame([(d, *x) for d, x in known_rows(known).items()], "k_digest string, license string, kind string")


def folder_digests(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """``k_digest, license, kind`` of a folder of licence texts, a file each, named like the
    licence (an ending ``.txt`` or ``.md`` apart); to be given to ``scan_licenses`` as ``known``."""
    files = spark.read.format("text").option("wholetext", True).option("pathGlobFilter", pattern).load(folder)
    name = F.regexp_replace(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1), r"\.(txt|md)$", "")
    rows = files.select(name.alias("license"), canonical(F.col("value")).alias("c"))
    rows = rows.select("license", untitled(F.col("c"), F.regexp_extract("c", TITLE_PATTERN, 1)).alias("c")).where("c <> ''")
    return rows.groupBy(F.sha2("c", 256).alias("k_digest")).agg(F.min("license").alias("license")).withColumn("kind", F.lit("text"))


def scan_licenses(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """``doc_id, n_canonical, digest, license, kind`` of every document.

    ``license`` is null unless the whole text, normalised, is a known one. A title of a licence
    (``TITLES``) may stand above the text, whose ``kind`` then is ``titled``; it is not part of the form,
    and the title of another licence makes it no match. Null texts have null
    lengths and digests; texts of punctuation alone normalise to the empty text and match
    nothing. Repeated rows stay; an empty table gives an empty result; further columns are left
    out. ``known`` has one row a digest; Spark broadcasts it where it is small, as lists of licences
    are, and then shuffles no row; texts are never shuffled.
    """
    known = known_digests(docs.sparkSession) if known is None else known
    rows = docs.select("doc_id", canonical(F.col("text")).alias("c")).select("doc_id", "c", F.regexp_extract("c", TITLE_PATTERN, 1).alias("title"))
    rows = rows.select("doc_id", "title", untitled(F.col("c"), F.col("title")).alias("c")).select("doc_id", "title", F.length("c").cast("long").alias("n_canonical"), F.sha2("c", 256).alias("digest"))
    titles = F.create_map(*[F.lit(x) for t, k in _OF_TITLE.items() for x in (t, k)])
    fits = (F.col("digest") == F.col("k_digest")) & (F.col("n_canonical") > 0) & ((F.coalesce("title", F.lit("")) == "") | (titles[F.col("title")] == F.col("license")))
    kind = F.when((F.col("title") != "") & (F.col("kind") == "text"), F.lit("titled")).otherwise(F.col("kind"))
    return rows.join(known, fits, "left").select("doc_id", "n_canonical", "digest", "license", kind.alias("kind"))


def oracle_sql() -> str:
    """The whole-table scan as DuckDB SQL."""
    quote = lambda pattern: pattern.replace("'", "''")
    lower = lambda c: f"translate({c}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    own = lower(f"regexp_replace(text, '{quote(NAME_LINE)}', '\\1', 'g')")
    own = f"regexp_replace({own}, '{quote(HOLDER_CLAUSE)}', '\\1\\2', 'g')"
    for pattern in (COPYRIGHT_LINE, RESERVED_LINE):
        own = f"regexp_replace({own}, '{quote(pattern)}', '\\1', 'g')"
    own = f"' ' || regexp_replace({own}, '{NOT_WORD}', ' ', 'g') || ' '"
    for found, taken in SPELLINGS:
        own = f"replace({own}, ' {found} ', ' {taken} ')"
    table = ", ".join(f"('{d}', '{license_id}', '{kind}')" for d, (license_id, kind) in known_rows().items())
    titles = ", ".join(f"('{t}', '{k}')" for t, k in _OF_TITLE.items())
    return f"""
        WITH a AS (SELECT doc_id, trim({own}, ' ') AS a FROM documents),
             b AS (SELECT doc_id, a, regexp_extract(a, '{TITLE_PATTERN}', 1) AS title FROM a),
             c AS (SELECT doc_id, title, CASE WHEN title <> '' THEN substr(a, length(title) + 2) ELSE a END AS c FROM b),
             d AS (SELECT doc_id, title, CAST(length(c) AS BIGINT) AS n_canonical, sha256(c) AS digest FROM c),
             k(k_digest, license, kind) AS (VALUES {table}),
             t(t_title, t_license) AS (VALUES {titles})
        SELECT doc_id, n_canonical, digest, license, CASE WHEN title <> '' AND kind = 'text' THEN 'titled' ELSE kind END AS kind
        FROM d LEFT JOIN t ON t_title = title LEFT JOIN k ON digest = k_digest AND n_canonical > 0 AND (coalesce(title, '') = '' OR t_license = license)"""
