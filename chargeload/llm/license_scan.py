"""Licence scan by canonical digests.

A text's canonical form is its lower-case letters and digits: lines that name a copyright
holder go, everything between words becomes one space, and equivalent spellings become one. The SHA-256
of that form is looked up among the digests of known licences and notices. Whole texts are looked
up, and every line, sentence and run of up to `RUN` paragraphs that holds a marker word, so a notice inside a document is found too.

The known texts are a small table (`MAX_KNOWN` entries at most, checked), broadcast to the scan of the documents; only
digests are shuffled.

Defined cases: null text is empty and has the digest of the empty string; rows of one id are one document
(its least digest, all its notices); an empty table gives no rows. Everything is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_KNOWN = 10_000

# Lines that only name a copyright holder, equivalent spellings, marker words.
COPYRIGHT_LINE = r"^[ \t*#/;-]*(?:copyright[ \t]+(?:\(c\)|©|[0-9]{4}|by[ \t])|\(c\)|©)[^\n]*$"
SPELLINGS = (("licence", "license"), ("sub license", "sublicense"), ("non infringement", "noninfringement"), ("copyright holder", "copyright owner"),
             ("merchantibility", "merchantability"), ("favour", "favor"), ("organisation", "organization"), ("whilst", "while"), ("https ", "http "))
MARKER = "licen[sc]e|copyright|redistribut|warrant|public domain"
SENTENCE_END = r"(?<=[.!?])[ \t]+|\n"

# Licences.
_PERMISSION = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_AUTHOR_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_NAME = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_TAIL = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
KNOWN: tuple[tuple[str, str], ...] = (
    ("MIT", f"{_PERMISSION} The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. {_AS_IS}"),
    ("MIT", f"MIT License {_PERMISSION} The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. {_AS_IS}"),
    ("ISC", f"Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. {_AUTHOR_AS_IS}"),
    ("0BSD", f"Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. {_AUTHOR_AS_IS}"),
    ("BSD-2-Clause", f"{_BSD_HEAD} {_BSD_TAIL}"),
    ("BSD-3-Clause", f"{_BSD_HEAD} {_BSD_NAME} {_BSD_TAIL}"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\");"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
)

# Digests of canonical full texts (with and without what stands around the terms) and standard headers.
DIGESTS: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "09ad3868555dada25cbf24199409a8c1e39fe8ef08d164adc6e98c1d02767793"),
    ("Apache-2.0", "7a46cf4a5d56898d746584f4fe57bdf571d600a8f39d21063431d88929f803c7"),
    ("Apache-2.0", "93651fc3b3c9c21033cf07999bdb593e0138192678d4743ddf7ee126fefab052"),
    ("Artistic-1.0-Perl", "bc4d0c00d493021b9f3b1041689fa28b4bf980cf2e37601f7cb475a7265e3b93"),
    ("CC0-1.0", "cccf7894e1b9f4ba9f97728bf0c5baf9e07bc2ac93da7a51556451b1fb2b868e"),
    ("GFDL-1.2", "b6270c129be9b0e0172ebf4f39b974d927f155b0569e6689a4fd15068977ecdd"),
    ("GFDL-1.3", "7a546845f0b9175c013adbd275ab046668c2cd62fa85809f866f6d3218d6adcd"),
    ("GPL-1.0", "37f380f152339f34a15db620545eb53f0b5c7d9e6a9542aa09ed0d22f186920f"),
    ("GPL-2.0", "3606e919f92e4862a5628788f284c07f5a0ca41b819f88414d7e825dca4facc4"),
    ("GPL-2.0", "a311bfb80ef013414e08cf2ea0128d424ffe3b22888612edd81cc8f04be43f8d"),
    ("GPL-2.0", "ae2be2aaa68f5e52ef402874fc8c7c691879b445cb12e49d84f88168cc2d7dd6"),
    ("GPL-3.0", "66237b20dfaa335f5c003a3da64555538643deb65ca015c0d5fa588527312c4e"),
    ("GPL-3.0", "b1165b3a9c3ac2638585a8adb6e0c10814b7d97627160747134355b2690ff5af"),
    ("GPL-3.0", "ee0d2b91860148fdc6916d4fbea5723c7b0c7330d7a45ee71fabe123ce7175f8"),
    ("LGPL-2.0", "bea988245c65edbddad6f43ff12ca2472c232324e916d42648b90eac944d833e"),
    ("LGPL-2.1", "38fd334a43235dc3cc9b4054ff7eda2187759f1748f276e846fe99c0d3225c0f"),
    ("LGPL-2.1", "3d43f3599cd8306a5e9c7255077f3c826a7543312eda4ecf9d50975abeb8e95f"),
    ("LGPL-2.1", "ed875dac9045cba09a17867210991f3a4a82f80b82096b054560a3a8dae9d692"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "f77c59051c0127d677dcce7ba0d4733294974749a7b4155250912498d92767d6"),
    ("MPL-2.0", "95f6a0d094cf3da6a140310541c7b576789031b600469b70877b34f97918e4c9"),
    ("MPL-2.0", "acb0bece3dc447740b87a4db23e0d425157552e4a33f273241a94444c2368900"),
    ("Unlicense", "7a4d92cdb11d254973a073803be1148a5402f1b2ca67808cdb3ef78b596102cd"),
)
RUN = 8  # paragraphs of a notice at most
PARAGRAPH_END = r"\n[^\p{L}\p{N}\n]*\n"


def canonical(text: Column) -> Column:
    out = F.regexp_replace(F.lower(text), f"(?md){COPYRIGHT_LINE}", "")
    out = F.trim(F.regexp_replace(out, r"[^\p{L}\p{N}]+", " "))
    for old, new in SPELLINGS:
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def digest(text: Column) -> Column:
    return F.sha2(canonical(text).cast("binary"), 256)


def scan_licenses(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """One row per doc_id of `docs` (doc_id, text): text_digest, license (of the whole text, or null), notices (sorted names
    found in its lines, sentences and runs of paragraphs, joined by commas). `known` has license_id and text."""
    spark = docs.sparkSession
    digests = spark.createDataFrame(list(DIGESTS) if known is None else [], "license_id string, digest string")
    known = spark.createDataFrame(list(KNOWN), "license_id string, text string") if known is None else known.select("license_id", "text")
    if known.limit(MAX_KNOWN + 1).count() > MAX_KNOWN:
        raise ValueError(f"more than {MAX_KNOWN} known licences")
    known = known.select(digest(F.col("text")).alias("digest"), "license_id").unionByName(digests).groupBy("digest").agg(F.min("license_id").alias("license_id"))
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    whole = texts.select("doc_id", F.lit(True).alias("whole"), digest(F.col("text")).alias("digest"))
    parts = texts.where(F.lower("text").rlike(MARKER)).select("doc_id", F.explode(F.array_distinct(F.concat(F.split("text", "\n"), F.split("text", SENTENCE_END)))).alias("part"))
    paragraphs = texts.where(F.lower("text").rlike(MARKER)).select("doc_id", F.split("text", PARAGRAPH_END).alias("p"))
    # runs that begin with a paragraph with a marker word, or with the one before it
    near = F.filter(F.sequence(F.lit(1), F.size("p")), lambda i: F.lower(F.array_join(F.slice("p", i, F.lit(2)), "\n")).rlike(MARKER))
    starts = paragraphs.select("doc_id", F.explode(F.transform(near, lambda i: F.slice("p", i, F.lit(RUN)))).alias("p"))
    runs = starts.select("doc_id", F.explode(F.transform(F.sequence(F.lit(1), F.size("p")), lambda n: F.array_join(F.slice("p", F.lit(1), n), "\n\n"))).alias("part"))
    parts = parts.unionByName(runs).where(F.lower("part").rlike(MARKER)).select("doc_id", F.lit(False).alias("whole"), digest(F.col("part")).alias("digest"))
    found = whole.unionByName(parts).join(F.broadcast(known), "digest", "left")
    return found.groupBy("doc_id").agg(
        F.min(F.when(F.col("whole"), F.col("digest"))).alias("text_digest"),
        F.min(F.when(F.col("whole"), F.col("license_id"))).alias("license"),
        F.array_join(F.array_sort(F.collect_set(F.when(~F.col("whole"), F.col("license_id")))), ",").alias("notices"),
    )
