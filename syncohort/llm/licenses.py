"""Licence scans: canonical digests of whole texts and lines, joined to known digests.

Canonical means: A-Z lower-cased, lines that only state a copyright left out,
punctuation and white space reduced to single blanks, equivalent spellings made one.
Two texts with the same canonical form have the same digest; nothing is compared pair
by pair.
"""

from __future__ import annotations

import hashlib
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Known texts, fixed values: short notices and complete licences.
KNOWN = {
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "MIT": "Released under the MIT License.",
    "MIT-text": """Permission is hereby granted, free of charge, to any person obtaining a copy of
this software and associated documentation files (the "Software"), to deal in the Software without
restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute,
sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished
to do so, subject to the following conditions: The above copyright notice and this permission notice
shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS
IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT,
TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS
IN THE SOFTWARE.""",
    "ISC-text": """Permission to use, copy, modify, and/or distribute this software for any purpose
with or without fee is hereby granted, provided that the above copyright notice and this permission
notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES
WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO
EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY
DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT,
NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE.""",
}


def _standard() -> dict[str, str]:
    """Whole texts of `license_texts`, and the forms in which their files occur.

    -terms ends with the terms, without the advice on how to apply them; -titled has
    the title line that other copies lack, -untitled lacks it.
    """
    folder = Path(__file__).with_name("license_texts")
    texts = {f"{p.stem}-text": p.read_text("utf-8") for p in sorted(folder.glob("*.txt"))}
    title, _, bsd = texts["BSD-3-Clause-text"].partition("\n")
    third, after = bsd.index("3. Neither"), bsd.index("THIS SOFTWARE IS PROVIDED BY")
    bsd2 = bsd[:third] + bsd[after:]
    out = {"BSD-3-Clause-text-untitled": bsd, "BSD-2-Clause-text-untitled": bsd2}
    # Bullets instead of numbers, as many copies have them.
    for number, body in (("3", bsd), ("2", bsd2)):
        bullets = body.replace("\n1. ", "\n* ").replace("\n2. ", "\n* ").replace("\n3. ", "\n* ")
        out[f"BSD-{number}-Clause-text-bullets"] = f"BSD {number}-Clause License\n{bullets}"
        out[f"BSD-{number}-Clause-text-bullets-untitled"] = bullets
    out["BSD-2-Clause-text"] = f"BSD 2-Clause License\n{bsd2}"
    for name, body in (("MIT", KNOWN["MIT-text"]), ("ISC", KNOWN["ISC-text"])):
        out[f"{name}-text-titled"] = f"{name} License\n\n{body}"
        out[f"{name}-text-titled-the"] = f"The {name} License\n\n{body}"
        out[f"{name}-text-titled-twice"] = f"The {name} License ({name})\n\n{body}"
    for name, text in texts.items():
        terms, end, _ = text.partition("END OF TERMS AND CONDITIONS")
        if end:
            out[f"{name}-terms"] = terms + end
    return texts | out


KNOWN |= _standard()

#: Spellings that count as the same, as whole words after lower-casing.
SPELLINGS = {
    "licence": "license", "licences": "licenses", "licenced": "licensed", "licencing": "licensing",
    "sublicence": "sublicense", "merchantibility": "merchantability", "noninfringment": "noninfringement",
    "organisation": "organization", "favour": "favor", "fulfil": "fulfill", "whilst": "while",
    "acknowledgement": "acknowledgment", "programme": "program", "v2": "version 2", "v3": "version 3",
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A line that states a copyright, also in a comment, on lower-cased text between line breaks.
COPYRIGHT = (
    r"\n[\t #/*;%!<>-]*(copyright[\t ]+(\(c\)|©|by |[12][0-9][0-9][0-9])|\(c\)|©|all rights reserved)[^\n]*"
)
_NOTHING = hashlib.sha256(b" ").hexdigest()
#: One or more lines without letters and digits (not lower-cased), also of comment signs.
BLANK_LINES = r"\n[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]*\n"
SIGNS = r"[\x00-\x2f\x3a-\x60\x7b-\x7f]+"


def canonical(text: Column) -> Column:
    """The canonical form, with a blank at either end; a null stays null."""
    low = F.translate(text, _UPPER, _LOWER)
    kept = F.regexp_replace(F.concat(F.lit("\n"), low), COPYRIGHT, "")
    out = F.concat(F.lit(" "), F.regexp_replace(kept, SIGNS, " "), F.lit(" "))
    # Blanks are doubled first, so that neighbouring words are replaced one by one.
    out = F.replace(out, F.lit(" "), F.lit("  "))
    for other, usual in SPELLINGS.items():
        out = F.replace(out, F.lit(f" {other} "), F.lit(f" {usual} "))
    return F.regexp_replace(out, " +", " ")


def digest(text: Column) -> Column:
    """SHA-256 of the canonical form; null where nothing is left of it."""
    return F.nullif(F.sha2(canonical(text), 256), F.lit(_NOTHING))


def known_texts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(KNOWN.items()), "license_id string, text string")


def license_scan(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(doc_id, digest, license_id, n_notices, notices) for every row of `docs`.

    license_id is the known text that the whole text equals canonically, n_notices and
    notices (sorted, comma-joined ids) those that a whole line or a paragraph, wrapped over
    lines, equals. Null and empty
    texts, and texts of copyright lines or punctuation only, have a null digest and
    match nothing; an empty `known` matches nothing. Of known texts with one digest the
    lowest id counts. Rows that repeat a doc_id, or have a null one, are looked up one
    by one. Other columns are ignored.
    """
    if known is None:
        known = known_texts(docs.sparkSession)
    listed = (
        known.select(digest(F.col("text")).alias("digest"), "license_id")
        .dropna()
        .groupBy("digest")
        .agg(F.min("license_id").alias("license_id"))
    )
    texts = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64("text").alias("version"),
        F.col("text").cast("string").alias("text"),
    )
    paragraphs = F.filter(F.split("text", BLANK_LINES), lambda p: p.contains("\n"))
    parts = F.array_distinct(F.concat(F.split("text", "\n"), paragraphs))
    lines = texts.select("doc_id", "version", F.explode(parts).alias("line"))
    notices = (
        # Never null, so that no filter works the form out a second time.
        lines.select(
            "doc_id",
            "version",
            F.coalesce(F.sha2(canonical(F.col("line")), 256), F.lit("")).alias("digest"),
        )
        .join(listed, "digest")
        .groupBy(F.col("doc_id").alias("_id"), F.col("version").alias("_version"))
        .agg(F.sort_array(F.collect_set("license_id")).alias("found"))
    )
    whole = texts.select("doc_id", "version", digest(F.col("text")).alias("digest"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("version") == F.col("_version"))
    found = F.coalesce("found", F.array().cast("array<string>"))
    return (
        whole.join(listed, "digest", "left")
        .join(notices, same, "left")
        .select(
            "doc_id", "digest", "license_id",
            F.size(found).cast("long").alias("n_notices"),
            F.array_join(found, ",").alias("notices"),
        )
    )
