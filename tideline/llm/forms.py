"""One consistent form for text (problem 8).

Two forms are built from the same steps, each once per distinct value of a batch:

* ``normal_form``: compatibility composition (NFKC), full case folding, every kind of space mapped to U+0020,
  default-ignorable characters removed. The form for matching.
* ``appearance``: keeps all that a reader sees. Full-width, half-width and ligature forms are replaced, marks composed,
  spaces mapped, default-ignorable characters removed and look-alike letters of Greek and Cyrillic replaced by the Latin
  letter, or of Cyrillic by the Greek one. Letter case, line breaks, digits, superscripts and real accents stay.

Null stays null; an empty text stays empty. Both forms are idempotent.
"""

from __future__ import annotations

import hashlib
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.runtime import written

# Code points of Unicode's Default_Ignorable_Code_Point property (first, last), and U+FFF9..U+FFFB.
IGNORABLE = (
    (0x00AD, 0x00AD), (0x034F, 0x034F), (0x061C, 0x061C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F),
    (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF),
    (0xFFA0, 0xFFA0), (0xFFF0, 0xFFFB), (0x1BCA0, 0x1BCA3), (0x1D173, 0x1D17A), (0xE0000, 0xE0FFF),
)

# Fixed values, after Unicode's table of confusable characters, of one case each: letters of Greek and Cyrillic that look like a
# Latin letter, each followed by that letter; then letters of Cyrillic that look like a Greek one and no Latin one.
LOOK_ALIKE = {
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P",
    "Τ": "T", "Υ": "Y", "Χ": "X", "α": "a", "ι": "i", "ν": "v", "ο": "o", "ρ": "p", "υ": "u", "ϲ": "c", "ϳ": "j",
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P",
    "С": "C", "Т": "T", "У": "Y", "Ү": "Y", "Х": "X", "Ԛ": "Q", "Ԝ": "W", "Ԍ": "G", "а": "a", "е": "e", "ѕ": "s",
    "і": "i", "ј": "j", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "ѵ": "v", "ӏ": "l", "Ӏ": "I", "Ϲ": "C", "Ϳ": "J", "Ϻ": "M", "Ϝ": "F", "Ѵ": "V", "Ӕ": "Æ", "ӕ": "æ", "Ә": "Ə", "ә": "ə",
    "Г": "Γ", "П": "Π", "Ф": "Φ", "Ѱ": "Ψ", "Л": "Λ", "Ѳ": "Θ", "к": "κ", "ф": "φ", "ѱ": "ψ",
}

REPLACED_TAGS = ("<wide>", "<narrow>", "<noBreak>")


@lru_cache(1)
def _removed() -> dict[int, None]:
    return {c: None for first, last in IGNORABLE for c in range(first, last + 1)}


@lru_cache(1)
def _spaces() -> dict[int, str]:
    return {c: " " for c in range(0x3001) if unicodedata.category(chr(c)) == "Zs"} | {0x09: " "}


@lru_cache(1)
def _shapes() -> dict[int, str]:
    """Full-width, half-width and ligature characters with what they stand for, read from the Unicode database."""
    out: dict[int, str] = {}
    for c in range(0x80, sys.maxunicode + 1):
        what = unicodedata.decomposition(chr(c))
        if what.startswith(REPLACED_TAGS) or what.startswith("<compat>") and " LIGATURE " in f" {unicodedata.name(chr(c), '')} ":
            out[c] = unicodedata.normalize("NFKC", chr(c))
    return out


@lru_cache(1)
def _first_pass() -> dict[int, str | None]:
    return _shapes() | _spaces() | _removed()


@lru_cache(1)
def _letters() -> dict[int, str]:
    return {ord(k): v for k, v in LOOK_ALIKE.items()}


def appearance_of(text: str) -> str:
    if text.isascii():
        return text.replace("\t", " ")
    plain = text.translate(_first_pass())
    if plain.isascii():
        return plain
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", plain).translate(_letters()))


def normal_form_of(text: str) -> str:
    if text.isascii():
        return text.replace("\t", " ").casefold()
    out = unicodedata.normalize("NFKC", text.translate(_removed())).casefold().translate(_spaces() | _removed())
    return unicodedata.normalize("NFKC", out)


def _by_value(texts: pd.Series, form) -> pd.Series:
    known = {t: form(t) for t in texts.dropna().unique()}
    return pd.Series([known.get(t) for t in texts], dtype=object)


@F.pandas_udf(T.StringType())
def appearance(texts: pd.Series) -> pd.Series:
    return _by_value(texts, appearance_of)


@F.pandas_udf(T.StringType())
def normal_form(texts: pd.Series) -> pd.Series:
    return _by_value(texts, normal_form_of)


def with_forms(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``normal_form`` and ``appearance`` of ``text``; columns of these names are replaced."""
    return docs.withColumns({"normal_form": normal_form(F.col(text)), "appearance": appearance(F.col(text))})


def _digest(text: str) -> bytes:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def digests(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, form, string): 128-bit digests of a text's appearance and of the text, for texts that show something. Both are
    taken in one pass, so that only digests leave the task that read the text."""

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            both = {}
            for t in pdf.t.unique():
                form = appearance_of(t)
                both[t] = (_digest(form), _digest(t)) if form.strip() else (None, None)
            pairs = [both[t] for t in pdf.t]
            yield pd.DataFrame({"doc_id": pdf.doc_id, "form": [p[0] for p in pairs], "string": [p[1] for p in pairs]})

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("t")).where("doc_id is not null and t is not null")
    return rows.mapInPandas(digest, "doc_id long, form binary, string binary").where("form is not null")


def look_alikes(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Pairs (``doc_id_a < doc_id_b``) whose texts differ as strings but have one appearance.

    Texts are grouped by a digest of their appearance. Only appearances with several different strings go on (``min != max`` of
    the string digests, pre-aggregated). Their different strings are paired first, copies once, and only pairs of strings then
    meet the documents of either: a text with a million copies and one twin costs a million rows, its pairs. Null texts, empty
    texts and texts that show nothing give no pair; a repeated (id, text) row counts once.
    """
    rows = written(digests(docs, id_col, text))
    several = rows.groupBy("form").agg(F.min("string").alias("lo"), F.max("string").alias("hi")).where("lo != hi").select("form")
    members = written(rows.join(several, "form", "left_semi").distinct())
    strings = members.select("form", F.col("string").alias("a")).distinct()
    pairs = strings.join(strings.select("form", F.col("a").alias("b")), "form").where("a < b").select("a", "b")
    one = members.select(F.col("string").alias("a"), F.col("doc_id").alias("x"))
    other = members.select(F.col("string").alias("b"), F.col("doc_id").alias("y"))
    return pairs.join(one, "a").join(other, "b").where("x != y").select(F.least("x", "y").alias("doc_id_a"), F.greatest("x", "y").alias("doc_id_b")).distinct()


def form_classes(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: the class of its appearance (its smallest id), how many documents and strings the class has.

    Counts come from a pre-aggregated group per appearance; no list of members is built. A text that is null or shows nothing
    is a class of its own. A repeated row counts once.
    """
    rows = written(digests(docs, id_col, text).distinct())
    per_string = rows.groupBy("form", "string").agg(F.min("doc_id").alias("m"), F.count("*").alias("n"))
    classes = per_string.groupBy("form").agg(F.min("m").alias("class_id"), F.sum("n").alias("documents"), F.count("*").alias("strings"))
    # Classes of one document are left out of the join, so that what it sends follows the copies, not the corpus.
    found = rows.join(classes.where("documents > 1"), "form").select("doc_id", "class_id", "documents", "strings")
    out = docs.select(F.col(id_col).alias("doc_id")).where("doc_id is not null").distinct().join(found, "doc_id", "left")
    one = F.lit(1).cast("long")
    return out.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("documents", one).alias("documents"), F.coalesce("strings", one).alias("strings"))
