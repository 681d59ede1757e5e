"""Text functions as columns: normal forms, tokens, folding, structural patterns."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

#: Unicode white space, for Java and RE2 alike.
WHITE = "[\\x{9}-\\x{d}\\x{1c}-\\x{20}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once however often the body's lambdas name it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def compose(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def nfc(text: Column) -> Column:
    """Composed form. Only texts with a combining mark can change. A Python function is run on every row whatever the
    condition around it, so others go as nulls and their value never leaves the JVM."""
    marked = text.rlike("\\p{M}|[\\x{340}\\x{341}\\x{374}\\x{37e}\\x{387}\\x{212a}\\x{212b}]")
    return F.coalesce(pandas_udf(compose, "string")(F.when(marked, text)), text)


def collapse(text: Column) -> Column:
    """White space runs to one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, WHITE + "+", " "))


def normalize(text: Column) -> Column:
    return collapse(nfc(text))


# What is no letter or digit, the first that is one, and the rest: no piece is gone over twice. Java asks of classes in
# their order, and of single characters before ranges, so the frequent ones stand first.
_ALNUM, _BLANK = "abcdefghijklmnopqrstuvwxyz0123456789", "\\x09\\x0a\\x0b\\x0c\\x0d\\x1c\\x1d\\x1e\\x1f\\x20"
_PLAIN = f"[^{_BLANK}{_ALNUM}]*+[{_ALNUM}][^{_BLANK}]*+"
_PIECE = (
    f"[^[{_ALNUM}][{WHITE[1:-1]}\\p{{L}}\\p{{N}}]]*+[[{_ALNUM}][\\p{{L}}\\p{{N}}]]"
    f"[[\\x21-\\x7e\\xa1-\\x{{167f}}][^{WHITE[1:-1]}]]*+"
)


def tokens(text: Column, segment: Callable[[Column], Column] = lambda c: c) -> Column:
    """Lower-cased pieces between white space that hold a letter or digit; segment joins the words of a language first
    (the default is a stand-in that leaves the text alone). Texts of ASCII only take a pattern of small classes."""
    low = F.lower(segment(text))
    return F.when(F.length(low) == F.octet_length(low), F.regexp_extract_all(low, F.lit(_PLAIN), F.lit(0))).otherwise(
        F.regexp_extract_all(low, F.lit(_PIECE), F.lit(0))
    )


def word_count(text: Column) -> Column:
    """Stand-in for a model's token count: pieces between white space."""
    return F.size(F.filter(F.split(text, WHITE + "+"), lambda w: w != ""))


#: Vietnamese letters by the letter without marks.
MARKED = {
    "a": "àáảãạăằắẳẵặâầấẩẫậ",
    "d": "đ",
    "e": "èéẻẽẹêềếểễệ",
    "i": "ìíỉĩị",
    "o": "òóỏõọôồốổỗộơờớởỡợ",
    "u": "ùúủũụưừứửữự",
    "y": "ỳýỷỹỵ",
}


def fold(text: Column) -> Column:
    """Lower case without Vietnamese marks, white space collapsed."""
    marked = "".join(MARKED.values())
    plain = "".join(k * len(v) for k, v in MARKED.items())
    return collapse(F.translate(F.lower(normalize(text)), marked, plain))


def query_key_text(query: Column) -> Column:
    """Normal form of a question as a cache key: lower case, white space collapsed but kept in front, end stops cut."""
    return F.rtrim(F.regexp_replace(F.lower(nfc(query)), WHITE + "+", " "), F.lit(" ?.!"))


ROMAN = "[IVXLCDM]+"
#: Ordinals of parts.
ORDINALS = "nhất|hai|ba|tư|bốn|năm|sáu|bảy|tám|chín|mười"
#: How structural lines begin.
STRUCTURE = {
    "appendix": "(?iu)^PHỤ\\s+LỤC(?![\\p{L}\\p{N}_])",
    "part": f"(?iu)^Phần\\s+(?:thứ\\s+)?({ROMAN}|\\d+|{ORDINALS})(?![\\p{{L}}\\p{{N}}_])",
    "chapter": f"(?iu)^Chương\\s+({ROMAN}|\\d+)(?![\\p{{L}}\\p{{N}}_])",
    "section": "(?iu)^Mục\\s+(\\d+[a-zđ]?)(?![\\p{L}\\p{N}_])",
    "article": "^Điều\\s+(\\d+[a-zđ]?)\\s*\\.\\s*(.*)$",
    "clause": "^(\\d+[a-zđ]?)\\s*\\.\\s+(.*)$",
    "point": "^(?:([a-zđư])\\)|-)\\s+(.*)$",
}


def kind_of_line(text: Column) -> Column:
    """Name of the first structure that a line begins, or null."""
    out = F.lit(None).cast("string")
    for name in reversed(STRUCTURE):
        out = F.when(text.rlike(STRUCTURE[name]), F.lit(name)).otherwise(out)
    return out


def is_structural(text: Column) -> Column:
    """Whether a line is a label of an appendix, part, chapter, section or article."""
    return F.coalesce(kind_of_line(text).isin("appendix", "part", "chapter", "section", "article"), F.lit(False))


def strip_markers(text: Column) -> Column:
    """Footnote markers [n] out, with the digits beside one only if they are the marker's own number."""
    out = F.regexp_replace(text, "(?<!\\d)(\\d{1,3})\\[\\1\\](?:\\1(?!\\d))?", "")
    out = F.regexp_replace(out, "\\[(\\d{1,3})\\]\\1(?!\\d)", "")
    out = F.regexp_replace(out, "\\[\\d{1,3}\\]", "")
    out = F.regexp_replace(out, "^([a-zđư]\\)|\\d{1,3}\\.)(?=\\S)", "$1 ")
    return collapse(F.regexp_replace(out, " ([,;.])", "$1"))


def number_key(number: Column) -> Column:
    """Sort key of numbers like 48a: the number, then the letters."""
    digits = F.regexp_extract(number, "^(\\d*)", 1)
    return F.struct(
        F.when(digits == "", 0).otherwise(digits.cast("int")).alias("n"),
        F.regexp_extract(number, "^\\d*(.*)$", 1).alias("suffix"),
    )


def escape_setext(markdown: Column) -> Column:
    """A blank line before each underline of dashes or equals signs that follows text."""
    return F.regexp_replace(markdown, "(?m)(?<=\\S[ \\t]{0,9})\\n(?=[-=]{3,}[ \\t]*$)", "\n\n")


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "(?<=[.;])\\s+"), lambda x: F.trim(x)), lambda s: s != "")


def clauses(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, ",\\s+"), lambda x: F.trim(x)), lambda s: s != "")
