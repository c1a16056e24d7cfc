"""Text functions over columns.

Patterns spell out Unicode white space, letters and numbers as classes that mean the same in every regular expression
engine that reads them; shorthands such as \\w, \\s and \\b don't.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's str.split() has it, inside a class.
WS = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: A class of many ranges is tried range by range, so the printable ASCII characters, most of any text, are told first.
SPACE, NON_SPACE = f"[[^!-~]&&[{WS}]]", f"[!-~[^{WS}]]"
#: The same characters as a list.
BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: A word character, and a letter of headings.
WORD = r"[\p{L}\p{N}_]"
LETTER = r"[\p{L}\p{Nl}\p{No}]"
NOT_AFTER_WORD, NOT_BEFORE_WORD = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"

# Patterns that decide results.
STAMP = r"(?i)scanned[\t-\r\x1c-\x20\x{85}\x{a0}]+by[\t-\r\x1c-\x20\x{85}\x{a0}]+camscanner[^\n]*"
BLOCK_MARKUP = r"</?(?:div|span|p)[^>]*>"
MARKUP, CLASS_ATTRIBUTE = r"</?[a-zA-Z][^>]*>", rf"class{SPACE}*={SPACE}*['\"][^'\"]*['\"]"
PARAGRAPHS = rf"\n{SPACE}*\n+"
SENTENCE_ENDS = ".!?।॥؟۔。！？"
MAJOR = rf"(?i)^(?:UNIT{SPACE}+[IVXLCDM]+|CHAPTER{SPACE}+\p{{Nd}}+|SECTION{SPACE}+\p{{Nd}}+)"
NUMBERED = r"\p{Nd}+(?:\.\p{Nd}+)*"
UNIT_SECTION = rf"(?:^|\n)(?:#+{SPACE}*|(?:{NUMBERED}{SPACE}+)|(?:UNIT{SPACE}+[IVXLCDM]+)){LETTER}[^\n:]{{2,60}}(?::|\n|$)"
PDF_SECTION = rf"(?:^|\n)({NUMBERED}{SPACE}+{LETTER}[^\n:]{{2,50}})(?::|\n|$)"
TXT_SECTION = rf"(?:^|\n)(?:#+{SPACE}*|Section{SPACE}+)({WORD}[^\n]{{2,40}})"
DOCX_HEADING = rf"(?i)^(?:{NUMBERED}{SPACE}+{LETTER}.{{1,50}}|UNIT{SPACE}+[IVXLCDM]+.*|CHAPTER{SPACE}+\p{{Nd}}+.*|SECTION{SPACE}+\p{{Nd}}+.*)$"


def let(c: Column, body: Callable[[Column], Column]) -> Column:
    """body of c's value. What body gets is a variable, so c is evaluated once however often body names it."""
    return F.element_at(F.transform(F.array(c), body), 1)


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def strip_chars(c: Column, inside: str) -> Column:
    """Without the characters of a class at either end."""
    return F.regexp_replace(c, rf"\A[{inside}]+|[{inside}]+\z", "")


def is_blank(c: Column) -> Column:
    return F.coalesce(~c.rlike(NON_SPACE), F.lit(True))


def words(c: Column) -> Column:
    return F.filter(F.split(c, f"{SPACE}+"), lambda w: w != "")


def word_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(f"{NON_SPACE}+"))


def without_stamp(c: Column) -> Column:
    return F.regexp_replace(c, STAMP, "")


def line_ends(c: Column) -> Column:
    return F.regexp_replace(c, r"\r\n?", "\n")


def normalize_native(c: Column) -> Column:
    """Text of a native page: paragraphs parted by one blank line, lines stripped, blanks collapsed."""
    t = F.regexp_replace(line_ends(without_stamp(c)), BLOCK_MARKUP, "")
    line = lambda x: strip(F.regexp_replace(x, r"[ \t]+", " "))
    para = lambda p: F.array_join(F.filter(F.transform(F.split(strip(p), "\n"), line), lambda x: x != ""), "\n")
    return F.array_join(F.filter(F.transform(F.split(t, PARAGRAPHS), para), lambda p: p != ""), "\n\n")


def paragraphs(c: Column) -> Column:
    """Stripped paragraphs that hold a letter or number."""
    return F.filter(F.transform(F.split(c, PARAGRAPHS), strip), lambda p: p.rlike(r"[\p{L}\p{N}]"))


def sentences(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, f"(?<=[{SENTENCE_ENDS}]){SPACE}+"), strip), lambda s: s != "")


def word_windows(c: Column, size: int | Column) -> Column:
    """Consecutive runs of size words, joined by blanks. A text without words has none."""
    size = F.lit(size) if isinstance(size, int) else size

    def runs(w: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(w) / size).cast("int") - 1, F.lit(0))), lambda i: i * size < F.size(w))
        return F.transform(starts, lambda i: F.array_join(F.slice(w, i * size + 1, size), " "))

    return let(words(c), runs)


def is_major_heading(c: Column) -> Column:
    return F.substring(c, 1, 40).rlike(MAJOR)


def unit_section(paragraph: Column, page_section: Column) -> Column:
    """The heading inside a paragraph, without its marks, or the page's section."""
    found = strip(strip_chars(F.regexp_extract(paragraph, UNIT_SECTION, 0), r"# \n:"))
    return F.when(F.regexp_extract(paragraph, UNIT_SECTION, 0) != "", found).otherwise(page_section)


def pdf_section(c: Column) -> Column:
    found = strip(F.regexp_extract(c, PDF_SECTION, 1))
    return F.when(found != "", found)


def txt_section(c: Column) -> Column:
    found = F.regexp_extract(c, TXT_SECTION, 1)
    return F.when(found != "", strip(found))


def is_docx_heading(text: Column, heading_style: Column) -> Column:
    return heading_style | (text.rlike(DOCX_HEADING) & (word_count(text) <= 12))


def native_quality(c: Column) -> Column:
    """struct(usable, clean): whether a page's own text can do without OCR."""
    clean = F.when(is_blank(c), F.lit("")).otherwise(strip(without_stamp(c)))
    letters = F.regexp_count(clean, F.lit(r"\p{L}"))
    long_words = F.regexp_count(clean, F.lit(NOT_AFTER_WORD + r"[\p{L}\p{N}]{2,}" + NOT_BEFORE_WORD))
    usable = (clean != "") & (((letters >= 10) & (letters / F.length(clean) >= 0.3)) | ((long_words >= 2) & (letters >= 8)))
    return F.struct(F.coalesce(usable, F.lit(False)).alias("usable"), clean.alias("clean"))


def without_markup(c: Column) -> Column:
    """A chunk's text without tags and class attributes."""
    return strip(F.regexp_replace(F.regexp_replace(c, MARKUP, ""), CLASS_ATTRIBUTE, ""))


def without_block_markup(c: Column) -> Column:
    return strip(F.regexp_replace(c, BLOCK_MARKUP, ""))


def table_text(rows: Column) -> Column:
    """An array of rows of cells as lines."""
    return F.array_join(F.transform(rows, lambda r: F.array_join(F.transform(r, strip), " | ")), "\n")


def preview(c: Column, limit: int = 100) -> Column:
    flat = strip(F.regexp_replace(F.coalesce(c, F.lit("")), f"{SPACE}+", " "))
    return F.when(flat == "", "<no readable text>").when(F.length(flat) > limit, F.concat(F.substring(flat, 1, limit - 3), F.lit("..."))).otherwise(flat)


def snippet(c: Column, limit: int = 300) -> Column:
    flat = F.regexp_replace(strip(c), "\n", " ")
    return F.when(F.length(flat) > limit, F.concat(F.substring(flat, 1, limit), F.lit("..."))).otherwise(flat)


def embedding_text(c: Column) -> Column:
    return F.when(is_blank(c), " ").otherwise(strip(c))


def strategy_label(c: Column) -> Column:
    return F.when(c == "llama3.2_semantic", "Semantic (advised)").when(F.contains(c, F.lit("fallback")), "Deterministic (fallback)").otherwise("Deterministic")


def thousands(c: Column) -> Column:
    return F.format_number(c, 0)
