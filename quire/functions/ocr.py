"""Cleaning of OCR output, over columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import BLOCK_MARKUP, NOT_AFTER_WORD, NOT_BEFORE_WORD, PARAGRAPHS, SENTENCE_ENDS, SPACE, WS, is_blank, line_ends, strip, without_stamp

# Confusions of handwritten and technical notes, applied in this order.
CORRECTIONS = [
    (r"\b[aA]u[tT]umater\b|\b[aA]omata\b", "Automata"),
    (r"\bsholy\b|\bshdu\b", "study"),
    (r"\bcompehng\b|\bcompuerg\b|\bcomputey\b", "computing"),
    (r"\bmachirey\b|\bmeehire\b", "machines"),
    (r"\b&his\b", "This"),
    (r"\b[cC]onswet\b", "Construct"),
    (r"\b[hH]ranshm\b|\b[hH]ansihon\b|\btransihon\b", "transition"),
    (r"\b[pP]enote\b", "denote"),
    (r"\bbinal\b", "final"),
    (r"\b[sS]ravhng\b|\bstarhng\b|\b[sS]torbing\b", "starting"),
    (r"\b[sS]ral\b|\bsrate\b", "state"),
    (r"\b[sS]tates?\b", "states"),
    (r"\balphabe[t]?\b|\balpha\s+beh\b", "alphabet"),
    (r"\blangoage\b|\blmgog\b|\bbrgugl\b", "language"),
    (r"\bacapts\b|\bacoeptd\b", "accepts"),
    (r"\bsubseh\b|\b[sS]ubseb\b", "subset"),
    (r"\bhnite\b", "finite"),
    (r"\binhnite\b|\binbnite\b|\bihhhile\b|\bihsnihe\b", "infinite"),
    (r"\binleger\b|\bintgos\b", "integers"),
    (r"\bposihive\b", "positive"),
    (r"\b[sS]ewahial\b|\b[sS]euahial\b", "Sequential"),
    (r"\b[pP]ara\s+lle\b", "Parallel"),
    (r"\bedgey\b", "edges"),
    (r"\b[iI]nlermeliale\b|\b[iI]nermediale\b", "intermediate"),
    (r"\b[eE]liminabon\b", "elimination"),
    (r"\b[rR]emonigs\b|\bemongs\b", "removing"),
    (r"\baytey\b|\bafey\b", "after"),
    (r"\bfinalstaty\b", "final states"),
    (r"\b[lL]stale\s+vodey\b|\bvodey\b", "state nodes"),
    (r"\bo[tT]er\s+all\s+fen\b|\boTer\s+all\s+fen\b", "other than"),
    (r"\b[lL]-[aA]cample\b|\bbarampleg\b|\beamplein\b", "Example:"),
    (r"\bmou\s+rmow\b", "remove"),
    (r"\bpahm\b", "path"),
    (r"\bSRM\b", ""),
]

# What ends a line for good, what stands by itself, and closing marks.
#: What ends a line for good, besides the ends of sentences.
LINE_ENDS = SENTENCE_ENDS + ":;"
#: A line that is a heading or bullet of its own.
OWN_LINE = rf"^(?:[•\-*]|\p{{Nd}}+(?:\.\p{{Nd}}+)*{SPACE}+|#+|[A-Z\x{{0900}}-\x{{0D7F}}\x{{0600}}-\x{{06FF}}]{{2,}}:)"
CLOSING = r"[\"'”’)\]}»]"


def unicode_bounds(pattern: str) -> str:
    """A pattern whose \\b and \\s mean Unicode words and white space. \\b stands beside word characters in it, but
    where it comes before a sign it asks for a word character in front."""
    out, parts = "", re.split(r"(\\b)", pattern)
    for i, p in enumerate(parts):
        if p != r"\b":
            out += p.replace(r"\s", SPACE)
            continue
        before, after = parts[i - 1] if i else "", parts[i + 1] if i + 1 < len(parts) else ""
        if before and before != "|" and not before.endswith("|"):
            out += NOT_BEFORE_WORD
        else:
            out += NOT_AFTER_WORD if re.match(r"[\w\[(]", after) else r"(?<=[\p{L}\p{N}_])"
    return out


def corrected(c: Column, corrections: list[tuple[str, str]] = CORRECTIONS) -> Column:
    """Each pattern replaced, in order."""
    for pattern, new in corrections:
        c = F.regexp_replace(c, unicode_bounds(pattern), new)
    return c


def is_readable_line(c: Column) -> Column:
    line = strip(c)
    letters = F.regexp_count(line, F.lit(r"\p{L}"))
    long_words = F.regexp_count(line, F.lit(NOT_AFTER_WORD + r"[\p{L}\p{Nl}\p{No}]{3,}" + NOT_BEFORE_WORD))
    return (F.length(line) >= 2) & (letters >= 2) & ~(line.rlike(r"[+*=/]") & (long_words == 0) & (letters < 6))


def sanitize(c: Column, corrections: list[tuple[str, str]] = CORRECTIONS) -> Column:
    """Raw OCR output as lines of readable text."""
    t = F.regexp_replace(without_stamp(c), NOT_AFTER_WORD + r"[A-Z]\p{Nd}+[+*][A-Za-z0-9+*]*(?:(?<=[A-Za-z0-9])(?![\p{L}\p{N}_])|(?<=[+*])(?=[\p{L}\p{N}_]))", " ")
    t = F.regexp_replace(corrected(t, corrections), r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", " ")
    collapsed = lambda x: strip(F.regexp_replace(x, r"[ \t]+", " "))
    lines = F.filter(F.transform(F.split(t, r"\r\n|[\n\r\x{85}\x{2028}\x{2029}]"), collapsed), is_readable_line)
    alone = lambda x: collapsed(F.regexp_replace(x, f"(?<![^{WS}])[b-hj-zB-HJ-Z](?![^{WS}])", " "))
    kept = F.filter(F.transform(lines, alone), lambda x: F.length(x) >= 2)
    return F.when(is_blank(c), "").otherwise(strip(F.array_join(kept, "\n")))


def confident_lines(c: Column, least: float = 0.55) -> Column:
    """Texts of array<struct<text, score>> that were read with enough confidence."""
    good = F.filter(c, lambda x: x["text"].isNotNull() & (x["score"] >= least) & ~is_blank(x["text"]))
    return F.transform(good, lambda x: x["text"])


def reflow(c: Column) -> Column:
    """Lines of OCR text joined to sentences, block by block.

    A line stands by itself if the line before ended a sentence or it looks like a heading or bullet. Whether a line
    ended depends on its own tail only, so the glue between neighbours is known for all at once.
    """
    t = line_ends(F.regexp_replace(without_stamp(c), BLOCK_MARKUP, ""))
    ends = F.lit(f"[{LINE_ENDS}]$|[{LINE_ENDS}]{SPACE}*{CLOSING}$")

    def block(b: Column) -> Column:
        lines = F.filter(F.transform(F.split(b, "\n"), strip), lambda x: x != "")
        glued = F.transform(lines, lambda x, i: F.when(i == 0, x).otherwise(F.concat(F.when(F.regexp(F.get(lines, i - 1), ends) | x.rlike(OWN_LINE), F.lit("\n")).otherwise(F.lit(" ")), x)))
        return F.array_join(glued, "")

    return F.when(is_blank(c), "").otherwise(F.array_join(F.filter(F.transform(F.split(t, PARAGRAPHS), block), lambda b: b != ""), "\n\n"))
