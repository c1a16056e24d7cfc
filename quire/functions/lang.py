"""Language of texts, over columns: scripts by their characters, other languages through a classifier.

A classifier is a function of a prose column that gives struct(lang, prob). The one here counts function words; any
other, such as a pandas UDF around a model, can be passed in its place.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import is_blank, let, words

Classifier = Callable[[Column], Column]

# Names of languages, and scripts in the order in which they are tried.
NAMES = {
    "en": "English", "hi": "Hindi", "ta": "Tamil", "te": "Telugu", "bn": "Bengali", "mr": "Marathi", "gu": "Gujarati",
    "kn": "Kannada", "ml": "Malayalam", "pa": "Punjabi", "ur": "Urdu", "fr": "French", "de": "German", "es": "Spanish",
    "zh-cn": "Chinese", "ar": "Arabic", "ru": "Russian", "ja": "Japanese",
}
SCRIPTS = {
    "hi": r"[\x{0900}-\x{097F}]",
    "ta": r"[\x{0B80}-\x{0BFF}]",
    "te": r"[\x{0C00}-\x{0C7F}]",
    "bn": r"[\x{0980}-\x{09FF}]",
    "kn": r"[\x{0C80}-\x{0CFF}]",
    "ml": r"[\x{0D00}-\x{0D7F}]",
    "gu": r"[\x{0A80}-\x{0AFF}]",
    "pa": r"[\x{0A00}-\x{0A7F}]",
    "ur": r"[\x{0600}-\x{06FF}]",
}
#: What is no prose: digits, brackets, signs and some Greek letters of formulas.
NOT_PROSE = r"[\p{Nd}()\[\]{}=+\-*/<>→⇒δεΦΣ_:;,.?!@#$%^&|\\]+"
#: The same, with a quick way out for letters and blanks; and a character of any of the scripts.
_NOT_PROSE = f"[[^a-zA-Z ]&&{NOT_PROSE[:-1]}]+"
_ANY_SCRIPT = f"[[^\\x00-\\x7F]&&[{''.join(SCRIPTS.values())}]]"

#: Function words that the classifier counts. Words that two of the languages share say nothing and aren't here.
FUNCTION_WORDS = {
    "en": ("the", "of", "and", "to", "is", "that", "for", "it", "with", "was", "by", "this"),
    "de": ("der", "die", "und", "das", "von", "zu", "mit", "ist", "nicht", "ein", "für", "auf"),
    "fr": ("le", "les", "des", "et", "est", "dans", "pour", "une", "sur", "pas", "du", "avec"),
    "es": ("el", "los", "las", "y", "que", "por", "una", "con", "para", "del", "como", "su"),
}


def language_name(c: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in NAMES.items() for x in pair])
    return F.coalesce(F.try_element_at(names, F.lower(c)), F.upper(c))


def script(c: Column, least: int = 12) -> Column:
    """The first script, in order, with enough characters, or null. Texts without a character of any aren't counted."""
    return F.when((F.lit(least) <= 0) | c.rlike(_ANY_SCRIPT), F.coalesce(*[F.when(F.regexp_count(c, F.lit(p)) >= least, lang) for lang, p in SCRIPTS.items()]))


def prose(c: Column) -> Column:
    """Words of two characters or more, without formulas."""
    return F.array_join(F.filter(words(F.regexp_replace(c, _NOT_PROSE, " ")), lambda w: F.length(w) >= 2), " ")


def by_function_words(c: Column) -> Column:
    """struct(lang, prob): the language with most function words, the first of equal ones, and its share of them. Null
    if there are none."""

    def scored(low: Column) -> Column:
        # With a blank before the text every word has one, which finds places faster than looking back from each.
        counts = [F.regexp_count(low, F.lit(rf" (?:{'|'.join(w)})(?![^ ])")) for w in FUNCTION_WORDS.values()]
        return F.array(*[F.struct(n.alias("n"), F.lit(-i).alias("i"), F.lit(lang).alias("lang")) for i, (lang, n) in enumerate(zip(FUNCTION_WORDS, counts, strict=True))])

    def best(each: Column) -> Column:
        total = F.aggregate(each, F.lit(0), lambda acc, x: acc + x["n"])
        return let(F.array_max(each), lambda m: F.when(m["n"] > 0, F.struct(m["lang"].alias("lang"), (m["n"] / total).alias("prob"))))

    return let(let(F.concat(F.lit(" "), F.lower(c)), scored), best)


def block_language(c: Column, default: str | Column = "en", least_chars: int = 50, confidence: float = 0.85, classify: Classifier = by_function_words) -> Column:
    """struct(lang, prob) of a block: by script, else by the classifier on enough prose; a weak guess keeps the default
    and its own probability."""
    default = F.lit(default) if isinstance(default, str) else default
    made = lambda lang, p: F.struct(lang.alias("lang"), p.cast("double").alias("prob"))
    judged = lambda best: F.when(best["lang"].isNull(), made(default, F.lit(0.0))).when(best["prob"] >= confidence, made(best["lang"], best["prob"])).otherwise(made(default, best["prob"]))
    guessed = lambda text: F.when(F.length(text) < least_chars, made(default, F.lit(0.0))).otherwise(let(classify(text), judged))
    known = lambda found: F.when(found.isNotNull(), made(found, F.lit(1.0))).otherwise(let(prose(c), guessed))
    return F.when(is_blank(c), made(default, F.lit(0.0))).otherwise(let(script(c), known))


def language(c: Column, default: str = "en", classify: Classifier = by_function_words) -> Column:
    return block_language(c, default, classify=classify)["lang"]


def chunk_language(c: Column, default: Column, allowed: Column, classify: Classifier = by_function_words) -> Column:
    """A chunk's language: its script, else a sure guess that its document has too (or that anything goes, where
    allowed is null), else the document's."""
    judged = lambda best: F.when((best["prob"] >= 0.85) & (allowed.isNull() | F.array_contains(allowed, best["lang"])), best["lang"]).otherwise(default)
    guessed = lambda text: F.when(F.length(text) < 60, default).otherwise(let(classify(text), judged))
    return let(script(c, 10), lambda found: F.when(found.isNotNull(), found).otherwise(let(prose(c), guessed)))


def shown_label(breakdown: Column) -> Column:
    """What a page about a document shows for a breakdown array<struct<lang, pct>>: one name, or all with shares.
    Unlike the summary it shows all of several languages however large the first one's share is."""
    name = lambda x: F.concat(language_name(x["lang"]), F.lit(" ("), x["lang"], F.lit(")"))
    share = lambda x: F.concat(name(x), F.lit(" - "), F.format_string("%.0f%%", F.bround(x["pct"], 0)))
    return F.when(F.size(breakdown) > 1, F.array_join(F.transform(breakdown, share), ", ")).otherwise(name(breakdown[0]))
