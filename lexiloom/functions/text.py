"""Text functions as column expressions: cleaning, tokens, measures, comparison."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Ligatures and what they stand for.
LIGATURES = {"Æ": "AE", "æ": "ae", "Œ": "OE", "œ": "oe", "ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st"}
# Typographic marks and their plain forms.
MARKS = {"–": "-", "—": "--", "‘": "'", "’": "'", "“": '"', "”": '"', "…": "..."}
QUOTES = ("“”«»‘’", '""""' + "''")
#: White space as Unicode has it, for Java's and other engines' classes alike.
SPACE = r"[\s\p{Z}\x0b\x1c-\x1f\x{85}]"
# Lines that belong to an edition, not to its text.
BOILERPLATE = [r"(?:project\s+gutenberg|distributed\s+proofreaders)", r"(?:copyright|©)\s*\d{4}", r"(?:all\s+rights\s+reserved)", r"(?:isbn|issn)\s*[:=]?\s*[\d-]+"]
# Function words of the three dimensions of an arc.
ARC_WORDS = {
    "staging": "a about all an are at be been being by each few for from here in is it its many of on one several some that the their them there these they this those three to two was were what which who with".split(),
    "progression": "after again already because before during finally first last next now once second since so soon still suddenly then therefore thus until when while yet".split(),
    "tension": "although appear believe but cannot could feel however if know maybe might must need never no not nothing perhaps seem should think though understand want whether without wonder would".split(),
}
# Words without content.
STOP_WORDS = (
    "a all also am an and are as at be been being both but by can cometh could did do doth does each else every few for from goeth had has hath have he her hereby him his how i if in into is it its just may me might more most must my no nor not of on only or other our own "
    "saith same shall she should so some such than that the thee their them then therein thereby thereof these they thine this those thou thy to too unto up upon us very was we were what when where wherefore which who whom whose why will with would ye you your"
).split()


def replaced(text: Column, pairs: dict[str, str]) -> Column:
    return reduce(lambda t, p: F.replace(t, F.lit(p[0]), F.lit(p[1])), pairs.items(), text)


def _composed(form: str):
    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: unicodedata.normalize(form, t), na_action="ignore")

    return run


def _by_form(text: Column, form: str) -> Column:
    plain = F.octet_length(text) == F.length(text)  # ASCII stays as it is, in the JVM
    return F.when(plain, text).otherwise(_composed(form)(F.when(~plain, text)))


def nfc(text: Column) -> Column:
    return _by_form(text, "NFC")


def nfkc(text: Column) -> Column:
    return _by_form(text, "NFKC")


def plain_quotes(text: Column) -> Column:
    return F.translate(text, *QUOTES)


def stripped(text: Column) -> Column:
    """Without white space of any kind at its ends."""
    return F.regexp_replace(text, rf"\A{SPACE}+|{SPACE}+\z", "")


def tidy_space(text: Column) -> Column:
    """One blank between words of a line, none at its ends, at most one empty line in sequence."""
    lines = F.transform(F.split(text, "\n"), lambda line: stripped(F.regexp_replace(line, r"[ \t]+", " ")))
    return stripped(F.regexp_replace(F.array_join(lines, "\n"), r"\n{3,}", "\n\n"))


def normalised(text: Column) -> Column:
    """Composed, with plain quotes and tidy space; doing it again changes nothing."""
    return tidy_space(plain_quotes(nfc(text)))


def rejoined(text: Column) -> Column:
    """Words of any script broken by a hyphen at a line's end, whole again."""
    return F.regexp_replace(text, rf"([\p{{L}}\p{{N}}_])-\n{SPACE}*([\p{{L}}\p{{N}}_])", "$1$2")


def without_lines(text: Column, *patterns: str) -> Column:
    return F.array_join(F.filter(F.split(text, "\n"), lambda line: ~reduce(lambda a, b: a | b, [line.rlike(p) for p in patterns])), "\n")


PAGE_NUMBER = rf"^{SPACE}*\p{{Nd}}{{1,4}}{SPACE}*$"


def without_page_numbers(text: Column) -> Column:
    return without_lines(text, PAGE_NUMBER)


def without_boilerplate(text: Column) -> Column:
    return without_lines(text, *(f"(?i){p}" for p in BOILERPLATE))


def without_controls(text: Column) -> Column:
    return F.regexp_replace(text, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x{9f}]", "")


def collapsed(text: Column) -> Column:
    return stripped(F.regexp_replace(F.regexp_replace(text, r"[ \t]+", " "), r"\n{3,}", "\n\n"))


def cleaned_by_rules(text: Column) -> Column:
    """The steps of ``cleaned`` after composition."""
    steps = [without_controls, lambda t: replaced(t, LIGATURES), lambda t: replaced(t, MARKS), rejoined, without_page_numbers, without_boilerplate, collapsed]
    return reduce(lambda t, step: step(t), steps, text)


def cleaned(text: Column) -> Column:
    """Composed by compatibility, without control characters, ligatures, typographic marks, broken words, page numbers, boilerplate and needless space."""
    return cleaned_by_rules(nfkc(text))


def slug(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(name), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"[ \t\n\r]+"), lambda w: w != "")).cast("bigint")


def words(text: Column) -> Column:
    """Lower-case words of letters and apostrophes."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([a-z']+)"), F.lit(1))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets of words; 0.0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def cosine(a: Column, b: Column) -> Column:
    """Norms are at least 1e-8 each; the result lies in [-1, 1]."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = lambda x: F.greatest(F.sqrt(dot(x, x)), F.lit(1e-8))
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / (norm(a) * norm(b))))


def overlaps(start: Column, end: Column, low: Column | int, high: Column | int) -> Column:
    return (start < high) & (end > low)
