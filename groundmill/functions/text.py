"""Text functions over columns. White space, words and digits follow Unicode, not ASCII; nothing leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space, as the inside of a character class that Java's and RE2's patterns both read.
WS = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: The same for Java alone, which knows most of it as one property: a pattern starts with JAVA and has SPACE in a class.
JAVA, SPACE = "(?U)", r"\s\x1c-\x1f"
# Words that are no keywords, and cues that a text denies something (found anywhere, also inside words).
STOPWORDS = ("a", "an", "and", "are", "as", "at", "be", "been", "by", "for", "from", "has", "have", "he", "her", "his", "in", "is", "it", "its", "of", "on", "or", "she", "that", "the", "their", "they", "this", "to", "was", "were", "with", "you", "your")
NEGATION_CUES = ("not", "never", "no evidence", "false", "untrue", "incorrect")
JUNK = ("?", "??", "???", "n/a", "na", "none", "null", "<unk>", "unknown")


def strip(value: Column) -> Column:
    """Without white space at either end; null stays null."""
    return F.regexp_replace(value, f"{JAVA}^[{SPACE}]+|[{SPACE}]+$", "")


def collapse(value: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(value, f"{JAVA}[{SPACE}]+", " "))


def filled(value: Column) -> Column:
    """Stripped, and null if nothing is left."""
    return F.nullif(strip(value), F.lit(""))


def not_junk(value: Column) -> Column:
    """Stripped, and null if it is empty or stands for no value."""
    bare = filled(value)
    return F.when(~F.lower(bare).isin(*JUNK), bare)


def pieces(value: Column) -> Column:
    """The runs of characters between white space."""
    return F.regexp_extract_all(value, F.lit(f"{JAVA}[^{SPACE}]+"), F.lit(0))


def tokens(value: Column) -> Column:
    """Runs of ASCII letters and digits, in lower case."""
    return F.regexp_extract_all(F.lower(value), F.lit("[a-z0-9]+"), F.lit(0))


def keywords(value: Column) -> Column:
    """Distinct tokens of more than one character that are no stop words."""
    return F.array_distinct(F.filter(tokens(value), lambda t: (F.length(t) > 1) & ~t.isin(*STOPWORDS)))


def _runs(value: Column) -> Column:
    return F.regexp_extract_all(value, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def entities(value: Column) -> Column:
    """Distinct whole words of one capital and small ASCII letters, in lower case."""
    return F.array_distinct(F.transform(F.filter(_runs(value), lambda w: w.rlike("^[A-Z][a-z]+$")), F.lower))


def numbers(value: Column) -> Column:
    """Distinct whole words of decimal digits of any script."""
    return F.array_distinct(F.filter(_runs(value), lambda w: w.rlike(r"^\p{Nd}+$")))


def negated(value: Column) -> Column:
    low = F.lower(value)
    cue = low.contains(NEGATION_CUES[0])
    for other in NEGATION_CUES[1:]:
        cue = cue | low.contains(other)
    return cue


def sentences(value: Column, least: int) -> Column:
    """Stripped sentences of at least ``least`` characters: cut at white space after a full stop, ! or ?."""
    cut = F.split(value, f"{JAVA}(?<=[.!?])[{SPACE}]+")
    return F.filter(F.transform(cut, strip), lambda s: F.length(s) >= least)


def clauses(value: Column, least: int) -> Column:
    """Stripped parts between full stops of at least ``least`` characters."""
    return F.filter(F.transform(F.split(value, r"\."), strip), lambda s: F.length(s) >= least)


def safe_name(value: Column, default: str) -> Column:
    """A file name: other characters become ``_``, none of ``._-`` at the ends."""
    bare = F.regexp_replace(F.regexp_replace(value, "[^A-Za-z0-9._-]+", "_"), "^[._-]+|[._-]+$", "")
    return F.coalesce(F.nullif(bare, F.lit("")), F.lit(default))


def key_of(identifier: Column, title: Column, text: Column) -> Column:
    """An article's key: its id, else a hash of its title, else of the start of its text."""
    by_title = F.concat(F.lit("title:"), F.substring(F.md5(strip(title)), 1, 16))
    by_text = F.concat(F.lit("row:"), F.substring(F.md5(F.substring(text, 1, 512)), 1, 16))
    return F.coalesce(filled(identifier), F.when(filled(title).isNotNull(), by_title), by_text)
