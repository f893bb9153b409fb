"""Column functions on text: normalisation, word grams, answer extraction, keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode words; the same class in Java's and in RE2's dialect.
WORD = r"[\p{L}\p{N}_]+"
#: ASCII punctuation and the articles that answers are compared without (fixed values of the metric).
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Word ends are letter classes, as what \b means differs between dialects.
ARTICLES = r"(?<![\p{L}\p{N}_])(a|an|the)(?![\p{L}\p{N}_])"


def words(text: Column | str) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def normalize(text: Column | str) -> Column:
    """Lower-cased words joined by one space."""
    return F.array_join(words(text), " ")


def word_grams(found: str, n: int) -> Column:
    """All n-word grams of a column of words, none for fewer words. Give a column name: the lambda refers to it often."""
    return F.when(F.size(found) >= n, F.expr(f"transform(sequence(1, size({found}) - {n - 1}), i -> array_join(slice({found}, i, {n}), ' '))")).otherwise(F.array().cast("array<string>"))


def answer_words(text: Column | str) -> Column:
    """Words of an answer: lower case, no ASCII punctuation, no articles."""
    plain = F.translate(F.lower(text), PUNCTUATION, "")
    return F.filter(F.split(F.regexp_replace(plain, ARTICLES, " "), r"\s+"), lambda w: w != "")


NUMBER = r"-?[0-9]+(?:\.[0-9]+)?"
#: What introduces an answer, with any mark-up before its letter (fixed forms of the metric).
ANSWER = r"[Aa]nswer\s*(?:is)?[\s:：*(]*"
BOXED_LETTER = r"\\boxed\{\s*\(?([A-D])\)?\s*\}"


def boxed(text: Column | str) -> Column:
    """What the last \\boxed{} holds, which may nest braces once; null without one."""
    return F.try_element_at(F.regexp_extract_all(text, F.lit(r"\\boxed\{([^{}]*(?:\{[^{}]*\}[^{}]*)*)\}"), F.lit(1)), F.lit(-1))


def last_number(text: Column | str) -> Column:
    """The last number of the last \\boxed{}, or without one there of the whole text; , and $ do not count. Null if none."""
    last = lambda c: F.try_element_at(F.regexp_extract_all(F.translate(c, ",$", ""), F.lit(NUMBER), F.lit(0)), F.lit(-1))
    return F.coalesce(last(boxed(text)), last(F.col(text) if isinstance(text, str) else text))


def numbers_agree(a: Column, b: Column, within: float = 1e-6) -> Column:
    """Whether both are numbers and differ by less than ``within``; false for anything else."""
    return F.coalesce(F.abs(a.try_cast("double") - b.try_cast("double")) < within, F.lit(False))


def last_choice(text: Column | str) -> Column:
    """The letter of the last answer, bold or in brackets or not, or \\boxed{}; an 'A' before a lower-case word is an article."""
    plain = F.regexp_replace(text, rf"({ANSWER})A(?=\s+[a-z])", "$1a")
    found = F.regexp_extract_all(plain, F.lit(rf"{ANSWER}[A-D](?![A-Za-z0-9])|{BOXED_LETTER}"), F.lit(0))
    return F.regexp_extract(F.try_element_at(found, F.lit(-1)), r"([A-D])[^A-D]*$", 1)


def only_match(text: Column | str, pattern: str) -> Column:
    """The match of a pattern where there is exactly one, else null."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.when(F.size(found) == 1, found[0])


def opening(text: Column | str, length: int = 48) -> Column:
    """The first characters of the first line of the trimmed text."""
    return F.left(F.split_part(F.trim(text), F.lit("\n"), F.lit(1)), F.lit(length))


def between_markers(text: Column | str, start: str, end: str) -> Column:
    """A whole text without byte-order mark, with plain line ends, between a line that holds start and one that holds end."""
    plain = F.regexp_replace(F.regexp_replace(text, "^\ufeff", ""), "\r\n?", "\n")
    inner = F.regexp_extract(plain, rf"(?s){start}[^\n]*\n(.*?)(?:\n[^\n]*{end}|\z)", 1)
    return F.trim(F.when(inner != "", inner).otherwise(plain))


def letters_and_digits(text: Column | str, by: str = " ") -> Column:
    """Lower-case runs of ASCII letters and digits, joined by ``by``; with "" all in one."""
    plain = F.regexp_replace(F.lower(text), "[^a-z0-9]+", by)
    return F.trim(plain) if by == " " else F.regexp_replace(plain, f"^{by}+|{by}+$", "") if by else plain


def title_core(title: Column | str) -> Column:
    """A title up to a colon or semicolon, without the article before it."""
    return F.regexp_replace(letters_and_digits(F.regexp_extract(title, "^[^;:]*", 0)), "^(the|a|an) ", "")


def sentences(text: Column | str) -> Column:
    """A text split at white space after an end of sentence."""
    return F.split(text, r"(?<=[.!?])\s+")


def byte_slice(text: str, percent: str, size: int) -> Column:
    """(start, bytes, decoded) of ``size`` bytes after the first line break at or behind a share of the text's bytes; what is no
    whole character there is decoded as U+FFFD. Null without a line break. Texts stay in the JVM."""
    raw = F.col(text).cast("binary")
    begin = F.floor(F.octet_length(raw).cast("long") * F.col(percent) / 100).cast("int")
    behind = F.substr(raw, begin + 1)
    skipped = F.octet_length(F.substring_index(behind.cast("string"), "\n", 1))  # found byte by byte, so a cut character is no matter
    at = begin + skipped + 1
    part = F.substr(raw, at + 1, F.lit(size))
    found = F.struct(at.cast("long").alias("start"), part.alias("bytes"), F.make_valid_utf8(part.cast("string")).alias("decoded"))
    return F.when(skipped < F.octet_length(behind), found)
