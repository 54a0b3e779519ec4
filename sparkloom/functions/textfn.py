"""Text expressions: tokens, k-mers, shape, readability.  All JVM-side."""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}]+"


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def normalise_text(text: Column) -> Column:
    """Punctuation stripped, lower case, blanks collapsed."""
    bare = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\s]+", "")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def lines(text: Column) -> Column:
    return F.split(text, r"\n")


def kmers(tokens: Column, k: int) -> Column:
    """All runs of ``k`` consecutive tokens, joined by a blank.

    ``tokens`` is used per run: give a column of an earlier projection.
    """
    starts = F.when(F.size(tokens) >= k, F.sequence(F.lit(1), F.size(tokens) - k + 1)).otherwise(
        F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(tokens, i, F.lit(k)), " "))


def unescape_html(text: Column) -> Column:
    """Character references replaced; ``&amp;`` becomes the word " and ".

    The text is cut before every ``&``, so each piece starts with at most one
    reference, and names are looked up in a constant map.
    """
    pairs = [F.lit(x) for name, code in sorted(name2codepoint.items()) if name != "amp" for x in (name, chr(code))]
    names = F.create_map(*pairs, F.lit("amp"), F.lit(" and "))

    def piece(p):
        name = F.regexp_extract(p, r"^&(\w+);", 1)
        code = F.regexp_extract(p, r"^&#(\d+);", 1).try_cast("int")
        number = F.when((code > 0) & (code < 0x110000) & ~code.between(0xD800, 0xDFFF), F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))
        char = F.coalesce(F.try_element_at(names, F.when(name != "", name)), number)
        return F.when(char.isNotNull(), F.concat(char, F.regexp_replace(p, r"^&#?\w+;", ""))).otherwise(p)

    return F.when(text.contains("&"), F.array_join(F.transform(F.split(text, "(?=&)"), piece), "")).otherwise(text)


# The alternatives of the social tokenizer, tried in this order.
PHONE = r"(?:(?:\+?[01][\-\s.]*)?(?:[\(]?\d{3}[\-\s.\)]*)?\d{3}[\-\s.]*\d{4})"
URL = r"http[s]?://(?:[a-zA-Z]|[0-9]|[$-_@.&+]|[!*\(\),]|(?:%[0-9a-fA-F][0-9a-fA-F]))+"
EMOTICON = (r"(?:[<>]?[:;=8][\-o\*\']?[\)\]\(\[dDpP/\:\}\{@\|\\]"
            r"|[\)\]\(\[dDpP/\:\}\{@\|\\][\-o\*\']?[:;=8][<>]?)")
TAG = r"<[^>]+>"
USER = r"(?:@[\p{L}\p{N}_]+)"
HASHTAG = r"(?:#+[\p{L}\p{N}_]+[\p{L}\p{N}_\'\-]*[\p{L}\p{N}_]+)"
WORD_DASHED = r"(?:[a-z][a-z'\-_]+[a-z])"
NUMBER = r"(?:[+\-]?\d+[,/.:-]\d+[+\-]?)"
WORD_PLAIN = r"(?:[\p{L}\p{N}_]+)"
ELLIPSIS = r"(?:\.(?:\s*\.)+)"
REST = r"(?:[^\s\p{Z}])"
SOCIAL = "(?i)" + "|".join(
    [PHONE, URL, EMOTICON, TAG, USER, HASHTAG, WORD_DASHED, NUMBER, WORD_PLAIN, ELLIPSIS, REST])


def tokenize_social(text: Column) -> Column:
    """Tokens of informal text in lower case; tokens holding a URL keep their case."""
    found = F.regexp_extract_all(unescape_html(text), F.lit(SOCIAL), F.lit(0))
    return F.transform(found, lambda w: F.when(w.contains("://") & F.regexp_like(w, F.lit("(?i)" + URL)), w).otherwise(F.lower(w)))


PUNCTUATION = r"[!-/:-@\[-`{-~]"


def share(part: Column, whole: Column) -> Column:
    """``part / whole``, 0 where the whole is 0."""
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def sentences(text: Column) -> Column:
    """Pieces between sentence ends that hold more than blanks."""
    return F.filter(F.split(text, r"[.!?]+"), lambda s: F.regexp_like(s, F.lit(r"\S")))


def shape_tokens(text: Column) -> Column:
    """Blank-separated words of the text without punctuation."""
    return F.regexp_extract_all(F.regexp_replace(text, PUNCTUATION, ""), F.lit(r"[^\s]+"), F.lit(0))


def text_shape(text: Column, tokens: Column, sents: Column) -> dict[str, Column]:
    """Counts and shares used as review features; safe on empty text.

    ``tokens`` and ``sents`` are used several times: give them as columns of an
    earlier projection, so that each text is cut only once.
    """
    n_words = F.size(tokens)
    caps_words = F.size(F.filter(tokens, lambda w: F.regexp_like(w, F.lit(r"^\p{Lu}{2,}$"))))
    caps_sents = F.size(F.filter(sents, lambda s: (s == F.upper(s)) & (F.regexp_replace(s, PUNCTUATION + r"|\s", "") != "")))
    return {
        "n_words": n_words, "n_sentences": F.size(sents),
        "caps_word_share": share(caps_words, n_words), "caps_sentence_share": share(caps_sents, F.size(sents)),
        "capital_share": share(F.regexp_count(text, F.lit("[A-Z]")), F.regexp_count(text, F.lit("[A-Za-z]"))),
        "punctuation_share": share(F.regexp_count(text, F.lit(PUNCTUATION)), F.length(text)),
    }


VOWELS = "[aeiouyàâäéèêëîïôöùûüáíóúñ]+"


def readability(text: Column) -> dict[str, Column]:
    """Flesch reading ease and Flesch-Kincaid grade; a syllable is a run of vowels."""
    tokens = words(text)
    n_words = F.size(tokens)
    n_sent = F.greatest(F.size(sentences(text)), F.lit(1))
    syllables = F.regexp_count(F.lower(text), F.lit(VOWELS))
    per_sentence = F.try_divide(n_words, n_sent)
    per_word = F.try_divide(syllables, n_words)
    return {
        "flesch": F.lit(206.835) - F.lit(1.015) * per_sentence - F.lit(84.6) * per_word,
        "grade": F.lit(0.39) * per_sentence + F.lit(11.8) * per_word - F.lit(15.59),
    }


def average_word_length(tokens: Column) -> Column:
    total = F.aggregate(tokens, F.lit(0), lambda a, w: a + F.length(w))
    return F.try_divide(total, F.size(tokens))


def words_without_vowels(tokens: Column) -> Column:
    return F.filter(tokens, lambda w: ~F.regexp_like(w, F.lit("[aeiou]")))


def long_words(tokens: Column, least: int = 4) -> Column:
    return F.filter(tokens, lambda w: F.length(w) >= least)


def replace_word(text: Column, old: str, new: str) -> Column:
    return F.regexp_replace(text, rf"\b\Q{old}\E\b", new)
