"""Column expressions for text clean-up and terms. Everything here stays inside the JVM."""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfmark.functions.items import SPACE_CLASS, col

WORD_CHARS = r"\p{L}\p{M}\p{N}_"

# Numeric part-of-speech codes and their letters; Z (symbols) and X (unknown) have no number.
POS_LETTERS = {1: "N", 2: "A", 3: "P", 4: "C", 5: "V", 6: "D", 7: "R", 8: "J", 9: "T", 10: "I"}

# Letters and signs whose ASCII form is longer than one character or has no Unicode decomposition.
ASCII_FORMS = {
    "ß": "ss", "Æ": "AE", "æ": "ae", "Œ": "OE", "œ": "oe", "Þ": "Th", "þ": "th", "Ŋ": "NG", "ŋ": "ng",
    "Ø": "O", "ø": "o", "Đ": "D", "đ": "d", "Ð": "D", "ð": "d", "Ł": "L", "ł": "l", "Ħ": "H", "ħ": "h",
    "ı": "i", "Ŧ": "T", "ŧ": "t", " ": " ", "¡": "!", "«": "<<", "»": ">>", "¿": "?", "×": "x",
    "–": "-", "—": "--", "‘": "'", "’": "'", "“": '"', "”": '"', "„": ",,", "…": "...", "€": "EUR",
}


def words(c: str | Column) -> Column:
    """Runs of non-space characters. Only the first and the last part of the split can be empty."""

    def inner(parts: Column) -> Column:
        n = F.size(parts)
        head = (F.get(parts, F.lit(0)) == "").cast("int")
        tail = ((F.get(parts, n - 1) == "") & (n > 1)).cast("int")
        return F.slice(parts, head + 1, n - head - tail)

    return bind(F.split(col(c), f"[{SPACE_CLASS}]+", -1), inner)


def normalise_spaces(c: str | Column) -> Column:
    return F.array_join(words(c), " ")


def separate_signs(c: str | Column) -> Column:
    """Words and single signs as separate tokens."""
    return F.regexp_extract_all(
        col(c), F.lit(rf"[{WORD_CHARS}]+|[^{WORD_CHARS}{SPACE_CLASS}]"), F.lit(0)
    )


def signs_to_spaces(c: str | Column) -> Column:
    return F.regexp_replace(col(c), rf"[^{WORD_CHARS}]", " ")


def remove_words(tokens, stop_words=(), min_length: int | None = None, max_length: int | None = None) -> Column:
    """Drop exact stop words and tokens outside the length limits. The stop list is a settings-sized literal."""
    tokens = col(tokens)
    tests = []
    if stop_words:
        tests.append(lambda x: ~x.isin(sorted(stop_words)))
    if min_length:
        tests.append(lambda x: F.length(x) >= min_length)
    if max_length:
        tests.append(lambda x: F.length(x) <= max_length)
    if not tests:
        return tokens
    return F.filter(tokens, lambda x: reduce(lambda a, b: a & b, [t(x) for t in tests]))


def _decomposed_latin() -> tuple[str, str]:
    """Accented Latin letters and their base letters, by Unicode decomposition."""
    pairs = []
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        base = unicodedata.normalize("NFD", chr(code))[0]
        if base.isascii() and chr(code) not in ASCII_FORMS:
            pairs.append((chr(code), base))
    return "".join(p[0] for p in pairs), "".join(p[1] for p in pairs)


LATIN_FROM, LATIN_TO = _decomposed_latin()


def transliterate(c: str | Column) -> Column:
    """Latin letters to ASCII; scripts outside the Latin blocks stay as they are."""
    c = F.translate(col(c), LATIN_FROM, LATIN_TO)
    single = {k: v for k, v in ASCII_FORMS.items() if len(v) == 1}
    c = F.translate(c, "".join(single), "".join(single.values()))
    for sign, ascii_form in ASCII_FORMS.items():
        if len(ascii_form) > 1:
            c = F.replace(c, F.lit(sign), F.lit(ascii_form))
    return c


def change_case(c: str | Column, case: str | None) -> Column:
    """``case`` is 'upper', 'lower' or None; the two exclude each other."""
    if case not in (None, "upper", "lower"):
        raise ValueError("case must be 'upper', 'lower' or None")
    c = col(c)
    return F.upper(c) if case == "upper" else F.lower(c) if case == "lower" else c


def part_of_speech(codes) -> list[str]:
    """Numeric part-of-speech codes to letters; letters pass through."""
    return [POS_LETTERS.get(int(c), str(c)) if str(c).isdigit() else str(c) for c in codes]


def clean_text(
    c: str | Column,
    *,
    separate: bool = False,
    stop_words=(),
    min_length: int | None = None,
    max_length: int | None = None,
    to_ascii: bool = False,
    case: str | None = None,
) -> Column:
    """The clean-up chain without a lexicon: early removal, separation, removal, ASCII, case."""
    c = col(c)
    early = F.array_join(remove_words(words(c), stop_words, min_length), " ")
    tokens = separate_signs(early) if separate else words(early)
    return F.when(c == "", c).otherwise(finish_text(tokens, stop_words, min_length, max_length, to_ascii, case))


def finish_text(tokens, stop_words, min_length, max_length, to_ascii, case) -> Column:
    """Last steps of the chain, shared by the variants with and without a lexicon."""
    text = F.array_join(remove_words(tokens, stop_words, min_length, max_length), " ")
    return change_case(transliterate(text) if to_ascii else text, case)


def bind(c: Column, body) -> Column:
    """``body`` over the value of ``c``, computed once per row even where ``body`` uses it inside a lambda."""
    return F.get(F.transform(F.array(c), body), F.lit(0))


def count_terms(terms: str | Column) -> Column:
    """Distinct terms of an array with their counts, as ``ARRAY<STRUCT<term, value DOUBLE>>``.

    Sorting and run lengths stay inside the row, so counting the terms of a document needs no shuffle.
    """

    def runs(s: Column) -> Column:
        first = lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1))
        starts = F.when(F.size(s) > 0, F.filter(F.sequence(F.lit(0), F.size(s) - 1), first))
        entry = lambda i, j: F.struct(F.get(s, i).alias("term"), (j - i).cast("double").alias("value"))
        return bind(starts, lambda b: F.zip_with(b, F.concat(F.slice(b, 2, F.size(b)), F.array(F.size(s))), entry))

    return bind(F.sort_array(col(terms)), runs)


def _grams(tokens: Column, n: int, glue: str) -> Column:
    if n == 1:
        many = tokens
    else:
        many = F.transform(
            F.sequence(F.lit(1), F.size(tokens) - F.lit(n - 1)),
            lambda i: F.array_join(F.slice(tokens, i, F.lit(n)), glue),
        )
    return F.when(F.size(tokens) < n, F.array(F.array_join(tokens, glue))).otherwise(many)


def text_ngrams(tokens: str | Column, n: int) -> Column:
    """Word n-grams glued by '_'; a shorter text gives one gram of all its words."""
    return bind(col(tokens), lambda t: _grams(t, n, "_"))


def item_ngrams(items: str | Column, n: int) -> Column:
    """Word n-grams of every item, glued by a blank, never across items."""
    return F.flatten(F.transform(F.transform(col(items), words), lambda w: _grams(w, n, " ")))


def word_parts(tokens: str | Column, max_words: int) -> Column:
    """Consecutive parts of at most ``max_words`` words; an empty text is one empty part."""

    def cut(words: Column) -> Column:
        last = F.greatest(F.ceil(F.size(words) / max_words).cast("int") - 1, F.lit(0))
        return F.transform(
            F.sequence(F.lit(0), last),
            lambda i: F.struct(
                i.alias("part_no"),
                F.slice(words, i * max_words + 1, F.lit(max_words)).alias("words"),
                (i == last).alias("is_last"),
            ),
        )

    return bind(col(tokens), cut)


def join_hyphenated(c: str | Column) -> Column:
    """Rejoin words hyphenated at line ends, other line ends become blanks."""
    return F.regexp_replace(F.regexp_replace(col(c), "-\r?\n", ""), "\r?\n", " ")
