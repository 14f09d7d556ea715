"""Text functions as Column expressions."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from docmesa.functions import vocab


def any_of(parts: list[Column]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | p
    return out


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once in a row, however often it is used."""
    return F.get(F.transform(F.array(value), use), 0)


def contains_any(text: Column, terms: list[str]) -> Column:
    return any_of([F.contains(text, F.lit(t)) for t in terms])


def hits(text: Column, terms: list[str]) -> Column:
    """How many of the terms occur in the text."""
    return sum((F.contains(text, F.lit(t)).cast("int") for t in terms), F.lit(0))


def quoted(term: str) -> str:
    """A term as part of a pattern."""
    return re.sub(r"([\\.^$|?*+()\[\]{}/&-])", r"\\\1", term)


def has_word(text: Column, term: str) -> Column:
    """The pattern is tried only where the term occurs at all."""
    return F.contains(text, F.lit(term)) & F.rlike(text, F.lit(rf"\b{quoted(term)}\b"))


def word_hits(text: Column, terms: list[str]) -> Column:
    return sum((has_word(text, t).cast("int") for t in terms), F.lit(0))


def pattern_count(text: Column, pattern: str) -> Column:
    """regexp_count() of a pattern; if it is made of plain words, only where these occur."""
    plain = pattern.replace(r"\b", "")
    count = F.regexp_count(text, F.lit(pattern))
    return F.when(F.contains(text, F.lit(plain)), count).otherwise(0) if plain.replace(" ", "").isalpha() else count


def plain_characters(text: Column) -> Column:
    """Typographic characters as ASCII ones, without the final compatibility composition."""
    dropped, blanks, hyphens = "­​‌‍", "\x00﻿ ", "‐‑‒–—−•"
    singles, doubles = "‘’", "“”"
    source = blanks + hyphens + singles + doubles + dropped
    target = " " * len(blanks) + "-" * len(hyphens) + "'" * len(singles) + '"' * len(doubles)
    return F.translate(text, source, target)


def normalize_unicode(text: Column) -> Column:
    """Typographic characters as ASCII ones, then NFKC; ASCII text is left as it is."""
    plain = plain_characters(text)
    composed = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), plain, F.lit(True))
    return F.when(F.rlike(plain, F.lit(r"^\p{ASCII}*$")), plain).otherwise(composed)


def normalize_line(text: Column, composed: bool = True) -> Column:
    t = normalize_unicode(text) if composed else plain_characters(text)
    t = F.regexp_replace(t, r"(?<=[A-Za-z])-\s+(?=[a-z])", "")
    t = F.regexp_replace(t, r"\s+([,.;:!?%)\]])", "$1")
    t = F.regexp_replace(t, r"([(\[])\s+", "$1")
    t = F.regexp_replace(t, r"\b([A-Za-z])\s*/\s*([A-Za-z])\b", "$1/$2")
    t = F.regexp_replace(t, r"\b(\d+)\s*([°%])", "$1$2")
    t = F.regexp_replace(t, r"(?<=[\p{L}\p{N}_])-\s+(?=[\p{L}\p{N}_])", "")
    t = F.regexp_replace(t, r"[\s ]+", " ")
    return F.regexp_replace(t, r"^[ \t\r\n|]+|[ \t\r\n|]+$", "")


def normalize_table_line(line: Column) -> Column:
    whole = normalize_line(line)
    cells = F.array_join(F.transform(F.split(whole, r"\|"), lambda c: F.trim(c)), " | ")
    return F.when(F.contains(whole, F.lit("|")), cells).otherwise(whole)


def line_fingerprint(line: Column) -> Column:
    """A line in lower case with dates, page counts and numbers as marks."""
    t = F.lower(normalize_line(line))
    t = F.regexp_replace(t, r"\b\d{1,4}([/-]\d{1,2}){1,2}\b", "<date>")
    t = F.regexp_replace(t, r"\b\d+\s*(?:of|/)\s*\d+\b", "<page>")
    t = F.regexp_replace(t, r"\b\d+\b", "<num>")
    return F.trim(F.regexp_replace(t, r"[^a-z0-9<>]+", " "))


def normalize_for_dedupe(text: Column, composed: bool = True) -> Column:
    """Lower case words with blanks between; fractions are dropped."""
    t = normalize_unicode(text) if composed else text
    t = F.regexp_replace(F.lower(t), r"\b\d+\s*/\s*\d+\b", " ")
    return F.trim(F.regexp_replace(t, r"[^\p{L}\p{N}_]+", " "))


def words_of(normalized: Column) -> Column:
    return F.filter(F.split(normalized, " "), lambda w: w != "")


def shingles(words: Column, size: int = 5) -> Column:
    """Distinct word n-grams; of fewer words, the words."""
    n = F.size(words)
    grams = F.transform(F.sequence(F.lit(0), F.greatest(n - size, F.lit(0))), lambda i: F.concat_ws(" ", *[F.get(words, i + k) for k in range(size)]))
    return F.array_distinct(F.when(n < size, words).otherwise(grams))


def char_ngrams(token: Column, size: int = 3) -> Column:
    n = F.length(token)
    return F.array_distinct(F.when(n <= size, F.array(token)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(n - size + 1, F.lit(1))), lambda i: F.substring(token, i, size))))


def jaccard(a: Column, b: Column) -> Column:
    """Of arrays as sets; 0 where one is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def containment(a: Column, b: Column) -> Column:
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b))))


def signature(text: Column, size: int = 20) -> Column:
    return F.substring(F.sha1(text.cast("binary")), 1, size)


def tokens(text: Column, pattern: str = r"[A-Za-z][A-Za-z0-9_.-]{1,}") -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def keyword_token(token: Column) -> Column:
    """Lower case without marks at the ends and without a plural s."""
    t = F.regexp_replace(F.lower(token), r"^[._-]+|[._-]+$", "")
    plural = F.endswith(t, F.lit("s")) & (F.length(t) > 4) & ~F.endswith(t, F.lit("ss")) & ~F.endswith(t, F.lit("us"))
    return F.when(plural, F.substring(t, F.lit(1), F.length(t) - 1)).otherwise(t)


def keyword_keep(token: Column) -> Column:
    stop = F.array(*[F.lit(w) for w in vocab.STOPWORDS])
    singular = F.when(F.endswith(token, F.lit("s")) & (F.length(token) > 4), F.substring(token, F.lit(1), F.length(token) - 1)).otherwise(token)
    return (F.length(token) >= 2) & ~F.array_contains(stop, token) & ~F.array_contains(stop, singular) & ~F.rlike(token, F.lit(r"^\d+$"))


def stem(token: Column) -> Column:
    """Without the first ending that fits, where more than three letters stay; -ies becomes -y."""
    out = token
    for end in reversed(("ing", "tion", "ions", "ies", "ed", "es", "s")):  # fixed values, in order
        cut = F.substring(token, F.lit(1), F.length(token) - len(end))
        out = F.when(F.endswith(token, F.lit(end)) & (F.length(token) > len(end) + 3), F.concat(cut, F.lit("y")) if end == "ies" else cut).otherwise(out)
    return out


def sentences(text: Column) -> Column:
    """Split behind marks that end a sentence or clause."""
    found = F.filter(F.transform(F.split(text, r"(?<=[.!?;:])\s+"), lambda s: F.trim(s)), lambda s: s != "")
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.trim(text)))


def answer_sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.regexp_replace(text, r"\s+", " "), r"(?<=[.!?])\s+"), lambda s: F.trim(s)), lambda s: F.length(s) > 30)


def unique_preserve(values: Column) -> Column:
    """The first of values that are equal but for case and blanks at the ends; empty ones are left out."""
    start = F.array().cast("array<string>")
    return F.aggregate(values, start, lambda seen, v: F.when((F.trim(v) == "") | F.exists(seen, lambda s: F.lower(F.trim(s)) == F.lower(F.trim(v))), seen).otherwise(F.concat(seen, F.array(v))))


def standards(text: Column) -> Column:
    found = F.flatten(F.array(*[F.regexp_extract_all(text, F.lit(rf"(?i)\b{p}"), F.lit(0)) for p in vocab.STANDARDS]))
    return F.slice(F.array_distinct(F.transform(found, lambda s: F.upper(F.regexp_replace(normalize_line(s, composed=False), r"[.,;:]+$", "")))), 1, 20)


def identifiers(text: Column) -> Column:
    """Technical identifiers of five characters or more that are not inside a standard's name."""
    bare = text
    for p in vocab.STANDARDS:
        bare = F.regexp_replace(bare, rf"(?i)\b{p}", " ")
    found = F.regexp_extract_all(bare, F.lit(vocab.IDENTIFIER), F.lit(0))
    trimmed = F.transform(found, lambda s: F.regexp_replace(s, r"^[-_]+|[-_]+$", ""))
    return F.slice(F.array_distinct(F.filter(trimmed, lambda s: F.length(s) >= 5)), 1, 30)


def acronyms(text: Column) -> Column:
    stop = F.array(*[F.lit(w) for w in vocab.STOPWORDS])
    return F.slice(F.array_distinct(F.filter(F.regexp_extract_all(text, F.lit(r"\b[A-Z]{2,8}\b"), F.lit(0)), lambda a: ~F.array_contains(stop, F.lower(a)))), 1, 30)


def section_references(text: Column) -> Column:
    return unique_preserve(F.regexp_extract_all(text, F.lit(r"(?i)\b(?:section|sec\.?|clause|paragraph|para\.?)\s+((?:\d+\.)*\d+[A-Z]?)\b"), F.lit(1)))


def is_page_number(line: Column) -> Column:
    return F.rlike(F.lower(line), F.lit(r"^(page|pg\.?|sheet)?\s*\d+\s*(of|/)\s*\d+$|^(page|pg\.?|sheet)\s+\d+$|^\d+$|^-+\s*\d+\s*-+$"))


def is_watermark(line: Column) -> Column:
    t = F.lower(line)
    return t.isin(vocab.WATERMARKS) | contains_any(t, vocab.WATERMARK_PARTS)


def is_furniture(line: Column) -> Column:
    return (F.length(line) < 320) & contains_any(F.lower(line), vocab.FURNITURE)


def is_boilerplate(line: Column) -> Column:
    t = F.lower(line)
    return (F.length(t) <= 420) & any_of([F.rlike(t, F.lit(p)) for p in vocab.BOILERPLATE])


def is_contaminated(text: Column) -> Column:
    t = F.lower(text)
    return any_of([has_word(t, p) for p in vocab.CONTAMINATION])


def preview(text: Column, limit: int) -> Column:
    """At most `limit` characters of the text on one line, with an ellipsis where it is cut."""
    t = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(t) <= limit, t).otherwise(F.concat(F.rtrim(F.substring(t, 1, limit - 3)), F.lit("...")))


def cut_at_blank(text: Column, limit: int) -> Column:
    return F.when(F.length(text) > limit, F.regexp_replace(F.substring(text, 1, limit), r"\s\S*$", "")).otherwise(text)


def revision_sort_key(revision: Column) -> Column:
    t = F.upper(F.trim(revision))
    number = F.regexp_extract(t, r"^([A-Z]?)(\d+)([A-Z]?)", 2)
    key = F.concat(F.regexp_extract(t, r"^([A-Z]?)(\d+)([A-Z]?)", 1), F.lpad(number.cast("int").cast("string"), 4, "0"), F.regexp_extract(t, r"^([A-Z]?)(\d+)([A-Z]?)", 3))
    return F.when(t == "", "").when(number == "", t).otherwise(key)


def clamp(value: Column, default: float = 0.0) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(value.try_cast("double"), F.lit(default))))


def micro(value: Column) -> Column:
    """A score in millionths, for comparison across engines; null where that is no number of 64 bits."""
    return F.round(value * 1e6).try_cast("bigint")
