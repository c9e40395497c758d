"""Character-level obfuscation scores.

A word scores when it mixes Latin and Cyrillic letters or carries suspicious digits. Only words
that contain a digit or both alphabets can score above zero, so one regex pulls those candidates
out of the text and the per-word rules run on them alone.
"""
from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, functions as F

from .. import config
from .chars import (DIGIT, EMOJI_SET, JNONSPACE as NONSPACE, WORD, alternatives, cyrillic_set,
                    digit_set, latin_set)
from .text import _col, contains_any, let, strip

PHONE = rf"\+380{DIGIT}{{9}}"
LINK = (rf"(?i)https?://{NONSPACE}+|www\.{NONSPACE}+"
        rf"|(?:(?<!{NONSPACE})|\G){NONSPACE}+\.(?:com|ua|org|net)(?!{WORD})")
# A text without any of these holds no link; the check is far cheaper than the pattern.
LINK_MARKS = ["://", "www.", ".com", ".ua", ".org", ".net"]
HIDDEN = f"[[^\\x00-\\x7f]&&[{''.join(config.INVISIBLE_CHARS)}]]"
SWAP = f"[{config.CONFUSABLE_CYRILLIC}{config.CONFUSABLE_LATIN}{config.CONFUSABLE_DIGITS}]"
STRANGE = rf"[[^\x00-\x7f]&&[\p{{Cf}}\p{{Co}}\p{{Cn}}]&&[^{EMOJI_SET}]]"


@lru_cache(maxsize=None)
def known_term_pattern() -> str:
    """Regex over a lower-cased word: brands, brands with a number, allowed words."""
    plain = [b for b in config.KNOWN_BRANDS if b == b.lower()]
    inside = [b for b in plain if len(b) >= 4]
    with_number = [b for b in plain if b.isascii() and b.isalpha()]
    exact = plain + config.ALLOWED_WORDS + config.BRANDS_WITH_NUMBERS
    return (f"{alternatives(inside)}|^(?:{alternatives(with_number)}){DIGIT}{{2,}}$"
            f"|^(?:{alternatives(exact)})$")


@lru_cache(maxsize=None)
def brand_number_pattern() -> str:
    with_number = [b for b in config.KNOWN_BRANDS if b.isascii() and b.isalpha() and b == b.lower()]
    return (f"^(?:{alternatives(config.BRANDS_WITH_NUMBERS)})$"
            f"|^(?:{alternatives(with_number)}){DIGIT}{{2,}}$")


# Words purely of Latin or purely of Cyrillic letters are skipped by the first branch; what the second
# branch captures holds a digit, both alphabets, or rarer characters, and goes to the word rules.
CANDIDATE = (rf"(?:[a-zA-Z_\x{{c0}}-\x{{d6}}\x{{d8}}-\x{{f6}}\x{{f8}}-\x{{24f}}]++"
             rf"|[\x{{400}}-\x{{481}}\x{{48a}}-\x{{4ff}}_]++)(?!{WORD})|({WORD}{{2,}})")


def _count(word: Column, members: str) -> Column:
    return F.length(F.regexp_replace(word, F.lit(f"[^{members}]+"), F.lit("")))


def is_known_term(word) -> Column:
    return F.rlike(F.lower(_col(word)), F.lit(known_term_pattern()))


def digit_score(word) -> Column:
    """Suspicion of the digit positions in one word, 0 to 1."""
    w = _col(word)
    confusable = config.CONFUSABLE_DIGITS
    inner = lambda members: F.regexp_count(
        w, F.lit(rf"(?<=\p{{L}})[{members}](?=\p{{L}})"))
    swaps = inner(confusable)
    digits = inner(digit_set())
    tail = F.when(F.rlike(w, F.lit(rf"^\P{{Nd}}+{DIGIT}$")), 0.2).otherwise(0.0)
    return (F.when(~F.rlike(w, F.lit(f"[{digit_set()}]")), 0.0)
            .when(F.rlike(F.lower(w), F.lit(brand_number_pattern())), 0.0)
            .when(F.rlike(w, F.lit(rf"^\P{{Nd}}+{DIGIT}{{2,}}$")), 0.0)
            .when(F.rlike(w, F.lit(rf"^{DIGIT}+\P{{Nd}}+$")), 0.1)
            .otherwise(F.least(swaps * 0.3 + (digits - swaps) * 0.1 + tail, F.lit(1.0))))


def word_score(word) -> Column:
    """Substitution score of one word; 0 means not obfuscated."""
    w = _col(word)
    parts = F.struct(_count(w, cyrillic_set()).alias("cyr"), _count(w, latin_set()).alias("lat"),
                     digit_score(w).alias("dig"))

    def rule(p: Column) -> Column:
        letters = p["cyr"] + p["lat"]
        ratio = F.least(p["cyr"], p["lat"]) / letters
        top = F.greatest(p["dig"], ratio * 2)
        return (F.when(letters == 0, 0.0)
                .when((p["cyr"] == 0) | (p["lat"] == 0), p["dig"])
                .when((letters > 2) & F.rlike(w, F.lit(SWAP)), F.greatest(F.lit(0.6), ratio * 2))
                .when(top > 0.1, F.least(top * 1.5, F.lit(1.0)))
                .otherwise(0.0))

    return let(parts, rule)


def clean_for_scoring(text) -> Column:
    """Stripped text without phone numbers, links and bare domains."""
    def drop_links(t: Column) -> Column:
        low = F.lower(t)
        marks = let(low, lambda x: contains_any(x, LINK_MARKS))
        return F.when(marks, F.regexp_replace(t, F.lit(LINK), F.lit(""))).otherwise(t)

    def drop_phones(t: Column) -> Column:
        return F.when(F.contains(t, F.lit("+380")), F.regexp_replace(
            t, F.lit(PHONE), F.lit(""))).otherwise(t)

    return let(let(strip(F.coalesce(_col(text), F.lit(""))), drop_phones), drop_links)


def candidate_words(clean: Column) -> Column:
    """Words that can score: with a digit or mixed alphabets, no pure number, no known term."""
    words = F.regexp_extract_all(clean, F.lit(CANDIDATE), F.lit(1))
    return F.filter(words, lambda w: (w != "") & ~F.rlike(w, F.lit(f"^[{digit_set()}]+$"))
                    & ~is_known_term(w))


def obfuscation_score(text, invisible: str = "characters") -> Column:
    """Score of one text, 0 to 1.

    ``invisible='characters'`` counts real invisible characters; ``'literal'`` leaves that part at
    zero, which is what the original list loading amounts to.
    """
    whole = strip(F.coalesce(_col(text), F.lit("")))
    weights = config.OBFUSCATION_WEIGHTS

    def combine(clean: Column) -> Column:
        word_part = let(
            F.filter(F.transform(candidate_words(clean), word_score), lambda s: s > 0),
            lambda found: F.when(F.size(found) > 0, F.aggregate(
                found, F.lit(0.0), lambda acc, s: acc + s) / F.size(found)).otherwise(0.0))
        if invisible == "literal":
            hidden_part = F.lit(0.0)
        else:
            hidden_part = F.least(F.regexp_count(clean, F.lit(HIDDEN)) * 0.5, F.lit(1.0))
        strange_part = F.least(F.regexp_count(clean, F.lit(STRANGE)) * 0.2, F.lit(1.0))
        return F.least(word_part * weights["word"] + hidden_part * weights["invisible"]
                       + strange_part * weights["strange"], F.lit(1.0))

    scored = let(clean_for_scoring(text), lambda c: F.when(
        F.rlike(c, F.lit(WORD)), combine(c)).otherwise(0.0))
    return F.when(F.length(whole) < 2, 0.0).otherwise(scored)


def combined_obfuscation(message_score, sender_score) -> Column:
    m, s = _col(message_score), _col(sender_score)
    return (F.when((m > 0.3) & (s > 0.3), F.least(m + s, F.lit(1.0)))
            .when((m > 0.3) | (s > 0.3), F.greatest(m, s) * 0.8)
            .otherwise(m * 0.55 + s * 0.45))


def add_obfuscation(df, text="message_text", source="source_addr", invisible="characters"):
    """Attach message, sender and combined scores to every message."""
    return (df.withColumn("message_obfuscation", obfuscation_score(text, invisible))
            .withColumn("sender_obfuscation", obfuscation_score(source, invisible))
            .withColumn("obfuscation_score",
                        combined_obfuscation("message_obfuscation", "sender_obfuscation")))
