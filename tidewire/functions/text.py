"""Message text expressions: normalisation, rule categories, text features.

All of them are column expressions evaluated in the JVM.
"""
from __future__ import annotations

from pyspark.sql import Column, functions as F

from .. import config
from .chars import (DIGIT, JNONSPACE as NONSPACE, JSPACE as SPACE, SPACE_CHARS, WORD_END,
                    WORD_START, alternatives)

ALL_SUSPICIOUS = [w for words in config.SUSPICIOUS_WORDS.values() for w in words]

TEXT_FEATURES = ["message_length", "message_parts", "encoding_issues", "empty_message",
                 "excessive_length", "suspicious_word_count", "url_count", "suspicious_url",
                 "urgency_score", "financial_patterns", "phone_numbers", "message_entropy",
                 "social_engineering"]
TEXT_STATISTICS = ["length", "word_count", "digit_ratio", "upper_ratio", "has_money", "has_phone",
                   "has_url", "has_code", "exclamation_count", "question_count",
                   "avg_word_length"]

PHONE_PATTERN = r"\+?3?8?0[0-9]{9}"
# The bare-domain branch can only start at the head of a run of non-space characters or where the
# previous match ended; saying so keeps the scan linear on very long runs.
URL_PATTERN = (rf"https?://{NONSPACE}+|www\.{NONSPACE}+"
               rf"|(?:(?<!{NONSPACE})|\G){NONSPACE}+\.[a-z]{{2,}}")
FINANCIAL_PATTERNS = [
    rf"{DIGIT}+{SPACE}*(?:грн|₴|\$|USD|EUR)",
    rf"рахунок{SPACE}*{DIGIT}+",
    rf"карт[аи]{SPACE}*{DIGIT}+",
    "баланс",
    "переказ",
]


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once, however often ``use`` mentions it."""
    return F.transform(F.array(value), use)[0]


def _flag(c: Column) -> Column:
    return F.coalesce(c, F.lit(False)).cast("int")


def strip(c) -> Column:
    """Trim Unicode white space on both sides."""
    return F.btrim(_col(c), F.lit(SPACE_CHARS))


def contains_any(c: Column, items) -> Column:
    """True when one of the literal strings occurs in the text."""
    found = F.lit(False)
    for item in items:
        found = found | F.contains(c, F.lit(item))
    return found


def count_present(c: Column, items) -> Column:
    """How many of the literal strings occur in the text."""
    total = F.lit(0)
    for item in items:
        total = total + F.contains(c, F.lit(item)).cast("int")
    return total


# ---- normalisation ----------------------------------------------------------------------------

def normalize_text(c, extended: bool = False) -> Column:
    """Lower-case, collapse space and replace numbers, amounts, phones and links by markers.

    ``extended`` adds the ``www.`` and short-code markers of the classifier form.
    """
    t = F.lower(F.coalesce(_col(c), F.lit("")))
    t = strip(F.regexp_replace(t, F.lit(f"{SPACE}+"), F.lit(" ")))
    steps = [
        (rf"{WORD_START}{DIGIT}{{4,}}{WORD_END}", "LONGNUM"),
        (rf"{DIGIT}+{SPACE}*(?:грн|₴|uah)", "MONEY"),
        (rf"\+?3?8?0?{DIGIT}{{9,}}", "PHONE"),
        (rf"https?://{NONSPACE}+", "URL"),
    ]
    if extended:
        steps += [(rf"www\.{NONSPACE}+", "URL"),
                  (rf"{WORD_START}{DIGIT}{{4,6}}{WORD_END}", "CODE")]
    for pattern, marker in steps:
        t = F.regexp_replace(t, F.lit(pattern), F.lit(marker))
    return t


# ---- rule categories --------------------------------------------------------------------------

def rule_category(text, source, senders=None, keywords=None) -> Column:
    """First category with a sender inside the address, else first keyword group, else other."""
    senders = config.CATEGORY_SENDERS if senders is None else senders
    keywords = config.FEATURE_KEYWORDS if keywords is None else keywords
    low = F.lower(F.coalesce(_col(text), F.lit("")))
    up = F.upper(F.coalesce(_col(source), F.lit("")))
    rule = None
    branches = [(contains_any(up, [s.upper() for s in names]), cat)
                for cat, names in senders.items()]
    branches += [(contains_any(low, words), cat) for cat, words in keywords]
    for cond, cat in branches:
        rule = F.when(cond, cat) if rule is None else rule.when(cond, cat)
    return F.lit("other") if rule is None else rule.otherwise("other")


def rule_category_capture(text, source, rules=None) -> Column:
    """Category rules of the capture job: alternating text and address checks, first hit wins."""
    rules = config.CAPTURE_RULES if rules is None else rules
    sides = {"text": F.lower(F.coalesce(_col(text), F.lit(""))),
             "source": F.upper(F.coalesce(_col(source), F.lit("")))}
    rule = None
    for side, cat, words in rules:
        cond = contains_any(sides[side], words)
        rule = F.when(cond, cat) if rule is None else rule.when(cond, cat)
    return rule.otherwise("other")


# ---- scalar text features ---------------------------------------------------------------------

def message_parts(length: Column) -> Column:
    return F.greatest(F.lit(1), F.floor((length + 139) / F.lit(140)).cast("int"))


def encoding_issues(c) -> Column:
    return _flag(contains_any(_col(c), config.WEIRD_CHARS))


def _lower(c, low) -> Column:
    """The lower-cased text: taken from column ``low`` when the caller has it already."""
    return F.lower(_col(c)) if low is None else _col(low)


def suspicious_word_count(c, words=None, low=None) -> Column:
    return F.least(count_present(_lower(c, low), ALL_SUSPICIOUS if words is None else words),
                   F.lit(10))


def url_count(c, low=None) -> Column:
    # a match never crosses a blank and needs a dot or "://", so other pieces need no regex scan
    pieces = F.filter(F.split(_lower(c, low), F.lit(" ")),
                      lambda p: F.contains(p, F.lit(".")) | F.contains(p, F.lit("://")))
    return F.regexp_count(F.array_join(pieces, " "), F.lit(URL_PATTERN))


def suspicious_url(c, shorteners=None, low=None) -> Column:
    return _flag(contains_any(_lower(c, low),
                              config.SHORTENERS if shorteners is None else shorteners))


def upper_count(c: Column) -> Column:
    return F.length(F.regexp_replace(c, F.lit(r"[^\p{IsUppercase}]+"), F.lit("")))


def char_count(c: Column, ch: str) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(ch), F.lit("")))


def urgency_score(c, low=None) -> Column:
    t = _col(c)
    points = (count_present(_lower(c, low), config.URGENCY_STEMS)
              + (upper_count(t) > F.length(t) * 0.3).cast("int")
              + F.least(char_count(t, "!"), F.lit(3)))
    return F.least(points / F.lit(5.0), F.lit(1.0))


def financial_patterns(c, low=None) -> Column:
    text = _lower(c, low)
    total = F.lit(0)
    for pattern in FINANCIAL_PATTERNS:
        total = total + F.regexp_count(text, F.lit(pattern))
    return F.least(total, F.lit(5))


def phone_numbers(c) -> Column:
    return F.regexp_count(_col(c), F.lit(PHONE_PATTERN))


def message_entropy(c) -> Column:
    """Shannon bits over the characters, divided by 5 and capped at 1.

    With n characters and character counts k the bits are log2(n) - sum(k log2 k) / n. Every step
    removes one character from what is left of the text, so frequent characters shorten the rest
    of the work; k is the drop in length, seen one step later.
    """
    t = _col(c)
    n = F.length(t)
    start = F.struct(t.alias("rest"), n.alias("before"), F.lit(0.0).alias("total"))

    def add(total: Column, k: Column) -> Column:
        return total + F.when(k > 0, k * F.log2(k)).otherwise(0.0)

    def step(acc: Column, ch: Column) -> Column:
        left = F.length(acc["rest"])
        return F.struct(F.replace(acc["rest"], ch, F.lit("")).alias("rest"), left.alias("before"),
                        add(acc["total"], acc["before"] - left).alias("total"))

    weighted = F.aggregate(F.array_distinct(F.split(t, F.lit(""))), start, step,
                           lambda acc: add(acc["total"], acc["before"] - F.length(acc["rest"])))
    return F.when(n > 0, F.greatest(
        F.least((F.log2(n) - weighted / n) / 5.0, F.lit(1.0)), F.lit(0.0))).otherwise(0.0)


def social_engineering(c, low=None) -> Column:
    return _flag(contains_any(_lower(c, low), config.SOCIAL_STEMS))


def add_text_features(df, text="message_text"):
    """Attach all text features; the lower-cased text is computed once per row."""
    staged = df.withColumn("_low", F.lower(F.coalesce(_col(text), F.lit(""))))
    return staged.withColumns(text_features(text, low="_low")).drop("_low")


def text_features(text="message_text", low=None) -> dict[str, Column]:
    """All features that depend on the text alone, by output name."""
    t = F.coalesce(_col(text), F.lit(""))
    length = F.length(t)
    return {
        "message_length": length,
        "message_parts": message_parts(length),
        "encoding_issues": encoding_issues(t),
        "empty_message": _flag(length == 0),
        "excessive_length": _flag(length > 1000),
        "suspicious_word_count": suspicious_word_count(t, low=low),
        "url_count": url_count(t, low=low),
        "suspicious_url": suspicious_url(t, low=low),
        "urgency_score": urgency_score(t, low=low),
        "financial_patterns": financial_patterns(t, low=low),
        "phone_numbers": phone_numbers(t),
        "message_entropy": message_entropy(t),
        "social_engineering": social_engineering(t, low=low),
    }


# ---- classifier text statistics ---------------------------------------------------------------

def text_model_features(text="message_text") -> dict[str, Column]:
    """The eleven text statistics the category classifier learns from."""
    from .chars import digit_set
    t = F.coalesce(_col(text), F.lit(""))
    low = F.lower(t)
    n = F.length(t)
    words = F.filter(F.split(t, F.lit(f"{SPACE}+")), lambda w: F.length(w) > 0)
    share = lambda count: count / F.greatest(n, F.lit(1))
    n_words = F.size(words)
    digits = F.length(F.regexp_replace(t, F.lit(f"[^{digit_set()}]+"), F.lit("")))
    letters_in_words = F.length(F.regexp_replace(t, F.lit(f"{SPACE}+"), F.lit("")))
    return {
        "length": n,
        "word_count": n_words,
        "digit_ratio": share(digits),
        "upper_ratio": share(upper_count(t)),
        "has_money": _flag(F.rlike(low, F.lit(
            rf"{DIGIT}+{SPACE}*(?:грн|₴|\$|uah|usd|eur)"))),
        "has_phone": _flag(F.rlike(t, F.lit(rf"\+?3?8?0?{DIGIT}{{9,}}"))),
        "has_url": _flag(F.rlike(low, F.lit(r"https?://|www\."))),
        "has_code": _flag(F.rlike(low, F.lit(rf"(?:код|code|pin|otp)[^\n]*{DIGIT}{{4,}}"))),
        "exclamation_count": char_count(t, "!"),
        "question_count": char_count(t, "?"),
        "avg_word_length": F.when(n_words > 0, letters_in_words / n_words).otherwise(0.0),
    }


def basic_flags(text="message_text", source="source_addr", dest="dest_addr",
                length: Column | None = None) -> dict[str, Column]:
    """The flags set when a message is first stored."""
    from .chars import digit_set
    t = F.coalesce(_col(text), F.lit(""))
    s = F.coalesce(_col(source), F.lit(""))
    d = F.coalesce(_col(dest), F.lit(""))
    all_digits = F.lit(f"^[{digit_set()}]+$")
    numeric = lambda a: _flag(F.rlike(F.replace(strip(a), F.lit("+"), F.lit("")), all_digits))
    return {
        "source_is_numeric": numeric(s),
        "source_addr_length": F.length(s),
        "empty_message": _flag(F.length(strip(t)) == 0),
        "encoding_issues": _flag(F.contains(t, F.lit("�")) | F.contains(t, F.lit("\0"))),
        "excessive_length": _flag((F.length(t) if length is None else length) > 160),
        "dest_is_valid": numeric(d),
    }


__all__ = ["ALL_SUSPICIOUS", "PHONE_PATTERN", "URL_PATTERN", "FINANCIAL_PATTERNS", "add_text_features",
           "alternatives",            "basic_flags", "char_count", "contains_any", "count_present", "encoding_issues",
           "financial_patterns", "message_entropy", "message_parts", "normalize_text",
           "phone_numbers", "rule_category", "rule_category_capture", "social_engineering",
           "strip", "suspicious_url", "suspicious_word_count", "text_features",
           "text_model_features", "upper_count", "url_count", "urgency_score"]
