"""Character classes as regex text.

Word, space and digit classes are written out so that the same pattern means the same thing on the
JVM and in any other regex engine; shorthand classes differ between engines. The alphabet classes
follow the Unicode character names and are built from that rule.
"""
from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

# Members of the white-space class, the way a Unicode-aware text library counts them.
SPACE_SET = (r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
             r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}")
SPACE = f"[{SPACE_SET}]"
NONSPACE = f"[^{SPACE_SET}]"
# The same class for the JVM: single Latin-1 members are one bit-set look-up, the rest is guarded.
_FAST_SPACE = (r" \t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\xa0[\x{1680}-\x{3000}&&[\x{1680}\x{2000}-\x{200a}"
               r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]]")
JSPACE = f"[{_FAST_SPACE}]"
JNONSPACE = f"[^{_FAST_SPACE}]"
SPACE_CHARS = ("\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200b)))
               + "\u2028\u2029\u202f\u205f\u3000")
WORD_SET = r"\p{L}\p{N}_"
WORD = f"[{WORD_SET}]"
WORD_START = f"(?<!{WORD})"
WORD_END = f"(?!{WORD})"
DIGIT = r"\p{Nd}"
EMOJI_SET = r"\x{1F300}-\x{1F9FF}\x{2600}-\x{27BF}"


def _ranges(codes):
    start = prev = None
    for c in codes:
        if prev is None or c != prev + 1:
            if start is not None:
                yield start, prev
            start = c
        prev = c
    if start is not None:
        yield start, prev


def _as_set(codes) -> str:
    return "".join(f"\\x{{{a:x}}}" if a == b else f"\\x{{{a:x}}}-\\x{{{b:x}}}"
                   for a, b in _ranges(codes))


@lru_cache(maxsize=None)
def _tables() -> dict[str, str]:
    latin, cyrillic, digits = [], [], []
    for code in range(sys.maxunicode + 1):
        ch = chr(code)
        if ch.isdigit():
            digits.append(code)
        if 0x400 <= code <= 0x4FF:
            cyrillic.append(code)
        elif "a" <= ch.lower() <= "z":
            latin.append(code)
        elif (not ch.isdigit() and not 0x1F300 <= code <= 0x1F9FF
              and not 0x2600 <= code <= 0x27BF and unicodedata.category(ch)[0] == "L"):
            name = unicodedata.name(ch, "")
            if "CYRILLIC" in name:
                cyrillic.append(code)
            elif "LATIN" in name:
                latin.append(code)
    # every wide digit is a number character, so the long range list hides behind one cheap test
    return {"latin": "a-zA-Z" + _guarded(latin), "cyrillic": r"\x{400}-\x{4ff}" + _guarded(cyrillic),
            "digit": r"0-9[\p{N}&&[^\x00-\x7f]&&[" + _as_set(digits) + "]]"}


def _guarded(codes) -> str:
    return r"[[^\x00-\x7f]&&[" + _as_set(codes) + "]]"


def latin_set() -> str:
    return _tables()["latin"]


def cyrillic_set() -> str:
    return _tables()["cyrillic"]


def digit_set() -> str:
    """Digits in the wide sense: decimal digits plus superscript and circled ones."""
    return _tables()["digit"]


def alternatives(items) -> str:
    """Alternation of literal strings."""
    special = set(r"\.^$|?*+()[]{}-")
    return "|".join("".join("\\" + ch if ch in special else ch for ch in item) for item in items)
