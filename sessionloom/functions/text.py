"""Text functions as Column expressions: tokens, Porter stems, byte-bounded cuts, path parts, sizes."""

from __future__ import annotations

import json
import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def _folding() -> tuple[str, str]:
    """Latin letters with marks, and the letters without: from the Unicode decompositions."""
    pairs = []
    for point in range(0xC0, 0x250):
        base = unicodedata.normalize("NFD", chr(point))
        if len(base) > 1 and all(unicodedata.combining(c) for c in base[1:]):
            pairs.append((chr(point), base[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_MARKED, _PLAIN = _folding()


def folded(text: Column) -> Column:
    """Lower case without diacritics."""
    return F.lower(F.regexp_replace(F.translate(text, _MARKED, _PLAIN), r"\p{M}", ""))


@F.pandas_udf(StringType())
def pretty_json(value: pd.Series) -> pd.Series:
    """JSON texts on lines of their own, indented by two; null for null."""
    return value.map(lambda v: None if v is None else json.dumps(json.loads(v), indent=2, ensure_ascii=False))


def tokens(text: Column) -> Column:
    """Words of letters and digits of the folded text, in order; null for null."""
    return F.regexp_extract_all(folded(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def plain_tokens(text: Column) -> Column:
    """Words of ASCII letters and digits of the lower-cased text, which plain SQL can express."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([a-z0-9]+)"), F.lit(1))


# The suffix rules of Porter's published stemming algorithm (1980).
_STEP2 = [
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"),
    ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"),
    ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
]
_STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
_STEP4 = [
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ou", "ism", "ate", "iti", "ous", "ive", "ize",
]
#: Regular expressions of stems, in which Y is the consonant and y the vowel.
_V, _C = "[aeiouy]", "[^aeiouy]"
_M1 = rf"^{_C}*{_V}+{_C}"  # measure above 0
_M2 = rf"^{_C}*{_V}+{_C}+{_V}+{_C}"  # above 1
_JUST1 = rf"^{_C}*{_V}+{_C}+{_V}*$"  # just 1
_HAS_VOWEL = _V
_CVC = rf"{_C}{_V}[^aeiouywxY]$"


def _by_suffix(word: Column, rules: list[tuple[str, str]], measure: str) -> Column:
    """The rule of the longest suffix that fits; it applies only if its stem has the measure."""
    out = word
    for suffix, other in sorted(rules, key=lambda r: len(r[0])):
        stem = F.left(word, F.length(word) - len(suffix))
        out = F.when(word.endswith(suffix), F.when(stem.rlike(measure), F.concat(stem, F.lit(other))).otherwise(word)).otherwise(out)
    return out


def stem_steps() -> list:
    """The steps of Porter's algorithm, each from word Column to word Column."""

    def step1a(w):
        cut = lambda n: F.left(w, F.length(w) - n)
        return F.when(w.endswith("sses"), cut(2)).when(w.endswith("ies"), cut(2)).when(w.endswith("ss"), w).when(w.endswith("s"), cut(1)).otherwise(w)

    def step1b(w):
        cut = lambda n: F.left(w, F.length(w) - n)

        def mended(s):
            double = s.rlike(r"([^aeiouylsz])\1$")
            short = s.rlike(_JUST1) & s.rlike(_CVC)
            return F.when(s.rlike("(at|bl|iz)$"), F.concat(s, F.lit("e"))).when(double, F.left(s, F.length(s) - 1)).when(short, F.concat(s, F.lit("e"))).otherwise(s)

        return (
            F.when(w.endswith("eed"), F.when(cut(3).rlike(_M1), cut(1)).otherwise(w))
            .when(w.endswith("ed") & cut(2).rlike(_HAS_VOWEL), mended(cut(2)))
            .when(w.endswith("ing") & cut(3).rlike(_HAS_VOWEL), mended(cut(3)))
            .otherwise(w)
        )

    def step1c(w):
        stem = F.left(w, F.length(w) - 1)
        return F.when(F.lower(w).endswith("y") & stem.rlike(_HAS_VOWEL), F.concat(stem, F.lit("i"))).otherwise(w)

    def step4(w):
        out = _by_suffix(w, [(s, "") for s in _STEP4], _M2)
        ion = F.left(w, F.length(w) - 3)
        return F.when(w.endswith("ion"), F.when(ion.rlike(_M2) & ion.rlike("[st]$"), ion).otherwise(w)).otherwise(out)

    def step5(w):
        stem = F.left(w, F.length(w) - 1)
        dropped = stem.rlike(_M2) | (stem.rlike(_JUST1) & ~stem.rlike(_CVC))
        w = F.when(w.endswith("e") & dropped, stem).otherwise(w)
        return F.when(w.rlike(_M2) & w.endswith("ll"), F.left(w, F.length(w) - 1)).otherwise(w)

    return [step1a, step1b, step1c, lambda w: _by_suffix(w, _STEP2, _M1), lambda w: _by_suffix(w, _STEP3, _M1), step4, step5]


def stemmed(df: DataFrame, word: str, stem: str = "stem") -> DataFrame:
    """Adds the Porter stem of a column of lower-case words; words of up to two letters and others stay.

    Meant for a table of distinct words. Each step is a lambda over a one-element array: so its
    input is evaluated once, however often the step names it.
    """
    marked = F.regexp_replace(F.regexp_replace(F.col(word), "^y", "Y"), "([aeiou])y", "$1Y")
    fits = F.col(word).rlike("^[a-z]{3,}$")
    found = reduce(lambda w, step: F.transform(F.array(w), step)[0], stem_steps(), marked)
    return df.withColumn(stem, F.when(fits, F.lower(found)).otherwise(F.col(word)))


def cut_bytes(text: Column, most: int) -> Column:
    """At most ``most`` bytes of UTF-8, ended before a character that does not fit, then '...'."""
    data = F.encode(text, "utf-8")
    tries = [F.try_validate_utf8(F.substring(data, 1, n).cast("string")) for n in range(most, max(0, most - 4), -1)]
    return F.when(text.isNull() | (F.octet_length(text) <= most), text).otherwise(F.concat(F.coalesce(*tries, F.lit("")), F.lit("...")))


def last_segment(path: Column) -> Column:
    """What follows the last slash: '' after a closing slash, all of it without one."""
    return F.element_at(F.split(path, "/"), -1)


def trailing_uuid(name: Column) -> Column:
    """The last 36 characters of a name of at least so many, else null."""
    return F.when(F.length(name) >= 36, F.right(name, F.lit(36)))


def epoch_millis_text(ms: Column) -> Column:
    """RFC 3339 text of epoch milliseconds, whole seconds; 1970 for null."""
    return F.date_format(F.timestamp_seconds(F.coalesce(F.floor(ms / 1000), F.lit(0))), "yyyy-MM-dd'T'HH:mm:ssxxx")


def human_bytes(n: Column) -> Column:
    """A number of bytes to one decimal; what lies halfway goes to the even one, as in C's printf (Java's goes up)."""
    units = [("GB", 1 << 30), ("MB", 1 << 20), ("KB", 1 << 10)]
    return reduce(lambda c, u: c.when(n >= u[1], F.format_string(f"%.1f {u[0]}", F.bround(n / F.lit(float(u[1])), 1))), units, F).otherwise(F.format_string("%d B", n.cast("long")))


def short_tool(name: Column) -> Column:
    """A tool's name without the prefix of its server and without the word Tool at its end."""
    return F.regexp_replace(F.regexp_replace(name, "^mcp__[^_]+(?:_[^_]+)*__", ""), "Tool$", "")


def glob_regex(pattern: str) -> str:
    """A path glob as a regular expression: * stays inside a segment, ** does not."""
    import re

    out = ""
    for part in re.split(r"(\*\*/?|\*|\?)", pattern):
        out += {"**": ".*", "**/": "(?:.*/)?", "*": "[^/]*", "?": "[^/]"}.get(part, re.escape(part))
    return f"^{out}$"
