"""Text cleaning and simple text analysis as column expressions (no Python rows).

Spark's ``\\w`` and ``\\b`` are ASCII; where other letters matter the classes are
written out.  Python's strip() removes all white space, so trimming is a regex.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

#: What a regular expression's \\s is.
SPACES = " \t\n\x0b\x0c\r"

# The characters that OCR confuses, and what they stand for.
OCR_FROM = "ēōāūǎǔǒīĒŌĀŪǍǓǑĪ"
OCR_TO = "êôâưăủỏịÊÔÂƯĂỦỎỊ"
# Typographic ligatures and quotes that expand to more than one character.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st", "Ĳ": "IJ", "ĳ": "ij", "—": "--", "…": "..."}
# Quotes, dashes and the no-break space that become one ASCII character.
QUOTES_FROM = "‘’‚‛“”„‟″′«»‹›– "
QUOTES_TO = "''''\"\"\"\"\"'\"\"''- "
INVISIBLE = "[­​-‏﻿·⁠-⁤]"
# Lines that are page furniture.
PAGE_NUMBER = r"(?m)^[\t ]*(?:Page\s+\d+\s+of\s+\d+|Page\s+\d+|\d+\s*/\s*\d+|[-–]\s*\d+\s*[-–]|\[\s*\d+\s*\])[\t ]*$"
COPYRIGHT = r"(?im)^[^\n]*(?:©|Copyright\s+\d{4}|All\s+rights\s+reserved|Permission\s+to\s+(?:make|copy|reproduce)|Licensed\s+under|This\s+work\s+is\s+licensed|Creative\s+Commons)[^\n]*$"
PREPRINT = r"(?im)^[^\n]*(?:Preprint[.\s]|Under\s+review|Submitted\s+to|arXiv:\d{4}\.\d+|DRAFT[:\s]|Confidential[:\s])[^\n]*$"
LONE_URL = r"(?m)^[\t ]*https?://\S+[\t ]*$"
LONE_EMAIL = r"(?m)^[\t ]*[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+\.[A-Za-z0-9_.]+[\t ]*$"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def squeeze(c: Column) -> Column:
    """Every run of white space one space, ends trimmed, lower case."""
    return strip(F.regexp_replace(F.lower(c), r"\s+", " "))


def fix_ocr_diacritics(c: Column) -> Column:
    return F.translate(c, OCR_FROM, OCR_TO)


def _where(c: Column, marks: tuple[str, ...], change: Callable[[Column], Column]) -> Column:
    """The text changed where one of the strings stands in its lower case: a plain search spares most texts the pattern.

    The text and its lower case are bound once, so that chains of such steps stay as long as they are.
    """

    def one(text: Column) -> Column:
        found = F.exists(F.array(F.lower(text)), lambda low: reduce(lambda x, m: x | F.contains(low, F.lit(m)), marks[1:], F.contains(low, F.lit(marks[0]))))
        return F.when(found, change(text)).otherwise(text)

    return F.transform(F.array(c), one)[0]


@F.pandas_udf(StringType())
def compose(texts: pd.Series) -> pd.Series:
    """Canonical composition (NFC) of whole texts."""
    return texts.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFC", t))


def normalize_unicode(c: Column) -> Column:
    """Confused diacritics, ligatures, quotes and invisible characters, for text in composed form (see :func:`compose`)."""
    plain = F.translate(c, OCR_FROM + QUOTES_FROM, OCR_TO + QUOTES_TO)
    expanded = reduce(lambda x, pair: F.replace(x, F.lit(pair[0]), F.lit(pair[1])), LIGATURES.items(), plain)
    return F.regexp_replace(expanded, INVISIBLE, "")


def dehyphenate(c: Column) -> Column:
    return _where(c, ("-\n",), lambda x: F.regexp_replace(x, r"([\p{L}\p{N}_])-\n\s*([\p{L}\p{N}_])", "$1$2"))


def remove_artifacts(c: Column, aggressive: bool = False) -> Column:
    joined = dehyphenate(c)
    if aggressive:
        joined = F.regexp_replace(joined, r"([a-z,])\n([a-z(])", "$1 $2")
    return F.replace(joined, F.lit("\t"), F.lit(" "))


#: What a line of each kind of furniture holds at least.
_SIGNS = {COPYRIGHT: ("©", "copyright", "reserved", "permission", "licensed", "creative"), PREPRINT: ("preprint", "review", "submitted", "arxiv:", "draft", "confidential"), LONE_URL: ("http",), LONE_EMAIL: ("@",)}


def remove_boilerplate(c: Column, aggressive: bool = False) -> Column:
    patterns = [PAGE_NUMBER, COPYRIGHT, PREPRINT, *([LONE_URL, LONE_EMAIL] if aggressive else [])]

    def without(x: Column, p: str) -> Column:
        return _where(x, _SIGNS[p], lambda y: F.regexp_replace(y, p, "")) if p in _SIGNS else F.regexp_replace(x, p, "")

    return reduce(without, patterns, c)


def normalize_whitespace(c: Column, multiline: bool = True) -> Column:
    out = F.regexp_replace(c, r"[ \t][ \t]+", " ")
    if multiline:
        out = _where(out, ("\n\n\n",), lambda x: F.regexp_replace(x, r"\n{3,}", "\n\n"))
    return strip(out)


def clean_text(c: Column, aggressive: bool = False) -> Column:
    """The cleaning pipeline: characters, line artefacts, furniture, white space."""
    return normalize_whitespace(remove_boilerplate(remove_artifacts(normalize_unicode(c), aggressive), aggressive))


def clean_heading(c: Column) -> Column:
    return normalize_whitespace(normalize_unicode(c), multiline=False)


def drop_lines(c: Column, furniture: Column) -> Column:
    """The text without the lines that, stripped, are in the array ``furniture``."""
    return F.array_join(F.filter(F.split(c, "\n"), lambda x: ~F.array_contains(furniture, strip(x))), "\n")


def tokens(c: Column) -> Column:
    """Runs of letters, digits and underscores of the lower-cased text."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{N}_]+)"), 1)


def count_of(c: Column, needle: Column) -> Column:
    """Occurrences of ``needle`` that do not overlap, in lower case."""
    low = F.lower(c)
    return ((F.length(low) - F.length(F.replace(low, F.lower(needle), F.lit("")))) / F.length(needle)).cast("long")


def sentences(c: Column) -> Column:
    """Split after . ! or ? followed by white space."""
    marked = F.regexp_replace(strip(c), r"([.!?])\s+", "$1\u0001")
    return F.filter(F.split(marked, "\u0001"), lambda x: x != "")


def lead_summary(c: Column, max_sentences: int = 6, max_chars: int = 900) -> Column:
    """The first sentences, joined by a space, while their length with separators stays within ``max_chars``."""
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(0).alias("n"), F.lit(False).alias("over"))

    def add(acc: Column, s: Column) -> Column:
        full = acc["over"] | ((acc["n"] + F.length(s)) > max_chars)
        return F.struct(
            F.when(full, acc["kept"]).otherwise(F.array_append(acc["kept"], s)).alias("kept"),
            F.when(full, acc["n"]).otherwise(acc["n"] + F.length(s) + 1).alias("n"),
            full.alias("over"),
        )

    return F.array_join(F.aggregate(F.slice(sentences(c), 1, max_sentences), start, add, lambda acc: acc["kept"]), " ")


def fixed_chunks(c: Column, size: int, overlap: int) -> Column:
    """Sliding chunks; the last is the first that reaches the end."""
    step = max(1, size - overlap)
    n = F.length(c)
    last = F.greatest(F.ceil((n - size) / step), F.lit(0)).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(c, i * step + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def mojibake_ratio(c: Column) -> Column:
    """Share of wrongly decoded characters plus 2.2 times what Latin-1 letters exceed other letters by, at most 1."""
    compact = F.regexp_replace(c, r"\s", "")
    n = F.length(compact)

    def share(pattern: str) -> Column:
        return (n - F.length(F.regexp_replace(compact, pattern, ""))) / n

    excess = F.greatest(F.lit(0.0), share("[À-ÿ]") - share("[^\u0000-ÿ]"))
    return F.when(n > 0, F.least(F.lit(1.0), share("[ÃÂÐÑ�]") + 2.2 * excess)).otherwise(0.0)


# What is taken off both ends of a token, wrongly decoded letters, and vowels of a word's lower case.
_EDGES = ".,;:!?\"'()[]{}<>|`~"
_WRONG = re.compile("[ÃÂÐÑ�]")
_VOWEL = re.compile("[aeiouyàáâãäåèéêëìíîïòóôõöùúûüýăđơưạ-ỹ]")
_LATIN1 = re.compile("[À-ÿ]")
_BREAKS = re.compile(f"[{SPACES}]+")


def _noisy(token: str) -> bool:
    """Looks like an OCR or encoding error."""
    bare = token.strip(_EDGES)
    n = len(bare)
    if not n:
        return False
    if _WRONG.search(bare) or len(_LATIN1.findall(bare)) >= 2:
        return True
    letters = sum(map(str.isalpha, bare))
    if not letters:
        return False
    digits = sum(unicodedata.category(x)[0] == "N" for x in bare)
    return (n - letters - digits) / n > 0.35 or (n >= 8 and not _VOWEL.search(bare.lower()))


#: Judged tokens that a worker keeps; a bound on memory only.
_JUDGED_MOST = 200_000
_judged: dict[str, bool] = {}


@F.pandas_udf(DoubleType())
def noisy_ratio(texts: pd.Series) -> pd.Series:
    """Share of tokens that look like errors; each distinct token is judged once."""

    def share(text: str | None) -> float | None:
        if text is None:
            return None
        found = [t for t in _BREAKS.split(text) if t]
        bad = 0
        for t in found:
            known = _judged.get(t)
            if known is None:
                if len(_judged) >= _JUDGED_MOST:
                    _judged.clear()
                known = _judged[t] = _noisy(t)
            bad += known
        return bad / len(found) if found else 0.0

    return texts.map(share).astype("float64")


def ocr_score(mojibake: Column, noisy: Column) -> Column:
    return 0.7 * mojibake + 0.3 * noisy


def escape_query(c: Column) -> Column:
    """A backslash before every character that full-text query syntax gives a meaning."""
    return F.regexp_replace(c, r'([+\-&|!(){}\[\]^"~*?:\\/])', r"\\$1")


def entity_key(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"[-_\s]", ""))


def _bases() -> tuple[dict[str, str], dict[str, str]]:
    """Characters whose compatibility decomposition without marks is one other character, or several; marks map to nothing."""
    one, more = {}, {}
    for code in [*range(0xA0, 0x370), *range(0x1E00, 0x2000), *range(0xFB00, 0xFB07)]:
        char = chr(code)
        base = "".join(x for x in unicodedata.normalize("NFKD", char) if not unicodedata.combining(x))
        if unicodedata.combining(char) or (base != char and len(base) == 1):
            one[char] = base
        elif base != char and base.strip() == base and len(base) > 1 and base.isalpha():
            more[char] = base
    return one, more


_ONE, _MORE = _bases()
_MARKED = "".join(sorted(_ONE, key=lambda x: not _ONE[x]))  # those that map to nothing last


def strip_accents(c: Column) -> Column:
    """Latin, Greek and Vietnamese letters without their marks; loose marks go, ligatures are written out."""
    plain = F.translate(c, _MARKED, "".join(_ONE[x] for x in _MARKED))
    return F.when(c.rlike(f"[{''.join(_MORE)}]"), reduce(lambda x, pair: F.replace(x, F.lit(pair[0]), F.lit(pair[1])), _MORE.items(), plain)).otherwise(plain)


def normal_name(c: Column) -> Column:
    return squeeze(strip_accents(c))
