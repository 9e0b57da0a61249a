"""Text normalisation and scalar expressions, all as Spark columns. Offsets are code points, 0-based, half-open."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that a French note and any note at inference keep, and rules of word replacement, in their order.
FRENCH_KEPT = r"0-9A-Za-zÀ-ÖØ-öø-ÿœŒæÆ\s.,:\/\-'"
INFER_KEPT = r"a-zA-Z\s.,:"
REPLACEMENTS = ((",", ""), (" and ", " with "), (" with ", " and "), (" valve ", " "), (" of ", " of the "))
STOP_WORDS = "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split()


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def normalize_term(text) -> Column:
    """Lower case; everything but a-z and 0-9 becomes one space; trimmed."""
    return F.trim(F.regexp_replace(F.lower(_c(text)), "[^a-z0-9]+", " "))


def normalize_keep_len(text) -> Column:
    """Lower case with every other character replaced by one space, so that offsets stay."""
    return F.regexp_replace(F.lower(_c(text)), "[^a-z0-9]", " ")


def letters_only(text) -> Column:
    """Lower case, a-z alone; spaces go too."""
    return F.regexp_replace(F.lower(_c(text)), "[^a-z]", "")


def process_term(text) -> Column:
    """Lower case, cut one character before the last bracket, drop up to the first ']', trimmed."""
    low = F.lower(_c(text))
    at = F.length(low) - F.locate("(", F.reverse(low)) + 1  # 1-based place of the last bracket
    head = F.when(F.locate("(", low) == 0, low).when(at >= 2, F.substring(low, F.lit(1), at - 2)).otherwise(F.substring(low, F.lit(1), F.length(low) - 1))
    close = F.locate("]", head)
    return F.trim(F.when(close > 0, F.substring(head, close + 1, F.length(head))).otherwise(head))


def collapse_ws(text) -> Column:
    """Null becomes empty; runs of Unicode white space become one space; trimmed."""
    return F.trim(F.regexp_replace(F.coalesce(_c(text), F.lit("")), r"(?U)\s+", " "))


def mention_key(text) -> Column:
    """Lower case and collapsed white space."""
    return collapse_ws(F.lower(_c(text)))


def french_clean(text) -> Column:
    """Length-preserving: characters outside the French set become spaces."""
    return F.regexp_replace(_c(text), f"[^{FRENCH_KEPT}]", " ")


def infer_clean(text) -> Column:
    """Length-preserving cleaning at inference: digits and slashes become spaces too."""
    return F.regexp_replace(_c(text), f"[^{INFER_KEPT}]", " ")


@lru_cache
def keeping(kept: str) -> Callable[[str], str]:
    """The same inside a task: a text whose characters outside the class `kept` become spaces, by one look into a table for all."""
    stays = np.zeros(0x110000, bool)
    stays[[ord(c) for c in re.findall(f"[{kept}]", "".join(map(chr, range(0xD800))) + "".join(map(chr, range(0xE000, 0x110000))), re.ASCII)]] = True

    def clean(text: str) -> str:
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        return np.where(stays[points], points, np.uint32(32)).astype("<u4").tobytes().decode("utf-32-le")

    return clean


def train_clean(text) -> Column:
    """Length-preserving cleaning for training, which keeps digits and slashes."""
    return F.regexp_replace(_c(text), r"[^a-zA-Z0-9\s.,:\/]", " ")


def slice_text(text, start, end) -> Column:
    """text[start:end]."""
    return F.substring(_c(text), _c(start) + 1, _c(end) - _c(start))


def levenshtein_similarity(a, b) -> Column:
    """1 - distance / longer length of the trimmed lower-cased strings; 1 for equal ones, 0 if one is empty. Not rounded."""
    x, y = (F.trim(F.lower(F.coalesce(_c(v), F.lit("")))) for v in (a, b))
    far = 1 - F.levenshtein(x, y) / F.greatest(F.length(x), F.length(y))
    return F.when(x == y, F.lit(1.0)).when((x == "") | (y == ""), F.lit(0.0)).otherwise(far)


def term_name(text) -> Column:
    """The part of "Name (type)" before the type."""
    found = F.regexp_extract(_c(text), r"^(.*) \(([^()]*)\)$", 1)
    return F.when(found == "", F.trim(_c(text))).otherwise(found)


def term_type(text) -> Column:
    """The type of "Name (type)", or Unknown."""
    found = F.regexp_extract(_c(text), r"^(.*) \(([^()]*)\)$", 2)
    return F.when(found == "", F.lit("Unknown")).otherwise(found)


def hierarchy_of(term) -> Column:
    """The semantic type in brackets at a term's end; null without one."""
    found = F.regexp_extract(_c(term), r"(?U)\((\w+\s?.?\s?\w+.?\w+.?\w+.?)\)$", 1)
    return F.when(found != "", found)


def single_space_offset(text, pos) -> Column:
    """Where pos lands when every run of spaces before it is one space."""
    before = F.substring(_c(text), F.lit(1), _c(pos))
    return _c(pos) - (F.length(before) - F.length(F.regexp_replace(before, " +", " ")))


def first_non_empty(*columns) -> Column:
    """The first value that isn't null, blank or "nan", trimmed; else empty."""
    valid = [F.when(_c(c).isNotNull() & (F.trim(_c(c)) != "") & (F.lower(F.trim(_c(c))) != "nan"), F.trim(_c(c))) for c in columns]
    return F.coalesce(*valid, F.lit(""))


def one_line(text) -> Column:
    """Line ends become a backslash and n, tabs a space."""
    return F.replace(F.regexp_replace(_c(text), r"\r\n|\r|\n", r"\\n"), F.lit("\t"), F.lit(" "))


def restore_lines(text) -> Column:
    """The inverse for line ends; null becomes empty."""
    return F.replace(F.coalesce(_c(text), F.lit("")), F.lit("\\n"), F.lit("\n"))
