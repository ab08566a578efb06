"""Python-``re`` semantics on Java regexes.

Python's ``\\w \\d \\s \\b`` are Unicode-aware for str patterns; Java's are ASCII
unless told otherwise, and ``(?U)`` disagrees with Python on combining marks
(Devanagari vowel signs are non-word characters in Python). The classes below
reproduce Python's behaviour, and every pattern in the library goes through
``py()`` so the dialect is fixed in one place.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python \w: letters, numbers (Nd, Nl, No) and underscore.
W = r"\p{L}\p{N}_"
# Python \s: str.isspace() characters.
S = r"\s\p{Z}\x{85}\x{1c}-\x{1f}"

WORD = f"[{W}]"
NONWORD = f"[^{W}]"
SPACE = f"[{S}]"
DIGIT = r"\p{Nd}"
BOUNDARY = f"(?:(?<=[{W}])(?![{W}])|(?<![{W}])(?=[{W}]))"
# Python [^\w\s]
SPECIAL = f"[^{W}{S}]"


def py(pattern: str, ignore_case: bool = False) -> str:
    """Rewrite a Python pattern that uses \\b \\d \\s \\w outside classes."""
    out = (pattern.replace(r"\b", BOUNDARY)
           .replace(r"\d", DIGIT)
           .replace(r"\s", SPACE)
           .replace(r"\w", WORD))
    return ("(?iu)" + out) if ignore_case else out


def strip(c: Column) -> Column:
    """Python ``str.strip()`` (Spark ``trim`` only cuts plain spaces)."""
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def squeeze(c: Column) -> Column:
    """``re.sub(r'\\s+', ' ', x).strip()``."""
    return strip(F.regexp_replace(c, f"{SPACE}+", " "))


def split_words(c: Column) -> Column:
    """Python ``str.split()`` on an already stripped string ('' gives [''])."""
    return F.split(c, f"{SPACE}+")


def quote(c: Column) -> Column:
    """``re.escape`` for a column value used inside a pattern (\\Q...\\E)."""
    return F.concat(F.lit(r"\Q"), F.replace(c, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
