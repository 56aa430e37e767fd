"""How numbers, durations and words are shown, in SQL and on a terminal."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STYLES = {"bold": 1, "dim": 2, "red": 31, "green": 32, "yellow": 33, "blue": 34}


def styled(text: str, style: str, on: bool = True) -> str:
    """text in a style of the terminal; plain where `on` is false."""
    return f"\x1b[{STYLES[style]}m{text}\x1b[0m" if on else text


def thousands(n: Column) -> Column:
    """A whole number with commas."""
    return F.format_number(n, 0)


def plural(word: Column) -> Column:
    """The English plural, by the end of the word."""
    hiss = word.rlike("(s|x|ch|sh)$")
    soft = word.rlike("..*[^aeiou]y$") & (F.length(word) > 2)
    return F.when(hiss, F.concat(word, F.lit("es"))).when(soft, F.concat(F.regexp_replace(word, "y$", ""), F.lit("ies"))).otherwise(F.concat(word, F.lit("s")))


def duration(ms: Column) -> Column:
    """Whole milliseconds below a second, seconds with a tenth below a minute, then minutes and seconds."""
    s = ms / 1000
    whole = lambda x: F.round(x, 0).cast("long").cast("string")
    long = F.concat(F.floor(s / 60).cast("string"), F.lit("m "), whole(F.pmod(s, F.lit(60))), F.lit("s"))
    return F.when(ms < 1000, F.concat(whole(ms), F.lit("ms"))).when(s < 60, F.concat(F.format_number(s, 1), F.lit("s"))).otherwise(long)
