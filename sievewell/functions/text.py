"""Text expressions: words, windows, sentences, tokens, snippets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}_]+"


def strip(c: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def words(c: Column) -> Column:
    """Words between runs of Unicode white space."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), r"(?U)\s+"), lambda w: w != "")


def check_window(size: int, overlap: int) -> None:
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError(f"a window of {size} words can't overlap by {overlap}")


def word_windows(w: Column, size: int, overlap: int) -> Column:
    """Windows of ``size`` words, ``size - overlap`` apart, up to the first that reaches the end. w is an array of words."""
    check_window(size, overlap)
    step, n = size - overlap, F.size(w)
    count = F.when(n == 0, 0).otherwise(F.greatest(F.lit(0), F.ceil((n - size) / step)) + 1).cast("int")
    starts = F.filter(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), lambda i: i < count)
    return F.transform(starts, lambda i: F.array_join(F.slice(w, i * step + 1, size), " "))


def sentences(c: Column) -> Column:
    """Parts that end in . ! ? or an ideographic full stop before white space, or before a blank line; stripped, none empty."""
    parts = F.split(F.coalesce(c, F.lit("")), r"(?U)(?<=[.!?。])\s+|\n{2,}")
    return F.filter(F.transform(parts, strip), lambda s: s != "")


def tokens(c: Column) -> Column:
    """Lower-cased runs of letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(c), F.lit(TOKEN), 0)


def mixed_word_count(c: Column) -> Column:
    """Latin words, and Thai characters at four a word (rounded half to even)."""
    return F.regexp_count(c, F.lit("[A-Za-z0-9]+")) + F.bround(F.regexp_count(c, F.lit("[฀-๿]")) / 4).cast("int")


def snippet(c: Column, limit: int = 240) -> Column:
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit), F.lit("…"))).otherwise(c)


def normal_name(c: Column) -> Column:
    """Key of an entity: stripped, lower-cased, inner white space as one space."""
    return F.regexp_replace(F.lower(strip(c)), r"(?U)\s+", " ")


def hits(c: Column, terms: tuple[str, ...]) -> Column:
    """The terms that the text contains, in their order."""
    return F.filter(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(c, t))


def hit_any(c: Column, terms: tuple[str, ...]) -> Column:
    return F.coalesce(F.lower(c), F.lit("")).rlike("|".join(_quoted(t) for t in terms))


def _quoted(t: str) -> str:
    return "".join("\\" + x if x in "\\^$.|?*+()[]{}-" else x for x in t)
