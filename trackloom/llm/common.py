"""Helpers shared by the text operators: words, let-bindings, and the library's storage and components."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.operators.components import components  # noqa: F401
from trackloom.storage import forget, fresh_path, shared_dir, written  # noqa: F401

#: White space for words; everything else belongs to a word.
SPACES = " \t\n\x0b\f\r"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once for ``body``; a plain reuse would evaluate it at each mention."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """The words of a text in order; none for a null or blank text. Splitting at one plain
    character is several times faster than at a pattern, so the pattern is left to texts
    with runs of white space."""
    flat = F.coalesce(text, F.lit(""))
    for c in SPACES[1:]:
        flat = F.replace(flat, F.lit(c), F.lit(" "))
    cut = lambda t: F.when(t == "", F.array().cast("array<string>")).when(F.contains(t, F.lit("  ")), F.split(t, " +")).otherwise(F.split(t, " "))
    return let(F.btrim(flat), cut)


def free_name(df: DataFrame, *stems: str) -> list[str]:
    """Column names that ``df`` doesn't have, whatever the letter case."""
    taken = {c.lower() for c in df.columns}
    found = []
    for stem in stems:
        name = f"__{stem}"
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        found.append(name)
    return found
