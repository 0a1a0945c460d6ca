"""Text expressions. All are built-in Spark functions, so they stay in generated code."""

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word: letters, digits and underscores of any script.
WORD = r"[\p{L}\p{N}_]+"
#: What belongs to a word for correction: also apostrophes, backticks and the marked e.
EDGE = r"[^\p{L}\p{N}_'`êÊ]*"


def once(c: Column, of: Callable[[Column], Column]) -> Column:
    """What `of` makes of a value that it uses in several places, and that is computed once."""
    return F.get(F.transform(F.array(c), of), F.lit(0))


def strip(c: Column) -> Column:
    """Without white space at both ends (Spark's trim takes spaces only)."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def is_blank(c: Column) -> Column:
    """True for null, empty and white space."""
    return c.isNull() | ~F.rlike(c, F.lit(r"\S"))


def words(c: Column) -> Column:
    """Words in lower case, in order."""
    return F.regexp_extract_all(F.lower(c), F.lit(WORD), F.lit(0))


def tokens(c: Column) -> Column:
    """What stands between white space."""
    return F.filter(F.split(c, r"\s+"), lambda x: x != "")


def ngrams(parts: Column, n: int) -> Column:
    """Runs of n parts joined by a space; none if there are fewer parts."""
    if n == 1:
        return parts
    starts = F.when(F.size(parts) >= n, F.sequence(F.lit(1), F.size(parts) - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(parts, i, n), " "))


def lines(c: Column) -> Column:
    return F.split(c, "\n")


def has_any(c: Column, parts: Iterable[str]) -> Column:
    """Whether the lower-cased text has any of the substrings, inside words too."""
    return F.exists(F.array(*[F.lit(p) for p in parts]), lambda p: F.contains(F.lower(c), p))


def between_tags(c: Column, opening: str, closing: str) -> Column:
    """What is behind the last opening tag and before the first closing tag after it."""
    return F.substring_index(F.substring_index(c, opening, -1), closing, 1)


def leading_symbols(c: Column) -> Column:
    return F.regexp_extract(c, f"^({EDGE})", 1)


def trailing_symbols(c: Column) -> Column:
    return F.regexp_extract(c, f"({EDGE})$", 1)


def clean_word(c: Column) -> Column:
    return F.regexp_replace(c, EDGE[:-1], "")


def file_stem(c: Column) -> Column:
    """A name fit for a file: the last part of a path, other characters as dashes."""
    return F.regexp_replace(F.regexp_extract(F.rtrim(c, F.lit("/")), r"([^/]*)$", 1), r"[^A-Za-z0-9_.-]+", "-")


def checkpoint_step(c: Column) -> Column:
    """The number of a checkpoint's name; null for other names."""
    return F.try_to_number(F.nullif(F.regexp_extract(c, r"checkpoint-(\d+)$", 1), F.lit("")), F.lit("9999999999")).cast("long")


def checkpoint_order(c: Column) -> list[Column]:
    """Orders checkpoints: names without a step, as that of the final one, first, then by step."""
    return [checkpoint_step(c).asc_nulls_first(), c.asc()]


def valid_content(c: Column) -> Column:
    """More than ten tokens, and no description of a picture."""
    return ~F.startswith(c, F.lit("The image")) & (F.size(tokens(c)) > 10)


def first_present(names: Iterable[str], preferred: Iterable[str]) -> str | None:
    """The column that holds a table's text: `text`, else the first of the preferred that is there, else the only one."""
    names = list(names)
    for name in ("text", *preferred):
        if name in names:
            return name
    return names[0] if len(names) == 1 else None
