"""Language identification by weighted word lists, and the filters on its labels."""

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import lines, once, words

#: Words of a language that count two, and one.
WEIGHTS = {
    "de": (("der", "die", "und", "nicht", "ist", "von", "mit"), ("das", "den", "ein", "zu", "im", "für", "auf", "sich", "als", "auch")),
    "en": (("the", "and", "of", "that", "with", "was", "this"), ("to", "in", "is", "for", "as", "be", "by", "it", "from", "are")),
    "es": (("el", "los", "las", "del", "una", "por", "y"), ("la", "de", "que", "en", "se", "un", "con", "no", "su", "para")),
    "fr": (("le", "les", "des", "et", "dans", "pour", "est"), ("la", "de", "un", "une", "du", "que", "en", "sur", "au", "par")),
}


def score(parts: Column, lang: str) -> Column:
    """The weight of a list of words in one language."""
    strong, weak = (F.array(*[F.lit(w) for w in ws]) for ws in WEIGHTS[lang])
    return F.size(F.filter(parts, lambda w: F.array_contains(strong, w))) * 2 + F.size(F.filter(parts, lambda w: F.array_contains(weak, w)))


def scored(parts: Column, langs: Iterable[str] = tuple(WEIGHTS)) -> Column:
    """array<struct<score, turn, lang>>, the best language greatest; of equal ones the first by name."""
    return F.array(*[F.struct(score(parts, lang).alias("score"), F.lit(-k).alias("turn"), F.lit(lang).alias("lang")) for k, lang in enumerate(sorted(langs))])


def label(text: Column, langs: Iterable[str] = tuple(WEIGHTS)) -> Column:
    """The best language of a text; null for a null text."""
    return F.when(text.isNotNull(), once(words(text), lambda ws: F.array_max(scored(ws, langs))["lang"]))


def probabilities(text: Column, langs: Iterable[str], limit_before: bool = True) -> Column:
    """array<struct<p, turn, lang>> for `langs`: a softmax over them, or over all languages of which these are then picked."""
    use = sorted(lang for lang in langs if lang in WEIGHTS)
    over = use if limit_before else sorted(WEIGHTS)

    def softmax(s: Column) -> Column:
        top = F.greatest(*[s[lang] for lang in over]) if len(over) > 1 else s[over[0]]
        total = sum((F.exp(s[lang] - top) for lang in over), F.lit(0.0))
        return F.array(*[F.struct((F.exp(s[lang] - top) / total).alias("p"), F.lit(-k).alias("turn"), F.lit(lang).alias("lang")) for k, lang in enumerate(use)])

    return once(once(words(text), lambda ws: F.struct(*[score(ws, lang).cast("double").alias(lang) for lang in over])), softmax)


def _first_lines(text: Column, wanted: Iterable[str]) -> tuple[Column, Column, Column]:
    parts = lines(text)
    one, two = (label(F.get(parts, k)).isin(*wanted) for k in (0, 1))
    return F.size(parts) > 1, one, two


def both_lines(text: Column, wanted: Iterable[str]) -> Column:
    """The first line is in a wanted language, and so is the second if there is one."""
    more, one, two = _first_lines(text, wanted)
    return F.coalesce(one & (~more | two), F.lit(False))


def either_line(text: Column, wanted: Iterable[str]) -> Column:
    """One of the first two lines is in a wanted language."""
    more, one, two = _first_lines(text, wanted)
    return F.coalesce(one | (more & two), F.lit(False))


def most_lines(text: Column, wanted: Iterable[str]) -> Column:
    """More than half of the lines that aren't blank are in a wanted language."""
    full = F.filter(lines(text), lambda x: F.rlike(x, F.lit(r"\S")))
    # each line is cut once, before it is scored for every language
    good = F.filter(F.transform(full, words), lambda ws: F.array_max(scored(ws))["lang"].isin(*wanted))
    return F.coalesce((F.size(full) > 0) & (F.size(good) * 2 > F.size(full)), F.lit(False))


def either_in_both(one: Column, first: Iterable[str], other: Column, second: Iterable[str]) -> Column:
    """One of the first two lines of each of two texts is in its wanted language."""
    return either_line(one, first) & either_line(other, second)
