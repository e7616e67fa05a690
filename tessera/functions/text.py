"""Text functions. Word characters are `[\\p{L}\\p{N}_]` and white space includes `\\p{Z}`, which is
what Unicode-aware engines agree on; Java's own `\\w` and `\\s` are narrower."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.fixed import COMMON_WORDS
from tessera.functions.scalars import col, let

SPACES = r"[\s\p{Z}]+"
WORDS = r"[\p{L}\p{N}_]+"


def collapse(text) -> Column:
    """White space runs become one space, none at the ends."""
    return F.trim(F.regexp_replace(col(text), SPACES, " "))


def words(text) -> Column:
    """Lower-case word tokens."""
    return F.regexp_extract_all(F.lower(col(text)), F.lit(WORDS), F.lit(0))


def sentences(text) -> Column:
    """Trimmed, non-blank parts between runs of `.`, `!` and `?`."""
    return F.filter(F.transform(F.split(col(text), "[.!?]+"), lambda s: F.trim(s)), lambda s: s != "")


def spaced_words(text) -> Column:
    """Parts between white space."""
    return F.filter(F.split(col(text), SPACES), lambda s: s != "")


def has_heading(text) -> Column:
    """A line of its own that begins with a capital and has no sentence end."""
    return col(text).rlike(r"\n[A-Z][^.!?]*\n")


def has_paragraphs(text) -> Column:
    return col(text).contains("\n\n")


def sanitize(text) -> Column:
    """Without tags and control characters, and only words, spaces and plain punctuation."""
    plain = F.regexp_replace(col(text), "<[^>]*>", "")
    plain = F.regexp_replace(plain, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")
    return F.trim(F.regexp_replace(plain, r"""[^\p{L}\p{N}_\s\p{Z}\-.,;!?'"]""", ""))


def strip_end_punctuation(text) -> Column:
    return F.regexp_replace(col(text), "[.,!?;:]+$", "")


def query_terms(text) -> Column:
    """Lower-case parts between white space, of more than one character."""
    return F.filter(spaced_words(F.lower(col(text))), lambda t: F.length(t) > 1)


def topic_terms(terms) -> Column:
    """Without common words; end punctuation goes after that, so an emptied term still counts."""
    stops = F.array(*map(F.lit, COMMON_WORDS))
    kept = F.filter(col(terms), lambda t: ~F.array_contains(stops, t) & (F.length(t) > 1))
    return F.transform(kept, strip_end_punctuation)


def capitalize(text) -> Column:
    return F.concat(F.upper(F.substring(col(text), 1, 1)), F.lower(F.substring(col(text), 2, 2**31 - 1)))


def ngrams(tokens, least: int = 1, most: int = 3) -> Column:
    """All runs of ``least`` to ``most`` tokens, joined by a space."""

    def of_length(t: Column, n: int) -> Column:
        made = F.transform(F.sequence(F.lit(1), F.size(t) - n + 1), lambda i: F.array_join(F.slice(t, i, n), " "))
        return F.when(F.size(t) >= n, made).otherwise(F.array().cast("array<string>"))

    def runs(t: Column) -> Column:
        return F.concat(*(of_length(t, n) for n in range(least, most + 1)))

    return let(col(tokens), runs)


def split_list(text, separator: str = ",") -> Column:
    """Trimmed, non-blank parts of a separated list."""
    return F.filter(F.transform(F.split(col(text), separator), lambda s: F.trim(s)), lambda s: s != "")


def table_text(rows) -> Column:
    """A table, array of arrays of cells, as lines of cells between bars; null cells are empty."""
    line = lambda r: F.array_join(F.transform(r, lambda c: F.coalesce(c, F.lit(""))), "|")
    return F.array_join(F.transform(col(rows), line), "\n")


def markdown_table(rows) -> Column:
    """`TABLE:` and the rows, the first set off by a rule; a single row is its cells between bars."""

    def render(t: Column) -> Column:
        line = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(r, lambda c: F.coalesce(c, F.lit(""))), " | "), F.lit(" |"))
        rule = F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), F.size(F.element_at(t, 1))))
        lines = F.concat(F.array(line(F.element_at(t, 1)), rule), F.transform(F.slice(t, 2, F.size(t)), line))
        return F.when(F.size(t) > 1, F.concat(F.lit("TABLE:\n"), F.array_join(lines, "\n"))).otherwise(F.concat(F.lit("TABLE:\n"), table_text(t)))

    return F.when(F.size(col(rows)) > 0, let(col(rows), render))
