"""Tokens and stop words."""

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}"

# The default English stop words of Spark ML's StopWordsRemover, without the ones that
# hold an apostrophe (a token never does) or a single letter. Pass another list where one is wanted.
ENGLISH_STOP_WORDS = """
me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers
herself it its itself they them their theirs themselves what which who whom this that these those am is
are was were be been being have has had having do does did doing an the and but if or because as until
while of at by for with about against between into through during before after above below to from up
down in out on off over under again further then once here there when where why how all any both each
few more most other some such no nor not only own same so than too very can will just don should now
could would ought cannot
""".split()


def tokens(text: Column) -> Column:
    """Lower-case word tokens of two or more characters."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"({TOKEN_PATTERN})"), F.lit(1))


def is_stop_word(term: Column, stop_words: Iterable[str]) -> Column:
    words = list(stop_words)
    return term.isin(words) if words else F.lit(False)


def name_list(packed: Column, separator: str = ",") -> Column:
    """Split a comma-packed string into trimmed names; NULL gives an empty list."""
    return F.transform(F.split(F.coalesce(packed, F.lit("")), separator), lambda x: F.trim(x))


MISSING_TOKENS = ["Unknown", "N/A", ""]


def known_names(packed: Column) -> Column:
    """Distinct trimmed names of a comma-packed string without the missing markers."""
    return F.array_distinct(F.filter(name_list(packed), lambda x: ~x.isin(MISSING_TOKENS)))
