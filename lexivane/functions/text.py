"""Text functions as Spark expressions, all within the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Every character that ``str.isspace`` holds for.
WHITESPACE = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
#: English function words; a query's words that equal one are left out.
STOPWORDS = tuple(
    """i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself yourselves he him his himself she she's her hers herself it it's its
    itself they them their theirs themselves what which who whom this that that'll these those am is are was were be been being have has had having do does did doing
    a an the and but if or because as until while of at by for with about against between into through during before after above below to from up down in out on off
    over under again further then once here there when where why how all any both each few more most other some such no nor not only own same so than too very s t
    can will just don don't should should've now d ll m o re ve y ain aren aren't couldn couldn't didn didn't doesn doesn't hadn hadn't hasn hasn't haven haven't isn
    isn't ma mightn mightn't mustn mustn't needn needn't shan shan't shouldn shouldn't wasn wasn't weren weren't won won't wouldn wouldn't""".split()
)


def _parts(text: Column) -> Column:
    spaced = F.translate(F.coalesce(text.cast("string"), F.lit("")), WHITESPACE, " " * len(WHITESPACE))
    return F.filter(F.split(spaced, " "), lambda w: w != "")


def tokens(text: Column) -> Column:
    """Lower-case words between white space, punctuation and all; none of a null or empty text."""
    return _parts(F.lower(text))


def drop_stopwords(text: Column, stopwords: Sequence[str] = STOPWORDS) -> Column:
    """The text's words, case kept, without those that equal a stop word, one blank between them; empty for a null."""
    return F.array_join(F.filter(_parts(text), lambda w: ~w.isin(*stopwords)) if stopwords else _parts(text), " ")


def strip(text: Column) -> Column:
    """The text without white space at its ends."""
    return F.trim(F.btrim(text, F.lit(WHITESPACE)))


def combined(columns: Sequence[str], present: Sequence[str]) -> Column:
    """A row's text columns in one: all but ``id`` and ``encoded_data``, in order, a blank between them.

    A null reads ``None``; a column that isn't ``present`` reads as nothing.
    """
    use = [c for c in columns if c not in ("id", "encoded_data")]
    return F.concat_ws(" ", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("None")) if c in present else F.lit("") for c in use]) if use else F.lit("")


def url_title(url: Column) -> Column:
    """What follows the last slash, query and fragment too; empty after a slash at the end."""
    return F.element_at(F.split(url, "/", -1), -1)


def file_table(path: Column) -> Column:
    """``file_`` and the base name without its last extension."""
    name = F.element_at(F.split(path, "/", -1), -1)
    return F.concat(F.lit("file_"), F.regexp_replace(name, r"(?<=[^.])\.[^.]*$", ""))


def preview(text: Column, n: int) -> Column:
    """The first ``n`` characters and ``...``, or ``N/A`` where there are none."""
    return F.when(F.length(text) > 0, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(F.lit("N/A"))
