"""Text cleaning, message stripping and tokenising as Column expressions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The characters that cleaning keeps are a-z, 0-9, dash, quote and space. NOT_KEPT names
# all the others by range, because Java matches ranges far faster than the same class negated.
NOT_KEPT = r"[\x00-\x1f!-&(-,./:-`{-\x{10ffff}]"

# Fixed values: (pattern, replacement) steps of each preset, and whether it lower-cases first.
PRESETS: dict[str, tuple[bool, tuple[tuple[str, str], ...]]] = {
    "newsgroups": (True, ((NOT_KEPT, " "), (" ---*", " "), (r"\s+", " "))),
    "reviews": (True, ((NOT_KEPT, ""), ("--", " "), (" - ", " "), (r"\s+", " "))),
    "movie_neg": (False, ((NOT_KEPT, ""), (" - ", " "), ("--", " "), (r"\s+", " "))),
    "movie_pos": (False, ((NOT_KEPT, ""), (" - ", " "))),
    "none": (False, ()),
}

# A token is a run of two or more word characters. ASCII is enough after cleaning.
ASCII_TOKEN = "[a-z0-9_]{2,}"
UNICODE_TOKEN = r"[\p{L}\p{N}_]{2,}"

# What marks a quoted line of a message, and a line that sets off a signature.
QUOTE_LINE = r"(writes in|writes:|wrote:|says:|said:|^In article|^Quoted from|^\||^>)"
RULE_LINE = r"^\s*-*\s*$"

# The common 179-word English stop-word list.
ENGLISH_STOP_WORDS: tuple[str, ...] = tuple(
    """
    i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself yourselves
    he him his himself she she's her hers herself it it's its itself they them their theirs themselves
    what which who whom this that that'll these those am is are was were be been being have has had having
    do does did doing a an the and but if or because as until while of at by for with about against between
    into through during before after above below to from up down in out on off over under again further
    then once here there when where why how all any both each few more most other some such no nor not only
    own same so than too very s t can will just don don't should should've now d ll m o re ve y ain aren
    aren't couldn couldn't didn didn't doesn doesn't hadn hadn't hasn hasn't haven haven't isn isn't ma
    mightn mightn't mustn mustn't needn needn't shan shan't shouldn shouldn't wasn wasn't weren weren't won
    won't wouldn wouldn't
    """.split()
)

CleaningRule = Callable[[Column], Column]


def clean(col: Column | str, preset: str = "reviews", rules: Sequence[CleaningRule] | None = None) -> Column:
    """Clean text by a preset, or by the caller's own list of ``Column -> Column`` rules."""
    text = F.col(col) if isinstance(col, str) else col
    if rules is not None:
        for rule in rules:
            text = rule(text)
        return text
    if preset not in PRESETS:
        raise ValueError(f"unknown cleaning preset {preset!r}, expected one of {sorted(PRESETS)}")
    lowercase, steps = PRESETS[preset]
    if lowercase:
        text = F.lower(text)
    for pattern, replacement in steps:
        text = F.regexp_replace(text, pattern, replacement)
    return text


def clean_text(
    df: DataFrame, col: str = "text", preset: str = "reviews", rules: Sequence[CleaningRule] | None = None
) -> DataFrame:
    return df.withColumn(col, clean(col, preset, rules))


def drop_empty(df: DataFrame, col: str = "text") -> DataFrame:
    """Drop rows whose text is null or has no characters; text of one space stays."""
    return df.where(F.length(col) > 0)


def strip_parts(col: Column | str, headers: bool = True, footers: bool = True, quotes: bool = True) -> Column:
    """Drop parts of a message: its header block, its quoted lines, its signature.

    Header: everything up to and including the first blank line, so a message without one is all
    header. Quotes: lines that hold a quote mark or an attribution. Footer: what follows the last
    line that is blank or made of dashes, unless that is the first line or there is none.
    """
    text = F.col(col) if isinstance(col, str) else col
    if headers:
        blank = F.instr(text, "\n\n")
        text = F.when(blank > 0, F.substr(text, blank + 2)).when(text.isNotNull(), "")
    if quotes:
        text = F.array_join(F.filter(F.split(text, "\n"), lambda line: ~line.rlike(QUOTE_LINE)), "\n")
    if footers:
        lines = F.split(F.btrim(text, F.lit(" \t\n\r\x0b\x0c")), "\n")
        rules = F.transform(lines, lambda line: line.rlike(RULE_LINE))
        from_end = F.array_position(F.reverse(rules), True)
        kept = F.size(lines) - from_end
        text = F.when((from_end > 0) & (kept > 0), F.array_join(F.slice(lines, F.lit(1), kept.cast("int")), "\n")).otherwise(text)
    return text


def strip_message_parts(
    df: DataFrame, col: str = "text", headers: bool = True, footers: bool = True, quotes: bool = True
) -> DataFrame:
    return df.withColumn(col, strip_parts(col, headers, footers, quotes))


def tokens(col: Column | str, pattern: str = UNICODE_TOKEN) -> Column:
    """Lower-cased tokens in text order."""
    return F.regexp_extract_all(F.lower(col), F.lit(pattern), F.lit(0))
