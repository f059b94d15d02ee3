"""String expressions: piece splitting, templates, seeded hashes."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# They decide ids and texts, so both sides of a comparison need them.
PIECE_PATTERN = r"\p{L}+|\p{N}+|[^\s\p{L}\p{N}]+"
TEXT_SEPARATOR = " <ENDOFTEXT> "
PROMPT_HEAD = "] Summarize the following article.\nArticle:\n"
PROMPT_TAIL = "\nSummary:\n"


def pieces(text: Column | str) -> Column:
    """Runs of letters, of digits and of other visible characters, in order."""
    return F.regexp_extract_all(text, F.lit(PIECE_PATTERN), F.lit(0))


def piece_count(text: Column | str) -> Column:
    """Length of :func:`pieces` without building the array."""
    return F.regexp_count(text, F.lit(PIECE_PATTERN))


def as_text(value: Column | str) -> Column:
    """Cast to string; a missing value reads ``None``."""
    column = value if isinstance(value, Column) else F.col(value)
    return F.coalesce(column.cast("string"), F.lit("None"))


def join_text(*values: Column | str) -> Column:
    """One value as text, several joined by the end-of-text mark."""
    return F.concat_ws(TEXT_SEPARATOR, *[as_text(v) for v in values])


def render_prompt(language: Column | str, source: Column | str) -> Column:
    """Instruction text that precedes a summary."""
    return F.concat(F.lit("[LANG="), as_text(language), F.lit(PROMPT_HEAD), as_text(source), F.lit(PROMPT_TAIL))


def seeded_key(seed: int, *parts: Column) -> Column:
    """Hex digest of ``seed:part:part``; sorting by it shuffles reproducibly."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts]))


def digest_number(digest: Column) -> Column:
    """The first 48 bits of a hex digest as a non-negative long."""
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("long")


def seeded_draw(seed: int, *parts: Column) -> Column:
    """A 48-bit pseudo-random long fixed by ``seed`` and ``parts``."""
    return digest_number(seeded_key(seed, *parts))


def file_label(value: Column) -> Column:
    """Last part of a slash-separated name, lower case, blanks as underscores."""
    return F.replace(F.lower(F.element_at(F.split(value, "/"), -1)), F.lit(" "), F.lit("_"))
