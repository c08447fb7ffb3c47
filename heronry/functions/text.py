"""String functions of the curation pipeline as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters that the metric normaliser keeps, besides the space (fixed values).
METRIC_LETTERS = "a-zåäöéü"
#: Sentence and token patterns (fixed values).
SENTENCE = r"[^.!?]+[.!?]?"
IS_WORD = "[a-zåäöéèüáàâäëïöüA-ZÅÄÖ]+"
TOKEN = IS_WORD + r"|[,.!?;:\-]"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def strip(c: str | Column) -> Column:
    """White space off both ends, as Unicode has it."""
    return F.regexp_replace(col(c), r"(?U)^\s+|\s+$", "")


def norm_metric(c: str | Column) -> Column:
    """Lower case, letters and single spaces only."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(col(c)), f"[^{METRIC_LETTERS} ]+", " "), " +", " "))


def cer(ref: str | Column, hyp: str | Column) -> Column:
    """Edit distance over code points by the reference's length; an empty reference gives 0 or 1."""
    from .edit_distance import edit_distance

    r, h = col(ref), col(hyp)
    return F.when(F.length(r) == 0, F.when(F.length(h) > 0, 1.0).otherwise(0.0)).otherwise(edit_distance(r, h) / F.length(r))


def sentences(c: str | Column) -> Column:
    """Sentences, stripped, blanks dropped."""
    parts = F.transform(F.regexp_extract_all(col(c), F.lit(SENTENCE), 0), lambda s: F.regexp_replace(s, r"(?U)^\s+|\s+$", ""))
    return F.filter(parts, lambda s: F.length(s) > 0)


def tokens(c: str | Column) -> Column:
    """Words and punctuation; digits and everything else vanish."""
    return F.regexp_extract_all(col(c), F.lit(TOKEN), 0)


def is_word(c: str | Column) -> Column:
    return col(c).rlike(f"^{IS_WORD}$")


def split_sentences(c: str | Column) -> Column:
    """Pieces after sentence ends."""
    return F.split(col(c), r"(?<=[.!?…])(?U)\s+")


def split_clauses(c: str | Column) -> Column:
    return F.split(col(c), r"(?<=[,;:])(?U)\s+")


def safe_name(c: str | Column, width: int = 40) -> Column:
    """Letters and digits joined by underscores, stripped before it is cut."""
    return F.left(F.regexp_replace(F.regexp_replace(col(c), "[^A-Za-z0-9]+", "_"), "^_+|_+$", ""), F.lit(width))


def fixed(c: str | Column, digits: int) -> Column:
    """A number with fixed decimals, half up."""
    return F.format_string(f"%.{digits}f", col(c).cast("double"))


def field_of_report(line: str | Column, at: int) -> Column:
    """The n-th white-space separated field of a report line as a number; null for bad lines."""
    return F.try_element_at(F.split(F.trim(col(line)), r"\s+"), F.lit(at)).try_cast("double")


def padded_id(c: str | Column, prefix: str = "", width: int = 6) -> Column:
    """Zero-padded sequence names."""
    return F.concat(F.lit(prefix), F.lpad(col(c).cast("string"), width, "0"))


def number_of_path(c: str | Column) -> Column:
    """The number that a path's base name is."""
    return F.substring_index(F.substring_index(col(c), "/", -1), ".", 1).try_cast("long")
