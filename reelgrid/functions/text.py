"""String expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from reelgrid.functions.vectors import bound


def word_count(s: Column) -> Column:
    """Number of runs of visible characters; 0 for empty text."""
    return F.regexp_count(s, F.lit(r"\S+"))


def words(s: Column) -> Column:
    return F.regexp_extract_all(s, F.lit(r"\S+"), F.lit(0))


def strip(s: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(s, r"^\s+|\s+$", "")


def strip_dots(s: Column) -> Column:
    """Trailing dots go, then blanks at both ends."""
    return F.trim(F.regexp_replace(s, r"\.+$", ""))


def join_words(parts: Column) -> Column:
    return F.array_join(parts, " ")


def after_colon(s: Column) -> Column:
    """Lower-case text after the first colon."""
    return F.lower(F.regexp_replace(s, r"^[^:]*:", ""))


def after_marker(s: Column, marker: str) -> Column:
    """The part between the first and the second ``marker``; null without one."""
    return F.try_element_at(F.split(s, f"\\Q{marker}\\E"), F.lit(2))


def route_by_prefix(s: Column, rules: dict[str, str]) -> Column:
    """The value of the first prefix that ``s`` starts with; null skips the row."""
    out = F.lit(None).cast("string")
    for prefix, value in reversed(rules.items()):
        out = F.when(s.startswith(prefix), F.lit(value)).otherwise(out)
    return out


def last_segment(uri: Column) -> Column:
    return F.substring_index(uri, "/", -1)


def path_stem(path: Column) -> Column:
    """File name without its last extension."""
    return F.regexp_replace(last_segment(path), r"\.[^.]*$", "")


def extension(path: Column) -> Column:
    return F.regexp_extract(path, r"\.([^./]*)$", 1)


def with_scheme(url: Column) -> Column:
    """``http:`` in front of an address without a protocol."""
    return F.when(url.contains("http"), url).otherwise(F.concat(F.lit("http:"), url))


def answer_letter(s: Column) -> Column:
    """The letter in 'answer is X' in upper case; empty without one."""
    return F.upper(F.regexp_extract(s, r"(?i)answer is ([A-Z])", 1))


def choice_of(answer: Column, options: list[str], unknown: str = "Z") -> Column:
    """The option that a free answer names.

    Trailing dots and blanks go. One character stands for itself. Longer text
    gives the letter of 'answer is X', else the first option that occurs in it.
    Anything else is ``unknown``.
    """
    s = strip_dots(answer)
    first = F.coalesce(*[F.when(s.contains(o), F.lit(o)) for o in options], F.lit(unknown))
    named = answer_letter(s)
    return F.when(F.coalesce(F.length(s), F.lit(0)) == 0, F.lit(unknown)).when(F.length(s) == 1, s).when(named != "", named).otherwise(first)


def label_in(s: Column, labels: list[str], default: str) -> Column:
    """The first label that occurs in the lower-cased text."""
    low = F.lower(s)
    return F.coalesce(*[F.when(low.contains(x), F.lit(x)) for x in labels], F.lit(default))


def yes_no(s: Column) -> Column:
    return F.when(F.lower(F.trim(s)) == "yes", 1).otherwise(0)


def node_id(prefix: str, idx: Column) -> Column:
    return F.concat(F.lit(prefix), idx.cast("string"))


def padded(idx: Column, width: int = 5) -> Column:
    return F.lpad(idx.cast("string"), width, "0")


def surrogate_id(*cols: Column) -> Column:
    """A repeatable id from the columns' text."""
    return F.sha2(F.concat_ws("\u001f", *[c.cast("string") for c in cols]), 256)


def word_chunks(s: Column, n: int = 128) -> Column:
    """Texts of ``n`` words; the last may have fewer; no words, no chunks."""

    def chunks(w):
        starts = F.when(F.size(w) > 0, F.sequence(F.lit(1), F.size(w), F.lit(n))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(w, i, n), " "))

    return bound(words(s), chunks)


def char_chunks(s: Column, limit: int = 128) -> Column:
    """Greedy texts of at most ``limit`` characters, cut at words.

    A word that doesn't fit closes the chunk before it, which is empty if an
    overlong word comes first.
    """
    none = F.array().cast("array<string>")
    # One pass of a regular expression: as many characters as end before a blank, or one overlong word.
    cut = F.split(F.regexp_replace(join_words(words(s)), f"(?s)(.{{1,{limit}}}|[^ ]+)(?: |$)", "$1\n"), "\n")
    chunks = bound(cut, lambda c: F.slice(c, 1, F.size(c) - 1))
    first = F.when(F.length(F.regexp_extract(s, r"\S+", 0)) > limit, F.array(F.lit(""))).otherwise(none)
    return F.concat(first, chunks)


def date_in_name(name: Column) -> Column:
    """The date of an eight-digit run in a file name; null without a valid one."""
    return F.try_to_date(F.regexp_extract(name, r"(\d{8})", 1), "yyyyMMdd")
