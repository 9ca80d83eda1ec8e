"""Column helpers for text; only built-in functions, so that they stay on the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ligatures and what they stand for; characters folded to a plainer one.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl"}
FOLD_FROM = "‘’‚“”„«»‐‑–—   \t"
FOLD_TO = "'''\"\"\"\"\"----    "
#: Words that stand beside a page number.
PAGE_WORDS = ["page", "p", "pg", "of", "sur", "de", "seite"]


def normalize_text(text: Column, ignore_case: bool = False) -> Column:
    """Comparison key: ligatures unfolded, quotes, dashes and blanks folded, trimmed; lower case if asked."""
    for one, several in LIGATURES.items():
        text = F.replace(text, F.lit(one), F.lit(several))
    text = F.trim(F.translate(text, FOLD_FROM, FOLD_TO))
    return F.lower(text) if ignore_case else text


def search_fold(text: Column, match_case: bool = False) -> Column:
    """One character for one: blanks, quotes and dashes folded, so that offsets stay; lower case unless asked."""
    text = F.translate(text, FOLD_FROM + "\n\r", FOLD_TO + "  ")
    return text if match_case else F.lower(text)


def header_key(text: Column) -> Column:
    """Key under which running headers compare: lower case, digits as #, single spaces, trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), "[0-9]", "#"), "[ \\t]+", " "))


def looks_like_page_number(text: Column) -> Column:
    """One to four tokens, each of at most four digits or a page word, and one of them digits."""
    tokens = F.filter(F.transform(F.split(F.lower(F.trim(text)), " "), lambda t: F.regexp_replace(t, r"^[-–—.,/|]+|[-–—.,/|]+$", "")), lambda t: t != "")
    number = lambda t: t.rlike("^[0-9]{1,4}$")
    return F.size(tokens).between(1, 4) & F.forall(tokens, lambda t: number(t) | t.isin(PAGE_WORDS)) & F.exists(tokens, number)


def list_marker(text: Column) -> Column:
    """Does the first token read as a bullet, or as numbering such as 1. a) (2) iv. ?"""
    first = F.element_at(F.split(F.ltrim(text), " "), 1)
    return first.rlike(r"^([•◦▪*–-]|\(?[0-9]{1,4}[.)]|\(?[a-zA-Z][.)]|\(?[ivxIVX]{1,4}[.)])$")


def ends_sentence(text: Column) -> Column:
    return text.rlike(r"[.!?:;»”\")]$")


def clean_title(text: Column, most: int = 120) -> Column:
    """Single blanks; longer titles cut at the last whole word, if that is past half, and marked by an ellipsis."""
    flat = F.trim(F.regexp_replace(text, r"[ \t\n\r]+", " "))
    head = F.substring(flat, 1, most)
    at = F.length(head) - F.instr(F.reverse(head), " ") + 1
    cut = F.when(F.contains(head, F.lit(" ")) & (at > most // 2), F.substring(head, F.lit(1), (at - 1).cast("int"))).otherwise(head)
    return F.when(F.length(flat) <= most, flat).otherwise(F.concat(F.rtrim(cut), F.lit("…")))


def safe_file_name(title: Column, most: int = 60) -> Column:
    """A title without characters that file systems refuse."""
    return F.trim(F.substring(F.regexp_replace(title, r'[\\/:*?"<>|\x00-\x1f]', ""), 1, most))


def template(pattern: str, **values: Column) -> Column:
    """``pattern`` with {name} replaced; doubled braces stand for themselves; unknown names stay."""
    out = F.lit(pattern.replace("{{", "\x01").replace("}}", "\x02"))
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), value.cast("string"))
    return F.translate(out, "\x01\x02", "{}")


def words(text: Column) -> Column:
    """Normalised non-empty words in reading order."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
