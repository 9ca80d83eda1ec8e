"""Numbering, dates, sizes, colours, flags and check digits as columns of built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Roman numerals, file types, units, permission and field-flag bits (lowest bit first).
ROMAN = [(1000, "M"), (900, "CM"), (500, "D"), (400, "CD"), (100, "C"), (90, "XC"), (50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I")]
MIME = {"html": "text/html", "htm": "text/html", "txt": "text/plain", "pdf": "application/pdf", "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "json": "application/json", "xml": "application/xml", "csv": "text/csv"}
RIGHTS = {"print": 2, "modify": 3, "copy": 4, "annotate": 5, "fill_forms": 8, "accessibility": 9, "assemble": 10, "print_high": 11}
FIELD_FLAGS = {"read_only": 0, "required": 1, "no_export": 2, "multiline": 12, "password": 13, "no_toggle_off": 14, "radio": 15, "push_button": 16, "combo": 17, "edit": 18, "multi_select": 21, "comb": 24, "rich_text": 25}


def roman(n: Column) -> Column:
    """Subtractive roman numerals; thousands repeat M; 0 is empty."""
    out, rest = F.lit(""), n.cast("int")
    for value, digits in ROMAN:
        out = F.concat(out, F.repeat(F.lit(digits), F.floor(rest / value).cast("int")))
        rest = rest % value
    return out


def letters(n: Column, base: str = "a") -> Column:
    """a..z, aa, bb .. zz, aaa: the letter repeats, at most 64 times."""
    return F.repeat(F.char(F.lit(ord(base)) + (n - 1) % 26), F.least(F.floor((n - 1) / 26) + 1, F.lit(64)).cast("int"))


def alpha(n: Column) -> Column:
    """A..Z, AA, AB ..: bijective base 26; empty below 1. Fourteen letters hold any bigint."""
    start = F.struct(n.cast("bigint").alias("n"), F.lit("").alias("out"))

    def letter(acc: Column, _: Column) -> Column:
        rest = acc["n"] - 1
        return F.when(acc["n"] > 0, F.struct(F.call_function("div", rest, F.lit(26)).alias("n"), F.concat(F.char(65 + rest % 26), acc["out"]).alias("out"))).otherwise(acc)

    return F.aggregate(F.sequence(F.lit(1), F.lit(14)), start, letter, lambda acc: acc["out"])


def bates_label(number: Column, digits: int, prefix: str = "", suffix: str = "") -> Column:
    """prefix, number padded with zeros, suffix; wider numbers stay whole."""
    n = number.cast("string")
    return F.concat(F.lit(prefix), F.when(F.length(n) >= digits, n).otherwise(F.lpad(n, digits, "0")), F.lit(suffix))


def parse_document_date(raw: Column) -> tuple[Column, Column]:
    """(timestamp without zone, offset in minutes) of D:YYYYMMDDHHmmSS+HH'mm' and its shortened forms; else nulls."""
    body = r"^(?:D:)?([0-9]{4})([0-9]{2})?([0-9]{2})?([0-9]{2})?([0-9]{2})?([0-9]{2})?(?:([+-])([0-9]{2})'?([0-9]{2})?'?)?Z?$"
    part = lambda k: F.nullif(F.regexp_extract(raw, body, k), F.lit("")).cast("int")
    clamp = lambda c, low, high, other: F.greatest(F.lit(low), F.least(F.lit(high), F.coalesce(c, F.lit(other))))
    year, month = part(1), clamp(part(2), 1, 12, 1)
    last = F.dayofmonth(F.last_day(F.make_date(year, month, F.lit(1))))
    day = F.least(last, clamp(part(3), 1, 31, 1))
    stamp = F.expr("NULL").cast("timestamp_ntz")
    text = F.concat(F.lpad(year.cast("string"), 4, "0"), *[x for sep, c in zip("-- ::", (month, day, clamp(part(4), 0, 23, 0), clamp(part(5), 0, 59, 0), clamp(part(6), 0, 59, 0)), strict=True) for x in (F.lit(sep), F.lpad(c.cast("string"), 2, "0"))])
    stamp = F.when(year.isNotNull(), text.cast("timestamp_ntz"))
    sign = F.when(F.regexp_extract(raw, body, 7) == "-", -1).when(F.regexp_extract(raw, body, 7) == "+", 1)
    return stamp, sign * (part(8) * 60 + F.coalesce(part(9), F.lit(0)))


def parse_size(text: Column, bare: int = 1) -> Column:
    """Bytes of 800 KB, 1,5 Mo, 2G; ``bare`` is the unit of a number alone."""
    form = r"(?i)^\s*([0-9]+(?:[.,][0-9]+)?)\s*([kmgt]?)(?:i?[bo])?\s*$"
    number = F.nullif(F.translate(F.regexp_extract(text, form, 1), ",", "."), F.lit("")).cast("double")
    unit = F.lower(F.regexp_extract(text, form, 2))
    factor = F.when(unit == "k", 2.0**10).when(unit == "m", 2.0**20).when(unit == "g", 2.0**30).when(unit == "t", 2.0**40).when(F.lower(text).rlike("[bo]"), 1.0).otherwise(float(bare))
    return F.round(number * factor).cast("bigint")


def luminance(r: Column, g: Column, b: Column) -> Column:
    """Relative luminance of colour components in [0, 1]."""
    linear = lambda c: F.when(c <= 0.03928, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4)))
    return linear(r) * 0.2126 + linear(g) * 0.7152 + linear(b) * 0.0722


def contrast_ratio(a: Column, b: Column) -> Column:
    return (F.greatest(a, b) + 0.05) / (F.least(a, b) + 0.05)


def rgb_to_cmyk(r: Column, g: Column, b: Column) -> list[Column]:
    """Percentages of C, M, Y, K with full black generation, of components 0 to 255."""
    k = 255 - F.greatest(r, g, b)
    ink = lambda c: F.when(k == 255, F.lit(0)).otherwise(F.round((255 - c - k) * 255 / (255 - k)).cast("int"))
    return [ink(r), ink(g), ink(b), k]


def color_hex(r: Column, g: Column, b: Column) -> Column:
    return F.concat(F.lit("#"), *[F.lpad(F.hex(c.cast("int")), 2, "0") for c in (r, g, b)])


def flags(raw: Column, bits: dict[str, int]) -> list[Column]:
    """A boolean for each named bit."""
    return [(F.shiftrightunsigned(raw.cast("bigint"), bit).bitwiseAND(F.lit(1)) == 1).alias(name) for name, bit in bits.items()]


def luhn_ok(digits: Column) -> Column:
    return F.call_function("luhn_check", digits)


def mod97(text: Column) -> Column:
    """Remainder by 97 of letters and digits, letters as 10 to 35."""

    return F.aggregate(F.split(F.upper(text), ""), F.lit(0), lambda acc, c: F.when(c == "", acc).otherwise(mod97_step(acc, c)))


def mod97_step(acc: Column, c: Column) -> Column:
    """The remainder after one more letter or digit, in upper case."""
    value = F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    return F.when(value < 10, (acc * 10 + value) % 97).otherwise((acc * 100 + value) % 97)


def mime_of(name: Column) -> Column:
    ext = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    out = F.lit("application/octet-stream")
    for e, m in MIME.items():
        out = F.when(ext == e, m).otherwise(out)
    return out
