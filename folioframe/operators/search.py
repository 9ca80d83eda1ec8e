"""Search, replacement, personal data by pattern, redaction and links, over lines of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioframe.functions import numbers as N

#: Patterns of personal data.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "ipv4": r"[\p{L}0-9_.]*[0-9]\.[0-9]+\.[0-9]+\.[0-9][\p{L}0-9_.]*",
    "phone": r"\+[0-9][0-9 ().-]{6,}[0-9]",
    "digits": r"[0-9](?:[ -]?[0-9]){12,18}",
}

#: Months of French dates, and what stands in identifiers.
MONTHS = "janvier février mars avril mai juin juillet août septembre octobre novembre décembre".split()
_GAP, _S = r"[ \x{A0}]?", r"[ ./\x{A0}\x{202F}-]?"
_DATE = "|".join(rf"[0-9]{{1,2}}{s}[0-9]{{1,2}}{s}(?:[0-9]{{4}}|[0-9]{{2}})" for s in ("/", "-", r"\."))
#: French phone numbers, account and social-security numbers, and dates. No letter or digit stands before them.
NATIONAL = {
    "phone_fr": rf"(?:\+(?:0{_S}0{_S})?3{_S}3|0{_S}0{_S}3{_S}3|0){_S}[1-9](?:{_S}[0-9]){{8}}",
    "iban": rf"[A-Z]{{2}}[0-9]{{2}}(?:{_GAP}[A-Za-z0-9]){{11,30}}",
    "nir": rf"[12](?:{_GAP}[0-9]){{4}}{_GAP}[0-9ABab](?:{_GAP}[0-9]){{9}}",
    "date_fr": rf"{_DATE}|[0-9]{{1,2}}(?:[eE][rR])? (?i:{'|'.join(MONTHS)}) [0-9]{{4}}",
}
#: What they begin with: one quick test for most places of a line.
BEGINS = {"phone_fr": r"[+0]", "iban": r"[A-Z]", "nir": r"[12]", "date_fr": r"[0-9]"}
#: What must not follow them; an account number may run on, as its key says where it ends.
NOT_AFTER = {"phone_fr": rf"{_S}[0-9]|[\p{{L}}\p{{N}}]", "iban": None, "nir": r"[\p{L}\p{N}]", "date_fr": r"[\p{L}\p{N}]"}


def starts(text: Column, parts: Column) -> Column:
    """Where each of ``parts``, the matches of a text in order, starts (from 1)."""
    return F.aggregate(
        parts,
        F.struct(F.lit(1).alias("at"), F.array().cast("array<int>").alias("out")),
        lambda acc, p: F.struct(
            (F.call_function("locate", p, text, acc["at"]) + F.length(p)).alias("at"),
            F.concat(acc["out"], F.array(F.call_function("locate", p, text, acc["at"]))).alias("out"),
        ),
        lambda acc: acc["out"],
    )


def find(lines: DataFrame, pattern: str, keys: list[str], text: str = "line") -> DataFrame:
    """(keys, start, end, hit): non-overlapping matches in each line; positions from 1, ends exclusive."""
    hits = lines.where(F.col(text).rlike(pattern)).withColumn("_hits", F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    both = hits.select(*keys, F.explode(F.arrays_zip(starts(F.col(text), F.col("_hits")).alias("start"), F.col("_hits").alias("hit"))).alias("m"))
    return both.select(*keys, F.col("m.start").alias("start"), (F.col("m.start") + F.length("m.hit")).alias("end"), F.col("m.hit").alias("hit"))


def iban_size(plain: Column) -> Column:
    """Length of the longest head, of 15 characters at least, whose key is right (null: none); in one pass.

    The first four characters, two letters and two digits, are read last: as six digits after each head.
    """
    first = F.element_at(F.transform(F.array(F.substring(plain, 1, 4)), N.mod97), 1)
    zero = F.struct(F.lit(4).alias("n"), F.lit(0).alias("rest"), F.lit(None).cast("int").alias("size"))

    def read(chars: Column, key: Column) -> Column:
        def step(acc: Column, c: Column) -> Column:
            rest = N.mod97_step(acc["rest"], c)
            right = (acc["n"] >= 14) & ((rest * (10**6 % 97) + key) % 97 == 1)
            return F.struct((acc["n"] + 1).alias("n"), rest.alias("rest"), F.when(right, acc["n"] + 1).otherwise(acc["size"]).alias("size"))

        return F.aggregate(chars, zero, step, lambda acc: acc["size"])

    bound = F.array(F.struct(F.filter(F.split(F.substr(plain, F.lit(5)), ""), lambda c: c != "").alias("chars"), first.alias("key")))
    return F.element_at(F.transform(bound, lambda x: read(x["chars"], x["key"])), 1)


def find_anywhere(lines: DataFrame, pattern: str, after: str | None, keys: list[str], text: str = "line", begins: str = "") -> DataFrame:
    """(keys, start, hit): what a pattern matches from every place that no letter or digit precedes; matches may overlap.

    ``begins``, if given, is a class that holds the first character of every match.
    """
    form = rf"{f'(?={begins})' if begins else ''}(?<![\p{{L}}\p{{N}}])(?=({pattern}){f'(?!{after})' if after else ''})"
    rows = lines.where(F.col(text).rlike(form)).withColumn("_hits", F.regexp_extract_all(text, F.lit(form), F.lit(1))).withColumn("_gaps", F.split(text, form, -1))
    # a match at the very start leaves no empty gap before it
    gaps = F.when(F.size("_gaps") == F.size("_hits"), F.concat(F.array(F.lit("")), F.col("_gaps"))).otherwise(F.col("_gaps"))
    start = F.transform("_hits", lambda h, k: 1 + F.aggregate(F.slice(gaps, F.lit(1), k + 1), F.lit(0), lambda n, g: n + F.length(g)))
    return rows.select(*keys, F.explode(F.arrays_zip(start.alias("start"), F.col("_hits").alias("hit"))).alias("m")).select(*keys, "m.start", "m.hit")


def national(lines: DataFrame, keys: list[str], text: str = "line") -> DataFrame:
    """(keys, kind, start, end, hit): French phone, account and social-security numbers and dates, each with its check."""
    out = None
    for kind, pattern in NATIONAL.items():
        some = find_anywhere(lines, pattern, NOT_AFTER[kind], keys, text, BEGINS[kind]).withColumn("kind", F.lit(kind))
        plain = F.upper(F.regexp_replace("hit", r"[ \x{A0}]", ""))
        if kind == "iban":
            # the longest head whose key is right; then back to the blanks of the text
            some = some.withColumn("_n", F.element_at(F.transform(F.array(plain), iban_size), 1)).where("_n IS NOT NULL").withColumn("hit", F.call_function("regexp_extract", F.col("hit"), F.concat(F.lit(r"^(?:[ \x{A0}]?[A-Za-z0-9]){"), F.col("_n").cast("string"), F.lit("}")), F.lit(0))).drop("_n")
        if kind == "nir":
            digits = F.replace(F.replace(F.substring(plain, 1, 13), F.lit("2A"), F.lit("19")), F.lit("2B"), F.lit("18"))
            some = some.where(97 - digits.cast("bigint") % 97 == F.substring(plain, 14, 2).cast("int"))
        if kind == "date_fr":
            part = lambda p: F.regexp_extract("hit", p, 1).try_cast("int")
            month, year = F.coalesce(part("^[0-9]+[/.-]([0-9]+)"), F.lit(1)), F.regexp_extract("hit", "([0-9]+)$", 1)
            some = some.where(part("^([0-9]+)").between(1, 31) & month.between(1, 12) & ((F.length(year) == 2) | year.try_cast("int").between(1000, 3000)))
        out = some if out is None else out.unionByName(some)
    return out.select(*keys, "kind", "start", (F.col("start") + F.length("hit")).alias("end"), "hit")


def find_across_lines(docs: DataFrame, needle: str, key: str, text: str = "text") -> DataFrame:
    """(key, match, start, end): non-overlapping occurrences of ``needle`` in whole texts, whatever their case.

    Line breaks count as blanks, one for one, so that a match may run on over the ends of lines; empty lines end a
    paragraph, which no match crosses, as two blanks stand there. Positions from 1, ends exclusive.
    """
    folded = F.lower(F.translate(F.col(text), "\n\t", "  "))
    # the gaps between matches tell where each match starts
    gaps = F.split(folded, r"\Q" + needle.lower() + r"\E", -1)
    rows = docs.where(F.contains(folded, F.lit(needle.lower()))).select(key, F.posexplode(F.transform(gaps, F.length)).alias("match", "gap"))
    before = F.sum("gap").over(Window.partitionBy(key).orderBy("match").rowsBetween(Window.unboundedPreceding, 0))
    last = F.max("match").over(Window.partitionBy(key))
    at = rows.withColumn("start", before + F.col("match") * len(needle) + 1).withColumn("_last", last).where(F.col("match") < F.col("_last"))
    return at.select(key, (F.col("match") + 1).cast("long").alias("match"), "start", (F.col("start") + len(needle)).alias("end"))


def pieces(matches: DataFrame, lines: DataFrame, key: str, line: str = "line") -> DataFrame:
    """(key, match, line_no, start, end): each match cut at the ends of lines (key, line_no, line); positions in the line."""
    w = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    begin = F.coalesce(F.sum(F.length(line) + 1).over(w), F.lit(0)) + 1
    spans = lines.select(key, "line_no", begin.alias("_a"), F.length(line).alias("_n")).join(matches.select(key).distinct(), key, "left_semi")
    # the lines on which a match begins and ends are those that began last before
    ends = matches.select(key, "match", F.explode(F.array(F.col("start").cast("long"), F.col("end").cast("long") - 1)).alias("_a"))
    both = spans.select(key, F.lit(None).cast("long").alias("match"), F.col("_a").cast("long").alias("_a"), "line_no").unionByName(ends.withColumn("line_no", F.lit(None).cast("int")))
    order = Window.partitionBy(key).orderBy("_a", F.col("match").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    on = both.withColumn("_on", F.last("line_no", ignorenulls=True).over(order)).where("match IS NOT NULL").groupBy(key, "match").agg(F.min("_on").alias("_from"), F.max("_on").alias("_to"))
    met = matches.join(on, [key, "match"]).withColumn("line_no", F.explode(F.sequence("_from", "_to"))).join(spans, [key, "line_no"]).where((F.col("start") < F.col("_a") + F.col("_n")) & (F.col("end") > F.col("_a")))
    return met.select(key, "match", "line_no", (F.greatest("start", "_a") - F.col("_a") + 1).alias("start"), (F.least(F.col("end"), F.col("_a") + F.col("_n")) - F.col("_a") + 1).alias("end"))


def candidates(lines: DataFrame, keys: list[str], text: str = "line") -> DataFrame:
    """(keys, kind, start, end, hit): the matches of all patterns, checked where the kind has a check."""
    out = national(lines, keys, text)
    for kind, pattern in PATTERNS.items():
        some = find(lines, pattern, keys, text).withColumn("kind", F.lit(kind))
        if kind == "ipv4":
            # the pattern takes whole runs of letters, digits and dots, so that nothing adjoins a run that is a quad
            some = some.withColumn("hit", F.regexp_replace("hit", r"\.$", "")).where(F.col("hit").rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$"))
            some = some.where(F.forall(F.split("hit", r"\."), lambda p: p.cast("int") <= 255)).withColumn("end", F.col("start") + F.length("hit"))
        if kind == "digits":
            some = some.where(F.call_function("luhn_check", F.translate("hit", " -", "")))
        out = out.unionByName(some)
    return out


def merged(spans: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, start, end): overlapping or touching spans as one."""
    w = Window.partitionBy(*keys).orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    first = spans.withColumn("_new", F.coalesce(F.col("start") > reach, F.lit(True)).cast("int"))
    run = first.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return run.groupBy(*keys, "_run").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_run")


def redact(lines: DataFrame, spans: DataFrame, keys: list[str], overlay: str = "[x]", text: str = "line") -> DataFrame:
    """Lines with the spans' characters replaced by ``overlay``, and how many characters went."""
    zones = merged(spans.select(*keys, "start", "end"), keys).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("_zones"))
    joined = lines.join(zones, keys, "left").withColumn("_zones", F.coalesce("_zones", F.array().cast(zones.schema["_zones"].dataType)))
    state = F.struct(F.lit(1).alias("at"), F.lit("").alias("out"))
    built = F.aggregate(
        "_zones",
        state,
        lambda acc, z: F.struct(z["end"].alias("at"), F.concat(acc["out"], F.substring(F.col(text), acc["at"], z["start"] - acc["at"]), F.lit(overlay)).alias("out")),
        lambda acc: F.concat(acc["out"], F.substring(F.col(text), acc["at"], F.length(text))),
    )
    removed = F.aggregate("_zones", F.lit(0), lambda n, z: n + z["end"] - z["start"])
    return joined.withColumn("redacted", built).withColumn("n_zones", F.size("_zones")).withColumn("n_removed", removed).drop("_zones")


def hrefs(pages: DataFrame) -> DataFrame:
    """(page_id, idx, target, kind): links of pages in order."""
    links = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))).alias("idx", "target"))
    kind = F.when(F.col("target").rlike("^https?://"), "uri").when(F.col("target").rlike("^mailto:"), "mail").when(F.col("target").startswith("/"), "goto").when(F.col("target").startswith("#"), "named").otherwise("unsupported")
    return links.withColumn("kind", kind)
