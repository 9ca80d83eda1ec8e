"""Addresses in running text: detection, joining over line ends, and links that are still missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: How addresses begin, the characters that go on in them, and the marks that end a sentence after them.
OPENING = r"(?:https?://|mailto:|www\.)"
INSIDE = r"[A-Za-z0-9._~%/?#=&+:@!$'*,;()\[\]-]"
CLOSING = ".,;:!?'\""
HOST = r"(?:localhost|[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,})"
#: An address starts a word: no letter, digit, dot, @ or slash stands before it.
FORM = r"(?i)(?:^|[^\p{L}\p{N}.@/])(" + OPENING + INSIDE + "*)"
VALID = r"(?i)^(?:mailto:[^@]+@" + HOST + r"|https?://(?:[^/?#]*@)?" + HOST + r"(?:[:/?#].*)?|www(?:\.[A-Za-z0-9-]+)+\.[A-Za-z]{2,}(?:[:/?#].*)?)$"
#: Fixed value: a word that goes on with a path, of which one mark must be a separator.
PATH = r"^" + INSIDE + r"*[/.\-_%=?#]" + INSIDE + r"*(?:\s|$)"


def trimmed(run: Column) -> Column:
    """Without closing marks and brackets that have no partner: the longest head that ends in neither."""
    n = lambda head, mark: F.length(head) - F.length(F.replace(head, F.lit(mark), F.lit("")))

    def stays(e: Column) -> Column:
        head, last = F.substring(run, F.lit(1), e), F.substring(run, e, F.lit(1))
        mark = F.instr(F.lit(CLOSING), last) > 0
        return F.when(last == ")", n(head, "(") >= n(head, ")")).when(last == "]", n(head, "[") >= n(head, "]")).otherwise(~mark)

    places = F.sequence(F.length(run), F.lit(1), F.lit(-1))
    return F.substring(run, F.lit(1), F.coalesce(F.get(F.filter(places, stays), 0), F.lit(0)))


def find_uris(lines: DataFrame, keys: list[str], text: str = "line") -> DataFrame:
    """(keys, k, shown, uri): addresses of each line in order, as shown and as targets; what has no valid host is none.

    A run of letters that is rejected is not looked into again. Null lines have none.
    """
    runs = lines.select(*keys, F.posexplode(F.transform(F.regexp_extract_all(text, F.lit(FORM), F.lit(1)), trimmed)).alias("_k", "shown"))
    bare = F.col("shown").rlike(r"(?i)^www\.")
    uri = F.when(bare, F.concat(F.lit("https://"), "shown")).otherwise(F.col("shown"))
    return runs.where(F.col("shown").rlike(VALID)).select(*keys, (F.col("_k") + 1).cast("bigint").alias("k"), "shown", uri.alias("uri"))


def joined(lines: DataFrame, keys: list[str], order: str, text: str = "line") -> DataFrame:
    """As ``find_uris`` of (keys, order, text), where an address that ends a line with a slash takes in the next line's path."""
    after = F.lead(text).over(Window.partitionBy(*keys).orderBy(order))
    found = find_uris(lines.withColumn("_next", after).withColumn("_line", F.col(text)), [*keys, order, "_next", "_line"], text)
    goes_on = F.col("uri").endswith("/") & F.col("_line").endswith(F.col("shown")) & F.coalesce(F.col("_next").rlike(PATH), F.lit(False))
    rest = F.regexp_extract("_next", r"^\S+", 0)
    return found.select(*keys, order, "k", F.when(goes_on, F.concat("uri", rest)).otherwise(F.col("uri")).alias("uri"), goes_on.alias("over"))


def autolink(found: DataFrame, links: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n_found, n_added, n_already): addresses (keys, uri) found, and whether a link (keys, uri) has them already."""
    have = links.select(*keys, "uri").distinct().withColumn("_have", F.lit(True))
    known = F.coalesce("_have", F.lit(False))
    return found.join(have, [*keys, "uri"], "left").groupBy(*keys).agg(F.count(F.lit(1)).alias("n_found"), F.count_if(~known).alias("n_added"), F.count_if(known).alias("n_already"))
