"""Inventories of files, and writers. Spark writes the files; names come from columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: First bytes of file formats, in hexadecimal.
MAGIC = {"25504446": "pdf", "89504E47": "png", "FFD8FF": "jpeg", "47494638": "gif", "50415231": "parquet", "504B0304": "zip"}
TEXT = ["txt", "md", "csv", "json", "html", "xml"]


def file_inventory(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length, kind): each file below ``folder``, by its extension, without reading what is in it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length")
    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    return files.select("path", "length", F.when(ext.isin(TEXT), "text").when(ext == "", "unknown").otherwise(ext).alias("kind"))


def kind_by_content(content: Column) -> Column:
    """The format that a file's first bytes name, or null."""
    head = F.hex(F.substring(content, 1, 4))
    out = F.lit(None).cast("string")
    for magic, kind in MAGIC.items():
        out = F.when(head.startswith(magic), kind).otherwise(out)
    return out


def write_parts(pages: DataFrame, folder: str, by: str = "part_name") -> None:
    """One folder for each part; rows of a part are brought together first, so that it is few files."""
    pages.repartition(by).sortWithinPartitions(by, "page").write.partitionBy(by).parquet(folder)


def write_form_values(fields: DataFrame, folder: str) -> None:
    """Names and values of the fields that may be exported, as JSON lines."""
    fields.where("value IS NOT NULL AND kind NOT IN ('button', 'signature')").select("doc", "name", "value").write.json(folder)


def csv_lines(cells: DataFrame, table: str = "table", least_columns: int = 1) -> DataFrame:
    """(table, row, line): rows of cells (table, row, col, text) as lines of CSV, each table as wide as its widest row.

    Columns count from 1; missing cells are empty, and several texts of one cell go by their order. Texts with a comma, a
    quote or a line end are quoted. Row 0 is the header, c1, c2, ..
    """
    one = cells.groupBy(table, "row", "col").agg(F.min("text").alias("text"))
    rows = one.groupBy(table, "row").agg(F.map_from_entries(F.collect_list(F.struct("col", "text"))).alias("_cells"), F.max("col").alias("_widest"))
    width = F.greatest(F.max("_widest").over(Window.partitionBy(table)), F.lit(least_columns))
    quoted = lambda x: F.when(x.rlike('[,"\r\n]'), F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.coalesce(x, F.lit("")))
    wide = rows.withColumn("_width", width)
    lines = wide.select(table, "row", F.array_join(F.transform(F.sequence(F.lit(1), F.col("_width")), lambda c: quoted(F.try_element_at("_cells", c))), ",").alias("line"))
    names = wide.groupBy(table).agg(F.first("_width").alias("_width")).select(table, F.lit(0).cast(cells.schema["row"].dataType).alias("row"), F.array_join(F.transform(F.sequence(F.lit(1), F.col("_width")), lambda c: F.concat(F.lit("c"), c.cast("string"))), ",").alias("line"))
    return names.unionByName(lines)


def write_tables(cells: DataFrame, folder: str, least_columns: int = 1) -> None:
    """Cells (table, row, col, text) as CSV, a folder with one file for each table; any number of columns."""
    lines = csv_lines(cells, "table", least_columns)
    lines.repartition("table").sortWithinPartitions("table", "row").select("table", "line").write.partitionBy("table").text(folder)


def outline_rows(spark: SparkSession, path: str) -> DataFrame:
    """(doc, ord, depth, title, page, ok) of outline files: tabs for depth, then title, tab, page."""
    text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("doc"), F.posexplode(F.split("value", "\r?\n")).alias("ord", "line"))
    form = "^(\t*)([^\t]*)\t([0-9]+)\\s*$"
    rows = text.where(F.trim("line") != "")
    out = rows.select("doc", "ord", F.length(F.regexp_extract("line", "^(\t*)", 1)).alias("depth"), F.trim(F.regexp_extract("line", form, 2)).alias("title"), F.nullif(F.regexp_extract("line", form, 3), F.lit("")).cast("int").alias("page"))
    return out.withColumn("ok", (F.col("title") != "") & F.col("page").isNotNull() & (F.col("page") > 0))


def first_of_each(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """Of rows with equal keys the first in order."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_k = 1").drop("_k")
