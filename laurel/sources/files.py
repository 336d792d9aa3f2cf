"""Files as they land: named and positional exports, XML and JSONP payloads, in batch or as a stream."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FUNDING = "Funding Text "  # fixed value: header prefix of the funding columns
CALLBACK = len("callback(")  # fixed value: characters before the JSON of a JSONP payload
CELL_END, RECORD_END = "\x1f", "\x1e"  # stand for separators outside quotes while a file is cut
XML = {"attributePrefix": "_", "valueTag": "_VALUE", "mode": "PERMISSIVE"}


def export_rows(whole: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """Records of CSV exports from whole files (`value`), each by its own header: {field: header} and `funding_text`.

    Files differ in their headers (the number of funding columns varies), so cells are found by position in the file's
    own header row, in the one pass that reads the file; the first header is read as `Authors`, and a header that a file
    lacks gives NULL. Quoted cells may hold separators, line breaks and doubled quotes: cutting at the quotes leaves
    quoted and unquoted stretches in turn, and only commas and line breaks of unquoted ones separate. An empty cell is
    NULL. A file is one row until it is cut; an export holds at most 2,000 records.
    """
    cut = F.split(F.translate("value", CELL_END + RECORD_END, "  "), '"')
    inside, last = lambda i: i % 2 == 1, F.size("parts") - 1
    plain = lambda x: F.translate(F.replace(x, F.lit("\r\n"), F.lit("\n")), ",\n", CELL_END + RECORD_END)
    cells = F.transform("parts", lambda x, i: F.when(inside(i), x).when((x == "") & (i > 0) & (i < last), '"').otherwise(plain(x)))
    records = whole.select(cut.alias("parts")).select(F.array_join(cells, "").alias("text")).select(
        F.filter(F.split("text", RECORD_END), lambda r: r != "").alias("records"))
    named = records.select("records", F.split(F.element_at(F.concat("records", F.array(F.lit(""))), 1), CELL_END).alias("header"))
    first = F.array(F.lit("Authors"))
    named = named.select("records", F.concat(first, F.slice("header", 2, F.greatest(F.size("header") - 1, F.lit(0)))).alias("header"))
    places = named.select(
        "records", F.array(*[F.array_position("header", h).cast("int") for h in columns.values()]).alias("places"),
        F.filter(F.transform("header", lambda h, i: F.when(h.startswith(FUNDING), i + 1)), lambda i: i.isNotNull()).alias("funding"))
    rows = places.select("places", "funding", F.explode(F.slice("records", 2, F.greatest(F.size("records") - 1, F.lit(0)))).alias("record"))
    split = rows.select("places", "funding", F.split("record", CELL_END).alias("cells"))
    cell = lambda at: F.nullif(F.get("cells", at - 1), F.lit(""))
    return split.select(
        *[cell(F.get("places", F.lit(k))).alias(field) for k, field in enumerate(columns)],
        F.transform("funding", lambda at: F.coalesce(F.get("cells", at - 1), F.lit(""))).alias("funding_text"))


def read_export(spark: SparkSession, paths: str | Sequence[str], columns: Mapping[str, str]) -> DataFrame:
    """CSV exports, whatever their headers, in one scan: see `export_rows`."""
    return export_rows(spark.read.text(paths, wholetext=True), columns)


def landed_exports(spark: SparkSession, folder: str, columns: Mapping[str, str], suffix: str = "csv",
                   per_trigger: int = 64) -> DataFrame:
    """Stream of the records of exports as they land, at most `per_trigger` files in a micro-batch."""
    whole = (spark.readStream.format("text").option("wholetext", True).option("pathGlobFilter", f"*.{suffix}")
             .option("recursiveFileLookup", True).option("maxFilesPerTrigger", per_trigger).load(folder))
    return export_rows(whole, columns)


def positional_schema(width: int) -> str:
    return ", ".join(f"c{i} string" for i in range(width))


def read_positional(spark: SparkSession, path: str, width: int, sep: str = "\t") -> DataFrame:
    """A delimited export whose columns count by position (c0, c1, ...); the header row is skipped."""
    return spark.read.schema(positional_schema(width)).csv(path, header=True, enforceSchema=True, sep=sep)


def read_xml(spark: SparkSession, path: str, row_tag: str, schema: str) -> DataFrame:
    """One row per `row_tag` element; malformed elements come as `_corrupt_record`."""
    return spark.read.format("xml").options(rowTag=row_tag, **XML).schema(schema).load(path)


def parse_xml(payload: Column, schema: str) -> Column:
    """A payload column as a struct; NULL fields when it is malformed. Repeated children are arrays, also single."""
    return F.from_xml(payload, schema, XML)


def parse_jsonp(payload: Column, schema: str) -> Column:
    """`callback({...})` as a struct."""
    body = F.substring(payload, F.lit(CALLBACK + 1), F.length(payload) - CALLBACK - 1)
    return F.from_json(body, schema)


def landed(spark: SparkSession, folder: str, schema: str, fmt: str = "csv", suffix: str = "csv", **options) -> DataFrame:
    """Stream of files as they land in a folder tree.

    Only complete exports match the suffix: partial downloads (`x.csv.crdownload`) and marker files do not.
    """
    return (
        spark.readStream.schema(schema).format(fmt).options(**options)
        .option("pathGlobFilter", f"*.{suffix}").option("recursiveFileLookup", True).load(folder)
    )
