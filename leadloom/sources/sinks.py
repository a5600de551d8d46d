"""Writing leads, and the table of records that later runs are seeded from."""

from __future__ import annotations

import json
import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.plans.leads import export_columns
from leadloom.plans.lineage import cut
from leadloom.schema import LEAD_COLUMNS, MISSING


CONTROLS = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f]")


def write_csv(leads: DataFrame, path: str, extra: list[str] | None = None) -> None:
    """The export as CSV files with a header each; the job's commit makes them visible as a whole."""
    export_columns(leads, extra).write.mode("overwrite").option("header", True).option("quoteAll", False).option("escape", '"').csv(path)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def with_row_index(leads: DataFrame, order: list[str], after: int = 0) -> DataFrame:
    """`leads` with row_index, from `after`, in the given order, without gathering rows in one task.

    Rows are ranged by order; a first pass counts each range's rows, a second numbers rows within it.
    """
    d = cut(leads.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()))
    sizes = d.groupBy("_part").agg(F.count("*").alias("n"), F.min("_at").alias("_first"))
    before = sizes.alias("a").join(sizes.alias("b"), F.col("b._part") < F.col("a._part"), "left").groupBy(F.col("a._part").alias("_part"), F.col("a._first").alias("_first")).agg(F.coalesce(F.sum("b.n"), F.lit(0)).alias("_before"))
    return d.join(before, "_part").withColumn("row_index", F.col("_before") + F.col("_at") - F.col("_first") + after).drop("_part", "_at", "_first", "_before")


def append_csv(spark: SparkSession, leads: DataFrame, path: str, extra: list[str] | None = None) -> None:
    """Appends to the export at `path`; ValueError where its header is another one."""
    wanted = export_columns(leads, extra)
    have = header_of(spark, path)
    if have and have != wanted.columns:
        raise ValueError(f"the export at {path} has other columns: {have}")
    wanted.write.mode("append").option("header", True).option("quoteAll", False).option("escape", '"').csv(path)


def header_of(spark: SparkSession, path: str) -> list[str]:
    """Column names of an export; none where there is none."""
    try:
        return read_csv(spark, path).columns
    except Exception as error:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER_SCHEMA" not in str(error):
            raise
        return []


def row_count(spark: SparkSession, path: str) -> int:
    """Rows of an export, line breaks in quotes being none."""
    return read_csv(spark, path).count()


def reconciled(export: DataFrame, records: DataFrame) -> DataFrame:
    """The rows of an export that the table of records has committed, each once: what a run that broke off left besides goes."""
    return export.dropDuplicates(["record_id"]).join(records.where("stage = 'committed'").select("record_id").distinct(), "record_id", "left_semi").select(*export.columns)


def truncated(numbered: DataFrame, rows: int) -> DataFrame:
    """The first `rows` rows by row_index."""
    return numbered.where(F.col("row_index") < rows)


def migrated(records: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """The export made anew from the raw JSON of committed records in their order: columns it lacks are N/A, others go."""
    names = [*LEAD_COLUMNS, *(extra or [])]
    raw = F.from_json("raw_json", "map<string,string>")
    d = committed(records).select("committed_row", "record_id", raw.alias("r"))
    return d.select("committed_row", *[F.coalesce("record_id", F.lit(MISSING)).alias(c) if c == "record_id" else F.coalesce(F.col("r")[c], F.lit(MISSING)).alias(c) for c in names])


def raw_json(df: DataFrame, columns: list[str]) -> DataFrame:
    """`df` with raw_json: the given columns as one JSON object, NULL ones left out."""
    return df.withColumn("raw_json", F.to_json(F.struct(*columns)))


def write_xlsx(leads: DataFrame, path: str, columns: list[str] | None = None) -> int:
    """The leads as one sheet of text cells, missing ones empty, streamed row by row through the driver; the count of rows.

    A sheet holds 1,048,576 rows; ValueError beyond.
    """
    import zipfile
    from xml.sax.saxutils import escape

    columns = columns or leads.columns
    cell = lambda v: "" if v is None else f'<is><t xml:space="preserve">{escape(CONTROLS.sub("", str(v)))}</t></is>'
    line = lambda values: "<row>" + "".join(f'<c t="inlineStr">{cell(v)}</c>' if v not in (None, "") else "<c/>" for v in values) + "</row>"
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    rels, main = "http://schemas.openxmlformats.org/package/2006/relationships", "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    office, kinds = "http://schemas.openxmlformats.org/officeDocument/2006/relationships", "application/vnd.openxmlformats-officedocument.spreadsheetml"
    parts = {
        "[Content_Types].xml": f'{head}<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{kinds}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{kinds}.worksheet+xml"/></Types>',
        "_rels/.rels": f'{head}<Relationships xmlns="{rels}"><Relationship Id="rId1" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'{head}<workbook xmlns="{main}" xmlns:r="{office}"><sheets><sheet name="leads" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'{head}<Relationships xmlns="{rels}"><Relationship Id="rId1" Type="{office}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
    }
    n = 0
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, xml in parts.items():
            z.writestr(name, xml)
        with z.open("xl/worksheets/sheet1.xml", "w", force_zip64=True) as sheet:
            sheet.write(f'{head}<worksheet xmlns="{main}"><sheetData>{line(columns)}'.encode())
            for row in leads.select(*columns).toLocalIterator():
                n += 1
                if n > 1_048_575:
                    raise ValueError("more rows than a sheet holds")
                sheet.write(line(row).encode())
            sheet.write(b"</sheetData></worksheet>")
    return n


def write_ndjson(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def commit_records(batch: DataFrame, path: str) -> DataFrame:
    """Appends the records whose id isn't in the table at `path` yet, and returns them; once more changes nothing."""
    spark = batch.sparkSession
    fresh = batch.dropDuplicates(["record_id"])
    try:
        known = spark.read.parquet(path).select("record_id")
        fresh = fresh.join(known, "record_id", "left_anti")
    except Exception as error:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER_SCHEMA" not in str(error):
            raise
    fresh = cut(fresh)
    fresh.write.mode("append").parquet(path)
    return fresh


def committed(records: DataFrame) -> DataFrame:
    return records.where("stage = 'committed'").orderBy("committed_row")


def summary(records: DataFrame) -> dict:
    """Counts of the run's records by stage."""
    row = records.agg(F.count("*").alias("records"), *[F.count_if(F.col("stage") == s).alias(s) for s in ("discovered", "enriched", "committed")]).first()
    return row.asDict()


def write_summary(path: str, values: dict) -> None:
    Path(path).write_text(json.dumps(values, ensure_ascii=False, indent=2), encoding="utf-8")
