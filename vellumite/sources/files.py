"""Readers and writers. Schemas are given, never inferred; bad rows are kept apart, not dropped unseen."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumite.functions.predicates import upload_error
from vellumite.functions.text import natural_key

CORRUPT = "_corrupt_record"


def read_json(spark: SparkSession, path: str, schema: str, lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """Good rows and, as text with their file, those that are no JSON of the schema."""
    raw = spark.read.schema(f"{schema}, {CORRUPT} string").option("multiLine", not lines).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json*").option("columnNameOfCorruptRecord", CORRUPT).json(path).withColumn("_file", F.col("_metadata.file_path"))
    return raw.where(F.col(CORRUPT).isNull()).drop(CORRUPT, "_file"), raw.where(F.col(CORRUPT).isNotNull()).select("_file", CORRUPT)


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; a line that a crash has torn is left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_documents(spark: SparkSession, path: str, schema: str, skip: list[str]) -> DataFrame:
    """JSON documents of a folder and those below, but for file names in `skip`."""
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    return spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(path).withColumn("_n", name).where(~F.col("_n").isin(skip)).drop("_n")


def read_uploads(spark: SparkSession, path: str, most_bytes: int = 50 << 20, most_pages: int = 100) -> DataFrame:
    """Binary files with their hash, their size, and the rule that each breaks, if any. Pages are counted by their markers."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    pages = F.regexp_count(F.decode("content", "ISO-8859-1"), F.lit(r"/Type\s*/Page[^s]"))
    name = F.element_at(F.split("path", "/"), -1)
    encrypted = F.contains(F.decode("content", "ISO-8859-1"), F.lit("/Encrypt"))
    error = F.coalesce(upload_error(name, F.col("length"), F.col("content"), pages, most_bytes, most_pages), F.when(encrypted, "ENCRYPTED"))
    return f.select("path", name.alias("filename"), "length", F.sha2("content", 256).alias("sha256"), pages.alias("pages"), error.alias("error"))


def read_runs(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Completed runs, the newest first; what is no run is left out."""
    return spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).option("mode", "DROPMALFORMED").json(path).withColumn("_at", F.col("_metadata.file_modification_time")).withColumn("_path", F.col("_metadata.file_path")).where("status = 'completed'").orderBy(F.desc("_at"), "_path")


def read_database(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """A table of an SQL database, in parallel where the options name a partition column."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def check_version(df: DataFrame, column: str, version: str) -> DataFrame:
    """df, unless a row has another schema version."""
    return df.where(F.assert_true(F.col(column) == version, F.lit(f"schema version is not {version}")).isNull())


def write_once(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """A sink that never overwrites; the commit is Spark's own."""
    w = df.write.mode("errorifexists")
    w.option("header", True).csv(path) if kind == "csv" else w.format(kind).save(path)


def cached(spark: SparkSession, inputs: DataFrame, key: str, path: str, compute) -> DataFrame:
    """Results by content hash: those known are read, the rest computed and appended. Incomplete entries count as missing."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    exists = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
    known = spark.read.parquet(path).where("status = 'completed'") if exists else None
    missing = inputs.join(known.select(key), key, "left_anti") if known is not None else inputs
    compute(missing.dropDuplicates([key])).withColumn("status", F.lit("completed")).write.mode("append").parquet(path)
    return inputs.select(key).distinct().join(spark.read.parquet(path).where("status = 'completed'").drop("status"), key)


REGIONS = "path string, part string, number int, place int, kind string, text string, x0 double, y0 double, x1 double, y1 double, cells array<array<string>>"
_EMU = 12700.0


def _tag(e) -> str:
    return e.tag.rsplit("}", 1)[-1]


def package_regions(name: str, content: bytes, most: int = 300_000_000) -> list[tuple]:
    """Paragraphs, tables and shapes of a word-processor or slide package, parts in the order of their numbers."""
    out = []
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        if sum(i.file_size for i in z.infolist()) > most:
            raise ValueError("the package is too large")
        parts = [n for n in z.namelist() if re.fullmatch(r"word/document\.xml|ppt/slides/slide\d+\.xml", n)]
        for number, part in enumerate(sorted(parts, key=lambda n: re.sub(r"\d+", lambda m: m[0].zfill(8), n)), 1):
            root, place = ElementTree.fromstring(z.read(part)), 0
            words = lambda e: "".join(t.text or "" for t in e.iter() if _tag(t) == "t")
            in_tables = {id(x) for t in root.iter() if _tag(t) == "tbl" for x in t.iter() if x is not t}
            for e in root.iter():
                if id(e) in in_tables:
                    continue
                box = (None,) * 4
                if _tag(e) == "tbl":
                    cells = [[words(c).strip() for c in r if _tag(c) == "tc"] for r in e.iter() if _tag(r) == "tr"]
                    out.append((name, part, number, place, "table", None, *box, cells))
                elif _tag(e) == "sp" or (_tag(e) == "p" and part.startswith("word/")):
                    text = "\n".join(filter(None, (words(p) for p in e.iter() if _tag(p) == "p"))) if _tag(e) == "sp" else words(e)
                    off, ext = (next((x for x in e.iter() if _tag(x) == k), None) for k in ("off", "ext"))
                    if off is not None and ext is not None and "x" in off.attrib and "cx" in ext.attrib:
                        x, y, w, h = (int(v) / _EMU for v in (off.get("x"), off.get("y"), ext.get("cx"), ext.get("cy")))
                        box = (x, y, x + w, y + h)
                    if text.strip():
                        out.append((name, part, number, place, "text", text, *box, None))
                else:
                    continue
                place += 1
    return out


def read_packages(spark: SparkSession, path: str) -> DataFrame:
    """Regions of all packages of a folder, boxes in points. A file that is no package gives one row of kind 'error'."""

    def run(batches):
        names = [c.split()[0] for c in REGIONS.split(", ")]
        kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), *[pa.float64()] * 4, pa.list_(pa.list_(pa.string()))]
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    rows = package_regions(name, content)
                except (zipfile.BadZipFile, ElementTree.ParseError, ValueError) as e:
                    rows = [(name, None, None, 0, "error", str(e), None, None, None, None, None)]
                cols = list(zip(*rows, strict=True)) or [()] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.{docx,pptx}").load(path).select("path", "content").mapInArrow(run, REGIONS)


def in_natural_order(df: DataFrame, column: str) -> DataFrame:
    return df.orderBy(natural_key(F.col(column)))
