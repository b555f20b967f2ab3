"""What the corpus operators share: the shared work folder, row locators, word patterns."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lineloom.session import shared_base

#: Words of the size and fingerprint contracts: runs of anything but ASCII white space.
SPACED_WORD = r"[^\x20\x09-\x0D]+"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: Plans whose rows keep the places of the file rows they come from, one row for each at most.
ROW_BY_ROW = {"Project", "Filter", "SubqueryAlias", "LogicalRelation"}


def _path_in(spark: SparkSession, path: str):
    """(file system, path) of a folder, as Hadoop knows them."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share; it goes when the driver ends."""
    path = f"{shared_base(spark)}/lineloom/{name}-{uuid.uuid4().hex}"
    fs, p = _path_in(spark, path)
    # marked once it exists: only then the file system remembers it
    fs.mkdirs(p)
    fs.deleteOnExit(p)
    return path


def spool(df: DataFrame, name: str) -> DataFrame:
    """`df` written once as Parquet to the shared folder and read back: lineage ends there,
    and the loss of an executor costs no recomputation."""
    path = shared_dir(df.sparkSession, name)
    df.write.mode("append").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_spool(spooled: DataFrame) -> None:
    """Deletes the folder of a table that spool() gave and that nothing reads any more."""
    for folder in {f.rsplit("/", 1)[0] for f in spooled.inputFiles()}:
        fs, p = _path_in(spooled.sparkSession, folder)
        fs.delete(p, True)


def ascii_lower(text: Column) -> Column:
    """`text` with A-Z lowered and nothing else changed; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def held_out(doc_id: Column) -> Column:
    """Rows that no model may learn from: crc32 of the id's decimal text divisible by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def with_places(docs: DataFrame) -> DataFrame:
    """`docs` itself if it is a scan of one path with filters and projections only, whose rows have
    places of their own; else spooled. A place outlives an explode or a join, but several rows share it then."""
    left = [docs._jdf.queryExecution().analyzed()]
    for plan in left:
        kind = plan.getClass().getSimpleName()
        if kind not in ROW_BY_ROW or not plan.deterministic():
            return spool(docs, "rows")
        if kind == "LogicalRelation":
            source = plan.relation()
            if source.getClass().getSimpleName() != "HadoopFsRelation" or source.location().rootPaths().size() != 1:
                return spool(docs, "rows")
        children = plan.children()
        left += [children.apply(i) for i in range(children.size())]
    return docs


def located(docs: DataFrame, *columns: Column | str) -> DataFrame:
    """`columns` of `docs`, the result of with_places(), plus `at_file` and `at_row`, where each row lies."""
    meta = docs.metadataColumn("_metadata")
    return docs.select(*columns, meta["file_path"].alias("at_file"), meta["row_index"].alias("at_row"))


def local_table(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A small literal table that lives in the plan; no Python runs for it."""
    text = json.dumps(rows, ensure_ascii=True)
    return spark.range(1).select(F.inline(F.from_json(F.lit(text), f"array<struct<{schema}>>")))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
