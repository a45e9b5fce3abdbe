"""The warehouse: Parquet folders partitioned by syllabus, changed by appends and partition rewrites."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Tables and their columns.
TABLES = {
    "chunks": "syllabus_id string, chunk_no int, text string, module string, department string, semester string, subject_code string, subject_name string, elective_type string",
    "concepts": "syllabus_id string, rank int, concept string",
    "outcomes": "syllabus_id string, course_code string, co string, full_co string, text string",
    "outcome_map": "syllabus_id string, co string, po string, strength int",
    "ingested": "syllabus_id string, parse_id string, run string",
    "staged": "syllabus_id string, parse_id string, doc_id string, department string, program string, semester string, subject_code string, subject_name string, elective_type string, route string, text string",
}

#: The tables of stored vectors, (syllabus_id, chunk_no, vector), have the embedder's name behind this, and their indexes.
VECTORS, INDEX = "vectors-", "index-"


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for an intermediate table, in the one that the driver and all executors share."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = "file://" + tempfile.mkdtemp(prefix="auditlark-")
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def outcome_insert(stored: DataFrame, given: DataFrame) -> DataFrame:
    """Rows of given that have no (course_code, full_co) in stored, one for each key: insert if absent."""
    keyed = given.dropDuplicates(["course_code", "full_co"])
    return keyed.join(stored.select("course_code", "full_co"), ["course_code", "full_co"], "left_anti")


def outcome_upsert(stored: DataFrame, given: DataFrame) -> DataFrame:
    """Labels in upper case; of several for one (syllabus_id, co) the last given stays."""
    both = stored.withColumn("seq", F.lit(-1).cast("long")).unionByName(given.withColumn("seq", F.monotonically_increasing_id()))
    upper = both.withColumns({"co": F.upper("co"), "po": F.upper("po")})
    return upper.groupBy("syllabus_id", "co").agg(F.max_by("po", "seq").alias("po"), F.max_by("strength", "seq").alias("strength"))


def absent(rows: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows of syllabi that stored doesn't know."""
    return rows.join(stored.select("syllabus_id").distinct(), "syllabus_id", "left_anti")


def labelled(found: DataFrame, outcome_map: DataFrame) -> DataFrame:
    """found(syllabus_id, mapped_co, ...) plus mapped_po, the outcome's label, of several the least; null without one."""
    labels = outcome_map.groupBy("syllabus_id", F.upper("co").alias("key")).agg(F.min("po").alias("mapped_po"))
    return found.withColumn("key", F.upper("mapped_co")).join(labels, ["syllabus_id", "key"], "left").drop("key")


def with_subject(rows: DataFrame, registered: DataFrame) -> DataFrame:
    """rows(syllabus_id, ...) plus the subject's name, code, department and semester; null for unknown syllabi."""
    about = registered.select(F.col("syllabus_id").alias("of"), "subject_name", "subject_code", "department", "semester")
    return rows.join(about, F.col("syllabus_id") == F.col("of"), "left").drop("of")


def matched_option(detected: DataFrame, registered: DataFrame) -> DataFrame:
    """detected(syllabus_id, subject_code, ...) plus option: the stored syllabus of that id, else the first by id with that
    code in any case; null without one."""
    ids = registered.select(F.col("syllabus_id").alias("by_id")).distinct()
    coded = registered.where("subject_code <> ''").groupBy(F.upper("subject_code").alias("code")).agg(F.min("syllabus_id").alias("by_code"))
    rows = detected.join(ids, F.col("syllabus_id") == F.col("by_id"), "left").join(coded, F.upper("subject_code") == F.col("code"), "left")
    return rows.withColumn("option", F.coalesce("by_id", "by_code")).drop("by_id", "by_code", "code")


def by_module(chunks: DataFrame) -> DataFrame:
    """chunks(syllabus_id, chunk_no, text, module) with each module's chunks numbered: module, nth, syllabus_id, chunk_no,
    text. Chunks without a module belong to general topics."""
    named = F.coalesce(F.nullif("module", F.lit("")), F.lit("General Topics"))
    rows = chunks.select(named.alias("module"), "syllabus_id", "chunk_no", "text")
    return rows.withColumn("nth", F.expr("row_number() over (partition by module order by syllabus_id, chunk_no)"))


def _in_order(table: str, rows: DataFrame) -> DataFrame:
    return rows.select(*(c.split()[0] for c in TABLES[table].split(", "))) if table in TABLES else rows


class Store:
    """Tables below a folder. Deletions cascade to all tables, so that nothing of a syllabus outlives it."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _fs(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def tables(self) -> list[str]:
        """The fixed tables, and those of vectors, one for each embedder."""
        fs, at = self._fs(self.folder)
        names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
        return [*TABLES, *(n for n in names if n.startswith(VECTORS))]

    def path(self, table: str) -> str:
        return f"{self.folder}/{table}"

    def read(self, table: str) -> DataFrame:
        fs, at = self._fs(self.path(table))
        if not fs.exists(at):
            return self.spark.createDataFrame([], TABLES[table])
        return self.spark.read.schema(TABLES[table]).parquet(self.path(table))

    def append(self, table: str, rows: DataFrame) -> None:
        _in_order(table, rows).repartition("syllabus_id").write.mode("append").partitionBy("syllabus_id").parquet(self.path(table))

    def replace(self, table: str, rows: DataFrame) -> None:
        """Overwrite the partitions of the syllabi in rows, no others."""
        kept = _in_order(table, rows).repartition("syllabus_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        kept.partitionBy("syllabus_id").parquet(self.path(table))

    def vectors(self, model: str, kind: str) -> DataFrame:
        """Stored vectors of an embedder, whose column has this type."""
        fs, at = self._fs(self.path(VECTORS + model))
        schema = f"syllabus_id string, chunk_no int, vector {kind}"
        return self.spark.read.schema(schema).parquet(self.path(VECTORS + model)) if fs.exists(at) else self.spark.createDataFrame([], schema)

    def get(self, table: str, where: str | None = None, columns: list[str] | None = None, limit: int | None = None) -> DataFrame:
        """Rows that meet a condition, some of their columns, and at most so many, the first by syllabus and place; conditions
        and columns reach the scan, and one on syllabus_id its folders."""
        rows = self.read(table)
        rows = rows if where is None else rows.where(where)
        if limit is not None:
            order = [c for c in ("syllabus_id", "chunk_no", "rank", "co", "doc_id") if c in rows.columns]
            rows = rows.orderBy(*order).limit(limit)
        return rows if columns is None else rows.select(*columns)

    def orphans(self) -> DataFrame:
        """(table, n): how many rows of the other tables are of syllabi without chunks."""
        known, out = self.read("chunks").select("syllabus_id").distinct(), None
        for table in ("concepts", "outcomes", "outcome_map"):
            n = self.read(table).join(known, "syllabus_id", "left_anti").agg(F.lit(table).alias("table"), F.count("*").alias("n"))
            out = n if out is None else out.unionByName(n)
        return out

    def exists(self, syllabus_id: str) -> bool:
        return bool(self.read("chunks").where(F.col("syllabus_id") == syllabus_id).limit(1).count())

    def new_only(self, rows: DataFrame) -> DataFrame:
        """Rows of syllabi that aren't stored yet."""
        return absent(rows, self.read("chunks"))

    def delete(self, syllabus_id: str) -> None:
        from urllib.parse import quote

        for table in self.tables():
            for name in {syllabus_id, quote(syllabus_id, safe=" -_.,()&")}:
                fs, at = self._fs(f"{self.path(table)}/syllabus_id={name}")
                fs.delete(at, True)

    def reset(self, *tables: str) -> None:
        for table in tables or self.tables():
            fs, at = self._fs(self.path(table))
            fs.delete(at, True)

    def purge(self) -> int:
        n = self.read("chunks").select("syllabus_id").distinct().count()
        self.reset()
        return n

    def registry(self) -> DataFrame:
        """(syllabus_id, metadata of its first chunk, modules in first-seen order, n_chunks)."""
        return registry(self.read("chunks"))


def registry(chunks: DataFrame) -> DataFrame:
    about = ["department", "semester", "subject_code", "subject_name", "elective_type"]
    first = F.array_sort(F.collect_list(F.struct("chunk_no", "module")))
    names = F.array_distinct(F.filter(F.transform(first, lambda x: x["module"]), lambda m: m.isNotNull() & ~F.lower(m).isin("", "unknown", "none")))
    return chunks.groupBy("syllabus_id").agg(*(F.min_by(c, "chunk_no").alias(c) for c in about), names.alias("modules"), F.count("*").alias("n_chunks"))


def hierarchy(registered: DataFrame) -> DataFrame:
    """(department, semesters: array of semester with its subjects), with names for what is missing."""
    named = registered.select(F.coalesce("department", F.lit("Unknown Department")).alias("department"), F.coalesce("semester", F.lit("Unknown")).alias("semester"), F.struct("syllabus_id", "subject_name").alias("subject"))
    by_semester = named.groupBy("department", "semester").agg(F.array_sort(F.collect_list("subject")).alias("subjects"))
    return by_semester.groupBy("department").agg(F.array_sort(F.collect_list(F.struct("semester", "subjects"))).alias("semesters"))


def summary(chunks: DataFrame) -> DataFrame:
    """(department, semester, n_subjects, n_modules, n_chunks) of each semester, each department (semester null) and all
    (both null); level tells them apart: 0, 1 and 3. Subjects are counted before they are added up, so no list is built."""
    unnamed = F.lower(F.coalesce("module", F.lit(""))).isin("", "unknown", "none")
    modules = chunks.groupBy("syllabus_id", F.when(~unnamed, F.col("module")).alias("module")).agg(F.count("*").alias("n"), F.min(F.struct("chunk_no", "department", "semester")).alias("first"))
    subjects = modules.groupBy("syllabus_id").agg(F.count("module").alias("n_modules"), F.sum("n").alias("n_chunks"), F.min("first").alias("first"))
    named = subjects.select("n_modules", "n_chunks", F.coalesce("first.department", F.lit("Unknown Department")).alias("department"), F.coalesce("first.semester", F.lit("Unknown")).alias("semester"))
    rolled = named.rollup("department", "semester").agg(F.grouping_id().cast("int").alias("level"), F.count("*").alias("n_subjects"), F.sum("n_modules").alias("n_modules"), F.sum("n_chunks").alias("n_chunks"))
    return rolled.select("level", "department", "semester", "n_subjects", F.coalesce("n_modules", F.lit(0)).alias("n_modules"), F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"))
