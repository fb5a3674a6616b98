"""Sources and sinks: text folders with metadata, landed pages, JSON seeds, tables replaced by file, exports, vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

METADATA = (
    "title string, author array<string>, subject string, summary string, creator string, source_url string, source_format string, filename string, "
    "preprocessing string, source_type string, veda string, mandala int, chronology_layer int, chronology_name string"
)


def read_texts(spark: SparkSession, folder: str) -> DataFrame:
    """(path, base, ext, content) of all .md and .txt files below a folder."""
    t = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{md,txt}").text(folder, wholetext=True)
    t = t.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))
    return t.withColumn("base", F.regexp_extract("path", r"([^/]+)\.(md|txt)$", 1)).withColumn("ext", F.regexp_extract("path", r"\.(md|txt)$", 1))


def read_metadata(spark: SparkSession, folder: str) -> DataFrame:
    """Metadata records X_metadata.json with their base name X; files that are no JSON give no record."""
    m = spark.read.schema(METADATA).option("multiLine", "true").option("recursiveFileLookup", "true").option("mode", "DROPMALFORMED").option("pathGlobFilter", "*_metadata.json").json(folder)
    return m.withColumn("base", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)_metadata\.json$", 1))


def load_documents(spark: SparkSession, folder: str, one_level: bool = False, titles: DataFrame | None = None) -> DataFrame:
    """One document per text file with the metadata of its own name or of its folder's; .md goes before .txt.

    Files of a folder with one metadata record, such as book_01.md, inherit it with `book` set from their number; titles(base, title)
    replace the inherited title of such files.  With `one_level` only texts named as their folder count, so that folders of several files drop out.
    """
    t = read_texts(spark, folder).withColumn("folder", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1))
    w = Window.partitionBy(F.regexp_replace("path", r"\.(md|txt)$", "")).orderBy("ext")
    t = t.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
    m = read_metadata(spark, folder)
    own = t.join(m, "base").withColumn("book", F.lit(None).cast("int"))
    rest = t.join(m.select("base"), "base", "left_anti")
    shared = rest.join(m.withColumnRenamed("base", "folder"), "folder").withColumn("book", F.regexp_extract("base", r"_(\d+)$", 1).try_cast("int"))
    if titles is not None:
        named = titles.select("base", F.col("title").alias("_title"))
        shared = shared.join(named, "base", "left").withColumn("title", F.coalesce("_title", "title")).drop("_title")
    out = own.unionByName(shared, allowMissingColumns=True)
    return out.where(F.col("base") == F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)) if one_level else out


def read_hymn_index(spark: SparkSession, folder: str) -> DataFrame:
    """(mandala, line_no, text) of index files whose names end in the number of the mandala."""
    t = spark.read.option("recursiveFileLookup", "true").text(folder, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_path"), r"(\d+)\.[a-z]+$", 1).try_cast("int").alias("mandala"), "value")
    return t.where("mandala is not null").select("mandala", F.posexplode(F.split("value", "\r?\n")).alias("line_no", "text"))


def rewrite_with_backup(df: DataFrame, path: str) -> None:
    """Replace the table at path; what stood there is kept as path.bak, and put back if the writing fails."""
    spark = df.sparkSession
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    old, bak, new = fs_path(path), fs_path(path + ".bak"), fs_path(path + ".new")
    fs = old.getFileSystem(spark._jsc.hadoopConfiguration())
    df.write.mode("overwrite").parquet(path + ".new")
    if fs.exists(old):
        fs.delete(bak, True)
        fs.rename(old, bak)
    if not fs.rename(new, old):
        fs.rename(bak, old)
        raise OSError(f"{path} could not be replaced")


def write_records(df: DataFrame, path: str) -> None:
    """Records as JSON, one object a line: transcripts, mirrors."""
    df.write.mode("overwrite").json(path)


def unpaired_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Texts without metadata, for the quarantine count; a .txt beside a .md of the same name is paired with it."""
    bare = F.regexp_replace("path", r"\.(md|txt)$", "")
    known = load_documents(spark, folder).select(bare.alias("_p"))
    return read_texts(spark, folder).select("path", bare.alias("_p")).join(known, "_p", "left_anti").select("path")


def read_pages(spark: SparkSession, folder: str) -> DataFrame:
    """(path, text) of landed pages: UTF-8, else Latin-1.  A page that was not landed is simply absent."""
    b = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    utf8 = F.expr("try_validate_utf8(cast(content as string))")
    return b.select("path", F.coalesce(utf8, F.decode("content", "ISO-8859-1")).alias("text"))


def path_exists(spark: SparkSession, path: str) -> bool:
    jp = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jp.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jp)


def read_json_with_fallback(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """The first of the paths that exists and holds a record; an empty table if none does."""
    for p in paths:
        if path_exists(spark, p):
            t = spark.read.schema(schema).option("multiLine", "true").json(p)
            if not t.isEmpty():
                return t
    return spark.createDataFrame([], schema)


def read_latest_by_key(spark: SparkSession, glob: str, schema: str, key: str) -> DataFrame:
    """Union of JSON files in which the last file, by name, wins for every key."""
    j = spark.read.schema(schema).option("multiLine", "true").json(glob).withColumn("_f", F.col("_metadata.file_name"))
    cols = [c for c in j.columns if c not in (key, "_f")]
    return j.groupBy(key).agg(F.max_by(F.struct(*cols), "_f").alias("b")).select(key, "b.*")


def seed_facts(spark: SparkSession, path: str) -> DataFrame:
    """Facts of a seed file, provenance 'authoritative' where none is given, in file order as `seq`."""
    kind = "facts array<struct<subject:string,relation:string,object:string,citation:string,note:string,provenance:string>>"
    f = spark.read.schema(kind).option("multiLine", "true").json(path).select(F.posexplode("facts").alias("seq", "f")).select("seq", "f.*")
    return f.withColumn("provenance", F.coalesce("provenance", F.lit("authoritative")))


def replace_partition(df: DataFrame, path: str, column: str = "filename") -> None:
    """Write df over the partitions it has rows for; the others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(path)


def write_text(df: DataFrame, path: str, text: str = "text", by: str | None = None) -> None:
    """One text row as it is; a view of the table, which stays the master."""
    out = df.select(F.col(text).alias("value"), *([by] if by else []))
    w = out.write.mode("overwrite")
    (w.partitionBy(by) if by else w).text(path)


def embed(chunks: DataFrame, text: str, model: Callable[[list[str]], list[list[float]]], batch: int = 32) -> DataFrame:
    """chunks with `embedding`, `batch` texts a call, inside the executors; a failed call fails its task, which Spark retries."""
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chunks.schema) + ", embedding array<float>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            vs: list = []
            for i in range(0, len(b), batch):
                vs += model([t or "" for t in b[text].iloc[i : i + batch]])
            yield b.assign(embedding=vs)

    return chunks.mapInPandas(run, ddl)


def count_by(df: DataFrame, column: str) -> DataFrame:
    """Rows per value, for checks after an index was built."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("rows"))


def export_answer(answers: DataFrame, question: str, answer: str, citations: str) -> DataFrame:
    """Question, answer and sources as Markdown text."""
    body = F.concat(F.lit("# Question\n\n"), F.coalesce(question, F.lit("")), F.lit("\n\n# Answer\n\n"), F.coalesce(answer, F.lit("")), F.lit("\n\n# Sources\n\n"), F.array_join(F.transform(citations, lambda c: F.concat(F.lit("- "), c)), "\n"), F.lit("\n"))
    return answers.select(body.alias("text"))


def metadata_rows(spark: SparkSession, records: list[dict]) -> DataFrame:
    """Metadata records of an edition, absent keys as nulls."""
    return spark.createDataFrame([{c.split()[0]: r.get(c.split()[0]) for c in METADATA.split(", ")} for r in records], METADATA)


def ensure_table(spark: SparkSession, path: str, build: Callable[[], DataFrame], rebuild: bool = False) -> DataFrame:
    """The table at path; built where it is absent, empty or to be rebuilt."""
    if not rebuild and path_exists(spark, path):
        t = spark.read.parquet(path)
        if not t.isEmpty():
            return t
    build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def read_keyed_json(spark: SparkSession, path: str, field: str, entry: str) -> DataFrame:
    """Rows (key, ...) of a JSON object whose `field` maps keys to entries of one shape."""
    m = spark.read.schema(f"`{field}` map<string, {entry}>").option("multiLine", "true").json(path)
    rows = m.select(F.explode(field).alias("key", "e"))
    return rows.select("key", "e.*") if entry.lower().startswith("struct") else rows.withColumnRenamed("e", "value")


def contiguous_files(files: DataFrame, number: str, gap: int = 3) -> DataFrame:
    """Files up to the first run of `gap` missing numbers, as a crawl that gives up would have seen them."""
    w = Window.orderBy(number)  # one row per landed file
    f = files.withColumn("_gap", F.coalesce(F.col(number) - F.lag(number).over(w) - 1, F.lit(0)))
    return f.withColumn("_cut", F.max((F.col("_gap") >= gap).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).where("_cut = 0").drop("_gap", "_cut")
