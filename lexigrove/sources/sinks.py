"""Sinks: reports, citations, archives, catalogues, deletion scripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexigrove.functions.analysis import FROM, TO
from lexigrove.functions.text import csv_cell


def write_report(rows: DataFrame, path: str, order: tuple[str, ...], header: dict[str, str]) -> None:
    """One ordered CSV of guarded cells; header columns repeat in every line."""
    cells = [csv_cell(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in rows.columns] + [csv_cell(F.lit(v)) for v in header.values()]
    names = ",".join(f'"{c}"' for c in (*rows.columns, *header))
    body = rows.orderBy(*order).select(F.concat_ws(",", *cells).alias("value")).coalesce(1)
    body.write.mode("overwrite").option("lineSep", "\r\n").text(path)
    rows.sparkSession.createDataFrame([(names,)], "value string").coalesce(1).write.mode("append").text(path + ".header")


def write_json_report(rows: DataFrame, path: str, order: tuple[str, ...]) -> None:
    rows.orderBy(*order).coalesce(1).write.mode("overwrite").json(path)


def export_archive(chunks: DataFrame, path: str, volume: str | None = None, vectors: bool = False) -> int:
    """The volume's rows as a columnar archive, without vectors unless asked for."""
    rows = chunks.where(F.col("volume_id") == volume) if volume else chunks
    rows = rows if vectors else rows.drop(*(c for c in rows.columns if c.startswith("embedding")))
    rows.write.mode("overwrite").parquet(path)
    return rows.sparkSession.read.parquet(path).count()


def materialize_catalogue(entries: DataFrame, path: str) -> None:
    """Replaces the rows of the catalogues that entries has, and of no other."""
    entries.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("catalog").parquet(path)


def catalogues(spark: SparkSession, path: str) -> DataFrame:
    """(catalog, files, size) of every catalogue that is materialised at path."""
    return spark.read.parquet(path).groupBy("catalog").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("size"))


def drop_catalogue(spark: SparkSession, path: str, name: str) -> bool:
    """Takes one catalogue away; whether there was one."""
    escaped = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(name)
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/catalog={escaped}")
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def write_catalogue(entries: DataFrame, path: str, root: str, made: str) -> None:
    """A catalogue as one folder that can be handed on: its entries, and what they are of (root, time, files, bytes)."""
    entries.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/entries")
    head = entries.agg(F.lit(root).alias("root"), F.lit(made).alias("made"), F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("size"), F.lit(0)).cast("bigint").alias("size"))
    head.coalesce(1).write.mode("overwrite").json(f"{path}/head")


def read_catalogue(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(head, entries); a catalogue whose entries are not what its head says is refused."""
    entries = spark.read.parquet(f"{path}/entries")
    head = spark.read.schema("root string, made string, files bigint, size bigint").json(f"{path}/head")
    told, is_ = head.first(), entries.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("size")).first()
    if told is None or (told.files, told.size) != (is_.files, is_["size"]):
        raise ValueError(f"the catalogue at {path} is damaged")
    return head, entries


#: Authors that say nothing.
NOBODY = ("unknown", "unknown author", "n/a", "na", "-", "?", "")


def last_name(author: Column) -> Column:
    """What stands before a comma, else the last word; anon for nobody."""
    name = F.regexp_replace(F.coalesce(author, F.lit("")), r"^\s+|\s+$", "")
    before = F.regexp_replace(F.substring_index(name, ",", 1), r"\s+$", "")
    last = F.element_at(F.split(name, r"\s+"), -1)
    return F.when(F.lower(name).isin(*NOBODY), "anon").when(F.instr(name, ",") > 1, before).otherwise(last)


def latex(text: Column) -> Column:
    """Text with LaTeX's own characters escaped."""
    text = F.regexp_replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\ue000")), r"([&%$#_{}])", r"\\$1")
    for a, b in (("^", r"\^{}"), ("~", r"\~{}"), ("\ue000", r"\textbackslash{}")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def citation_key(author: Column, year: Column) -> Column:
    """Last name in ASCII letters and digits, accents taken off, and the year."""
    # Accents come off letter by letter, in either case; what is left of other scripts goes.
    both = [(a, b) for a, b in zip(FROM, TO, strict=True)] + [(a.upper(), b.upper()) for a, b in zip(FROM, TO, strict=True) if len(a.upper()) == 1]
    plain = F.translate(last_name(author), "".join(a for a, _ in both), "".join(b for _, b in both))
    plain = F.regexp_replace(plain, "[^A-Za-z0-9]", "")
    return F.concat(F.when(plain == "", "item").otherwise(plain), F.coalesce(year.cast("string"), F.lit("")))


def bibtex(rows: DataFrame) -> DataFrame:
    """(id, key, entry) for rows (id, title, author, year); keys that repeat get _2, _3 and so on."""
    keyed = rows.withColumn("base", citation_key(F.col("author"), F.col("year")))
    n = F.row_number().over(Window.partitionBy("base").orderBy("id"))
    keyed = keyed.withColumn("n", n).withColumn("key", F.concat("base", F.when(F.col("n") > 1, F.concat(F.lit("_"), "n")).otherwise("")))
    entry = F.concat(F.lit("@misc{"), "key", F.lit(",\n  title = {"), latex(F.col("title")), F.lit("},\n  author = {"), latex(F.col("author")), F.lit("},\n  year = {"), F.coalesce(F.col("year").cast("string"), F.lit("")), F.lit("}\n}"))
    return keyed.select("id", "key", entry.alias("entry"))


def deletion_script(copies: DataFrame, path: str = "path", kind: str = "bash") -> DataFrame:
    """One line a copy, quoted for the shell: (place, line)."""
    quote = {"bash": lambda p: F.concat(F.lit("rm -- '"), F.replace(p, F.lit("'"), F.lit("'\\''")), F.lit("'")), "powershell": lambda p: F.concat(F.lit("Remove-Item -LiteralPath '"), F.replace(p, F.lit("'"), F.lit("''")), F.lit("'")), "batch": lambda p: F.concat(F.lit('del "'), F.replace(p, F.lit("%"), F.lit("%%")), F.lit('"'))}[kind]
    return copies.select(F.col(path).alias("place"), quote(F.col(path)).alias("line"))
