"""Files and archives as frames (SRC-01 to SRC-15, SRC-39 to SRC-41).

``scan`` lists files with their bytes; Spark reads only what the following filters on path and length leave.  Archives are
opened in memory on the executors, member by member; a member that can't be read becomes a row with an error.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# What counts as content, and what never does.
CONTENT = ("pdf", "xlsx", "xls", "csv", "docx", "doc", "pptx", "ppt", "png", "jpg", "jpeg", "tiff", "bmp", "txt", "md")
SYSTEM_FILES = (".DS_Store", "Thumbs.db")
CATEGORIES = ("Documents", "Emails", "Images", "Presentations", "Spreadsheets")
#: Bytes of a member beyond which it is reported and not unpacked, and of the members that are given on together.
MOST_BYTES, FRAME_BYTES = 500 * 1024 * 1024, 32 * 1024 * 1024


def scan(spark: SparkSession, root: str, glob: str = "*", recursive: bool = True) -> DataFrame:
    """path, modificationTime, length and content of the files under ``root`` whose names fit ``glob``."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", glob)
    return reader.option("recursiveFileLookup", str(recursive).lower()).load(root)


def parts_below(path: Column, root: str) -> Column:
    """The parts of a path below ``root``."""
    return F.split(F.regexp_replace(path, rf"^.*?{root.rstrip('/').split('/')[-1]}/", ""), "/")


def discover_zips(files: DataFrame, root: str) -> DataFrame:
    """SRC-01, SRC-02: category and path of *.zip (case counts) one folder below ``root``; folders with a leading dot are skipped."""
    p = parts_below(F.col("path"), root)
    return files.withColumn("parts", p).where((F.size("parts") == 2) & ~F.col("parts")[0].startswith(".") & F.col("path").endswith(".zip")).withColumn("category", F.col("parts")[0]).drop("parts")


def by_parent(files: DataFrame, root: str) -> DataFrame:
    """SRC-03: the category is the folder that holds the file; files right under ``root`` are skipped."""
    p = parts_below(F.col("path"), root)
    return files.withColumn("parts", p).where(F.size("parts") >= 2).withColumn("category", F.element_at("parts", -2)).drop("parts")


def by_first_folder(files: DataFrame, root: str) -> DataFrame:
    """SRC-04: the category is the first folder below ``root``; files right under it are Uncategorized."""
    p = parts_below(F.col("path"), root)
    return files.withColumn("category", F.when(F.size(p) >= 2, p[0]).otherwise("Uncategorized"))


def known_categories(files: DataFrame) -> DataFrame:
    """SRC-05."""
    return files.where(F.col("category").isin(*CATEGORIES))


def ordinary_files(files: DataFrame, most: int = MOST_BYTES) -> DataFrame:
    """SRC-07: without files of the system and files over ``most`` bytes; both tests run on the listing, before any file is read."""
    name = F.element_at(F.split("path", "/"), -1)
    out = files.where(F.col("length") <= most)
    for s in SYSTEM_FILES:
        out = out.where(~name.startswith(s))
    return out


def members_of(raw: bytes, depth: int, prefix: str = "") -> Iterator[tuple[str, int, bytes | None, str | None]]:
    """Name, size, bytes and error of the members of an archive; archives within it are opened ``depth`` levels down."""
    try:
        z = zipfile.ZipFile(io.BytesIO(raw))
        listed = z.infolist()
    except (zipfile.BadZipFile, OSError, ValueError) as e:
        yield prefix.rstrip("/"), len(raw), None, f"bad archive: {e}"
        return
    for m in listed:
        if m.is_dir():
            continue
        name = prefix + m.filename
        if m.file_size > MOST_BYTES:
            yield name, m.file_size, None, "too large"
            continue
        try:
            data = z.read(m)
        except (zipfile.BadZipFile, OSError, RuntimeError, NotImplementedError, ValueError, EOFError, zipfile.zlib.error) as e:
            yield name, m.file_size, None, f"unreadable: {e}"
            continue
        if depth > 0 and m.filename.lower().endswith(".zip"):
            yield from members_of(data, depth - 1, name + "/")
        else:
            yield name, m.file_size, data, None


def unzip(archives: DataFrame, content: str = "content", keep: tuple[str, ...] = ("path",), depth: int = 1) -> DataFrame:
    """SRC-09 to SRC-11, SRC-14: a row for each member of each archive: ``keep``, member, ord, size, data and error.

    Null contents give no row, empty or broken ones a row with an error; order is that of the archive.
    """
    schema = ", ".join([*(f"`{k}` {archives.schema[k].dataType.simpleString()}" for k in keep), "member string, ord int, size bigint, data binary, error string"])

    columns = [*keep, "member", "ord", "size", "data", "error"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                raw = row[-1]
                if raw is None:
                    continue
                held, total = [], 0  # members are given on before the next ones are unpacked
                for i, (name, size, data, error) in enumerate(members_of(bytes(raw), depth)):
                    held.append((*row[:-1], name, i, size, data, error))
                    total += len(data or b"") + 200
                    if total > FRAME_BYTES:
                        yield pd.DataFrame(held, columns=columns)
                        held, total = [], 0
                if held:
                    yield pd.DataFrame(held, columns=columns)

    return archives.select(*keep, content).mapInPandas(run, schema)


def content_members(members: DataFrame, extensions: tuple[str, ...] = CONTENT) -> DataFrame:
    """SRC-12, SRC-13: members with a known extension, in any case."""
    return members.where(F.lower(F.regexp_extract("member", r"\.([A-Za-z0-9]+)$", 1)).isin(*extensions))


def inspect(files: DataFrame) -> DataFrame:
    """SRC-40: zips and other files by category, from the listing alone."""
    zipped = F.lower("path").endswith(".zip")
    return files.groupBy("category").agg(F.count_if(zipped).alias("zips"), F.count_if(~zipped).alias("others"))


def inspect_members(members: DataFrame) -> DataFrame:
    """SRC-41: members, PDFs, archives and others of each archive."""
    name = F.lower("member")
    pdf, z = name.endswith(".pdf"), name.endswith(".zip")
    return members.groupBy("path").agg(F.count("*").alias("members"), F.count_if(pdf).alias("pdfs"), F.count_if(z).alias("zips"), F.count_if(~pdf & ~z).alias("others"), F.sum("size").alias("bytes"))


def problems(files: DataFrame) -> DataFrame:
    """SRC-39: ok and problem of files: empty, or not beginning as their extension says."""
    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    head = F.hex(F.substring("content", 1, 4))
    wanted = F.when(ext == "pdf", "25504446").when(ext.isin("docx", "xlsx", "pptx", "zip"), "504B0304").when(ext == "png", "89504E47").when(ext.isin("jpg", "jpeg"), "FFD8FF")
    problem = F.when(F.col("length") == 0, "empty").when(wanted.isNotNull() & ~head.startswith(wanted), "wrong signature")
    return files.withColumn("problem", problem).withColumn("ok", F.col("problem").isNull())
