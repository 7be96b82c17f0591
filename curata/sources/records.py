"""Readers and writers of records: JSON lines, CSV of titles, images, sidecars."""

from __future__ import annotations

import os

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from curata.functions.text import clean_text
from curata.operators.relational import with_row_index

IMAGE_ENDINGS = ("jpg", "jpeg", "png", "webp", "bmp")
TITLE_COLUMNS = ("article_id", "image_id", "article_url", "article_title")


def _lines(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    lines = spark.read.text(path)
    row = F.when(F.trim("value").startswith("{"), F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"}))
    ok = F.from_json("value", "map<string,string>", {"allowSingleQuotes": "false"}).isNotNull()
    return lines.withColumns({"row": row, "blank": F.trim("value") == ""}).withColumn("ok", F.col("row").isNotNull() & ok)


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str, strict: bool = True) -> DataFrame:
    """An object a line by an explicit schema; blank lines are skipped. A bad line is an error that names its file and
    text if strict, else it is left out; bad_lines tells the numbers of all of them."""
    parsed = _lines(spark, path, schema).withColumn("file", F.col("_metadata.file_path")).where("not blank")
    if strict:
        stop = F.raise_error(F.concat(F.lit("not a JSON object in "), F.col("file"), F.lit(": "), F.left("value", F.lit(200)))).cast(parsed.schema["row"].dataType)
        return parsed.select(F.when(F.col("ok"), F.col("row")).otherwise(stop).alias("row")).select("row.*")
    return parsed.where("ok").select("row.*")


def bad_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line (from 1) and value of the lines that aren't JSON objects; blank ones aren't bad."""
    numbered = with_row_index(spark.read.text(path).select("value", F.col("_metadata"), F.col("_metadata.file_path").alias("file")), "line", 1, per_file=True)
    ok = F.trim("value").startswith("{") & F.from_json("value", "map<string,string>", {"allowSingleQuotes": "false"}).isNotNull()
    return numbered.where((F.trim("value") != "") & ~F.coalesce(ok, F.lit(False))).select("file", "line", "value")


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Nulls are written; text isn't escaped beyond what JSON asks for."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


#: What the bytes 80 to 9F are in Windows-1252; a dot where it has no character.
WESTERN = "€.‚ƒ„…†‡ˆ‰Š‹Œ.Ž..‘’“”•–—˜™š›œ.žŸ"


def decode(content: Column) -> Column:
    """struct<text, encoding> of bytes: UTF-8 without its mark, else Windows-1252, else Latin-1."""
    utf8 = F.regexp_replace(content.cast("string"), "^\ufeff", "")
    marked = F.hex(F.substring(content, 1, 3)) == "EFBBBF"
    odd = F.hex(content).rlike("^(?:..)*(?:81|8D|8F|90|9D)")
    latin = F.decode(content, "ISO-8859-1")
    known = {chr(0x80 + i): c for i, c in enumerate(WESTERN) if c != "."}
    western = F.translate(latin, "".join(known), "".join(known.values()))
    return (
        F.when(F.is_valid_utf8(content.cast("string")), F.struct(utf8.alias("text"), F.when(marked, "utf-8-sig").otherwise("utf-8").alias("encoding")))
        .when(odd, F.struct(latin.alias("text"), F.lit("latin-1").alias("encoding")))
        .otherwise(F.struct(western.alias("text"), F.lit("cp1252").alias("encoding")))
    )


def utf8_copy_path(path: str) -> str:
    """name_utf8.ending beside name.ending."""
    stem, ending = os.path.splitext(path)
    return f"{stem}_utf8{ending}"


def _csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"')


def _titles(spark: SparkSession, path: str) -> DataFrame:
    rows = _csv(spark, path)
    if missing := [c for c in TITLE_COLUMNS if c not in rows.columns]:
        raise ValueError(f"{path}: no column {', '.join(missing)}")
    return rows.select(*(F.trim(F.coalesce(c, F.lit(""))).alias(c) for c in TITLE_COLUMNS))


def read_titles_csv(spark: SparkSession, path: str) -> DataFrame:
    """article_id, image_id, article_url and article_title, trimmed, of rows that have an id and a title."""
    return _titles(spark, path).where("article_id <> '' AND article_title <> ''")


def skipped_titles(spark: SparkSession, path: str) -> DataFrame:
    """The rows that read_titles_csv leaves out."""
    return _titles(spark, path).where("article_id = '' OR article_title = ''")


def read_articles(spark: SparkSession, path: str, title: str = "article_title", article: str = "article_id", image: str = "image_id", first: int = 1, keep_untitled: bool = False) -> DataFrame:
    """row_idx and the three canonical columns of a .jsonl file (in any case) or a CSV. Rows are numbered in file order from
    `first`, and a row without an id goes by its number. Rows without a title are left out unless keep_untitled."""
    if path.lower().endswith(".jsonl"):
        numbered = with_row_index(spark.read.text(path).where(F.trim("value") != "").select("value", "_metadata"), first=first)
        fields = ", ".join(f"`{c}` string" for c in (title, article, image))
        rows = numbered.select("row_idx", F.from_json("value", fields).alias("row")).select("row_idx", "row.*")
    else:
        rows = _csv(spark, path)
        rows = with_row_index(rows.select(*(F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in (title, article, image)), "_metadata"), first=first)
    return article_rows(rows, title, article, image, keep_untitled=keep_untitled)


def article_rows(df: DataFrame, title: str = "article_title", article: str = "article_id", image: str = "image_id", order: str = "row_idx", keep_untitled: bool = False) -> DataFrame:
    """The three canonical columns; a missing id is the row's number; rows without a title are left out."""
    own = clean_text(F.col(article))
    out = df.select(F.col(order), F.when(own == "", F.col(order).cast("string")).otherwise(own).alias("article_id"), clean_text(F.col(image)).alias("image_id"), clean_text(F.col(title)).alias("article_title"))
    return out if keep_untitled else out.where("article_title <> ''")


def header_size(b: bytes) -> tuple[int, int] | None:
    """Width and height from the header of a PNG, BMP, WebP or JPEG file; None where it has none."""
    little = lambda at, n: int.from_bytes(b[at : at + n], "little")
    big = lambda at, n: int.from_bytes(b[at : at + n], "big")
    if b[:8] == b"\x89PNG\r\n\x1a\n" and len(b) >= 24:
        return big(16, 4), big(20, 4)
    if b[:2] == b"BM" and len(b) >= 26:
        return little(18, 4), abs(int.from_bytes(b[22:26], "little", signed=True))
    if b[:4] == b"RIFF" and b[8:12] == b"WEBP" and len(b) >= 30:
        kind = b[12:16]
        if kind == b"VP8X":
            return little(24, 3) + 1, little(27, 3) + 1
        if kind == b"VP8L":
            return (little(21, 4) & 0x3FFF) + 1, (little(21, 4) >> 14 & 0x3FFF) + 1
        return little(26, 2) & 0x3FFF, little(28, 2) & 0x3FFF
    at = 2 if b[:2] == b"\xff\xd8" else len(b)
    while at + 9 <= len(b) and b[at] == 0xFF:
        kind = b[at + 1]
        if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):  # a frame's start
            return big(at + 7, 2), big(at + 5, 2)
        at += 1 if kind == 0xFF else 2 + big(at + 2, 2)
    return None


def image_files(spark: SparkSession, folder: str) -> DataFrame:
    """The images below a folder by path: path, image_id (the file's stem), image_filename, extension, bytes, SHA-256, width,
    height, their ratio to six places, and metadata_error for a header that can't be read, whose size is null."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    ending = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))

    @F.pandas_udf("width int, height int")
    def size(content: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([header_size(x) or (None, None) for x in content], columns=["width", "height"], dtype="Int32")

    found = files.where(ending.isin(*IMAGE_ENDINGS)).withColumn("size", size("content"))
    w, h = F.col("size.width"), F.col("size.height")
    ok = (w > 0) & (h > 0)
    return found.select(
        "path", F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1).alias("image_id"), F.regexp_extract("path", r"([^/]+)$", 1).alias("image_filename"), ending.alias("extension"), F.col("length").alias("file_size_bytes"),
        F.sha2("content", 256).alias("sha256"), F.when(ok, w).alias("width"), F.when(ok, h).alias("height"), F.when(ok, F.round(w / h, 6)).alias("aspect_ratio"), F.when(~F.coalesce(ok, F.lit(False)), "unreadable image header").alias("metadata_error"),
    ).orderBy("path")


def write_sidecar(df: DataFrame, path: str) -> None:
    """A one-row frame as one JSON object."""
    df.limit(1).coalesce(1).write.mode("overwrite").option("ignoreNullFields", "false").json(path)
