"""Files as rows: object scans, block lists, and text out of parsers' payloads."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.sources.projects import entries

DOCUMENT_PARTS = ("md_content", "text_content", "html_content")
OCR_SCHEMA = "struct<schema_version: string, filename: string, language: string, pages: array<struct<page_number: int, lines: array<struct<text: string, confidence: double, bounding_box: array<array<double>>>>>>, processing_time_seconds: double>"
AUDIO_PROJECT = "import array<struct<_filename: string, _offset: double>>, wavetrack array<struct<_name: string, waveclip: array<struct<_offset: double>>>>"


def objects(spark: SparkSession, folder: str, longest: int | None = None, glob: str | None = None) -> DataFrame:
    """path, modificationTime, length, content of all files below a folder. Files over `longest` bytes aren't read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    files = reader.load(folder)
    return files.where(F.col("length") <= longest) if longest is not None else files


def blocklist(spark: SparkSession, path: str) -> DataFrame:
    """rule: the lines of a filter list that are neither blank nor comments."""
    rule = T.strip(F.col("value"))
    return spark.read.text(path).select(rule.alias("rule")).where((F.col("rule") != "") & ~F.col("rule").startswith("!"))


def markdown_title(text: Column) -> Column:
    """The first heading of level one; empty if there is none."""
    return F.regexp_extract(text, r"(?m)^#[ \t]+([^\r\n]+)$", 1)


def markdown_text(text: Column) -> Column:
    """Without the signs of headings, emphasis, code, quotes, lists, links and images."""
    out = F.regexp_replace(text, r"(?m)^(```|~~~).*$", "")
    for pattern, to in (
        (r"!\[([^\]]*)\]\([^)]*\)", "$1"), (r"\[([^\]]*)\]\([^)]*\)", "$1"), (r"(?m)^[ \t]{0,3}#{1,6}[ \t]+", ""), (r"(?m)^[ \t]{0,3}>[ \t]?", ""),
        (r"(?m)^[ \t]*(?:[-*+]|\d+\.)[ \t]+", ""), (r"(\*\*|__)(.+?)\1", "$2"), (r"(?<![\w*])[*_]([^*_\n]+)[*_](?![\w*])", "$1"), (r"`([^`]*)`", "$1"),
    ):
        out = F.regexp_replace(out, pattern, to)
    return T.strip(F.regexp_replace(out, r"\n{3,}", "\n\n"))


def markdown(files: DataFrame, content: str = "content") -> DataFrame:
    """`files` with title and text of UTF-8 markdown bytes."""
    raw = F.decode(F.col(content), "UTF-8")
    return files.withColumn("_raw", raw).withColumns({"title": markdown_title(F.col("_raw")), "text": markdown_text(F.col("_raw"))}).drop("_raw")


def elements(payload: Column) -> Column:
    """struct(title, text) of `[{type, text}]`: every text with a line feed; the first title that isn't blank."""
    rows = F.from_json(payload, "array<struct<type: string, text: string>>")
    titles = F.filter(rows, lambda e: (e["type"] == "Title") & ~T.is_blank(e["text"]))
    return F.struct(F.get(titles, F.lit(0))["text"].alias("title"), F.array_join(F.transform(rows, lambda e: F.concat(F.coalesce(e["text"], F.lit("")), F.lit("\n"))), "").alias("text"))


def walked_texts(payload: str | None) -> str:
    """Each `text` of a JSON payload that is a string, joined by line feeds, in pre-order: an object's own one before those below it, members and
    elements in the order of the payload; of a repeated member the last value counts, at the place of the first. Nothing of what is no JSON."""
    import json

    try:
        open_ = [json.loads(payload or "")]
    except (ValueError, RecursionError):
        return ""
    out = []
    while open_:
        node = open_.pop()
        if isinstance(node, dict):
            if isinstance(node.get("text"), str):
                out.append(node["text"])
            open_ += reversed(node.values())
        elif isinstance(node, list):
            open_ += reversed(node)
    return "\n".join(out)


def document_text(payload: Column) -> Column:
    """The first part of a document's payload that is text and isn't blank, else walked_texts(). Only payloads without such a part are walked, in Python: VARIANT
    keeps the members of an object sorted by name, so it has lost the order of the payload."""
    whole = F.try_parse_json(payload)
    text = lambda p: F.when(F.schema_of_variant(F.try_variant_get(whole, f"$.document.{p}", "variant")) == "STRING", F.try_variant_get(whole, f"$.document.{p}", "string"))
    part = F.coalesce(*[T.nonblank(text(p)) for p in DOCUMENT_PARTS])

    @F.pandas_udf("string")
    def each(s: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else walked_texts(x) for x in s], dtype=object)

    return F.coalesce(part, each.asNondeterministic()(F.when(part.isNull(), payload)))


def ocr_payload(payload: Column) -> Column:
    """The recognition result as a struct with pages and lines."""
    return F.from_json(payload, OCR_SCHEMA)


def audio_projects(spark: SparkSession, path: str) -> DataFrame:
    """track, offset, filename: the imports of project files, or else the clips of their wave tracks; a track without a
    name is Track_n."""
    projects = spark.read.format("xml").option("rowTag", "project").schema(AUDIO_PROJECT).load(path)
    imports = projects.where(F.size("import") > 0).select(F.posexplode("import").alias("n", "i"))
    imported = imports.select(T.basename(F.col("i._filename")).alias("track"), F.coalesce("i._offset", F.lit(0.0)).alias("offset"), F.col("i._filename").alias("filename"))
    tracks = projects.where(F.coalesce(F.size("import"), F.lit(0)) <= 0).select(F.posexplode("wavetrack").alias("n", "t"))
    clips = tracks.select(F.coalesce(T.nonblank(F.col("t._name")), F.concat(F.lit("Track_"), F.col("n") + 1)).alias("track"), F.explode("t.waveclip").alias("c"))
    return imported.unionByName(clips.select("track", F.coalesce("c._offset", F.lit(0.0)).alias("offset"), F.lit(None).cast("string").alias("filename")))


def archive_entries(files: DataFrame, cap: int, content: str = "content") -> DataFrame:
    """path, name, size, data, error: the entries of ZIP archives, without leading separators. An archive whose entries leave its folder, or
    exceed the cap together, gives one row with an error."""
    import io
    import zipfile

    def frame(rows):
        return pd.DataFrame(rows, columns=["path", "name", "size", "data", "error"]).astype({"size": "Int64"})

    def each(frames):
        for f in frames:
            out = []
            for path, data in zip(f["path"], f["content"], strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(data)) as z:
                        for name, i in entries(z, cap):  # one entry at a time
                            yield frame([(path, name, i.file_size, z.read(i), None)])
                except (ValueError, zipfile.BadZipFile) as e:
                    out.append((path, None, None, None, str(e)))
            if out:
                yield frame(out)

    return files.select("path", F.col(content).alias("content")).mapInPandas(each, "path string, name string, size bigint, data binary, error string")
