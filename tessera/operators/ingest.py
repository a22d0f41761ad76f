"""Ingestion: routing, accept-once by version, replace-by-source, chunking and tallies."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.config import Chunking
from tessera.functions import text as T
from tessera.session import ship

#: The parser for each file extension.
PARSERS = {
    "markdown": ("md",),
    "docling": ("docx", "xlsx", "pptx", "html"),
    "ocr": ("png", "jpg", "jpeg", "tiff", "bmp", "webp"),
    "unstructured": ("eml", "msg", "epub", "rtf", "xml", "odt"),
    "per_page": ("pdf",),
}
#: Magic bytes in hexadecimal, in the order in which they are tried.
SIGNATURES = (
    ("89504E470D0A1A0A", "image/png"),
    ("FFD8FF", "image/jpeg"),
    ("474946383761", "image/gif"),
    ("474946383961", "image/gif"),
    ("424D", "image/bmp"),
    ("49492A00", "image/tiff"),
    ("4D4D002A", "image/tiff"),
    ("255044462D", "application/pdf"),
)


def is_eligible(key: Column, markdown: str = "markdown/", documents: str = "documents/") -> Column:
    return F.lower(key).endswith(".md") | F.contains(key, F.lit(markdown)) | F.contains(key, F.lit(documents))


def channel(key: Column, markdown: str = "markdown/", documents: str = "documents/") -> Column:
    """Where a bucket's object goes: markdown, unstructured, or null for nowhere."""
    return F.when(F.lower(key).endswith(".md") | F.contains(key, F.lit(markdown)), "markdown").when(F.contains(key, F.lit(documents)), "unstructured")


def parser(name: Column) -> Column:
    """The parser of an attachment by its extension; null for a type that none takes."""
    ext, out = T.extension(name), F.lit(None).cast("string")
    for p, extensions in reversed(PARSERS.items()):
        out = F.when(ext.isin(*extensions), p).otherwise(out)
    return out


def page_parser(text: Column, least: int = 50) -> Column:
    """ocr for a page with next to no text, else docling."""
    return F.when(F.length(T.strip(F.coalesce(text, F.lit("")))) < least, "ocr").otherwise("docling")


def sniffed_mime(content: Column) -> Column:
    """The type by magic bytes, null if none fits."""
    head = F.hex(F.substring(content, 1, 12))
    out = F.when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), "image/webp")
    for prefix, mime in reversed(SIGNATURES):
        out = F.when(head.startswith(prefix), mime).otherwise(out)
    return out


def image_mime(header: Column, name: Column) -> Column:
    """A valid header, else by the extension, else image/png."""
    ext = T.extension(name)
    by_name = F.when(ext.isin("jpg", "jpeg"), "image/jpeg").when(ext.isin("png", "gif", "webp", "bmp"), F.concat(F.lit("image/"), ext))
    return F.coalesce(F.when(F.lower(header).rlike("^image/[a-z0-9.+-]+$"), F.lower(header)), by_name, F.lit("image/png"))


def accept(files: DataFrame, allowed: list[str], content: str = "content") -> DataFrame:
    """`files` with mime and error: an empty list allows every known type."""
    mime = sniffed_mime(F.col(content))
    out = files.withColumn("mime", mime)
    bad = F.when(F.col("mime").isNull(), "unrecognised file signature")
    return out.withColumn("error", bad.when(~F.col("mime").isin(*allowed), "type not allowed") if allowed else bad)


def object_key(folder: str, name: Column) -> Column:
    return F.concat(F.lit(folder.strip("/") + "/"), T.sanitized_filename(name))


def version(etag: Column, modified: Column) -> Column:
    return T.first_nonblank(etag, modified.cast("string"), F.lit("unknown"))


def new_versions(objects: DataFrame, ledger: DataFrame, keys: tuple[str, ...] = ("key", "version")) -> DataFrame:
    """Objects whose (key, version) the ledger doesn't have; of repeated ones, one."""
    return objects.dropDuplicates([*keys]).join(ledger.select(*keys), [*keys], "left_anti")


def replace_by_source(old: DataFrame, new: DataFrame, source: str = "source") -> DataFrame:
    """`old` without the sources that `new` has, and `new`."""
    return old.join(new.select(source).distinct(), source, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def tally(objects: DataFrame, by: str, status: str = "status", chunks: str = "chunks") -> DataFrame:
    """by, indexed (chunks of what was indexed), skipped and failed (objects). An empty parse counts as skipped."""
    when = lambda s, x: F.coalesce(F.sum(F.when(F.col(status).isin(*s), x)), F.lit(0)).cast("bigint")
    return objects.groupBy(by).agg(when(["indexed"], F.col(chunks)).alias("indexed"), when(["skipped", "empty"], 1).alias("skipped"), when(["failed"], 1).alias("failed"))


TOKEN = re.compile(r"\w+|[^\w\s]")


def split_text(text: str | None, config: Chunking = Chunking()) -> list[str]:
    """Chunks of at most `tokens` words and signs. A chunk ends after the last break character beyond `min_chars`, if it
    has one; the last ends with the text. Chunks of `min_embed_chars` or fewer, and those beyond `max_chunks`, if that is set, go."""
    out, at, text = [], 0, text or ""
    ends = [m.end() for m in TOKEN.finditer(text)]
    done = 0  # tokens before `at`
    while at < len(text) and (config.max_chunks is None or len(out) < config.max_chunks) and done < len(ends):
        last = min(done + config.tokens, len(ends)) - 1
        end = ends[last]
        if last < len(ends) - 1:
            cut = max(text.rfind(c, at + config.min_chars, end) for c in config.breaks)
            end = cut + 1 if cut >= 0 else end
        else:
            end = len(text)
        chunk = text[at:end].strip()
        if len(chunk) > config.min_embed_chars:
            out.append(chunk)
        at = end
        while done < len(ends) and ends[done] <= at:
            done += 1
    return out


def chunks(docs: DataFrame, config: Chunking = Chunking(), text: str = "text") -> DataFrame:
    """A row for each chunk of each text, with chunk_no from 1 and chunk in place of the text."""

    ship(docs.sparkSession)

    @F.pandas_udf("array<string>")
    def each(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield pd.Series([split_text(t, config) for t in s], dtype=object)

    others = [c for c in docs.columns if c != text]
    split = docs.select(*others, each.asNondeterministic()(F.col(text)).alias("_chunks"))
    return split.select(*others, F.posexplode("_chunks").alias("chunk_no", "chunk")).withColumn("chunk_no", F.col("chunk_no") + 1)
