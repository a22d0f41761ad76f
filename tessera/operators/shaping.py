"""Nested payloads to rows: text recognition, daily series, places."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Languages that text recognition takes.
OCR_LANGUAGES = ("en", "pl", "de", "fr", "es", "it", "pt", "nl", "ru", "ch", "ja", "ko")


def zip_lines(texts: Column, scores: Column, polygons: Column) -> Column:
    """Lines of three parallel arrays, as many as the shortest has; a missing polygon array counts as empty polygons."""
    n = F.least(F.size(texts), F.size(scores), F.coalesce(F.size(polygons), F.size(texts)))
    line = lambda i: F.struct(
        F.get(texts, i).alias("text"), F.get(scores, i).cast("double").alias("confidence"),
        F.coalesce(F.get(polygons, i), F.array().cast("array<array<double>>")).alias("bounding_box"),
    )
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), line)).otherwise(F.array().cast("array<struct<text: string, confidence: double, bounding_box: array<array<double>>>>"))


def ocr_text(pages: Column) -> Column:
    """All lines of all pages, in order, joined by line feeds."""
    lines = F.flatten(F.transform(pages, lambda p: F.coalesce(p["lines"], F.array().cast("array<struct<text: string, confidence: double, bounding_box: array<array<double>>>>"))))
    return F.array_join(F.transform(lines, lambda x: x["text"]), "\n")


def ocr_lines(results: DataFrame, pages: str = "pages") -> DataFrame:
    """A row for each line, with page_number and line_no from 1."""
    others = [c for c in results.columns if c != pages]
    by_page = results.select(*others, F.explode(pages).alias("_p"))
    rows = by_page.select(*others, F.col("_p.page_number").alias("page_number"), F.posexplode("_p.lines").alias("_at", "_l"))
    return rows.select(*others, "page_number", (F.col("_at") + 1).alias("line_no"), "_l.text", "_l.confidence", "_l.bounding_box")


def known_language(language: Column, default: str = "en") -> Column:
    code = F.lower(language)
    return F.when(code.isin(*OCR_LANGUAGES), code).otherwise(default)


def daily_rows(series: DataFrame, arrays: dict[str, str], time: str = "time") -> DataFrame:
    """A row for each time of parallel arrays: other columns, date, and a column for each of `arrays` (array name to
    column), null past an array's end. A row without times gives one with the error `no_results`."""
    others = [c for c in series.columns if c not in (time, *arrays)]
    rows = series.select("*", F.posexplode_outer(time).alias("_at", "date"))
    return rows.select(*others, "date", *[F.when(F.col("_at").isNotNull(), F.get(a, F.col("_at"))).alias(c) for a, c in arrays.items()], F.when(F.col("date").isNull(), "no_results").alias("error"))


def best_match(candidates: DataFrame, query: str, position: str, country: Column) -> DataFrame:
    """For each query the first candidate of the wanted country, whatever its case, else the first at all."""
    wanted = F.when(F.upper("country_code") == F.upper(country), 0).otherwise(1)
    others = [c for c in candidates.columns if c != query]
    best = candidates.groupBy(query).agg(F.min_by(F.struct(*others), F.struct(wanted, F.col(position))).alias("_b"))
    return best.select(query, *[F.col(f"_b.{c}").alias(c) for c in others])


def date_error(date: Column, today: Column, years: int = 80) -> Column:
    """Why a string is no historical date; null if it is one. today: an injected date."""
    d = F.when(date.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(date, "yyyy-MM-dd"))
    return (
        F.when(date.isNull() | ~date.rlike(r"\S"), "date must not be blank").when(d.isNull(), "date must be in ISO format yyyy-MM-dd")
        .when(d >= today, "date must be strictly in the past").when(d < F.add_months(today, -12 * years), f"date must be within the last {years} years")
    )


def place_error(name: Column, label: str = "city", longest: int = 100) -> Column:
    """Why a string is no place name; null if it is one."""
    return (
        F.when(name.isNull() | ~name.rlike(r"\S"), f"{label} must not be blank").when(F.length(name) > longest, f"{label} must be at most {longest} characters")
        .when(~name.rlike(r"^[\p{L}\p{M}\p{N} .,'’()/-]+$"), f"{label} contains unsupported characters")
    )


def option(value: Column, allowed: list[str], default: str) -> Column:
    """A lower-case option, the default for one that isn't allowed."""
    v = F.lower(value)
    return F.when(v.isin(*allowed), v).otherwise(default)


def with_status(requests: DataFrame, answers: DataFrame, keys: list[str]) -> DataFrame:
    """Every request with its answer's columns and a status: ok, or no_results where no answer has its keys."""
    out = requests.join(answers.withColumn("_found", F.lit(True)), keys, "left")
    return out.withColumn("status", F.when(F.col("_found"), "ok").otherwise("no_results")).drop("_found")


def limit_error(limit: Column, least: int = 1, most: int = 10) -> Column:
    """Why a number of results can't be asked for; null if it can. A null limit is the default."""
    return F.when(~F.coalesce(limit.between(least, most), F.lit(True)), f"limit must be between {least} and {most}")


def limited(candidates: DataFrame, query: str, position: str, limit: Column, default: int = 5) -> DataFrame:
    """The first results of each query by position, as many as its valid limit says; an invalid one gives none."""
    ranked = candidates.withColumn("_at", F.row_number().over(Window.partitionBy(query).orderBy(position)))
    return ranked.where(limit_error(limit).isNull() & (F.col("_at") <= F.coalesce(limit, F.lit(default)))).drop("_at")


def first_day(series: DataFrame, arrays: dict[str, str], time: str = "time") -> DataFrame:
    """The first day of each row of parallel arrays: other columns, date, a column for each array, and the error no_results without days."""
    others = [c for c in series.columns if c not in (time, *arrays)]
    first = lambda a: F.get(F.col(a), F.lit(0))
    return series.select(*others, first(time).alias("date"), *[first(a).alias(c) for a, c in arrays.items()], F.when(first(time).isNull(), "no_results").alias("error"))


def measured(value: Column, unit: Column) -> Column:
    """struct(value, unit), null without a value."""
    return F.when(value.isNotNull(), F.struct(value.alias("value"), unit.alias("unit")))


def current_result(rows: DataFrame, place: list[str], measures: dict[str, tuple[str, str]]) -> DataFrame:
    """A nested result: location, a struct of the columns of `place`, and for each of `measures` (name to column of value and of unit) a struct of both."""
    return rows.select(F.struct(*place).alias("location"), *[measured(F.col(v), F.col(u)).alias(name) for name, (v, u) in measures.items()])


def polygons(raw: Column) -> Column:
    """Polygons from JSON arrays of points; one that is no list of pairs of numbers is empty."""
    points = F.from_json(raw, "array<array<double>>")
    good = F.forall(points, lambda p: (F.size(p) == 2) & F.forall(p, lambda x: x.isNotNull()))
    return F.when(F.coalesce(good, F.lit(False)), points).otherwise(F.array().cast("array<array<double>>"))


def cache_key(rows: DataFrame, text: str, into: str = "cache_key") -> DataFrame:
    """`rows` with the text in compatible composed form (NFKC), lower case and without white space at its ends; null for null."""

    @F.pandas_udf("string")
    def each(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield pd.Series([None if x is None else unicodedata.normalize("NFKC", x).strip().lower() for x in s], dtype=object)

    return rows.withColumn(into, each.asNondeterministic()(F.col(text)))
