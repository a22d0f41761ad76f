"""The tools for weather, memory and recognition as table functions of SQL: each takes a table, and its result's columns follow the table's.

    SELECT * FROM weather_current(TABLE(observations), place => 'city', unit => 'fahrenheit')

A function says itself by what its table is partitioned and sorted, so a place's or user's rows come together to one task, one at a time; what a task
holds is bounded by a limit of the tool. Options are checked when the query is analysed. Names of columns are options, with defaults.
"""

from __future__ import annotations

import datetime
import heapq
import json
import math
from collections.abc import Iterator
from typing import Any

from pyspark.sql import Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

from tessera.session import ship

#: Least and most of the tools' numbers, and their units.
DAYS, PLACES, MEMORIES = (1, 16), (1, 10), (1, 100)
UNITS = ("celsius", "fahrenheit")
#: Columns of temperatures, by the beginning of their names.
TEMPERATURE = "temperature"


def _value(arg: AnalyzeArgument | None, default: Any, name: str) -> Any:
    if arg is None:
        return default
    if arg.isTable or not arg.isConstantExpression:
        raise ValueError(f"{name} must be a constant")
    return default if arg.value is None else arg.value


def _columns(table: AnalyzeArgument, *names: str) -> StructType:
    if not table.isTable:
        raise ValueError("the first argument must be TABLE(...)")
    missing = [n for n in names if n not in table.dataType.names]
    if missing:
        raise ValueError(f"no column {', '.join(missing)} in the table")
    return table.dataType


def _within(n: Any, bounds: tuple[int, int], name: str) -> int:
    if not bounds[0] <= int(n) <= bounds[1]:
        raise ValueError(f"{name} must be between {bounds[0]} and {bounds[1]}")
    return int(n)


def _schema(table: StructType, drop: tuple[str, ...] = (), double: str | None = None, **more: Any) -> StructType:
    out = StructType()
    for f in table.fields:
        if f.name not in drop and f.name not in more:
            out = out.add(f.name, DoubleType() if double and f.name.startswith(double) else f.dataType, True)
    for name, kind in more.items():
        out = out.add(name, kind, True)
    return out


def _row(row: Row, names: list[str], unit: str) -> list:
    """The values of a row by name, temperatures as numbers in the unit."""
    out = []
    for n in names:
        v = row[n]
        if n.startswith(TEMPERATURE) and v is not None:
            v = float(v) * 9 / 5 + 32 if unit == "fahrenheit" else float(v)
        out.append(v)
    return out


class _Weather:
    """A place's observations by time. A unit that isn't known is celsius."""

    @staticmethod
    def _analyzed(observations, place, time, unit) -> AnalyzeResult:
        place, time = _value(place, "place", "place"), _value(time, "time", "time")
        _value(unit, "celsius", "unit")
        return AnalyzeResult(_schema(_columns(observations, place, time), double=TEMPERATURE, unit=StringType()), partitionBy=[PartitioningColumn(f"`{place}`")], orderBy=[OrderingColumn(f"`{time}`")])

    def _emit(self, row: Row, unit: str | None) -> tuple:
        unit = unit.lower() if unit and unit.lower() in UNITS else "celsius"
        return (*_row(row, [n for n in row.__fields__ if n != "unit"], unit), unit)


class WeatherCurrent(_Weather):
    """The last observation of each place; of several at one time the one with the greatest values as text."""

    @staticmethod
    def analyze(observations: AnalyzeArgument, place: AnalyzeArgument = None, time: AnalyzeArgument = None, unit: AnalyzeArgument = None) -> AnalyzeResult:
        return _Weather._analyzed(observations, place, time, unit)

    def __init__(self) -> None:
        self.last = None

    def eval(self, observations: Row, place: str = "place", time: str = "time", unit: str = "celsius") -> Iterator[tuple]:
        self.unit = unit
        if observations[time] is not None and (self.last is None or observations[time] > self.last[time] or (observations[time] == self.last[time] and str(observations) > str(self.last))):
            self.last = observations
        return iter(())

    def terminate(self) -> Iterator[tuple]:
        if self.last is not None:
            yield self._emit(self.last, self.unit)


class WeatherForecast(_Weather):
    """The first `days` rows of each place by time, 7 if not given, 1 to 16."""

    @staticmethod
    def analyze(observations: AnalyzeArgument, place: AnalyzeArgument = None, time: AnalyzeArgument = None, days: AnalyzeArgument = None, unit: AnalyzeArgument = None) -> AnalyzeResult:
        _within(_value(days, 7, "days"), DAYS, "days")
        return _Weather._analyzed(observations, place, time, unit)

    def __init__(self) -> None:
        self.n = 0

    def eval(self, observations: Row, place: str = "place", time: str = "time", days: int = 7, unit: str = "celsius") -> Iterator[tuple]:
        if self.n < (7 if days is None else days):
            self.n += 1
            yield self._emit(observations, unit)


class WeatherHistorical(_Weather):
    """The rows of each place on a day (yyyy-MM-dd)."""

    @staticmethod
    def analyze(observations: AnalyzeArgument, date: AnalyzeArgument, place: AnalyzeArgument = None, time: AnalyzeArgument = None, unit: AnalyzeArgument = None) -> AnalyzeResult:
        day = _value(date, None, "date")
        if day is None or len(str(day)) != 10:
            raise ValueError("date must be yyyy-MM-dd")
        datetime.date.fromisoformat(str(day))
        return _Weather._analyzed(observations, place, time, unit)

    def eval(self, observations: Row, date: str, place: str = "place", time: str = "time", unit: str = "celsius") -> Iterator[tuple]:
        if str(observations[time])[:10] == str(date):
            yield self._emit(observations, unit)


class WeatherGeocode:
    """The first `limit` candidates of each query by position, 5 if not given, 1 to 10."""

    @staticmethod
    def analyze(candidates: AnalyzeArgument, query: AnalyzeArgument = None, position: AnalyzeArgument = None, limit: AnalyzeArgument = None) -> AnalyzeResult:
        _within(_value(limit, 5, "limit"), PLACES, "limit")
        query, position = _value(query, "query", "query"), _value(position, "pos", "position")
        table = _columns(candidates, query, position)
        return AnalyzeResult(_schema(table, rank=IntegerType()), partitionBy=[PartitioningColumn(f"`{query}`")], orderBy=[OrderingColumn(f"`{position}`")])

    def __init__(self) -> None:
        self.n = 0

    def eval(self, candidates: Row, query: str = "query", position: str = "pos", limit: int = 5) -> Iterator[tuple]:
        if self.n < (5 if limit is None else limit):
            self.n += 1
            yield (*[candidates[n] for n in candidates.__fields__ if n != "rank"], self.n)


class MemorySearch:
    """The `limit` items of a user most like a vector by cosine, with score; ties to the smaller id as text. Only the user's items are scored. Items whose
    vector is null, of another length, or zero aren't found."""

    @staticmethod
    def analyze(items: AnalyzeArgument, vector: AnalyzeArgument, user_id: AnalyzeArgument, user: AnalyzeArgument = None, embedding: AnalyzeArgument = None, id: AnalyzeArgument = None, limit: AnalyzeArgument = None) -> AnalyzeResult:
        _within(_value(limit, 5, "limit"), MEMORIES, "limit")
        user, embedding, id = _value(user, "user_id", "user"), _value(embedding, "embedding", "embedding"), _value(id, "id", "id")
        table = _columns(items, user, embedding, id)
        return AnalyzeResult(_schema(table, drop=(embedding,), score=DoubleType()), partitionBy=[PartitioningColumn(f"`{user}`")])

    def __init__(self) -> None:
        self.best: list[tuple] = []
        self.n = 0

    def eval(self, items: Row, vector: list, user_id: Any, user: str = "user_id", embedding: str = "embedding", id: str = "id", limit: int = 5) -> Iterator[tuple]:
        v = items[embedding]
        if items[user] == user_id and v is not None and len(v) == len(vector) and None not in v:
            size = math.sqrt(sum(x * x for x in v)) * math.sqrt(sum(float(x) ** 2 for x in vector))
            if size > 0:
                score = round(sum(float(x) * float(y) for x, y in zip(v, vector, strict=True)) / size, 6)
                self.n += 1
                place = (score, tuple(-ord(c) for c in str(items[id])) + (1,), self.n)  # a text that begins another is the smaller one
                row = (*[items[n] for n in items.__fields__ if n not in (embedding, "score")], score)
                (heapq.heappush if len(self.best) < (5 if limit is None else limit) else heapq.heappushpop)(self.best, (*place, row))
        return iter(())

    def terminate(self) -> Iterator[tuple]:
        yield from (b[-1] for b in sorted(self.best, reverse=True))


class MemoryInsert:
    """The items with the default user for those without one, and why an item can't be stored (null: it can)."""

    @staticmethod
    def analyze(items: AnalyzeArgument, text: AnalyzeArgument = None, user: AnalyzeArgument = None, default_user: AnalyzeArgument = None) -> AnalyzeResult:
        return AnalyzeResult(_schema(_columns(items, _value(text, "text", "text"), _value(user, "user_id", "user")), error=StringType()))

    def eval(self, items: Row, text: str = "text", user: str = "user_id", default_user: str = "default") -> Iterator[tuple]:
        from tessera.config import Memory

        words, most = items[text], Memory().max_text
        error = "text must not be blank" if words is None or not words.strip() else f"text must be at most {most} characters" if len(words) > most else None
        who = items[user] if items[user] is not None and str(items[user]).strip() else default_user
        yield (*[who if n == user else items[n] for n in items.__fields__ if n != "error"], error)


class MemoryDelete:
    """The items but for the one of an id."""

    @staticmethod
    def analyze(items: AnalyzeArgument, memory_id: AnalyzeArgument, id: AnalyzeArgument = None) -> AnalyzeResult:
        return AnalyzeResult(_schema(_columns(items, _value(id, "id", "id"))))

    def eval(self, items: Row, memory_id: Any, id: str = "id") -> Iterator[tuple]:
        if items[id] is None or items[id] != memory_id:
            yield tuple(items)


class MemoryWipe:
    """The items of all users but one."""

    @staticmethod
    def analyze(items: AnalyzeArgument, user_id: AnalyzeArgument, user: AnalyzeArgument = None) -> AnalyzeResult:
        return AnalyzeResult(_schema(_columns(items, _value(user, "user_id", "user"))))

    def eval(self, items: Row, user_id: Any, user: str = "user_id") -> Iterator[tuple]:
        if items[user] is None or items[user] != user_id:
            yield tuple(items)


class OcrLines:
    """page_number, line_no and text of each line of each recognition payload, with its confidence, the language asked for and the table's other columns. A
    payload that can't be read is one row with an error."""

    @staticmethod
    def analyze(payloads: AnalyzeArgument, payload: AnalyzeArgument = None, lang: AnalyzeArgument = None) -> AnalyzeResult:
        payload = _value(payload, "payload", "payload")
        more = {"language": StringType(), "page_number": IntegerType(), "line_no": IntegerType(), "text": StringType(), "confidence": DoubleType(), "error": StringType()}
        return AnalyzeResult(_schema(_columns(payloads, payload), drop=(payload,), **more))

    def eval(self, payloads: Row, payload: str = "payload", lang: str = "en") -> Iterator[tuple]:
        made = ("language", "page_number", "line_no", "text", "confidence", "error")
        others = tuple(payloads[n] for n in payloads.__fields__ if n != payload and n not in made)
        try:
            pages = json.loads(payloads[payload] or "")["pages"] or []
            rows = [(lang, p.get("page_number"), i, line.get("text"), line.get("confidence")) for p in pages for i, line in enumerate(p.get("lines") or [], 1)]
        except (ValueError, TypeError, KeyError, AttributeError, RecursionError) as e:
            yield (*others, lang, None, None, None, None, f"unreadable payload: {type(e).__name__}")
            return
        for language, page, i, text, confidence in rows:
            yield (*others, language, page, i, text, None if confidence is None else float(confidence), None)


TOOLS = {
    "weather_current": WeatherCurrent, "weather_air_quality": WeatherCurrent, "weather_forecast": WeatherForecast, "weather_historical": WeatherHistorical, "weather_geocode": WeatherGeocode,
    "memory_search": MemorySearch, "memory_insert": MemoryInsert, "memory_delete": MemoryDelete, "memory_wipe": MemoryWipe, "ocr_lines": OcrLines,
}


def register(spark: SparkSession) -> list[str]:
    """Adds the tools to a session; returns their names."""
    ship(spark)
    for name, handler in TOOLS.items():
        spark.udtf.register(name, F.udtf(handler))
    return [*TOOLS]
