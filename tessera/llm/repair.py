"""Mends the structure of conversations at the least cost, with an audit of the edits.

A conversation is right if the initials of its roles read `(s?(ua)+)?`. Its rows are walked by a machine of four states (nothing yet, after s,
after u, after a); each row is kept (0), given the role that the state wants (2) or deleted (3), and empty rows of that role may be
put in anywhere (2). Blank rows and repeats must be deleted; a truncated row that stays costs 1 more.

Conversations are bucketed by length and worked on together, time-major: from the last turn to the first the costs of all four states of all
conversations of a bucket are updated at once; then all trace their edits at once from the stored costs.

Two passes over the rows. The first sees flags and digests only (25 bytes a row), those of a conversation together, as its audit is one
value in any case. The second streams the texts in order past the audits, so no task holds the texts of a conversation.

Order: turn (nulls first), then the digest of role and text, so that ties have a defined order and repeats stand together. Nulls in
conv_id, role and text are one space, but a null conv_id stays null in results; null turns count for no gap. No rows give no rows; columns
besides conv_id, turn, role, text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import python_ready

SPACE = r"\x20\x09-\x0D"
#: Costs, and what no edit costs.
REROLE, DELETE, INSERT, CUT_OFF, NEVER = 2, 3, 2, 1, 1 << 29
#: Flags of a row: the initial of its role (s, u, a, other) in two bits, then these.
BLANK, TRUNCATED, PAIR, REPEAT = 4, 8, 16, 32
#: The state after an empty or kept row of the role that each state wants; that role; the state after a kept row by initial, -1 for none.
THEN = np.array([2, 2, 3, 2])
WANTED = ("user", "user", "assistant", "user")
KEPT = np.array([[1, 2, -1, -1], [-1, 2, -1, -1], [-1, -1, 3, -1], [-1, 2, -1, -1]])
#: Turns and conversations that are worked on together: 16 bytes of costs each.
CELLS, TOGETHER = 1 << 20, 4096
REPORT = "gaps, blank, duplicate, truncated, illegal, cost, audit".split(", ")
_REPORT = ", ".join(f"{c} {'string' if c == 'audit' else 'bigint'}" for c in REPORT)


def _key(conv_id: Column) -> Column:
    """A text for each conv_id, also for the null one."""
    return F.when(conv_id.isNull(), "").otherwise(F.concat(F.lit("="), conv_id.cast("string")))


def _named(df: DataFrame, like: DataFrame) -> DataFrame:
    """`df` with conv_id, of the type that `like` has, in place of key. It doesn't pass through pandas, where a null would turn numbers into floats."""
    conv_id = F.when(F.col("key") != "", F.expr("substring(key, 2)").cast(dict(like.dtypes)["conv_id"])).alias("conv_id")
    return df.select(conv_id, *[c for c in df.columns if c != "key"])


def plain(conversations: DataFrame) -> DataFrame:
    """key, conv_id, turn, role, text, times: the rows as they are, nulls of role and text as one space."""
    return conversations.select(_key(F.col("conv_id")).alias("key"), "conv_id", F.col("turn").cast("bigint").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), F.lit(1).alias("times"))


def damaged(conversations: DataFrame) -> DataFrame:
    """plain() with faults, by crc32 of `conv_id:turn` mod 20: 0 drops the row (times 0), 1 empties its text, 2 takes its .!? away, 3 doubles it
    (times 2), 4 makes its role user."""
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    rows = plain(conversations).withColumn("fault", F.crc32(name) % 20)
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.withColumns({"text": text, "role": F.when(F.col("fault") == 4, "user").otherwise(F.col("role")), "times": F.when(F.col("fault") == 0, 0).when(F.col("fault") == 3, 2).otherwise(1)})
    return rows.drop("fault")


def _identity() -> Column:
    """What two rows of equal role and text share, and no others."""
    return F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))))


def costs(code: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Least costs to the end, [turn, state, conversation], of flags [turn, conversation]; turns from `length` on are none."""
    turns, many = code.shape
    out = np.empty((turns + 1, 4, many), np.int32)
    initial, must, late = code & 3, (code & (BLANK | REPEAT)) > 0, np.where(code & TRUNCATED, CUT_OFF, 0).astype(np.int32)
    from_right = np.array([0, NEVER, NEVER, 0], np.int32)[:, None]

    def put_in(c: np.ndarray) -> None:  # empty rows before the next edit
        c[2] = np.minimum(c[2], c[3] + INSERT)
        np.minimum(c[[0, 1, 3]], c[2] + INSERT, out=(rest := np.empty_like(c[[0, 1, 3]])))
        c[[0, 1, 3]] = rest

    out[turns] = from_right
    put_in(out[turns])
    for t in range(turns - 1, -1, -1):
        after, now = out[t + 1], out[t]
        i = initial[t]
        user = np.where(i == 1, after[2], NEVER)
        now[0] = np.where(i == 0, after[1], user)
        now[1] = now[3] = user
        now[2] = np.where(i == 2, after[3], NEVER)
        np.minimum(now, after[THEN] + REROLE, out=now)
        now += late[t]
        now[:, must[t]] = NEVER
        np.minimum(now, after + DELETE, out=now)
        put_in(now)
        none = t >= length
        now[:, none] = after[:, none]
    return out


def trace(code: np.ndarray, length: np.ndarray, cost: np.ndarray) -> list[str]:
    """The ASCII-least of the cheapest edits of each conversation: D, I, K and R are tried in this order, as equal costs so far and an equal
    state mean equal ways on."""
    many = len(length)
    turn, state, live = np.zeros(many, np.int64), np.zeros(many, np.int64), np.arange(many)
    letters: list[tuple[np.ndarray, np.ndarray]] = []
    while True:
        left = cost[turn[live], state[live], live]
        live, left = (live[go], left[go]) if not (go := (turn[live] < length[live]) | (left > 0)).all() else (live, left)
        if not len(live):
            break
        t, s = turn[live], state[live]
        row = t < length[live]
        ahead = np.where(row, t + 1, t)
        flags = code[np.minimum(t, len(code) - 1), live] if len(code) else np.zeros(len(live), np.uint8)
        kept = KEPT[s, flags & 3]
        late = np.where(flags & TRUNCATED, CUT_OFF, 0)
        delete = row & (cost[ahead, s, live] + DELETE == left)
        insert = ~delete & (cost[t, THEN[s], live] + INSERT == left)
        keep = ~delete & ~insert & row & ((flags & (BLANK | REPEAT)) == 0) & (kept >= 0) & (cost[ahead, kept, live] + late == left)
        state[live] = np.where(delete, s, np.where(keep, kept, THEN[s]))
        turn[live] = np.where(insert, t, ahead)
        letters.append((live, np.where(delete, ord("D"), np.where(insert, ord("I"), np.where(keep, ord("K"), ord("R")))).astype(np.uint8)))
    if not letters:
        return [""] * many
    who, what = np.concatenate([w for w, _ in letters]), np.concatenate([x for _, x in letters])
    what = what[np.argsort(who, kind="stable")].tobytes().decode("ascii")
    ends = np.cumsum(np.bincount(who, minlength=many))
    return [what[a:b] for a, b in zip(np.concatenate([[0], ends[:-1]]), ends, strict=True)]


def edits(codes: list[np.ndarray]) -> tuple[np.ndarray, list[str]]:
    """Cost and audit of each conversation of flags. Buckets hold lengths up to the next power of two."""
    lengths = np.array([len(c) for c in codes], np.int64)
    cost, audit = np.zeros(len(codes), np.int64), [""] * len(codes)
    bucket = np.ceil(np.log2(np.maximum(lengths, 1))).astype(int)
    for b in np.unique(bucket):
        members = np.flatnonzero((bucket == b) & (lengths > 0))
        step = max(1, CELLS >> b)
        for some in (members[i : i + step] for i in range(0, len(members), step)):
            code = np.zeros((lengths[some].max(), len(some)), np.uint8)
            for j, m in enumerate(some):
                code[: lengths[m], j] = codes[m]
            table = costs(code, lengths[some])
            cost[some] = table[0, 0]
            for m, a in zip(some, trace(code, lengths[some], table), strict=True):
                audit[m] = a
    return cost, audit


def audits(rows: DataFrame) -> DataFrame:
    """key and REPORT of each conversation of plain() or damaged() rows. A row's first fault counts: blank, duplicate (its role and text
    came earlier), truncated (its last character but white space is none of .!?). illegal: neighbours whose initials aren't su, ua or au."""
    python_ready(rows.sparkSession)
    here = F.col("times") > 0
    blank = ~F.col("text").rlike(f"[^{SPACE}]")
    truncated = ~F.col("text").rlike(rf"[.!?][{SPACE}]*\z")
    initial = F.substring("role", 1, 1)
    code = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3) + F.when(blank, BLANK).when(truncated, TRUNCATED).otherwise(0) + F.when(F.col("times") == 2, PAIR).otherwise(0)
    turn = F.when(here, F.col("turn"))
    found = rows.groupBy("key").agg(
        (F.max(turn) - F.min(turn) + 1).alias("span"),
        F.sort_array(F.collect_list(F.when(here, F.struct("turn", _identity().alias("id"), code.cast("int").alias("code"))))).alias("rows"),
    )
    turns = F.array_compact(F.array_distinct(F.col("rows.turn")))
    found = found.select("key", F.coalesce(F.col("span") - F.size(turns), F.lit(0)).cast("bigint").alias("gaps"), F.col("rows.id").alias("ids"), F.col("rows.code").alias("codes"))

    def report(frame: pd.DataFrame) -> pd.DataFrame:
        codes = [np.asarray(c, np.uint8) for c in frame["codes"]]
        sizes = [np.where(c & PAIR, 2, 1) for c in codes]
        whole = np.concatenate([np.empty(0, np.uint8), *(np.repeat(c, n) for c, n in zip(codes, sizes, strict=True))])
        lengths = np.array([n.sum() for n in sizes], np.int64)
        who = np.repeat(np.arange(len(frame)), lengths)
        ids = [i for seen, n in zip(frame["ids"], sizes, strict=True) for i in np.repeat(np.asarray(seen, object), n)]
        again = pd.DataFrame({"who": who, "id": pd.Series(ids, dtype=object)}).duplicated().to_numpy(bool) & ((whole & BLANK) == 0)
        whole = np.where(again, (whole & ~np.uint8(TRUNCATED)) | REPEAT, whole)
        a, b, same = whole[:-1] & 3, whole[1:] & 3, who[:-1] == who[1:]
        wrong = same & ~(((a == 0) & (b == 1)) | ((a == 1) & (b == 2)) | ((a == 2) & (b == 1)))
        ends = np.cumsum(lengths)
        cost, audit = edits([whole[e - n : e] for e, n in zip(ends, lengths, strict=True)])
        count = lambda where: np.bincount(who[: len(where)][where], minlength=len(frame))
        return pd.DataFrame({"key": frame["key"], "gaps": frame["gaps"], "blank": count((whole & BLANK) > 0), "duplicate": count(again), "truncated": count((whole & TRUNCATED) > 0), "illegal": count(wrong), "cost": cost, "audit": audit})

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting, turns = [], 0
        for frame in frames:
            waiting.append(frame)
            turns += sum(map(len, frame["codes"]))
            if turns >= CELLS or sum(map(len, waiting)) >= TOGETHER:
                yield report(pd.concat(waiting, ignore_index=True))
                waiting, turns = [], 0
        if waiting:
            yield report(pd.concat(waiting, ignore_index=True))

    return found.mapInPandas(each, f"key string, {_REPORT}")


def _arranged(rows: DataFrame, reports: DataFrame) -> DataFrame:
    """Each conversation's report and then its rows in order, in one task, sorted by Spark."""
    texts = rows.where(F.col("times") > 0).select("key", F.lit(1).alias("kind"), "turn", _identity().alias("id"), "role", "text", F.explode(F.array_repeat(F.lit(0), F.col("times"))).alias("copy")).drop("copy")
    both = reports.select("key", F.lit(0).alias("kind"), F.struct(*REPORT).alias("report")).unionByName(texts, allowMissingColumns=True)
    return both.repartition("key").sortWithinPartitions("key", "kind", "turn", "id").drop("turn", "id")


def _mended(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[str, dict, Iterator[tuple[str, str, str]]]]:
    """(key, report, its edits as (edit, role, text)) of each conversation of _arranged(), one row at a time. A conversation must be read to its end."""

    def records() -> Iterator[tuple]:
        for f in frames:
            yield from f[["key", "report", "role", "text"]].itertuples(index=False, name=None)

    rows = records()
    ahead = next(rows, None)

    def walk(audit: str) -> Iterator[tuple[str, str, str]]:
        nonlocal ahead
        state = 0
        for edit in audit:
            role = WANTED[state]
            if edit == "I":
                yield edit, role, ""
            else:
                old, text, ahead = ahead[-2], ahead[-1], next(rows, None)
                role = old if edit != "R" else role
                yield edit, role, text
            if edit != "D":
                state = int(KEPT[state]["sua".index(role[0])])

    while ahead is not None:
        key, report, ahead = ahead[0], ahead[1], next(rows, None)
        yield key, report, walk(report["audit"])


def repaired(rows: DataFrame) -> DataFrame:
    """conv_id, place (from 0), edit (K, R or I), role, text: the conversations of plain() or damaged() rows, mended."""
    python_ready(rows.sparkSession)

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        size = 0
        for key, _, walk in _mended(frames):
            for place, (edit, role, text) in enumerate(e for e in walk if e[0] != "D"):
                out.append((key, place, edit, role, text))
                size += len(text)
                if len(out) >= TOGETHER or size >= 1 << 24:
                    yield pd.DataFrame(out, columns=["key", "place", "edit", "role", "text"])
                    out, size = [], 0
        if out:
            yield pd.DataFrame(out, columns=["key", "place", "edit", "role", "text"])

    return _named(_arranged(rows, audits(rows)).mapInPandas(each, "key string, place bigint, edit string, role string, text string"), rows)


def digests(rows: DataFrame) -> DataFrame:
    """REPORT and repaired_sha256 (`role:text` of the mended rows, joined by line feeds) of each conversation of plain() or damaged() rows.
    One without rows: zeros, an empty audit, the digest of nothing."""
    python_ready(rows.sparkSession)

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        for key, report, walk in _mended(frames):
            whole, first = hashlib.sha256(), True
            for edit, role, text in walk:
                if edit != "D":
                    whole.update(f"{'' if first else chr(10)}{role}:{text}".encode())
                    first = False
            out.append((key, *(report[c] for c in REPORT), whole.hexdigest()))
            if len(out) >= TOGETHER:
                yield pd.DataFrame(out, columns=["key", *REPORT, "repaired_sha256"])
                out = []
        if out:
            yield pd.DataFrame(out, columns=["key", *REPORT, "repaired_sha256"])

    return _named(_arranged(rows, audits(rows)).mapInPandas(each, f"key string, {_REPORT}, repaired_sha256 string"), rows)


#: digests() of damaged() rows in DuckDB, over the table conversations, whose turns have different numbers: a machine of four states goes forward over the rows
#: and keeps the best (cost, audit) of each state, which is enough as no two equal costs of a state have audits of which one begins the other.
DIGESTS_SQL = r"""
WITH RECURSIVE named AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations),
faults AS (
  SELECT conv_id, turn, role, text, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(name, ''), lambda x: ord(x)::BIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda v, k: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::BIGINT) ELSE v >> 1 END)), 4294967295::BIGINT) % 20 AS fault FROM named),
damaged AS (
  SELECT conv_id, turn, copy, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
    CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text FROM faults, range(2) AS r(copy) WHERE fault <> 0 AND (copy = 0 OR fault = 3)),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, copy) AS t, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again,
    NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank FROM damaged),
flagged AS (
  SELECT *, again AND NOT blank AS duplicate, NOT blank AND NOT again AND NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS truncated, left(role, 1) AS initial,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY t) || left(role, 1) AS pair FROM placed),
counted AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated,
    count(*) FILTER (pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal FROM flagged GROUP BY conv_id),
walk AS (
  SELECT conv_id, 0::BIGINT AS t, CASE i WHEN 0 THEN 0 WHEN 1 THEN 2 ELSE 3 END AS state, {'cost': 2 * i, 'audit': repeat('I', i::BIGINT), 'said': CASE i WHEN 0 THEN '' WHEN 1 THEN 'user:' ELSE 'user:' || chr(10) || 'assistant:' END} AS best
  FROM counted, (VALUES (0), (1), (2)) v(i)
  UNION ALL
  SELECT conv_id, t, state, min({'cost': cost, 'audit': audit, 'said': said}) AS best FROM (
    SELECT conv_id, t, CASE i WHEN 0 THEN after WHEN 1 THEN CASE WHEN after = 2 THEN 3 ELSE 2 END ELSE CASE WHEN after = 2 THEN 2 ELSE 3 END END AS state, cost + 2 * i AS cost, audit || repeat('I', i::BIGINT) AS audit,
      array_to_string(list_filter([said, CASE WHEN i > 0 THEN CASE WHEN after = 2 THEN 'assistant:' ELSE 'user:' END END, CASE WHEN i > 1 THEN CASE WHEN after = 2 THEN 'user:' ELSE 'assistant:' END END], lambda x: x <> ''), chr(10)) AS said
    FROM (
      SELECT w.conv_id, f.t, edit, w.best.audit || edit AS audit,
        CASE edit WHEN 'D' THEN state WHEN 'R' THEN CASE WHEN state = 2 THEN 3 ELSE 2 END ELSE CASE WHEN initial = 's' AND state = 0 THEN 1 WHEN initial = 'u' AND state <> 2 THEN 2 WHEN initial = 'a' AND state = 2 THEN 3 END END AS after,
        w.best.cost + CASE edit WHEN 'D' THEN 3 WHEN 'R' THEN 2 ELSE 0 END + CASE WHEN edit <> 'D' AND truncated THEN 1 ELSE 0 END AS cost,
        CASE WHEN edit = 'D' THEN w.best.said ELSE array_to_string(list_filter([w.best.said, CASE WHEN edit = 'K' THEN role WHEN state = 2 THEN 'assistant' ELSE 'user' END || ':' || text], lambda x: x <> ''), chr(10)) END AS said
      FROM walk w JOIN flagged f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.t = w.t + 1, (VALUES ('D'), ('K'), ('R')) e(edit) WHERE edit = 'D' OR NOT (blank OR duplicate)) s, (VALUES (0), (1), (2)) v(i)
    WHERE after IS NOT NULL) x GROUP BY conv_id, t, state),
ended AS (SELECT w.conv_id, min(w.best) AS best FROM walk w JOIN counted c ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND w.t = c.n WHERE state IN (0, 3) GROUP BY w.conv_id)
SELECT a.conv_id, coalesce(c.gaps, 0)::BIGINT AS gaps, coalesce(c.blank, 0)::BIGINT AS blank, coalesce(c.duplicate, 0)::BIGINT AS duplicate, coalesce(c.truncated, 0)::BIGINT AS truncated, coalesce(c.illegal, 0)::BIGINT AS illegal,
  coalesce(e.best.cost, 0)::BIGINT AS cost, coalesce(e.best.audit, '') AS audit, sha256(coalesce(e.best.said, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM a.conv_id
"""
