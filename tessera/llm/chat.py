"""Chat formatting by a prefix tree: conversations that begin with the same turns share these, once.

Template. A turn is `<s>[INST] text [/INST]` of a user, ` text </s>` after an opening `<a>` of an assistant, `<<SYS>> text <</SYS>>` of a system,
and `<t>role<:> text </t>` of any other role. Within texts and roles a backslash is doubled, and each control string gets one after its first
character, so no control string is left in them and the escape can be undone. No control string overlaps itself, so the first end mark
after a begin mark is the turn's. Only an assistant's text is under the loss mask.

Packs. Conversations are ordered by the digests of their turns, so those with a common beginning stand together, and are cut into packs of
about PACK characters. Within a pack a conversation adds only the turns that the one before doesn't share: the pack is a forest of prefix
trees, depth first, each shared turn once. The first conversation of a pack is written whole, as a pack is a training sequence of its
own and attends to nothing outside; a first turn that a third of all conversations share is thus written once a pack. A node has its
place in the pack (start, end), the position of its first token (tokens count from the tree's root, so positions run on along each
branch), and the intervals of the pack that its tokens attend to besides the earlier ones of its own: those of its ancestors, neighbours joined.
A token is a code point, unless a vocabulary file of the tokenizers library is given.

What is together in one task: the digests of a conversation (a text of 32 characters a turn, by which it is ordered) and a pack, row by row.

Order of turns: turn (nulls first), then digest. Null text and null role are empty; conversations with a null conv_id are one. Rows
that repeat are turns that repeat. No rows give no rows; columns besides conv_id, turn, role, text are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import python_ready, stored

#: The marks around the text of each role, and of others, whose role stands between the first two.
MARKS = {"user": ("<s>[INST] ", " [/INST]"), "assistant": ("<a> ", " </s>"), "system": ("<<SYS>> ", " <</SYS>>")}
OTHER = ("<t>", "<:> ", " </t>")
CONTROLS = ["<s>", "</s>", "<a>", "</a>", "<t>", "</t>", "<:>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
_ESCAPED = re.compile("|".join(["\\\\", *map(re.escape, sorted(CONTROLS, key=len, reverse=True))]))
_BEGINS = {begin: (role, end) for role, (begin, end) in MARKS.items()}
_BEGIN = re.compile("|".join(map(re.escape, [*_BEGINS, OTHER[0]])))
#: Characters of a pack, about. A conversation beyond has a pack of its own.
PACK = 1 << 20
#: Characters of a turn's marks, in the estimate of a pack's size.
MARKUP = 20
NODE = "pack bigint, place bigint, depth int, conv_id string, start bigint, end bigint, position bigint, attends array<struct<start:bigint,end:bigint>>, loss_start bigint, loss_end bigint, text string"


def escape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def render(role: str, text: str) -> tuple[str, int, int]:
    """A turn in the template, and where its text stands under the loss mask (0, 0: nowhere)."""
    begin, end = MARKS.get(role) or (OTHER[0] + escape(role) + OTHER[1], OTHER[2])
    body = escape(text)
    span = (len(begin), len(begin) + len(body)) if role == "assistant" else (0, 0)
    return begin + body + end, *span


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) of turns in the template."""
    out, at = [], 0
    while at < len(formatted):
        m = _BEGIN.match(formatted, at)
        if m is None:
            raise ValueError(f"no turn begins at character {at}")
        role, end = _BEGINS.get(m[0], (None, OTHER[2]))
        at = m.end()
        if role is None:
            stop = formatted.index(OTHER[1], at)
            role, at = unescape(formatted[at:stop]), stop + len(OTHER[1])
        stop = formatted.index(end, at)
        out.append((role, unescape(formatted[at:stop])))
        at = stop + len(end)
    return out


def _key(conv_id: Column) -> Column:
    return F.when(conv_id.isNull(), "").otherwise(F.concat(F.lit("="), conv_id.cast("string")))


def _turns(conversations: DataFrame) -> DataFrame:
    """key, turn, id, role, text: a row each turn; equal ids are equal turns."""
    rows = conversations.select(_key(F.col("conv_id")).alias("key"), F.col("turn").cast("bigint").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.withColumn("id", F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))))


def order(turns: DataFrame, pack: int = PACK) -> DataFrame:
    """key, pack, rank, shared, ahead: where each conversation stands. shared: turns of it that the one before it in its pack has written;
    ahead: those that the next one shares with it."""
    python_ready(turns.sparkSession)
    one = F.sort_array(F.collect_list(F.struct("turn", "id", F.length("text").alias("size"))))
    paths = turns.groupBy("key").agg(one.alias("t")).select("key", F.array_join("t.id", "").alias("path"), F.col("t.size").alias("sizes"))
    ordered = paths.repartitionByRange("path", "key").sortWithinPartitions("path", "key")

    def common(a: str, b: str) -> int:
        """Leading turns that two paths share, by bisection."""
        low, high = 0, min(len(a), len(b)) // 32
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if a[: middle * 32] == b[: middle * 32] else (low, middle - 1)
        return low

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        number, rank, used, last, held = TaskContext.get().partitionId() << 36, 0, 0, None, None
        for f in frames:
            out = []
            for key, path, sizes in f[["key", "path", "sizes"]].itertuples(index=False, name=None):
                same = 0 if last is None else common(last, path)
                new = int(sizes[same:].sum()) + MARKUP * (len(sizes) - same)
                if used and used + new > pack:
                    number, rank, used, same = number + 1, 0, 0, 0
                    new = int(sizes.sum()) + MARKUP * len(sizes)
                if held:
                    out.append((*held, same))
                held = (key, number, rank, same)
                rank, used, last = rank + 1, used + new, path
            yield pd.DataFrame(out, columns=["key", "pack", "rank", "shared", "ahead"])
        if held:
            yield pd.DataFrame([(*held, 0)], columns=["key", "pack", "rank", "shared", "ahead"])

    return ordered.mapInPandas(each, "key string, pack bigint, rank bigint, shared int, ahead int")


def _arranged(conversations: DataFrame, pack: int) -> DataFrame:
    """The new turns of each conversation after a row for the conversation itself (k = -1), a pack in one task and sorted by Spark. Turns that an
    earlier conversation of the pack writes stay where they are."""
    turns = _turns(conversations)
    places = stored(order(turns, pack))
    k = F.row_number().over(Window.partitionBy("key").orderBy("turn", "id")) - 1
    new = turns.withColumn("k", k).join(places.select("key", "pack", "rank", "shared"), "key").where(F.col("k") >= F.col("shared"))
    both = new.select("pack", "rank", "k", "role", "text").unionByName(places.withColumn("k", F.lit(-1)), allowMissingColumns=True)
    return both.repartition("pack").sortWithinPartitions("pack", "rank", "k")


def _walk(frames: Iterator[pd.DataFrame], measure) -> Iterator[tuple]:
    """("conversation", key, shared, ahead) and the ("node", ...) that it adds, of the rows of _arranged()."""
    pack = None
    for f in frames:
        for number, rank, k, role, text, key, shared, ahead in f[["pack", "rank", "k", "role", "text", "key", "shared", "ahead"]].itertuples(index=False, name=None):
            if k < 0:
                if number != pack:
                    pack, end, path = number, 0, []
                name, keep = key, int(ahead)
                del path[int(shared) :]
                yield "conversation", key, int(shared), keep
                tip = path[-1] if path else None
                continue
            formatted, mask_start, mask_end = render(role, text)
            size = measure(formatted)
            start, end = end, end + size
            position, attends = (0, ()) if tip is None else (tip[0], tip[1])
            yield "node", pack, rank, k, name, start, end, position, attends, mask_start, mask_end, formatted
            joined = (*attends[:-1], (attends[-1][0], end)) if attends and attends[-1][1] == start else (*attends, (start, end))
            tip = (position + size, joined)
            if k < keep:  # the only ones that a later conversation comes back to
                path.append(tip)


def formatted(conversations: DataFrame, pack: int = PACK, vocabulary: str | None = None) -> DataFrame:
    """NODE rows of all conversations. place: the rank in the pack of the conversation conv_id (as text, null for the null one) that wrote the
    node; depth: its turn there. loss_start and loss_end count characters within `text`. With a vocabulary, start, end, position and attends count
    its tokens, each node encoded by itself, and `ids` has them."""
    python_ready(conversations.sparkSession)

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens, measure = [], len
        if vocabulary:
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(vocabulary)

            def measure(text: str) -> int:
                tokens.append(tokenizer.encode(text, add_special_tokens=False).ids)
                return len(tokens[-1])

        out, size = [], 0
        columns = [c.split()[0] for c in NODE.split(", ")]

        def batch() -> pd.DataFrame:
            frame = pd.DataFrame(out, columns=columns)
            frame["conv_id"] = [c[1:] if c else None for c in frame["conv_id"]]
            frame["attends"] = [[{"start": a, "end": b} for a, b in x] for x in frame["attends"]]
            return frame.assign(ids=pd.Series(tokens[:], dtype=object)) if vocabulary else frame

        for kind, *node in _walk(frames, measure):
            if kind == "node":
                out.append(node)
                size += len(node[-1])
                if len(out) >= 4096 or size >= 1 << 24:
                    yield batch()
                    out, size = [], 0
                    tokens.clear()
        if out:
            yield batch()

    return _arranged(conversations, pack).mapInPandas(each, NODE + (", ids array<int>" if vocabulary else ""))


def digests(conversations: DataFrame, pack: int = PACK) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of each conversation, read back from the nodes as they
    are written: its own and those of the ancestors that it shares are parsed and unescaped. turns_sha256: role, line feed, text, line feed of
    each turn. A digest of the shared turns is kept where the next conversation branches off, not their texts."""
    python_ready(conversations.sparkSession)
    columns = ["key", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        path: list[tuple] = []  # of each shared depth: digests and counts up to there
        out: list[tuple] = []
        key = state = None

        def result() -> tuple:
            n, turns, loss_chars, loss, chars = state
            return key, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars

        for kind, *what in _walk(frames, len):
            if kind == "conversation":
                if state is not None:
                    out.append(result())
                key, shared, keep = what
                del path[shared:]
                state = path[-1] if path else (0, hashlib.sha256(), 0, hashlib.sha256(), 0)
                if len(out) >= 4096:
                    yield pd.DataFrame(out, columns=columns)
                    out = []
            else:
                depth, start, end, text = what[2], *what[-3:]
                n, turns, loss_chars, loss, chars = state
                turns, loss = turns.copy(), loss.copy()
                for role, said in parse(text):
                    turns.update(f"{role}\n{said}\n".encode())
                    n += 1
                masked = unescape(text[start:end])
                loss.update(masked.encode())
                state = (n, turns, loss_chars + len(masked), loss, chars + len(text))
                if depth < keep:
                    path.append(state)
        if state is not None:
            out.append(result())
        if out:
            yield pd.DataFrame(out, columns=columns)

    found = _arranged(conversations, pack).mapInPandas(each, "key string, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
    conv_id = F.when(F.col("key") != "", F.expr("substring(key, 2)").cast(dict(conversations.dtypes)["conv_id"])).alias("conv_id")
    return found.select(conv_id, *columns[1:])


def _sql_marks() -> str:
    """Characters of a turn's marks by role, in SQL."""
    known = " ".join(f"WHEN '{role}' THEN {len(begin + end)}" for role, (begin, end) in MARKS.items())
    return f"CASE role {known} ELSE {len(''.join(OTHER))} + length(role) + len(regexp_extract_all(role, '{_ESCAPED.pattern}')) END"


#: digests() in DuckDB, over the table conversations and the conversation -7; turns of a conversation have different numbers there.
DIGESTS_SQL = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, turn, role, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) v(turn, role))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(text) + len(regexp_extract_all(text, '{_ESCAPED.pattern}')) + {_sql_marks()})::BIGINT AS formatted_chars
FROM turns GROUP BY conv_id
"""
