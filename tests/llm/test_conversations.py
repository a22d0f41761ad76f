"""Audit of filters, repair and formatting of conversations, against plain twins."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib
from functools import cache

import pandas as pd
from tests.conftest import duck, normal

from tessera.llm import audit, chat, queries, repair

SF = "/root/testdata/sf0.001"
SPACE = " \t\n\v\f\r"


# -- the audit of filters ------------------------------------------------------------------------------------------------------------------


def test_audit_equals_sql(spark):
    r = random.Random(3)
    texts = ["", None, "a b c", "A B " * 150, "word " * 250, " ".join(f"w{i}" for i in range(250)), "price $5", "x y", "\x0b\x1c", "ÄÖ" * 300]
    docs = pd.DataFrame([(i % 40 if i % 7 else None, r.choice(texts), r.choice(["en", "de", "", None])) for i in range(120)], columns=["doc_id", "text", "lang"]).astype({"doc_id": "Int64"})
    labels = pd.DataFrame([(i, r.choice([0, 1, None]), r.choice([0, 1, None])) for i in [*range(30), *range(10), None]], columns=["doc_id", "quality", "toxic"]).astype("Int64")
    clean = lambda f: [tuple(None if pd.isna(v) else v.item() if hasattr(v, "item") else v for v in row) for row in f.itertuples(index=False)]
    d = spark.createDataFrame([(*row, 1, "clash") for row in clean(docs)], "doc_id long, text string, lang string, mask int, digest string")
    m = spark.createDataFrame([(*row, "x") for row in clean(labels)], "doc_id long, quality int, toxic int, part string")
    out = audit.audit(audit.histograms(d, m)).toPandas()
    assert len(out) == 3 * 600 and (out["shapley"] > 0).any() and (out["toxic_lost"] > 0).any()
    assert normal(out) == normal(duck(audit.AUDIT_SQL, documents=docs, labels=labels))
    # every order keeps the same documents, and what it removes and keeps is all of them
    last = out[out["step"] == 5].groupby("part")["kept"].nunique()
    assert (last == 1).all()


def test_audit_of_nothing(spark):
    empty = audit.histograms(spark.createDataFrame([], "doc_id long, text string, lang string"), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert audit.audit(empty).count() == 0


def test_matrices_count_each_mask_once():
    kept, removed, redundant, unique = audit.matrices()
    assert kept.shape == (32, 600) and kept.dtype.kind == "i"
    for m, order in itertools.product(range(32), range(0, 600, 5)):
        assert removed[m, order : order + 5].sum() + kept[m, order + 4] == 1
        assert (removed + redundant)[m, order : order + 5].sum() == bin(m).count("1")
        assert unique[m, order : order + 5].sum() == (bin(m).count("1") == 1)


# -- repair --------------------------------------------------------------------------------------------------------------------------------


def plain_damage(rows):
    """{conv_id: damaged (turn, role, text) in order} of (conv_id, turn, role, text)."""
    out = {}
    for conv, turn, role, text in rows:
        mine = out.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if fault == 0:
            continue
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        mine += [(turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    digest = lambda r: hashlib.md5(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()
    return {c: sorted(m, key=lambda r: (r[0] is not None, r[0] or 0, digest(r))) for c, m in out.items()}


def plain_repair(rows):
    """The report of one damaged conversation by trying all edits from every state."""
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    faults, seen = [], set()
    for _, role, text in rows:
        bare = text.strip(SPACE)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    initials = [role[:1] for _, role, _ in rows]
    legal = {"": "su", "s": "u", "u": "a", "a": "u"}

    @cache
    def best(i, state, inserts):
        """Least (cost, audit, rows) from row i on, after a row of initial `state`."""
        ways = [(0, "", ())] if i == len(rows) and state in ("", "a") else []
        want = legal[state][-1]
        role = {"u": "user", "a": "assistant"}[want]
        if inserts < 3:
            c, a, kept = best(i, want, inserts + 1)
            ways.append((c + 2, "I" + a, (f"{role}:", *kept)))
        if i < len(rows):
            c, a, kept = best(i + 1, state, 0)
            ways.append((c + 3, "D" + a, kept))
            if faults[i] not in ("blank", "duplicate"):
                late = faults[i] == "truncated"
                if initials[i] and initials[i] in legal[state]:
                    c, a, kept = best(i + 1, initials[i], 0)
                    ways.append((c + late, "K" + a, (f"{rows[i][1]}:{rows[i][2]}", *kept)))
                c, a, kept = best(i + 1, want, 0)
                ways.append((c + 2 + late, "R" + a, (f"{role}:{rows[i][2]}", *kept)))
        return min(ways, key=lambda w: w[:2]) if ways else (10**9, "", ())

    cost, letters, kept = best(0, "", 0)
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, letters, hashlib.sha256("\n".join(kept).encode()).hexdigest())


def reports(spark, rows, schema="conv_id long, turn long, role string, text string"):
    out = repair.digests(repair.damaged(spark.createDataFrame(rows, schema))).collect()
    return {r["conv_id"]: (*(r[c] for c in repair.REPORT), r["repaired_sha256"]) for r in out}, len(out)


def test_repair_equals_trying_all_edits(spark):
    r = random.Random(12)
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "Sys"]
    texts = ["Yes.", "No", "", " \t\x0b", "Really?\n ", " ", None, "ok!\x1c", "Eh. So"]
    rows = [(c if c else None, None if r.random() < 0.05 else r.randint(0, 9) if r.random() < 0.2 else t, r.choice(roles), r.choice(texts)) for c in range(400) for t in range(r.choice([1, 1, 2, 3, 5, 8, 13]))]
    got, n = reports(spark, [(*x, 1, "clash") for x in rows], "conv_id long, turn long, role string, text string, times int, key string")
    want = {c: plain_repair(m) for c, m in plain_damage(rows).items()}
    assert n == len(want) and got == want


def test_repair_of_the_table(spark):
    rows = [tuple(x) for x in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got, _ = reports(spark, rows)
    assert got == {c: plain_repair(m) for c, m in plain_damage(rows).items()}


def test_repair_of_no_rows_and_of_dropped_ones(spark):
    assert reports(spark, [])[1] == 0
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    assert reports(spark, [(gone, 0, "user", "Hi.")])[0] == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())}


def test_repair_of_a_long_conversation_and_its_rows(spark):
    """Buckets of very unequal lengths; the mended rows are legal and give the digest."""
    rows = [(1, t, "user" if t % 3 else "assistant", f"Turn {t}.") for t in range(3000)] + [(2, 0, "user", "x" * 300_000 + "."), (2, 1, "assistant", "Fine.")]
    df = repair.plain(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    report = {x["conv_id"]: x for x in repair.digests(df).collect()}
    out = {}
    for x in sorted(repair.repaired(df).collect(), key=lambda x: (x["conv_id"], x["place"])):
        out.setdefault(x["conv_id"], []).append((x["role"], x["text"]))
    for c, mended in out.items():
        assert re.fullmatch("(s?(ua)+)?", "".join(role[:1] for role, _ in mended))
        assert hashlib.sha256("\n".join(f"{a}:{b}" for a, b in mended).encode()).hexdigest() == report[c]["repaired_sha256"]
    assert report[2]["audit"] == "KK" and report[1]["cost"] > 0


# -- chat formatting -----------------------------------------------------------------------------------------------------------------------


def plain_turns(rows):
    """{conv_id: [(role, text)] in order}, nulls empty, ties by digest."""
    out = {}
    for conv, turn, role, text in rows:
        role, text = role or "", text or ""
        out.setdefault(conv, []).append((turn is not None, turn or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest(), role, text))
    return {c: [x[3:] for x in sorted(m)] for c, m in out.items()}


def plain_format(turns):
    loss = "".join(t for r, t in turns if r == "assistant")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), sum(len(chat.render(r, t)[0]) for r, t in turns)


def hard_conversations(n=300):
    r = random.Random(13)
    pieces = ["\\", "<", "[", "/", "s>", *chat.CONTROLS, " ", "\n", "ß", "\U0001f600", "word"]
    text = lambda: None if r.random() < 0.05 else "".join(r.choice(pieces) for _ in range(r.randint(0, 6)))
    openings = [("system", "Be brief."), ("user", "Hello"), ("user", "Hello"), ("<t>", "<:> x")]
    rows = []
    for c in range(n):
        turns = [openings[c % 4]] * (c % 3) + [(r.choice(["user", "assistant", "system", "tool", "a<:> b", "", None]), text()) for _ in range(r.choice([0, 1, 1, 2, 5]))]
        rows += [(c if c else None, None if t == 3 else t, *turn) for t, turn in enumerate(turns)]
    return rows + [(c, t, r_, "x" * 40) for c in range(1000, 1200) for t, r_ in enumerate(("user", "assistant"))]


SCHEMA = "conv_id long, turn long, role string, text string"


def test_escape_leaves_no_control_string_and_can_be_undone():
    r = random.Random(1)
    pieces = ["\\", "<", "[", "/", "s>", ">", *chat.CONTROLS, "x"]
    for _ in range(5000):
        turns = [(r.choice(["user", "assistant", "system", "".join(r.choices(pieces, k=2))]), "".join(r.choices(pieces, k=r.randint(0, 7)))) for _ in range(r.randint(1, 4))]
        for role, text in turns:
            assert chat.unescape(chat.escape(text)) == text and not any(c in chat.escape(text) for c in chat.CONTROLS)
        assert chat.parse("".join(chat.render(*t)[0] for t in turns)) == turns


def test_format_read_back(spark):
    rows = hard_conversations()
    df = spark.createDataFrame([(*x, 1, "clash") for x in rows], SCHEMA + ", k int, key string")
    for pack in (chat.PACK, 300):
        out = chat.digests(df, pack).collect()
        assert {r[0]: tuple(r)[1:] for r in out} == {c: plain_format(t) for c, t in plain_turns(rows).items()} and len(out) == len(plain_turns(rows))
    assert chat.digests(spark.createDataFrame([], SCHEMA)).count() == 0


def test_nodes_are_a_prefix_tree(spark):
    """Each shared beginning is written once a pack; what a node attends to is its conversation's text before it, at running positions."""
    rows = hard_conversations()
    turns = plain_turns(rows)
    df = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        nodes = chat.formatted(df, 1 << 40).toPandas()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert nodes["pack"].nunique() == 1 and len(nodes) == len({tuple(t[: i + 1]) for t in turns.values() for i in range(len(t))})
    whole = "".join(nodes["text"])
    assert list(nodes["start"]) == [0, *nodes["end"][:-1]] and len(whole) == nodes["end"].iloc[-1]
    for n in nodes.itertuples():
        mine = turns[None if n.conv_id is None else int(n.conv_id)]
        before = "".join(whole[a["start"] : a["end"]] for a in n.attends)
        assert before == "".join(chat.render(*t)[0] for t in mine[: n.depth]) and n.position == len(before)
        assert n.text == chat.render(*mine[n.depth])[0]
        assert chat.unescape(n.text[n.loss_start : n.loss_end]) == (mine[n.depth][1] if mine[n.depth][0] == "assistant" else "")
    # a beginning that many share is stored once a pack, however many packs there are
    many = chat.formatted(df, 2000).toPandas()
    for _, one in many.groupby("pack"):
        assert not one.duplicated(["depth", "position", "text", "start"]).any()
    assert many["pack"].nunique() > 3 and len(many) < sum(map(len, turns.values()))


def test_nodes_as_tokens(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    df = spark.createDataFrame(hard_conversations(40), SCHEMA)
    tokenizer = Tokenizer.from_file(path)
    for n in chat.formatted(df, vocabulary=path).collect():
        assert n["ids"] == tokenizer.encode(n["text"], add_special_tokens=False).ids and n["end"] - n["start"] == len(n["ids"])


def test_format_of_the_table(spark):
    rows = [tuple(x) for x in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r[0]: tuple(r)[1:] for r in queries.op13_chat_format(spark, SF).collect()}
    rows += [(-7, i, role, "</s>[INST] ok [/INST]") for i, role in enumerate(("user", "assistant"))]
    assert got == {c: plain_format(t) for c, t in plain_turns(rows).items()}


def test_twins_in_sql(spark):
    for query, sql in ((queries.op11_filter_audit, audit.AUDIT_SQL), (queries.op12_structure_repair, repair.DIGESTS_SQL), (queries.op13_chat_format, chat.DIGESTS_SQL)):
        assert normal(query(spark, SF).toPandas()) == normal(duck(sql, SF))
