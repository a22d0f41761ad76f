"""BPE encoding and decoding with tree concatenation of long unsplit text.

A text is cut at special tokens, normalised, and split into words by the vocabulary's pattern; merges act within a
word. A long word, such as a line without spaces, is halved until its parts are short. Parts are encoded on their
own and joined: the tokens around a join are encoded anew in a window that doubles until its first token is the left
side's and its last one the right side's. All adjacent pairs of the result are then pairs of a right encoding, so the
result is the one that merging the whole word gives.

Words of ordinary length are encoded where their text is. Texts that hold a run of LONG characters without a space are dealt out:
their parts become rows, encoded in parallel by other tasks, and one task a text joins them.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache
from operator import add

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import python_ready, stored

#: Characters of an unsplit run from which on a text's parts are dealt out.
LONG = 1 << 16
#: Symbols of a part of a long word, and tokens on each side of the first window.
PART, WINDOW = 128, 4
#: Words that a worker remembers.
MEMORY = 200_000


def _byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself if printable in Latin-1,
    else one from 256 on, in order."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


def unlike(spec: dict) -> None:
    """Raises if a file asks for steps that Vocabulary doesn't take, as its ids would be wrong without a sign."""
    kinds = lambda part, inner: [x.get("type") for x in part.get(inner, [part])] if part else []
    normal, split = kinds(spec.get("normalizer"), "normalizers"), kinds(spec.get("pre_tokenizer"), "pretokenizers")
    model = spec["model"]
    spaces = [n for n in (spec.get("normalizer") or {}).get("normalizers", []) if n.get("type") == "Replace"]
    good = (
        normal == ["NFC", "Replace", "Lowercase"] and all(n["pattern"].get("Regex") == r"\s+" and n["content"] == " " for n in spaces) and split == ["Split", "ByteLevel"]
        and model.get("type", "BPE") == "BPE" and not model.get("dropout") and not model.get("byte_fallback") and not model.get("ignore_merges") and not model.get("continuing_subword_prefix")
        and model.get("end_of_word_suffix") and spec.get("decoder") is None and all("<|" in t["content"] and not (t["lstrip"] or t["rstrip"] or t["single_word"]) for t in spec["added_tokens"])
    )
    if not good:
        raise ValueError("not a word-level BPE file of the kind that this encoder knows")


class Vocabulary:
    """A word-level BPE file of the tokenizers library: NFC, white space dropped, lower case, a split pattern, bytes as
    characters, merges with a suffix at word ends.

    Within, a token is one character and an encoding a string, so that a merge is one replacement: below 256 a byte,
    from 256 one that ends a word, from 512 the result of the merge of that rank, after these the special tokens.
    """

    def __init__(self, path: str) -> None:
        import re

        import numpy as np
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        unlike(spec)
        ids: dict[str, int] = spec["model"]["vocab"]
        suffix, merges = spec["model"]["end_of_word_suffix"], spec["model"]["merges"]
        chars = _byte_chars()
        codes = {c + end: chr(at + b) for at, end in ((0, ""), (256, suffix)) for b, c in enumerate(chars)}
        strings = [*codes]
        self.ranks: dict[str, int] = {}
        self.pairs: list[str] = []
        self.parts = {c: c for c in codes.values()}
        for rank, (a, b) in enumerate(merges):
            pair, made = codes[a] + codes[b], chr(512 + rank)
            self.ranks.setdefault(pair, rank)
            self.pairs.append(pair)
            self.parts[made] = self.parts[codes[a]] + self.parts[codes[b]]
            codes.setdefault(a + b, made)
            strings.append(a + b)
        self.special = {t["content"]: chr(512 + len(merges) + i) for i, t in enumerate(spec["added_tokens"])}
        self.ids = np.array([*(ids[x] for x in strings), *(t["id"] for t in spec["added_tokens"])], np.int32)
        self.tokens = np.empty(self.ids.max() + 1, object)
        self.tokens[self.ids] = [*strings, *self.special]
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.split = regex.compile(pattern).findall
        plain = pattern.replace(r"[\p{L}]", "[a-z]").replace(r"[\p{N}]", "[0-9]").replace(r"\p{L}\p{N}", "a-z0-9")
        self.split_ascii = re.compile(plain, re.ASCII).findall  # the same for lower-case ASCII, and faster
        self.cut = regex.compile("(" + "|".join(regex.escape(s) for s in self.special) + ")").split
        self.known: dict[str, str] = {}
        self.before: dict[str, str] = {}

    def symbols(self, word: str) -> str:
        data = word.encode("utf-8", "replace")
        return data[:-1].decode("latin-1") + chr(256 + data[-1])

    def merge(self, s: str) -> str:
        """The encoding of some symbols, by merging the pair of lowest rank again and again."""
        get = self.ranks.get
        while len(s) > 1:
            ranks = [r for p in map(add, s, s[1:]) if (r := get(p)) is not None]
            if not ranks:
                break
            rank = min(ranks)
            s = s.replace(self.pairs[rank], chr(512 + rank))
        return s

    def join(self, left: str, right: str) -> str:
        """The encoding of what two encodings stand for together."""
        k = WINDOW
        while True:
            a, b = left[-k:], right[:k]
            w = self.merge("".join(map(self.parts.__getitem__, a + b)))
            if (k >= len(left) or w[0] == a[0]) and (k >= len(right) or w[-1] == b[-1]):
                return left[:-k] + w + right[k:]
            k *= 2

    def joined(self, encodings: list[str]) -> str:
        """Of the encodings of a word's parts, joined as a tree."""
        while len(encodings) > 1:
            pairs = [self.join(a, b) for a, b in zip(encodings[::2], encodings[1::2])]  # noqa: B905
            encodings = pairs + encodings[len(encodings) - len(encodings) % 2 :]
        return encodings[0]

    def halves(self, symbols: str) -> list[str]:
        """The parts that halving gives, all of PART symbols at most."""
        n = 1
        while -(-len(symbols) // n) > PART:
            n *= 2
        size = -(-len(symbols) // n)
        return [symbols[i : i + size] for i in range(0, len(symbols), size)]

    def word(self, word: str) -> str:
        if word in self.special.values():
            return word
        s = self.symbols(word)
        return self.merge(s) if len(s) <= PART else self.joined([*map(self.merge, self.halves(s))])

    def words(self, text: str) -> list[str]:
        """The words of a text; a special token in it is its own character."""
        out = []
        for i, piece in enumerate(self.cut(text) if "<|" in text else [text]):
            if i % 2:
                out.append(self.special[piece])
            elif piece.isascii():
                out += self.split_ascii(piece.lower())
            else:  # a capital sigma is lowered without its context
                out += self.split(unicodedata.normalize("NFC", piece).replace("\u03a3", "\u03c3").lower())
        return out

    def encode(self, text: str) -> str:
        known, out = self.known, []
        for w in self.words(text):
            e = known.get(w)
            if e is None:
                e = self.before.get(w) or self.word(w)
                if len(w) < 64:
                    if len(known) >= MEMORY // 2:  # what was used lately stays, as it is taken over from `before`
                        self.before, self.known = known, {}
                        known = self.known
                    known[w] = e
            out.append(e)
        return "".join(out)


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _ids(v: Vocabulary, encodings: list[str]) -> pa.Array:
    import numpy as np

    ends = np.cumsum([0, *map(len, encodings)], dtype=np.int32)
    codes = np.frombuffer("".join(encodings).encode("utf-32-le", "surrogatepass"), "<u4")
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(v.ids[codes]))


def _decoded(v: Vocabulary, ids: pa.ListArray) -> Iterator[str]:
    """The text of each array of ids; of a null one, an empty text."""
    flat, at = ids.flatten().to_numpy(), 0
    for n in ids.value_lengths().to_pylist():
        yield " ".join(v.tokens[flat[at : at + (n or 0)]])
        at += n or 0


def _encoded(v: Vocabulary, encodings: list[str]) -> pa.StructArray:
    """The ids of each text and the digest of what they decode to, so that one worker does both and no decoded text leaves it."""
    ids = _ids(v, encodings)
    digests = pa.array([hashlib.sha256(x.encode()).hexdigest() for x in _decoded(v, ids)], pa.string())
    return pa.StructArray.from_arrays([ids, digests], ["ids", "decoded_sha256"])


#: What _encoded() returns.
ENCODED = "struct<ids: array<int>, decoded_sha256: string>"


def encode(docs: DataFrame, path: str, text: str = "text", into: str = "ids") -> DataFrame:
    """`docs` with the column `into`: the token ids of `text` by the vocabulary file `path`, which every worker can read.

    No special tokens are added; their strings in a text are special tokens, as the library's default has it. Null and empty texts have
    an empty array. Rows with extra columns keep them; repeated rows get equal ids.
    """
    return _with_codes(docs, path, text, into, "array<int>", _ids)


def _with_codes(docs: DataFrame, path: str, text: str, into: str, kind: str, result: Callable[[Vocabulary, list[str]], pa.Array]) -> DataFrame:
    """`docs` with the column `into` of type `kind`: `result` of the encodings of its texts."""
    python_ready(docs.sparkSession)
    t = F.coalesce(F.col(text), F.lit(""))

    @F.arrow_udf(kind)
    def whole(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        v = vocabulary(path)
        for column in parts:
            yield result(v, [v.encode(x) for x in column.to_pylist()])

    whole = whole.asNondeterministic()  # so that Spark computes it once, however often it is used
    is_long = (F.length(t) >= LONG) & t.rlike(rf"\S{{{LONG}}}")
    long = docs.where(is_long)
    near = docs.where(~is_long).withColumn(into, whole(t))
    return near.unionByName(_dealt(long, path, t, into, kind, result))


def _dealt(docs: DataFrame, path: str, t: Column, into: str, kind: str, result: Callable[[Vocabulary, list[str]], pa.Array]) -> DataFrame:
    """_with_codes() of few texts with long words, whose parts are encoded in parallel."""
    base = stored(docs.withColumn("_tessera_no", F.monotonically_increasing_id()).withColumn("_tessera_text", t))

    def cut(frames):
        import pandas as pd

        v = vocabulary(path)
        for frame in frames:
            for no, text in zip(frame["_tessera_no"].tolist(), frame["_tessera_text"], strict=True):
                rows, run = [], []
                for w in [*v.words(text), None]:
                    s = "" if w is None or w in v.special.values() else v.symbols(w)
                    if w is not None and len(s) < LONG:
                        run.append(v.word(w))
                        continue
                    rows.append((0, "".join(run)))
                    run = []
                    rows += [(1 + (i > 0), part) for i, part in enumerate(v.halves(s))] if s else []
                yield pd.DataFrame({"no": no, "at": range(len(rows)), "kind": [k for k, _ in rows], "s": [s for _, s in rows]})

    def leaf(frames):
        v = vocabulary(path)
        for frame in frames:
            frame["s"] = [s if k == 0 else v.merge(s) for k, s in zip(frame["kind"], frame["s"], strict=True)]
            yield frame

    def join(rows: pa.Table) -> pa.Table:
        v, out, parts = vocabulary(path), [], []
        no, rows = rows["no"][0].as_py(), rows.sort_by("at")
        for part, s in [*zip(rows["kind"].to_pylist(), rows["s"].to_pylist(), strict=True), (0, "")]:
            if part < 2 and parts:
                out.append(v.joined(parts))
                parts = []
            (parts if part else out).append(s)
        return pa.table({"no": pa.array([no], pa.int64()), "s": result(v, ["".join(out)])})

    schema = "no bigint, at int, kind int, s string"  # kind: 0 encoded, 1 the first part of a word, 2 a later one
    parts = base.select("_tessera_no", "_tessera_text").mapInPandas(cut, schema)
    encoded = parts.repartition(F.xxhash64("no", "at")).mapInPandas(leaf, schema).groupBy("no").applyInArrow(join, f"no bigint, s {kind}")
    encoded = encoded.toDF("_tessera_no", "_tessera_whole")
    out = base.drop("_tessera_text").join(encoded, "_tessera_no")  # every text has rows, if only an empty run
    return out.withColumn(into, F.col("_tessera_whole")).drop("_tessera_no", "_tessera_whole")


def decode(docs: DataFrame, path: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """`docs` with the text of `ids`: the strings of all tokens, special ones too, joined by a space, as a file without a
    decoder has it. Null and empty arrays have an empty text."""
    python_ready(docs.sparkSession)

    @F.arrow_udf("string")
    def text(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        v = vocabulary(path)
        for column in parts:
            yield pa.array(list(_decoded(v, column)), pa.string())

    return docs.withColumn(into, text.asNondeterministic()(F.coalesce(F.col(ids), F.array().cast("array<int>"))))


def digests(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """`docs` with ids, n_tokens, ids_sha256 (of the decimal ids joined by a space) and decoded_sha256, in place of columns of these names."""
    out = _with_codes(docs, path, text, "_tessera_codes", ENCODED, _encoded)
    out = out.withColumns({"ids": F.col("_tessera_codes.ids"), "decoded_sha256": F.col("_tessera_codes.decoded_sha256")})
    return out.withColumns({
        "n_tokens": F.size("ids").cast("bigint"),
        "ids_sha256": F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256),
    }).drop("_tessera_codes")
