"""Byte-level BPE encoding by depth-first walks over tries of words, and decoding.

The canonical encoding of a prefix ends in one token, and that token is the only one among the vocabulary's suffixes of the
prefix that may stand behind the last token of what is left before it. So each trie node keeps one token: its parent
nodes' tokens are known when the walk reaches it, and words that share a prefix share its encoding. Two tokens may stand
side by side if no merge across their border would have been made before both were complete.

Texts are cut at spaces that the pre-tokenizer always cuts at; a task keeps the ids of pieces and words it has met, up to a
fixed number, and walks the trie of the new words of each batch, whose leaves in the walk's order are the words sorted.

Nulls are encoded as empty texts; empty texts have no tokens. Any length works: a step looks at no more bytes than the
longest token has. Repeated rows give repeated results; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
from bisect import bisect_left
from collections.abc import Iterator
from struct import pack

import numpy as np
from pyspark.sql import DataFrame

from lodestrata.llm import kernel

CACHE = 60_000  # pieces a task keeps of those met last, and as many of those met before
PAIRS = 1 << 19  # pairs of tokens of which a worker keeps whether they may be neighbours
NEVER = 1 << 60
# fixed values: white space of Unicode, and the cut into words of byte-level BPE
SPACES = r"\t\n\x0B\f\r \x85\xA0  -     　"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACES}\p{{L}}\p{{N}}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary file: printable Latin-1 bytes for themselves, the others in
    order for the code points from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tokens, merges and special tokens of a tokenizer file, and which tokens may be neighbours."""

    def __init__(self, raw: str):
        spec = json.loads(raw)
        letters = byte_letters()
        to_bytes = lambda s: bytes(letters[c] for c in s)
        names = spec["model"]["vocab"]
        self.bytes_of = {i: to_bytes(s) for s, i in names.items()}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes_of |= {i: s.encode() for s, i in self.special.items()}
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.made: dict[int, int] = {}
        for r, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            i, j, whole = names[a], names[b], names[a + b]
            self.rank[i, j] = r
            if whole not in self.parts:
                self.parts[whole], self.made[whole] = (i, j), r
        special = set(self.special.values())
        self.ids = {}
        for i, s in sorted((x for x in self.bytes_of.items() if x[0] not in special), key=lambda x: len(x[1])):
            if self.reachable(i):
                self.ids[s] = i
        self.fit: set[int] = set()
        self.unfit: set[int] = set()
        self.ending: list[tuple[int, int] | None] = [None] * (max(self.bytes_of) + 1)  # by token, one object for all states
        for s, i in self.ids.items():
            self.ending[i] = len(s), i
        self.state_bytes = [b"", *sorted({t[:n] for t in self.ids for n in range(1, len(t) + 1)})]
        self.steps: dict[int, int] = {}
        self.endings: list[list[tuple[int, int]] | None] = [None] * len(self.state_bytes)

    def reachable(self, token: int) -> bool:
        """Whether the token is the encoding of its own bytes. Parts are asked about before wholes."""
        if token not in self.parts:
            return True
        a, b = self.parts[token]
        return self.bytes_of[a] in self.ids and self.bytes_of[b] in self.ids and self.apart(a, b, self.made[token])

    def edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """The tokens that touch one end of a token while it grows, each with the merge that swallows it."""
        out, until = [], NEVER
        while token in self.parts:
            out.append((token, until))
            token, until = self.parts[token][side], self.made[token]
        out.append((token, until))
        return out

    def apart(self, a: int, b: int, before: int = NEVER) -> bool:
        """No merge across the border of a and b is made earlier than `before`. Of equal merges the leftmost is first."""
        rank = self.rank
        ends = self.edge(b, 0)
        for x, x_until in self.edge(a, 1):
            for y, y_until in ends:
                m = rank.get((x, y))
                if m is not None and m < before and m < x_until and m <= y_until:
                    return False
        return True

    def neighbours(self, pair: int) -> bool:
        """Whether two tokens, the first << 32 | the second, may stand side by side. Known ones are kept, up to a number."""
        if len(self.fit) + len(self.unfit) > PAIRS:
            self.fit.clear()
            self.unfit.clear()
        ok = self.apart(pair >> 32, pair & 0xFFFFFFFF)
        (self.fit if ok else self.unfit).add(pair)
        return ok

    def step(self, state: int, byte: int) -> int:
        """The state after one more byte: states are the beginnings of tokens, and a state stands for the longest one that
        the bytes so far end in. Each step is looked for once and then remembered."""
        end = self.state_bytes[state] + bytes((byte,))
        while (to := bisect_left(self.state_bytes, end)) == len(self.state_bytes) or self.state_bytes[to] != end:
            end = end[1:]
        self.steps[state << 8 | byte] = to
        return to

    def suffixes(self, state: int) -> list[tuple[int, int]]:
        """(length, token) of the tokens that a state's bytes end in, longest first."""
        end = self.state_bytes[state]
        found = self.endings[state] = [self.ending[self.ids[end[i:]]] for i in range(len(end)) if end[i:] in self.ids]
        return found


def encode_words(v: Vocabulary, words: set[str]) -> dict[str, bytes]:
    """The ids of each word, as little-endian 32-bit integers. Sorted words are the trie's leaves in the order of a depth-first
    walk: a word goes on at the node where it leaves the path of the word before."""
    out: dict[str, bytes] = {}
    steps, endings, fit, unfit, ending = v.steps, v.endings, v.fit, v.unfit, v.ending
    longest = max((len(w.encode()) for w in words), default=0)
    last, states = [0] * (longest + 1), [0] * (longest + 1)  # of the path, by depth: the prefix's last token << 32, the state
    path = b""
    for word in sorted(words):
        w, depth = word.encode(), 0
        for x, y in zip(path, w):  # noqa: B905
            if x != y:
                break
            depth += 1
        state = states[depth]
        for x in w[depth:]:
            key = state << 8 | x
            state = steps[key] if key in steps else v.step(state, x)
            depth += 1
            for n, token in endings[state] or v.suffixes(state):
                if n == depth:
                    break
                pair = last[depth - n] | token
                if pair in unfit:
                    continue
                if pair in fit or v.neighbours(pair):
                    break
            else:
                raise ValueError("a byte is not in the vocabulary")
            last[depth], states[depth] = token << 32, state
        path = w
        tokens = []
        while depth:
            tokens.append(token := last[depth] >> 32)
            depth -= ending[token][0]
        tokens.reverse()
        out[word] = pack(f"<{len(tokens)}I", *tokens)
    return out


class Encoder:
    def __init__(self, raw: str):
        import regex

        self.v = Vocabulary(raw)
        self.words = regex.compile(PATTERN).findall
        self.cut = re.compile(rf" (?<=[^{SPACES}] )(?=[^{SPACES}])").split  # the literal first, which is searched for fastest
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.v.special, key=len, reverse=True))) + ")").split if self.v.special else None
        self.pieces: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def cuts(self, text: str) -> list[str]:
        """Pieces that begin where a word must begin: at a single space between other characters."""
        first, *rest = self.cut(text)
        return [first, *[" " + x for x in rest]]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        plans: list[list] = []
        met: set[str] = set()
        for t in texts:
            plan: list = []
            for part in self.specials(t or "") if self.specials and any(s in (t or "") for s in self.v.special) else [t or ""]:
                if part in self.v.special:
                    plan.append(np.array([self.v.special[part]], "<u4").tobytes())
                elif part:
                    cuts = self.cuts(part)
                    met.update(cuts)
                    plan.append(cuts)
            plans.append(plan)
        if len(self.pieces) > CACHE:
            self.older, self.pieces = self.pieces, {}
        known, older = self.pieces, self.older
        met.difference_update(known)
        split = []  # pieces of several words; a word is a piece of its own
        new = set()
        for m in met:
            if m in older:
                known[m] = older[m]
            elif len(ws := self.words(m)) > 1:
                split.append((m, ws))
                new.update(ws)
            else:
                new.add(m)
        new.difference_update(known)
        for w in new.intersection(older):
            known[w] = older[w]
        known.update(encode_words(self.v, new.difference(older)))
        get = known.__getitem__
        for m, ws in split:
            known[m] = b"".join(map(get, ws))
        return [b"".join([p if isinstance(p, bytes) else b"".join(map(get, p)) for p in plan]) for plan in plans]

    def forget(self) -> None:
        """Lets go of what grows with the texts; a worker goes on to other tasks, of other operators too."""
        self.pieces, self.older = {}, {}

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.v.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


def encoder(raw: str) -> Encoder:
    """One encoder for each worker and tokenizer file."""
    if (key := ("bpe", hash(raw))) not in kernel.KEPT:
        kernel.trim()
        kernel.KEPT[key] = Encoder(raw)
    return kernel.KEPT[key]


def groups(texts: list, limit: int = 1 << 19) -> Iterator[list]:
    """Runs of about `limit` characters."""
    run, n = [], 0
    for t in texts:
        run.append(t)
        n += len(t or "")
        if n > limit:
            yield run
            run, n = [], 0
    if run:
        yield run


def _map(df: DataFrame, keep: list[str], text: str, path: str | None, schema: str, make) -> DataFrame:
    with open(path or default_path(), encoding="utf-8") as f:
        raw = df.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary file: its size doesn't depend on the data

    def run(batches):
        e = encoder(raw.value)
        yield from made_of(e, batches)
        e.forget()
        kernel.trim()

    def made_of(e, batches):
        import pyarrow as pa

        for batch in batches:
            columns = [batch.column(i) for i in range(len(keep))]
            made: list[list] = []
            for run in groups(batch.column(len(keep)).to_pylist()):
                for ids, t in zip(e.encode(run), run, strict=True):
                    made.append(make(e, ids, t))
            arrays = [pa.array(c, kind) for c, kind in zip(zip(*made, strict=True) if made else [[]] * len(kinds), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*columns, *arrays], names=[*keep, *names])

    import pyarrow as pa

    parsed = [x.split() for x in schema.split(",")]
    names = [n for n, _ in parsed]
    kinds = [{"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[k] for _, k in parsed]
    own = df.select(*keep, df[text].alias("_text"))
    return own.mapInArrow(run, ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields[:-1]] + [schema]))


def encode(df: DataFrame, keep: list[str], text: str = "text", path: str | None = None) -> DataFrame:
    """The kept columns, n_tokens, and ids as little-endian unsigned 32-bit integers."""
    return _map(df, keep, text, path, "n_tokens long, ids binary", lambda e, ids, t: (len(ids) // 4, ids))


def decode(df: DataFrame, keep: list[str], ids: str = "ids", path: str | None = None) -> DataFrame:
    """The kept columns and the text of encoded ids (null ids: empty)."""
    with open(path or default_path(), encoding="utf-8") as f:
        raw = df.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        import pyarrow as pa

        e = encoder(raw.value)
        for batch in batches:
            texts = [e.decode(x or b"") for x in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(keep))], pa.array(texts, pa.string())], names=[*keep, "text"])

    own = df.select(*keep, df[ids].alias("_ids"))
    return own.mapInArrow(run, ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields[:-1]] + ["text string"]))


def digests(df: DataFrame, keep: list[str], text: str = "text", path: str | None = None) -> DataFrame:
    """The kept columns, n_tokens, and SHA-256 digests of the ids and of the text decoded from them."""

    def make(e: Encoder, ids: bytes, _):
        return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(e.decode(ids).encode()).hexdigest()

    return _map(df, keep, text, path, "n_tokens long, ids_sha256 string, decoded_sha256 string", make)
