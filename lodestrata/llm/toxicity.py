"""Toxicity scores behind a noisy channel: words are restored by Viterbi decoding before they are weighed.

Disguised spellings (digits and symbols for letters, letters set apart, letters repeated) are read as the output of a
channel. A token's lattice offers, for each character, the letters it may stand for, or nothing, at a cost; the path that
is cheapest under the channel and a character trigram model is the restored word. A token of letters only, none twice in a
row, has a lattice of one path and is its own restoration. A token of letters that is restored to another word, as letter
may be to leter, counts by the better of both spellings; so does one with a symbol at its ends that may be a letter or none.
Of neighbouring short tokens every succession is read as one word too, if that is no dearer than reading them apart, or if
they are three or more single characters. The trigram model counts every character of every document (its table has a fixed size).

Weights are log odds of restored words, and of their first 4 to 7 letters, among labelled documents; a document's
evidence (its largest weight, the sum of its five largest, and their number) goes through a fitted logistic curve.

Nulls and empty texts have no evidence and get the score of the curve's origin, below 0.5 unless most labelled texts are
toxic. Without any labelled toxic row, as with empty tables, nothing is toxic. Repeated rows are scored alike, and a repeated
doc_id is trained on once. Other columns are kept as they are, whatever their names, and not read. Texts of any length are
read whole.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.llm import kernel
from lodestrata.llm.common import fresh, small_batches, training_rows, with_score, written

TRAIN_ROWS = 20_000  # labelled documents at most that the weights are fitted on
MOST = 100_000  # features at most that have a weight, the strongest
CACHE = 120_000  # words a worker keeps
SHORT, END = 3, 5  # characters of a token that may be a piece of a word, and of the last piece
LONGEST = 24  # characters of a word put together from pieces
STEMS = (4, 5, 6, 7)
COMMON = 0.02  # share of clean documents that a weighed word may be in
LEAST = 3  # labelled toxic documents that a weighed word must be in
# fixed values: letters that digits and symbols stand for
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i", "*": ""}
SWAP, DROP, SPLIT, JOIN = 1.0, 0.7, 0.4, 0.4  # costs of a substitution, of a dropped symbol, repetition or boundary
FRONT, TAIL = "".join(c for c, x in LEET.items() if x and not c.isdigit()), "$+|<(€£"  # symbols that may be letters at a token's ends
DOUBT = {c for c, x in LEET.items() if x}
CLASSES = 64
STOPS = ".,;:?!)\"'"  # none of them may be a letter at a token's end
TWICE = re.compile(r"(.)\1", re.DOTALL).search
LETTERS = re.compile(r"[^\W\d_]*").match  # from the start on
RUNS = re.compile(r"(.)\1+", re.DOTALL).sub


def classes() -> np.ndarray:
    """Byte to one of 64 classes: 0 between words, 1 to 26 letters in either case, 27 digits, the rest by continuation."""
    table = np.zeros(256, np.int64)
    for i in range(26):
        table[97 + i] = table[65 + i] = 1 + i
    table[48:58] = 27
    table[128:192] = 28 + np.arange(64) % 32
    table[192:256] = 60 + np.arange(64) % 4
    return table


def trigram_counts(texts: DataFrame, text: str = "text") -> np.ndarray:
    """Counts of class trigrams over all texts: 64**3 numbers, added up by Spark."""
    table = classes()

    def count(batches):
        import pyarrow as pa

        total = np.zeros(CLASSES**3, np.int64)
        for batch in kernel.parts(batches, 2048):
            for _, buf, offsets in kernel.pieces(batch.column(0)):
                c = table[buf]
                c = np.insert(c, offsets, 0)  # texts don't run on into each other
                if len(c) > 2:
                    total += np.bincount((c[:-2] * CLASSES + c[1:-1]) * CLASSES + c[2:], minlength=CLASSES**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["g", "n"])

    counts = small_batches(texts).select(F.col(text).cast("binary").alias("t")).mapInArrow(count, "g long, n long").groupBy("g").agg(F.sum("n").alias("n"))
    out = np.zeros(CLASSES**3)
    found = counts.toArrow()  # 64**3 rows of two numbers at most
    out[found["g"].to_numpy()] = found["n"].to_numpy()
    return out


def costs(counts: np.ndarray) -> np.ndarray:
    """-log p(third | first two), smoothed by the pair and single counts."""
    three = counts.reshape(CLASSES, CLASSES, CLASSES)
    two, one = three.sum(0), three.sum((0, 1))
    p1 = (one + 0.5) / (one.sum() + 0.5 * CLASSES)
    p2 = (two + 4 * p1) / (two.sum(1, keepdims=True) + 4)
    return -np.log((three + 4 * p2) / (three.sum(2, keepdims=True) + 4))


class Channel:
    def __init__(self, cost: np.ndarray):
        self.cost = cost.ravel().tolist()
        self.code = {}
        table = classes()
        for c in map(chr, range(0x250)):
            self.code[c] = int(table[list(c.encode())[-1]]) if c.isalpha() else 0
        for c in "0123456789":
            self.code[c] = 27

        self.table = {}
        for c, letters in LEET.items():
            self.table[c] = [(x, self.code[x], SWAP) for x in letters]
        for c in "0123456789":
            self.table[c].append((c, 27, SWAP + 1))

    def arcs(self, c: str, before: str) -> list[tuple[str, int, float]]:
        """What a character may stand for behind another ('' for nothing), with classes and costs."""
        if c.isalpha():
            out = [(c, self.code.get(c, 0), 0.0)]
        else:
            out = self.table.get(c, [])
            if not c.isdigit():
                out = [*out, ("", 0, DROP)]
            elif not out:
                out = [(c, self.code.get(c, 0), SWAP + 1)]
        return [*out, ("", 0, SPLIT)] if c == before else out

    def begin(self) -> tuple[list, str]:
        """States before the first character: (cost, classes of the last two letters, letters) of each, and that character."""
        return [(0.0, 0, "")], ""

    def go(self, states: list, before: str, piece: str) -> tuple[list, str]:
        """The states after some more characters. Of readings that end in the same two letters the cheapest goes on."""
        cost, code = self.cost, self.code
        for c in piece:
            if c != before and c.isalpha() and len(states) == 1:  # one state, one arc
                total, ab, out = states[0]
                k = code.get(c, 0)
                states = [(total + cost[ab << 6 | k], (ab & 63) << 6 | k, out + c)]
            else:
                new: dict = {}
                arcs = self.arcs(c, before)
                for total, ab, out in states:
                    for x, k, extra in arcs:
                        s = (total + extra + cost[ab << 6 | k], (ab & 63) << 6 | k, out + x) if x else (total + extra, ab, out)
                        end = s[2][-2:]
                        if end not in new or s[0] < new[end][0]:
                            new[end] = s
                states = list(new.values())
            before = c
        return states, before

    def ended(self, states: list) -> tuple[float, str]:
        """The cost and letters of the cheapest of the states, if a word ends there."""
        cost = self.cost
        if len(states) == 1:
            return states[0][0] + cost[states[0][1] << 6], states[0][2]
        total, _, out = min((s[0] + cost[s[1] << 6], s[2][-2:], s[2]) for s in states)
        return total, out

    def best(self, token: str) -> tuple[float, str]:
        """The cost and letters of the cheapest reading of a token."""
        return self.ended(self.go(*self.begin(), token)[0])

    def decode(self, token: str) -> str:
        """The cheapest reading of a token."""
        return self.best(token)[1]


def stripped(token: str) -> str:
    """Without symbols around it, but for those that may be letters: in front of a token with a letter all from the first of
    FRONT on, in front of digits one $ or @, behind it one or two of TAIL."""
    a, b = 0, len(token)
    while a < b and not token[a].isalnum():
        a += 1
    while b > a and not token[b - 1].isalnum():
        b -= 1
    if any(map(str.isalpha, token[a:b])):
        a = next((i for i in range(a) if token[i] in FRONT), a)
    elif a and token[a - 1] in "@$" and (a == 1 or token[a - 2] != token[a - 1]):
        a -= 1
    tail = len(token) - b - len(token[b:].lstrip(TAIL))
    if 0 < tail < 3:
        b += tail
    return token[a:b]


def plain(token: str) -> bool:
    """Letters only and none twice in a row: one path."""
    return token.isalpha() and not TWICE(token)


def squeezed(token: str) -> str:
    """Without letters that follow the same letter. Dropping doubled letters, as a reading may, doesn't change it."""
    return RUNS(r"\1", token) if TWICE(token) else token


class Restorer:
    """Restores lower-cased tokens; remembers a bounded number of them."""

    def __init__(self, cost: np.ndarray):
        self.channel, self.memo, self.prices, self.runs = Channel(cost), {}, {}, {}

    def word(self, token: str) -> str:
        """The restored word alone."""
        return self.readings(token).partition(" ")[0]

    def readings(self, token: str) -> str:
        """The restored word, and behind it, after spaces, the token's own letters and those with a symbol at an end read as
        a letter, if they are others."""
        if token.isalpha() and not TWICE(token):
            return token
        got = self.memo.get(token)
        if got is None:
            core = stripped(token)
            got = core if plain(core) or not any(map(str.isalpha, core)) and not any(c in LEET for c in core) else self.channel.decode(core)
            own = core.lstrip(FRONT).rstrip(TAIL)
            others = [own] if own.isalpha() else []
            front, tail = core[: len(core) - len(core.lstrip(FRONT))], core[len(core.rstrip(TAIL)) :]
            if own:
                others += [self.channel.decode(x + core[len(front) :]) for c in dict.fromkeys(front) for x in LEET.get(c, "")]
                others += [self.channel.decode(core[: len(core) - len(tail)] + x) for c in dict.fromkeys(tail) for x in LEET.get(c, "")]
            got = " ".join(dict.fromkeys(w for w in (got, *others) if w))
            if len(self.memo) > CACHE:
                self.memo.clear()
            self.memo[token] = got
        return got

    def price(self, token: str) -> float:
        """The cost of a token's cheapest reading."""
        got = self.prices.get(token)
        if got is None:
            if len(self.prices) > CACHE:
                self.prices.clear()
            got = self.prices[token] = self.channel.best(token)[0]
        return got

    def joined(self, run: tuple[str, ...]) -> list[str]:
        """The words that tokens of a run make with those behind the first: see above."""
        got = self.runs.get(run)
        if got is None:
            go, ended = self.channel.go, self.channel.ended
            word, apart, got = run[0], self.price(run[0]), []
            states, last = go(*self.channel.begin(), word)
            for k, piece in enumerate(run[1:], 1):
                word, apart = word + piece, apart + self.price(piece)
                states, last = go(states, last, piece)
                if len(word) == k + 1 > 2 or ended(states)[0] + JOIN * k <= apart:
                    got.append(self.readings(word))
            if len(self.runs) > CACHE:
                self.runs.clear()
            got = self.runs[run] = list(dict.fromkeys(filter(None, got)))
        return got

    def words(self, text: str | None, together: bool = False) -> Counter:
        """The restored words of a text: of each token, and of short neighbouring tokens. `together` makes one item, which
        counts once, of all words that begin with the same of these tokens."""
        tokens = (text or "").lower().split()
        out: Counter = Counter()
        for t, n in Counter(tokens).items():
            if w := self.readings(bare(t)):
                out[w] += n
        for run in runs(tokens):
            if got := self.joined(run):
                out.update([" ".join(got)] if together else got)
        return out


def bare(token: str) -> str:
    """A token of letters without stops behind it, which mean nothing; another as it is."""
    core = token.rstrip(STOPS)
    return core if core.isalpha() else token


def runs(tokens: list[str]) -> list[tuple[str, ...]]:
    """Short neighbouring tokens, from each one on as far as they go."""
    sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
    out = []
    for i in np.flatnonzero((sizes[:-1] <= SHORT) & (sizes[1:] <= END)).tolist():
        j, size = i + 1, len(tokens[i])
        while j < len(tokens) and len(tokens[j]) <= END and len(tokens[j - 1]) <= SHORT and size + len(tokens[j]) <= LONGEST:
            size += len(tokens[j])
            j += 1
        if j > i + 1:
            out.append(tuple(tokens[i:j]))
    return out


def features(readings: str) -> list[str]:
    return [f for word in readings.split(" ") for f in (word, *[word[:n] + "~" for n in STEMS if len(word) >= n])]


def begins(readings: str, heads: set[str]) -> bool:
    """Whether a reading begins with one of the heads."""
    n = STEMS[0]
    return readings[:n] in heads or " " in readings and any(w[:n] in heads for w in readings.split(" "))


class Model:
    """Weights of words and stems, the curve, and the trigram costs that restoring needs."""

    def __init__(self, cost: np.ndarray, weights: dict[str, float], curve: np.ndarray):
        self.cost, self.weights, self.curve = cost, weights, curve
        self.heads = {f.removesuffix("~")[: STEMS[0]] for f in weights}  # how a word or stem with a weight begins

    def evidence(self, words: Iterable[str], memo: dict[str, float]) -> tuple[float, float, float]:
        found, heads = [], self.heads
        for w in words:
            if not begins(w, heads):
                continue
            x = memo.get(w)
            if x is None:
                if len(memo) > CACHE:
                    memo.clear()
                x = memo[w] = max([self.weights.get(f, 0.0) for f in features(w)])
            if x:
                found.append(x)
        return summary(found)

    def score(self, evidence: tuple[float, float, float]) -> float:
        z = self.curve[0] + sum(c * x for c, x in zip(self.curve[1:], evidence, strict=True))
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


def lettered(token: str) -> str:
    """The letters of a token, if nothing else in it may be a letter; else nothing."""
    if token.isalpha():
        return token
    return "".join(filter(str.isalpha, token)) if DOUBT.isdisjoint(token) and not any(map(str.isdigit, token)) else ""


class Scorer:
    """Evidence and scores of texts. Tokens that can't have a weight are left out undecoded, which changes nothing: whatever
    doubled letters a reading drops, without any doubled letter it and a token of letters begin alike, so a token whose
    beginnings aren't those of a weighed word or stem has no weighed reading."""

    def __init__(self, model: Model):
        self.model, self.restorer = model, Restorer(model.cost)
        self.whole = {squeezed(f) for f in model.weights if not f.endswith("~")}
        self.stems = {squeezed(f[:-1]) for f in model.weights if f.endswith("~")}
        self.few = any(len(f) < STEMS[0] for f in self.stems)
        self.begins = {f[:n] for f in self.whole | self.stems for n in range(1, len(f) + 1)}
        self.none: set = set()  # tokens and runs without a weight
        self.some: dict = {}  # (readings, weight) of the others

    def weight(self, readings: str) -> float:
        return max([self.model.weights.get(f, 0.0) for f in features(readings)])

    def stem(self, s: str) -> bool:
        """Whether squeezed letters begin with a weighed stem, squeezed."""
        stems = self.stems
        return s[:4] in stems or s[:5] in stems or s[:6] in stems or s[:7] in stems or self.few and (s[:3] in stems or s[:2] in stems or s[:1] in stems)

    def hopeless(self, token: str) -> bool:
        """Whether no reading of a token has a weight; tokens that don't begin with letters always may."""
        if letters := lettered(token):
            s = squeezed(letters)
            return s not in self.whole and not self.stem(s)
        letters = LETTERS(token)[0]
        if not letters.isalpha():
            return False
        s = squeezed(letters)
        return s not in self.begins and not self.stem(s)

    def hopeless_run(self, run: tuple[str, ...]) -> bool:
        """The same of the words that tokens of a run make with those behind the first."""
        pieces = list(map(lettered, run))
        if not all(pieces):
            return False
        s = squeezed("".join(pieces))
        if s[:2] not in self.begins:
            return True
        if self.stem(s):
            return False
        word = pieces[0]
        for piece in pieces[1:]:
            word += piece
            if squeezed(word) in self.whole:
                return False
        return True

    def look(self, item) -> None:
        """Puts a token or run into `none` or `some`."""
        got = ""
        if isinstance(item, str):
            token = bare(item)
            if not self.hopeless(token):
                got = self.restorer.readings(token)
        elif not self.hopeless_run(item):
            got = " ".join(self.restorer.joined(item))
        if got and (x := self.weight(got)):
            self.some[item] = got, x
        else:
            self.none.add(item)

    def evidence(self, text: str | None) -> tuple[float, float, float]:
        """What Model.evidence says of Restorer.words."""
        tokens = (text or "").lower().split()
        if len(self.none) + len(self.some) > CACHE:
            self.none.clear()
            self.some.clear()
        items = {*tokens, *runs(tokens)}
        new = items - self.none
        for item in new - self.some.keys():
            self.look(item)
        return summary(dict(self.some[item] for item in new & self.some.keys()).values())

    def score(self, text: str | None) -> float:
        return self.model.score(self.evidence(text))


def summary(weights: Iterable[float]) -> tuple[float, float, float]:
    """The largest, the sum of the five largest, and the number of them."""
    found = sorted(weights, reverse=True)
    return (found[0] if found else 0.0, sum(found[:5]), math.log1p(len(found)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Coefficients, intercept first, by Newton's steps with a ridge; a step that makes things worse is halved."""
    x = np.column_stack([np.ones(len(y)), x])
    pull = np.array([1e-3] + [ridge] * (x.shape[1] - 1))
    loss = lambda w: np.logaddexp(0, x @ w).sum() - y @ (x @ w) + 0.5 * pull @ w**2
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(pull), x.T @ (y - p) - pull * w)
        while np.abs(step).max() > 1e-9 and loss(w + step) > loss(w):
            step = step / 2
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def log_odds(toxic: Column, clean: Column, n_toxic: int, n_clean: int) -> Column:
    """A feature's weight from the numbers of documents that have it; null for a rare, common or weak one."""
    odds = F.log((toxic + 0.5) / (n_toxic + 1)) - F.log((clean + 0.5) / (n_clean + 1))
    return F.when((toxic >= min(LEAST, max(2, n_toxic))) & (clean <= COMMON * n_clean) & (odds > 2.0), odds)


def weigh(words: DataFrame) -> list[dict[str, float]]:
    """words: (y, half, words). Weights of features by half 0, by half 1, and by all rows.

    Documents are counted by feature, label and half in Spark; toxic ones first, so that of the clean ones only features are
    counted that begin like one of those. Only features with a weight come to the driver, MOST at most.
    """
    n = {(r["y"], r["half"]): r["count"] for r in words.groupBy("y", "half").count().collect()}  # four rows
    n_toxic, n_clean = ([n.get((y, half), 0) for half in (0, 1)] for y in (1, 0))

    def counted(heads: set[str] | None):
        def run(batches):
            import pyarrow as pa

            for batch in kernel.parts(batches):
                tally: tuple[Counter, Counter] = (Counter(), Counter())
                for half, ws in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    tally[half].update({f for w in ws if heads is None or begins(w, heads) for f in features(w)})
                names = list(tally[0] | tally[1])
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *[pa.array([t[f] for f in names], pa.int64()) for t in tally]], names=["f", "a", "b"])

        return run

    def counts(y: int, heads: set[str] | None = None) -> DataFrame:
        return words.where(F.col("y") == y).select("half", "words").mapInArrow(counted(heads), "f string, a long, b long")

    sums = lambda df, a, b: df.groupBy("f").agg(F.sum("a").alias(a), F.sum("b").alias(b))
    toxic = written(sums(counts(1), "t0", "t1").where(F.col("t0") + F.col("t1") >= min(LEAST, max(2, min(n_toxic)))))
    heads = {r[0] for r in toxic.select(F.left(F.regexp_replace("f", "~$", ""), F.lit(STEMS[0]))).distinct().collect()}  # of four letters
    clean = sums(counts(0, heads).join(toxic.select("f"), "f", "left_semi"), "c0", "c1")
    t0, t1, c0, c1 = (F.coalesce(c, F.lit(0)) for c in ("t0", "t1", "c0", "c1"))
    found = toxic.join(clean, "f", "left").select("f", log_odds(t0, c0, n_toxic[0], n_clean[0]).alias("w0"), log_odds(t1, c1, n_toxic[1], n_clean[1]).alias("w1"), log_odds(t0 + t1, c0 + c1, sum(n_toxic), sum(n_clean)).alias("w"))
    found = found.where("w0 IS NOT NULL OR w1 IS NOT NULL OR w IS NOT NULL").orderBy(F.greatest("w", "w0", "w1").desc(), "f").limit(MOST).toArrow()
    return [{f: w for f, w in zip(found["f"].to_pylist(), found[k].to_pylist(), strict=True) if w is not None} for k in ("w0", "w1", "w")]


def fit(words: DataFrame, cost: np.ndarray) -> Model:
    """words: (y, half, words) with the restored words of each labelled document.

    Weights come from one half of the rows and the curve from the other, and the other way round, so that the curve meets
    weights that haven't seen its rows; the final weights come from all.
    """
    own = weigh(words)
    none = Model(cost, {}, np.array([-5.0, 0, 0, 0]))
    shipped = words.sparkSession.sparkContext.broadcast([Model(none.cost[:0], w, none.curve) for w in own[:2]])

    def look(batches):
        import pyarrow as pa

        models, memos = shipped.value, ({}, {})
        for batch in kernel.parts(batches):
            halves = batch.column(1).to_pylist()
            found = [models[1 - h].evidence(dict.fromkeys(ws, 1), memos[1 - h]) for h, ws in zip(halves, batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([e[k] for e in found], pa.float64()) for k in range(3)]], names=["y", "e0", "e1", "e2"])

    seen = words.select("y", "half", "words").mapInArrow(look, "y int, e0 double, e1 double, e2 double").toArrow()  # TRAIN_ROWS rows of four numbers at most
    rows = np.column_stack([seen[c].to_numpy() for c in ("y", "e0", "e1", "e2")]).astype(float)
    if len(rows) < 4 or not rows[:, 0].any():
        return none
    rows = rows[np.lexsort(rows.T)]
    return Model(cost, own[2], logistic(rows[:, 1:], rows[:, 0]))


def train(docs: DataFrame, labels: DataFrame, kept: Column, label: str = "toxic", limit: int = TRAIN_ROWS) -> Model:
    """docs: doc_id and text; all texts feed the trigram model, and `limit` labelled ones at most the weights."""
    cost = costs(trigram_counts(docs))

    def restore(batches):
        import pyarrow as pa

        r = Restorer(cost)
        for batch in kernel.parts(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([sorted(r.words(t, True)) for t in batch.column(2).to_pylist()], pa.list_(pa.string()))], names=["y", "half", "words"])

    rows = training_rows(docs, labels, label, kept, limit).select("y", F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(2)).cast("int").alias("half"), "text")
    return fit(written(rows.mapInArrow(restore, "y int, half int, words array<string>")), cost)


def score(docs: DataFrame, model: Model, keep: list[str], text: str = "text", name: str = "score") -> DataFrame:
    """The kept columns and a column of scores, 0 to 1."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    at = keep.index(text) if text in keep else len(keep)

    def run(batches):
        import pyarrow as pa

        s = Scorer(shipped.value)
        for batch in kernel.parts(batches):
            scores = [s.score(t) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(keep))], pa.array(scores, pa.float64())], names=[*keep, name])

    own = small_batches(docs).select(*keep, *([docs[text].alias(fresh(keep, "_text"))] if text not in keep else []))
    return own.mapInArrow(kernel.trimmed(run), with_score(own, len(keep), name))
