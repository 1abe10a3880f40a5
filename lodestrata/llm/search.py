"""Exact top-k BM25 search: an inverted index with block maxima for each shard, pruned as block-max WAND does, and an exact merge.

The texts are cut into words once; each text's distinct words and their counts are written as a table. Statistics are global: a
pass over that table counts the texts, their words, and in how many texts each query word is. A second pass builds postings of
the query words for each run of SHARD texts, with the largest impact of each word and of each word in each block of BLOCK texts.

In a shard, words of very many texts have a row with a number for each text; what they add to every text's score for many
queries is one product of matrices in single precision, whose rounding widens the bounds. The other words are ordered by their
largest impact. Those whose largest impacts together stay below the threshold, the k-th best score known, are left out if that
saves most postings; the postings of the others are added to the product. To such a partial score the block maxima of the words
left out are added; texts whose bound is below the threshold are dropped, and the rest are scored exactly, by falling bound, until
no bound reaches the threshold, which rises all the while. Texts of a shard are worked on together, in arrays, not by cursors that move from
posting to posting; what is pruned is the same. A first threshold comes from a search of every SEED-th text. Tasks send k
results a query at most, and the k best of these are the k best of all. Bounds are compared with a slack for rounding, so
nothing that ties is lost; equal scores go by doc_id.

Queries are worked on in blocks of about QUERY_WORDS words, whatever their number; a block is what is broadcast. A query is a
text, and each of its distinct words counts once; rows of one query_id are one query, of the words of all of them. Words are runs of ASCII letters and digits and non-ASCII characters,
lower-cased in A-Z, told apart by 64-bit hashes.

Nulls are empty texts: they match nothing, and count as texts of length 0. Queries without words have no results. Repeated
rows are results of their own, a null doc_id last among equals. Very long texts are indexed whole. An empty table has no
results. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.llm import kernel
from lodestrata.llm.common import small_batches, written

K1, B = 1.2, 0.75
K = 10
SHARD, BLOCK = 8192, 64
MOST_POSTINGS = 1 << 22  # postings after which a shard is closed, though it has fewer texts
PIECE = 1 << 18  # bytes of text that are cut into words at once
SEED = 32  # every how manieth text, by a hash, gives the first thresholds
DENSE = 16  # a word in a 16th of a shard's texts has a row with a number for each of them
TOGETHER = 128  # queries whose sums of such rows are made at once
LEFT = 1.25  # words are left out of the first sums if these have so many times fewer postings then
QUERY_WORDS = 1_000_000
SLACK = 1e-9
BREAK = np.ones(256, bool)
BREAK[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
NO_ID = np.iinfo(np.int64).max


def terms(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words, the first word of each text and the total)."""
    starts, ends, at = kernel.words(buf, offsets, BREAK)
    return kernel.hashes(kernel.LOWERED[buf], starts, ends), at


def index(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(d, n, words, counts): the id, the number of words, and the distinct words' hashes, sorted, with their counts."""

    def cut(batches):
        import pyarrow as pa

        for batch in kernel.parts(batches, 2048):
            n: list[int] = []
            words, counts = [], []
            for _, buf, offsets in kernel.pieces(batch.column(1), PIECE):
                h, at = terms(buf, offsets)
                n += np.diff(at).tolist()
                for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                    w, c = np.unique(h[a:b], return_counts=True)
                    words.append(w.tobytes())
                    counts.append(c.astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(words, pa.binary()), pa.array(counts, pa.binary())], names=["d", "n", "words", "counts"])

    return small_batches(docs).select(F.col(doc_id).cast("long").alias("d"), F.col(text).cast("binary").alias("t")).mapInArrow(kernel.trimmed(cut), "d long, n long, words binary, counts binary")


def _flat(column, kind) -> tuple[np.ndarray, np.ndarray]:
    """(all numbers of a binary column without nulls, how many each row has)."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    size = np.dtype(kind).itemsize
    data = column.buffers()[2]
    return (np.frombuffer(data, kind)[offsets[0] // size : offsets[-1] // size] if data is not None and data.size else np.zeros(0, kind)), np.diff(offsets) // size


def find(vocabulary: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which words are in the sorted vocabulary, the places of these)."""
    if not len(vocabulary) or not len(words):
        return np.zeros(len(words), bool), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(vocabulary, words), len(vocabulary) - 1)
    ok = vocabulary[at] == words
    return ok, at[ok]


def spread(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All numbers of the ranges, one range behind the other."""
    n = ends - starts
    total = int(n.sum())
    if not total:
        return np.zeros(0, np.int64)
    full = n > 0
    starts, n = starts[full], n[full]
    ends = np.cumsum(n)
    return np.arange(total) + np.repeat(starts - ends + n, n)


def sums(at: np.ndarray, value: np.ndarray, starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Sums of values by place, over the ranges; long ranges are copied as they stand, short ones picked."""
    if len(starts) and int((ends - starts).sum()) > 256 * len(starts):
        ranges = list(map(slice, starts.tolist(), ends.tolist()))
        return np.bincount(np.concatenate([at[r] for r in ranges]), np.concatenate([value[r] for r in ranges]), n)
    p = spread(starts, ends)
    return np.bincount(at[p], value[p], n)


def first_of_each(ids: np.ndarray, digests: np.ndarray, k: int) -> np.ndarray:
    """Which texts are among the k with the least ids of those with the same words and length: others can't be in a result, as these
    have the same score and come first. digests: two numbers a text."""
    order = np.lexsort((ids, digests[:, 1], digests[:, 0]))
    d = digests[order]
    new = np.concatenate(([True], (d[1:] != d[:-1]).any(1)))
    place = np.arange(len(ids))
    out = np.zeros(len(ids), bool)
    out[order] = place - np.maximum.accumulate(np.where(new, place, 0)) < k
    return out


class Shard:
    """Postings of some texts by text and by word, with the largest impact of each word and of each word in each block.

    Words of many texts have rows instead, in single precision, which are added up for many queries at once as a product of matrices.
    word and impact come text by text, words ascending; `sizes` has the number of postings of each text."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, word: np.ndarray, impact: np.ndarray, words: int, block: int = BLOCK):
        self.ids, self.word, self.weight = ids, word.astype(np.int32, copy=False), impact
        self.at = np.concatenate(([0], np.cumsum(sizes)))
        text = np.repeat(np.arange(len(ids), dtype=np.int32), sizes)
        n = np.bincount(self.word, minlength=words)
        often = np.flatnonzero(n * DENSE >= max(1, len(ids)))
        self.row = np.full(words, -1, np.int32)  # which row a word of many texts has
        self.row[often] = np.arange(len(often))
        self.rows = np.zeros((len(often), len(ids)), np.float32)
        row = self.row[self.word]
        self.rows[row[row >= 0], text[row >= 0]] = impact[row >= 0]
        few = np.flatnonzero(row < 0)
        few = few[np.argsort(self.word[few], kind="stable")]
        self.text, self.impact, word = text[few].astype(np.int64), impact[few], self.word[few].astype(np.int64)
        n[often] = 0
        self.of_word = np.concatenate(([0], np.cumsum(n)))
        cell = word * (len(ids) // block + 1) + self.text // block
        starts = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1]))) if len(cell) else np.zeros(0, np.int64)
        self.most = np.maximum.reduceat(self.impact, starts) if len(cell) else np.zeros(0)
        self.block = self.text[starts] // block
        self.cells = np.searchsorted(word[starts], np.arange(words + 1))
        self.peak = np.zeros(words)
        have = np.flatnonzero(self.cells[1:] > self.cells[:-1])
        if len(have):
            self.peak[have] = np.maximum.reduceat(self.most, self.cells[have])
        self.blocks = np.arange(len(ids)) // block
        self.asked = np.zeros(words, bool)

    def often(self, queries: list[np.ndarray]) -> np.ndarray:
        """For each query and text, the impacts of words that have rows, added up in single precision."""
        which = np.zeros((len(queries), len(self.rows)), np.float32)
        for i, words in enumerate(queries):
            row = self.row[words]
            which[i, row[row >= 0]] = 1
        return which @ self.rows

    def total(self, words: np.ndarray) -> np.ndarray:
        """The impacts of some words without rows in every text, added up."""
        return sums(self.text, self.impact, self.of_word[words], self.of_word[words + 1], len(self.ids))

    def exact(self, texts: np.ndarray) -> np.ndarray:
        """Scores by the words in `asked`, added up in the order of words, so that equal texts have equal scores."""
        a, b = self.at[texts], self.at[texts + 1]
        p = spread(a, b)
        ok = self.asked[self.word[p]]
        return np.bincount(np.repeat(np.arange(len(texts)), b - a)[ok], self.weight[p[ok]], len(texts))

    def search(self, words: np.ndarray, k: int, best: tuple[np.ndarray, np.ndarray], floor: float, often: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """best: (scores, ids) so far, best first; floor: a score that k texts are known to reach; often: this query's row of `often`.
        Returns `best` with this shard's results taken in."""
        if often is None:
            often = self.often([words])[0]
        slack = 1 + SLACK + 2 * len(self.rows) * 2.0**-24  # all impacts are positive, so sums of n are off by n roundings at most
        if len(best[0]) >= k:
            floor = max(floor, best[0][k - 1])
        peak = self.peak[words]
        order = np.argsort(peak, kind="stable")
        order = order[np.searchsorted(peak[order], 0.0, "right") :]
        most = np.cumsum(peak[order]) * slack
        postings = np.cumsum(self.of_word[words[order] + 1] - self.of_word[words[order]])
        split = int(np.searchsorted(most, floor))  # words before it stay below the floor together
        if split and LEFT * postings[split - 1] < postings[-1]:
            split = 0  # leaving them out saves less than the bounds cost that are then asked for
        few, rest = words[order[split:]], words[order[:split]]
        bound = often + self.total(few) if len(few) else often.astype(float)
        left = most[split - 1] if split else 0.0
        todo = np.flatnonzero((bound * slack >= floor - left) & (bound + left > 0))
        if split and len(todo) > 2 * k:
            by_block = sums(self.block, self.most, self.cells[rest], self.cells[rest + 1], self.blocks[-1] + 1)
            upper = bound[todo] + by_block[self.blocks[todo]]
            todo, upper = todo[upper * slack >= floor], upper[upper * slack >= floor]
            if len(todo) > 2 * k:  # too many for going through each of them
                upper = (bound + self.total(rest))[todo]
                todo, upper = todo[upper * slack >= floor], upper[upper * slack >= floor]
            bound = upper * slack
        else:
            bound = (bound[todo] + left) * slack
        if not len(todo):
            return best
        if len(todo) > 4 * k:  # the best first, so that the floor rises before the others are put in order
            first = np.argpartition(-bound, 2 * k)[: 2 * k]
            self.asked[words] = True
            scores = np.sort(self.exact(todo[first]))[::-1]
            self.asked[words] = False
            floor = max(floor, scores[k - 1])
            todo, bound = todo[bound >= floor], bound[bound >= floor]
        order = np.argsort(-bound, kind="stable")
        todo, bound = todo[order], bound[order]
        self.asked[words] = True
        at, step = 0, 2 * k
        while at < len(todo) and bound[at] >= floor:
            chosen = todo[at : at + step]
            scores = self.exact(chosen)
            hit = scores >= max(floor, 1e-300)
            s, i = np.concatenate([best[0], scores[hit]]), np.concatenate([best[1], self.ids[chosen[hit]]])
            order = np.lexsort((i, -s))[:k]
            best = s[order], i[order]
            if len(best[0]) >= k:
                floor = max(floor, best[0][k - 1])
            at, step = at + step, step * 2
        self.asked[words] = False
        return best


def search(docs: DataFrame, queries: DataFrame, k: int = K, doc_id: str = "doc_id", text: str = "text", query_id: str = "query_id", query_text: str = "query_text", query_words: int = QUERY_WORDS) -> DataFrame:
    """(query_id, rank, doc_id, score): the k best texts of every query that shares a word with any, ranks from 1."""
    asked = index(queries, query_id, query_text).where(F.octet_length("words") > 0).select(F.col("d").alias("q"), F.col("words").alias("terms"))
    asked = _one_each(written(asked))
    total = (asked.agg(F.sum(F.octet_length("terms"))).first()[0] or 0) / 8
    blocks = max(1, -(-int(total) // query_words))
    source = index(docs, doc_id, text)
    if blocks > 1:
        source = written(source)
    parts = [_block(source, asked.where(F.pmod(F.xxhash64("terms"), F.lit(blocks)) == i), k) for i in range(blocks)]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    ranked = out.withColumn("rank", F.row_number().over(_best())).where(F.col("rank") <= k)
    return ranked.select(F.col("q").alias(query_id), "rank", F.col("d").alias(doc_id), "score")


def _best() -> Window:
    return Window.partitionBy("q").orderBy(F.col("score").desc(), F.col("d").asc_nulls_last())


def _one_each(asked: DataFrame) -> DataFrame:
    """One row for each q, with the distinct words of all its rows; `asked` itself if it has no other."""
    again = asked.groupBy("q").count().where("count > 1").select(F.col("q").alias("_q"))
    if again.isEmpty():
        return asked

    def merge(key, table):
        import pyarrow as pa

        h = np.unique(np.concatenate([np.frombuffer(x.as_py(), np.uint64) for x in table.column("terms")]))
        return pa.table({"q": pa.array([key[0].as_py()], pa.int64()), "terms": pa.array([h.tobytes()], pa.binary())})

    same = asked["q"].eqNullSafe(again["_q"])
    merged = asked.join(again, same, "left_semi").distinct().groupBy("q").applyInArrow(merge, "q long, terms binary")
    return written(asked.join(again, same, "left_anti").union(merged))


def _block(source: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    spark = source.sparkSession
    shard_texts, block, most_postings, seed = SHARD, BLOCK, MOST_POSTINGS, SEED  # as they are on the driver
    rows = asked.toArrow()  # QUERY_WORDS words or so
    names = rows["q"].to_numpy()
    sets = [np.frombuffer(x.as_py(), np.uint64) for x in rows["terms"]]
    vocabulary = np.unique(np.concatenate(sets)) if sets else np.zeros(0, np.uint64)
    shipped = spark.sparkContext.broadcast((names, [np.searchsorted(vocabulary, s) for s in sets], vocabulary))

    def match(batches):
        import pyarrow as pa

        vocabulary = shipped.value[2]
        for batch in kernel.parts(batches, 2048):
            h, each = _flat(batch.column(2), np.uint64)
            ok, w = find(vocabulary, h)
            tf = _flat(batch.column(3), np.int32)[0][ok]
            sizes = np.bincount(np.repeat(np.arange(len(batch)), each)[ok], minlength=len(batch))
            ends = np.concatenate(([0], np.cumsum(sizes) * 4)).astype(np.int32)
            binary = lambda x: pa.Array.from_buffers(pa.binary(), len(batch), [None, pa.py_buffer(ends), pa.py_buffer(x.astype(np.int32))])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), binary(w), binary(tf)], names=["d", "n", "words", "counts"])

    source = written(source.mapInArrow(kernel.trimmed(match), "d long, n long, words binary, counts binary"))

    def count(batches):
        import pyarrow as pa

        df, n, length = np.zeros(len(shipped.value[2]), np.int64), 0, 0
        for batch in batches:
            df += np.bincount(_flat(batch.column(1), np.int32)[0], minlength=len(df))
            n += len(batch)
            length += int(batch.column(0).to_numpy().sum())
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, [-1, -2])), pa.array(np.append(df[at], [n, length]))], names=["w", "n"])

    counts = source.select("n", "words").mapInArrow(kernel.trimmed(count), "w long, n long").groupBy("w").agg(F.sum("n").alias("n")).toArrow()  # a row for each query word
    df, sums = np.zeros(len(vocabulary)), {-1: 0, -2: 0}
    w, n = counts["w"].to_numpy(), counts["n"].to_numpy()
    df[w[w >= 0]] = n[w >= 0]
    sums |= {int(a): int(b) for a, b in zip(w[w < 0], n[w < 0], strict=True)}
    average = max(sums[-2] / max(1, sums[-1]), 1e-9)
    idf = spark.sparkContext.broadcast(np.log1p((sums[-1] - df + 0.5) / (df + 0.5)))

    def searched(texts: DataFrame, floors) -> DataFrame:
        """The k best of each task's texts for every query, without those below its floor."""

        def run(batches):
            import pyarrow as pa

            names, queries, vocabulary = shipped.value
            weight, floor = idf.value, floors.value if floors else np.zeros(len(queries))
            best = [(np.zeros(0), np.zeros(0, np.int64))] * len(queries)

            def close(*held):
                ids, sizes, digests, word, impact = (np.concatenate([x.pop(0) for _ in range(len(x))]) for x in held)
                keep = first_of_each(ids, digests, k)
                at = np.repeat(keep, sizes)
                shard = Shard(ids[keep], sizes[keep], word[at], impact[at], len(vocabulary), block)
                for a in range(0, len(queries), TOGETHER):
                    often = shard.often(queries[a : a + TOGETHER])
                    for i, q in enumerate(queries[a : a + TOGETHER], a):
                        best[i] = shard.search(q, k, best[i], floor[i], often[i - a])

            new = lambda: ([], [], [], [], [])
            lists, held, size = new(), 0, 0
            for batch in kernel.parts(batches, min(shard_texts, 2048)):
                w, each = _flat(batch.column(2), np.int32)
                text, tf = np.repeat(np.arange(len(batch)), each), _flat(batch.column(3), np.int32)[0]
                lengths = batch.column(1).to_numpy()
                digests = b"".join(hashlib.blake2b(b"%d %b%b" % (z, x, y), digest_size=16).digest() for x, y, z in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), lengths.tolist(), strict=True))
                impacts = weight[w] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[text] / average))
                parts = batch.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False), each, np.frombuffer(digests, np.uint64).reshape(-1, 2), w, impacts
                for a, b in zip(lists, parts, strict=True):
                    a.append(b)
                held, size = held + len(batch), size + len(w)
                if held >= shard_texts or size >= most_postings:
                    close(*lists)
                    lists, held, size = new(), 0, 0
            if held:
                close(*lists)
            n = [len(b[0]) for b in best]
            d = np.concatenate([b[1] for b in best]) if best else np.zeros(0, np.int64)
            s = np.concatenate([b[0] for b in best]) if best else np.zeros(0)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(names, n).astype(np.int64)), pa.array(d, mask=d == NO_ID), pa.array(s)], names=["q", "d", "score"])

        return texts.mapInArrow(kernel.trimmed(run), "q long, d long, score double")

    some = source.where(F.pmod(F.xxhash64("d", "words"), F.lit(seed)) == 0)
    first = searched(some.coalesce(max(1, source.rdd.getNumPartitions() // 8)), None)  # fewer tasks, as each goes through all queries
    first = first.withColumn("rank", F.row_number().over(_best())).where(F.col("rank") == k).select("q", "score").toArrow()  # a row for each query
    floor = dict(zip(first["q"].to_pylist(), first["score"].to_pylist(), strict=True))
    return searched(source, spark.sparkContext.broadcast(np.array([floor.get(q, 0.0) for q in names.tolist()])))
