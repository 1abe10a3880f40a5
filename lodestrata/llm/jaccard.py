"""Exact Jaccard self-join of word-shingle sets, as components, by prefixes of single tokens and of token combinations.

A text's tokens are the hashes (64 bits) of its runs of five words; two texts link if their sets' Jaccard similarity is
at least 3/4, which whole-number arithmetic decides. Texts with equal sets are one node.

1. Tokens are ordered: those in many texts last, by document frequency, the others first, by hash. Frequencies are counted
   over all texts; the most frequent tokens (2**18 at most, an 8-byte number each) are what is broadcast. Any order gives the
   same links; this one keeps prefixes rare.
2. Two similar sets share a token within their prefixes; and the first two tokens that they share lie within prefixes that
   are one longer. The extended prefixes are indexed by token.
3. Rare tokens give candidate pairs, under length and positional filters; a frequent token (more than RARE nodes) gives
   only stars: each node with the first one of about its size. Stars, those of rare tokens too, are verified and joined
   into components; frequent tokens get more stars, round other nodes. Pairs within a component have nothing left to say;
   the others are verified.
4. Frequent tokens whose nodes are by then in one component have nothing left to find. Of the others, nodes are indexed by
   combinations of two tokens, and pairs across components become candidates; a token of a node with very many such tokens
   stays single, with the first-token filter. Signatures of whole sets, which never rule out a similar pair, leave out most
   pairs that verification would refuse. So copies are connected without all their pairs, and no link is lost.

Nulls and texts without words have empty sets, link with nothing and are components by themselves. Texts with fewer than
five words have one token. Equal rows have the same node; rows with a null doc_id link like others, and a component's id is
its least doc_id that is not null. A token is 64 bits of a hash, and pairs are verified with all of them. Two different sets would
be taken for one at a 64-bit collision, which among 10**8 texts has a chance of 3 in 10,000. Other columns are not read. An empty
table gives an empty table.
"""

from __future__ import annotations

from math import ceil, log2

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm import kernel
from lodestrata.llm.common import small_batches, written
from lodestrata.llm.components import components

WORDS = 5
RARE = 48  # nodes of a token up to which all its pairs are candidates
HEAVY, MOST_HEAVY = 32, 1 << 18  # texts from which a token counts as frequent in the order, and how many are kept
ROUNDS, CENTERS = 3, 3  # further stars of frequent tokens, and centers of each
COMBINED = 24  # tokens of a node up to which combinations are made
SEEN = 1 << 19  # nodes that a task remembers, so as to send copies once
SMALL = 2_000_000  # rows up to which a table of numbers is broadcast
PIECE = 1 << 18  # bytes of text, MADE rows, HELD tokens: what a worker works on at a time, so that it stays small
MADE, HELD = 1 << 17, 1 << 20


def node_of(s: np.ndarray) -> int:
    """A signed 64-bit digest of a sorted set."""
    salted = kernel.mix(s + np.uint64(0x632BE59BD9B4E019))
    return int(kernel.mix(np.array([salted.sum(dtype=np.uint64) ^ (np.uint64(len(s)) << np.uint64(40))], np.uint64)).view(np.int64)[0])


def _sets(batches, column: int, n: int = WORDS):
    """(batch, sets of its rows)."""
    kernel.release()
    for batch in batches:
        sets: list[np.ndarray] = []
        for _, buf, offsets in kernel.pieces(batch.column(column), PIECE):
            sets += kernel.shingles(kernel.LOWERED[buf], offsets, n)
        yield batch, sets


def _once(batches, column: int):
    """(node, set) of non-empty texts, copies within a task mostly once."""
    seen: set[int] = set()
    for _, sets in _sets(batches, column):
        for s in sets:
            if len(s) and (node := node_of(s)) not in seen:
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(node)
                yield node, s


def _texts(docs: DataFrame, text: str) -> DataFrame:
    return small_batches(docs).select(F.col(text).cast("binary").alias("_t"))


# 1. frequencies


def pack(values: np.ndarray) -> bytes:
    """Sorted 32-bit numbers as compressed differences, plane by plane."""
    d = np.diff(values.astype(np.uint32), prepend=np.uint32(0)).astype("<u4")
    return zstandard.ZstdCompressor(level=1).compress(d.view(np.uint8).reshape(-1, 4).T.tobytes())


def unpack(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u4").ravel(), dtype=np.uint32)


def frequent(docs: DataFrame, text: str, least: int = HEAVY, most: int = MOST_HEAVY) -> tuple[np.ndarray, np.ndarray]:
    """(the upper bits of tokens, document frequencies) of the most frequent tokens, in order of the bits.

    Tasks send sorted runs of shortened hashes, dealt out by their top bits, two to three bytes a token.
    """
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    bits = min(24, max(6, ceil(log2(size / 6 / 2e6 + 1))))
    held_tokens = HELD  # as it is on the driver

    def cut(batches):
        import pyarrow as pa

        def flush(held):
            t = np.concatenate(held)
            held.clear()
            t >>= np.uint64(32 - bits)
            t.sort()
            edges = np.searchsorted(t, np.arange((1 << bits) + 1, dtype=np.uint64) << np.uint64(32))
            full = np.flatnonzero(np.diff(edges))
            rows = [pack(t[edges[i] : edges[i + 1]] & np.uint64(0xFFFFFFFF)) for i in full]
            return pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(rows, pa.binary())], names=["bucket", "run"])

        held, n = [], 0
        for _, s in _once(batches, 0):
            held.append(s)
            n += len(s)
            if n > 2 * held_tokens:
                yield flush(held)
                held, n = [], 0
        if held:
            yield flush(held)

    def count(batches):
        import pyarrow as pa

        def merged(parts):
            v = np.concatenate([p[0] for p in parts])
            order = np.argsort(v, kind="stable")
            v = v[order]
            at = np.flatnonzero(np.concatenate(([True], v[1:] != v[:-1])))
            return v[at], np.add.reduceat(np.concatenate([p[1] for p in parts])[order], at)

        def close(bucket, parts):
            v, c = merged(parts)
            at = c >= least
            return pa.RecordBatch.from_arrays([pa.array((np.uint64(bucket) << np.uint64(32) | v[at].astype(np.uint64)).astype(np.int64)), pa.array(c[at].astype(np.int64))], names=["token", "df"])

        bucket, parts, held = None, [], 0
        for batch in batches:
            for b, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if b != bucket and parts:
                    yield close(bucket, parts)
                    parts, held = [], 0
                bucket = b
                run = unpack(raw)
                parts.append((run, np.ones(len(run), np.int64)))
                held += len(run)
                if held > held_tokens:  # a token in very many texts is held as a number only
                    parts, held = [merged(parts)], 0
        if parts:
            yield close(bucket, parts)

    runs = _texts(docs, text).mapInArrow(kernel.trimmed(cut), "bucket int, run binary").repartition("bucket").sortWithinPartitions("bucket")
    top = runs.mapInArrow(kernel.trimmed(count), "token long, df long").orderBy(F.col("df").desc(), "token").limit(most).toPandas()  # `most` rows at most
    top = top.sort_values("token")
    return top["token"].to_numpy(np.uint64), top["df"].to_numpy(np.int64), bits


# 2. the index of extended prefixes


def index(docs: DataFrame, text: str, top) -> DataFrame:
    """(token, node, n, pos): the extended prefix of every node, in the common order."""
    shipped = docs.sparkSession.sparkContext.broadcast(top)  # MOST_HEAVY rows at most
    made = MADE

    def run(batches):
        import pyarrow as pa

        tokens, counts, bits = shipped.value
        shift = np.uint64(32 - bits)

        def flush(held):
            t = np.concatenate([h[0] for h in held])
            sizes = [len(h[0]) for h in held]
            node = np.repeat(np.array([h[1] for h in held], np.int64), sizes)
            n = np.repeat(np.array([h[2] for h in held], np.int32), sizes)
            pos = np.concatenate([np.arange(k, dtype=np.int32) for k in sizes])
            return pa.RecordBatch.from_arrays([pa.array(t.view(np.int64)), pa.array(node), pa.array(n), pa.array(pos)], names=["token", "node", "n", "pos"])

        held, total = [], 0
        for node, s in _once(batches, 0):
            n = len(s)
            prefix = min(n, n - -(-3 * n // 4) + 2)
            if len(tokens):
                short = s >> shift
                at = np.minimum(np.searchsorted(tokens, short), len(tokens) - 1)
                df = np.where(tokens[at] == short, counts[at], 0)
                s = s[np.argsort(df, kind="stable")]
            held.append((s[:prefix], node, n))
            total += prefix
            if total > made:
                yield flush(held)
                held, total = [], 0
        if held:
            yield flush(held)

    return _texts(docs, text).mapInArrow(kernel.trimmed(run), "token long, node long, n int, pos int")


# 3. candidates


def fits(n1, p1, n2, p2, shared: int):
    """Whether sets of these sizes can be similar if the token at these places is their shared-th common one or earlier."""
    rest = np.minimum(n1 - p1, n2 - p2) - 1 + shared
    return (4 * np.minimum(n1, n2) >= 3 * np.maximum(n1, n2)) & (7 * rest >= 3 * (n1 + n2))


def candidates(idx: DataFrame) -> DataFrame:
    """(kind, token, a, b, n, pos): kinds 0 and 2 are pairs (a, b), 2 those of a token's first node; kind 1 are the entries of
    frequent tokens (a: the node).

    Entries come sorted by token and size; only the first RARE of a token are ever held.
    """
    most = MADE

    def run(batches):
        import pyarrow as pa

        out: list[tuple] = []
        pairs: list[np.ndarray] = []
        made = 0

        def drain():
            nonlocal out, pairs, made
            p = np.unique(np.concatenate(pairs), axis=0) if pairs else np.zeros((0, 3), np.int64)
            e = np.concatenate(out, axis=1) if out else np.zeros((4, 0), np.int64)
            k, z = len(p), e.shape[1]
            out, pairs, made = [], [], 0
            return pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([p[:, 2], np.ones(z, np.int64)]).astype(np.int32)), pa.array(np.concatenate([np.zeros(k, np.int64), e[0]])), pa.array(np.concatenate([p[:, 0], e[1]])), pa.array(np.concatenate([p[:, 1], np.zeros(z, np.int64)])), pa.array(np.concatenate([np.zeros(k, np.int64), e[2]]).astype(np.int32)), pa.array(np.concatenate([np.zeros(k, np.int64), e[3]]).astype(np.int32))],
                names=["kind", "token", "a", "b", "n", "pos"],
            )

        def pair(a, b, star):
            nonlocal made
            if len(a):
                pairs.append(np.column_stack([np.minimum(a, b), np.maximum(a, b), np.where(star, 2, 0)]))
                made += len(a)

        def rare(rows):
            i, j = np.triu_indices(rows.shape[1], 1)
            ok = fits(rows[2, i], rows[3, i], rows[2, j], rows[3, j], 2)
            pair(rows[1, i[ok]], rows[1, j[ok]], i[ok] == 0)

        def stars(rows, center):
            """Goes on with a run; center: (node, n) of the last star or None."""
            nonlocal made
            at = 0
            while at < rows.shape[1]:
                if center is None or 4 * center[1] < 3 * rows[2, at]:
                    center = (rows[1, at], rows[2, at])
                to = int(np.searchsorted(rows[2, at:] * 3, 4 * center[1], "right")) + at
                to = max(to, at + 1)
                others = rows[1, at:to][rows[1, at:to] != center[0]]
                pair(np.full(len(others), center[0]), others, np.ones(len(others), bool))
                at = to
            out.append(rows)
            made += rows.shape[1]
            return center

        head, token, center, frequent_run = np.zeros((4, 0), np.int64), None, None, False
        for batch in batches:
            rows = np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(4)])
            if not rows.shape[1]:
                continue
            edges = np.concatenate(([0], np.flatnonzero(np.diff(rows[0])) + 1, [rows.shape[1]]))
            long_ = np.flatnonzero(np.diff(edges) > 1)
            first, last = 0, len(edges) - 2
            todo = sorted({first, last, *long_.tolist()})
            for k in todo:
                part = rows[:, edges[k] : edges[k + 1]]
                if part[0, 0] != token:
                    if token is not None and not frequent_run and head.shape[1] > 1:
                        rare(head)
                    head, token, center, frequent_run = part[:, :0], part[0, 0], None, False
                # one entry for each node: copies of a node have the same size and stand together
                joined = np.concatenate([head[:, -1:], part], axis=1)
                new = np.concatenate(([True], joined[1, 1:] != joined[1, :-1]))[joined.shape[1] - part.shape[1] :] if joined.shape[1] > part.shape[1] else np.concatenate(([True], part[1, 1:] != part[1, :-1]))
                part = part[:, new]
                if frequent_run:
                    center = stars(part, center)
                    head = part[:, -1:] if part.shape[1] else head
                else:
                    head = np.concatenate([head, part], axis=1)
                    if head.shape[1] > RARE:
                        center, frequent_run = stars(head, None), True
                        head = head[:, -1:]
                if made > most:
                    yield drain()
        if token is not None and not frequent_run and head.shape[1] > 1:
            rare(head)
        if made:
            yield drain()

    dealt = idx.repartition("token").sortWithinPartitions("token", "n", "node")
    return dealt.mapInArrow(kernel.trimmed(run), "kind int, token long, a long, b long, n int, pos int")


def small(df: DataFrame) -> DataFrame:
    """Marked for broadcast if it has few rows."""
    return F.broadcast(df) if df.count() <= SMALL else df


def sets_of(docs: DataFrame, text: str, nodes: DataFrame) -> DataFrame:
    """(node, set) of the asked nodes, made anew from the texts: only these are shuffled."""

    def run(batches):
        import pyarrow as pa

        def batch(held):
            return pa.RecordBatch.from_arrays([pa.array([h[0] for h in held], pa.int64()), pa.array([h[1] for h in held], pa.binary())], names=["node", "tokens"])

        held: list[tuple[int, bytes]] = []
        for node, s in _once(batches, 0):
            held.append((node, s.tobytes()))
            if len(held) >= 512:
                yield batch(held)
                held = []
        yield batch(held)

    nodes = written(nodes.distinct())
    every = _texts(docs, text).mapInArrow(kernel.trimmed(run), "node long, tokens binary")
    return every.join(small(nodes), "node", "left_semi").dropDuplicates(["node"])


def verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are similar."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                s, t = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                if 4 * min(len(s), len(t)) < 3 * max(len(s), len(t)):
                    keep.append(False)
                    continue
                both = np.sort(np.concatenate((s, t)), kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                keep.append(4 * common >= 3 * (len(s) + len(t) - common))
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(keep, pa.bool_())) for i in (0, 1)], names=["a", "b"])

    one, two = (sets.select(F.col("node").alias(side), F.col("tokens").alias(f"_{side}")) for side in ("a", "b"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "_a", "_b").mapInArrow(kernel.trimmed(run), "a long, b long")


# 4. what stars leave open


def across(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs whose nodes aren't in one component yet."""
    one, two = (labels.select(F.col("node").alias(side), F.col("component").alias(f"_{side}")) for side in ("a", "b"))
    return pairs.join(one, "a", "left").join(two, "b", "left").where(F.coalesce("_a", "a") != F.coalesce("_b", "b")).select("a", "b")


def ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("node"))


def mixed(entries: DataFrame, labels: DataFrame) -> DataFrame:
    """Entries of tokens whose nodes are in more than one component, with the component. labels: (node, component)."""
    e = entries.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    tokens = e.groupBy("token").agg(F.min("component").alias("_x"), F.max("component").alias("_y")).where("_x <> _y").select("token")
    return written(e.join(tokens, "token", "left_semi"))


def relabelled(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Components after more links."""
    return written(components(labels.select(F.col("node").alias("a"), F.col("component").alias("b")).union(links)))


def signatures(sets: DataFrame) -> DataFrame:
    """(node, sig): for each bit of 64 * len(sig), whether an odd number of the set's tokens fall on it. Two signatures of one
    length differ in no more bits than their sets have tokens that only one of them holds. Long sets have long signatures,
    by powers of two from 8 to 64 numbers; halves folded onto each other make a signature of half the length."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = []
            for raw in batch.column(1).to_pylist():
                s = kernel.mix(np.frombuffer(raw, np.uint64))
                bits = 64 * min(64, max(8, 1 << (-(-len(s) // 32) - 1).bit_length()))
                odd = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
                rows.append(np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8").tolist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.int64()))], names=["node", "sig"])

    return sets.mapInArrow(kernel.trimmed(run), "node long, sig array<long>")


def alike(sig1, n1, sig2, n2):
    """Whether the signatures leave it open that the sets are similar: those have (n1 + n2) / 7 tokens at most that one of them
    lacks."""
    fold = lambda s, k: F.zip_with(F.slice(s, F.lit(1), k), F.slice(s, k + 1, k), lambda x, y: x.bitwiseXOR(y))
    one = F.when(F.size(sig1) > F.size(sig2), fold(sig1, F.size(sig2))).otherwise(sig1)
    two = F.when(F.size(sig2) > F.size(sig1), fold(sig2, F.size(sig1))).otherwise(sig2)
    differ = F.aggregate(F.zip_with(one, two, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)
    return 7 * differ <= n1 + n2


def star_rounds(entries: DataFrame, labels: DataFrame, tested: DataFrame, docs: DataFrame, text: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame | None]:
    """(components, tested pairs, entries that are still mixed, sets of their nodes) after stars round other nodes of frequent tokens that are still mixed.

    A token's nodes are dealt to CENTERS classes by a hash that differs from round to round; each class has as its center the node
    that has the most mixed tokens in its prefix, so the fewest rare ones of its own: it lies nearest to the text that its
    group has in common. Classes are aggregated before the shuffle; a round makes CENTERS pairs at most for an entry.
    """
    e = mixed(entries, labels)
    if e.isEmpty():
        return labels, tested, e, None
    sets = written(sets_of(docs, text, e.select("node")))
    for r in range(ROUNDS):
        load = e.groupBy("node").agg(F.count(F.lit(1)).alias("f"))
        hashed = F.xxhash64("node", F.lit(r))
        best = e.join(load, "node").groupBy("token", F.pmod(hashed, F.lit(CENTERS)).alias("_class")).agg(F.max(F.struct("f", hashed.alias("h"), "node", "n", "component")).alias("c"))
        c = small(written(best.select("token", F.col("c.node").alias("_node"), F.col("c.n").alias("_n"), F.col("c.component").alias("_component"))))
        near = e.join(c, "token").where((F.col("component") != F.col("_component")) & (4 * F.least("n", "_n") >= 3 * F.greatest("n", "_n")))
        pairs = written(near.select(F.least("node", "_node").alias("a"), F.greatest("node", "_node").alias("b")).distinct().join(tested, ["a", "b"], "left_anti"))
        tested = tested.union(pairs)
        labels = relabelled(labels, verify(pairs, sets))
        e = mixed(entries, labels)
        if e.isEmpty():
            break
    return labels, tested, e, sets


def open_pairs(e: DataFrame, sets: DataFrame | None) -> DataFrame | None:
    """Candidate pairs across components from frequent tokens, under length, positional and signature filters; None if there
    are none. e: mixed entries; sets: those of their nodes."""
    if sets is None or e.isEmpty():
        return None
    load = e.groupBy("node").agg(F.count(F.lit(1)).alias("f"))
    wide = e.join(load.where(F.col("f") > COMBINED), "node", "left_semi").select("token").distinct()
    single = e.join(wide, "token", "left_semi").select(F.col("token").alias("k1"), F.lit(0).cast("long").alias("k2"), "node", "n", "pos", "component", F.lit(1).alias("shared"))
    marked = e.join(wide.withColumn("wide", F.lit(True)), "token", "left")
    narrow_nodes = marked.groupBy("node", "n", "component").agg(F.sort_array(F.collect_list(F.struct("pos", "token", F.coalesce("wide", F.lit(False)).alias("wide")))).alias("ts"))
    # a node with a narrow token has at most COMBINED tokens
    first = narrow_nodes.select("node", "n", "component", "ts", F.posexplode("ts").alias("i", "x")).where(~F.col("x.wide"))
    combined = first.select(F.col("x.token").alias("k1"), F.explode(F.slice("ts", F.col("i") + 2, F.lit(COMBINED))).alias("y"), "node", "n", "component").select("k1", F.col("y.token").alias("k2"), "node", "n", F.col("y.pos").alias("pos"), "component", F.lit(2).alias("shared"))
    keyed = written(single.union(combined))
    mixed_keys = keyed.groupBy("k1", "k2").agg(F.min("component").alias("_x"), F.max("component").alias("_y")).where("_x <> _y").select("k1", "k2")
    keyed = keyed.join(mixed_keys, ["k1", "k2"], "left_semi").join(written(signatures(sets)), "node")
    other = keyed.select("k1", "k2", F.col("node").alias("node2"), F.col("n").alias("n2"), F.col("pos").alias("pos2"), F.col("component").alias("component2"), F.col("sig").alias("sig2"))
    rest = F.least(F.col("n") - F.col("pos"), F.col("n2") - F.col("pos2")) - 1 + F.col("shared")
    ok = (F.col("node") < F.col("node2")) & (F.col("component") != F.col("component2")) & (4 * F.least("n", "n2") >= 3 * F.greatest("n", "n2")) & (7 * rest >= 3 * (F.col("n") + F.col("n2")))
    ok = ok & alike(F.col("sig"), F.col("n"), F.col("sig2"), F.col("n2"))
    return keyed.join(other, ["k1", "k2"]).where(ok).select(F.col("node").alias("a"), F.col("node2").alias("b")).distinct()


def members(docs: DataFrame, doc_id: str, text: str, extra: list[str]) -> DataFrame:
    """(doc_id, n, node, extra columns) of every row; node is null for an empty set."""

    def run(batches):
        import pyarrow as pa

        for batch, sets in _sets(batches, 1):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([node_of(s) if len(s) else None for s in sets], pa.int64()), *[batch.column(i + 2) for i in range(len(extra))]], names=[doc_id, "n_shingles", "node", *extra])

    own = docs.select(doc_id, F.col(text).cast("binary").alias("_t"), *extra)
    f = own.schema.fields
    return own.mapInArrow(kernel.trimmed(run), ", ".join([f"`{doc_id}` {f[0].dataType.simpleString()}", "n_shingles long", "node long", *[f"`{x.name}` {x.dataType.simpleString()}" for x in f[2:]]]))


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs without those that have a link to, or through, a smaller doc_id. Of repeated rows (equal id and
    text) one stays; of rows with one id and different texts each goes or stays for itself; rows with a null doc_id can't be
    told apart and all stay."""
    rows = written(_joined(docs, doc_id, text))
    gone = rows.where(F.col(doc_id) != F.col("component_id"))
    repeated = written(rows.where(F.col(doc_id).isNotNull()).groupBy(doc_id).count().where("count > 1").select(doc_id))
    if repeated.isEmpty():
        return docs.join(small(written(gone.select(doc_id).distinct())), doc_id, "left_anti").select(*docs.columns)
    # only rows with a repeated id must be told apart by their sets
    single = docs.join(small(written(gone.join(small(repeated), doc_id, "left_anti").select(doc_id).distinct())), doc_id, "left_anti").join(small(repeated), doc_id, "left_anti")
    several = members(docs.join(small(repeated), doc_id, "left_semi"), doc_id, text, [c for c in docs.columns if c != doc_id])
    several = several.join(written(gone.join(small(repeated), doc_id, "left_semi").select(doc_id, "node").distinct()), [doc_id, "node"], "left_anti")
    kept = single.select(*docs.columns).union(several.select(*docs.columns))
    marked = kept.withColumn("_same", F.xxhash64(F.coalesce(text, F.lit(""))))
    return marked.where(F.col(doc_id).isNull()).union(marked.where(F.col(doc_id).isNotNull()).dropDuplicates([doc_id, "_same"])).drop("_same").select(*docs.columns)


def join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id): one row for each row of docs."""
    return _joined(docs, doc_id, text).drop("node")


def _joined(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """The same with the node of each row's set; null for an empty set."""
    found = written(candidates(index(docs, text, frequent(docs, text))))
    stars = written(found.where("kind = 2").select("a", "b").distinct())
    entries = found.where("kind = 1").select("token", F.col("a").alias("node"), "n", "pos")
    labels = written(components(verify(stars, sets_of(docs, text, ends(stars)))))
    labels, tested, e, sets = star_rounds(entries, labels, stars, docs, text)
    pairs = across(found.where("kind = 0").select("a", "b").distinct(), labels)
    more = open_pairs(e, sets)
    rest = written((pairs if more is None else pairs.union(more)).distinct().join(tested, ["a", "b"], "left_anti"))
    if not rest.isEmpty():
        labels = relabelled(labels, verify(rest, sets_of(docs, text, ends(rest))))
    rows = written(members(docs, doc_id, text, []))
    ids = rows.where("node IS NOT NULL").groupBy("node").agg(F.min(doc_id).alias("_id"))
    ids = ids.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = ids.groupBy("component").agg(F.min("_id").alias("component_id"))
    by_node = ids.join(least, "component").select(F.col("node").alias("_node"), "component_id")
    joined = rows.join(by_node, rows["node"] == by_node["_node"], "left")
    return joined.select(doc_id, "n_shingles", "node", F.when(F.col("node").isNull(), F.col(doc_id)).otherwise(F.col("component_id")).alias("component_id"))
