"""Mixing sources to target weights by Sainte-Laguë apportionment, in DataFrame operations only.

A text's size is its number of words. The words of all texts are shared among the sources by weight, no source above a
multiple of its own size; what a capped source leaves goes to the others by weight. Targets are then turned into whole
blocks of equal size: sources, and after them the shards of each source, get blocks by highest quotients (target over odd
numbers). Inside a shard texts stand in the order of a seeded hash; its blocks are taken from a seeded block on, round the
shard as often as the quota asks for. So no task holds more than a shard, however large its source is.

Nulls in text count as empty: size 0, taken 0. A null source is a source of its own, last in order. Null doc_ids take part
like any other. Repeated rows stand side by side in the order and are taken by themselves. Empty tables give empty results.
Ties of quotients go to the earlier source or shard. Other columns are kept and never read; `mix` adds columns
whose names begin with _, so its input should have none such, while `apply` takes columns of any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.llm.common import BLANK, WORD, fresh, written

CAP = 3  # times its own size that a source may be taken
BLOCK = 16  # words of a block
SHARD_WORDS, MOST_SHARDS = 250_000, 4096  # a source has so many shards that each has about so many words, 4096 at most
SEED = 17
OWN = ["_size", "_source_size", "_target", "_taken", "_from", "_length", "_shard_words", "_start"]


def size(text: Column) -> Column:
    """Words become a letter each, blanks go; counting matches would copy the whole text for every word."""
    return F.coalesce(F.length(F.translate(F.regexp_replace(text, WORD, "x"), " \t\n\x0b\x0c\r", "")), F.lit(0)).cast("long")


def targets(totals: DataFrame, weights=(1, 2, 3), cap: int = CAP) -> DataFrame:
    """totals: (_source, _source_size), a row for each source. Adds _place (order of the source) and _target.

    Targets are level * weight, or cap * size where that is less; the level is found by taking sources in order of
    cap * size / weight: the first so many are capped, the rest share what is left.
    """
    every = Window.partitionBy()  # a row for each source
    t = totals.withColumn("_place", F.row_number().over(every.orderBy(F.col("_source").asc_nulls_last())))
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.col("_place") - 1) % len(weights) + 1).cast("int")).cast("double")
    t = t.withColumns({"_w": w, "_cap": cap * F.col("_source_size").cast("double")}).withColumn("_ratio", F.col("_cap") / F.col("_w"))
    by_ratio = every.orderBy("_ratio", "_place")
    t = t.withColumns({"_all": F.sum(F.col("_source_size").cast("double")).over(every), "_caps": F.coalesce(F.sum("_cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)), "_rest": F.sum("_w").over(by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing))})
    # the level if this source and all behind it share what those before it leave; the first that stays under its cap sets it
    t = t.withColumn("_level", (F.col("_all") - F.col("_caps")) / F.col("_rest"))
    t = t.withColumn("_set", F.min(F.when(F.col("_level") <= F.col("_ratio"), F.struct("_ratio", "_place", "_level"))).over(every)["_level"])
    return t.withColumn("_target", F.coalesce(F.least("_cap", F.col("_set") * F.col("_w")), F.col("_cap"))).select("_source", "_source_size", "_place", "_target")


def apportion(votes: DataFrame, group: list[str], place: str, vote: str, seats: Column, name: str) -> DataFrame:
    """Adds whole seats for each party of a group, by highest quotients vote / (2k + 1); `seats`: of the whole group.

    A party's seats lie between its rounded share of seats - n/2 and of seats + n/2 (n parties), so only the quotients in
    between, 3n of them at most in a group, are made and ranked; those below are won by all.
    """
    all_ = Window.partitionBy(*group)
    v = votes.withColumns({"_seats": seats, "_votes": F.sum(vote).over(all_), "_n": F.count(F.lit(1)).over(all_)})
    share = lambda s: F.when(F.col("_votes") > 0, F.floor(F.col(vote) * F.greatest(s, F.lit(0.0)) / F.col("_votes") + 0.5)).otherwise(0).cast("long")
    v = v.withColumns({"_low": F.greatest(share(F.col("_seats") - F.col("_n") / 2) - 1, F.lit(0)), "_high": share(F.col("_seats") + F.col("_n") / 2) + 1})
    v = v.withColumn("_left", F.col("_seats") - F.sum("_low").over(all_))
    q = v.select(*votes.columns, "_low", "_left", F.explode(F.sequence("_low", "_high")).alias("_k")).withColumn("_q", F.col(vote) / (2 * F.col("_k") + 1))
    won = q.withColumn("_rank", F.row_number().over(all_.orderBy(F.col("_q").desc(), place, "_k")))
    return won.groupBy(*votes.columns).agg((F.first("_low") + F.count_if((F.col("_rank") <= F.col("_left")) & (F.col(vote) > 0))).alias(name))


def mix(docs: DataFrame, weights=(1, 2, 3), cap: int = CAP, block: int = BLOCK, seed: int = SEED, doc_id: str = "doc_id", source: str = "source", text: str = "text", keep_text: bool = True) -> DataFrame:
    """The rows with _size, _source_size, _target and _taken, and where the taken words lie in the shard's order.

    keep_text: whether the other columns come along (else doc_id and source only).
    """
    sized = docs.withColumn("_size", size(F.col(text)))
    light = sized.select(F.col(doc_id).alias("_id"), F.col(source).alias("_source"), "_size")
    totals = light.groupBy("_source").agg(F.sum("_size").alias("_source_size"))
    t = targets(totals, weights, cap)
    every = Window.partitionBy()
    t = apportion(t, [], "_place", "_target", F.round(F.sum("_target").over(every) / block).cast("long"), "_blocks")
    n = F.least(F.greatest(F.ceil(F.col("_source_size") / SHARD_WORDS), F.lit(1)), F.lit(MOST_SHARDS))
    t = written(t.withColumn("_shards", n.cast("long")))  # a row for each source, whose size Spark now knows
    # numbers of rows with the same hash don't matter: equal ids of a source share a shard
    shard = lambda id_: F.pmod(F.xxhash64(F.lit(seed), id_), F.col("_shards"))
    with_source = light.join(t, light["_source"].eqNullSafe(t["_source"])).drop(t["_source"]).withColumn("_shard", shard(F.col("_id")))
    shards = with_source.groupBy("_source", "_place", "_source_size", "_target", "_blocks", "_shards", "_shard").agg(F.sum("_size").alias("_shard_words"))
    quotas = apportion(shards, ["_place"], "_shard", "_shard_words", F.col("_blocks"), "_quota")
    quotas = written(quotas.withColumn("_length", F.least(F.col("_quota") * block, cap * F.col("_shard_words"))).withColumn("_start", F.when(F.col("_shard_words") > 0, F.pmod(F.xxhash64(F.lit(seed), F.col("_place"), F.col("_shard")), F.ceil(F.col("_shard_words") / block)) * block).otherwise(0)))

    rows = sized if keep_text else sized.select(doc_id, source, "_size")
    s, q = F.broadcast(t) if t.count() <= 100_000 else t, quotas.drop("_source_size", "_target", "_blocks", "_shards", "_quota", "_source")
    s = s.select(F.col("_source").alias("_s"), "_place", "_source_size", "_target", "_shards")
    placed = rows.join(s, rows[source].eqNullSafe(s["_s"])).withColumn("_shard", shard(F.col(doc_id))).join(q, ["_place", "_shard"])
    order = Window.partitionBy("_place", "_shard").orderBy(F.xxhash64(F.lit(seed + 1), F.col(doc_id)), F.col(doc_id), "_size", *([F.xxhash64(F.col(text))] if keep_text else []))
    placed = placed.withColumn("_from", F.sum("_size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_size"))
    return placed.withColumn("_taken", taken(F.col("_from"), F.col("_size"), F.col("_shard_words"), F.col("_start"), F.col("_length"))).drop("_s", "_shards", "_place", "_shard")


def _overlap(a, n, b, m):
    return F.greatest(F.least(a + n, b + m) - F.greatest(a, b), F.lit(0))


def taken(at: Column, n: Column, words: Column, start: Column, length: Column) -> Column:
    """How many of the words [at, at + n) of a circle of `words` lie in `length` words from `start` on, laps counted."""
    laps = F.when(words > 0, F.floor(length / words)).otherwise(0)
    rest = length - laps * words
    return (laps * n + _overlap(at, n, start, rest) + _overlap(at, n, start - words, rest)).cast("long")


def apply(docs: DataFrame, **options) -> DataFrame:
    """The mix itself, with the columns of docs: each text once for every full lap, and the part of it, cut at words, that
    a partial lap takes. Texts that are not taken are left out. Columns whose names begin with _ are renamed while it works."""
    columns = docs.columns
    plain: list[str] = []
    for c in columns:
        plain.append(fresh([*columns, *plain], f"kept{c}") if c.startswith("_") else c)
    docs = docs.toDF(*plain)
    m = mix(docs, **options)
    text = options.get("text", "text")
    laps = F.when(F.col("_shard_words") > 0, F.floor(F.col("_length") / F.col("_shard_words"))).otherwise(0)
    part = F.col("_taken") - laps * F.col("_size")
    rest = F.col("_length") - laps * F.col("_shard_words")
    # the part begins where the lap does, unless the lap has begun before the text; a lap that comes round to a text from both sides takes both ends
    tail = _overlap(F.col("_from"), F.col("_size"), F.col("_start"), rest)
    head = _overlap(F.col("_from"), F.col("_size"), F.col("_start") - F.col("_shard_words"), rest)
    m = m.withColumns({"_laps": laps, "_part": part, "_tail": tail, "_head": head, "_skip": F.greatest(F.col("_start") - F.col("_from"), F.lit(0))})
    # pieces of blanks and a word; blanks at the end are a piece more, which no cut reaches
    m = m.withColumn("_words", F.when((F.col("_part") > 0) & (F.col("_part") < F.col("_size")), F.split(F.col(text), rf"(?<!{BLANK})(?={BLANK})")))
    cut = lambda skip, n: F.slice("_words", skip.cast("int") + 1, n.cast("int"))
    piece = F.when(F.col("_part") == F.col("_size"), F.col(text)).otherwise(F.array_join(F.concat(cut(F.lit(0), F.col("_head")), cut(F.col("_skip"), F.col("_tail"))), ""))
    whole = F.array_repeat(F.col(text), F.col("_laps").cast("int"))
    m = m.withColumn("_texts", F.when(F.col("_part") > 0, F.concat(whole, F.array(piece))).otherwise(whole))
    return m.where(F.size("_texts") > 0).withColumn("_text", F.explode("_texts")).select(*[F.col("_text").alias(c) if c == text else F.length("_text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns]).toDF(*columns)
