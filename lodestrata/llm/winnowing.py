"""Document fingerprints by winnowing, in DataFrame operations only.

A text is hashed at every code point over a window of GRAM code points; in every run of WINDOW such hashes the least is selected, of
equal ones the rightmost. Any passage of GRAM + WINDOW - 1 code points that two texts share is therefore selected alike in
both. Hash and position are packed into one number, the position turned round, so that a plain minimum breaks ties to the
right.

Nothing here is interpreted for each code point: a text is laid out at four bytes a code point, so a gram is a slice at a known
place; a row for each block of WINDOW runs holds the hashes that they need, and a row for each run its minimum. Only rows
whose minimum differs from that of the run before, about one in eight, go into the fingerprint.

Nulls are empty texts, whose fingerprints are empty; a text shorter than GRAM has one hash, of the whole. Very long texts
are read whole. Repeated rows have the same fingerprints; among equal doc_ids the order is by a
hash of the text, nulls come last. An empty table has no fingerprints. Other columns are not read, so their names don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from lodestrata.operators.ordinals import bounds, range_of

GRAM, WINDOW = 16, 16
MAX_POS = 2147483647
HIGH, LOW = -(1 << 32), 0xFFFFFFFF


def selected(df: DataFrame, keys: list[str], text: str, gram: int = GRAM, window: int = WINDOW, once: str | None = None) -> DataFrame:
    """(keys, _picked): a row for each selected hash, or a null one for an empty text. `once` is a column that only the first row
    of each text gets, null elsewhere."""
    n = F.coalesce(F.length(text), F.lit(0))
    extra = [once] if once else []
    df = df.select(*keys, *extra, F.coalesce(F.encode(text, "UTF-32"), F.lit(b"")).alias("_codes"), F.greatest(n - gram, F.lit(0)).alias("_last"), F.greatest(n - gram - window + 2, F.least(n, F.lit(1))).alias("_runs"))
    df = df.select("*", F.explode(F.sequence(F.lit(0), F.greatest(F.col("_runs") - 1, F.lit(0)), F.lit(window))).alias("_at"))
    df = df.select("*", (F.col("_at") * 4).alias("_byte"), (F.lit(MAX_POS) - F.col("_at")).cast("long").alias("_turned"))
    packed = lambda k: F.xxhash64(F.substring("_codes", F.col("_byte") + (4 * k + 1), F.lit(4 * gram))).bitwiseAND(F.lit(HIGH)).bitwiseOR(F.col("_turned") - F.lit(k).cast("long"))
    # from the hash before the block's first run to the last of its last run
    df = df.select(*keys, *extra, "_last", "_runs", "_at", F.array(*[packed(k) for k in range(-1, 2 * window - 1)]).alias("_h"))
    df = df.select("*", F.explode(F.array(*map(F.lit, range(window)))).alias("_j"))
    h = lambda k: F.get("_h", F.col("_j") + k)
    inner = F.least(*[h(k) for k in range(1, window)]) if window > 2 else h(1) if window > 1 else F.lit(None).cast("long")
    pos = F.col("_at") + F.col("_j")
    df = df.select(*keys, *[F.when(pos == 0, F.col(c)).alias(c) for c in extra], "_last", "_runs", pos.alias("_pos"), "_h", inner.alias("_inner"), h(0).alias("_left"), h(window).alias("_right"))
    # a text with one run may have less than a run's hashes
    least = F.when(F.col("_runs") == 1, F.array_min(F.slice("_h", F.lit(2), F.col("_last") + 1))).otherwise(F.least("_inner", "_right"))
    df = df.select(*keys, *extra, "_runs", "_pos", least.alias("_min"), F.least("_inner", "_left").alias("_before"))
    keep = (F.col("_pos") == 0) | ((F.col("_pos") < F.col("_runs")) & (F.col("_min") != F.col("_before")))
    # exploded, not filtered: a filter would be moved before the minima, which would then be worked out twice
    df = df.select(*keys, *extra, "_runs", F.explode(F.when(keep, F.array("_min")).otherwise(F.array().cast("array<long>"))).alias("_min"))
    place = F.shiftleft(F.lit(MAX_POS).cast("long") - F.col("_min").bitwiseAND(F.lit(MAX_POS)), 32)
    return df.select(*keys, *extra, F.when(F.col("_runs") > 0, place.bitwiseOR(F.shiftright("_min", 32).bitwiseAND(F.lit(LOW)))).alias("_picked"))


def gathered() -> Column:
    """The picked numbers of a text, in the order of their positions: position in the upper half, hash in the lower."""
    return F.sort_array(F.collect_list("_picked"))


def fingerprints(df: DataFrame, keys: list[str], text: str, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """(keys, fingerprint) of every text; the keys tell rows apart."""
    return selected(df, keys, text, gram, window).groupBy(*keys).agg(gathered().alias("fingerprint"))


def _hash(x: Column) -> Column:
    return F.shiftright(F.shiftleft(x, 32), 32).cast("int")


def grams(fingerprint: Column) -> Column:
    """The distinct hashes, without positions."""
    return F.array_distinct(F.transform(fingerprint, _hash))


def positions(fingerprint: Column) -> Column:
    """(hash, position) of what is selected."""
    return F.transform(fingerprint, lambda x: F.struct(_hash(x).alias("hash"), F.shiftright(x, 32).cast("int").alias("pos")))


def places(fingerprint: Column) -> Column:
    """The positions alone, as text."""
    return F.array_join(F.transform(fingerprint, lambda x: F.shiftright(x, 32).cast("string")), ",")


def digest(fingerprint: Column) -> Column:
    """SHA-256 of hashes and positions."""
    return F.sha2(F.array_join(F.transform(fingerprint, lambda x: x.cast("string")), ",").cast("binary"), 256)


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sets of hashes; two empty ones are alike."""
    common = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(common / (F.size(a) + F.size(b) - common))


def with_next(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, text, next_text, own): texts beside the next one by descending doc_id, after the last the first.

    Texts are dealt into ranges of doc_id by fixed bounds and shuffled once; the first text of a range also goes, as a
    visitor, to the range before it, so that the last text there has its neighbour.
    """
    parts = max(16, 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cuts = bounds(docs.select(doc_id), doc_id, min(parts, 1024))
    own = docs.select(F.col(doc_id).alias("_id"), F.coalesce(text, F.lit("")).alias("_text")).withColumns({"_range": range_of(F.col("_id"), cuts), "_tie": F.xxhash64("_text")})
    heads = [(r[0], r[1]["_id"], r[1]["_tie"]) for r in own.groupBy("_range").agg(F.max(F.struct("_id", "_tie")).alias("head")).collect()]  # a row for each range
    heads.sort()
    target = [(r, i, t, heads[(k + 1) % len(heads)][0]) for k, (r, i, t) in enumerate(heads)]
    fields = [StructField("_r", IntegerType()), StructField("_head_id", own.schema["_id"].dataType), StructField("_head_tie", LongType()), StructField("_to", IntegerType())]
    heads = docs.sparkSession.createDataFrame(target, StructType(fields))
    placed = own.join(F.broadcast(heads), F.col("_range") == F.col("_r"))
    here, there = F.struct(F.col("_range").alias("at"), F.lit(False).alias("visits")), F.struct(F.col("_to").alias("at"), F.lit(True).alias("visits"))
    head = F.col("_id").eqNullSafe(F.col("_head_id")) & (F.col("_tie") == F.col("_head_tie"))
    return placed.select("_id", "_text", "_tie", F.explode(F.when(head, F.array(here, there)).otherwise(F.array(here))).alias("_p")).select("_id", "_text", "_tie", "_p.at", "_p.visits").repartition("at")


def compare(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited form (its last half replaced by as much of the beginning of the next text), with
    likenesses. The rows of a range of ids stay together from the texts to the result: there is one shuffle."""
    order = Window.partitionBy("at").orderBy("visits", F.col("_id").desc_nulls_last(), F.col("_tie").desc())
    rows = with_next(docs, doc_id, text).withColumns({"_row": F.row_number().over(order), "_next": F.lead("_text").over(order)})
    half = F.floor(F.length("_text") / 2).cast("int")
    edited = F.concat(F.left("_text", F.length("_text") - half), F.left("_next", half))
    rows = rows.select("at", "_row", "_id", "visits", "_text", F.when(~F.col("visits"), edited).alias("_edited"))
    about = F.struct("_id", "visits", F.length("_text").cast("long").alias("n_chars"), F.sha2(F.col("_edited").cast("binary"), 256).alias("edited_sha256"))
    own = F.struct(F.lit(0).alias("which"), F.col("_text").alias("t"), about.alias("about"))
    other = F.struct(F.lit(1).alias("which"), F.col("_edited").alias("t"), F.when(F.lit(False), about).alias("about"))
    texts = rows.select("at", "_row", F.explode(F.when(F.col("visits"), F.array(own)).otherwise(F.array(own, other))).alias("x")).select("at", "_row", "x.which", "x.t", "x.about")
    prints = selected(texts, ["at", "_row", "which"], "t", once="about").groupBy("at", "_row", "which").agg(gathered().alias("p"), F.first("about", ignorenulls=True).alias("about"))
    pairs = prints.groupBy("at", "_row").agg(*[F.first(F.when(F.col("which") == k, F.col("p")), ignorenulls=True).alias(name) for k, name in ((0, "_print"), (1, "_edited_print"))], F.first("about", ignorenulls=True).alias("about"))
    pairs = pairs.withColumn("_grams", grams(F.col("_print"))).withColumn("_next_grams", F.lead("_grams").over(Window.partitionBy("at").orderBy("_row"))).where(~F.col("about.visits"))
    return pairs.withColumn("_edited_grams", grams(F.col("_edited_print"))).select(
        F.col("about._id").alias(doc_id), "about.n_chars", "about.edited_sha256", digest(F.col("_print")).alias("fingerprint"), digest(F.col("_edited_print")).alias("edited_fingerprint"),
        likeness(F.col("_grams"), F.col("_edited_grams")).alias("near_edited"), likeness(F.col("_grams"), F.col("_next_grams")).alias("near_next"), places(F.col("_print")).alias("positions"),
    )
