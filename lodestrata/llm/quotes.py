"""Chat formatting with quotation linking, in DataFrame operations only.

Lines that begin with > (each may have a space before or behind it) are quotes, as deep as they have such marks; runs of lines of
one depth are passages. Passages, and each of their paragraphs, lines and sentences, are hashed in a normal form (lower case,
white space as one space, no marks) and joined to the bodies of earlier messages of the conversation, and their paragraphs,
lines and sentences, hashed alike; their number is that of a text's line feeds and sentence ends. Sentences may run over lines,
so a quote may be wrapped anew. A message replies to
the latest message that its passages of depth 1 are found in. Conversations are put in the order of their reply trees:
a message, then the replies to it by turn, and so on; messages that quote nobody are roots, by turn. Bodies are written
without quotes that are found, as a line <|role|> and the text.

Only messages with a quote are cut into lines and joined; paths from the root grow by pointer doubling, so the rounds
go with the logarithm of the deepest thread. A conversation is put in order in blocks of roots (BLOCK turns each), whose
lengths are then added up, so a very long one isn't one task's work. It comes out as one row; one of more than PART_BYTES, which
no row should hold, as several, numbered by part, whose texts joined by line feeds are the whole.

Nulls: a null conv_id is a conversation of its own; null turns come first and have no earlier messages; a null text is
empty, a null role is written as an empty name. Empty texts stay as turns. Repeated rows stay, side by side. A quote that
is found nowhere counts as unresolved and stays in the text as it is, with its marks. Very long texts are read whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.llm.common import written

MARKS = r"^[ \t]?(?:>[ \t]?)+"
QUOTED = r"(?m)^[ \t]?>"
PARAGRAPH = r"\r?\n[ \t]*\r?\n"
SENTENCE = r"(?<=[.!?…。！？])"
PART_BYTES = 16 << 20  # of text in a row of a conversation; only longer conversations have several rows
BLOCK = 1024  # turns of roots that are put in order together


def normal(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))


def key(c: Column) -> Column:
    """128 bits of the SHA-256 of the normal form; null for what is empty in it."""
    n = normal(c)
    return F.when(n != "", F.left(F.sha2(n.cast("binary"), 256), F.lit(32)))


def depth(line: Column) -> Column:
    marks = F.regexp_extract(line, MARKS, 0)
    return F.length(marks) - F.length(F.replace(marks, F.lit(">"), F.lit("")))


def bodies(messages: DataFrame) -> DataFrame:
    """Adds body (the text without quoted lines and blank lines around it) and quoting (whether there is a quote)."""
    lines = F.filter(F.split("text", r"\r?\n"), lambda x: ~x.rlike(MARKS))
    quoting = F.col("text").rlike(QUOTED)
    return messages.withColumns({"quoting": quoting, "body": F.when(quoting, F.regexp_replace(F.array_join(lines, "\n"), r"^\s+|\s+$", "")).otherwise(F.col("text"))})


def cut(messages: DataFrame) -> DataFrame:
    """(msg, conv_id, turn, line, raw, depth, run): the lines of messages with quotes; a run has lines of one depth."""
    lines = messages.where("quoting").dropDuplicates(["msg"]).select("msg", "conv_id", "turn", F.posexplode(F.split("text", r"\r?\n")).alias("line", "raw"))
    marked = lines.withColumn("depth", depth(F.col("raw")))
    at = Window.partitionBy("msg", "conv_id", "turn").orderBy("line")
    return marked.withColumn("new", (F.coalesce(F.lag("depth").over(at), F.lit(-1)) != F.col("depth")).cast("int")).withColumn("run", F.sum("new").over(at)).drop("new")


def passages(messages: DataFrame) -> DataFrame:
    """(msg, conv_id, turn, depth, run, passage): the quoted passages of messages."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", F.regexp_replace("raw", MARKS, "").alias("t")))), lambda x: x["t"]), "\n")
    return cut(messages).where("depth > 0").groupBy("msg", "conv_id", "turn", "depth", "run").agg(text.alias("passage"))


def units(c: Column) -> Column:
    """Rank and key of a text, its paragraphs and lines, and its sentences by paragraph and by line."""
    paragraphs, lines = F.split(c, PARAGRAPH), F.split(c, r"\r?\n")
    parts = [(0, F.array(c)), (1, paragraphs), (1, lines), (2, F.flatten(F.transform(paragraphs, lambda x: F.split(x, SENTENCE)))), (2, F.flatten(F.transform(lines, lambda x: F.split(x, SENTENCE))))]
    return F.array_distinct(F.concat(*[F.transform(p, lambda x, rank=rank: F.struct(F.lit(rank).alias("rank"), key(x).alias("k"))) for rank, p in parts]))


def unresolved(messages: DataFrame, found: DataFrame) -> DataFrame:
    """(msg, body): texts without blank lines around and without the passages that are found."""
    resolved = found.where("source IS NOT NULL OR NOT said").select("msg", "run")
    lines = cut(messages).join(resolved, ["msg", "run"], "left_anti")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "raw"))), lambda x: x["raw"]), "\n")
    return lines.groupBy("msg").agg(F.regexp_replace(text, r"^\s+|\s+$", "").alias("body"))


def links(messages: DataFrame) -> DataFrame:
    """(msg, conv_id, turn, depth, run, source): source is the latest earlier turn that a passage, or else a paragraph
    or line of it, or else a sentence, is from; null if there is none. Also said: whether the passage has any text."""
    p = written(passages(messages))
    asked = p.select("*", F.explode(units(F.col("passage"))).alias("u")).select("msg", "conv_id", "turn", "depth", "run", "u.rank", "u.k").where("k IS NOT NULL").dropDuplicates()
    convs = p.select("conv_id").distinct()
    own = messages.join(convs, messages["conv_id"].eqNullSafe(convs["conv_id"]), "left_semi").select("conv_id", "turn", F.explode(units(F.col("body"))["k"]).alias("k")).where("k IS NOT NULL").distinct()
    own = own.select(F.col("conv_id").alias("c2"), F.col("turn").alias("t2"), F.col("k").alias("k2"))
    hits = asked.join(own, (asked["k"] == own["k2"]) & asked["conv_id"].eqNullSafe(own["c2"]) & (own["t2"] < asked["turn"]))
    best = hits.groupBy("msg", "conv_id", "turn", "depth", "run").agg(F.max(F.struct(-F.col("rank"), "t2")).alias("b")).select(F.col("msg").alias("m2"), F.col("depth").alias("d2"), F.col("run").alias("r2"), F.col("b.t2").alias("source"))
    return p.withColumn("said", normal(F.col("passage")) != "").drop("passage").join(best, (p["msg"] == best["m2"]) & (p["depth"] == best["d2"]) & (p["run"] == best["r2"]), "left").drop("m2", "d2", "r2")


def thread(messages: DataFrame) -> DataFrame:
    """Messages with n_quotes, n_linked, reply_to and path (the turns from the root of the reply tree)."""
    m = messages.select(F.col("conv_id"), F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    m = bodies(m.withColumn("msg", F.xxhash64(F.struct("conv_id", "turn", "role", "text"))))
    plain = m.withColumns({"n_quotes": F.lit(0).cast("long"), "n_linked": F.lit(0).cast("long"), "reply_to": F.lit(None).cast("long"), "path": F.array(F.coalesce("turn", F.lit(-1)))})
    if m.where("quoting").isEmpty():
        return plain.drop("quoting", "msg")
    found = written(links(m))
    per = found.groupBy("msg").agg(F.count(F.lit(1)).alias("n_quotes"), F.count("source").alias("n_linked"), F.max(F.when(F.col("depth") == 1, F.col("source"))).alias("reply_to")).withColumnRenamed("msg", "m2")
    base = m.join(per, m["msg"] == per["m2"], "left").drop("m2").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_quotes", "n_linked")})
    rest = unresolved(m.join(found.where("source IS NULL AND said").select("msg").distinct(), "msg", "left_semi"), found).select(F.col("msg").alias("m2"), F.col("body").alias("rest"))
    base = base.join(rest, base["msg"] == rest["m2"], "left").withColumn("body", F.coalesce("rest", "body")).drop("m2", "rest")
    # one pointer for each turn with a reply; a turn that isn't among them is a root
    state = written(base.where("reply_to IS NOT NULL").groupBy("conv_id", "turn").agg(F.max("reply_to").alias("up")).select("conv_id", "turn", "up", F.array("turn").alias("path")))
    while True:
        nxt = state.select(F.col("conv_id").alias("c2"), F.col("turn").alias("t2"), F.col("up").alias("up2"), F.col("path").alias("p2"))
        joined = state.join(nxt, state["conv_id"].eqNullSafe(nxt["c2"]) & (state["up"] == nxt["t2"]), "left")
        moved = joined.where("t2 IS NOT NULL")
        state = written(joined.select("conv_id", "turn", F.when(F.col("t2").isNull(), F.col("up")).otherwise(F.col("up2")).alias("up"), F.when(F.col("t2").isNull(), F.col("path")).otherwise(F.concat("p2", "path")).alias("path")))
        if moved.isEmpty():
            break
    paths = state.select(F.col("conv_id").alias("c2"), F.col("turn").alias("t2"), F.concat(F.array("up"), "path").alias("path"))
    return base.join(paths, base["conv_id"].eqNullSafe(paths["c2"]) & (base["turn"] == paths["t2"]), "left").withColumn("path", F.coalesce("path", F.array(F.coalesce("turn", F.lit(-1))))).drop("c2", "t2", "quoting", "msg")


def conversations(messages: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """(conv_id, part, n_turns, n_quotes, n_linked, text): conversations in reply order without quotes."""
    turn = F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n"), F.col("body"))
    t = thread(messages).withColumns({"_block": F.floor(F.col("path")[0] / BLOCK), "_turn": turn, "_bytes": F.octet_length(turn).cast("long") + 1})
    order = Window.partitionBy("conv_id", "_block").orderBy("path", F.col("turn").asc_nulls_first(), "role", "text")
    t = t.withColumns({"_pos": F.row_number().over(order), "_to": F.sum("_bytes").over(order.rowsBetween(Window.unboundedPreceding, 0))})
    # a row for each block: BLOCK roots and more
    blocks = block_starts(t).select(F.col("conv_id").alias("_c"), F.col("_block").alias("_b"), "_before")
    placed = t.join(blocks, t["conv_id"].eqNullSafe(blocks["_c"]) & (t["_block"] == blocks["_b"]))
    placed = placed.withColumn("part", F.floor((F.col("_before") + F.col("_to") - F.col("_bytes")) / part_bytes).cast("int"))
    out = placed.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n_turns"), F.sum("n_quotes").alias("n_quotes"), F.sum("n_linked").alias("n_linked"), F.array_sort(F.collect_list(F.struct("_block", "_pos", "_turn"))).alias("turns"))
    return out.select("conv_id", "part", "n_turns", "n_quotes", "n_linked", F.array_join(F.transform("turns", lambda x: x["_turn"]), "\n").alias("text"))


def block_starts(t: DataFrame) -> DataFrame:
    """(conv_id, _block, _before): the bytes of a conversation before each of its blocks."""
    sizes = t.groupBy("conv_id", "_block").agg(F.sum("_bytes").alias("_n"))
    before = Window.partitionBy("conv_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
