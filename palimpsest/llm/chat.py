"""Chat formatting by quotation linking.

A line's quote level is the number of ``>`` before its text. Lines of one level
that follow each other without a blank line are a block. A block is unwrapped,
normalised and cut into sentences, whose hashes are joined to the passages that
messages wrote themselves (their sentences, lines and paragraphs): in the same
conversation the earliest turn that has it, else the earliest message of any
other conversation, whatever its number. Where no sentence of a block is known,
its single lines are looked up. A message replies to the message that most of
its level-1 passages come from (ties: the later one). Conversations joined by
such links form one thread. Lines that introduce a quote are left out at every
level.

Within a thread, conversations stand by depth: a conversation comes after the
one that its first reply to another answers. Where such replies go in a circle,
the circle is opened at the conversation with the smallest number. Equal depths
go by number, and messages of a conversation by turn. Texts are given without
quotes and without the lines that introduce them.

Everything is keyed joins to unique keys; a frequent sentence, conversation or
thread is no group that a task collects, and places in a thread come from
running counts of a global order. No pattern repeats a group without a bound.

Cases: a null text counts as empty; an empty text or one of quotes alone gives
an empty message that still has its place; quotes of unknown text link to
nothing; a message never replies to itself or to a later turn of its own
conversation; very long texts and very deep quotes go the same way; repeated
rows stay, one after the other, and link alike; null ids sort first and make a
conversation of their own without links; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.operators.components import connected_components
from palimpsest.sources.tables import materialize

#: A quote mark before a line; the line that introduces a quote; where a sentence ends.
QUOTED = r"^[ \t>]*>[ \t]?"
INTRODUCES = r"(?i)(wrote|writes|schrieb|a écrit|escribió)[ \t]*:[ \t]*$"
SENTENCE_END = r"(?<=[.!?])\s+"
BLANK = r"\n\s*\n"


def levels(text: Column) -> Column:
    """The lines of a text: (level, line without its marks)."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n", -1)
    return F.transform(
        lines,
        lambda x: F.struct(
            F.length(F.regexp_replace(F.regexp_extract(x, QUOTED, 0), r"[^>]", "")).alias("level"),
            F.regexp_replace(x, QUOTED, "").alias("line"),
        ),
    )


def _introduces(parsed: Column, x: Column, i: Column) -> Column:
    """Whether a line announces the deeper quote that follows it, after a blank line at most."""
    after, then = F.get(parsed, i + 1), F.get(parsed, i + 2)
    follows = (after["level"] > x["level"]) | ((F.trim(after["line"]) == "") & (then["level"] > x["level"]))
    return x["line"].rlike(INTRODUCES) & F.coalesce(follows, F.lit(False))


def of_level(parsed: Column, level: Column) -> Column:
    """The lines of one level as a text; other lines are blank in it, so that they part blocks."""
    return F.array_join(F.transform(parsed, lambda x, i: F.when((x["level"] == level) & ~_introduces(parsed, x, i), x["line"]).otherwise(F.lit(""))), "\n")


def own_text(parsed: Column) -> Column:
    """The unquoted lines, less those that introduce a quote."""
    kept = F.filter(parsed, lambda x, i: (x["level"] == 0) & ~_introduces(parsed, x, i))
    return F.trim(F.array_join(F.transform(kept, lambda x: x["line"]), "\n"), F.lit(" \t\r\n"))


def _flat(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def _hashes(parts: Column) -> Column:
    return F.transform(F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: F.length(s) > 0), F.md5)


def sentences(block: Column) -> Column:
    """The hashes of a block's normalised sentences; line breaks are spaces."""
    return _hashes(F.split(_flat(block), SENTENCE_END, -1))


def lines(block: Column) -> Column:
    """The hashes of a block's normalised lines."""
    return _hashes(F.transform(F.split(block, "\n", -1), _flat))


def passages(text: Column) -> Column:
    """The hashes of a text's sentences, lines and paragraphs, once each."""
    blocks = F.split(text, BLANK, -1)
    return F.array_distinct(F.concat(F.flatten(F.transform(blocks, sentences)), lines(text), _hashes(F.transform(blocks, _flat))))


def parse(messages: DataFrame) -> DataFrame:
    rows = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), levels(F.col("text")).alias("lines"))
    deepest = F.coalesce(F.array_max(F.transform("lines", lambda x: x["level"])), F.lit(0))
    return rows.select("conv_id", "turn", "role", own_text(F.col("lines")).alias("text"), deepest.alias("levels"), F.when(deepest > 0, F.col("lines")).alias("quoted"))


def _quotes(ids: DataFrame) -> DataFrame:
    """(conv_id, turn, level, block, is_line, passage): each message's quoted sentences, and the lines that are none."""
    met = F.array_distinct(F.filter(F.transform("quoted", lambda x: x["level"]), lambda n: n > 0))
    deep = ids.where("levels > 0").select("conv_id", "turn", "quoted", F.explode(met).alias("level"))
    blocks = deep.select("conv_id", "turn", "level", F.posexplode(F.split(of_level(F.col("quoted"), F.col("level")), BLANK, -1)).alias("block", "said"))
    both = blocks.select("conv_id", "turn", "level", "block", sentences(F.col("said")).alias("s"), lines(F.col("said")).alias("l"))
    tagged = F.concat(F.transform("s", lambda h: F.struct(F.lit(False).alias("is_line"), h.alias("passage"))), F.transform(F.array_except("l", "s"), lambda h: F.struct(F.lit(True).alias("is_line"), h.alias("passage"))))
    return both.select("conv_id", "turn", "level", "block", F.explode(tagged).alias("x")).select("conv_id", "turn", "level", "block", "x.*")


def reply_links(parsed: DataFrame) -> DataFrame:
    """One row for each message with quotes: what it replies to, its quoted sentences, and how many are known (a block known by lines alone counts once)."""
    ids = parsed.where("conv_id is not null and turn is not null")
    quotes = materialize(_quotes(ids), "quotes")
    wanted = quotes.select("passage").distinct()
    own = ids.select("conv_id", "turn", F.explode(passages(F.col("text"))).alias("passage")).join(wanted, "passage", "left_semi")
    own = materialize(own.groupBy("conv_id", "passage").agg(F.min("turn").alias("first_turn")), "own")
    place = F.struct(F.col("conv_id").alias("conv"), F.col("first_turn").alias("turn"))
    first = own.groupBy("passage").agg(F.min(place).alias("first"))
    # for a conversation that has the earliest itself, the earliest of the others
    second = own.join(first, "passage").where("conv_id <> first.conv").groupBy("passage", "first").agg(F.min(place).alias("second"))
    anywhere = first.join(second.select("passage", "second"), "passage", "left")
    found = quotes.join(own, ["conv_id", "passage"], "left").join(anywhere, "passage", "left")
    here = F.when(F.col("first_turn") < F.col("turn"), F.struct(F.col("conv_id").alias("conv"), F.col("first_turn").alias("turn")))
    found = found.withColumn("to", F.coalesce(here, F.when(F.col("first.conv") != F.col("conv_id"), F.col("first")), F.col("second")))
    # the passages of one block stand together: they are part of one text
    known = F.count_if(~F.col("is_line") & F.col("to").isNotNull()).over(Window.partitionBy("conv_id", "turn", "level", "block"))
    found = found.withColumn("known", known).where("not is_line or (known = 0 and to is not null)")
    place_in_block = F.row_number().over(Window.partitionBy("conv_id", "turn", "level", "block").orderBy(F.desc("is_line"), "passage"))
    found = found.withColumn("linked", F.when(F.col("is_line"), (place_in_block == 1).cast("int")).otherwise(F.col("to").isNotNull().cast("int")))
    votes = found.groupBy("conv_id", "turn", "to").agg(F.count_if(F.col("level") == 1).alias("votes"), F.count_if(~F.col("is_line")).alias("n"), F.sum("linked").alias("linked"))
    best = F.max(F.when(F.col("to").isNotNull() & (F.col("votes") > 0), F.struct("votes", "to")))
    return votes.groupBy("conv_id", "turn").agg(best["to"].alias("to"), F.sum("n").alias("n_quoted"), F.sum("linked").alias("n_linked"))


def depths(parents: DataFrame) -> DataFrame:
    """(conv, depth) of conversations with a parent, by doubling pointers; a circle is opened at its smallest member.

    ``parents`` has one row (conv, parent) a conversation.
    """
    parents = materialize(parents, "parents")
    count = parents.count()
    while True:
        p, reach = materialize(parents.select("conv", F.col("parent").alias("to"), F.lit(1).cast("long").alias("depth"), F.col("parent").alias("least")), "pointers"), 1
        while reach <= count and not p.where("to is not null").isEmpty():
            q = p.select(F.col("conv").alias("at"), F.col("to").alias("next"), F.col("depth").alias("more"), F.col("least").alias("lower"))
            both = p.join(q, p["to"] == q["at"], "left")
            p, reach = materialize(both.select("conv", F.col("next").alias("to"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.least("least", F.coalesce("lower", "least")).alias("least")), "pointers"), 2 * reach
        opened = p.where("to is not null and least = conv").select("conv")
        if opened.isEmpty():
            return p.select("conv", "depth")
        parents = materialize(parents.join(opened, "conv", "left_anti"), "parents")


def threads(messages: DataFrame) -> DataFrame:
    """One row a message: thread_id, position, role, text, message, levels, reply_conv, reply_turn, n_quoted, n_linked."""
    parsed = materialize(parse(messages), "parsed")
    links = materialize(reply_links(parsed), "links")
    crossing = links.where("to.conv <> conv_id")
    merged = connected_components(crossing.select(F.col("conv_id").alias("a"), F.col("to.conv").alias("b"))).select(F.col("vertex").alias("member"), F.col("component").alias("joined"))
    parents = crossing.groupBy(F.col("conv_id").alias("conv")).agg(F.min(F.struct("turn", F.col("to.conv").alias("parent")))["parent"].alias("parent"))
    rows = parsed.drop("quoted").join(links, ["conv_id", "turn"], "left")
    rows = rows.join(merged, rows["conv_id"] == merged["member"], "left").withColumn("thread_id", F.coalesce("joined", "conv_id")).drop("member", "joined")
    deep = depths(parents)
    rows = rows.join(deep, rows["conv_id"] == deep["conv"], "left").drop("conv").withColumn("depth", F.coalesce("depth", F.lit(0)))
    spark = messages.sparkSession
    order = ["thread_id", "depth", "conv_id", "turn"]
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    lined = rows.repartitionByRange(parts, *order, F.xxhash64("role", "text")).sortWithinPartitions(*order, "role", "text")
    lined = materialize(lined.withColumn("place", F.monotonically_increasing_id()), "lined")
    part, row = F.shiftright("place", 33), F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    ahead, total = [], 0
    for p, n in sorted((r["p"], r["n"]) for r in lined.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()):
        ahead.append((p, total))
        total += n
    counts = spark.createDataFrame(ahead, "p long, ahead long")  # one row a partition
    numbered = lined.withColumn("p", part).join(F.broadcast(counts), "p").withColumn("place", F.col("ahead") + row)
    begins = numbered.groupBy(F.col("thread_id").alias("of")).agg(F.min("place").alias("begin"))
    out = numbered.join(begins, numbered["thread_id"].eqNullSafe(begins["of"]))
    role = F.coalesce("role", F.lit("user"))
    return out.select(
        "conv_id", "turn", "thread_id", (F.col("place") - F.col("begin")).alias("position"), "role", "text",
        F.concat(F.lit("<|"), role, F.lit("|>\n"), F.col("text"), F.lit("\n")).alias("message"), F.col("levels").cast("int").alias("levels"),
        F.col("to.conv").alias("reply_conv"), F.col("to.turn").alias("reply_turn"), F.coalesce("n_quoted", F.lit(0)).cast("long").alias("n_quoted"), F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
    )


def quoting(messages: DataFrame) -> DataFrame:
    """Messages that quote the turn before them, and turns 0 that of the conversation with the next number; for tables without quotes."""
    rows = messages.select("conv_id", "turn", "role", "text")
    texts = rows.groupBy("conv_id", "turn").agg(F.min("text").alias("said"))
    before = texts.select(F.col("conv_id").alias("c"), (F.col("turn") + 1).alias("t"), "said")
    across = texts.where("turn = 0").select((F.col("conv_id") - 1).alias("c"), F.col("turn").alias("t"), "said")
    both = rows.join(before.unionByName(across), (F.col("conv_id") == F.col("c")) & (F.col("turn") == F.col("t")), "left")
    marked = F.concat(F.lit("On Monday they wrote:\n> "), F.replace("said", F.lit("\n"), F.lit("\n> ")), F.lit("\n"), F.coalesce("text", F.lit("")))
    return both.select("conv_id", "turn", "role", F.when(F.col("said").isNull(), F.col("text")).otherwise(marked).alias("text"))
