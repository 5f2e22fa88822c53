"""Quotation linking: conversations in reply order without quotes.

A message's lines carry a quote level, the number of leading ``>``. Runs of
lines of one level are passages; their text, normalised (markers off, lower
case, single spaces), is hashed and joined to the own text of the
conversation's messages. Both sides are taken whole, by paragraph and by line;
the largest part that is found, and of one kind the longest, tells the
original. The original of a passage is the earliest message of its conversation that holds it and comes
before the quoting one; failing that, the earliest message of any other
conversation. A message replies to the latest original it quotes at level one
in its own conversation, and to the message before it where it quotes none. Depth is
the number of replies from the start of the thread, found by pointer jumping.
The order of a conversation is that of the turns, in which every reply comes after
what it answers.

Originals are reduced to one row per (conversation, hash) before the join, so
a line or first turn that a third of all messages share is one row, and the
quoting side is split by adaptive skew joins. Ranks are running totals over
a range partitioning, so a conversation of any length is never one task's group.

Defined cases: null text counts as empty; a message without quotes keeps its
text as it is; one of quotes alone becomes empty. A line that only announces a
quote ("... wrote:") right before one goes with it. Rows that share
conversation and turn are one place in the tree, and each keeps its text; a
null turn comes last, a null conversation is one of its own. An empty table
gives an empty result. Other columns play no part and may have any name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabforge.llm.common import materialize, running_totals

MARK = re.compile(r"[ \t]*((?:>[ \t]*)+)(.*)", re.S)
ANNOUNCE = re.compile(r".*\b(?:wrote|writes|said|schrieb|a écrit|escribió)\s*:\s*$")


def levels(text: str) -> list[tuple[int, str]]:
    """(quote level, line without its markers) of each line."""
    out = []
    for line in text.split("\n"):
        m = MARK.match(line)
        out.append((m.group(1).count(">"), m.group(2)) if m else (0, line))
    return out


def normalised(text: str) -> str:
    return " ".join(text.lower().split())


def key(text: str) -> str | None:
    import hashlib

    text = normalised(text)
    return hashlib.sha256(text.encode()).hexdigest() if text else None


def parse(text: str | None):
    """(own text, [(level, passage)]) of one message."""
    text = text or ""
    if ">" not in text:
        return text, []
    lines = levels(text)
    if all(level == 0 for level, _ in lines):
        return text, []
    own, passages = [], []
    for i, (level, body) in enumerate(lines):
        if level:
            if passages and i and lines[i - 1][0] == level:
                passages[-1][1].append(body)
            else:
                passages.append((level, [body]))
        elif not (i + 1 < len(lines) and lines[i + 1][0] and ANNOUNCE.match(body)):
            own.append(body)
    return "\n".join(own).strip("\n"), [(level, "\n".join(body)) for level, body in passages]


def units(own: str) -> list[str]:
    """The keys under which a message's own text can be quoted."""
    parts = [own, *re.split(r"\n[ \t]*\n", own), *own.split("\n")]
    return [k for k in dict.fromkeys(map(key, parts)) if k]


def asked(passage: str) -> list[str]:
    """The keys of a passage, best first: all of it, its paragraphs and its lines, the longest of each first."""
    parts = [passage]
    for pieces in (re.split(r"\n[ \t]*\n", passage), passage.split("\n")):
        parts += sorted(pieces, key=lambda piece: -len(normalised(piece)))
    return [k for k in dict.fromkeys(map(key, parts)) if k]


def _parsed(messages: DataFrame) -> DataFrame:
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        quote = pa.struct([("level", pa.int32()), ("keys", pa.list_(pa.string()))])
        for batch in batches:
            found = [parse(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), batch.column("turn"), batch.column("role"), pa.array([f[0] for f in found], pa.string()),
                 pa.array([units(f[0]) for f in found], pa.list_(pa.string())),
                 pa.array([[{"level": lv, "keys": asked(p)} for lv, p in f[1]] for f in found], pa.list_(quote))],
                names=["conv_id", "turn", "role", "text", "units", "quotes"])

    return messages.mapInArrow(run, "conv_id long, turn long, role string, text string, units array<string>, "
                                    "quotes array<struct<level:int,keys:array<string>>>")


def quote_links(parsed: DataFrame) -> DataFrame:
    """conv_id, turn, quote (number), level, from_conv, from_turn of every passage whose original was found."""
    quotes = (parsed.filter(F.size("quotes") > 0)
              .select("conv_id", "turn", F.posexplode("quotes").alias("quote", "q"))
              .select("conv_id", "turn", "quote", "q.level", F.posexplode("q.keys").alias("nth", "key")))
    # only keys that some passage asks for, one row per conversation and key
    wanted = quotes.select("key").distinct()
    held = (parsed.select("conv_id", "turn", F.explode("units").alias("key")).join(wanted, "key", "left_semi")
            .groupBy("conv_id", "key").agg(F.min("turn").alias("from_turn")))
    # the two smallest conversations of a key: one of them is not the quoting one;
    # the limit on the row number is applied before the shuffle as well
    nth = F.row_number().over(Window.partitionBy("key").orderBy("conv_id"))
    first = (held.withColumn("n", nth).filter(F.col("n") <= 2).withColumn("at", F.struct("conv_id", "from_turn"))
             .groupBy("key").agg(F.min("at").alias("o"), F.max("at").alias("p")))
    here = held.select(F.col("conv_id").alias("o_conv"), F.col("key").alias("o_key"), "from_turn")
    found = quotes.join(here, F.col("conv_id").eqNullSafe(F.col("o_conv")) & (F.col("key") == F.col("o_key"))
                        # a null turn comes last, after every other
                        & ((F.col("from_turn") < F.col("turn")) | (F.col("turn").isNull() & F.col("from_turn").isNotNull())), "left")
    found = found.join(first.select(F.col("key").alias("f_key"), "o", "p"), F.col("key") == F.col("f_key"), "left")
    found = found.withColumn("o", F.when(~F.col("o.conv_id").eqNullSafe(F.col("conv_id")), F.col("o")).otherwise(F.col("p")))
    elsewhere = F.col("o").isNotNull() & ~F.col("o.conv_id").eqNullSafe(F.col("conv_id"))
    found = found.select(
        "conv_id", "turn", "quote", "level",
        F.when(F.col("from_turn").isNotNull(), F.struct(F.lit(0).alias("far"), "nth", F.col("conv_id").alias("c"), F.col("from_turn").alias("t")))
        .when(elsewhere, F.struct(F.lit(1).alias("far"), "nth", F.col("o.conv_id").alias("c"), F.col("o.from_turn").alias("t"))).alias("at"))
    return (found.filter("at IS NOT NULL").groupBy("conv_id", "turn", "quote").agg(F.max("level").alias("level"), F.min("at").alias("at"))
            .select("conv_id", "turn", "quote", "level", F.col("at.c").alias("from_conv"), F.col("at.t").alias("from_turn")))


def reply_order(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, position, reply_to, depth, n_quotes, n_linked, text
    per row of ``messages``."""
    parsed = materialize(_parsed(messages.select(F.col("conv_id").cast("long").alias("conv_id"),
                                                 F.col("turn").cast("long").alias("turn"),
                                                 F.col("role").cast("string").alias("role"), "text")), "quotes-parsed")
    links = materialize(quote_links(parsed), "quotes-links")
    nodes = parsed.select("conv_id", "turn").distinct().withColumn("one", F.lit(1).cast("long"))
    ranked = materialize(running_totals(materialize(nodes, "quotes-nodes"), ["conv_id", "turn"], ["one"], "quotes-order"),
                         "quotes-ranked")
    start = ranked.groupBy("conv_id").agg(F.min("one_before").alias("start")).select(F.col("conv_id").alias("s_conv"), "start")
    # a node's number is global, so pointers are single integers
    nodes = ranked.join(start, F.col("conv_id").eqNullSafe(F.col("s_conv"))).select(
        "conv_id", "turn", F.col("one_before").alias("node"), "start")
    answers = (links.filter(F.col("level") == 1).filter(F.col("from_conv").eqNullSafe(F.col("conv_id")))
               .groupBy("conv_id", "turn").agg(F.max("from_turn").alias("reply"))
               .toDF("a_conv", "a_turn", "reply"))
    nodes = nodes.join(answers, F.col("conv_id").eqNullSafe(F.col("a_conv")) & F.col("turn").eqNullSafe(F.col("a_turn")), "left")
    by_turn = ranked.select(F.col("conv_id").alias("p_conv"), F.col("turn").alias("p_turn"), F.col("one_before").alias("p_node"))
    nodes = nodes.join(by_turn, F.col("conv_id").eqNullSafe(F.col("p_conv")) & (F.col("reply") == F.col("p_turn")), "left")
    nodes = materialize(nodes.select("conv_id", "turn", "node", "start", F.when(F.col("node") > F.col("start"),
                        F.coalesce("p_node", F.col("node") - 1)).alias("parent")), "quotes-tree")
    # depth: each round doubles the reach of the pointers that have not arrived
    jump = materialize(nodes.select("node", F.col("parent").alias("up"), F.when(F.col("parent").isNull(), 0).otherwise(1)
                                    .cast("long").alias("depth")), "quotes-jump")
    arrived, pending = jump.filter("up IS NULL"), jump.filter("up IS NOT NULL")
    while pending.limit(1).count():
        over = arrived.unionByName(pending).select(F.col("node").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"))
        moved = materialize(pending.join(over, "up").select(
            "node", F.col("next").alias("up"), (F.col("depth") + F.col("more")).alias("depth")), "quotes-jump")
        arrived, pending = arrived.unionByName(moved.filter("up IS NULL")), moved.filter("up IS NOT NULL")
    names = nodes.select(F.col("node").alias("parent"), F.col("turn").alias("reply_to"))
    tree = (nodes.join(arrived.select("node", "depth"), "node").join(names, "parent", "left")
            .select(F.col("conv_id").alias("t_conv"), F.col("turn").alias("t_turn"),
                    (F.col("node") - F.col("start")).alias("position"), "reply_to", "depth"))
    linked = links.groupBy("conv_id", "turn").agg(F.count("*").alias("n_linked")).toDF("l_conv", "l_turn", "n_linked")
    tree = tree.join(linked, F.col("t_conv").eqNullSafe(F.col("l_conv")) & F.col("t_turn").eqNullSafe(F.col("l_turn")), "left")
    return (parsed.join(tree, F.col("conv_id").eqNullSafe(F.col("t_conv")) & F.col("turn").eqNullSafe(F.col("t_turn")))
            .select("conv_id", "turn", "role", "position", "reply_to", "depth",
                    F.size("quotes").cast("long").alias("n_quotes"), F.coalesce("n_linked", F.lit(0)).alias("n_linked"), "text"))
