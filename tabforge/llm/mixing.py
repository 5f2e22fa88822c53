"""Mixing sources to target weights by a low-discrepancy slot schedule.

Each source's documents are put in a seeded shuffled order, anew in every
epoch, and the resulting word stream is cut into blocks of equally many words.
The mix is a sequence of slots, one block each. Slot numbers are mapped
through the cumulative slot quotas of the sources, and a slot's place in the
mix is its van der Corput point (its number with the bits reversed), so every
stretch of the mix holds the sources close to their weights and every
source gets exactly its quota. Slots are ranked within their source and the
rank names the block that fills the slot.

A hot source is no hot task: positions in the stream and ranks of the slots
are running totals over one range partitioning of all rows, slots are made
from bounded pieces, and the block join is on (source, block).

Defined cases: null text has no words; documents without words are returned
with 0 taken words. Null source is a source of its own, last in order. Rows
that agree in everything are separate documents, told apart by a copy
number. A null ``doc_id`` is an id like any other. With no words at all
every target is 0. An empty table gives an empty result. Columns other than
id, text and source play no part and may have any name.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabforge.llm.common import free_prefix, materialize, n_words, running_totals

CYCLE = (5.0, 2.0, 1.0)
MAX_REPEATS = 3
BLOCK_WORDS = 1024
PIECE = 1 << 16
KEY = ["src", "doc_id", "size", "text_key", "copy"]


def shuffle_key(seed: int, epoch, doc_id):
    """60 bits of MD5: a seeded order of a source's documents, anew in every epoch."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), epoch.cast("string"), doc_id.cast("string")))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, cycle=CYCLE, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """source, src (rank), source_size, target from one row per source.

    Targets are weight shares of all words, held to ``max_repeats`` times
    the source's size, the excess shared anew by weight. With sources sorted
    by cap per weight the held ones come first, so one pass of running sums
    finds the common level of the others. The windows read one row per
    source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    s = sizes.withColumn("src", F.row_number().over(by_name) - 1)
    weights = F.element_at(F.array(*[F.lit(float(w)) for w in cycle]), F.col("src") % len(cycle) + 1)
    s = s.withColumns({"w": weights, "cap": F.col("source_size") * max_repeats})
    order = Window.orderBy(F.col("cap") / F.col("w"), "src")
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumns({
        "level": (F.sum("source_size").over(everything)
                  - F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        / F.sum("w").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))})
    # the level of the first source that is not held
    free = F.min(F.when(F.col("cap") > F.col("level") * F.col("w"), F.struct(F.col("cap") / F.col("w"), "src", "level")))
    s = s.withColumn("common", free.over(everything)["level"])
    target = F.when(F.col("common").isNull(), F.col("cap").cast("double")).otherwise(
        F.least(F.col("cap").cast("double"), F.col("common") * F.col("w")))
    return s.select("source", "src", "source_size", F.round(target, 6).alias("target"))


def _reversed_bits(x, bits: int):
    return F.conv(F.reverse(F.lpad(F.bin(x), bits, "0")), 2, 10).cast("long")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        cycle=CYCLE, max_repeats: int = MAX_REPEATS, block_words: int = BLOCK_WORDS, seed: int = 7):
    """The documents with their targets, and the mix.

    Returns ``(rows, segments)``. ``rows``: src, doc_id, size, text_key,
    copy, source, source_size, target. ``segments``: those keys, epoch, slot
    (place in the mix, ascending, with gaps), block, first (word of the
    document, from 0) and taken (words).
    """
    thin = docs.select(F.col(source_col).alias("source"), F.col(id_col).alias("doc_id"), n_words(F.col(text_col)).alias("size"),
                       F.xxhash64(text_col).alias("text_key"))
    thin = materialize(thin.groupBy("source", "doc_id", "size", "text_key").count(), "mix-rows")
    sizes = thin.groupBy("source").agg(F.sum(F.col("size") * F.col("count")).alias("source_size"))
    sources = materialize(source_targets(sizes, cycle, max_repeats).withColumns({
        "words": F.round("target").cast("long"),
        "epochs": F.when(F.col("source_size") > 0,
                         F.ceil(F.round("target") / F.col("source_size"))).otherwise(0).cast("int"),
        "quota": F.ceil(F.round("target") / block_words)}), "mix-sources")

    rows = thin.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("count")))).drop("count")
    per_source = sources.drop("quota").withColumnRenamed("source", "_source")
    rows = materialize(rows.join(per_source, F.col("source").eqNullSafe(F.col("_source")))
                       .select("source", *KEY, "source_size", "target", "words", "epochs"), "mix-documents")

    # places of the documents in their source's stream, epoch after epoch
    stream = (rows.filter("size > 0 AND epochs > 0")
              .select(*KEY, "words", F.explode(F.sequence(F.lit(0), F.col("epochs") - 1)).alias("epoch"))
              .withColumn("order", shuffle_key(seed, F.col("epoch"), F.col("doc_id"))))
    stream = running_totals(stream, ["src", "epoch", "order", *KEY[1:]], ["size"], "mix-stream")
    begins = stream.groupBy("src").agg(F.min("size_before").alias("begin"))
    stream = stream.join(begins, "src").withColumn("at", F.col("size_before") - F.col("begin"))
    end = F.least(F.col("at") + F.col("size"), F.col("words"))
    stream = (stream.filter("at < words")
              .withColumn("block", F.explode(F.sequence(F.floor(F.col("at") / block_words),
                                                        F.floor((end - 1) / block_words))))
              .withColumn("from", F.greatest(F.col("at"), F.col("block") * block_words))
              .select(*KEY, "epoch", "block", (F.col("from") - F.col("at")).alias("first"),
                      (F.least(end, (F.col("block") + 1) * block_words) - F.col("from")).alias("taken")))

    segments = stream.join(slots(sources), ["src", "block"])
    return rows.drop("words", "epochs"), segments


def slots(sources: DataFrame) -> DataFrame:
    """(src, block, slot): each source's quota of slots, ranked in mix order."""
    before = Window.orderBy("src").rowsBetween(Window.unboundedPreceding, -1)
    spans = sources.select("src", "quota", F.coalesce(F.sum("quota").over(before), F.lit(0)).alias("offset"))
    total = sources.agg(F.sum("quota")).first()[0] or 0
    bits = max(1, math.ceil(math.log2(total)) if total > 1 else 1)
    pieces = (spans.filter("quota > 0")
              .select("src", F.explode(F.sequence(F.col("offset"), F.col("offset") + F.col("quota") - 1,
                                                  F.lit(PIECE).cast("long"))).alias("lo"),
                      (F.col("offset") + F.col("quota")).alias("end"))
              .repartition("src", "lo"))
    points = (pieces.select("src", F.explode(F.sequence("lo", F.least(F.col("lo") + PIECE, F.col("end")) - 1)).alias("x"))
              .select("src", _reversed_bits(F.col("x"), bits).alias("slot"), F.lit(1).cast("long").alias("one")))
    ranked = running_totals(points, ["src", "slot"], ["one"], "mix-slots")
    first = ranked.groupBy("src").agg(F.min("one_before").alias("first"))
    return ranked.join(first, "src").select("src", "slot", (F.col("one_before") - F.col("first")).alias("block"))


def _same(a: DataFrame, b: DataFrame):
    return reduce(and_, [a[k].eqNullSafe(b[k]) for k in KEY])


def taken_words(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken per row of ``docs``."""
    rows, segments = mix(docs, **options)
    taken = segments.groupBy(*KEY).agg(F.sum("taken").alias("taken"))
    return rows.join(taken, _same(rows, taken), "left").select(
        rows["doc_id"], rows["size"], "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                    **options) -> DataFrame:
    """``docs`` as the mix takes them, all columns kept, one row per
    occurrence: a document is repeated as often as the mix takes it. Of the
    one occurrence per source that the target cuts, the whole document is
    returned if at least half its words are taken. Documents without words do
    not occur."""
    rows, segments = mix(docs, id_col, text_col, source_col, **options)
    occurrences = (segments.groupBy(*KEY, "epoch").agg(F.sum("taken").alias("taken"))
                   .filter(F.col("taken") * 2 >= F.col("size"))
                   .groupBy(*KEY).agg(F.count("*").cast("int").alias("times")))
    x = free_prefix(docs)
    names = ("source", *KEY[1:])
    times = rows.join(occurrences, _same(rows, occurrences)).select(
        *[rows[c].alias(f"{x}m_{c}") for c in names], F.col("times").alias(f"{x}times"))
    keys = {f"{x}source": F.col(source_col), f"{x}doc_id": F.col(id_col), f"{x}size": n_words(F.col(text_col)),
            f"{x}text_key": F.xxhash64(text_col)}
    # rows that agree in all keys are numbered like the copies in mix()
    copies = Window.partitionBy(*keys).orderBy(f"{x}text_key")
    tagged = docs.withColumns(keys).withColumn(f"{x}copy", F.row_number().over(copies))
    cond = reduce(and_, [F.col(f"{x}{c}").eqNullSafe(F.col(f"{x}m_{c}")) for c in names])
    return (tagged.join(times, cond).withColumn(f"{x}time", F.explode(F.sequence(F.lit(1), F.col(f"{x}times"))))
            .select(*[f"`{c}`" for c in docs.columns]))
