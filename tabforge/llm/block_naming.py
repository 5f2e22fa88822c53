"""Exact de-duplication by deterministic block naming.

Normalised texts are cut into fixed-size byte blocks. The distinct blocks
are sorted and numbered, so equal blocks share an integer name and different
blocks never do. Adjacent names are then paired, the distinct pairs sorted and
numbered in turn, until each document is left with one integer. Two
documents share (level, name) exactly if their texts are equal.

Blocks travel once, to be numbered. The occurrences are linked to their
number by a 128-bit routing key instead of the content; that no two different
blocks share a key is verified on the numbered blocks, and the naming is
repeated under another salt if any do. A copy held by a third of all rows costs
one block row per map task (the distinct is combined before the shuffle), and
its thin occurrence rows are split by adaptive skew joins.

Defined cases: null text counts as empty; an empty text is one empty block.
Rows that agree in everything are separate rows and one of them stays; of rows
that share id and text but differ elsewhere, the smallest by those columns. A
text of any length is read whole, block by block. A null
``doc_id`` sorts below any number. An empty table gives an empty result.
Columns other than the id and the text play no part and may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabforge.llm.common import ascii_lower, discard, free_prefix, materialize, one_of_each

BLOCK_BYTES = 16384


def _blocks(data: Column, size: int) -> Column:
    """The byte blocks of a binary column, at least one."""
    last = F.greatest(F.ceil(F.octet_length(data) / size), F.lit(1)).cast("int") - 1
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(data, i * size + 1, F.lit(size)))


def _key(block: Column, salt: int) -> Column:
    return F.unhex(F.md5(F.concat(F.lit(f"{salt}:").cast("binary"), block)))


def _numbered(distinct: DataFrame, order: list[str], name: str) -> DataFrame:
    """Sort distinct rows and give each an integer of its own."""
    return materialize(distinct.sortWithinPartitions(*order)
                       .select(order[0], *order[1:], F.monotonically_increasing_id().alias("name")), name)


def _block_names(docs: DataFrame, size: int, salt: int):
    """Occurrence table (rid, doc_id, text_sha256, keys) and block numbers (key, name), or
    None where two different blocks share a key."""
    rows = materialize(
        docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", F.col("text").cast("binary").alias("data"))
        .select("rid", "doc_id", F.sha2("data", 256).alias("text_sha256"),
                F.transform(_blocks(F.col("data"), size), lambda b: _key(b, salt)).alias("keys")), "naming-rows")
    blocks = (docs.select(F.explode(_blocks(F.col("text").cast("binary"), size)).alias("block"))
              .select(_key(F.col("block"), salt).alias("key"), "block").distinct())
    names = materialize(blocks.sortWithinPartitions("key", "block")
                        .select("key", F.monotonically_increasing_id().alias("name")), "naming-blocks")
    clash = names.groupBy("key").count().filter("count > 1").limit(1).count()
    if clash:
        discard(rows)
        discard(names)
        return None
    return rows, names


def identities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(rid, doc_id, text_sha256, level, name) per row of ``docs``; (level,
    name) is the collision-free identity of the normalised text."""
    norm = docs.select(F.col(id_col).alias("doc_id"),
                       ascii_lower(F.coalesce(F.col(text_col), F.lit(""))).alias("text"))
    salt, named = 0, None
    while named is None:
        named = _block_names(norm, block_bytes, salt)
        salt += 1
    rows, names = named
    longest = rows.agg(F.max(F.size("keys"))).first()[0] or 0
    nodes = materialize(rows.select("rid", F.size("keys").alias("n"), F.posexplode("keys").alias("pos", "key"))
                        .join(names, "key").select("rid", "n", "pos", "name"), "naming-nodes")
    done = [nodes.filter("n = 1").select("rid", F.lit(0).alias("level"), "name")]
    level = 0
    while longest > 1:
        level += 1
        longest = (longest + 1) // 2
        pairs = (nodes.filter("n > 1").groupBy("rid", F.shiftright("pos", 1).alias("pos"))
                 .agg(F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("left"),
                      F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("right"),
                      F.shiftright(F.max("n") + 1, 1).alias("n")))
        numbers = _numbered(pairs.select("left", "right").distinct(), ["left", "right"], f"naming-pairs-{level}")
        nodes = materialize(pairs.join(numbers, ["left", "right"]).select("rid", "n", "pos", "name"),
                            f"naming-nodes-{level}")
        discard(numbers)
        done.append(nodes.filter("n = 1").select("rid", F.lit(level).alias("level"), "name"))
    discard(names)
    final = done[0]
    for d in done[1:]:
        final = final.unionByName(d)
    return rows.select("rid", "doc_id", "text_sha256").join(final, "rid")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 per row of ``docs``; of
    equal texts the row with the largest id stays."""
    ids = identities(docs, id_col, text_col, block_bytes)
    groups = ids.groupBy("level", "name").agg(
        F.max(F.struct(F.col("doc_id"), F.col("rid"))).alias("keep"), F.count("*").alias("group_size"))
    return ids.join(groups, ["level", "name"]).select(
        "doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size",
        (F.col("rid") == F.col("keep.rid")).alias("kept"), "text_sha256")


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts, all columns kept."""
    x = free_prefix(docs)
    kept = (exact_duplicates(docs, id_col, text_col).filter("kept")
            .select(F.col("doc_id").alias(f"{x}keep_id"), F.col("text_sha256").alias(f"{x}keep_sha")))
    sha = F.sha2(ascii_lower(F.coalesce(F.col(text_col), F.lit(""))).cast("binary"), 256)
    tagged = docs.withColumns({f"{x}id": F.col(id_col), f"{x}sha": sha})
    cond = F.col(f"{x}id").eqNullSafe(F.col(f"{x}keep_id")) & (F.col(f"{x}sha") == F.col(f"{x}keep_sha"))
    # rows that repeat the id and the text of the row that stays: the smallest by their other columns
    return one_of_each(tagged.join(kept, cond, "left_semi"), [f"{x}id", f"{x}sha"], text_col).drop(f"{x}id", f"{x}sha")
