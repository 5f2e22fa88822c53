"""CSV records of files whose quoted fields hold line breaks, read in parallel.

Spark's ``multiLine`` reader takes a file as one task. Here the files are
read as lines, in ordinary splits, and the records are put together again:

1. A line turns the state in which it begins (at a record's start, or inside
   quotes) into the state in which it ends. One scan composes these maps over
   each split and counts the records that would start in it, for both states.
2. Running over the splits of a file in order (one row a split), that gives
   the state at the start of each split and the number of its first record.
3. A second scan joins the lines of each record. Records that cross a split
   come out in fragments, at most two a split, which are joined by the
   number of the record.

The records are parsed by Spark's CSV functions. Records keep their order
and are numbered densely. If no line leaves quotes open, the lines are the
records and the ordinary reader is used.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabforge.functions.columns import ROW_ID

# From a record's start, a line that ends inside quotes: whole fields, then a quote that is not closed.
# A field is quoted (quotes within it doubled, anything up to the comma after it), plain, or empty.
OPEN = r'^(?:(?:"(?:[^"]|"")*+"[^,]*+|[^",][^,]*+|),)*+"(?:[^"]|"")*+$'
START, QUOTED = 0, 1
WHOLE, HEAD, REST = 0, 1, 2


def _lines(spark: SparkSession, path: str) -> DataFrame:
    text = spark.read.option("lineSep", "\n").text(path)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), "value")


def has_open_lines(spark: SparkSession, path: str) -> bool:
    """Whether some line, taken as a record, leaves quotes open."""
    line = F.col("value")
    return bool(_lines(spark, path).filter(F.contains(line, F.lit('"')) & line.rlike(OPEN)).limit(1).count())


def _states(lines: list[str], quoted: list[int], begin: int) -> list[tuple[int, int]]:
    """(line, state at its start) wherever the state changes, the first line included."""
    out, state = [(0, begin)], begin
    for i in quoted:
        after = QUOTED if _OPEN.match('"' + lines[i] if state == QUOTED else lines[i]) else START
        if after != state:
            out.append((i + 1, after))
            state = after
    return out


_OPEN = re.compile(OPEN, re.S)


def _runs(batch) -> Iterator[tuple]:
    """(row of the split's first line, its lines) of each split in a batch, in order."""
    import numpy as np

    file, split = batch.column(0).dictionary_encode().indices.to_numpy(), batch.column(1).to_numpy()
    cut = np.flatnonzero(np.r_[True, (file[1:] != file[:-1]) | (split[1:] != split[:-1])]).tolist() if batch.num_rows else []
    for a, b in zip(cut, [*cut[1:], batch.num_rows]):
        yield a, batch.column(batch.schema.get_field_index("value")).slice(a, b - a)


def _marks(values):
    """Lines with a quote, and for each line whether it has more than white space."""
    import numpy as np
    import pyarrow.compute as pc

    quoted = np.flatnonzero(pc.match_substring(values, '"').to_numpy(zero_copy_only=False)).tolist()
    full = pc.not_equal(pc.ascii_trim_whitespace(values), "").to_numpy(zero_copy_only=False)
    return quoted, full


def _compose(batches):
    """(file, split, after_start, after_quoted, n_start, n_quoted) of every split."""
    import numpy as np
    import pyarrow as pa

    now, total = None, None
    rows = []
    for batch in batches:
        for at, values in _runs(batch):
            key = (batch.column(0)[at].as_py(), batch.column(1)[at].as_py())
            if key != now:
                if now:
                    rows.append((*now, *total))
                now, total = key, [START, QUOTED, 0, 0]
            quoted, full = _marks(values)
            seen = np.r_[0, np.cumsum(full)]
            lines = values.to_pylist() if quoted else []
            for entry in (0, 1):
                changes = _states(lines, quoted, total[entry])
                for (i, state), j in zip(changes, [c[0] for c in changes[1:]] + [len(values)]):
                    if state == START:
                        total[2 + entry] += int(seen[min(j, len(values))] - seen[min(i, len(values))])
                total[entry] = changes[-1][1]
    if now:
        rows.append((*now, *total))
    names = ["file", "split", "after_start", "after_quoted", "n_start", "n_quoted"]
    types = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)


def _join(batches):
    """Rows (row, split_no, kind, text) of whole records and of fragments.
    ``first`` numbers the split's first record; -1 is a file's header."""
    import numpy as np
    import pyarrow as pa

    now, state, nth, buffer, kind = None, START, 0, [], WHOLE
    out = []

    def emit(how):
        text = "\n".join(buffer)
        out.append((nth, now[0], how, text))

    def batch_of(rows):
        types = [pa.int64(), pa.int64(), pa.int32(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)],
                                          ["row", "split_no", "kind", "text"])

    for batch in batches:
        number, states, firsts = (batch.column(batch.schema.get_field_index(c)) for c in ("split_no", "state", "first"))
        for at, values in _runs(batch):
            key = (number[at].as_py(),)
            if key != now:
                if buffer:  # the split before ended inside a record
                    emit(REST if kind == REST else HEAD)
                now, state, nth, buffer = key, states[at].as_py(), firsts[at].as_py(), []
                kind = REST if state == QUOTED else WHOLE
            quoted, full = _marks(values)
            lines = values.to_pylist()
            changes = _states(lines, quoted, state)
            starts = np.zeros(len(lines) + 1, bool)
            for (i, s), j in zip(changes, [c[0] for c in changes[1:]] + [len(lines) + 1]):
                starts[i:j] = s == START
            state = changes[-1][1]
            for line, begins, filled in zip(lines, starts.tolist(), full.tolist()):
                if begins:
                    if buffer:
                        emit(kind)
                        nth += kind == WHOLE
                        buffer.clear()
                    kind = WHOLE
                    if not filled:
                        continue
                buffer.append(line)
            if buffer and starts[len(lines)]:  # the last record is complete
                emit(kind)
                nth += kind == WHOLE
                buffer.clear()
                kind = WHOLE
        if out:
            yield batch_of(out)
            out = []
    if buffer:
        emit(REST if kind == REST else HEAD)
    if out:
        yield batch_of(out)


def split_table(lines: DataFrame) -> DataFrame:
    """(file, split, split_no, state, first): one row a split."""
    table = lines.mapInArrow(_compose, "file string, split long, after_start int, after_quoted int, n_start long, n_quoted long")
    of_file = Window.partitionBy("file").orderBy("split")
    before = of_file.rowsBetween(Window.unboundedPreceding, -1)
    # a split either forces its end state or keeps or turns the one it began with
    turns = (F.col("after_start") == QUOTED) & (F.col("after_quoted") == START)
    table = table.withColumn("turned", F.pmod(F.count_if(turns).over(of_file), F.lit(2)))
    forced = F.when(F.col("after_start") == F.col("after_quoted"), F.col("after_start").bitwiseXOR(F.col("turned").cast("int")))
    table = table.withColumns({"forced": F.last(forced, ignorenulls=True).over(before), "earlier": F.lag("turned", 1, 0).over(of_file)})
    table = table.withColumn("state", F.coalesce("forced", F.lit(START)).bitwiseXOR(F.col("earlier").cast("int")))
    table = table.withColumn("n", F.when(F.col("state") == START, F.col("n_start")).otherwise(F.col("n_quoted")))
    everything = Window.orderBy("file", "split")
    earlier = everything.rowsBetween(Window.unboundedPreceding, -1)
    table = table.withColumns({"in_file": F.coalesce(F.sum("n").over(before), F.lit(0)), "all": F.coalesce(F.sum("n").over(earlier), F.lit(0)),
                               "split_no": F.row_number().over(everything)})
    # a file's first record is its header
    headers = F.count_if((F.col("in_file") == 0) & (F.col("n") > 0)).over(everything)
    return table.select("file", "split", F.col("split_no").cast("long").alias("split_no"), "state",
                        (F.col("all") - headers).alias("first"), ((F.col("in_file") == 0) & (F.col("n") > 0)).alias("header"))


def records(spark: SparkSession, path: str) -> DataFrame:
    """(_row_id, text): every record below ``path`` but the headers, in order."""
    from tabforge.session import materialize

    lines = _lines(spark, path)
    table = materialize(split_table(lines), "csv-splits")
    # a row a split (128 MB of text by default): 100 TB are 800,000 rows. A shuffle would lose the order of the lines.
    placed = lines.join(F.broadcast(table.drop("header")), ["file", "split"])
    parts = placed.select("file", "split", "value", "split_no", "state", "first").mapInArrow(
        _join, "row long, split_no long, kind int, text string")
    headers = F.broadcast(table.filter("header").select("split_no", F.col("first").alias("row")))  # a row a file
    pieces = parts.filter(F.col("kind") != WHOLE)  # at most two a split
    order = Window.orderBy("split_no", F.desc("kind")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    head = F.when(F.col("kind") == HEAD, F.struct("row", "split_no"))
    crossing = (pieces.withColumn("owner", F.last(head, ignorenulls=True).over(order)).groupBy("owner")
                .agg(F.sort_array(F.collect_list(F.struct("split_no", (-F.col("kind")).alias("o"), "text"))).alias("p"))
                .select("owner.row", "owner.split_no", F.concat_ws("\n", F.col("p.text")).alias("text")))
    both = parts.filter(F.col("kind") == WHOLE).select("row", "split_no", "text").unionByName(crossing)
    text = F.col("text")
    bare = F.when(F.endswith(text, F.lit("\r")), F.expr("left(text, length(text) - 1)")).otherwise(text)
    return both.join(headers, ["split_no", "row"], "left_anti").select(F.col("row").alias(ROW_ID), bare.alias("text"))
