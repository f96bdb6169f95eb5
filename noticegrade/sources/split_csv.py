"""CSV whose quoted fields may span lines, read by many tasks.

Spark's own multi-line reader gives a whole file to one task, because a task that starts in the
middle of a file can't know whether it starts inside a quoted field. Here files are read as
lines, by byte ranges. What a line does to the quote state is a function from two states
(outside or inside of a quoted field at its start) to two: it keeps the state, swaps it, or
sets it whatever it was. Such functions are composed by a running scan inside each range, the
ranges' compositions are scanned in turn (a row for each range), and that gives every line its
state. Lines that start outside start a record; only records of several lines are put together.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noticegrade.functions.storage import settle

_QUOTED = '"[^"]*+(?:""[^"]*+)*+'
#: A field and the comma after it: quoted (what follows the closing quote belongs to it) or plain.
_FIELD = rf'(?:{_QUOTED}"[^,]*+,|(?:[^",][^,]*+)?+,)'
#: Lines that leave a quoted field open, from outside and from inside of one.
_OPENS = rf"^{_FIELD}*+{_QUOTED}$"
_STAYS = r'^[^"]*+(?:""[^"]*+)*+$'
_REOPENS = rf'^[^"]*+(?:""[^"]*+)*+"[^,]*+,{_FIELD}*+{_QUOTED}$'

_OPTIONS = {"escape": '"', "multiLine": "true"}


def _lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Physical lines with file, range and place, and what each does to the quote state.

    ``out`` and ``ins`` are the state (1: inside) after the line if it starts outside or inside.
    """
    paths = [path] if isinstance(path, str) else list(path)
    text = spark.read.option("lineSep", "\n").text(paths)
    line = F.col("value")
    quotes = line.contains('"')
    out = F.when(quotes & line.rlike(_OPENS), 1).otherwise(0)
    ins = F.when(~quotes | line.rlike(_STAYS) | line.rlike(_REOPENS), 1).otherwise(0)
    return text.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("range"),
        F.monotonically_increasing_id().alias("at"), "value", out.alias("out"), ins.alias("ins"),
    )


def _composed(lines: DataFrame) -> DataFrame:
    """Adds what the lines of a range do to the state up to each line and before it, and the records begun.

    ``set_to`` (null: none sets it) and ``swapped`` are the composition up to a line, ``set_before`` and
    ``swapped_before`` that of the lines before; ``if_out`` and ``if_in`` count the lines of the range up to this
    one that start a record, if the range is entered outside or inside. A task has its ranges' lines
    in their order, so they are scanned as they are read and no line is moved.
    """
    kinds = "set_to int, swapped int, set_before int, swapped_before int, if_out long, if_in long"
    carried = lines.drop("out", "ins")
    return lines.mapInArrow(_scan, f"{', '.join(f'{c} {t}' for c, t in carried.dtypes)}, {kinds}")


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    here = None  # the range being read
    set_to, swapped, begun = -1, 0, [0, 0]
    for batch in batches:
        names = [c for c in batch.schema.names if c not in ("out", "ins")]
        start = batch.column("range").to_numpy()
        file = batch.column("file").dictionary_encode().indices.to_numpy()
        out, ins = batch.column("out").to_numpy(), batch.column("ins").to_numpy()
        cuts = np.flatnonzero((start[1:] != start[:-1]) | (file[1:] != file[:-1])) + 1
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
            part = batch.slice(a, b - a)
            if not part.num_rows:
                continue
            key = (part.column("file")[0].as_py(), int(start[a]))
            if key != here:
                here, set_to, swapped, begun = key, -1, 0, [0, 0]
            o, s = out[a:b], ins[a:b]
            sets = o == s
            swaps = np.cumsum(~sets & (o == 1))
            last = np.maximum.accumulate(np.where(sets, np.arange(len(o)), -1))
            from_line = last >= 0
            known = np.where(from_line, o[last], set_to)
            odd = np.where(from_line, swaps - swaps[last], swaps + swapped) % 2
            before = np.concatenate([[set_to], known[:-1]]), np.concatenate([[swapped], odd[:-1]])
            starts = [np.where(before[0] < 0, state, before[0]) ^ before[1] == 0 for state in (0, 1)]
            counts = [np.cumsum(x) + n for x, n in zip(starts, begun)]
            set_to, swapped, begun = int(known[-1]), int(odd[-1]), [int(c[-1]) for c in counts]
            columns = [pa.array(v.astype(np.int32), mask=v < 0) for v in (known, odd, *before)]
            columns += [pa.array(c.astype(np.int64)) for c in counts]
            more = ["set_to", "swapped", "set_before", "swapped_before", "if_out", "if_in"]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), *columns], names=[*names, *more])


def _after(set_to: Column, swapped: Column, state: Column) -> Column:
    """The state after a composition that is entered in ``state``."""
    return F.coalesce(set_to, state).bitwiseXOR(swapped.cast("int"))


def _range_states(lines: DataFrame) -> DataFrame:
    """(file, range, state, records): per range the state it's entered in and the records begun before it.

    One row for each range of a file, which is some hundred bytes for every 128 MB.
    """
    ends = lines.groupBy("file", "range").agg(
        F.max_by(F.struct("set_to", "swapped"), "at").alias("whole"), F.max("if_out").alias("if_out"), F.max("if_in").alias("if_in"),
    )
    per_file = ends.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("range", "whole", "if_out", "if_in"))).alias("ranges"))
    first = F.struct(F.lit(0).alias("state"), F.lit(0).cast("long").alias("records"), F.array().cast("array<struct<range:long,state:int,records:long>>").alias("done"))

    def step(acc: Column, r: Column) -> Column:
        begun = F.when(acc["state"] == 1, r["if_in"]).otherwise(r["if_out"])
        entry = F.struct(r["range"].alias("range"), acc["state"].alias("state"), acc["records"].alias("records"))
        state = _after(r["whole"]["set_to"], r["whole"]["swapped"], acc["state"])
        return F.struct(state.alias("state"), (acc["records"] + begun).alias("records"), F.concat(acc["done"], F.array(entry)).alias("done"))

    scanned = per_file.select("file", F.explode(F.aggregate("ranges", first, step)["done"]).alias("x"))
    return scanned.select("file", F.col("x.range").alias("range"), F.col("x.state").alias("state"), F.col("x.records").alias("records"))


def csv_records(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """(file, record, text): every record of the files, headers included; ``record`` counts from 1 in a file.

    Blank records are left out, and so is a carriage return at a record's end.
    """
    # read twice, which is less than to write the lines: first for the ranges' states alone
    states = settle(_range_states(_composed(_lines(spark, path))), "ranges")
    placed = _composed(_lines(spark, path)).join(states, ["file", "range"])
    state = F.col("state")
    placed = placed.withColumn("starts", (_after(F.col("set_before"), F.col("swapped_before"), state) == 0).cast("int"))
    placed = placed.withColumn("ends", _after(F.col("set_to"), F.col("swapped"), state) == 0)
    begun = F.when(state == 1, F.col("if_in")).otherwise(F.col("if_out"))
    numbered = placed.select("file", "range", "at", "value", "starts", "ends", (F.col("records") + begun).alias("record"))
    whole = numbered.filter("starts = 1 and ends").select("file", "record", F.col("value").alias("text"))
    parts = numbered.filter("not (starts = 1 and ends)").groupBy("file", "record")
    joined = parts.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("range", "at", "value"))), lambda x: x["value"]), "\n").alias("text"))
    records = whole.unionByName(joined)
    return records.withColumn("text", F.regexp_replace("text", "\r$", "")).filter("text <> ''")


def read_split_csv(spark: SparkSession, path: str | Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """CSV with a header in each file, every column text, as the multi-line reader gives it, in many tasks.

    Fields may be quoted and hold commas, doubled quotes and line breaks. ``columns`` names the
    columns; by default the first file's header does. Records end with a line feed, after a
    carriage return or not. Records with too few fields get nulls. A gzip file is one range.
    """
    if columns is None:
        reader = spark.read.option("header", "true").option("multiLine", "true").option("escape", '"')
        columns = reader.csv(path if isinstance(path, str) else list(path)).columns
    records = csv_records(spark, path).filter("record > 1")
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(columns))])
    parsed = records.select(F.from_csv("text", schema.simpleString()[7:-1].replace(":", " "), _OPTIONS).alias("r"))
    return parsed.select(*(F.col(f"r.c{i}").alias(c) for i, c in enumerate(columns)))
