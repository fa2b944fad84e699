"""CSV files whose quoted fields hold line ends, read by many tasks.

A file is read in byte ranges (Spark's own splits), as lines.  Whether a line
starts inside a quoted field depends on all quotes before it, so:

1. the lines of every range are stored as chunks of text, each with where it
   ends -- outside or inside a quoted field -- for either way it can start.
   How Spark splits a file depends on the other files of a scan and on the
   cores there are, so nothing is carried from one scan to another by ranges;
2. those steps are chained over the chunks of a file (a window over one row a
   chunk), which tells how each chunk really starts;
3. records are cut out of every chunk, once; what a chunk holds of a record
   that began earlier, or does not end in it, is put together by file and place.

Files without a record of several lines are told apart before, so Spark's own
CSV scan can read them.

A quote opens a field only at its start, ``""`` inside is one quote, and what
follows a closing quote up to the separator is text -- as in pandas and Python's
``csv``.  Records end with a line feed, a carriage return, or both; blank lines
are skipped; missing fields are NULL and surplus ones dropped; an empty field is
NULL, a quoted empty one is an empty text.  A file that ends inside a quoted
field is an error.
"""

from __future__ import annotations

import csv
import io
import re
import sys
from collections import deque
from collections.abc import Iterable, Iterator, Sequence
from functools import partial
from itertools import chain
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.broadcast import maybe_broadcast
from ..session import checkpoint_dir


def path_of(uri: str) -> str:
    """A file's path as readers take it; Spark writes local ones in two ways."""
    return re.sub(r"^file:/+", "file:///", unquote(uri))


FLUSH_CHARACTERS = 4 << 20  # of records parsed at once
CHUNK_BYTES = 1 << 20  # of lines in one row, unless a line is longer
MARK = "\x01"  # a line after the last: a record of its own unless a field is open


def _ends(text: str, sep: str, inside: bool) -> tuple[bool, bool]:
    """Whether lines that start inside (or outside) a quoted field end inside
    one, and whether a record of theirs has several lines."""
    if '"' not in text:
        return inside, inside
    csv.field_size_limit(sys.maxsize)
    lines = io.StringIO(('"' if inside else "") + text + "\n", newline="")
    reader = csv.reader(chain(lines, [MARK]), delimiter=sep)
    count, last = deque(enumerate(reader, 1), maxlen=1)[0]
    return last != [MARK], count < reader.line_num


def line_steps(sep: str):
    """``step(line, inside)``: whether a line that starts inside (or outside) a
    quoted field ends inside one."""
    return lambda line, inside: _ends(line, sep, inside)[0]


def _spans(batch: pa.RecordBatch, column: str) -> Iterator[tuple[str, int, pa.Array]]:
    """Runs of rows of one range: file, start of the range, ``column``."""
    if not batch.num_rows:
        return
    files = batch.column("file").dictionary_encode()
    codes, starts = files.indices.to_numpy(), batch.column("start").to_numpy()
    changes = np.flatnonzero((codes[1:] != codes[:-1]) | (starts[1:] != starts[:-1])) + 1
    for lo, hi in zip([0, *changes], [*changes, batch.num_rows]):
        yield files.dictionary[codes[lo]].as_py(), int(starts[lo]), batch.column(column).slice(lo, hi - lo)


def _text(lines: pa.Array) -> str:
    return pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(lines)], pa.int32()), lines), "\n")[0].as_py()


def _ranges(sep: str, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines -> per range: its ends for both starts, and whether a line inside
    it ends within a record."""
    names = ["file", "start", "from_outside", "from_inside", "torn"]
    place, ends, torn = None, [False, True], False

    def row():
        return pa.RecordBatch.from_arrays([pa.array([v]) for v in (*place, *ends, torn)], names=names)

    for batch in batches:
        for file, start, lines in _spans(batch, "quoted"):
            if (file, start) != place:
                if place is not None:
                    yield row()
                place, ends, torn = (file, start), [False, True], False
            text = _text(lines)
            steps = [_ends(text, sep, inside) for inside in (False, True)]
            torn = torn or steps[ends[0]][1]
            ends = [steps[e][0] for e in ends]
    if place is not None:
        yield row()


def _lines(spark: SparkSession, files: Sequence[str]) -> DataFrame:
    lines = spark.read.option("lineSep", "\n").text(list(files))
    return lines.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").alias("line")
    )


def range_starts(spark: SparkSession, files: Sequence[str], sep: str = ",") -> DataFrame:
    """One row a byte range that holds a quote: ``file``, ``start``, whether it starts ``inside`` a
    quoted field, whether it ``ends_inside``, and whether it is ``torn`` (a
    record has several lines)."""
    lines = _lines(spark, files)
    # a line without quotes ends as it starts, so only the others travel to Python
    quoted = lines.where(F.contains("line", F.lit('"'))).withColumnRenamed("line", "quoted")
    ranges = quoted.mapInArrow(partial(_ranges, sep), "file string, start long, from_outside boolean, from_inside boolean, torn boolean")
    ranges = _started(ranges, "start")
    ends = F.when(F.col("inside"), F.col("from_inside")).otherwise(F.col("from_outside"))
    return ranges.select("file", "start", "inside", ends.alias("ends_inside"), (F.col("torn") | F.col("inside")).alias("torn"))


def _started(ranges: DataFrame, *order: str) -> DataFrame:
    """The ranges of files (or chunks, in their ``order``) with whether they
    start ``inside`` a quoted field."""
    # a range that ends the same way however it starts fixes what follows; one
    # that turns outside into inside and back is a change of parity
    turns = F.col("from_outside") & ~F.col("from_inside")
    by_file = Window.partitionBy("file").orderBy(*order)
    so_far, before = by_file.rowsBetween(Window.unboundedPreceding, 0), by_file.rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("turns", F.sum(turns.cast("int")).over(so_far))
    fixed = F.when(F.col("from_outside") == F.col("from_inside"), F.struct(F.col("from_outside").cast("int").alias("state"), "turns"))
    last = F.last(fixed, ignorenulls=True).over(before)
    turned = F.coalesce(F.max("turns").over(before), F.lit(0)) - F.coalesce(last["turns"], F.lit(0))
    inside = (F.coalesce(last["state"], F.lit(0)) + turned) % 2 == 1
    return ranges.withColumn("inside", inside).drop("turns")


def torn_ranges(spark: SparkSession, files: Sequence[str], sep: str = ",") -> dict[str, list[int]]:
    """Files with a record of several lines -> the starts of their ranges that
    begin inside a quoted field and hold a quote.  At most one number a range reaches the driver,
    which has listed those ranges before."""
    ranges = range_starts(spark, files, sep)
    by_file = ranges.groupBy("file").agg(
        F.max("torn").alias("torn"),
        F.max_by("ends_inside", "start").alias("open"),
        F.collect_list(F.when(F.col("inside"), F.col("start"))).alias("inside"),
    )
    found = by_file.where("torn OR open").collect()
    unended = sorted(unquote(r["file"]) for r in found if r["open"])
    if unended:
        raise ValueError(f"{unended[0]} ends inside a quoted field" + (f", and {len(unended) - 1} other files" if unended[1:] else ""))
    return {r["file"]: r["inside"] for r in found}


def _chunks(sep: str, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines -> chunks of a range: their text and their ends for both starts."""
    names = ["file", "start", "chunk", "text", "from_outside", "from_inside"]
    place, number = None, 0
    for batch in batches:
        for file, start, lines in _spans(batch, "line"):
            if (file, start) != place:
                place, number = (file, start), 0
            sizes = np.cumsum(pc.binary_length(lines).to_numpy(zero_copy_only=False))
            cuts = np.flatnonzero(np.diff(sizes // CHUNK_BYTES)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(lines)]):
                text = _text(lines.slice(lo, hi - lo))
                row = (file, start, number, text + "\n", *(_ends(text, sep, inside)[0] for inside in (False, True)))
                yield pa.RecordBatch.from_arrays([pa.array([v]) for v in row], names=names)
                number += 1


def _cut(text: str, sep: str, inside: bool, ends_inside: bool) -> tuple[str | None, list[list], str | None]:
    """A chunk -> the end of a record that began earlier, the fields of its whole
    records, and the start of one that goes on."""
    lines = list(io.StringIO(text, newline=""))
    head = tail = None
    if inside:
        reader = csv.reader(chain(['"' + lines[0]], lines[1:]), delimiter=sep)
        next(reader)
        head, lines = "".join(lines[: reader.line_num]), lines[reader.line_num :]
    reader = csv.reader(lines, delimiter=sep, quoting=csv.QUOTE_NOTNULL)
    records, begin = [], 0
    for fields in reader:
        end = reader.line_num
        if ends_inside and end == len(lines):
            tail = "".join(lines[begin:])
        elif len(fields) > 1 or "".join(lines[begin:end]).strip(" \t\r\n"):
            records.append(fields)
        begin = end
    return head, records, tail


def _is_header(fields: list, names: Sequence[str]) -> bool:
    """Spark numbers empty and repeated names."""
    return len(fields) == len(names) and all(n in (f, f"{f or ''}{i}", f"_c{i}" if not f else f) for i, (f, n) in enumerate(zip(fields, names)))


def _check_header(file: str, fields: list, names: Sequence[str]) -> None:
    if not _is_header(fields, names):
        raise ValueError(f"{unquote(file)} has the columns {[f or '' for f in fields]}, not {list(names)}")


def _columns(records: list[list], width: int) -> list[pa.Array]:
    full = [r if len(r) == width else (r + [None] * width)[:width] for r in records]
    return [pa.array(c, pa.string()) for c in (zip(*full) if full else [[]] * width)]


def _cut_chunks(names, sep, schema, batches):
    """Chunks -> whole records as text columns, and parts of others as text."""
    csv.field_size_limit(sys.maxsize)
    width = len(names)

    def rows(n, columns, file, start, chunk, parts):
        last = [pa.array(c, t) for c, t in zip(zip(*parts), (pa.string(), pa.bool_(), pa.string()))] if parts else [pa.nulls(n, t) for t in (pa.string(), pa.bool_(), pa.string())]
        return pa.RecordBatch.from_arrays([*columns, pa.repeat(file, n), pa.repeat(pa.scalar(start, pa.int64()), n), pa.repeat(pa.scalar(chunk, pa.int64()), n), *last], names=schema)

    for batch in batches:
        for row in batch.to_pylist():
            text, first = row["text"], row["start"] == 0 and row["chunk"] == 0
            place = row["file"], row["start"], row["chunk"]
            head, records, tail = _cut(text.removeprefix("\ufeff") if first else text, sep, row["inside"], row["ends_inside"])
            if first and records:
                _check_header(row["file"], records.pop(0), names)
                first = False
            if records:
                yield rows(len(records), _columns(records, width), *place, None)
            parts = [(p, first, t) for p, t in (("head", head), ("tail", tail)) if t is not None]
            if parts:
                yield rows(len(parts), [pa.nulls(len(parts), pa.string())] * width, *place, parts)


def _joined_records(names, sep, batches):
    """The texts of records, one each -> text columns."""
    csv.field_size_limit(sys.maxsize)

    def batch(files, records):
        return pa.RecordBatch.from_arrays([*_columns(records, len(names)), pa.array(files, pa.string())], names=[f"c{i}" for i in range(len(names))] + ["file"])

    files, records, size = [], [], 0
    for b in batches:
        for row in b.to_pylist():
            (fields,) = csv.reader([row["text"]], delimiter=sep, quoting=csv.QUOTE_NOTNULL)
            if row["first"]:
                _check_header(row["file"], fields, names)
                continue
            files.append(row["file"])
            records.append(fields)
            size += len(row["text"])
            if size >= FLUSH_CHARACTERS:
                yield batch(files, records)
                files, records, size = [], [], 0
    if records:
        yield batch(files, records)


def read_csv_records(spark: SparkSession, files: Iterable[str], names: Sequence[str], sep: str = ",") -> DataFrame:
    """All text columns ``names`` and ``__file`` of the files of ``torn_ranges``.
    Each file has a header line.  The records are cut once and stored."""
    checkpoint_dir(spark)
    lines = _lines(spark, [path_of(f) for f in files])
    chunks = lines.mapInArrow(partial(_chunks, sep), "file string, start long, chunk long, text string, from_outside boolean, from_inside boolean").checkpoint()
    ends = F.when(F.col("inside"), F.col("from_inside")).otherwise(F.col("from_outside"))
    place = ["file", "start", "chunk"]
    # one short row a chunk
    starts = _started(chunks.drop("text"), "start", "chunk").select(*place, "inside", ends.alias("ends_inside")).checkpoint()
    started = chunks.select(*place, "text").join(maybe_broadcast(starts), place)
    columns = [T.StructField(f"c{i}", T.StringType()) for i in range(len(names))] + [T.StructField("file", T.StringType())]
    schema = T.StructType(columns + [T.StructField("start", T.LongType()), T.StructField("chunk", T.LongType()), T.StructField("part", T.StringType()), T.StructField("first", T.BooleanType()), T.StructField("text", T.StringType())])
    found = started.mapInArrow(partial(_cut_chunks, list(names), sep, schema.fieldNames()), schema).checkpoint()
    out = found.where("part IS NULL").select(*[c.name for c in columns])
    in_file = Window.partitionBy("file").orderBy("start", "chunk", "part").rowsBetween(Window.unboundedPreceding, 0)
    parts = found.where("part IS NOT NULL").select(*place, "part", "first", "text")
    owned = parts.withColumn("owner", F.last(F.when(F.col("part") == "tail", F.struct("start", "chunk")), ignorenulls=True).over(in_file))
    pieces = F.transform(F.array_sort(F.collect_list(F.struct("start", "chunk", "text"))), lambda p: p["text"])
    # the pieces of one record
    whole = owned.groupBy("file", "owner").agg(F.array_join(pieces, "").alias("text"), F.max(F.col("first") & (F.col("part") == "tail")).alias("first"))
    out = out.unionByName(whole.select("file", "text", "first").mapInArrow(partial(_joined_records, list(names), sep), T.StructType(columns)))
    return out.toDF(*names, "__file")


def read_text_columns(spark: SparkSession, files: Sequence[str], names: Sequence[str]) -> DataFrame:
    """CSV files with a header line ``names`` as text columns and ``__file`` (the
    file's URI).  Spark's scan reads those whose records are lines, the record
    reader the others; both split large files."""
    torn = torn_ranges(spark, files)
    taken = {path_of(f) for f in torn}
    plain = [f for f in files if path_of(f) not in taken]
    parts = [read_csv_records(spark, torn, names)] if torn else []
    if plain or not torn:
        scan = (
            spark.read.schema(T.StructType([T.StructField(c, T.StringType()) for c in names]))
            .option("header", True)
            .option("enforceSchema", False)
            .option("escape", '"')
            .option("ignoreLeadingWhiteSpace", False)
            .option("ignoreTrailingWhiteSpace", False)
            .csv(plain)
        )
        parts.insert(0, scan.withColumn("__file", F.col("_metadata.file_path")))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
