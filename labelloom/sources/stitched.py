"""Records of text files that may span any number of pieces, read by several tasks per file.

Spark cuts a text file by byte ranges at a separator: the line break for CSV, the closing brace for
JSON. A separator inside a quoted cell or string does not end a record, and a byte range does not know
whether it begins inside one. So the ranges are read twice, both times narrowly: first each range says
how it would end for either way it may begin (inside quotes or not) and how much deeper the braces get;
these few numbers per range, put in order per file, tell how every range does begin. Then each range
gives its records, and the pieces at its two ends, which are put together across ranges.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelloom.functions.sizing import small_side

JSON_STRING = re.compile(r'"[^"\\]*(?:\\.[^"\\]*)*"', re.S)
CSV_CLOSE = re.compile(r'[^"]*(?:""[^"]*)*"(?!")')
#: Ranges whose states are broadcast; more are joined.
MAX_RANGES = 200_000

# Task functions travel with the job: executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def json_step(piece: str, inside: bool) -> tuple[bool, int]:
    """Whether a piece that a closing brace follows ends inside a string, and how much deeper the braces are then."""
    rest = JSON_STRING.sub("", '"' + piece if inside else piece)
    begun = rest.find('"')
    if begun >= 0:
        return True, rest.count("{", 0, begun)
    return False, rest.count("{") - 1


def csv_step(line: str, inside: bool) -> tuple[bool, int]:
    """Whether a line ends inside a quoted cell. Quotes open at the start of a cell only."""
    if '"' not in line:
        return inside, 0
    at = 0
    while True:
        if not inside and line.startswith('"', at):
            inside, at = True, at + 1
        if inside:
            closed = CSV_CLOSE.match(line, at)
            if not closed:
                return True, 0
            inside, at = False, closed.end()
        comma = line.find(",", at)
        if comma < 0:
            return False, 0
        at = comma + 1


Step = Callable[[str, bool], tuple[bool, int]]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, Iterator[str]]]:
    """((file, start, further columns), pieces in order) of each byte range of a task."""
    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    row = next(rows, None)
    while row is not None:
        of, rest = row[:-1], [row]

        def pieces(of=of, rest=rest) -> Iterator[str]:
            while rest[0] is not None and rest[0][:-1] == of:
                value = rest[0][-1]
                rest[0] = next(rows, None)
                yield value

        yield of, pieces()
        row = rest[0]


def _ranges(pieces: DataFrame, step: Step) -> DataFrame:
    """(file, start, inside, depth): the state in which each byte range begins."""

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (file, start), values in _runs(batches):
            inside, deeper = [False, True], [0, 0]
            for value in values:
                for way in (0, 1):
                    inside[way], more = step(value, inside[way])
                    deeper[way] += more
            yield pa.RecordBatch.from_pydict({
                "file": [file], "start": pa.array([start], pa.int64()), "inside": [inside], "deeper": pa.array(
                    [deeper], pa.list_(pa.int64()))})

    def begins(ranges: pd.DataFrame) -> pd.DataFrame:
        ranges = ranges.sort_values("start")
        inside, depth, states = False, 0, []
        for after, deeper in zip(ranges["inside"], ranges["deeper"], strict=True):
            states.append((inside, depth))
            inside, depth = bool(after[int(inside)]), depth + int(deeper[int(inside)])
        return ranges[["file", "start"]].assign(inside=[s[0] for s in states], depth=[s[1] for s in states])

    found = pieces.select("file", "start", "value").mapInArrow(
        ends, "file string, start long, inside array<boolean>, deeper array<long>")
    return found.groupBy("file").applyInPandas(begins, "file string, start long, inside boolean, depth long")


def spark_ranges(spark: SparkSession, path: str, separator: str) -> int:
    """Byte ranges that Spark reads the files in, empty ones left out."""
    where = [F.col(f"_metadata.{c}") for c in ("file_path", "file_block_start")]
    return spark.read.option("lineSep", separator).text(path).select(*where).distinct().count()


def stitched(spark: SparkSession, path: str, separator: str, step: Step) -> DataFrame:
    """(record, first): every record's text without its last separator, and whether it is its file's first.

    A record ends with a piece that ends outside of quotes and braces. What follows a file's last
    separator is a record too, if it is not blank.
    """
    pieces = spark.read.option("lineSep", separator).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("place"), "value")
    states = small_side(_ranges(pieces, step), MAX_RANGES).withColumnsRenamed({"file": "of file", "start": "of start"})
    joined = pieces.join(states, (F.col("file") == F.col("of file")) & (F.col("start") == F.col("of start")))
    # A broadcast leaves pieces in their order and the sort has nothing to do; a shuffled join does not.
    ordered = joined.sortWithinPartitions("file", "start", "place").select("file", "start", "inside", "depth", "value")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(*found: tuple) -> pa.RecordBatch:
            file, start, part, done, first, text = zip(*found)
            return pa.RecordBatch.from_pydict({
                "file": file, "start": pa.array(start, pa.int64()), "part": pa.array(part, pa.int32()), "done": done,
                "first": first, "text": pa.array(text, pa.string())})

        for (file, start, inside, depth), values in _runs(batches):
            held, head, first, full = [], inside or depth > 0, start == 0, []
            for value in values:
                held.append(value)
                inside, deeper = step(value, inside)
                depth += deeper
                if inside or depth > 0:
                    continue
                depth = 0
                full.append((file, start, 0 if head else 1, True, first, separator.join(held)))
                held, head, first = [], False, False
                if len(full) == 1000:
                    yield rows(*full)
                    full = []
            if held:
                full.append((file, start, 0 if head else 2, False, first, separator.join(held)))
            if full:
                yield rows(*full)

    found = ordered.mapInArrow(cut, "file string, start long, part int, done boolean, first boolean, text string")
    whole = found.filter("part = 1")
    # Ends of ranges: one or two rows each. A record goes on until a row that is done.
    ends = found.filter("part <> 1").groupBy("file").agg(F.array_sort(F.collect_list(
        F.struct("start", "part", "done", "first", "text"))).alias("ends"))
    nothing = F.struct(F.array().cast("array<struct<text:string,first:boolean>>").alias("out"),
                       F.array().cast("array<string>").alias("held"), F.lit(False).alias("first"))

    def take(a, e):
        text = F.concat(a["held"], F.array(e["text"]))
        first = F.when(F.size(a["held"]) == 0, e["first"]).otherwise(a["first"])
        record = F.struct(F.array_join(text, separator).alias("text"), first.alias("first"))
        return F.when(e["done"], F.struct(
            F.concat(a["out"], F.array(record)).alias("out"), F.array().cast("array<string>").alias("held"), F.lit(False).alias("first"))
        ).otherwise(F.struct(a["out"].alias("out"), text.alias("held"), first.alias("first")))

    def last(a):
        rest = F.struct(F.array_join(a["held"], separator).alias("text"), a["first"].alias("first"))
        return F.when(F.size(a["held"]) > 0, F.concat(a["out"], F.array(rest))).otherwise(a["out"])

    across = ends.select(F.explode(F.aggregate("ends", nothing, take, last)).alias("r"))
    both = whole.select(F.col("text").alias("record"), "first").unionByName(
        across.select(F.col("r.text").alias("record"), F.col("r.first").alias("first")))
    return both.filter(~F.col("record").rlike(r"\A\s*\z"))


def read_json_list(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Objects of JSON files that hold one list of objects each, several objects, or one; any line breaks.

    A record that does not parse has nulls in all fields. An empty list gives no rows.
    """
    found = stitched(spark, path, "}", json_step).select(F.regexp_extract("record", r"(?s)\{.*\z", 0).alias("record"))
    record = F.from_json(F.concat("record", F.lit("}")), schema)
    return found.filter("record <> ''").select(record.alias("r")).select("r.*")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header in each file, whose quoted cells may hold line breaks; all columns stay text."""
    plain = spark.read.csv(path, header=True, escape='"', multiLine=True)
    columns = plain.columns
    if not columns:
        return plain
    schema = ", ".join(f"`{c.replace('`', '``')}` string" for c in columns)
    record = F.from_csv(F.regexp_replace("record", r"\r\z", ""), schema, {"escape": '"'})
    return stitched(spark, path, "\n", csv_step).filter(~F.col("first")).select(record.alias("r")).select("r.*")
