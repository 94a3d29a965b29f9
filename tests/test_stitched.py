"""Records that span lines and byte ranges, against the json and csv modules."""

import csv
import io
import json
import random

import pytest

from labelloom.sources import prompts, stitched

BITS = ['"', '""', "\\", "\n", "\r\n", ",", "}", "{", "}, {", "[", "]", '"}', "é", "日", "a", " b ", "\t", '"},{"prompt":"']


@pytest.fixture(params=[40, 700, 10**8])
def range_bytes(request, spark):
    """Byte ranges shorter and longer than a record, and one for each file."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]
    for n, v in zip(names, (request.param, 1)):
        spark.conf.set(n, v)
    yield request.param
    for n, v in zip(names, before):
        spark.conf.set(n, v)


@pytest.fixture(params=["tables", "joins"])
def states(request, monkeypatch):
    if request.param == "joins":
        monkeypatch.setattr(stitched, "MAX_RANGES", 0)


def odd_strings(seed, n):
    rng = random.Random(seed)
    return ["".join(rng.choice(BITS) for _ in range(rng.randint(0, 12))) for _ in range(n)]


def test_json_lists(spark, tmp_path, range_bytes, states):
    records = [{"prompt": s, "relevant_tools": odd_strings(i, i % 3)} for i, s in enumerate(odd_strings(1, 150))]
    records += [{"prompt": "x" * 3000}, {"relevant_tools": ["a"]}, {"prompt": None, "more": {"deep": [{"}": "{"}]}}, {}]
    for name, part, indent in (("a", records[:50], None), ("b", records[50:100], 2), ("c", records[100:], 0), ("d", [], None)):
        (tmp_path / f"{name}.json").write_text(json.dumps(part, indent=indent, ensure_ascii=name == "b"), encoding="utf-8")
    (tmp_path / "e.json").write_text("\n".join(json.dumps(r) for r in records[:5]))
    got = prompts.read_prompt_records(spark, str(tmp_path), multiline=True)
    if range_bytes == 40:
        assert stitched.spark_ranges(spark, str(tmp_path), "}") > 20
    found = sorted((r["prompt"], r["relevant_tools"]) for r in got.collect())
    assert found == sorted((r.get("prompt") or "", r.get("relevant_tools") or []) for r in records + records[:5])


def test_csv_cells_with_line_breaks(spark, tmp_path, range_bytes, states):
    cells = [s.replace("\r\n", "\n") for s in odd_strings(2, 300)]
    table = [cells[i:i + 3] for i in range(0, 300, 3)] + [["q" * 2000, "a\n" * 300, "z"]]
    for name, part in (("a", table[:60]), ("b", table[60:]), ("c", [])):
        out = io.StringIO()
        writer = csv.writer(out, quoting=csv.QUOTE_ALL, lineterminator="\r\n" if name == "b" else "\n")
        writer.writerows([["prompt", "t, wo", "three"], *part])
        (tmp_path / f"{name}.csv").write_bytes(out.getvalue().encode())
    got = prompts.read_table(spark, str(tmp_path), multiline=True)
    assert got.columns == ["prompt", "t, wo", "three"]
    found = sorted((tuple(r) for r in got.collect()), key=repr)
    assert sorted(tuple(c or "" for c in r) for r in found) == sorted(map(tuple, table))
    # Spark's own reader, a task per file, takes empty cells for nulls too.
    plain = spark.read.csv(str(tmp_path), header=True, escape='"', multiLine=True)
    assert sorted((tuple(r) for r in plain.collect()), key=repr) == found


def test_quotes_inside_of_plain_cells(spark, tmp_path, range_bytes):
    (tmp_path / "a.csv").write_text('prompt,b\n5" disk,x\n"a\nb",y\n6" and 7" disks,"z ""z"""\n')
    got = prompts.read_table(spark, str(tmp_path), multiline=True)
    assert sorted(tuple(r) for r in got.collect()) == [('5" disk', "x"), ('6" and 7" disks', 'z "z"'), ("a\nb", "y")]


@pytest.mark.parametrize("text", ["", "\n", "prompt,b\n"])
def test_tables_without_rows(spark, tmp_path, text):
    (tmp_path / "a.csv").write_text(text)
    assert prompts.read_table(spark, str(tmp_path), multiline=True).collect() == []
