"""The byte-range reader gives the rows of the whole-file reader, however a file is cut, and opens only what it needs."""

import random

import pyarrow.fs as pafs
import pytest
from pyspark.sql import functions as F

from gridlake.plans import catalog
from gridlake.sources import archives, ranges

CASE = """0, 100.0, 33 / case
title one
title, two / three
 11,'BUS, ONE  ', 138.0, 3 / a comment
12,"B/2",69.0,1

13,'THREE',13.8,1
0 / end of buses
12,'1 ',1,40.5
0, 'not an end'
 0 /
0
11,12,'1',0.01
11,12,'2',0.02
0 , / end
"""


def archive(rng):
    """A case file of many rows with all sections, odd lines and either line end."""
    glue = rng.choice(["\n", "\r\n"])
    lines = CASE.splitlines()
    for i in range(4, 18):
        lines += [f"{rng.randrange(1, 999)},'N {i} é',{rng.random():.4f} {rng.choice(['', '/ c', '/'])}" for _ in range(rng.randrange(12))] + ["" for _ in range(rng.randrange(2))] + ["0 / end"]
    if rng.random() < 0.5:
        lines += ["Q", "77,'behind the end'", "0"]
    return glue.join(lines) + rng.choice(["", glue])


@pytest.mark.parametrize("size", [64, 100, 257, 1 << 20])
def test_any_ranges_give_the_same_rows(spark, tmp_path, size):
    rng = random.Random(size)
    for i in range(3):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"c{i}.raw").write_bytes(archive(rng).encode())
    path = str(tmp_path / "in")
    whole = archives.read_case_archive(spark, path)
    names = ("bus", "load", "branch", "area", "owner", "switched_shunt")
    found = ranges.read_case_sections(spark, path, names, size, ranges.section_bounds(spark, path, size))
    for name in names:
        assert sorted(map(str, found[name].collect())) == sorted(map(str, whole[name].collect())), name
    assert whole["bus"].count() == 9 and set(found) == set(names)


def test_lines_of_ranges_are_the_lines_of_the_file(tmp_path):
    rng = random.Random(1)
    for k in range(60):
        text = b"".join(rng.choice([b"a", b"bb\n", b"\n", b"\r\n", b"ccc", "é\n".encode()]) for _ in range(rng.randrange(1, 40)))
        file = tmp_path / f"f{k}"
        file.write_bytes(text)
        parts = ranges.ranges_of(str(file), rng.randrange(1, 12))
        found = [line for p in parts for line in ranges.lines_of(pafs.LocalFileSystem(), p)]
        wanted = [line.removesuffix(b"\r") if i + 1 < len(text.split(b"\n")) else line for i, line in enumerate(text.split(b"\n"))]
        assert found == wanted


def test_many_tasks_and_only_the_ranges_of_a_section(spark, tmp_path):
    rows = "".join(f"{i},'B{i}',69.0,1\n" for i in range(2000))
    (tmp_path / "big.raw").write_text(CASE.split(" 11,")[0] + rows + "0\n" + rows + "0\n5,6,'1',0.5\n0\n")
    bounds = ranges.section_bounds(spark, str(tmp_path), 4096)
    assert len(bounds) > 15
    found = ranges.read_case_sections(spark, str(tmp_path), ("bus", "load", "fixed_shunt", "generator"), 4096, bounds)
    tasks = {name: frame.rdd.getNumPartitions() for name, frame in found.items()}
    assert tasks["bus"] > 6 and tasks["load"] > 6 and tasks["fixed_shunt"] == 1 and tasks["bus"] + tasks["load"] <= len(bounds) + 1
    assert [r.fields for r in found["fixed_shunt"].collect()] == [["5", "6", "'1'", "0.5"]] and found["bus"].count() == found["load"].count() == 2000
    assert found["generator"].count() == 0
    (line,) = {r.line_no for r in found["load"].collect() if r.fields[0] == "0"}
    assert line == 3 + 2000 + 1


def test_header_must_fit(spark, tmp_path):
    (tmp_path / "c.raw").write_text(CASE)
    with pytest.raises(ValueError):
        ranges.section_bounds(spark, str(tmp_path), 16)


def test_case_files_of_zones_are_written_and_read_in_parts(spark, monkeypatch):
    paths, read = [], ranges.read_case_sections
    monkeypatch.setattr(ranges, "read_case_sections", lambda spark, path, names: paths.append(path) or read(spark, path, names))
    found = catalog.queries()["read_case_loads"](spark, "/root/testdata/sf0.001")
    (path,) = paths
    whole = archives.read_case_archive(spark, path)
    assert found.count() == whole["load"].count() > 0
    files = spark.read.text(path).groupBy(F.input_file_name().alias("file")).agg(F.count("value").alias("n"), F.countDistinct("part").alias("zones"))
    assert all(r.zones == 1 and r.n > len(archives.SECTIONS) + 4 for r in files.collect())
    assert files.count() == catalog.Roles(spark, "/root/testdata/sf0.001").bus.select("zone").distinct().count()
