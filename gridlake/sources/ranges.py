"""Large case files read by many tasks: a data source of byte ranges, and a first pass that finds where sections begin.

A line belongs to the range in which it begins. The first pass only counts, for each range, its lines, section ends and whether the file was
quit; a row a range reaches the driver, where they are summed up along each file. So the second pass knows every line's number and
section by itself, needs no shuffle and no window, and leaves out ranges that hold nothing of the sections that are asked for.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from gridlake.sources.archives import HEADER_LINES, SECTIONS, fields_of

RANGE_BYTES = 64 << 20
_FORMAT = "case_ranges"
_READ = 1 << 20
_ROWS = 4096
_COMMENT = re.compile(r"""^((?:[^'"/]|'[^']*'|"[^"]*")*)/.*$""", re.S)
_END, _NO_END = re.compile(r"0\s*(,.*)?"), re.compile(r"0\s*,\s*\S")


class Bound(NamedTuple):
    file: str
    start: int
    stop: int
    lines: int  # of the file before the range
    ends: int
    last: int


class Range(InputPartition):
    def __init__(self, file: str, start: int, stop: int, lines: int = 0, ends: int = 0) -> None:
        super().__init__((file, start))
        self.file, self.start, self.stop, self.lines, self.ends = file, start, stop, lines, ends


def _system(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(path)


def ranges_of(path: str, size: int) -> list[Range]:
    """Ranges of about ``size`` bytes of all files below ``path``; names that begin with _ or . are no data."""
    system, place = _system(path)
    info = system.get_file_info(place)
    found = [info] if info.type == pafs.FileType.File else system.get_file_info(pafs.FileSelector(place, recursive=True))
    files = sorted((f.path, f.size) for f in found if f.type == pafs.FileType.File and not f.base_name.startswith(("_", ".")))
    return [Range(name, at, min(at + size, total)) for name, total in files for at in range(0, total, size)]


def lines_of(system: pafs.FileSystem, part: Range) -> Iterator[bytes]:
    """Lines that begin in the range, without their ends. Text after the last end of a line is a line, an empty one too, as splitting would give it."""
    with system.open_input_file(part.file) as f:
        total, at = f.size(), part.start  # at: where the next line begins
        skipping = False
        if at:
            f.seek(at - 1)
            skipping = f.read(1) != b"\n"
        f.seek(at)
        rest, place = b"", 0
        while at < part.stop:
            cut = rest.find(b"\n", place)
            if cut < 0:
                more = f.read(_READ)
                if more:
                    rest, place = rest[place:] + more, 0
                    continue
                if not skipping:
                    yield rest[place:]
                return
            if not skipping:
                yield rest[place:cut].removesuffix(b"\r")
            skipping = False
            at, place = at + cut + 1 - place, cut + 1
        if at == total == part.stop > part.start:
            yield b""  # behind the end of the last line


def _kind(line: str) -> str:
    """end, quit or empty for a line without its comment (and blanks), else row."""
    if _END.fullmatch(line) and not _NO_END.match(line):
        return "end"
    return "quit" if line.upper() == "Q" else "row" if line else "empty"


class CaseRanges(DataSource):
    """``format("case_ranges")``: counts of ranges, or with the option ``plan`` (ranges with what is before them) their rows of some sections."""

    @classmethod
    def name(cls) -> str:
        return _FORMAT

    def schema(self) -> str:
        return "file string, line_no int, section int, line string" if "plan" in self.options else "file string, start long, stop long, lines long, ends long, quit boolean"

    def reader(self, schema: object) -> DataSourceReader:
        return _RangeReader(dict(self.options))


class _RangeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.plan = options["path"], json.loads(options["plan"]) if "plan" in options else None
        self.size, self.wanted = int(options.get("rangebytes", options.get("rangeBytes", RANGE_BYTES))), set(json.loads(options.get("sections", "[]")))

    def partitions(self) -> Sequence[InputPartition]:
        return ranges_of(self.path, self.size) if self.plan is None else [Range(*p) for p in self.plan]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        system, _ = _system(self.path)
        return self._counted(system, partition) if self.plan is None else self._rows(system, partition)

    def _judged(self, system: pafs.FileSystem, part: Range) -> Iterator[tuple[str, str]]:
        for raw in lines_of(system, part):
            line = raw.decode()
            found = _COMMENT.match(line)
            bare = (found.group(1) if found else line).strip(" ")
            yield bare, _kind(bare)

    def _counted(self, system: pafs.FileSystem, part: Range) -> Iterator[pa.RecordBatch]:
        lines = ends = 0
        over = False
        for i, (_, kind) in enumerate(self._judged(system, part)):
            lines += 1
            if part.start == 0 and i < HEADER_LINES:
                continue
            ends += kind == "end"
            over |= kind == "quit"
        yield pa.RecordBatch.from_pylist([{"file": part.file, "start": part.start, "stop": part.stop, "lines": lines, "ends": ends, "quit": over}])

    def _rows(self, system: pafs.FileSystem, part: Range) -> Iterator[pa.RecordBatch]:
        out, ends = [], part.ends
        for i, (line, kind) in enumerate(self._judged(system, part), part.lines):
            if i < HEADER_LINES:
                continue
            if kind == "quit":
                break
            if kind == "row" and ends in self.wanted:
                out.append((f"file://{part.file}" if part.file.startswith("/") else part.file, i, ends, line))
            ends += kind == "end"
            if len(out) >= _ROWS:
                yield self._batch(out)
                out = []
        yield self._batch(out)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        names, kinds = ("file", "line_no", "section", "line"), (pa.string(), pa.int32(), pa.int32(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=list(names))


def section_bounds(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> list[Bound]:
    """All ranges below ``path`` with the lines and section ends of their file before them, and the section at their end; those behind a Q are left out. One pass over the files.

    The header's lines must lie in the first range of a file, so ``range_bytes`` must be longer than they are."""
    spark.dataSource.register(CaseRanges)
    counts = spark.read.format(_FORMAT).option("rangeBytes", str(range_bytes)).load(path).collect()  # a row a range
    out, file, lines, ends, over = [], None, 0, 0, False
    for r in sorted(counts, key=lambda r: (r["file"], r["start"])):
        if r["file"] != file:
            if r["lines"] < HEADER_LINES and r["stop"] - r["start"] == range_bytes:
                raise ValueError(f"{range_bytes} bytes don't hold the header of {r['file']}")
            file, lines, ends, over = r["file"], 0, 0, False
        if not over:
            out.append(Bound(file, r["start"], r["stop"], lines, ends, ends + r["ends"]))
        lines, ends, over = lines + r["lines"], ends + r["ends"], over or r["quit"]
    return out


def read_case_sections(spark: SparkSession, path: str, sections: Sequence[str] = SECTIONS, range_bytes: int = RANGE_BYTES, bounds: list[Bound] | None = None) -> dict[str, DataFrame]:
    """The rows (file, line_no, fields) that ``read_case_archive`` gives, of some sections, with files of any size read by many tasks.

    Only ranges that reach into a section are read for it. ``bounds``, if given, are those of ``section_bounds``, so that several calls share its pass."""
    bounds = section_bounds(spark, path, range_bytes) if bounds is None else bounds
    spark.dataSource.register(CaseRanges)
    out = {}
    for name in sections:
        i = SECTIONS.index(name)
        plan = [(p.file, p.start, p.stop, p.lines, p.ends) for p in bounds if p.ends <= i <= p.last]
        if not plan:
            out[name] = spark.createDataFrame([], "file string, line_no int, fields array<string>")
            continue
        rows = spark.read.format(_FORMAT).option("plan", json.dumps(plan)).option("sections", json.dumps([i])).load(path)
        out[name] = rows.select("file", "line_no", fields_of(F.col("line")).alias("fields"))
    return out
