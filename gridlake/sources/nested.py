"""Nested case files: one JSON object a scenario, written row by row, so a scenario may have any number of circuits.

Every row becomes a piece of JSON in Spark; pieces are dealt by scenario and sorted inside the tasks by scenario, section and key. A
data-source writer then strings them together: it holds a batch of pieces and where it is in the object, never a whole scenario. Tasks write
to a folder of their own attempts; the driver moves what they report when all have ended, so lost or repeated tasks leave nothing behind.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

SECTIONS = ("buses", "branches", "generators")
_FORMAT = "nested_cases"
#: Bytes of a stretch of a line, after which the writer begins another.
STRETCH = 4_000_000
_INDEX = "event_idx long, nth long, section int, file string, start long, size long, bare long"


@dataclass
class _Written(WriterCommitMessage):
    file: str | None
    cases: int


class NestedCases(DataSource):
    """``format("nested_cases")``: writes rows (event_idx, section, piece), sorted so within partitions, to JSON lines below the path. Section 0 holds
    the object's own fields, section i the items of the i-th array of the option ``sections``."""

    @classmethod
    def name(cls) -> str:
        return _FORMAT

    def writer(self, schema: object, overwrite: bool) -> DataSourceArrowWriter:
        return _CaseWriter(self.options["path"], self.options["sections"].split(","), overwrite)


def _shared(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system that all tasks and the driver share, and the folder in it."""
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(path)


def _index_of(file: str) -> str:
    return f"_index/{file}"


class _Stretches:
    """Writes a file and the index of its stretches. ``bare`` is where the items (or the head) of a stretch begin, behind the glue before them."""

    def __init__(self, out: pa.NativeFile, index: pa.NativeFile, file: str) -> None:
        self.out, self.index, self.file, self.at, self.nth = out, index, file, 0, 0
        self.open: dict[str, object] | None = None

    def _write(self, text: str) -> None:
        data = text.encode()
        self.out.write(data)
        self.at += len(data)

    def glue(self, text: str) -> None:
        """What belongs to no item; it ends a stretch."""
        self.end()
        start = self.at
        self._write(text)
        self._note({"section": None, "start": start, "size": self.at - start, "bare": None})

    def put(self, event: int, section: int, glue: str, text: str) -> None:
        if self.open and (self.open["event_idx"] != event or self.open["section"] != section or self.at - self.open["start"] >= STRETCH):
            self.end()
        if self.open is None:
            self.nth = 0 if section == 0 else self.nth
            self.open = {"event_idx": event, "section": section, "start": self.at, "bare": self.at + len(glue.encode())}
        self._write(glue + text)

    def end(self) -> None:
        if self.open:
            found, self.open = self.open, None
            self.event = found.pop("event_idx")
            self._note(found | {"size": self.at - found["start"]})

    def _note(self, found: dict[str, object]) -> None:
        row = {"event_idx": self.event, "nth": self.nth, "file": self.file} | found
        self.nth += 1
        self.index.write((json.dumps(row) + "\n").encode())


class _CaseWriter(DataSourceArrowWriter):
    def __init__(self, path: str, sections: list[str], overwrite: bool) -> None:
        self.path, self.sections, self.overwrite, self.attempt = path, sections, overwrite, uuid.uuid4().hex

    def _folder(self) -> tuple[pafs.FileSystem, str]:
        return _shared(self.path)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        system, folder = self._folder()
        batches = (b for b in iterator if len(b))
        first = next(batches, None)
        if first is None:
            return _Written(None, 0)
        name = f"part-{uuid.uuid4().hex}.json"
        attempts = f"{folder}/_attempts-{self.attempt}"
        system.create_dir(f"{attempts}/_index", recursive=True)
        with system.open_output_stream(f"{attempts}/{name}") as out, system.open_output_stream(f"{attempts}/{_index_of(name)}") as index:
            stretches = _Stretches(out, index, name)
            cases = self._string(first, batches, stretches)
            stretches.end()
        return _Written(name, cases)

    def _string(self, first: pa.RecordBatch, batches: Iterator[pa.RecordBatch], out: _Stretches) -> int:
        event, at, cases = None, 0, 0  # the open object, and the section that is being written
        batch: pa.RecordBatch | None = first
        while batch is not None:
            events, sections = batch.column("event_idx").to_pylist(), batch.column("section").to_pylist()
            pieces = batch.column("piece").to_pylist()
            i = 0
            while i < len(events):
                j = i
                while j < len(events) and events[j] == events[i] and sections[j] == sections[i]:
                    j += 1
                if sections[i] == 0:
                    if event is not None:
                        out.glue(self._up_to(at, len(self.sections) + 1) + "}}\n")
                    event, at, cases = events[i], 0, cases + 1
                    out.put(event, 0, "", pieces[i].removesuffix("}}"))  # its last field is the object of arrays
                elif event == events[i]:  # rows of a scenario without a head are left out
                    glue = "," if sections[i] == at else self._up_to(at, sections[i])
                    at = sections[i]
                    out.put(event, at, glue, ",".join(pieces[i:j]))
                i = j
            batch = next(batches, None)
        if event is not None:
            out.glue(self._up_to(at, len(self.sections) + 1) + "}}\n")
        return cases

    def _up_to(self, at: int, to: int) -> str:
        """What closes section ``at`` and opens all up to ``to``; those between are empty."""
        out = "]" if at else ""
        for i in range(at + 1, min(to, len(self.sections)) + 1):
            out += f',"{self.sections[i - 1]}":[' + ("]" if i < to else "")
        return out

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        system, folder = self._folder()
        attempts = f"{folder}/_attempts-{self.attempt}"
        if self.overwrite:
            for info in [i for f in (folder, f"{folder}/_index") for i in system.get_file_info(pafs.FileSelector(f, allow_not_found=True))]:
                if info.base_name.startswith("part-"):
                    system.delete_file(info.path)
        system.create_dir(f"{folder}/_index", recursive=True)
        for m in messages:
            if m is not None and m.file:
                for name in (m.file, _index_of(m.file)):
                    system.move(f"{attempts}/{name}", f"{folder}/{name}")
        self._clear(system, attempts)
        with system.open_output_stream(f"{folder}/_SUCCESS"):
            pass

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        system, folder = self._folder()
        self._clear(system, f"{folder}/_attempts-{self.attempt}")

    @staticmethod
    def _clear(system: pafs.FileSystem, attempts: str) -> None:
        if system.get_file_info(attempts).type == pafs.FileType.Directory:
            system.delete_dir(attempts)


def write_cases(convergence: DataFrame, tables: dict[str, tuple[DataFrame, list[str | None]]], path: str) -> None:
    """Writes one JSON object a line for each row of ``convergence`` (event_idx, name, type, flags, converged, iterations and more).

    An object has event_idx, name, type, has_voltage_violation and has_branch_violation (if there), and solution: convergence (the other columns) and
    an array for each of ``tables``: name -> (rows with event_idx, [number key, number key, text key]), in order of these keys (None: there
    is none). Nulls are left out of objects. Rows of events without a convergence row are left out, arrays without rows are empty. Events must be
    numbered; a repeated convergence row would open the object anew, so event_idx must be unique there.
    """
    spark = convergence.sparkSession
    spark.dataSource.register(NestedCases)
    front = [c for c in ("event_idx", "name", "type", "has_voltage_violation", "has_branch_violation") if c in convergence.columns]
    solved = F.struct(*[c for c in convergence.columns if c not in front])
    number, word = F.lit(None).cast("long"), F.lit(None).cast("string")
    rows = convergence.select(F.col("event_idx").cast("long").alias("event_idx"), F.lit(0).alias("section"), number.alias("k1"), number.alias("k2"), word.alias("k3"), F.to_json(F.struct(*front, F.struct(solved.alias("convergence")).alias("solution"))).alias("piece"))
    for i, (table, keys) in enumerate(tables.values(), 1):
        k1, k2, k3 = [F.col(k).cast(kind) if k else F.lit(None).cast(kind) for k, kind in zip(keys, ("long", "long", "string"), strict=True)]
        rest = [c for c in table.columns if c != "event_idx"]
        rows = rows.union(table.select(F.col("event_idx").cast("long"), F.lit(i), k1, k2, k3, F.to_json(F.struct(*rest))))
    dealt = rows.repartition("event_idx").sortWithinPartitions("event_idx", "section", "k1", "k2", "k3", "piece")
    dealt.select("event_idx", "section", "piece").write.format(_FORMAT).option("sections", ",".join(tables)).mode("overwrite").save(path)


def _index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_INDEX).json(f"{path}/_index")


def _dealt(rows: DataFrame) -> DataFrame:
    """Few stretches a task."""
    return rows.repartition(max(-(-rows.count() // 16), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "file", "start")


def _texts(rows: DataFrame, path: str, start: str) -> DataFrame:
    """``rows`` of the index with the texts of their stretches from the offset ``start`` on."""
    end = F.col("start") + F.col("size")
    rows = rows.select(*[c for c in rows.columns if c not in ("file", "start", "size", "bare")], F.col("file").alias("_file"), F.col(start).alias("_start"), (end - F.col(start)).alias("_size"))
    own = [c for c in rows.columns if not c.startswith("_")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = _shared(path)
        for batch in batches:
            for i, (file, at, size) in enumerate(zip(*[batch.column(c).to_pylist() for c in ("_file", "_start", "_size")], strict=True)):
                with system.open_input_file(f"{folder}/{file}") as found:
                    text = found.read_at(size, at).decode()
                yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(i, 1) for c in own], pa.array([text])], names=[*own, "text"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in own)
    return rows.mapInArrow(run, f"{kinds}, text string")


def read_lines(spark: SparkSession, path: str, size: int = 0) -> DataFrame:
    """(event_idx, nth, json): the lines that ``write_cases`` has written, line ends left out; a line of more than a stretch in several pieces, which give it
    strung together in order of nth. Pieces of lines of up to ``size`` bytes are put together."""
    index = _index(spark, path)
    whole = index.groupBy("event_idx", "file").agg(F.min("start").alias("start"), F.sum("size").alias("size")).where(F.col("size") <= size)
    short = whole.select("event_idx", F.lit(0).cast("long").alias("nth"), "file", "start", "size", F.lit(None).cast("long").alias("bare"))
    long = index.join(whole.select("event_idx", "file"), ["event_idx", "file"], "left_anti")
    found = short.unionByName(long.drop("section"))
    return _texts(_dealt(found), path, "start").select("event_idx", "nth", F.rtrim("text", F.lit("\n")).alias("json"))


def read_items(spark: SparkSession, path: str, section: int, kind: str) -> DataFrame:
    """(event_idx, fields of ``kind``): the items of the n-th array of all cases, parsed stretch by stretch; section 0 are the heads, as structs of ``kind``."""
    rows = _texts(_dealt(_index(spark, path).where(F.col("section") == section)), path, "bare")
    if section == 0:
        return rows.select(F.from_json(F.concat("text", F.lit("}}")), kind).alias("head")).select("head.*")
    return rows.select("event_idx", F.inline(F.from_json(F.concat(F.lit("["), F.col("text"), F.lit("]")), f"array<struct<{kind}>>")))
