"""Nested case files parse to the rows they were written from."""

import json
import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gridlake.sources import nested


def read(path):
    out = {}
    for name in sorted(os.listdir(path)):
        if name.startswith("part-"):
            with open(f"{path}/{name}") as lines:
                for line in lines:
                    case = json.loads(line)
                    assert case["event_idx"] not in out
                    out[case["event_idx"]] = case
    return out


@pytest.fixture(scope="module")
def tables(spark):
    cases = spark.createDataFrame([(1, 'A "quoted" }}', "Line", True, False, True, 4), (2, "B", "Generator", False, True, False, None), (7, "C", "Line", None, None, True, 1)], "event_idx int, name string, type string, has_voltage_violation boolean, has_branch_violation boolean, converged boolean, iterations int")
    buses = spark.createDataFrame([(e, b, b / 8) for e in (1, 2, 9) for b in range(40, -1, -1)], "event_idx int, bus_id long, v_pu double")
    branches = spark.createDataFrame([(e, a, a + 1, c, None if a == 3 else 1.5) for e in (2, 7, 9) for a in range(12) for c in "21"], "event_idx int, from_bus long, to_bus long, ckt string, p double")
    generators = spark.createDataFrame([(2, 5, "x"), (2, 4, "],[}")], "event_idx int, bus_id long, gen_id string")
    return cases, {"buses": (buses, ["bus_id", None, None]), "branches": (branches, ["from_bus", "to_bus", "ckt"]), "generators": (generators, ["bus_id", None, "gen_id"])}


def test_cases_parse_to_their_rows(spark, tables, tmp_path):
    cases, rest = tables
    path = str(tmp_path / "cases")
    for _ in range(2):  # writing again takes the place of what was there
        nested.write_cases(cases, rest, path)
    found = read(path)
    assert sorted(found) == [1, 2, 7] and os.path.exists(f"{path}/_SUCCESS") and not [n for n in os.listdir(path) if n.startswith("_attempts")]
    for e, case in found.items():
        head = next(r.asDict() for r in cases.collect() if r.event_idx == e)
        assert {k: head[k] for k in ("name", "type")} == {k: case[k] for k in ("name", "type")}
        assert case.get("has_branch_violation") == head["has_branch_violation"] and case["solution"]["convergence"].get("iterations") == head["iterations"]
        for name, (table, keys) in rest.items():
            wanted = [{k: v for k, v in r.asDict().items() if k != "event_idx" and v is not None} for r in table.where(F.col("event_idx") == e).orderBy(*[k for k in keys if k]).collect()]
            assert case["solution"][name] == wanted
    again = spark.read.schema("event_idx long, solution struct<buses: array<struct<bus_id: long>>>").json(path)
    assert {r.event_idx: len(r.solution.buses) for r in again.collect()} == {1: 41, 2: 41, 7: 0}


def test_empty_tables_write_no_cases(spark, tables, tmp_path):
    cases, rest = tables
    nested.write_cases(cases.where("false"), rest, str(tmp_path / "none"))
    assert read(tmp_path / "none") == {}


def test_objects_go_on_over_batches(tmp_path):
    """However the rows are cut into batches, the same text comes out, and a batch is all that is held."""
    rows = [(1, 0, '{"event_idx":1,"solution":{"convergence":{}}}'), *[(1, 2, f'{{"n":{i}}}') for i in range(5)], (2, 0, '{"event_idx":2,"solution":{"convergence":{}}}'), (3, 1, '{"lost":1}'), (4, 0, '{"event_idx":4,"solution":{"convergence":{}}}'), (4, 1, '{"n":1}'), (4, 3, '{"n":2}')]
    texts = set()
    for size in (1, 2, 3, 100):
        writer = nested._CaseWriter(f"file://{tmp_path}/{size}", ["a", "b", "c"], True)
        batches = [pa.RecordBatch.from_pylist([dict(zip(("event_idx", "section", "piece"), r, strict=True)) for r in rows[i : i + size]]) for i in range(0, len(rows), size)]
        message = writer.write(iter(batches))
        assert message.cases == 3
        writer.commit([message, None])
        texts.add((tmp_path / str(size) / message.file).read_text())
    assert len(texts) == 1
    found = [json.loads(line) for line in texts.pop().splitlines()]
    assert [len(f["solution"][k]) for f in found for k in "abc"] == [0, 5, 0, 0, 0, 0, 1, 0, 1]


def test_failed_writes_leave_nothing(tmp_path):
    writer = nested._CaseWriter(str(tmp_path), ["a"], True)
    message = writer.write(iter([pa.RecordBatch.from_pylist([{"event_idx": 1, "section": 0, "piece": '{"event_idx":1,"solution":{"convergence":{}}}'}])]))
    assert message.cases == 1
    writer.abort([message])
    assert not [n for n in os.listdir(tmp_path) if n.startswith(("part-", "_attempts"))]


@pytest.mark.parametrize("stretch", [1, 200, 1 << 20])
def test_r04_f8_lines_and_items_are_read_by_stretches(spark, tables, tmp_path, monkeypatch, stretch):
    """Pieces strung together are the lines."""
    monkeypatch.setattr(nested, "STRETCH", stretch)
    cases, rest = tables
    path = str(tmp_path / "cases")
    nested.write_cases(cases, rest, path)
    texts = {json.loads(line)["event_idx"]: line.rstrip("\n") for n in os.listdir(path) if n.startswith("part-") for line in open(f"{path}/{n}")}
    pieces = nested.read_lines(spark, path).collect()
    assert len({(r.event_idx, r.nth) for r in pieces}) == len(pieces)
    assert {e: "".join(r.json for r in sorted(pieces, key=lambda r: r.nth) if r.event_idx == e) for e in texts} == texts
    assert {r.event_idx: (r.nth, r.json) for r in nested.read_lines(spark, path, 1 << 20).collect()} == {e: (0, t) for e, t in texts.items()}
    for i, (name, kind) in enumerate((("buses", "bus_id long, v_pu double"), ("branches", "from_bus long, to_bus long, ckt string, p double"), ("generators", "bus_id long, gen_id string")), 1):
        wanted = [(e, *[item.get(f.split()[0]) for f in kind.split(", ")]) for e, t in texts.items() for item in json.loads(t)["solution"][name]]
        assert sorted(map(str, map(tuple, nested.read_items(spark, path, i, kind).collect()))) == sorted(map(str, wanted))
    heads = nested.read_items(spark, path, 0, "event_idx long, name string").collect()
    assert sorted(map(tuple, heads)) == [(e, json.loads(texts[e])["name"]) for e in sorted(texts)]
