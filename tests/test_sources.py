from pyspark.sql import functions as F

from gridlake.functions import exprs
from gridlake.operators import electrical
from gridlake.sources import archives, lists, sinks

CASE = """0, 50.0, 33, 0, 1, 60.0 / a case
title one
title, two
11,'North, A', 220.0,3,1,1,1,1.02,0.0
12,'South   ', 220.0,1,1,2,1,0.99,-3.25 / a comment
13,'East', 33.0,1,2,2,1,1.01,-1.5
0 / end of bus data
12,'1 ',1,1,1,40.5,9.25,0,0,0,0
0 / end of load data
13,'1',1,0.5,12.5
0 / end of fixed shunt data
11,'1',80.25,-4.5,30,-20,1.02,0,100,0,1,0,0,1,1,75,120,10
0 / end of generator data
11,12,'1 ',0.011,0.07,0.03,90,95,105,0,0,0,0,1
11,12,'2 ',0.012,0.08,0.03,0,0,0,0,0,0,0,0
0 / end of branch data
12,13,0,'1 ',1,2,1,0,0,2,'TWO WINDING ',1,1,1
0.02,0.12,25
0.97,0,4.5,60,65,70
1.01,0
11,12,13,'T ',1,2,1,0,0,2,'THREE',1,1,1
0.1,0.3,50,0.2,0.4,50,0.3,0.5,25,1.003,-2.5
1,0,0
1,0,0
1,0,0
0 / end of transformer data
1,11,5.5,1.25,'AREA ONE'
0 / end of area data
0 / two terminal
0 / vsc
0 / impedance correction
0 / multi terminal
0 / multi section
2,'ZONE TWO'
0 / zone
1,2,'A',15.5
0 / inter area
1,'OWNER'
0 / owner
0 / facts
13,1,0,1,1.05,0.95,12,100,' ',7.5,2,2.5,1,2.5
0 / switched shunt
Q
"""


def test_case_archive(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"c{i}.raw").write_text(CASE)
    tables = archives.read_case_archive(spark, str(tmp_path))
    assert list(tables) == list(archives.SECTIONS)
    bus = archives.bus_table_of(tables["bus"]).orderBy("file", "bus_id").collect()
    assert len(bus) == 9 and bus[0].name == "North, A" and bus[1].angle_deg == -3.25
    branch = archives.branch_table_of(tables["branch"]).collect()
    assert sorted({(b.from_bus, b.to_bus, b.ckt, b.status) for b in branch}) == [(11, 12, "1", 1), (11, 12, "2", 0)]
    assert tables["load"].count() == 3 and tables["vsc"].count() == 0 and tables["transformer"].count() == 27


def test_typed_sections_and_transformers(spark, tmp_path):
    for i in range(2):
        (tmp_path / f"c{i}.raw").write_text(CASE)
    tables = archives.read_case_archive(spark, str(tmp_path))
    one = lambda name: {tuple(r)[1:] for r in archives.typed_section(tables, name).collect()}
    assert one("load") == {(12, "1", 1, 1, 1, 40.5, 9.25, 0.0, 0.0, 0.0, 0.0)}
    assert one("generator") == {(11, "1", 80.25, -4.5, 30.0, -20.0, 1.02, 0, 100.0, 1, 75.0, 120.0, 10.0)}
    assert one("fixed_shunt") == {(13, "1", 1, 0.5, 12.5)} and one("area") == {(1, 11, 5.5, 1.25, "AREA ONE")}
    assert one("zone") == {(2, "ZONE TWO")} and one("owner") == {(1, "OWNER")} and one("inter_area") == {(1, 2, "A", 15.5)}
    (shunt,) = {(r.bus_id, r.status, r.binit, tuple((s.n, s.b) for s in r.steps)) for r in archives.typed_section(tables, "switched_shunt").collect()}
    assert shunt == (13, 1, 7.5, ((2, 2.5), (1, 2.5)))
    two, three = archives.transformer_tables_of(tables["transformer"], sbase=50.0)
    assert {tuple(r)[1:] for r in two.collect()} == {(12, 13, "1", 0.02 * (50 / 25 * 1.01 * 1.01), 0.12 * (50 / 25 * 1.01 * 1.01), 60.0, 65.0, 70.0, 0.97 / 1.01, 4.5, 1)}
    stars, branches = archives.expand_three_winding(three, archives.typed_section(tables, "bus"), sbase=50.0)
    assert sorted(tuple(r)[1:] for r in stars.collect()) == [(14, "DUMMY_BUS-11-12-13", 1, 1, 1.003, -2.5)] * 2
    found = {(r.from_bus, r.to_bus, round(r.r, 6), round(r.x, 6)) for r in branches.collect()}
    assert found == {(11, 14, 0.25, 0.45), (12, 14, -0.15, -0.15), (13, 14, 0.35, 0.55)} and branches.count() == 6


def test_unit_codes_of_transformers(spark, tmp_path):
    """CZ 1: r and x are on the system base already; CW 2: ratios are voltages over the nominal ones."""
    head = CASE.split("12,13,0,'1 ',1,2")[0]
    two = lambda ckt, cw, cz, base, v1, v2: f"12,13,0,'{ckt}',{cw},{cz},1,0,0,2,'T',1\n0.02,0.1,{base}\n{v1},60,65,70\n{v2}\n"
    (tmp_path / "t.raw").write_text(head + two("a", 1, 1, 25, "1.05,0,0", "1,0") + two("b", 1, 2, 25, "1,0,0", "1,0") + two("c", 2, 1, 25, "231,220,0", "33,33") + two("d", 2, 2, 0, "220,220,0", "34.65,33") + two("e", 1, 2, 50, "1,0,0", "1.1,0") + "0\n")
    found, _ = archives.transformer_tables_of(archives.read_case_archive(spark, str(tmp_path))["transformer"], sbase=50.0)
    assert {r.ckt: (round(r.r, 9), round(r.x, 9), round(r.tap, 9)) for r in found.collect()} == {"a": (0.02, 0.1, 1.05), "b": (0.04, 0.2, 1.0), "c": (0.02, 0.1, 1.05), "d": (0.02205, 0.11025, round(1 / 1.05, 9)), "e": (0.0242, 0.121, round(1 / 1.1, 9))}


def test_windings_keep_taps_ratings_and_status(spark):
    names = ["tap", "shift_deg", "rate_a", "rate_b", "rate_c"]
    row = (1, 2, 3, "1", *[0.1, 0.3, 100.0] * 3, 2, 0.01, -0.02, *[10.0 * i + j for i in (1, 2, 3) for j in range(5)])
    schema = "bus_i long, bus_j long, bus_k long, ckt string, r12 double, x12 double, sb12 double, r23 double, x23 double, sb23 double, r31 double, x31 double, sb31 double, stat int, g1 double, b1 double, " + ", ".join(f"{n}{i} double" for i in (1, 2, 3) for n in names)
    rows = [row, (*row[:13], 0, *row[14:]), (*row[:13], 4, *row[14:])]
    bus = spark.createDataFrame([(i, 7, 9) for i in (1, 2, 3)], "bus_id long, area int, owner int")
    stars, branches = archives.expand_three_winding(spark.createDataFrame(rows, schema), bus)
    found = sorted(((r.to_bus, r.from_bus, r.status, r.g1, r.b1, *[r[n] for n in names]) for r in branches.collect()))
    ends = {i: tuple(10.0 * i + j for j in range(5)) for i in (1, 2, 3)}
    wanted = [(star, i, int(i != out), 0.01 if i == 1 else 0.0, -0.02 if i == 1 else 0.0, *ends[i]) for star, out in ((4, 2), (5, 1)) for i in (1, 2, 3)]
    assert stars.count() == 2 and sorted(w[1:] for w in wanted) == sorted(f[1:] for f in found)


def test_three_windings(spark):
    t = spark.createDataFrame([(1, 2, 3, "1", 0.1, 0.3, 100.0, 0.2, 0.4, 100.0, 0.3, 0.5, 50.0)], "bus_i long, bus_j long, bus_k long, ckt string, r12 double, x12 double, sb12 double, r23 double, x23 double, sb23 double, r31 double, x31 double, sb31 double")
    bus = spark.createDataFrame([(1, 7, 9), (2, 8, 9), (3, 8, 9)], "bus_id long, area int, owner int")
    stars, branches = archives.expand_three_winding(t, bus)
    assert [tuple(r) for r in stars.collect()] == [(4, "DUMMY_BUS-1-2-3", 7, 9, 1.0, 0.0)]
    found = {r.from_bus: (round(r.r, 6), round(r.x, 6)) for r in branches.collect()}
    assert found == {1: (0.25, 0.45), 2: (-0.15, -0.15), 3: (0.35, 0.55)}


def test_dynamic_archive_and_bus_table(spark, tmp_path):
    (tmp_path / "a.dyr").write_text("// comment\n1 'GENROU' '1 ' 6.5 0.06\n 0.2 /\n2, 'X', 'A', 1 / tail\n")
    rows = sorted(tuple(r)[1:] for r in archives.read_dynamic_archive(spark, str(tmp_path / "a.dyr")).collect())
    assert rows == [(1, "GENROU", "1", [6.5, 0.06, 0.2]), (2, "X", "A", [1.0])]
    (tmp_path / "t.txt").write_text("# head\n5 1 1.5 2.5\n6 2 3.5 x\n\n")
    assert sorted(tuple(r) for r in archives.read_bus_table(spark, str(tmp_path / "t.txt")).collect()) == [(5, "1", 0, 1.5), (5, "1", 1, 2.5), (6, "2", 0, 3.5), (6, "2", 1, None)]


def test_series_and_logs(spark, tmp_path):
    (tmp_path / "s.csv").write_text("time-3,ang-11,ang-12\n0.0,1,2\n0.5,3,4\n1.0,5,6\n")
    rows, stats = archives.read_series_wide(spark, str(tmp_path / "s.csv"))
    assert sorted(tuple(r) for r in rows.collect())[:2] == [(11, 0.0, 1.0), (11, 0.5, 3.0)]
    assert stats.first().delta_t == 0.5
    (tmp_path / "x.log").write_text("Timing statistics for: Total\n   Average time:    1.5\n   Maximum time:    2.0\nTiming statistics for: Read\n   Average time: 0.25\nNumber of tasks executed on process 3: 17\n")
    timers, tasks = archives.read_run_logs(spark, str(tmp_path / "x.log"))
    assert sorted((r.timer, r.stat, r.seconds) for r in timers.collect()) == [("Read", "average", 0.25), ("Total", "average", 1.5), ("Total", "maximum", 2.0)]
    assert [(r.rank, r.tasks) for r in tasks.collect()] == [(3, 17)]


def test_xml_lists(spark, tmp_path):
    (tmp_path / "m.xml").write_text(
        "<Measurements><Measurement><Type>VM</Type><Bus>1</Bus><Value>1.0</Value><Deviation>0.01</Deviation></Measurement>"
        "<Measurement><Type>PIJ</Type><FromBus>1</FromBus><ToBus>2</ToBus><CKT>B1 </CKT><Value>0.5</Value><Deviation>0.02</Deviation></Measurement>"
        "<Measurement><Type>ZZ</Type><Bus>1</Bus><Value>1</Value><Deviation>1</Deviation></Measurement></Measurements>"
    )
    assert sorted((r.type, r.bus_id, r.from_bus, r.ckt) for r in lists.read_measurements(spark, str(tmp_path / "m.xml")).collect()) == [("PIJ", None, 1, "B1"), ("VM", 1, None, None)]
    (tmp_path / "c.xml").write_text(
        "<C><Contingency><contingencyType>Line</contingencyType><contingencyName>L1</contingencyName><contingencyLineBuses>1 2 3 4</contingencyLineBuses><contingencyLineNames>X Y</contingencyLineNames><CKT>B1 B2</CKT></Contingency>"
        "<Contingency><contingencyType>Line</contingencyType><contingencyName>bad</contingencyName><contingencyLineBuses>1 2 3</contingencyLineBuses><CKT>B1 B2</CKT></Contingency>"
        "<Contingency><contingencyType>Generator</contingencyType><contingencyName>G1</contingencyName><contingencyBuses>7</contingencyBuses><contingencyGenerators>1</contingencyGenerators></Contingency></C>"
    )
    found = sorted((r.name, r.pos, r.from_bus, r.to_bus, r.ckt, r.bus_id, r.gen_id) for r in lists.read_contingencies(spark, str(tmp_path / "c.xml")).collect())
    assert found == [("G1", 0, None, None, None, 7, "1"), ("L1", 0, 1, 2, "B1", None, None), ("L1", 1, 3, 4, "B2", None, None)]
    (tmp_path / "f.xml").write_text("<F><faultEvent><beginFault>1.0</beginFault><endFault>1.1</endFault><faultBranch>6 7</faultBranch><timeStep>0.005</timeStep></faultEvent><faultEvent><beginFault>1</beginFault><endFault>0</endFault><faultBranch>6 7</faultBranch><timeStep>0.1</timeStep></faultEvent></F>")
    assert [(r.from_bus, r.to_bus) for r in lists.read_fault_events(spark, str(tmp_path / "f.xml")).collect()] == [(6, 7)]
    (tmp_path / "mon.csv").write_text("# c\nfrom,to,ckt\n1,2,'1 '\r\n\n3,4,B\n")
    assert sorted(tuple(r) for r in lists.read_monitor_list(spark, str(tmp_path / "mon.csv")).collect()) == [(1, 2, "1"), (3, 4, "B")]


def test_writers(spark, tmp_path):
    rows = spark.createDataFrame([(0, 1.234567), (300, 2.0)], "event_idx int, p double")
    sinks.write_flat(rows, str(tmp_path / "flat"))
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "flat")).select("event_idx", "p", "event_bucket").collect()) == [(0, 1.2346, 0), (300, 2.0, 1)]
    sinks.write_results({"buses": rows.withColumn("contingency", F.lit("base"))}, str(tmp_path / "set"))
    assert spark.read.csv(str(tmp_path / "set/buses"), header=True).columns == ["contingency", "event_idx", "p"]


def test_tags_and_quotes(spark):
    raw = spark.createDataFrame([(" '1 ' ",), ('"A B"',), ("x",), (None,)], "s string")
    assert [r[0] for r in raw.select(exprs.canonical_tag(F.col("s"))).collect()] == ["1", "A", "x", None]
    assert raw.limit(1).select(exprs.csv_field(F.lit('a"b'))).first()[0] == '"a""b"'


def test_reactive_basis_is_chosen_anew(spark):
    units = spark.createDataFrame([(1, "1", 100.0, 10.0, -5.0, 1), (1, "2", 0.0, 100.0, -50.0, 1), (2, "1", 0.0, 0.0, 0.0, 1)], "bus_id long, gen_id string, rmpct double, qmax double, qmin double, status int")
    need = spark.createDataFrame([(1, 60.0), (2, 0.05)], "bus_id long, q_required double")
    found = {(r.bus_id, r.gen_id): (r.q, r.clamped) for r in electrical.allocate_reactive(units, need).collect()}
    assert found == {(1, "1"): (10.0, True), (1, "2"): (50.0, False), (2, "1"): (0.0, False)}


def test_small_deviations_of_large_values(spark):
    from gridlake.operators import stats

    rows = [("a", i, 1e8 + i * 1e-3, 1) for i in range(6)] + [("b", i, 5.0, 0) for i in range(3)]
    found = {r.row_key: r for r in stats.mean_rms(spark.createDataFrame(rows, "row_key string, scenario_idx int, value double, mask int"), 1).collect()}
    assert abs(found["a"].rms - (sum((i * 1e-3) ** 2 for i in range(6)) / 5) ** 0.5) < 1e-6
    assert tuple(found["b"])[1:] == (0, 0.0, 0.0, 0.0)


def test_broadcast_of_voltages_is_checked(spark, monkeypatch):
    voltage = spark.createDataFrame([(e, b, 1.0 + 0.01 * b, 5.0 * b) for e in range(2) for b in range(3)], "event_idx int, bus_id long, v_pu double, angle_deg double")
    circuit = spark.createDataFrame([(0, 1, "1", 0.01, 0.1, 0.02, 0.0, 0.0, False, 1), (1, 2, "1", 0.02, 0.2, 0.0, 0.98, 3.0, True, 1)], "from_bus long, to_bus long, ckt string, r double, x double, b double, tap double, shift_deg double, switched boolean, status int")
    small = sorted(electrical.line_flow(circuit, voltage).collect())
    monkeypatch.setattr(electrical, "BROADCAST_ROWS", 2)
    assert sorted(electrical.line_flow(circuit, voltage).select(*electrical.line_flow(circuit, voltage).columns).collect()) == small and len(small) == 4


def test_reactive_shares_are_clamped_and_shared_again(spark):
    units = spark.createDataFrame([(1, "1", 50.0, 10.0, -5.0, 1), (1, "2", 50.0, 100.0, -50.0, 1)], "bus_id long, gen_id string, rmpct double, qmax double, qmin double, status int")
    need = spark.createDataFrame([(1, 60.0)], "bus_id long, q_required double")
    found = {r.gen_id: (r.q, r.clamped, r.to_pq) for r in electrical.allocate_reactive(units, need).collect()}
    assert found == {"1": (10.0, True, False), "2": (50.0, False, False)}


def test_r04_f12_lists_are_written_line_by_line(spark, monkeypatch):
    """No row holds a list: files are as many as rows ask for, and each is a document."""
    import xml.etree.ElementTree as ET
    from pathlib import Path

    from gridlake.plans import catalog

    monkeypatch.setattr(catalog, "DEALT_ROWS", 50)
    written, xml = [], catalog._xml
    monkeypatch.setattr(catalog, "_xml", lambda *a, **b: written.append(xml(*a, **b)) or written[-1])
    rows = catalog.queries()["read_contingencies"](spark, "/root/testdata/sf0.001")
    files = [f for f in Path(written[0]).rglob("part-*.txt")]
    found = [len(ET.parse(f).getroot()) for f in files]
    assert max(found) < 150 and sum(found) == rows.count() > 5_000
    assert max(len(line) for f in files for line in f.open()) < 1_000


def test_r04_f2_rows_of_few_buckets_are_written_without_a_sort(spark, tmp_path, monkeypatch):
    rows = spark.range(2_000).selectExpr("cast(id % 26 as int) AS event_idx", "id * 0.1 AS p", "id")
    sinks.write_flat(rows, str(tmp_path / "few"))
    told = spark._jsparkSession.sharedState().statusStore().executionsList()
    plan = told.last().physicalPlanDescription()
    assert "event_bucket" in plan and "Sort" not in plan
    assert spark.read.parquet(str(tmp_path / "few")).select("id").distinct().count() == 2_000
    many = rows.withColumn("event_idx", F.col("id").cast("int") * 100)  # more buckets than a task has open
    sinks.write_flat(many, str(tmp_path / "many"))
    assert spark.read.parquet(str(tmp_path / "many")).where("event_bucket = event_idx DIV 256").count() == 2_000
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == "0"
