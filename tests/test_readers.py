"""Files in many splits, and pipelines whose macros are given numbers and lists."""

import math

import pytest

from ondula.operators import cycles as cyc
from ondula.plans import macros
from ondula.plans.pipeline import run
from ondula.sources import readers, writers
from tests.helpers import recording, recordings


@pytest.fixture
def small_splits(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700b")
    spark.conf.set("spark.sql.files.openCostInBytes", "0b")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def chart(blocks, interval="0.01 s"):
    out = []
    for k, rows in enumerate(blocks):
        out += [f"Interval=\t{interval}", "ExcelDateTime=\tx", "ChannelTitle=\tBP\tMCA v"]
        out += [f"{i / 100:.2f}\t{(i * 7 + k) % 100}\t{i % 13}" + (f"\t#* mark {i} " if i % 50 == 7 else "\t#3 Event Marker" if i % 50 == 9 else "") for i in range(rows)]
    return "\n".join(out) + "\n"


def plain_chart(text):
    """(idx, comment, markers, values) line by line."""
    rows, before = [], False
    for line in text.split("\n"):
        if line[:1].isdigit():
            cells = line.split("\t")
            note = cells[3][3:].replace(" ", "").upper() if len(cells) > 3 and cells[3].startswith("#*") else ""
            rows.append((len(rows), "RESET" if not before else note, ["#3"] if "Event" in line else [], [float(c) for c in cells[1:3]]))
        before = line[:1].isdigit()
    return rows


def test_a_chart_in_many_splits(spark, tmp_path, small_splits):
    text = chart([200, 90, 1, 150])
    (tmp_path / "a.txt").write_text(text)
    (tmp_path / "b.txt").write_text(chart([3]))
    ds = readers.labchart(spark, str(tmp_path))
    assert readers.lines(spark, str(tmp_path)).select("filename", "block").distinct().count() > 8
    rows = sorted(ds.samples.filter("filename = 'a.txt'").collect(), key=lambda r: r["idx"])
    assert [(r["idx"], r["comment"], r["markers"], [r["BP"], r["MCAV"]]) for r in rows] == plain_chart(text)
    assert {r["frequency"] for r in rows} == {100.0} and ds.samples.filter("filename = 'b.txt'").count() == 3


def test_rates_that_differ_within_a_file(spark, tmp_path):
    (tmp_path / "a.txt").write_text(chart([5]) + chart([5], "0.02 s"))
    with pytest.raises(Exception, match="sampling frequencies differ"):
        readers.labchart(spark, str(tmp_path)).samples.collect()
    (tmp_path / "a.txt").write_text(chart([5], "fast"))
    with pytest.raises(Exception, match="malformed Interval"):
        readers.labchart(spark, str(tmp_path)).samples.collect()


def test_a_scan_in_many_splits(spark, tmp_path, small_splits):
    head = "Name: x\nStart Time: 0:00:01\nEnd Time: 0:00:05\n{Data}\nTime (sec),Diameter (cm),Velocity (cm/s),Deleted,R-Wave\n"
    rows = [(i / 50, i % 17 + 0.5, i % 5 - 1.0, int(i % 20 in (3, 4, 5)), int(i % 30 == 0)) for i in range(200)]
    (tmp_path / "a.csv").write_text(head + "\n".join(",".join(map(str, r)) for r in rows) + "\n")
    got = sorted(readers.terason(spark, str(tmp_path)).samples.collect(), key=lambda r: r["idx"])
    want, good = [], None
    for r in rows:
        good = r if not r[3] else good
        want.append((good[1], good[2]))
    assert [(r["DIAMETER"], r["VELOCITY"]) for r in got] == want and [r["idx"] for r in got] == list(range(200))
    assert {r["frequency"] for r in got} == {50.0} and [r["idx"] for r in got if r["markers"]] == [i for i in range(200) if i % 30 == 0]


def test_expand_refuses_what_is_longer_than_the_recording(spark):
    ds = cyc.partition(recording(spark, [1, 2, 3, 4], {0: ["M"], 2: ["M"]}), ["X"], "M", ["W"])
    ds = cyc.arithmetic(cyc.measured(cyc.measured(ds, "W", "mean", "Y"), "W", "period", "P"), "P", "*", num=3, out="P")
    with pytest.raises(Exception, match="longer than recording"):
        cyc.expanded(ds, "Y", weights="P", out="E").samples.collect()


def test_numbers_stay_numbers_in_macros(spark, tmp_path):
    path = tmp_path / "own.toml"
    path.write_text('[[command]]\nclass_name = "partition"\nin = "{name}"\nindex = "M"\nin_channel = "X"\nout_channel = "W"\nout = "{name}"\n[[command]]\nclass_name = "arithmetic"\nin = "{name}"\nin_channel = "W"\nformat = "*"\nnum = "{factor}"\nout_channel = "W_{tag}"\nout = "{name}"\n')
    ds = run(spark, [{"class_name": "meta", "meta_name": str(path), "name": "A", "factor": 60, "tag": "x"}], {"A": recording(spark, [1, 4, 2], {2: ["M"]})})["A"]
    assert [r["values"] for r in ds.cycles("W_X").orderBy("wave_no").collect()] == [[60.0, 240.0], [120.0]]


def test_lists_spread_block_by_block(tmp_path):
    path = tmp_path / "own.toml"
    path.write_text('[[command]]\nclass_name = "delete"\nin = "Z"\n[[command]]\nclass_name = "measurement"\nin = "A"\nin_channel = "{c}"\nformat = "{f}"\nout = "A"\n[[command]]\nclass_name = "priority"\nin = "A"\nchannels = "{all}"\nout = "A"\n')
    made = macros.expand({"class_name": "meta", "meta_name": str(path), "c": ["P", "Q", "R"], "f": ["min", "max"], "all": ["U", "V"]})
    assert [(b["class_name"], b.get("in_channel"), b.get("format")) for b in made] == [("delete", None, None), ("measurement", "P", "min"), ("measurement", "Q", "max"), ("measurement", "R", "min"), ("priority", None, None)]
    assert made[-1]["channels"] == ["U", "V"]
    twice = macros.expand({"class_name": "meta", "meta_name": "filter_signal", "name": "A", "channel_name": ["P", "Q"]})
    assert [(b["function"].lower(), b["in_channel"]) for b in twice] == [("kalman", "P"), ("kalman", "Q"), ("savgol", "P"), ("savgol", "Q")]


def test_staged_records_are_held_by_places(spark):
    """Against lists; every rate of a record, record lengths that do not fit, channels that start late."""
    rows, want = [], {}
    rates = {"A": 200.0, "B": 60.0, "C": 7.0, "D": 199.0}
    sizes = {"A": [400, 55, 10], "B": [120, 1], "C": [14, 3, 1], "D": [398]}
    for channel, fs in rates.items():
        want[channel], starts = [], []
        for record, n in enumerate(sizes[channel]):
            values = [float(record * 1000 + i + 1) for i in range(n)]
            rows += [(1, channel, record, fs, i + 5, v) for i, v in enumerate(values)]
            new = max(1, int(n * 200.0 / fs)) if fs < 200 else n
            step = n / max(new - 1, 1)
            starts.append(len(want[channel]))
            want[channel] += [values[min(int(i * step), n - 1)] for i in range(new)] if fs < 200 else values
    ds = readers.staged(spark.createDataFrame(rows, "rec int, channel string, record int, fs double, sample_idx long, value double"))
    got = sorted(ds.samples.collect(), key=lambda r: r["idx"])
    total = max(map(len, want.values()))
    assert [r["idx"] for r in got] == list(range(total))
    for channel, values in want.items():
        assert [r[channel] for r in got] == [0.0] * (total - len(values)) + values
    assert "collect_list" not in ds.samples._jdf.queryExecution().toString()
    with pytest.raises(Exception, match="samples missing"):
        readers.staged(spark.createDataFrame([(1, "A", 0, 200.0, 0, 1.0), (1, "A", 0, 200.0, 2, 1.0)], "rec int, channel string, record int, fs double, sample_idx long, value double")).samples.collect()


def test_lines_go_to_the_shortest_channel(spark, tmp_path):
    ds = cyc.partition(recording(spark, [1, 4, 2.675, 3, 9], {1: ["M"], 3: ["M"]}), ["X"], "M", ["W"])
    ds = cyc.measured(ds, "W", "max", "TOP")
    ds = cyc.sliced(ds, "W", 0, 0.5, "PART")
    ds = cyc.take(ds, "TOP", waves=2, consecutive=False, out="TWO")
    ds = cyc.aggregated(ds, "TOP", "mean", out="A")
    lines = [r["line"] for r in writers.text_lines(ds, "{name}:{filename} {frequency} {A};{two};{part};{other}", decimal=2, name="N").orderBy("n").collect()]
    assert lines == ["N:one 10.0 4.67;1.0;;{OTHER}", "N:one 10.0 4.67;4.0;4.0;{OTHER}"]
    assert [r["line"] for r in writers.text_lines(ds, "{W}", decimal=2).orderBy("n").collect()] == ["1.0", "4.0,2.67", "3.0,9.0"]  # 2.675 is a little less than that
    assert [r["line"] for r in writers.text_lines(ds, "{A}").collect()] == ["4.67"]
    writers.save(ds, str(tmp_path / "out"), "{top}", header="top")
    assert "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*"))).split() == ["TOP", "1.0", "4.0", "9.0"]


def test_arithmetic_of_a_recording_without_cycles(spark):
    ds = cyc.partition(recordings(spark, [[1, 2, 3, 4], [5, 6]], [{1: ["M"], 2: ["M"]}, {1: ["M"]}]), ["X"], "M", ["W"], del_first=True, del_last=True)
    made = cyc.arithmetic(ds, "W", "+", num=1, out="Y").cycles("Y").orderBy("rec").collect()
    assert [(r["rec"], r["wave_no"]) for r in made] == [(1, 0), (2, 0)] and made[0]["values"] == [3.0] and made[1]["values"][0] != made[1]["values"][0]


def test_plots_show_markers_comments_and_titles(spark, tmp_path):
    ds = recording(spark, [0, 1, 0, -1] * 5, {3: ["X"], 7: ["M"]}, {4: "GO", 9: "STOP"})
    blocks = [{"class_name": "plot", "in": "A", "in_channel": ["X", "GONE", "X"], "index": ["X", "X", ""], "comments": ["go"], "title": "{name} of {filename}", "save": str(tmp_path / "{NAME}")}]
    run(spark, blocks, {"A": ds})
    rows = spark.read.parquet(str(tmp_path / "A")).collect()
    assert {r["title"] for r in rows} == {"A OF one"} and {(r["panel"], r["channel"]) for r in rows} == {(0, "X"), (2, "X")}
    assert sorted((r["panel"], r["kind"], r["t"], r["value"], r["text"]) for r in rows if r["kind"] != "line") == [(0, "comment", 0.4, None, "GO"), (0, "marker", 0.3, -1.0, "X")]
    line = sorted((r["t"], r["value"]) for r in rows if r["kind"] == "line" and r["panel"] == 2)
    assert len(line) == 100 and line[1][0] == 0.02 and abs(line[5][1] - 1) < 1e-9
    with pytest.raises(Exception, match="nothing to plot"):
        writers.plotted(ds, ["GONE"])


def test_plot_points_lie_where_the_resampled_values_do(spark):
    x = [math.cos(2 * math.pi * 3 * k / 51) for k in range(51)]
    points = writers.plot_data(recording(spark, x), ["X"]).orderBy("t").collect()
    assert len(points) == 254 and [p["t"] for p in points] == [k * 5.1 / 254 for k in range(254)]  # 5.1 s hold 255 steps of 1/50 s less a rounding error
    assert all(abs(p["value"] - math.cos(2 * math.pi * 3 * p["t"] / 5.1)) < 1e-9 for p in points)
