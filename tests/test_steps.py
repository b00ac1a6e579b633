"""Steps on small literal recordings."""

import pytest
from pyspark.sql import functions as F

from ondula.dataset import Dataset, PipelineError
from ondula.operators import cycles as cyc
from ondula.operators import samples as smp
from ondula.plans.pipeline import run
from ondula.queries import finals
from ondula.sources import readers, writers
from ondula.streaming.live import live_cycles
from tests.helpers import SAMPLE, recording, recordings

def cycles(ds, channel):
    return [r["values"] for r in ds.cycles(channel).orderBy("wave_no").collect()]


def test_marker_intervals(spark):
    marks = {i: ["A"] for i in (1, 6, 10, 12, 13)} | {i: ["B"] for i in (4, 8, 11, 15)}
    ds = recording(spark, range(16), marks)
    assert cycles(cyc.marker_intervals(ds, "A", "B", "T"), "T") == [[0.3], [0.2], [0.1], [0.2]]
    assert cycles(cyc.marker_intervals(ds, "B", "A", "T"), "T") == [[0.2], [0.2], [0.1]]


def test_partition_has_an_empty_first_cycle(spark):
    ds = cyc.partition(recording(spark, [1, 2, 3, 4], {0: ["M"], 2: ["M"]}), ["X"], "M", ["W"])
    assert cycles(ds, "W") == [[], [1.0, 2.0], [3.0, 4.0]]
    assert cycles(cyc.measured(ds, "W", "mean", "Y"), "Y") == [[0.0], [1.5], [3.5]]


def test_nan_rules_of_checks(spark):
    ds = cyc.partition(recording(spark, [float("nan"), 2, 3], {1: ["M"]}), ["X"], "M", ["W"])
    ok = lambda op: [r["ok"] for r in cyc.check(ds, "W", "MEAN", op, 2.5, mask="K").mask("K").orderBy("wave_no").collect()]
    assert ok("==") == [0, 1] and ok("!=") == [1, 0]


def test_unequal_cycles_do_not_aggregate(spark):
    ds = cyc.partition(recording(spark, [1, 2, 3], {1: ["M"]}), ["X"], "M", ["W"])
    with pytest.raises(Exception, match="unequal length"):
        cycles(cyc.aggregated(ds, "W", "mean", out="A"), "A")


def test_mean_drops_nan_and_empty_gives_nan(spark):
    ds = cyc.partition(recording(spark, [1, float("nan"), 3], {1: ["M"], 2: ["M"]}), ["X"], "M", ["W"])
    assert cycles(cyc.aggregated(ds, "W", "mean", out="A"), "A") == [[2.0]]
    none = cyc.check(ds, "W", "MAX", ">", 99, mask="K")
    assert str(cycles(cyc.aggregated(none, "W", "mean", mask="K", out="A"), "A")) == "[[nan]]"


@pytest.mark.parametrize(("form", "mask", "weights"), [("mean", "", "P"), ("mean", "K", "P"), ("difference", "", ""), ("median", "K", ""), ("mode", "", "")])
def test_aggregates_side_by_side_are_those_one_by_one(spark, form, mask, weights):
    """Channels of two tables, of different lengths, with a NaN, and one that only some recordings have."""
    nan = float("nan")
    ds = cyc.partition(recordings(spark, [[1, 5, 2, 4, 6, 3, 3, 3], [nan, 2, 3, 1], [7, 8]], [{2: ["M"], 4: ["M"], 6: ["M"]}, {2: ["M"]}, {}]), ["X"], "M", ["W"])
    ds = cyc.check(cyc.measured(cyc.measured(cyc.measured(ds, "W", "max", "T"), "W", "min", "L"), "W", "period", "P"), "W", "MAX", "<", 6, mask="K")
    ds = cyc.take(ds, "W", False, waves=2, out="F")
    each = [("W", "A"), ("T", "B"), ("L", "C"), ("F", "D"), ("none", "E")]
    together, single = cyc.aggregated_each(ds, each, form, mask, weights), ds
    for channel, out in each:
        single = cyc.aggregated(single, channel, form, mask, weights, out=out)
    for _, out in each[:-1]:
        assert str(sorted(map(tuple, together.cycles(out).collect()))) == str(sorted(map(tuple, single.cycles(out).collect()))), out
    assert not together.has("E") and together.table_of("A") == together.table_of("C")


def test_vessel_means_cut_the_samples_once(spark):
    ds = cyc.partition(recording(spark, [1, 2, 4, 2, 3, 5], {2: ["M"], 4: ["M"]}), ["X"], "M", ["W"])
    made = run(spark, [{"class_name": "meta", "meta_name": "terason_tools", "name": "A", "diameter_wave": "W", "velocity_wave": "W"}], {"A": ds})["A"]
    means = [f"{k}_{tag}".upper() for tag in ("diameter", "area", "velocity", "flow") for k in ("sys", "mean", "dias", "amp")] + [f"{k}_{tag}" for tag in ("VELOCITY", "FLOW") for k in ("PI", "RI", "SD")]
    assert len({made.table_of(m) for m in means}) == 1
    found = finals(made, **{m: m for m in means})
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Window [") == cyc.measured(ds, "W", "max").cycles("W")._jdf.queryExecution().optimizedPlan().toString().count("Window [")
    row = found.first()
    assert (row["SYS_DIAMETER"], row["DIAS_DIAMETER"], row["RI_VELOCITY"]) == (pytest.approx(11 / 3), 2.0, pytest.approx((0.5 + 0.5 + 0.4) / 3, abs=1e-6))


def test_unknown_names_are_errors(spark):
    ds = recording(spark, [1])
    with pytest.raises(PipelineError):
        cyc.measured(ds, "W", "mean")
    with pytest.raises(PipelineError):
        run(spark, [{"class_name": "nothing"}], {})


def test_cut_without_its_comment_is_an_error(spark):
    with pytest.raises(Exception, match="no comment"):
        smp.cut_comment(recording(spark, [1, 2]), ["start"]).samples.collect()


def test_tangent_between_minimum_and_maximum(spark):
    ds = recording(spark, [5, 0, 1, 4, 7, 8, 3], {1: ["LO"], 5: ["HI"]})
    ds = Dataset(ds.samples.withColumns({"LO": F.lit(0.0), "HI": F.lit(0.0)}), ("X", "LO", "HI"))
    marked = smp.tangents(ds, "X", "HI", "LO").samples.filter(F.array_contains("markers", "X")).collect()
    assert [r["idx"] for r in marked] == [2]


def test_one_partition_pass_feeds_a_whole_pipeline(spark):
    ds = recording(spark, range(40), {i: ["X"] for i in range(0, 40, 4)})
    blocks = [
        {"class_name": "partition", "in": "a", "in_channel": "x", "index": "x", "out_channel": "w", "out": "a"},
        {"class_name": "meta", "meta_name": "bp", "name": "a", "channel_name": "w"},
    ]
    done = run(spark, blocks, {"A": ds})["A"]
    plan = done.cycles("SYS_BP_WAVE")._jdf.queryExecution().executedPlan().toString()
    assert cycles(done, "AMP_BP_WAVE")[1] == [3.0] and plan.count("Exchange hashpartitioning") <= 3


def test_text_exports(spark, tmp_path):
    (tmp_path / "r.txt").write_text("Interval=\t0.1 s\nChannelTitle=\tBP\tCO2\n0\t1.5\t2\t#* go (now)\n0.1\tx\n0.2\t3\t4\t#20 Event Marker\n")
    ds = readers.labchart(spark, str(tmp_path / "r.txt"))
    rows = ds.samples.orderBy("idx").collect()
    assert ds.channels == ("TIME", "BP", "CO2") and [r["BP"] for r in rows] == [1.5, 0.0, 3.0] and rows[0]["comment"] == "RESET" and rows[2]["markers"] == ["#20"] and rows[0]["frequency"] == 10.0


def test_text_exports_of_two_kinds_in_many_splits(spark, tmp_path):
    """Each file has its own columns and rate; lines keep their order when a file is split."""
    body = "".join(f"{i / 10}\t{i}\t{-i}\n" for i in range(3000))
    (tmp_path / "a.txt").write_text("Interval=\t0.1 s\nChannelTitle=\tBP\tCO2\n" + body)
    (tmp_path / "b.txt").write_text("Interval=\t0.02 s\nChannelTitle=\tCO2\tFLOW\n0\t5\t6\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        ds = readers.labchart(spark, str(tmp_path))
        assert readers.lines(spark, str(tmp_path)).rdd.getNumPartitions() > 4
        rows = ds.samples.orderBy("filename", "idx").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert set(ds.channels) == {"TIME", "BP", "CO2", "FLOW"}
    assert [(r["idx"], r["BP"], r["CO2"], r["FLOW"], r["frequency"]) for r in rows[:3000]] == [(i, float(i), float(-i), 0.0, 10.0) for i in range(3000)]
    assert [(r["BP"], r["CO2"], r["FLOW"], r["frequency"], r["comment"]) for r in rows[3000:]] == [(0.0, 5.0, 6.0, 50.0, "RESET")]


def test_device_csv(spark, tmp_path):
    (tmp_path / "t.csv").write_text("Start Time (hh:mm:ss),00:00:00\nEnd Time (hh:mm:ss),00:00:01\n{Data}\nTime (sec),Diameter (cm),R-wave,Deleted Data\n0,1,0,1\n0.3,2,1,0\n0.6,9,0,1\n0.9,4,0,0\n")
    rows = readers.terason(spark, str(tmp_path / "t.csv")).samples.orderBy("idx").collect()
    assert [r["DIAMETER"] for r in rows] == [0.0, 2.0, 2.0, 4.0] and rows[0]["frequency"] == 4.0 and rows[1]["markers"]


def test_breath_rows(spark, tmp_path):
    (tmp_path / "b.csv").write_text("MR Time(s),PO2 (mmHg)\n0,10\n0.003,20\n0.005,x\n")
    rows = readers.respirac(spark, str(tmp_path / "b.csv")).samples.orderBy("idx").collect()
    assert len(rows) == 7 and [r["idx"] for r in rows if r["markers"]] == [2, 4, 6] and rows[3]["PO2"] == 20.0


def test_staged_records(spark):
    rows = [("r", "a", 0, 200.0, i, float(i)) for i in range(4)] + [("r", "b", 0, 100.0, i, float(i)) for i in range(2)]
    ds = readers.staged(spark.createDataFrame(rows, "rec string, channel string, record int, fs double, sample_idx long, value double"))
    got = ds.samples.orderBy("idx").collect()
    assert [r["A"] for r in got] == [0, 1, 2, 3] and [r["B"] for r in got] == [0, 0, 1, 1] and got[0]["comment"] == "RESET"


def test_saved_lines(spark, tmp_path):
    ds = cyc.measured(cyc.partition(recording(spark, [1, 2, 3], {2: ["M"]}), ["X"], "M", ["W"]), "W", "mean", "Y")
    writers.save(ds, str(tmp_path / "out"), "{filename},{y},{other}", header="f,y", decimal=1)
    lines = sorted(r["value"] for r in spark.read.text(str(tmp_path / "out")).collect())
    assert lines == ["F,Y", "one,1.5,{OTHER}", "one,3.0,{OTHER}"]


def test_live_cycles(spark, tmp_path):
    recording(spark, range(8), {3: ["M"], 6: ["M"]}).samples.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SAMPLE).parquet(str(tmp_path / "in"))
    q = live_cycles(stream, "X", "M").writeStream.format("memory").queryName("live").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    assert [(r["wave_no"], r["n"], r["mean"]) for r in spark.table("live").orderBy("wave_no").collect()] == [(0, 3, 1.0), (1, 3, 4.0)]


def two_rates(spark):
    rows = [(r, f, i, rate, "", [], float(i)) for r, f, rate, n in ((1, "one", 10.0, 11), (2, "two", 20.0, 21), (3, "none", 5.0, 6)) for i in range(n)]
    return Dataset(spark.createDataFrame(rows, SAMPLE), ("X",))


def test_resampling_takes_each_file_to_its_own_rate(spark):
    other = Dataset(spark.createDataFrame([(1, "one", 0, 20.0, "", [], 0.0), (2, "two", 0, 5.0, "", [], 0.0), (3, "two", 0, 99.0, "", [], 0.0)], SAMPLE), ("X",))
    catalog = run(spark, [{"class_name": "interpolate", "in": "A", "in_channel": "DATA", "in_frequency": "B", "out": "C"}], {"A": two_rates(spark), "B": other})
    found = catalog["C"].samples.groupBy("rec").agg(F.count("idx"), F.min("frequency"), F.max("X")).collect()
    assert sorted(map(tuple, found)) == [(1, 21, 20.0, 10.0), (2, 6, 5.0, 20.0), (3, 6, 5.0, 5.0)]


def test_resampling_moves_markers_and_comments(spark):
    ds = smp.resampled(recording(spark, range(11), {3: ["M"], 10: ["N"]}, {4: "HERE"}), frequency=20.0)
    rows = ds.samples.orderBy("idx").collect()
    assert len(rows) == 21 and {r["idx"]: r["markers"] for r in rows if r["markers"]} == {6: ["M"], 20: ["N"]}
    assert {r["idx"]: r["comment"] for r in rows if r["comment"]} == {8: "HERE"}


def test_alignment_takes_the_last_of_equal_file_names(spark):
    rows = [(r, "one", i, 10.0, "", [], float(v)) for r, v in ((1, 5), (2, 7)) for i in range(3)]
    other = Dataset(spark.createDataFrame(rows, SAMPLE), ("X",))
    ds = smp.aligned(recording(spark, [0, 0, 0]), other, "X", "X", "Y")
    assert [r["Y"] for r in ds.samples.orderBy("idx").collect()] == [7.0, 7.0, 7.0]


def test_aggregate_of_an_absent_channel_passes_through(spark):
    ds = recording(spark, [1, 2])
    assert cyc.aggregated(ds, "W", "mean") is ds


def test_a_macro_of_ones_own(spark, tmp_path):
    path = tmp_path / "own.toml"
    path.write_text('[[command]]\nclass_name = "partition"\nin = "{name}"\nindex = "M"\nin_channel = "{source}"\nout_channel = "{source}_cut"\nout = "{name}"\n[later]\n[[later.command]]\nclass_name = "measurement"\nin = "{name}"\nin_channel = "{source}_cut"\nformat = "max"\nout_channel = "{source}_top"\nout = "{name}"\n')
    ds = run(spark, [{"class_name": "meta", "meta_name": str(path), "name": "A", "source": "X"}], {"A": recording(spark, [1, 4, 2, 3], {2: ["M"]})})["A"]
    assert cycles(ds, "X_TOP") == [[4.0], [3.0]]


def test_scan_macro_masks_by_its_four_limits(spark):
    """Beats of 10 samples at 10 a second last 1 s: within 40 and 150 a minute; of the last ten the thin and the slow beat are masked."""
    wide, fast = [2.0] * 120, [20.0] * 120
    wide[50:60], fast[70:80] = [0.05] * 10, [5.0] * 10
    ds = recording(spark, wide, {i: ["B"] for i in range(0, 120, 10)})
    ds = Dataset(ds.samples.join(spark.createDataFrame(list(enumerate(fast)), "idx long, V double"), "idx"), ("X", "V"))
    made = run(spark, [{"class_name": "meta", "meta_name": "terason_dist", "name": "A", "index_channel_terason": "B", "channel_name_diameter": "X", "channel_name_velocity": "V", "diameter_mask_name": "OK"}], {"A": ds})["A"]
    masks = [r["ok"] for r in made.mask("OK").orderBy("wave_no").collect()]
    assert masks == [1, 1, 1, 0, 1, 0, 1, 1, 1, 1]
    assert cycles(made, "SYS_DIAMETER") == [[2.0]] and cycles(made, "MEAN_FLOW") == [[pytest.approx(20 * 4 * 0.7854)]]


def test_staged_records_by_the_read_step(spark, tmp_path):
    rows = [("r", "a", 0, 200.0, i, float(i)) for i in range(4)] + [("r", "b", 0, 130.0, i, float(i)) for i in range(3)]
    spark.createDataFrame(rows, "rec string, channel string, record int, fs double, sample_idx long, value double").write.parquet(str(tmp_path / "s.adi"))
    ds = run(spark, [{"class_name": "read", "format": "ADI", "folder": f"{tmp_path}/", "file": "s", "ext": ".adi", "out": "a"}])["A"]
    assert [r["B"] for r in ds.samples.orderBy("idx").collect()] == [0.0, 1.0, 2.0, 2.0] and ds.channels == ("TIME", "A", "B")  # 3 samples at 130 are int(4.6) at 200
    with pytest.raises(PipelineError):
        run(spark, [{"class_name": "read", "format": "OTHER", "folder": "", "file": "s", "ext": "", "out": "a"}])
