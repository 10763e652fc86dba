"""File sources and sinks on small written fixtures."""

import pytest
from pyspark.sql import functions as F

from runledger.sinks import store
from runledger.sources import documents, eventlog, files

LOG = "k long, ts_ms long, kind string, file_pos long"


def test_event_log(spark, tmp_path):
    path, day = str(tmp_path / "log"), 86_400_000
    rows = [(k, i * day, f"kind{i}", i) for k in (1, 2) for i in range(3)]
    store.write_event_log(spark.createDataFrame(rows, LOG), path)
    found = eventlog.read_event_log(spark, path, LOG)
    assert sorted(map(tuple, found.collect())) == rows
    (tmp_path / "log" / "period=1970-01-02" / "part-x.snappy.parquet").write_bytes(b"no parquet at all")
    assert sorted(map(tuple, eventlog.read_event_log(spark, path, LOG).collect())) == rows
    chosen = spark.createDataFrame([(2,), (2,), (9,)], "k long")
    assert sorted(map(tuple, eventlog.read_event_log(spark, path, LOG, chosen).collect())) == rows[3:]
    assert eventlog.read_event_log(spark, str(tmp_path / "missing"), LOG).count() == 0


def test_config_files(spark, tmp_path):
    def prop(name, value, final="", source="job.xml"):
        tags = [(t, v) for t, v in (("name", name), ("value", value), ("final", final)) if v is not None]
        inner = "".join(f"<{t}>{v}</{t}>" for t, v in tags)
        return f"<property>{inner}<source>{source}</source><source>second</source></property>"

    one, two = tmp_path / "application_77_8001", tmp_path / "a" / "application_77_8002"
    for d in (one, two):
        d.mkdir(parents=True)
    holes = [prop("alpha", "A1"), prop("beta", "B2", "no"), prop("gamma", "C3", "TRUE"),
             prop(None, "x"), prop("y", None), prop(None, None)]
    (one / "job-final.xml").write_text(f"<configuration>{''.join(holes)}</configuration>")
    (one / "config.xml").write_text(f"<configuration>{prop('old', '1')}</configuration>")
    (two / "config.xml").write_text(f"<configuration>{prop('only', '1', 'true')}</configuration>")
    got = {(r["dir"].rsplit("/", 1)[-1], r["name"]): (r["value"], r["final"], r["source"])
           for r in files.read_config(spark, str(tmp_path)).collect()}
    assert got == {
        ("application_77_8001", "alpha"): ("A1", False, "job.xml"),
        ("application_77_8001", "beta"): ("B2", False, "job.xml"),
        ("application_77_8001", "gamma"): ("C3", True, "job.xml"),
        ("application_77_8002", "only"): ("1", True, "job.xml"),
    }


def test_directories(spark, tmp_path):
    for d in ("intermediate/application_1_2", "finished/2019/01/08/application_3_4/sub", "finished/2019/other"):
        (tmp_path / d).mkdir(parents=True)
        (tmp_path / d / "f.jhist").write_text("x")
    got = {r["dir"].rsplit("/", 1)[-1] for r in files.read_job_directories(spark, str(tmp_path)).collect()}
    assert got == {"application_1_2", "application_3_4"}


GPU = """<?xml version="1.0" ?>
<nvidia_smi_log>
  <driver_version>512.40</driver_version>
  <gpu id="0"><product_name>Model Q</product_name><uuid>GPU-aa</uuid><minor_number>0</minor_number>
    <fb_memory_usage><total>8100 MiB</total><used>0 MiB</used><free>8100 MiB</free></fb_memory_usage>
    <bar1_memory_usage><total>4000 MiB</total><used>4 MiB</used><free>3996 MiB</free></bar1_memory_usage>
    <utilization><gpu_util>0 %</gpu_util></utilization></gpu>
  <gpu id="1"><product_name>Model Q</product_name><uuid>GPU-bb</uuid><minor_number>1</minor_number>
    <fb_memory_usage><total>8100 MiB</total><used>71 MiB</used></fb_memory_usage>
    <utilization><gpu_util>42.5 %</gpu_util></utilization></gpu>
</nvidia_smi_log>
"""


def test_gpu_snapshot(spark, tmp_path):
    (tmp_path / "smi.xml").write_text(GPU)
    rows = documents.read_gpu_snapshots(spark, str(tmp_path)).orderBy("minor_number").collect()
    assert [r["driver_version"] for r in rows] == ["512.40", "512.40"]
    assert rows[0]["fb_used"] + rows[0]["fb_free"] == 8100 and rows[0]["bar1_used"] + rows[0]["bar1_free"] == 4000
    assert rows[1]["utilization"] == pytest.approx(42.5, abs=1e-5)
    assert rows[1]["fb_free"] == -1 and rows[1]["bar1_used"] is None


def test_text_and_archives(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"one\r\ntwo\nthree\n")
    assert documents.read_whole_files(spark, str(tmp_path)).first()["text"] == "onetwothree"
    (tmp_path / "b.zip").write_bytes(b"PK\x03\x04rest")
    (tmp_path / "c.gz").write_bytes(b"\x1f\x8b\x08\x00")
    (tmp_path / "d").write_bytes(b"\x1f\x8b")
    flags = {r["path"].rsplit("/", 1)[-1]: r["archive"] for r in documents.read_archive_flags(spark, str(tmp_path)).collect()}
    assert flags == {"a.txt": False, "b.zip": True, "c.gz": True, "d": False}


def test_one_file_a_value(spark, tmp_path):
    """Values that come twice share a file, a line each; bytes stay, and nothing lies beside the files."""
    rows = [(1, b"a\nb"), (2, b"\x1f\x8b\x08\x00"), (3, None), (1, b"c"), (None, b"d")]
    store.write_files(spark.createDataFrame(rows, "part long, value binary"), str(tmp_path / "in"), "part", "value")
    found = {f.name: f.read_bytes() for f in (tmp_path / "in").rglob("*") if f.is_file()}
    assert sorted(found.pop("part=1.txt").split(b"\n")) == [b"", b"a", b"b", b"c"]
    assert found == {"part=2.txt": b"\x1f\x8b\x08\x00\n", "part=3.txt": b"\n", "part=__HIVE_DEFAULT_PARTITION__.txt": b"d\n"}
    assert {r["path"].rsplit("/", 1)[-1] for r in documents.read_archive_flags(spark, str(tmp_path / "in")).where("archive").collect()} == {"part=2.txt"}


def test_many_files_are_read_in_lots(spark, tmp_path):
    """The driver lists some of the files at a time, at any depth, and every file is read once."""
    for i in range(23):
        folder = tmp_path / "in" / f"f{i % 4}" / ("deep" if i % 3 else "")
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"{i}.txt").write_bytes(b"x\n%d" % i)
    (tmp_path / "in" / "top [1].txt").write_bytes(b"top")
    (tmp_path / "in" / "_SUCCESS").write_bytes(b"")
    lots, want = [], sorted([f"x{i}" for i in range(23)] + ["top"])

    def read(reader, paths):
        lots.append(paths)
        return reader.text(paths, wholetext=True).select(documents.without_line_ends("value").alias("text"))

    path = str(tmp_path / "in")
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    assert sorted(r["text"] for r in files.folder_by_folder(spark, path, read, "lots", most=6).collect()) == want
    assert len(lots) > 2 and len(sum(lots, [])) == 5 and spark.conf.get("spark.sql.files.openCostInBytes") == before
    assert sorted(r["text"] for r in documents.read_whole_files(spark, path).collect()) == want


def test_slot_plan(spark):
    text = '[{"hostname":"h","rank":"0","localRank":"0","crossRank":"0","size":"2","localSize":"2","crossSize":"1"},' \
           '{"hostname":"h","rank":"1","localRank":"1","crossRank":"1","size":"2","localSize":"2","crossSize":"1"}]'
    rows = documents.plan_slots(spark.createDataFrame([(text,)], "plan string"), "plan").orderBy("rank").collect()
    assert [(r["hostname"], r["rank"], r["size"]) for r in rows] == [("h", 0, 2), ("h", 1, 2)]


def test_finished_store_and_purge(spark, tmp_path):
    names = [f"application_77_8001-123-{end}-mara-SUCCEEDED.jhist" for end in (1546300800000, 1549000000000)]
    rows = spark.createDataFrame([(n,) for n in [*names, "application_1_2-1-user.jhist.inprogress"]], "name string")
    store.write_finished(rows, str(tmp_path / "s"))
    back = spark.read.schema("name string, year string, month string, day string").parquet(str(tmp_path / "s"))
    assert {(r["year"], r["month"], r["day"]) for r in back.collect()} == {("2019", "01", "01"), ("2019", "02", "01")}


def test_purge_drops_folders_and_leaves_files_alone(spark, tmp_path):
    """Years, months and days before the cutoff go whole; what stays is not written anew."""
    base, day = tmp_path / "s", 86_400_000
    ends = [1_420_070_400_000, 1_425_168_000_000, 1_546_300_800_000, 1_548_979_200_000, 1_548_979_200_000 + day, 1_551_398_400_000]
    rows = spark.createDataFrame([(f"application_77_{i}-123-{e}-mara-SUCCEEDED.jhist",) for i, e in enumerate(ends)], "name string")
    store.write_finished(rows, str(base))
    (base / "year=next" / "month=01" / "day=01").mkdir(parents=True)
    files_of = lambda: {str(f.relative_to(base)): (f.stat().st_ino, f.stat().st_mtime_ns) for f in base.rglob("*.parquet")}
    before = files_of()
    gone = store.purge_finished(spark, str(base), "2019-02-02")
    assert [(level, folder.split("/s/")[1]) for level, folder in gone] == [
        ("year", "year=2015"), ("month", "year=2019/month=01"), ("day", "year=2019/month=02/day=01")]
    after = files_of()
    assert after == {f: v for f, v in before.items() if "year=2019/month=02/day=02" in f or "year=2019/month=03" in f} and len(after) == 2
    assert (base / "year=next").exists() and store.purge_finished(spark, str(base), "2019-02-02") == []
    assert store.purge_finished(spark, str(tmp_path / "missing"), "2019-02-02") == []


def test_event_log_scan_skips_other_buckets(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = [(k, k * 1000 + i, f"kind{i}", i) for k in range(200) for i in range(3)]
    store.write_event_log(spark.createDataFrame(rows, LOG), path, "yyyy", buckets=16)
    chosen = spark.createDataFrame([(7,)], "k long")
    found = eventlog.read_event_log(spark, path, LOG, chosen, buckets=16)
    assert sorted(map(tuple, found.collect())) == [r for r in rows if r[0] == 7]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [(bucket" in plan
    every = eventlog.read_event_log(spark, path, LOG, buckets=16)
    opened = found.select(F.input_file_name()).distinct().count()
    assert every.count() == 600 and opened < every.select(F.input_file_name()).distinct().count()
    only = next((tmp_path / "log").rglob("*.parquet"))
    assert eventlog.damaged_files(spark, path).count() == 0
    (only.parent / "part-cut.snappy.parquet").write_bytes(only.read_bytes()[:-9])
    assert [r["path"].rsplit("/", 1)[1] for r in eventlog.damaged_files(spark, path).collect()] == ["part-cut.snappy.parquet"]
    assert eventlog.read_event_log(spark, path, LOG, buckets=16).count() == 600



def test_external_program(spark):
    from runledger.operators import program

    rows = spark.range(20).select(F.col("id").cast("string").alias("t")).repartition(3)
    out = program.run_program(rows, ["sh", "-c", "while read x; do echo $P$x; done"], "t", env={"P": "p"})
    assert {r["line"] for r in out.collect()} == {f"p{i}" for i in range(20)}
    with pytest.raises(Exception, match="exit code 3"):
        program.run_program(rows, ["sh", "-c", "cat >/dev/null; exit 3"], "t").collect()
    with pytest.raises(Exception, match="exit code"):
        program.run_program(rows, ["sleep", "60"], "t", timeout_s=1).collect()
    many = spark.range(200_000).select(F.col("id").cast("string").alias("t")).coalesce(1)
    with pytest.raises(Exception, match="before it had read all its input"):
        program.run_program(many, ["head", "-n", "3"], "t").collect()
    assert program.run_program(many, ["head", "-n", "3"], "t", may_stop_early=True).count() == 3
    broken = many.withColumn("t", F.expr("if(t = '150000', raise_error('no such row'), t)"))
    with pytest.raises(Exception, match="no such row"):
        program.run_program(broken, ["cat"], "t").collect()
