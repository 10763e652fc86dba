"""Known values: inputs and expected results fixed by the behaviour being matched."""

import datetime

import pytest
from pyspark.sql import functions as F

from runledger.functions import config, env, links, names, predicates
from runledger.operators import fit, graph, history, order, placement, settings, sets, tasks, telemetry, upkeep


def one(spark, column, **values):
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()))
    return row.select(column.alias("r")).first()["r"]


@pytest.mark.parametrize("name,pattern,valid", [
    ("job123-1-1-user1-FAILED.jhist", r"job\d+", True),
    ("application123-1-1-user1-FAILED.jhist", r"job\d+", False),
    ("job123-1-1-USER-SUCCEEDED.jhist", r"job\d+", False),
    ("job1-1-user.jhist.inprogress", r"job\d+", True),
    ("job1-1.jhist", r"job\d+", False),
    ("job1-x-1-user-FAILED.jhist", r"job\d+", False),
    ("job1-1-1-user-Failed.jhist", r"job\d+", False),
    ("job1-1-1-us-er-FAILED.jhist", r"job\d+", False),
    ("job1-1-1-user-.jhist", r"job\d+", False),
    ("job1-1-.jhist.inprogress", r"job\d+", False),
    ("nodot", r"job\d+", False),
    ("", r"job\d+", False),
])
def test_valid_names(spark, name, pattern, valid):
    assert one(spark, names.is_valid_history_name("n", pattern), n=name) is valid
    assert (one(spark, names.history_name_fault("n", pattern), n=name) is None) is valid


def test_names_round_trip(spark):
    build = lambda c, s: names.build_history_name(F.lit("app123"), F.lit(1), F.lit(c), F.lit("user"), F.lit(s))
    assert one(spark, build(-1, ""), x=1) == "app123-1-user.jhist.inprogress"
    assert one(spark, build(2, "SUCCEEDED"), x=1) == "app123-1-2-user-SUCCEEDED.jhist"
    back = one(spark, names.parse_history_name("n"), n="app123-1-2-user-SUCCEEDED.jhist")
    assert tuple(back) == ("app123", 1, 2, "user", "SUCCEEDED")
    assert tuple(one(spark, names.parse_history_name("n"), n="app123-1-user.jhist.inprogress")) == (
        "app123", 1, -1, "user", "RUNNING")


def test_date_directory(spark):
    assert one(spark, names.date_directory("m"), m=1559155036000) == "2019/05/29"
    assert one(spark, names.date_directory("m", "GMT+6"), m=1559155036000) == "2019/05/30"


def test_paths(spark):
    path = "/abc/def/application_1541469337545_0024"
    assert one(spark, names.last_component("p"), p=path) == "application_1541469337545_0024"
    assert one(spark, names.is_job_folder("p", "^application_.*"), p=path)


def test_duration(spark):
    text = lambda ms: one(spark, names.duration_text("m"), m=ms)
    assert text(((26 * 60 + 3) * 60 + 4) * 1000) == "1D 2H 3m 4s"
    assert text(0) == "" and text(60_000) == "1m "


def test_log_link(spark):
    link = lambda address, usr: one(
        spark, links.log_link(F.lit("node7.example"), F.lit("container_31_07_01"), F.lit(usr), address), x=1
    )
    assert link(F.lit("0.0.0.0:8042"), "maria") == "http://node7.example:8042/node/containerlogs/container_31_07_01/maria"
    assert link(F.lit("0.0.0.0"), "maria") == "NA"
    assert link(None, "maria") == "NA"
    assert link(F.lit("0.0.0.0:8042"), None) == "NA"


def test_memory_and_units(spark):
    mb = lambda s: one(spark, config.memory_mb("s"), s=s)
    assert [mb("2g"), mb("2048m"), mb("2048M"), mb("100"), mb("x")] == [2048, 2048, 2048, 100, None]
    assert one(spark, config.leading_float("s"), s="10.3 %") == pytest.approx(10.3, abs=1e-5)
    assert one(spark, config.leading_long("s"), s="725 MiB") == 725
    assert one(spark, config.leading_long(F.lit(None).cast("string")), x=1) == -1


def test_key_values(spark):
    parse = lambda items: one(spark, config.parse_key_values(items), x=1)
    assert parse(F.array(F.lit("foo=1"), F.lit("bar"), F.lit("baz=3"))) == {"foo": "1", "bar": "", "baz": "3"}
    assert parse(F.lit(None).cast("array<string>")) == {}
    assert parse(F.array(F.lit(" a=b=c "), F.lit("a=2"), F.lit("a="))) == {"a": ""}


def test_host_port_and_resource(spark):
    assert tuple(one(spark, config.split_host_port("s"), s="a.b-c:80")) == ("a.b-c", "80")
    assert one(spark, config.split_host_port("s"), s="a b:80") is None
    assert one(spark, config.host_port("h", "p"), h="h", p=-1) == "h:0"
    res = lambda s: one(spark, config.parse_resource("s"), s=s)
    assert tuple(res("/a/b.zip::c#archive")) == ("/a/b.zip", "c", "ARCHIVE")
    assert tuple(res("/a/b.txt")) == ("/a/b.txt", "b.txt", "FILE")
    assert res("a::b::c") is None


def test_cluster_spec(spark):
    text = '{"worker":["w0:1","w1:2"],"ps":["p0:3"],"evaluator":["e0:4"]}'
    spec = env.cluster_spec("s")
    roles = lambda role: sorted(one(spark, env.tf_cluster(spec, F.lit(role)), s=text))
    assert roles("worker") == ["ps", "worker"]
    assert roles("evaluator") == ["evaluator", "ps", "worker"]
    assert one(spark, env.rank_env(spec, F.lit(1), F.lit(3)), s=text)["init_method"] == "tcp://w0:1"
    assert one(spark, env.parameter_server_env(spec, F.lit("worker")), s=text) is None


def test_averages(spark):
    def fold(*values):
        rows = [(1, i, i * 5000, v) for i, v in enumerate(values)]
        return spark.createDataFrame(rows, "task int, id int, ts_ms long, value double")

    avg = lambda *v: telemetry.running_average(fold(*v)).first()["avg_value"]
    assert avg(0.1, 0.3, 0.5) == pytest.approx(0.3)
    assert avg(0.1, None, 0.5) == pytest.approx(0.7 / 3)
    assert avg(None, 0.5) == pytest.approx(-0.25)
    assert avg(None, None) == -1.0
    assert telemetry.running_maximum(fold(0.1, 0.4, 0.2)).first()["max_value"] == 0.4
    assert telemetry.running_maximum(fold(None)).first()["max_value"] == -1.0


def task_rows(spark, rows):
    return spark.createDataFrame(
        rows, "k int, role string, idx int, host string, start_ms long, end_ms long, exit_code int")


def test_task_accounting(spark):
    df = task_rows(spark, [
        (1, "ps", 0, "h", 0, 5, 0), (1, "worker", 0, "h", 0, None, None), (1, "worker", 1, "h", 0, 6, 0)])
    got = tasks.counters(df, predicates.is_monitored("role", ["ps"])).first()
    assert (got["total"], got["tracked"], got["completed"], got["completed_tracked"]) == (3, 2, 2, 1)
    final = tasks.final_status(df, predicates.is_monitored("role", ["ps"])).first()
    assert (final["status"], final["message"]) == ("FAILED", "Job worker:0 hasn't finished yet.")


def test_killed_by_master_counts_as_failure_only_at_the_end(spark):
    df = task_rows(spark, [(1, "worker", 0, "h", 0, 5, -105)])
    tracked = predicates.is_monitored("role")
    assert tasks.counters(df, tracked).first()["failed"] == 0
    assert tasks.final_status(df, tracked).first()["status"] == "FAILED"
    assert tasks.fail_fast(df).count() == 0


def test_untracked_only_succeeds(spark):
    df = task_rows(spark, [(1, "ps", 0, "h", 0, None, None)])
    assert tasks.final_status(df, predicates.is_monitored("role", ["ps"])).first()["status"] == "SUCCEEDED"


def test_attention_order_and_summary(spark):
    rows = [("worker", 0, None), ("ps", 0, None), ("worker", 1, 0), ("worker", 2, None), ("worker", 3, 1), ("worker", 4, None),
            ("worker", 5, -105), ("ps", 1, 1)]
    df = task_rows(spark, [(1, r, i, "h", 0, 1, c) for r, i, c in rows])
    placed = order.by_attention(df.withColumn("status", predicates.task_status("exit_code"))).orderBy("place")
    assert [f"{r['role']}{r['idx']}" for r in placed.collect()] == [
        "ps1", "worker3", "worker1", "worker5", "ps0", "worker0", "worker2", "worker4"]
    merged = task_rows(spark, [(1, r, i, "h", 0, 1, 0) for r in ("ps", "worker") for i in
                               ((1, 2, 3) if r == "ps" else (4, 5, 6))])
    runs = tasks.status_runs(merged.where("idx <> 5"))
    assert {(r["role"], r["first"], r["last"]) for r in runs.collect()} == {("ps", 1, 3), ("worker", 4, 4), ("worker", 6, 6)}
    assert tasks.status_text(runs).first()["text"] == "ps [1, 2, 3] worker [4, 6]"


def test_text_index_order(spark):
    df = spark.createDataFrame([(1, "w", i) for i in (2, 10, 1)], "k int, role string, idx int")
    assert [r["idx"] for r in order.by_task_id(df).orderBy("place").collect()] == [1, 10, 2]


def test_limits(spark):
    asked = spark.createDataFrame([("a", "foo", 2), ("b", "foo", 6), ("c", "foo", 5)], "app string, role string, n int")
    limits = spark.createDataFrame([("a", "foo", -1), ("b", "foo", 5), ("c", "foo", 10)], "app string, role string, max_allowed int")
    assert [r["app"] for r in settings.limit_violations(asked, limits, ["app", "role"], "n").collect()] == ["b"]


def conf(spark, **values):
    rows = [("a", f"job.{k.replace('__', '.').replace('_', '-')}", v) for k, v in values.items()]
    return spark.createDataFrame(rows, "app string, key string, value string")


def test_container_requests(spark):
    rows = conf(spark, worker__instances="3", evaluator__instances="1", db__instances="1", dbwriter__instances="1",
                chief__instances="0", worker__memory="4g")
    got = {r["role"]: r for r in settings.container_requests(rows).collect()}
    assert set(got) == {"worker", "evaluator", "db", "dbwriter"}
    assert got["db"]["memory_mb"] == 2048 and got["worker"]["memory_mb"] == 4096
    stages = spark.createDataFrame(
        [("a", ["worker", "evaluator", "db", "dbwriter"], ["dbwriter", "db"], [])],
        "app string, roles array<string>, prepare array<string>, training array<string>")
    edges = {(r["role"], r["depends_on"]) for r in settings.stage_edges(stages, ["db"]).collect()}
    assert edges == {("worker", "dbwriter"), ("evaluator", "dbwriter")}
    wrong = spark.createDataFrame(
        [("a", ["worker", "db", "dbwriter", "x"], ["dbwriter", "db"], ["chief", "evaluator", "worker"])],
        "app string, roles array<string>, prepare array<string>, training array<string>")
    assert not settings.complete_stages(wrong).first()["valid"]


def test_layers(spark):
    rows = [("a", 0, 0, "x", "d"), ("a", 1, 0, "x", "f"), ("a", 2, 0, "x", "c1"), ("a", 2, 1, "x", "c2"), ("a", 3, 0, "x", "s"),
            ("a", 0, 0, "y", "d"), ("a", 3, 0, "y", "s"), ("a", 1, 0, "m", "f"), ("a", 2, 0, "m", "c")]
    df = spark.createDataFrame(rows, "app string, layer int, pos int, key string, value string")
    got = {r["key"]: r["value"] for r in settings.merge_layers(df, F.col("key") == "m").collect()}
    assert got == {"x": "c2", "y": "s", "m": "f,c"}


def test_graph(spark):
    nodes = [(a, r) for a in (1, 2, 3) for r in ("db", "worker", "ps", "dbwriter", "cleanup")]
    edges = [("worker", "db"), ("worker", "ps"), ("ps", "db"), ("cleanup", "db"), ("cleanup", "worker"), ("ps", "absent")]
    rows = [(a, *e) for a in (1, 2, 3) for e in edges] + [(2, "db", "cleanup"), (3, "db", "db")]
    got = graph.acyclic(
        spark.createDataFrame(nodes, "app int, role string"),
        spark.createDataFrame(rows, "app int, role string, depends_on string"),
    )
    assert {r["app"]: r["acyclic"] for r in got.collect()} == {1: True, 2: False, 3: False}


def test_countdown(spark):
    counts = {"db": 1, "worker": 2, "ps": 4, "dbwriter": 8, "cleanup": 16}
    ends = {"db": 10, "dbwriter": 20, "ps": 30, "worker": 40, "cleanup": 50}
    df = task_rows(spark, [(1, r, i, "h", 0, ends[r] + i, 0) for r, n in counts.items() for i in range(n)])
    edges = spark.createDataFrame([("worker", "db"), ("worker", "ps"), ("ps", "db"), ("cleanup", "worker")],
                                  "role string, depends_on string")
    got = tasks.dependency_countdown(df, edges).where("ready").groupBy("role").agg(F.max("at_ms").alias("at"))
    assert {r["role"]: r["at"] for r in got.collect()} == {"ps": 10, "worker": 33, "cleanup": 41}
    lefts = tasks.dependency_countdown(df, edges).where("depends_on = 'ps'").orderBy("at_ms")
    assert [r["left"] for r in lefts.collect()] == [3, 2, 1, 0]


HOUR = 3_600_000
NOW = 100 * HOUR


@pytest.mark.parametrize("running,rule,groups,launched,want", [
    (["evaluator"], ("evaluator", "A", 3600, False), {"A": ["chief", "worker"]}, True, "FAILED"),
    (["evaluator"], ("evaluator", "A", 14400, False), {"A": ["chief", "worker"]}, True, None),
    (["evaluator"], ("evaluator", "A", 3600, True), {"A": ["chief", "worker"]}, True, "UNTRACKED"),
    (["evaluator"], ("evaluator", "A", 3600, False), {"B": ["chief"]}, True, None),
    (["evaluator"], ("evaluator", "A", 3600, False), {"A": ["gone"]}, True, None),
    (["evaluator"], ("evaluator", "A", 3600, False), {"A": ["chief", "gone"]}, True, "FAILED"),
    (["evaluator", "worker"], ("evaluator", "A", 3600, False), {"A": ["chief", "worker"]}, True, None),
    (["evaluator"], ("other", "A", 3600, False), {"A": ["chief"]}, True, None),
    (["evaluator"], ("evaluator", "A", 3600, False), {"A": ["chief"]}, False, None),
    ([], ("evaluator", "A", 3600, False), {"A": ["chief"]}, True, None),
])
def test_group_timeouts(spark, running, rule, groups, launched, want):
    slots = [("ps", 2), ("chief", 1), ("worker", 3), ("evaluator", 1)]
    df = task_rows(spark, [
        (1, r, i, "h", 0, None if r in running else NOW - 2 * HOUR, None if r in running else 0)
        for r, n in slots for i in range(n)])
    rules = spark.createDataFrame([rule], "role string, grp string, timeout_s int, ignored boolean")
    members = spark.createDataFrame([(g, r) for g, rs in groups.items() for r in rs], "grp string, role string")
    flag = F.lit(True) if launched else F.col("role") != "ps"
    got = [r["outcome"] for r in tasks.group_timeouts(df, rules, members, NOW, flag).collect()]
    assert got == ([want] if want else [])


def test_hosts(spark):
    rows = [("worker", 0, "localhost1"), ("worker", 1, "localhost1"), ("worker", 2, "localhost2"), ("worker", 3, "localhost3"),
            ("driver", 0, "localhost4")]
    df = task_rows(spark, [(1, r, i, h, 0, None, None) for r, i, h in rows])
    used = placement.host_processes(df)
    assert placement.host_list(used).first()["hosts"] == "localhost1:2,localhost2:1,localhost3:1"
    same = placement.local_sequence(df).where("host = 'localhost1'").orderBy("local_seq").collect()
    assert [r["idx"] for r in same] == [0, 1]
    plan = {(r["host"], r["local_rank"]): r for r in placement.rank_plan(used).collect()}
    first = plan["localhost1", 1]
    assert (first["rank"], first["cross_rank"], first["size"], first["local_size"], first["cross_size"]) == (1, 0, 4, 2, 1)
    assert plan["localhost3", 0]["cross_rank"] == 2


def test_purge(spark):
    days = [(f"{y:04}", f"{m:02}", f"{d:02}") for y, m, d in
            [(2018, 12, 31), (2019, 1, 5), (2019, 3, 31)] + [(2019, 4, d) for d in range(1, 31)]] + [("log", "xx", "1")]
    parts = spark.createDataFrame(days, "year string, month string, day string")
    cutoff = F.lit(datetime.date(2019, 4, 28))
    gone = {(r["year"], r["month"], r["day"]): r["level"] for r in upkeep.expired_partitions(parts, cutoff).collect()}
    kept = {d for d in days if d not in gone}
    assert kept == {("2019", "04", "28"), ("2019", "04", "29"), ("2019", "04", "30"), ("log", "xx", "1")}
    assert gone["2018", "12", "31"] == "year" and gone["2019", "03", "31"] == "month" and gone["2019", "04", "27"] == "day"
    stamps = spark.sql("select id, unix_millis(timestamp'2019-04-26 12:00:00' + make_interval(0,0,0,id)) as m from range(1, 4)")
    assert [r["id"] for r in upkeep.expired_landing(stamps, "m", cutoff).collect()] == [1]


def test_gang_descent_is_a_one_process_descent(spark):
    """Same weights as plain loops over the members' rows, and a separable table is separated."""
    import numpy as np

    from runledger.operators import fit

    random = np.random.default_rng(3)
    y = random.integers(0, 3, 401)
    x = np.array([[4, 0], [0, 4], [-4, -4]])[y] + random.normal(size=(401, 2))
    rows = spark.createDataFrame([(i, [float(v) for v in x[i]], int(y[i])) for i in range(401)], "id long, x array<double>, y int")
    members, batch, epochs, rate = 3, 32, 2, 0.5
    got = fit.descent_fit(rows.repartition(5), "x", "y", "id", 3, members, batch, epochs, rate, penalty=0.01)
    owner = {r["id"]: r["m"] for r in rows.select("id", F.pmod(F.hash("id"), F.lit(members)).alias("m")).collect()}
    shards = [[i for i in range(401) if owner[i] == m] for m in range(members)]
    w = np.zeros((3, 3))
    for _ in range(epochs):
        for at in range(0, max(map(len, shards)), batch):
            slopes = []
            for shard in shards:
                slope, n = np.zeros((3, 3)), len(shard[at: at + batch])
                for i in shard[at: at + batch]:
                    v = np.array([*x[i], 1.0])
                    p = np.exp(w @ v) / np.exp(w @ v).sum()
                    p[y[i]] -= 1
                    slope += np.outer(p, v) / n
                if n:
                    slopes.append(slope + 0.01 * w * np.array([1, 1, 0]))
            w = w - rate * sum(slopes) / len(slopes)
    assert np.allclose(got, w)
    right = fit.linear_predicted(rows, "x", got).where("predicted = y").count()
    assert right >= 395
    assert np.allclose(fit.descent_fit(rows.limit(0), "x", "y", "id", 3, 2), 0)


def test_softmax_fit_separates(spark):
    import numpy as np

    from runledger.operators import fit

    random = np.random.default_rng(5)
    y = random.integers(0, 3, 200)
    x = np.array([[4, 0], [0, 4], [-4, -4]])[y] + random.normal(size=(200, 2))
    rows = spark.createDataFrame([([float(v) for v in x[i]], int(y[i])) for i in range(200)], "x array<double>, label int")
    scored = fit.softmax_score(fit.softmax_fit(rows, "x", "label"), rows, "x")
    assert scored.where("predicted = label").count() >= 195


def test_long_chains_take_few_rounds(spark, monkeypatch):
    """A chain of 10,000 roles, one that ends in a circle, and a plain circle."""
    n, rounds = 10_000, []
    keep = graph.written
    monkeypatch.setattr(graph, "written", lambda df, label: rounds.append(label) or keep(df, label))
    ids = spark.range(n)
    role = lambda c: F.format_string("r%05d", c)
    chain = ids.where(f"id < {n - 1}").select(F.lit(1).alias("app"), role(F.col("id")).alias("role"), role(F.col("id") + 1).alias("depends_on"))
    tail = chain.withColumn("app", F.lit(2)).unionByName(spark.createDataFrame([(2, f"r{n - 1:05d}", f"r{n - 5:05d}")], chain.schema))
    circle = chain.withColumn("app", F.lit(3)).unionByName(spark.createDataFrame([(3, f"r{n - 1:05d}", "r00000")], chain.schema))
    nodes = ids.select(F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("app"), role(F.col("id")).alias("role"))
    got = graph.acyclic(nodes, chain.unionByName(tail).unionByName(circle))
    assert {r["app"]: r["acyclic"] for r in got.collect()} == {1: True, 2: False, 3: False}
    assert rounds.count("pointers") < 20 and len(rounds) < 32


def test_graphs_of_any_shape(spark):
    import random

    draw, nodes, edges, want = random.Random(4), [], [], {}
    for app in range(60):
        n = draw.randint(1, 9)
        own = {(draw.randrange(n), draw.randrange(n + 1)) for _ in range(draw.randint(0, 2 * n))}
        nodes += [(app, f"r{i}") for i in range(n)]
        edges += [(app, f"r{a}", f"r{b}") for a, b in own]
        left = {(a, b) for a, b in own if b < n}
        while drop := {(a, b) for a, b in left if b not in {x for x, _ in left}}:
            left -= drop
        want[app] = not left
    got = graph.acyclic(spark.createDataFrame(nodes, "app int, role string"), spark.createDataFrame(edges, "app int, role string, depends_on string"))
    assert {r["app"]: r["acyclic"] for r in got.collect()} == want and len(set(want.values())) == 2


def test_killed_ids_anywhere_in_a_name(spark):
    import random

    draw = random.Random(9)
    word = lambda a, b: "".join(draw.choice("ab_1") for _ in range(draw.randint(a, b)))
    names = sorted({word(0, 24) for _ in range(400)} | {"é" * 9 + "ab_1ab_1ab"})
    ids = sorted({word(1, 13) for _ in range(60)} | {"é" * 8, "ab_1ab_1ab"})
    dirs = spark.createDataFrame([(i, n) for i, n in enumerate([*names, None])], "k int, app_id string")
    for chosen in (ids, [i for i in ids if len(i) >= 8], [i for i in ids if len(i) < 3], ["", "zz"], [None]):
        killed = spark.createDataFrame([(i,) for i in chosen] * 2, "app_id string")
        got = {r["app_id"] for r in upkeep.killed_landing(dirs, killed, "contains").collect()}
        assert got == {n for n in names if any(i is not None and i in n for i in chosen)}


def test_revised_snapshots(spark):
    from runledger.operators import sets

    rows = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (2, "c"), (3, None)], "k int, s string")
    later = F.when(F.col("s") == "b", "c").when(F.col("s") == "c", "b").when(F.col("k") == 3, "x").when(F.col("k") == 1, "z").otherwise(F.col("s"))
    two = sets.snapshot_difference(rows, rows.select("k", later.alias("s")))
    one = sets.revised(rows, ["k"], {"s": F.col("s")}, {"s": later})
    assert sorted(map(str, one.collect())) == sorted(map(str, two.collect())) and one.count() == 6


def test_killed_landing(spark):
    dirs = spark.createDataFrame([(f"application_1_{i}",) for i in (1, 2, 10, 12, 21)] + [("x-application_1_1",)], "app_id string")
    killed = spark.createDataFrame([("application_1_1",), ("application_1_2",)], "app_id string")
    hits = lambda mode: sorted(r[0] for r in upkeep.killed_landing(dirs, killed, mode).collect())
    assert hits("equals") == ["application_1_1", "application_1_2"]
    assert hits("contains") == ["application_1_1", "application_1_10", "application_1_12", "application_1_2",
                                "application_1_21", "x-application_1_1"]
    killed = spark.createDataFrame([("ation_1_2",), ("1_12",), ("zz" * 40,), (None,)], "app_id string")
    assert hits("contains") == ["application_1_12", "application_1_2", "application_1_21"]
    killed = spark.createDataFrame([("application_1_1",), ("application_1_2",)], "app_id string")
    open_ = spark.createDataFrame([("application_1_1", 5, -1, "u", "RUNNING"), ("application_1_2", 5, 9, "u", "FAILED")],
                                  "app_id string, started_ms long, completed_ms long, usr string, status string")
    done = {r["app_id"]: (r["completed_ms"], r["status"]) for r in upkeep.finalise_killed(open_, killed, 77).collect()}
    assert done == {"application_1_1": (77, "KILLED"), "application_1_2": (9, "FAILED")}


def test_error_log_head(spark):
    text = "".join(f"line{i}\n" for i in range(10))
    assert one(spark, order.first_lines("t", 20), t=text) == text
    assert one(spark, order.first_lines("t", 5), t=text) == "".join(f"line{i}\n" for i in range(5))
    assert one(spark, order.first_lines("t", 5), t="a\r\nb") == "a\nb\n"
    assert one(spark, order.first_lines("t", 5), t="") == ""


def test_role_lists(spark):
    assert one(spark, sets.add_role(F.lit("a,b"), "c"), x=1) == "a,b,c"
    assert one(spark, sets.add_role(F.lit(""), "c"), x=1) == "c"


def test_termination_order(spark):
    flag = lambda **on: one(spark, tasks.termination_reason({k: F.lit(v) for k, v in on.items()}), x=1)
    assert flag(all_tracked_done=True, unhealthy=True, timeout=False) == "unhealthy"
    assert flag(all_tracked_done=True, timeout=True) == "timeout"
    assert flag(timeout=False) is None


def test_merge_lists_later_wins(spark):
    a = spark.createDataFrame([("x", 9), ("y", 1)], "app_id string, n int")
    b = spark.createDataFrame([("x", 2)], "app_id string, n int")
    assert {r[0]: r[1] for r in history.merge_app_lists("app_id", a, b).collect()} == {"x": 2, "y": 1}


def test_snapshots_with_copies(spark):
    a = spark.createDataFrame([(1,), (1,), (2,)], "x int")
    b = spark.createDataFrame([(1,), (3,)], "x int")
    got = sorted((r["x"], r["side"]) for r in sets.snapshot_difference(a, b).collect())
    assert got == [(1, "before"), (2, "before"), (3, "after")]
    assert sets.is_same(a, a) and not sets.is_same(a, b)


def test_cross_entropy(spark):
    loss = one(spark, fit.cross_entropy(F.array(F.lit(1.0), F.lit(2.0)), F.lit(1)), x=1)
    assert loss == pytest.approx(0.3132617)


def test_descent_takes_many_steps_a_call(spark, monkeypatch):
    """A call among members takes a second: 60 steps need a few, and give what a call a step gives."""
    import time

    import numpy as np

    rows = spark.range(240).select("id", F.array(*(((F.col("id") * p) % 7).cast("double") for p in (3, 5))).alias("x"), (F.col("id") % 3).cast("int").alias("y"))
    start = time.time()
    got = fit.descent_fit(rows, "x", "y", "id", 3, 2, batch=2, rate=0.1)
    assert time.time() - start < 30
    few = rows.limit(30)
    want = fit.descent_fit(few, "x", "y", "id", 3, 2, batch=4, rate=0.1)
    monkeypatch.setattr(fit, "MESSAGE", 1)
    assert np.array_equal(fit.descent_fit(few, "x", "y", "id", 3, 2, batch=4, rate=0.1), want) and np.abs(got).max() > 0
