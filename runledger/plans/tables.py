"""The history tables, shaped from the driver's star-schema tables.

One method per view; ``SQL`` holds the same views as DuckDB text for the checks.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runledger.operators import rules
from runledger.operators.series import Series
from runledger.operators.skew import dim_join, hot_values
from runledger.session import written

_hot: dict[tuple, list] = {}


def epoch_ms(c: str) -> Column:
    return F.unix_millis(F.col(c).cast("timestamp"))


def samples_of(events: DataFrame) -> DataFrame:
    """Metric samples (a failed one is null) of an events table or stream."""
    return events.select(
        F.col("user_id").alias("task"), F.col("event_id").alias("id"), epoch_ms("ts").alias("ts_ms"),
        F.when(F.col("event_type") != "error", F.col("value")).alias("value"),
    )


def pings_of(events: DataFrame) -> DataFrame:
    """Register, ping and result calls of an events table or stream."""
    return events.select(
        F.col("user_id").alias("task"), F.col("event_id").alias("id"), epoch_ms("ts").alias("ts_ms"),
        F.when(F.col("event_type") == "signup", "register")
        .when(F.col("event_type") == "purchase", "result")
        .otherwise("ping")
        .alias("kind"),
    )


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.spark, self.dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def write_once(self, *views: str) -> None:
        """From here on these views, and what is built on them, are read from the shared folder."""
        for view in views:
            self.__dict__[view] = written(getattr(self, view), view)

    def _hot_values(self, table: str, column: str) -> list:
        at = (self.spark.sparkContext.applicationId, self.dir, table, column)
        if at not in _hot:
            _hot[at] = hot_values(self.raw(table), column)
        return _hot[at]

    @property
    def hot_apps(self) -> list:
        """Applications holding too many tasks for one executor task."""
        return self._hot_values("lineitem", "l_orderkey")

    @property
    def app_hot(self) -> bool:
        return bool(self.hot_apps)

    @property
    def task_hot(self) -> bool:
        return bool(self._hot_values("events", "user_id"))

    @cached_property
    def apps(self) -> DataFrame:
        customers = self.raw("customer").select(
            F.col("c_custkey").alias("o_custkey"), F.lower("c_mktsegment").alias("usr")
        )
        joined = dim_join(
            self.raw("orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate"),
            customers,
            "o_custkey",
            hot=self._hot_values("orders", "o_custkey"),
        )
        started = epoch_ms("o_orderdate")
        k = F.col("o_orderkey")
        return joined.select(
            k.alias("k"),
            F.concat(
                F.lit("application_"), F.col("o_custkey").cast("string"), F.lit("_"), k.cast("string")
            ).alias("app_id"),
            started.alias("started_ms"),
            F.when(F.col("o_orderstatus") == "P", F.lit(-1).cast("long"))
            .otherwise(started + 14400000 + ((k * 7919) % 86400) * 1000)
            .alias("completed_ms"),
            "usr",
            F.when(F.col("o_orderstatus") == "F", "FAILED")
            .when(F.col("o_orderstatus") == "O", "SUCCEEDED")
            .otherwise("RUNNING")
            .alias("status"),
        )

    @cached_property
    def tasks(self) -> DataFrame:
        line = (
            self.raw("lineitem")
            .withColumn(
                "role",
                F.when(F.col("l_returnflag") == "N", "worker")
                .when(F.col("l_returnflag") == "A", "ps")
                .otherwise("evaluator"),
            )
            .withColumnRenamed("l_orderkey", "o_orderkey")
        )
        orders = self.raw("orders").select("o_orderkey", epoch_ms("o_orderdate").alias("t0"))
        joined = dim_join(line, orders, "o_orderkey", hot=self.hot_apps)
        slot = Series(
            joined,
            ["o_orderkey", "role"],
            ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"],
            hot=self.app_hot,
        ).row_number("slot")
        start = F.col("t0") + F.col("l_linenumber").cast("long") * 300000
        return slot.df.select(
            F.col("o_orderkey").alias("k"),
            "role",
            (F.col("slot") - 1).cast("int").alias("idx"),
            F.concat(F.lit("host"), (F.col("l_suppkey") % 16).cast("string")).alias("host"),
            start.alias("start_ms"),
            (start + F.col("l_quantity").cast("long") * 60000).alias("end_ms"),
            F.when((F.col("l_linestatus") == "O") & (F.col("l_tax") < 0.02), F.lit(None).cast("int"))
            .when(F.col("l_discount") >= 0.09, F.lit(1))
            .when((F.col("l_linestatus") == "O") & (F.col("l_discount") <= 0.01), F.lit(-105))
            .otherwise(F.lit(0))
            .alias("exit_code"),
        )

    @cached_property
    def event_log(self) -> DataFrame:
        """Every application event; ``file_pos`` numbers those of one application."""
        no_code = F.lit(None).cast("int")
        none = F.array().cast("array<struct<ts_ms:bigint,kind:string,kind_ord:int,exit_code:int>>")

        def mark(ts: Column, kind: str, rank: int, code: Column) -> Column:
            return F.struct(
                ts.alias("ts_ms"), F.lit(kind).alias("kind"), F.lit(rank).alias("kind_ord"),
                code.alias("exit_code"),
            )

        def rows(df: DataFrame, marks: Column, role: Column, idx: Column, host: Column) -> DataFrame:
            return df.select(
                "k", role.alias("role"), idx.alias("idx"), host.alias("host"), F.inline(marks)
            )

        started = F.col("started_ms")
        app_rows = rows(
            self.apps,
            F.concat(
                F.array(mark(started, "APPLICATION_INITED", 0, no_code)),
                F.when(
                    F.col("k") % 10 == 0,
                    F.array(mark(started + 1200000, "APPLICATION_INITED", 0, no_code)),
                ).otherwise(none),
                F.when(
                    F.col("completed_ms") != -1,
                    F.array(mark(F.col("completed_ms"), "APPLICATION_FINISHED", 3, no_code)),
                ).otherwise(none),
            ),
            F.lit(""), F.lit(-1), F.lit("am"),
        )
        task_rows = rows(
            self.tasks,
            F.concat(
                F.array(mark(F.col("start_ms"), "TASK_STARTED", 1, no_code)),
                F.when(
                    F.col("exit_code").isNotNull(),
                    F.array(mark(F.col("end_ms"), "TASK_FINISHED", 2, F.col("exit_code"))),
                ).otherwise(none),
            ),
            F.col("role"), F.col("idx"), F.col("host"),
        )
        log = Series(
            app_rows.unionByName(task_rows), ["k"], ["ts_ms", "kind_ord", "role", "idx"],
            hot=self.app_hot,
        ).row_number("file_pos")
        return log.df.select(
            "k", "ts_ms", "kind", "role", "idx", "host", "exit_code",
            (F.col("file_pos") - 1).alias("file_pos"),
        )

    @cached_property
    def samples(self) -> DataFrame:
        return samples_of(self.raw("events"))

    @cached_property
    def pings(self) -> DataFrame:
        return pings_of(self.raw("events"))

    @cached_property
    def app_config_layer(self) -> DataFrame:
        role = F.lower("p_type")
        unit = (
            F.when(F.col("p_partkey") % 3 == 0, "g").when(F.col("p_partkey") % 3 == 1, "M").otherwise("")
        )
        size = F.col("p_size").cast("string")
        entry = lambda key, value: F.struct(
            F.concat(F.lit("job."), role, F.lit(key)).alias("key"), value.alias("value")
        )
        return self.raw("part").select(
            F.col("p_brand").alias("app"),
            (F.col("p_partkey") % 4).alias("layer"),
            F.col("p_partkey").alias("pos"),
            F.inline(
                F.array(
                    entry(".instances", (F.col("p_size") % 5).cast("string")),
                    entry(".memory", F.concat(size, unit)),
                )
            ),
        )

    @cached_property
    def edges(self) -> DataFrame:
        """Role dependencies per region: every lower-numbered nation of the region with
        (a + b) % 3 <> 1; regions 0 and 3 get one edge back."""
        n = self.raw("nation").select("n_regionkey", "n_nationkey")
        forward = (
            n.alias("a")
            .join(n.alias("b"), "n_regionkey")
            .where(
                (F.col("a.n_nationkey") > F.col("b.n_nationkey"))
                & ((F.col("a.n_nationkey") + F.col("b.n_nationkey")) % 3 != 1)
            )
            .select(
                F.col("n_regionkey").alias("app"),
                F.col("a.n_nationkey").alias("role"),
                F.col("b.n_nationkey").alias("depends_on"),
            )
        )
        back = (
            n.where(F.col("n_regionkey").isin(0, 3))
            .groupBy(F.col("n_regionkey").alias("app"))
            .agg(F.min("n_nationkey").alias("role"), F.max("n_nationkey").alias("depends_on"))
        )
        return forward.unionByName(back)

    @cached_property
    def host_slots(self) -> DataFrame:
        return self.raw("nation").select(
            F.col("n_regionkey").alias("app"),
            F.col("n_nationkey").alias("host_ord"),
            F.col("n_name").alias("host"),
            (1 + F.col("n_nationkey") % 4).cast("int").alias("slots"),
        )

    @cached_property
    def gpu_xml(self) -> DataFrame:
        s = F.col("s_suppkey")

        def gpu(minor: int, util: Column, used: Column, free: Column) -> list[Column]:
            return [
                F.lit(f"<gpu><minor_number>{minor}</minor_number><utilization><gpu_util>"),
                util.cast("string"),
                F.lit(" %</gpu_util></utilization><fb_memory_usage><used>"),
                used.cast("string"),
                F.lit(" MiB</used><free>"),
                free.cast("string"),
                F.lit(" MiB</free></fb_memory_usage></gpu>"),
            ]

        return self.raw("supplier").select(
            s.alias("snap"),
            F.concat(
                F.lit("<nvidia_smi_log><driver_version>375.66</driver_version>"),
                *gpu(0, s % 101, s % 7, 8 + s % 5),
                *gpu(1, (s * 3) % 101, s % 3, 4 + s % 9),
                F.lit("</nvidia_smi_log>"),
            ).alias("xml"),
        )

    @cached_property
    def file_names(self) -> DataFrame:
        text = lambda c: F.col(c).cast("string")
        base = F.when(
            F.col("completed_ms") == -1,
            F.concat("app_id", F.lit("-"), text("started_ms"), F.lit("-"), "usr", F.lit(".jhist.inprogress")),
        ).otherwise(
            F.concat(
                "app_id", F.lit("-"), text("started_ms"), F.lit("-"), text("completed_ms"), F.lit("-"),
                "usr", F.lit("-"), "status", F.lit(".jhist"),
            )
        )
        k, plain = F.col("k"), F.col("base")
        return self.apps.select("k", base.alias("base")).select(
            "k",
            F.when(k % 17 == 3, F.upper(plain))
            .when(k % 17 == 5, F.replace(plain, F.lit("application_"), F.lit("job_")))
            .otherwise(plain)
            .alias("name"),
        )

    @cached_property
    def cluster_specs(self) -> DataFrame:
        """One task and the JSON cluster spec it is given, per application."""
        k = F.col("o_orderkey")
        at = lambda off, mod, port: F.concat(
            F.lit('"host'), ((k + off) % mod).cast("string"), F.lit(":"), port.cast("string"), F.lit('"')
        )
        spec = F.concat(
            F.lit('{"worker":['), at(0, 16, 2000 + k % 50), F.lit(","), at(3, 16, 3000 + k % 50), F.lit("],"),
            F.when(k % 4 == 0, F.lit("")).otherwise(
                F.concat(F.lit('"server":['), at(0, 7, F.lit(4000)), F.lit("],"))
            ),
            F.lit('"scheduler":['),
            F.when(k % 5 == 0, F.lit('"no address"')).otherwise(at(0, 16, 5000 + k % 9)),
            F.when(k % 2 == 1, F.lit('],"Evaluator":[')).otherwise(F.lit('],"evaluator":[')),
            at(5, 16, F.lit(6000)),
            F.lit('],"tensorboard":["host0:7000"]}'),
        )
        return self.raw("orders").select(
            k.alias("k"),
            F.when(k % 3 == 0, "worker").when(k % 3 == 1, "evaluator").otherwise("ps").alias("role"),
            (k % 2).cast("int").alias("idx"),
            spec.alias("spec"),
        )

    @cached_property
    def job_settings(self) -> DataFrame:
        """Settings of each application: what is tracked, what stops it, what waits for what."""
        k = F.col("o_orderkey")
        pick = lambda *values: F.element_at(F.array(*map(F.lit, values)), (k % len(values) + 1).cast("int"))
        entries = {
            "application.untracked.jobtypes": pick("ps", "ps, evaluator", ""),
            "application.stop-on-failure-jobtypes": pick("ps", "worker", "", "ps,worker"),
            "application.fail-on-worker-failure-enabled": pick("true", "false", "false", "FALSE", "no"),
            "worker.depends-on": pick("ps", "ps, evaluator"), "evaluator.depends-on": pick("worker", "", "ps"),
            "worker.instances": F.lit("2"), "application.group.A": pick("worker,chief", "worker", "evaluator"),
            "application.group.B": F.lit("ps"), "application.dependency.evaluator.timeout.after.A": pick("3600", "60"),
            "application.dependency.worker.timeout.after.B": F.lit("1800"),
            "application.dependency.worker.timeout.after.B.ignored": pick("true", "false", "True"),
        }
        pairs = [F.struct(F.lit(f"job.{name}").alias("key"), value.alias("value")) for name, value in entries.items()]
        return self.raw("orders").select(k.alias("k"), F.inline(F.array(*pairs)))

    @cached_property
    def app_edges(self) -> DataFrame:
        return rules.role_edges(self.job_settings)

    @cached_property
    def app_members(self) -> DataFrame:
        return rules.group_members(self.job_settings)

    @cached_property
    def app_group_rules(self) -> DataFrame:
        return rules.group_rules(self.job_settings)

    @cached_property
    def logs(self) -> DataFrame:
        return self.raw("documents").select(F.col("doc_id").alias("task"), "text")


SQL = {
    "apps": """
SELECT o_orderkey AS k,
       concat('application_', CAST(o_custkey AS VARCHAR), '_', CAST(o_orderkey AS VARCHAR)) AS app_id,
       epoch_ms(o_orderdate) AS started_ms,
       CASE WHEN o_orderstatus = 'P' THEN CAST(-1 AS BIGINT)
            ELSE epoch_ms(o_orderdate) + 14400000 + ((o_orderkey * 7919) % 86400) * 1000 END AS completed_ms,
       lower(c_mktsegment) AS usr,
       CASE o_orderstatus WHEN 'F' THEN 'FAILED' WHEN 'O' THEN 'SUCCEEDED' ELSE 'RUNNING' END AS status
FROM orders JOIN customer ON o_custkey = c_custkey""",
    "tasks": """
SELECT l_orderkey AS k,
       CASE l_returnflag WHEN 'N' THEN 'worker' WHEN 'A' THEN 'ps' ELSE 'evaluator' END AS role,
       CAST(row_number() OVER (PARTITION BY l_orderkey, l_returnflag
            ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) - 1 AS INT) AS idx,
       concat('host', CAST(l_suppkey % 16 AS VARCHAR)) AS host,
       epoch_ms(o_orderdate) + CAST(l_linenumber AS BIGINT) * 300000 AS start_ms,
       epoch_ms(o_orderdate) + CAST(l_linenumber AS BIGINT) * 300000 + CAST(l_quantity AS BIGINT) * 60000 AS end_ms,
       CASE WHEN l_linestatus = 'O' AND l_tax < 0.02 THEN NULL
            WHEN l_discount >= 0.09 THEN 1
            WHEN l_linestatus = 'O' AND l_discount <= 0.01 THEN -105
            ELSE 0 END AS exit_code
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "event_log": """
SELECT k, ts_ms, kind, role, idx, host, exit_code,
       CAST(row_number() OVER (PARTITION BY k ORDER BY ts_ms, kind_ord, role, idx) - 1 AS BIGINT) AS file_pos
FROM (
  SELECT k, started_ms AS ts_ms, 'APPLICATION_INITED' AS kind, 0 AS kind_ord, '' AS role, -1 AS idx, 'am' AS host, CAST(NULL AS INT) AS exit_code FROM apps
  UNION ALL SELECT k, started_ms + 1200000, 'APPLICATION_INITED', 0, '', -1, 'am', CAST(NULL AS INT) FROM apps WHERE k % 10 = 0
  UNION ALL SELECT k, start_ms, 'TASK_STARTED', 1, role, idx, host, CAST(NULL AS INT) FROM tasks
  UNION ALL SELECT k, end_ms, 'TASK_FINISHED', 2, role, idx, host, exit_code FROM tasks WHERE exit_code IS NOT NULL
  UNION ALL SELECT k, completed_ms, 'APPLICATION_FINISHED', 3, '', -1, 'am', CAST(NULL AS INT) FROM apps WHERE completed_ms <> -1
) u""",
    "samples": """
SELECT user_id AS task, event_id AS id, epoch_us(ts) // 1000 AS ts_ms,
       CASE WHEN event_type = 'error' THEN NULL ELSE value END AS value
FROM events""",
    "pings": """
SELECT user_id AS task, event_id AS id, epoch_us(ts) // 1000 AS ts_ms,
       CASE event_type WHEN 'signup' THEN 'register' WHEN 'purchase' THEN 'result' ELSE 'ping' END AS kind
FROM events""",
    "app_config_layer": """
SELECT p_brand AS app, p_partkey % 4 AS layer, p_partkey AS pos,
       concat('job.', lower(p_type), '.instances') AS key, CAST(p_size % 5 AS VARCHAR) AS value
FROM part
UNION ALL
SELECT p_brand, p_partkey % 4, p_partkey, concat('job.', lower(p_type), '.memory'),
       concat(CAST(p_size AS VARCHAR), CASE p_partkey % 3 WHEN 0 THEN 'g' WHEN 1 THEN 'M' ELSE '' END)
FROM part""",
    "edges": """
SELECT a.n_regionkey AS app, a.n_nationkey AS role, b.n_nationkey AS depends_on
FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey > b.n_nationkey
WHERE (a.n_nationkey + b.n_nationkey) % 3 <> 1
UNION ALL
SELECT n_regionkey, min(n_nationkey), max(n_nationkey) FROM nation WHERE n_regionkey IN (0, 3) GROUP BY n_regionkey""",
    "host_slots": """
SELECT n_regionkey AS app, n_nationkey AS host_ord, n_name AS host, CAST(1 + n_nationkey % 4 AS INT) AS slots FROM nation""",
    "gpu_xml": """
SELECT s_suppkey AS snap,
       concat('<nvidia_smi_log><driver_version>375.66</driver_version>',
         '<gpu><minor_number>0</minor_number><utilization><gpu_util>', CAST(s_suppkey % 101 AS VARCHAR), ' %</gpu_util></utilization>',
         '<fb_memory_usage><used>', CAST(s_suppkey % 7 AS VARCHAR), ' MiB</used><free>', CAST(8 + s_suppkey % 5 AS VARCHAR), ' MiB</free></fb_memory_usage></gpu>',
         '<gpu><minor_number>1</minor_number><utilization><gpu_util>', CAST((s_suppkey * 3) % 101 AS VARCHAR), ' %</gpu_util></utilization>',
         '<fb_memory_usage><used>', CAST(s_suppkey % 3 AS VARCHAR), ' MiB</used><free>', CAST(4 + s_suppkey % 9 AS VARCHAR), ' MiB</free></fb_memory_usage></gpu>',
         '</nvidia_smi_log>') AS xml
FROM supplier""",
    "job_settings": """
SELECT o_orderkey AS k, unnest(['job.application.untracked.jobtypes', 'job.application.stop-on-failure-jobtypes', 'job.application.fail-on-worker-failure-enabled',
         'job.worker.depends-on', 'job.evaluator.depends-on', 'job.worker.instances', 'job.application.group.A', 'job.application.group.B',
         'job.application.dependency.evaluator.timeout.after.A', 'job.application.dependency.worker.timeout.after.B', 'job.application.dependency.worker.timeout.after.B.ignored']) AS key,
       unnest([['ps', 'ps, evaluator', ''][o_orderkey % 3 + 1], ['ps', 'worker', '', 'ps,worker'][o_orderkey % 4 + 1], ['true', 'false', 'false', 'FALSE', 'no'][o_orderkey % 5 + 1],
         ['ps', 'ps, evaluator'][o_orderkey % 2 + 1], ['worker', '', 'ps'][o_orderkey % 3 + 1], '2', ['worker,chief', 'worker', 'evaluator'][o_orderkey % 3 + 1], 'ps',
         ['3600', '60'][o_orderkey % 2 + 1], '1800', ['true', 'false', 'True'][o_orderkey % 3 + 1]]) AS value
FROM orders""",
    "app_rules": """
SELECT k, list_transform(string_split(concat(coalesce(max(value) FILTER (key = 'job.application.untracked.jobtypes'), ''), ',tensorboard'), ','), lambda x: trim(x)) AS off_roles,
       list_transform(string_split(coalesce(max(value) FILTER (key = 'job.application.stop-on-failure-jobtypes'), ''), ','), lambda x: trim(x)) AS stop_roles,
       coalesce(lower(max(value) FILTER (key = 'job.application.fail-on-worker-failure-enabled')), 'false') = 'true' AS strict
FROM job_settings GROUP BY k""",
    "app_edges": """
SELECT DISTINCT * FROM (SELECT k, regexp_extract(key, '^job\\.([a-z]+)\\.depends-on$', 1) AS role, trim(unnest(string_split(value, ','))) AS depends_on
FROM job_settings WHERE key LIKE 'job.%.depends-on') e WHERE depends_on <> ''""",
    "app_members": """
SELECT k, regexp_extract(key, '^job\\.application\\.group\\.([A-Za-z]+)$', 1) AS grp, trim(unnest(string_split(value, ','))) AS role
FROM job_settings WHERE key LIKE 'job.application.group.%'""",
    "app_group_rules": """
SELECT k, regexp_extract(key, 'dependency\\.([A-Za-z]+)\\.', 1) AS role, regexp_extract(key, 'after\\.([A-Za-z]+)', 1) AS grp,
       max(CAST(v AS INT)) AS timeout_s, coalesce(bool_or(lower(value) = 'true') FILTER (key LIKE '%.ignored'), false) AS ignored
FROM (SELECT k, key, CASE WHEN key LIKE '%.ignored' THEN NULL ELSE value END AS v, value FROM job_settings WHERE key LIKE 'job.application.dependency.%') d
GROUP BY 1, 2, 3""",
    "file_names": """
SELECT k, CASE WHEN k % 17 = 3 THEN upper(base) WHEN k % 17 = 5 THEN replace(base, 'application_', 'job_') ELSE base END AS name
FROM (SELECT k, CASE WHEN completed_ms = -1
         THEN concat(app_id, '-', CAST(started_ms AS VARCHAR), '-', usr, '.jhist.inprogress')
         ELSE concat(app_id, '-', CAST(started_ms AS VARCHAR), '-', CAST(completed_ms AS VARCHAR), '-', usr, '-', status, '.jhist') END AS base
      FROM apps) b""",
    "cluster_specs": """
SELECT o_orderkey AS k,
       CASE o_orderkey % 3 WHEN 0 THEN 'worker' WHEN 1 THEN 'evaluator' ELSE 'ps' END AS role,
       CAST(o_orderkey % 2 AS INT) AS idx,
       concat('{"worker":["host', o_orderkey % 16, ':', 2000 + o_orderkey % 50, '","host', (o_orderkey + 3) % 16, ':', 3000 + o_orderkey % 50, '"],',
         CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE concat('"server":["host', o_orderkey % 7, ':4000"],') END,
         '"scheduler":[', CASE WHEN o_orderkey % 5 = 0 THEN '"no address"' ELSE concat('"host', o_orderkey % 16, ':', 5000 + o_orderkey % 9, '"') END,
         '],"', CASE WHEN o_orderkey % 2 = 1 THEN 'Evaluator' ELSE 'evaluator' END, '":["host', (o_orderkey + 5) % 16, ':6000"],',
         '"tensorboard":["host0:7000"]}') AS spec
FROM orders""",
    "logs": "SELECT doc_id AS task, text FROM documents",
}
NEEDS = {
    "event_log": ["apps", "tasks"], "file_names": ["apps"],
    **{view: ["job_settings"] for view in ("app_rules", "app_edges", "app_members", "app_group_rules")},
}


def with_views(sql: str, *views: str, recursive: bool = False) -> str:
    """``sql`` (a SELECT, or ``name AS (...), ... SELECT``) under the named views; whole text stays."""
    names: list[str] = []
    for view in views:
        for v in [*NEEDS.get(view, []), view]:
            if v not in names:
                names.append(v)
    head = ",\n".join(f"{v} AS ({SQL[v]})" for v in names)
    sql = sql.strip()
    lead = "WITH RECURSIVE " if recursive else "WITH "
    if sql.upper().startswith("WITH"):
        return sql
    if sql.upper().startswith("SELECT"):
        return f"{lead}{head}\n{sql}" if names else sql
    return f"{lead}{head + ',' if names else ''}\n{sql}"
