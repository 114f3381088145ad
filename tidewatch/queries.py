"""Queries over the driver's ``events`` table, each with its SQL for DuckDB.

The table's events stand for security events: ``event_type`` is the event's name, the
user its source, and addresses are made from the ids. Events are about ten hours apart
for a user, so time limits are hours.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions import predicates, scalars
from tidewatch.functions.intel import IntelGroups
from tidewatch.functions.versions import VersionedGroups, parsed
from tidewatch.operators import sequences, windows
from tidewatch.operators.automaton import Stage, match_pattern
from tidewatch.plans.compiler import compile_rule, fan_out, one_pass
from tidewatch.plans.matchsql import match_recognize
from tidewatch.plans.multirule import one_scan
from tidewatch.plans.rules import Rule
from tidewatch.shared import scratch
from tidewatch.sources import generators, readers, sinks
from tidewatch.streaming import joins, stateful

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

TIE = ["event_id"]
_SLIM = ["event_id", "ts", "user_id", "event_type", "value"]


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events with addresses; times as timestamps."""
    return _addressed(spark.read.parquet(f"{sf_dir}/events.parquet"))


def _addressed(df: DataFrame) -> DataFrame:
    part = lambda *cs: F.concat_ws(".", *[c if isinstance(c, str) else c.cast("string") for c in cs])
    return df.select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value", "props",
        part(F.lit("172"), F.lit("16"), F.col("user_id") % 8, F.col("event_id") % 256).alias("src_address"),
        part(F.lit("172"), F.lit("16"), F.col("event_id") % 8, F.col("user_id") % 256).alias("dst_address"),
    )


_EVENTS = """WITH ev AS (
  SELECT event_id, ts, user_id, event_type, value, props,
         '172.16.' || (user_id % 8) || '.' || (event_id % 256) AS src_address,
         '172.16.' || (event_id % 8) || '.' || (user_id % 256) AS dst_address
  FROM events)
"""


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql if sql.lstrip().upper().startswith("WITH") else _EVENTS + sql
        return f

    return put


def _is(name: str):
    return F.col("event_type") == name


# --- predicates -----------------------------------------------------------------


@query("having_any", "SELECT event_id, user_id, value FROM ev WHERE (event_type = 'purchase' AND value > 50) OR NOT (event_type <> 'error' OR value < 20)")
def having_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = events(spark, sf_dir)
    test = predicates.condition(df, "event_type = purchase and value > 50 or not (event_type != error or value < 20)")
    return windows.having_any(df, test).select("event_id", "user_id", "value")


_MATRIX = {
    "eq": ("event_type = click", "event_type = 'click'"),
    "ne": ("event_type != click", "event_type <> 'click'"),
    "gt": ("value > 42.5", "value > 42.5"),
    "gte": ("user_id >= 7", "user_id >= 7"),
    "lt": ("value < 10", "value < 10"),
    "lte": ("user_id <= 3", "user_id <= 3"),
    "like": ("event_type like ur", "contains(event_type, 'ur')"),
    "rlike": ("event_type rlike \"c.*k|v.+\"", "regexp_full_match(event_type, 'c.*k|v.+')"),
    "ip_range": ("src_address in 172.16.2.200-172.16.1.10", "(user_id % 8) * 256 + event_id % 256 BETWEEN 266 AND 712"),
    "ip_block": ("src_address in 172.16.4.0/23", "user_id % 8 IN (4, 5)"),
    "exist": ("props exist", "props IS NOT NULL"),
    "not_exist": ("not_exist threat_info", "true"),
    "missing": ("threat_info > 1", "false"),
    "not_missing": ("not threat_info > 1", "true"),
    "mixed": ("not (event_type = click or event_type = view) and value >= 5", "event_type NOT IN ('click', 'view') AND value >= 5"),
}


@query("predicate_matrix", "SELECT event_id, " + ", ".join(f"coalesce({sql}, false) AS p_{name}" for name, (_, sql) in _MATRIX.items()) + " FROM ev")
def predicate_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = events(spark, sf_dir)
    return df.select("event_id", *[predicates.where(df, text).alias(f"p_{name}") for name, (text, _) in _MATRIX.items()])


@query("contain_array", "SELECT event_id, event_id % 3 = 1 OR event_id % 5 = 1 AS has_one FROM ev")
def contain_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = events(spark, sf_dir).withColumn("codes", F.array(F.col("event_id") % 3, F.col("event_id") % 5))
    return df.select("event_id", predicates.where(df, "codes contain 1").alias("has_one"))


@query("json_field", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM ev WHERE TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) >= 50")
def json_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = events(spark, sf_dir)
    return df.where(predicates.condition(df, "k >= 50", raw="props")).select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query("ioc_match", "SELECT event_id FROM ev WHERE event_id % 4 = 2")
def ioc_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = events(spark, sf_dir).withColumn("ioc_matcher", F.concat(F.lit("m"), (F.col("event_id") % 4).cast("string")))
    return df.where(predicates.condition(df, "match m2")).select("event_id")


# --- intelligence groups ----------------------------------------------------------

_GROUPS = [
    ("g1", "bad hosts", "ip", "", "172.16.1.7"), ("g1", "bad hosts", "ip", "", "172.16.3.0/25"), ("g1", "bad hosts", "ip", "", "172.16.5.200-172.16.5.100"),
    ("g2", "bad events", "string", "email", "error"), ("g2", "bad events", "string", "email", "signup"), ("g3", "numbers", "num", "", "3"), ("g3", "numbers", "num", "", "5"),
]
_BAD_HOST = "((user_id % 8 = 1 AND event_id % 256 = 7) OR (user_id % 8 = 3 AND event_id % 256 < 128) OR (user_id % 8 = 5 AND event_id % 256 BETWEEN 100 AND 200))"


def _groups(spark: SparkSession, limit: int = 512) -> IntelGroups:
    return IntelGroups(spark.createDataFrame(_GROUPS, "group_id string, name string, type string, intelligence_type string, content string"), literal_limit=limit)


@query("intel_belong", f"SELECT event_id, {_BAD_HOST} AS bad_host, event_type NOT IN ('error', 'signup') AS fine_event, user_id IN (3, 5) AS by_id, false AS unknown FROM ev")
def intel_belong(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, g = events(spark, sf_dir), _groups(spark)
    is_in = lambda text: predicates.where(df, text, member=g.member)
    return df.select("event_id", is_in('src_address belong "bad hosts"').alias("bad_host"), is_in("not event_type belong g2").alias("fine_event"), is_in("user_id belong numbers").alias("by_id"), is_in("user_id belong nobody").alias("unknown"))


@query("intel_join", f"SELECT event_id, {_BAD_HOST} AS bad_host, event_type IN ('error', 'signup') AS bad_event FROM ev")
def intel_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with groups too large for literals: joins by content and by leading bits."""
    g = _groups(spark, limit=0)
    df = g.mark(g.mark(events(spark, sf_dir), "src_address", "bad hosts", "bad_host"), "event_type", "g2", "bad_event")
    return df.select("event_id", "bad_host", "bad_event")


@query("sql_belong", f"SELECT event_id FROM ev WHERE {_BAD_HOST} AND NOT event_type IN ('error', 'signup')")
def sql_belong(spark: SparkSession, sf_dir: str) -> DataFrame:
    _groups(spark).register_sql()
    events(spark, sf_dir).createOrReplaceTempView("tw_events")
    return spark.sql("SELECT event_id FROM tw_events WHERE belong(src_address, 'bad hosts') AND NOT belong(event_type, 'g2') AND NOT belong(NULL, 'g2') AND NOT belong('x', 'nobody')")


@query("intel_patterns_large", f"SELECT event_id, EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = ev.event_id) AND user_id < 100 AS known, EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = ev.event_id AND o.o_custkey % 10 = user_id % 10) AS shaped FROM ev")
def intel_patterns_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pattern for each order: as whole addresses and as parts of a text. The plan doesn't grow with the patterns."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    url = F.concat(F.lit("https?://shop\\.example/o"), "o_orderkey", F.lit("/u[0-9]{1,2}"))
    part = F.concat(F.lit("o"), "o_orderkey", F.lit("/u[0-9]*"), F.col("o_custkey") % 10, F.lit("$"))
    group = lambda k, kind, content: orders.select(F.lit(k).alias("group_id"), F.lit(k).alias("name"), F.lit("string").alias("type"), F.lit(kind).alias("intelligence_type"), content.alias("content"))
    g = IntelGroups(group("pages", "url", url).unionByName(group("shapes", "hash", part)), patterns=True, literal_limit=0)
    df = events(spark, sf_dir).withColumn("url", F.concat(F.lit("http://shop.example/o"), "event_id", F.lit("/u"), "user_id"))
    return g.mark(g.mark(df, "url", "pages", "known"), "url", "shapes", "shaped").select("event_id", "known", "shaped")


#: Messages with what the store held, by day of January 2024.
_CHANGES = [
    (1, "intelligence_group;h,e;add", ("hosts", "ip"), None), (2, "intelligence;h;edit", None, ["172.16.1.7", "172.16.3.0/25"]), (3, "intelligence;e;edit", None, ["error"]), (8, "intelligence;h;edit", None, ["172.16.5.200-172.16.5.100"]),
    (12, "intelligence_group;h;edit", ("bad hosts", "ip"), None), (15, "intelligence;e;edit", None, ["signup", "click"]), (20, "intelligence_group;h;delete", None, None), (22, "intelligence_group;e;delete", None, None),
    (24, "intelligence_group;e;add", ("kinds", "string"), None), (26, "intelligence;e;edit", None, ["view"]),
]


def _change_log(spark: SparkSession) -> DataFrame:
    """Group e's own name and type are always kinds, string."""
    rows = [(day, m, info and info[0], info and info[1], contents) for day, m, info, contents in _CHANGES]
    df = parsed(spark.createDataFrame(rows, "day int, message string, name string, type string, contents array<string>"))
    kinds = F.col("group_id") == "e"
    return df.select(F.make_timestamp(F.lit(2024), F.lit(1), "day", F.lit(0), F.lit(0), F.lit(0)).alias("at"), "module", "group_id", "op", F.when(kinds, "kinds").otherwise(F.col("name")).alias("name"), F.when(kinds, "string").otherwise(F.col("type")).alias("type"), F.lit("").alias("intelligence_type"), "contents")


_DAY = lambda n: f"TIMESTAMP '2024-01-{n:02}'"
_NARROW, _RANGE = "((user_id % 8 = 1 AND event_id % 256 = 7) OR (user_id % 8 = 3 AND event_id % 256 < 128))", "(user_id % 8 = 5 AND event_id % 256 BETWEEN 100 AND 200)"
_AS_OF = f"""SELECT event_id, (ts >= {_DAY(2)} AND ts < {_DAY(8)} AND {_NARROW}) OR (ts >= {_DAY(8)} AND ts < {_DAY(12)} AND {_RANGE}) AS by_name, (ts >= {_DAY(2)} AND ts < {_DAY(8)} AND {_NARROW}) OR (ts >= {_DAY(8)} AND ts < {_DAY(20)} AND {_RANGE}) AS by_id,
ts >= {_DAY(12)} AND ts < {_DAY(20)} AND {_RANGE} AS renamed, (ts >= {_DAY(3)} AND ts < {_DAY(15)} AND event_type = 'error') OR (ts >= {_DAY(15)} AND ts < {_DAY(22)} AND event_type IN ('signup', 'click')) OR (ts >= {_DAY(26)} AND event_type = 'view') AS kind FROM ev"""


def _as_of(df: DataFrame, groups: VersionedGroups) -> DataFrame:
    for field, group, flag in (("src_address", "hosts", "by_name"), ("src_address", "h", "by_id"), ("src_address", "bad hosts", "renamed"), ("event_type", "kinds", "kind")):
        df = groups.mark(df, "ts", field, group, flag)
    return df.select("event_id", "by_name", "by_id", "renamed", "kind")


@query("intel_as_of", _AS_OF)
def intel_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event with the groups of its own time, from a log of additions, renamings, deletions and new contents."""
    return _as_of(events(spark, sf_dir).select("event_id", "ts", "event_type", "src_address"), VersionedGroups(_change_log(spark)))


@query("stream_intel_as_of", _AS_OF)
def stream_intel_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _drained(_as_of(_stream(spark, sf_dir, "src_address"), VersionedGroups(_change_log(spark))), "as_of")


# --- windows ----------------------------------------------------------------------

_HOP = """, h AS (
  SELECT *, time_bucket(INTERVAL '8 hours', ts, TIMESTAMP '1970-01-01') - unnest([0, 1, 2]) * INTERVAL '8 hours' AS window_start FROM ev
)
"""
_END = "window_start + INTERVAL '24 hours' AS window_end"


def _naive(df: DataFrame) -> DataFrame:
    """Window bounds without a zone, as in the table."""
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in df.columns if c in ("window_start", "window_end")})


@query("having_count_hop", _EVENTS + _HOP + f"SELECT user_id::VARCHAR AS user_id, event_type, window_start, {_END}, count(*) AS cnt FROM h GROUP BY ALL HAVING count(*) >= 3")
def having_count_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _naive(windows.having_count(events(spark, sf_dir), ["user_id", "event_type"], "ts", "24 hours", "8 hours", least=3))


@query("having_count_predicate", _EVENTS + _HOP + f"SELECT user_id::VARCHAR AS user_id, window_start, {_END}, count(*) AS cnt FROM h WHERE event_type = 'purchase' OR value > 50 GROUP BY ALL HAVING count(*) > 3")
def having_count_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: predicate text, hopping windows, a threshold."""
    df = events(spark, sf_dir)
    return _naive(windows.having_count(df.where(predicates.condition(df, "event_type = purchase or value > 50")), ["user_id"], "ts", "24 hours", "8 hours", least=3, strict=True))


@query("having_count_tumble", "SELECT event_type, time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '1970-01-01') AS window_start, time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '1970-01-01') + INTERVAL '6 hours' AS window_end, count(*) AS cnt FROM ev GROUP BY ALL")
def having_count_tumble(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _naive(windows.having_count(events(spark, sf_dir), ["event_type"], "ts", "6 hours"))


@query("having_count_global", _EVENTS + _HOP + f"SELECT window_start, {_END}, count(*) AS cnt FROM h GROUP BY ALL HAVING count(*) > 30")
def having_count_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _naive(windows.having_count(events(spark, sf_dir), [], "ts", "24 hours", "8 hours", least=30, strict=True))


@query("having_count_distinct_hop", _EVENTS + _HOP + f"SELECT event_type, window_start, {_END}, count(DISTINCT coalesce(CASE WHEN user_id % 7 <> 0 THEN user_id::VARCHAR END, 'None')) AS cnt FROM h GROUP BY ALL")
def having_count_distinct_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = events(spark, sf_dir).withColumn("who", F.when(F.col("user_id") % 7 != 0, F.col("user_id")))
    return _naive(windows.having_count_distinct(df, ["event_type"], "ts", "who", "24 hours", "8 hours"))


@query("having_sum_hop", _EVENTS + _HOP + f"SELECT coalesce(k, 'None') AS k, window_start, {_END}, sum(amount) AS total FROM (SELECT *, CASE WHEN user_id % 5 <> 0 THEN user_id::VARCHAR END AS k, coalesce(round(value), 0) AS amount FROM h) GROUP BY ALL HAVING sum(amount) > 100")
def having_sum_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numeric text is summed; rows without the key form a group."""
    df = events(spark, sf_dir).select("ts", F.when(F.col("user_id") % 5 != 0, F.col("user_id")).alias("k"), F.round("value").cast("string").alias("amount"))
    return _naive(windows.having_sum(df, ["k"], "ts", "amount", "24 hours", "8 hours", least=100))


@query("session_count", _EVENTS + """, g AS (SELECT *, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > INTERVAL '6 hours', true) AS fresh FROM ev),
s AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM g)
SELECT user_id::VARCHAR AS user_id, min(ts) AS window_start, max(ts) + INTERVAL '6 hours' AS window_end, count(*) AS cnt FROM s GROUP BY user_id, n""")
def session_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _naive(windows.session_count(events(spark, sf_dir), ["user_id"], "ts", "6 hours"))


@query("sql_hop_count", ORACLE_SQL["having_count_hop"].replace("HAVING count(*) >= 3", "HAVING count(*) > 4").replace("user_id::VARCHAR AS user_id", "user_id"))
def sql_hop_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Window aggregation as SQL text over a registered table."""
    events(spark, sf_dir).createOrReplaceTempView("tw_events")
    return _naive(spark.sql("SELECT user_id, event_type, window.start AS window_start, window.end AS window_end, count(*) AS cnt FROM tw_events GROUP BY window(ts, '24 hours', '8 hours'), user_id, event_type HAVING count(*) > 4"))


@query("sql_tumble_filtered", "SELECT user_id, time_bucket(INTERVAL '12 hours', ts, TIMESTAMP '1970-01-01') AS window_start, count(1) AS cnt FROM ev WHERE event_type = 'error' GROUP BY ALL")
def sql_tumble_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    events(spark, sf_dir).createOrReplaceTempView("tw_events")
    return _naive(spark.sql("SELECT user_id, window.start AS window_start, count(1) AS cnt FROM tw_events WHERE event_type = 'error' GROUP BY window(ts, '12 hours'), user_id"))


# --- sequences ----------------------------------------------------------------------


def _pair(found: DataFrame) -> DataFrame:
    return found.select(F.col("a_user_id").alias("user_id"), F.col("a_event_id").alias("a_id"), F.col("b_event_id").alias("b_id"))


@query("followed_by_next", """, n AS (SELECT *, first(CASE WHEN event_type = 'purchase' THEN {'id': event_id, 't': ts} END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS b FROM ev)
SELECT user_id, event_id AS a_id, b.id AS b_id FROM n WHERE event_type = 'view' AND b.t - ts < INTERVAL '6 hours'""")
def followed_by_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = events(spark, sf_dir).select(*_SLIM)
    return _pair(sequences.followed_by(df, _is("view"), _is("purchase"), ["user_id"], "ts", TIE, "6 hours"))


_PAST = """, r AS (SELECT *, count(*) FILTER (event_type = 'purchase') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS run FROM ev),
e AS (SELECT user_id, run, event_id AS b_id, ts AS b_ts FROM r WHERE event_type = 'purchase')
"""


@query("followed_by_past_last", _EVENTS + _PAST + "SELECT r.user_id, arg_min(r.event_id, (r.ts, r.event_id)) AS a_id, e.b_id FROM r JOIN e USING (user_id, run) WHERE r.event_type = 'view' AND e.b_ts - r.ts < INTERVAL '24 hours' GROUP BY r.user_id, r.run, e.b_id")
def followed_by_past_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = events(spark, sf_dir).select(*_SLIM)
    return _pair(sequences.followed_by(df, _is("view"), _is("purchase"), ["user_id"], "ts", TIE, "24 hours", skip="past_last"))


@query("followed_by_relation", """, p AS (SELECT a.event_id AS a_id, b.event_id AS b_id, row_number() OVER (PARTITION BY a.event_id ORDER BY b.ts, b.event_id) AS n
FROM ev a JOIN ev b ON a.src_address = b.dst_address AND (b.ts, b.event_id) > (a.ts, a.event_id) AND b.ts - a.ts < INTERVAL '48 hours'
WHERE a.event_type = 'error' AND b.event_type = 'purchase') SELECT a_id, b_id FROM p WHERE n = 1""")
def followed_by_relation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A related to B by an address, without a key: re-keyed by the related fields."""
    df = events(spark, sf_dir).select("event_id", "ts", "event_type", "src_address", "dst_address")
    found = sequences.followed_by(df, _is("error"), _is("purchase"), [], "ts", TIE, "48 hours", relation=[("src_address", "dst_address")])
    return found.select(F.col("a_event_id").alias("a_id"), F.col("b_event_id").alias("b_id"))


@query("followed_by_strict", """, n AS (SELECT *, lead(event_type) OVER w AS nt, lead(event_id) OVER w AS ni, lead(ts) OVER w AS nts FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, event_id AS a_id, ni AS b_id FROM n WHERE event_type = 'view' AND nt = 'purchase' AND nts - ts < INTERVAL '24 hours'""")
def followed_by_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = events(spark, sf_dir).select(*_SLIM)
    return _pair(sequences.followed_by(df, _is("view"), _is("purchase"), ["user_id"], "ts", TIE, "24 hours", contiguity="strict"))


@query("match_sql_ab", ORACLE_SQL["followed_by_strict"].replace("SELECT user_id, event_id AS a_id, ni AS b_id", "SELECT user_id, event_id AS first_id, ni AS last_id, value AS first_value"))
def match_sql_ab(spark: SparkSession, sf_dir: str) -> DataFrame:
    events(spark, sf_dir).createOrReplaceTempView("tw_events")
    return match_recognize(spark, """SELECT * FROM tw_events MATCH_RECOGNIZE (
        PARTITION BY user_id ORDER BY ts MEASURES A.event_id AS first_id, B.event_id AS last_id, A.value AS first_value
        ONE ROW PER MATCH AFTER MATCH SKIP PAST LAST ROW PATTERN (A B) WITHIN INTERVAL '24' HOUR
        DEFINE A AS A.event_type = 'view', B AS B.event_type = 'purchase') AS T""", ("event_id",))


_STRICT_RUN = """, n AS (SELECT *, count(*) FILTER (event_type <> 'view') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS run FROM ev),
e AS (SELECT user_id, run, event_id AS b_id, ts AS b_ts FROM n WHERE event_type = 'purchase')
"""


@query("match_sql_repeat", _EVENTS + _STRICT_RUN + "SELECT n.user_id, arg_min(n.event_id, (n.ts, n.event_id)) AS first_id, e.b_id AS last_id FROM n JOIN e USING (user_id, run) WHERE n.event_type = 'view' AND e.b_ts - n.ts < INTERVAL '96 hours' GROUP BY n.user_id, n.run, e.b_id HAVING count(*) >= 2")
def match_sql_repeat(spark: SparkSession, sf_dir: str) -> DataFrame:
    events(spark, sf_dir).createOrReplaceTempView("tw_events")
    return match_recognize(spark, """SELECT * FROM tw_events MATCH_RECOGNIZE (
        PARTITION BY user_id ORDER BY ts MEASURES FIRST(A.event_id) AS first_id, B.event_id AS last_id
        ONE ROW PER MATCH AFTER MATCH SKIP PAST LAST ROW PATTERN (A{2,} B) WITHIN INTERVAL '96' HOUR
        DEFINE A AS A.event_type = 'view', B AS B.event_type = 'purchase') AS T""", ("event_id",))


@query("repeat_then", _EVENTS + _PAST + "SELECT r.user_id, arg_min(r.event_id, (r.ts, r.event_id)) AS a_id, e.b_id, count(*) AS times FROM r JOIN e USING (user_id, run) WHERE r.event_type = 'click' AND e.b_ts - r.ts < INTERVAL '72 hours' GROUP BY r.user_id, r.run, e.b_id HAVING count(*) >= 2")
def repeat_then(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = events(spark, sf_dir).select(*_SLIM)
    found = sequences.repeated_then(df, _is("click"), _is("purchase"), 2, ["user_id"], "ts", TIE, "72 hours")
    return found.select(F.col("a_user_id").alias("user_id"), F.col("a_event_id").alias("a_id"), F.col("b_event_id").alias("b_id"), "times")


@query("repeat_until", """, r AS (SELECT *, count(*) FILTER (event_type = 'purchase') OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM ev),
k AS (SELECT *, row_number() OVER (PARTITION BY user_id, run ORDER BY ts, event_id) AS i FROM r WHERE event_type = 'click')
SELECT user_id::VARCHAR AS user_id, string_agg(event_id::VARCHAR, ',' ORDER BY i) AS ids FROM k GROUP BY user_id, run, (i - 1) // 3 HAVING count(*) = 3""")
def repeat_until(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three clicks without a purchase between them; a purchase discards what was begun."""
    df = events(spark, sf_dir).select(*_SLIM)
    found = sequences.repeated_until(df, _is("click"), _is("purchase"), 3, ["user_id"], "ts", TIE)
    return found.select(F.col("signature").alias("user_id"), F.array_join(F.transform("events", lambda e: e["event_id"].cast("string")), ",").alias("ids"))


@query("repeat_until_automaton", ORACLE_SQL["repeat_until"])
def repeat_until_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by the general automaton."""
    df = events(spark, sf_dir).select(*_SLIM)
    found = match_pattern(df, [Stage("a", _is("click"), 3, None, until=_is("purchase"))], ["user_id"], "ts", TIE)
    return found.select(F.col("signature").alias("user_id"), F.array_join(F.transform("events", lambda e: e["event"]["event_id"].cast("string")), ",").alias("ids"))


@query("repeat_until_unkeyed", ORACLE_SQL["repeat_until"].replace("PARTITION BY user_id ORDER", "ORDER").replace("PARTITION BY user_id, run", "PARTITION BY run").replace("user_id::VARCHAR AS user_id, ", "").replace("GROUP BY user_id, run", "GROUP BY run"))
def repeat_until_unkeyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without a key, shared out in parts of equal size whose summaries are put together."""
    df = events(spark, sf_dir).select(*_SLIM)
    found = match_pattern(df, [Stage("a", _is("click"), 3, None, until=_is("purchase"))], [], "ts", TIE)
    return found.select(F.array_join(F.transform("events", lambda e: e["event"]["event_id"].cast("string")), ",").alias("ids"))


@query("not_followed_by", "SELECT event_id, user_id FROM ev a WHERE event_type = 'view' AND NOT EXISTS (SELECT 1 FROM ev b WHERE b.user_id = a.user_id AND b.event_type = 'purchase' AND (b.ts, b.event_id) > (a.ts, a.event_id) AND b.ts - a.ts < INTERVAL '6 hours')")
def not_followed_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = events(spark, sf_dir).select(*_SLIM)
    return sequences.not_followed_by(df, _is("view"), _is("purchase"), ["user_id"], "ts", TIE, "6 hours").select("event_id", "user_id")


_BEFORE = """, n AS (SELECT *, last(CASE WHEN event_type = 'view' THEN {'id': event_id, 't': ts} END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS a FROM ev),
b AS (SELECT user_id, ts, event_id, a.id AS a_id FROM n WHERE event_type = 'purchase' AND (a IS NULL OR ts - a.t > INTERVAL '24 hours'))
"""


@query("not_before", _EVENTS + _BEFORE + "SELECT user_id::VARCHAR AS signature, event_id AS b_id, a_id FROM b")
def not_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = events(spark, sf_dir).select(*_SLIM)
    found = sequences.not_before(df, _is("view"), _is("purchase"), "ts", TIE, "24 hours", ["user_id"], ["user_id"])
    return found.select("signature", F.col("b_event_id").alias("b_id"), F.col("a_event_id").alias("a_id"))


@query("not_before_silenced", (_EVENTS + _BEFORE).replace("WITH ev", "WITH RECURSIVE ev") + """, o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM b),
t(user_id, i, ts, b_id, a_id) AS (SELECT user_id, i, ts, event_id, a_id FROM o WHERE i = 1
UNION ALL SELECT o.user_id, o.i, o.ts, o.event_id, o.a_id FROM t JOIN o ON o.user_id = t.user_id AND o.i = (SELECT min(x.i) FROM o x WHERE x.user_id = t.user_id AND x.i > t.i AND x.ts - t.ts > INTERVAL '72 hours'))
SELECT user_id::VARCHAR AS signature, b_id, a_id FROM t""")
def not_before_silenced(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = events(spark, sf_dir).select(*_SLIM)
    found = sequences.not_before(df, _is("view"), _is("purchase"), "ts", TIE, "24 hours", ["user_id"], ["user_id"], "72 hours")
    return found.select("signature", F.col("b_event_id").alias("b_id"), F.col("a_event_id").alias("a_id"))


# --- variants of the sequences --------------------------------------------------------


@query("followed_by_unkeyed", ORACLE_SQL["followed_by_next"].replace("PARTITION BY user_id ", "").replace("6 hours", "2 hours").replace("SELECT user_id, event_id", "SELECT event_id").replace("event_type = 'view' AND", "event_type = 'view' AND value > 40 AND"))
def followed_by_unkeyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicate text on both sides, no key: shared out by time alone."""
    df = events(spark, sf_dir).select(*_SLIM)
    test = lambda text: predicates.where(df, text)
    found = sequences.followed_by(df, test("event_type = view and value > 40"), test("event_type = purchase"), [], "ts", TIE, "2 hours")
    return found.select(F.col("a_event_id").alias("a_id"), F.col("b_event_id").alias("b_id"))


_ALONE = "FROM ev a WHERE event_type = 'error' AND NOT EXISTS (SELECT 1 FROM ev b WHERE b.dst_address = a.src_address AND b.event_type = 'purchase' AND (b.ts, b.event_id) > (a.ts, a.event_id) AND b.ts - a.ts < INTERVAL '48 hours')"


@query("not_followed_by_relation", f"SELECT event_id {_ALONE}")
def not_followed_by_relation(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = events(spark, sf_dir).select("event_id", "ts", "event_type", "src_address", "dst_address")
    return sequences.not_followed_by(df, _is("error"), _is("purchase"), [], "ts", TIE, "48 hours", relation=[("src_address", "dst_address")]).select("event_id")


_ROLES = """, p AS (SELECT src_address AS k, ts, event_id, true AS a FROM ev WHERE event_type = 'view' UNION ALL SELECT dst_address, ts, event_id, false FROM ev WHERE event_type = 'purchase'),
r AS (SELECT *, count(*) FILTER (NOT a) OVER (PARTITION BY k ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS run FROM p),
e AS (SELECT k, run, event_id AS b_id, ts AS b_ts FROM r WHERE NOT a)
"""


@query("repeat_then_relation", _EVENTS + _ROLES + "SELECT arg_min(r.event_id, (r.ts, r.event_id)) AS a_id, e.b_id, count(*) AS times FROM r JOIN e USING (k, run) WHERE r.a AND e.b_ts - r.ts < INTERVAL '2000 hours' GROUP BY r.k, r.run, e.b_id HAVING count(*) >= 3")
def repeat_then_relation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A{3,} then B, related by an address."""
    df = events(spark, sf_dir).select("event_id", "ts", "event_type", "src_address", "dst_address")
    found = sequences.repeated_then(df, _is("view"), _is("purchase"), 3, [], "ts", TIE, "2000 hours", relation=[("src_address", "dst_address")])
    return found.select(F.col("a_event_id").alias("a_id"), F.col("b_event_id").alias("b_id"), "times")


_GREEDY = _PAST.replace("FILTER (event_type = 'purchase')", "FILTER (event_type = 'purchase' AND value <= 30)").replace("WHERE event_type = 'purchase'", "WHERE event_type = 'purchase' AND value <= 30")


@query("repeat_then_greedy", _EVENTS + _GREEDY + "SELECT r.user_id, arg_min(r.event_id, (r.ts, r.event_id)) AS a_id, e.b_id, count(*) AS times FROM r JOIN e USING (user_id, run) WHERE r.value > 30 AND e.b_ts - r.ts < INTERVAL '72 hours' GROUP BY r.user_id, r.run, e.b_id")
def repeat_then_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A+ greedy then B, where an event can be both."""
    df = events(spark, sf_dir).select(*_SLIM)
    found = sequences.repeated_then(df, F.col("value") > 30, _is("purchase"), 1, ["user_id"], "ts", TIE, "72 hours")
    return found.select(F.col("a_user_id").alias("user_id"), F.col("a_event_id").alias("a_id"), F.col("b_event_id").alias("b_id"), "times")


def _recognize(spark: SparkSession, sf_dir: str, measures: str, pattern: str, defines: str, hours: int, skip: str = "PAST LAST ROW") -> DataFrame:
    events(spark, sf_dir).createOrReplaceTempView("tw_events")
    return match_recognize(spark, f"SELECT * FROM tw_events MATCH_RECOGNIZE (PARTITION BY user_id ORDER BY ts MEASURES {measures} ONE ROW PER MATCH AFTER MATCH SKIP {skip} PATTERN {pattern} WITHIN INTERVAL '{hours}' HOUR DEFINE {defines}) AS T", ("event_id",))


_STRICT_PAIR = """, n AS (SELECT *, lead(event_type) OVER w AS nt, lead(event_id) OVER w AS ni, lead(ts) OVER w AS nts, lead(value) OVER w AS nv, lead(src_address) OVER w AS ns FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
"""


@query("match_sql_between", _EVENTS + _STRICT_PAIR + "SELECT user_id, event_id AS first_id, ni AS last_id, nv - value AS more FROM n WHERE event_type = 'view' AND nt = 'purchase' AND nv > value AND nts - ts < INTERVAL '48 hours'")
def match_sql_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B's definition compares with A; a measure computes with both."""
    return _recognize(spark, sf_dir, "A.event_id AS first_id, B.event_id AS last_id, B.value - A.value AS more", "(A B)", "A AS A.event_type = 'view', B AS B.event_type = 'purchase' AND B.value > A.value", 48)


@query("match_sql_belong", _EVENTS + _STRICT_PAIR + f"SELECT user_id, event_id AS first_id, ni AS last_id FROM n WHERE {_BAD_HOST} AND nt IN ('error', 'signup') AND nts - ts < INTERVAL '240 hours'")
def match_sql_belong(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Membership in intelligence groups in DEFINE."""
    _groups(spark).register_sql()
    return _recognize(spark, sf_dir, "A.event_id AS first_id, B.event_id AS last_id", "(A B)", "A AS belong(A.src_address, 'bad hosts'), B AS belong(B.event_type, 'g2') AND NOT belong(B.src_address, 'nobody')", 240, "TO NEXT ROW")


@query("match_sql_last", _EVENTS + _STRICT_RUN + "SELECT n.user_id, arg_min(n.event_id, (n.ts, n.event_id)) AS first_id, arg_max(n.event_id, (n.ts, n.event_id)) AS latest_id, e.b_id AS last_id FROM n JOIN e USING (user_id, run) WHERE n.event_type = 'view' AND e.b_ts - n.ts < INTERVAL '96 hours' GROUP BY n.user_id, n.run, e.b_id HAVING count(*) >= 2")
def match_sql_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plain column of a repeated variable is its last row's."""
    return _recognize(spark, sf_dir, "FIRST(A.event_id) AS first_id, A.event_id AS latest_id, LAST(B.event_id) AS last_id", "(A{2,} B)", "A AS A.event_type = 'view', B AS B.event_type = 'purchase'", 96)


@query("match_sql_three", ", n AS (SELECT *, lead(event_type) OVER w AS t1, lead(event_type, 2) OVER w AS t2, lead(event_id, 2) OVER w AS i2, lead(ts, 2) OVER w AS ts2 FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT user_id, event_id AS first_id, i2 AS last_id FROM n WHERE event_type = 'view' AND t1 = 'click' AND t2 = 'purchase' AND ts2 - ts < INTERVAL '240 hours'")
def match_sql_three(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three variables, by the automaton."""
    return _recognize(spark, sf_dir, "A.event_id AS first_id, C.event_id AS last_id", "(A B C)", "A AS A.event_type = 'view', B AS B.event_type = 'click', C AS C.event_type = 'purchase'", 240)


@query("match_sql_iterative", _EVENTS + _STRICT_RUN.replace("AS b_ts FROM n", "AS b_ts, value AS b_value FROM n") + """SELECT n.user_id, arg_min(n.event_id, (n.ts, n.event_id)) AS first_id, e.b_id AS last_id, arg_min(e.b_value - n.value, (n.ts, n.event_id)) AS more
FROM n JOIN e USING (user_id, run) WHERE n.event_type = 'view' AND e.b_ts - n.ts < INTERVAL '96 hours' AND e.b_value > n.value GROUP BY n.user_id, n.run, e.b_id""")
def match_sql_iterative(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A+ then B, where B's definition reads the first of the A's: the earliest A that it accepts begins the match."""
    return _recognize(spark, sf_dir, "FIRST(A.event_id) AS first_id, B.event_id AS last_id, B.value - FIRST(A.value) AS more", "(A+ B)", "A AS A.event_type = 'view', B AS B.event_type = 'purchase' AND B.value > FIRST(A.value)", 96)


@query("match_sql_cross", ", n AS (SELECT *, lead(event_type) OVER w AS t1, lead(value) OVER w AS v1, lead(value, 2) OVER w AS v2, lead(event_type, 2) OVER w AS t2, lead(event_id, 2) OVER w AS i2, lead(ts, 2) OVER w AS ts2 FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT user_id, event_id AS first_id, i2 AS last_id FROM n WHERE t1 <> event_type AND v1 > value AND v2 > v1 AND t2 = event_type AND ts2 - ts < INTERVAL '240 hours'")
def match_sql_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Definitions of three variables that read each other's rows."""
    return _recognize(spark, sf_dir, "A.event_id AS first_id, C.event_id AS last_id", "(A B C)", "A AS true, B AS B.event_type <> A.event_type AND B.value > A.value, C AS C.value > LAST(B.value) AND C.event_type = FIRST(A.event_type)", 240, "TO NEXT ROW")


@query("not_before_unkeyed", (_EVENTS + _BEFORE).replace("PARTITION BY user_id ", "").replace("24 hours", "1 hour").replace("event_type = 'view' THEN", "event_type = 'signup' THEN") + "SELECT 'All' AS signature, event_id AS b_id, a_id FROM b")
def not_before_unkeyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No group: one signature for all, still shared out by time."""
    df = events(spark, sf_dir).select(*_SLIM)
    found = sequences.not_before(df, predicates.where(df, "event_type = signup"), predicates.where(df, "event_type = purchase"), "ts", TIE, "1 hour")
    return found.select("signature", F.col("b_event_id").alias("b_id"), F.col("a_event_id").alias("a_id"))


@query("not_before_other_fields", """, x AS (SELECT *, CASE WHEN event_type = 'view' THEN user_id WHEN event_type = 'purchase' THEN event_id % 97 END AS g FROM ev),
n AS (SELECT *, last(CASE WHEN event_type = 'view' THEN {'id': event_id, 't': ts} END IGNORE NULLS) OVER (PARTITION BY g ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS a FROM x WHERE g IS NOT NULL)
SELECT g::VARCHAR AS signature, event_id AS b_id, a.id AS a_id FROM n WHERE event_type = 'purchase' AND (a IS NULL OR ts - a.t > INTERVAL '24 hours')""")
def not_before_other_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A's and B's grouped by fields of their own."""
    df = events(spark, sf_dir).select(*_SLIM, (F.col("event_id") % 97).alias("other"))
    found = sequences.not_before(df, _is("view"), _is("purchase"), "ts", TIE, "24 hours", ["user_id"], ["other"])
    return found.select("signature", F.col("b_event_id").alias("b_id"), F.col("a_event_id").alias("a_id"))


# --- rules --------------------------------------------------------------------------

_RULE = {
    "name": "views without purchase", "family": "not_followed_by", "groupBy": ["user_id"], "window": {"value": 12, "unit": "hour"},
    "events": [{"as": "A", "filter": "event_type = view and value > 30"}, {"as": "B", "filter": "event_type = purchase"}],
    "selects": [{"alias": "id", "eventAttr": {"as": "A", "attrField": "event_id"}}, {"alias": "who", "eventAttr": {"as": "A", "attrField": "user_id"}}, {"alias": "fixed", "constValue": 7, "constType": "long"}],
    "alert": {"enabled": True, "content": "no purchase", "level": 2, "alarmKey": ["who", "alarm_content"]},
}


@query("rule_json", "SELECT event_id AS id, user_id AS who, 7::BIGINT AS fixed, 'views without purchase' AS alarm_name, 2 AS alarm_level, '' AS alarm_stage, 'no purchase' AS alarm_content, '' AS alarm_advice, md5(user_id || ',no purchase') AS alarm_key FROM ev a WHERE event_type = 'view' AND value > 30 AND NOT EXISTS (SELECT 1 FROM ev b WHERE b.user_id = a.user_id AND b.event_type = 'purchase' AND (b.ts, b.event_id) > (a.ts, a.event_id) AND b.ts - a.ts < INTERVAL '12 hours')")
def rule_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compile_rule(Rule.from_json(_RULE), events(spark, sf_dir))


@query("rule_fan_out", "SELECT 'any' AS rule, count(*) AS n FROM ev WHERE value > 90 UNION ALL SELECT 'count', count(*) FROM (SELECT 1 FROM ev GROUP BY user_id, time_bucket(INTERVAL '1 day', ts, TIMESTAMP '1970-01-01') HAVING count(*) >= 4)")
def rule_fan_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [
        Rule.from_json({"id": "any", "name": "any", "family": "having_any", "events": [{"as": "A", "filter": "value > 90"}]}),
        Rule.from_json({"id": "count", "name": "count", "family": "having_count", "groupBy": ["user_id"], "window": {"value": 1, "unit": "day"}, "having": {"cnt": {"op": ">=", "value": 4}}, "events": [{"as": "A", "filter": ""}]}),
    ]
    counts = [df.agg(F.count("*").alias("n")).select(F.lit(k).alias("rule"), "n") for k, df in fan_out(rules, events(spark, sf_dir)).items()]
    return counts[0].unionByName(counts[1])


@query("rule_one_pass", """, d AS (SELECT *, time_bucket(INTERVAL '1 day', ts, TIMESTAMP '1970-01-01') AS w FROM ev)
SELECT 'any' AS rule, user_id::VARCHAR AS signature, NULL::TIMESTAMP AS window_start, 1.0::DOUBLE AS value FROM ev WHERE value > 90
UNION ALL SELECT 'count', user_id::VARCHAR, w, count(*)::DOUBLE FROM d GROUP BY user_id, w HAVING count(*) >= 4
UNION ALL SELECT 'types', event_type, w, count(*)::DOUBLE FROM d WHERE value > 20 GROUP BY event_type, w HAVING count(*) > 2
UNION ALL SELECT 'sum', 'All', w, sum(round(value))::DOUBLE FROM (SELECT * FROM d WHERE event_type = 'purchase') GROUP BY w HAVING sum(round(value)) > 100""")
def rule_one_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several rules over one reading of the events."""
    day, one = {"value": 1, "unit": "day"}, lambda f: [{"as": "A", "filter": f}]
    rules = [
        Rule.from_json({"id": "any", "name": "any", "family": "having_any", "groupBy": ["user_id"], "events": one("value > 90")}),
        Rule.from_json({"id": "count", "name": "count", "family": "having_count", "groupBy": ["user_id"], "window": day, "having": {"cnt": {"op": ">=", "value": 4}}, "events": one("")}),
        Rule.from_json({"id": "types", "name": "types", "family": "having_count", "groupBy": ["event_type"], "window": day, "having": {"cnt": {"op": ">", "value": 2}}, "events": one("value > 20")}),
        Rule.from_json({"id": "sum", "name": "sum", "family": "having_sum", "window": day, "having": {"total": {"field": "amount", "op": ">", "value": 100}}, "events": one("event_type = purchase")}),
    ]
    return _naive(one_pass(rules, events(spark, sf_dir).withColumn("amount", F.round("value")))).drop("window_end")


#: Thresholds of the rules that share a scan: seven rules for each.
_LEVELS = 15


def _seven(v: int) -> list[Rule]:
    day, test = {"value": 1, "unit": "day"}, f"value > {v * 6}"
    limit = lambda n: {"value": n, "unit": "hour"}
    one, two = lambda f: [{"as": "A", "filter": f}], lambda a, b: [{"as": "A", "filter": a}, {"as": "B", "filter": b}]
    by_user = {"groupBy": ["user_id"]}
    made = {
        "count": {"family": "having_count", "window": day, "slide": limit(8), "having": {"cnt": {"op": ">=", "value": 3}}, "events": one(test)} | by_user,
        "distinct": {"family": "having_count_distinct", "groupBy": ["event_type"], "window": day, "having": {"cnt": {"field": "user_id", "op": ">", "value": 2}}, "events": one(test)},
        "next": {"family": "followed_by", "skip": "next", "window": limit(6), "events": two(f"event_type = view and {test}", "event_type = purchase")} | by_user,
        "past": {"family": "followed_by", "window": limit(24), "events": two("event_type = view", f"event_type = purchase and {test}")} | by_user,
        "alone": {"family": "not_followed_by", "relation": [["src_address", "dst_address"]], "window": limit(48), "events": two(f"event_type = error and {test}", "event_type = purchase")},
        "before": {"family": "not_before", "window": limit(24), "events": two("event_type = view", f"event_type = purchase and {test}")} | by_user,
        "loop": {"family": "repeat_then", "patternRepeat": {"low": 2}, "window": limit(72), "events": two(f"event_type = click and {test}", "event_type = purchase")} | by_user,
    }
    return [Rule.from_json({"id": f"{name} {v}", "name": name} | d) for name, d in made.items()]


@query("rule_one_scan_sequences", f""", e AS (SELECT *, event_type = 'view' AS view, event_type = 'purchase' AS buy, value > v * 6 AS more FROM ev, (SELECT range AS v FROM range({_LEVELS}))),
h AS (SELECT *, time_bucket(INTERVAL '8 hours', ts, TIMESTAMP '1970-01-01') - unnest([0, 1, 2]) * INTERVAL '8 hours' AS w FROM e WHERE more),
n AS (SELECT *, first(CASE WHEN buy THEN {{'id': event_id, 't': ts}} END IGNORE NULLS) OVER (PARTITION BY v, user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS b,
  last(CASE WHEN view THEN ts END IGNORE NULLS) OVER (PARTITION BY v, user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS a,
  count(*) FILTER (buy AND more) OVER (PARTITION BY v, user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS run,
  count(*) FILTER (buy) OVER (PARTITION BY v, user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS all_run FROM e),
r AS (
  SELECT 'count ' || v AS rule, user_id::VARCHAR AS signature, w AS window_start, count(*)::DOUBLE AS value, NULL::BIGINT AS a_id, NULL::BIGINT AS b_id FROM h GROUP BY v, user_id, w HAVING count(*) >= 3
  UNION ALL SELECT 'distinct ' || v, event_type, time_bucket(INTERVAL '1 day', ts, TIMESTAMP '1970-01-01') AS w, count(DISTINCT user_id)::DOUBLE, NULL, NULL FROM e WHERE more GROUP BY v, event_type, w HAVING count(DISTINCT user_id) > 2
  UNION ALL SELECT 'next ' || v, user_id::VARCHAR, NULL, NULL, event_id, b.id FROM n WHERE view AND more AND b.t - ts < INTERVAL '6 hours'
  UNION ALL SELECT 'past ' || n.v, n.user_id::VARCHAR, NULL, NULL, arg_min(n.event_id, (n.ts, n.event_id)), x.event_id FROM n JOIN n x ON x.v = n.v AND x.user_id = n.user_id AND x.run = n.run AND x.buy AND x.more WHERE n.view AND x.ts - n.ts < INTERVAL '24 hours' GROUP BY n.v, n.user_id, x.event_id
  UNION ALL SELECT 'alone ' || v, 'All', NULL, NULL, event_id, NULL FROM e a WHERE event_type = 'error' AND more AND NOT EXISTS (SELECT 1 FROM ev b WHERE b.dst_address = a.src_address AND b.event_type = 'purchase' AND (b.ts, b.event_id) > (a.ts, a.event_id) AND b.ts - a.ts < INTERVAL '48 hours')
  UNION ALL SELECT 'before ' || v, user_id::VARCHAR, NULL, NULL, NULL, event_id FROM n WHERE buy AND more AND (a IS NULL OR ts - a > INTERVAL '24 hours')
  UNION ALL SELECT 'loop ' || n.v, n.user_id::VARCHAR, NULL, count(*)::DOUBLE, arg_min(n.event_id, (n.ts, n.event_id)), x.event_id FROM n JOIN n x ON x.v = n.v AND x.user_id = n.user_id AND x.all_run = n.all_run AND x.buy WHERE n.event_type = 'click' AND n.more AND x.ts - n.ts < INTERVAL '72 hours' GROUP BY n.v, n.user_id, x.event_id HAVING count(*) >= 2
) SELECT * FROM r""")
def rule_one_scan_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over a hundred rules of seven families, three ways to group and a relation, over one reading of the events."""
    df = events(spark, sf_dir).drop("props")
    found = one_scan([r for v in range(_LEVELS) for r in _seven(v)], df)
    return _naive(found).select("rule", "signature", "window_start", "value", F.col("a_event_id").alias("a_id"), F.col("b_event_id").alias("b_id"))


# --- projections, functions, sources ---------------------------------------------------


@query("project_json", "SELECT event_id, '{\"event_id\":' || event_id || ',\"event_type\":\"' || event_type || '\"}' AS value FROM ev")
def project_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = events(spark, sf_dir).drop("props").select("event_id", "event_type")
    return df.select("event_id", F.to_json(F.struct("event_id", "event_type")).alias("value"))


@query("scalar_functions", """SELECT event_id, epoch_us(ts) // 1000 AS ms, strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || '+0000' AS iso, epoch_us(ts) // 1000 AS again, upper(md5(event_type)) AS digest,
user_id::VARCHAR || ',' || event_type || ',None' AS signature, event_type IN ('click') AS same, 2886729728 + (user_id % 8) * 256 + event_id % 256 AS ip FROM ev""")
def scalar_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = events(spark, sf_dir)
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'UTC'")
    return df.select(
        "event_id", scalars.time_parse(F.col("ts")).alias("ms"), scalars.time_format(F.col("ts")).alias("iso"), scalars.parse_time(iso).alias("again"), scalars.md5_text(F.col("event_type"), upper=True).alias("digest"),
        scalars.group_signature([F.col("user_id"), F.col("event_type"), F.lit(None)]).alias("signature"), scalars.equals_ignoring_case_and_empty(F.col("event_type"), F.lit("CLICK")).alias("same"), scalars.ip_number(F.col("src_address")).alias("ip"),
    )


@query("sql_functions", "SELECT event_id, epoch_us(ts) // 1000 AS ms FROM ev WHERE event_type = 'view'")
def sql_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    scalars.register_sql(spark)
    events(spark, sf_dir).createOrReplaceTempView("tw_events")
    return spark.sql("SELECT event_id, time_parse(ts) AS ms FROM tw_events WHERE equals_ignoring_case_and_empty(event_type, 'VIEW')")


@query("generator_counts", "WITH g AS (SELECT (i % 5000 + 1) % 10 AS key, '172.16.100.' || (i % 5000 % 255) AS src_address FROM range(20000) t(i)) SELECT key::INT AS key, src_address, count(*) AS cnt FROM g GROUP BY ALL")
def generator_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generators.slim_events(spark, 5000, 10, parallelism=4).groupBy("key", "src_address").agg(F.count("*").alias("cnt"))


@query("generator_tuples", "SELECT ((i % 3000 + 1) % 7)::INT AS key, sum(1)::BIGINT AS n FROM range(6000) t(i) GROUP BY ALL")
def generator_tuples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generators.tuples(spark, 3000, 7, parallelism=2).groupBy("key").agg(F.sum("one").alias("n"))


@query("generator_parsed", "WITH g AS (SELECT (i % 1000 + 1) % 10 AS key, '172.16.100.' || (i % 1000 % 255) AS src_address FROM range(2000) t(i)) SELECT key::INT AS key, 'web attack' AS event_name, src_address, count(*) AS cnt FROM g GROUP BY ALL")
def generator_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event through JSON text and back."""
    return generators.parsed_events(spark, 1000, 10, parallelism=2).groupBy("key", "event_name", "src_address").agg(F.count("*").alias("cnt"))


@query("match_rendering", ORACLE_SQL["followed_by_strict"].replace("SELECT user_id, event_id AS a_id, ni AS b_id", "SELECT 'A: [{\"event_id\":' || event_id || '}] B: [{\"event_id\":' || ni || '}] ' AS text"))
def match_rendering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches as text."""
    df = events(spark, sf_dir).select(*_SLIM)
    found = sequences.followed_by(df, _is("view"), _is("purchase"), ["user_id"], "ts", TIE, "24 hours", contiguity="strict")
    return sequences.match_text(found.select("a_event_id", "b_event_id"), "a", "b")


@query("field_compare", "SELECT event_id, src_address = dst_address AS same, user_id > event_id % 100 AS more, lower(event_type) = lower(label) AS alike FROM (SELECT *, CASE WHEN event_id % 2 = 0 THEN upper(event_type) ELSE 'other' END AS label FROM ev)")
def field_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of one event with each other, text without regard to case."""
    df = events(spark, sf_dir).withColumns({"label": F.when(F.col("event_id") % 2 == 0, F.upper("event_type")).otherwise("other"), "rest": F.col("event_id") % 100})
    e = df.select(F.struct("*").alias("e"))
    is_so = lambda text: predicates.compile_predicate(predicates.parse(text, ("e",)), predicates.resolver(e))
    return e.select("e.event_id", is_so("e.src_address = e.dst_address").alias("same"), is_so("e.user_id > e.rest").alias("more"), is_so("e.event_type = e.label").alias("alike"))


@query("side_outputs", "SELECT 'errors' AS side, count(*) AS n FROM ev WHERE event_type = 'error' UNION ALL SELECT 'large', count(*) FROM ev WHERE value > 80")
def side_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = lambda part, name: part.agg(F.count("*").alias("n")).select(F.lit(name).alias("side"), "n")
    out = sinks.side_outputs(events(spark, sf_dir), {"errors": _is("error"), "large": F.col("value") > 80}, counted)
    return out["errors"].unionByName(out["large"])


@query("literal_source", "WITH x(v) AS (VALUES ('A:1'), ('A:2'), ('A:3'), ('B:1'), ('B:2'), ('B:3')) SELECT a.v AS a_v, b.v AS b_v FROM x a JOIN x b ON a.v[1] = 'A' AND b.v[1] = 'B' AND a.v[2:] = b.v[2:]")
def literal_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = readers.literals(spark, [(k, v) for k, v in enumerate(["A:1", "A:2", "A:3", "B:1", "B:2", "B:3"])], "event_id long, v string")
    df = df.withColumn("ts", F.timestamp_seconds(1_700_000_000 + F.col("event_id"))).withColumn("suffix", F.substring("v", 2, 9))
    found = sequences.followed_by(df, F.col("v").startswith("A"), F.col("v").startswith("B"), [], "ts", TIE, relation=[("suffix", "suffix")])
    return found.select("a_v", "b_v")


# --- streams --------------------------------------------------------------------------


def _stream(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """The events as a stream with a watermark; ``more``: of the addresses."""
    path = f"{sf_dir}/events.parquet"
    df = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path[:-1] + "[t]")
    return readers.with_event_time(_addressed(df).select("event_id", "ts", "user_id", "event_type", "value", *more), "ts")


def _drained(stream: DataFrame, name: str) -> DataFrame:
    """What a stream gives once it has read all there is, from files in the shared folder."""
    spark = stream.sparkSession
    out = scratch(spark, name)
    sinks.files(stream, f"{out}/data", f"{out}/checkpoint", once=True).awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/data")


def _watermark(spark: SparkSession, sf_dir: str):
    """The watermark once all events are read."""
    return F.lit(spark.read.parquet(f"{sf_dir}/events.parquet").agg(F.max(F.col("ts").cast("timestamp")) - F.expr("INTERVAL 3 SECONDS")).first()[0])


_PASSED = "(SELECT max(ts) FROM ev) - INTERVAL '3 seconds'"


def _event(k: int):
    return F.get_json_object("events", f"$[{k}].event.event_id").cast("bigint")


@query("stream_followed_by", ORACLE_SQL["followed_by_next"].replace("SELECT user_id, event_id", "SELECT user_id::VARCHAR AS signature, event_id") + f" AND b.t <= {_PASSED}")
def stream_followed_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = stateful.followed_by_stream(_stream(spark, sf_dir), _is("view"), _is("purchase"), ["user_id"], "ts", TIE, "6 hours")
    return _drained(found, "followed").select("signature", _event(0).alias("a_id"), _event(1).alias("b_id"))


@query("stream_not_followed_by", ORACLE_SQL["not_followed_by"].replace("SELECT event_id, user_id", "SELECT event_id, user_id::VARCHAR AS signature") + f" AND a.ts + INTERVAL '6 hours' <= {_PASSED}")
def stream_not_followed_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = stateful.not_followed_by_stream(_stream(spark, sf_dir), _is("view"), _is("purchase"), ["user_id"], "ts", TIE, "6 hours")
    return _drained(found, "alone").select(_event(0).alias("event_id"), "signature")


@query("stream_not_before", ORACLE_SQL["not_before_silenced"] + f" WHERE ts <= {_PASSED}")
def stream_not_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = stateful.not_before_stream(_stream(spark, sf_dir), _is("view"), _is("purchase"), "ts", TIE, "24 hours", ["user_id"], ["user_id"], "72 hours")
    return _drained(found, "unannounced").select("signature", _event(0).alias("b_id"), _event(1).alias("a_id"))


@query("stream_not_before_unkeyed", ORACLE_SQL["not_before_unkeyed"] + f" WHERE ts <= {_PASSED}")
def stream_not_before_unkeyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No group: stretches of time share the events out, and the last A of each is carried on."""
    found = stateful.not_before_stream(_stream(spark, sf_dir), _is("signup"), _is("purchase"), "ts", TIE, "1 hour")
    return _drained(found, "unannounced_all").select("signature", _event(0).alias("b_id"), _event(1).alias("a_id"))


@query("stream_having_count", ORACLE_SQL["having_count_tumble"].replace("SELECT event_type", "SELECT * FROM (SELECT event_type") + f") WHERE window_end <= {_PASSED}")
def stream_having_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows that the watermark has closed."""
    return _naive(_drained(windows.having_count(_stream(spark, sf_dir), ["event_type"], "ts", "6 hours"), "counted"))


@query("stream_having_count_hop", ORACLE_SQL["having_count_hop"].replace("SELECT user_id::VARCHAR", "SELECT * FROM (SELECT user_id::VARCHAR") + f") WHERE window_end <= {_PASSED}")
def stream_having_count_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hopping windows of a stream, by way of panes: an event isn't copied once for every window."""
    found = windows.having_count(_stream(spark, sf_dir), ["user_id", "event_type"], "ts", "24 hours", "8 hours", least=3, live_panes=True)
    return _naive(_drained(found, "hopped"))


@query("stream_having_sum_hop", ORACLE_SQL["having_sum_hop"].replace("SELECT coalesce(k, 'None') AS k", "SELECT * FROM (SELECT coalesce(k, 'None') AS k", 1) + f") WHERE window_end <= {_PASSED}")
def stream_having_sum_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _stream(spark, sf_dir).select("ts", F.when(F.col("user_id") % 5 != 0, F.col("user_id")).alias("k"), F.round("value").cast("string").alias("amount"))
    return _naive(_drained(windows.having_sum(df, ["k"], "ts", "amount", "24 hours", "8 hours", least=100, live_panes=True), "summed"))


@query("stream_count_distinct", "SELECT event_type, w AS window_start, w + INTERVAL '1 day' AS window_end, count(DISTINCT user_id) AS cnt FROM (SELECT *, time_bucket(INTERVAL '1 day', ts, TIMESTAMP '1970-01-01') AS w FROM ev) GROUP BY event_type, w HAVING w + INTERVAL '1 day' <= " + _PASSED)
def stream_count_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _naive(_drained(windows.having_count_distinct(_stream(spark, sf_dir), ["event_type"], "ts", "user_id", "1 day"), "distinct"))


def _live(rule: dict, spark: SparkSession, sf_dir: str, name: str, *more: str) -> DataFrame:
    """A declared rule over the stream."""
    df = _stream(spark, sf_dir, *more)
    return _drained(compile_rule(Rule.from_json({"name": name, "id": name} | rule), df), name)


def _pairs_of(a: str, b: str) -> list[dict]:
    return [{"as": "A", "filter": f"event_type = {a}"}, {"as": "B", "filter": f"event_type = {b}"}]


@query("stream_rule_followed_by", ORACLE_SQL["followed_by_past_last"].replace("WHERE r.event_type", f"WHERE e.b_ts <= {_PASSED} AND r.event_type"))
def stream_rule_followed_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pair(_live({"family": "followed_by", "groupBy": ["user_id"], "window": {"value": 24, "unit": "hour"}, "events": _pairs_of("view", "purchase")}, spark, sf_dir, "rule_followed"))


@query("stream_rule_followed_by_relation", ORACLE_SQL["followed_by_relation"].replace("WHERE a.event_type", f"WHERE b.ts <= {_PASSED} AND a.event_type"))
def stream_rule_followed_by_relation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = {"family": "followed_by", "relation": [["src_address", "dst_address"]], "skip": "next", "window": {"value": 48, "unit": "hour"}, "events": _pairs_of("error", "purchase")}
    found = _live(rule, spark, sf_dir, "rule_related", "src_address", "dst_address")
    return found.select(F.col("a_event_id").alias("a_id"), F.col("b_event_id").alias("b_id"))


@query("stream_rule_not_followed_by_relation", f"SELECT event_id {_ALONE} AND ts + INTERVAL '48 hours' <= {_PASSED}")
def stream_rule_not_followed_by_relation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = {"family": "not_followed_by", "relation": [["src_address", "dst_address"]], "window": {"value": 48, "unit": "hour"}, "events": _pairs_of("error", "purchase")}
    return _live(rule, spark, sf_dir, "rule_alone", "src_address", "dst_address").select("event_id")


@query("stream_rule_not_before", ORACLE_SQL["not_before"] + f" WHERE ts <= {_PASSED}")
def stream_rule_not_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _live({"family": "not_before", "groupBy": ["user_id"], "window": {"value": 24, "unit": "hour"}, "events": _pairs_of("view", "purchase")}, spark, sf_dir, "rule_unannounced")
    return found.select("signature", F.col("b_event_id").alias("b_id"), F.col("a_event_id").alias("a_id"))


@query("stream_repeat_then", ORACLE_SQL["repeat_then"].replace("WHERE r.event_type", f"WHERE e.b_ts <= {_PASSED} AND r.event_type"))
def stream_repeat_then(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _live({"family": "repeat_then", "groupBy": ["user_id"], "window": {"value": 72, "unit": "hour"}, "patternRepeat": {"low": 2}, "events": _pairs_of("click", "purchase")}, spark, sf_dir, "rule_repeated")
    return found.select(F.col("a_user_id").alias("user_id"), F.col("a_event_id").alias("a_id"), F.col("b_event_id").alias("b_id"), "times")


@query("stream_repeat_until", ORACLE_SQL["repeat_until"] + f" AND max(ts) <= {_PASSED}")
def stream_repeat_until(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _live({"family": "repeat_until", "groupBy": ["user_id"], "patternRepeat": {"low": 3}, "events": _pairs_of("click", "purchase")}, spark, sf_dir, "rule_until")
    return found.select(F.col("signature").alias("user_id"), F.array_join(F.transform("events", lambda e: e["event"]["event_id"].cast("string")), ",").alias("ids"))


@query("stream_join_followed_by_relation", ORACLE_SQL["stream_rule_followed_by_relation"].replace(f"b.ts <= {_PASSED}", f"a.ts + INTERVAL '48 hours' <= {_PASSED}"))
def stream_join_followed_by_relation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As a join of the stream with itself, an A with its first B: pairs whose first event's time limit has passed."""
    df = _stream(spark, sf_dir, "src_address", "dst_address")
    found = joins.followed_by_join(df, _is("error"), _is("purchase"), [], "ts", TIE, "48 hours", [("src_address", "dst_address")])
    return _drained(found, "join_related").where(F.col("a_ts") + F.expr("INTERVAL 48 HOURS") <= _watermark(spark, sf_dir)).select(F.col("a_event_id").alias("a_id"), F.col("b_event_id").alias("b_id"))
