"""Registered queries on supervised sittings, notices, streams and prerequisite graphs, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph, notify, proctor
from ..sources import tables as T
from ..sources.shared import new_path
from ..streaming import proctor as live
from ..streaming import merge, tracker
from ..streaming.tables import replayed, run_available, stream


def _group(df):
    return df.withColumn("day", F.substring_index("attempt_id", "-", -1))


def proctor_summary(s, d):
    return proctor.summary(T.proctor_events(s, d))


def proctor_baseline(s, d):
    return proctor.baseline(_group(proctor_summary(s, d)), "day")


def proctor_outliers(s, d):
    x = _group(proctor_summary(s, d))
    return proctor.outliers(x, proctor.baseline(x, "day"), "day")


def proctor_sessions(s, d):
    x = proctor.sessions(T.proctor_events(s, d), 1_800_000, ["user_id"])
    return x.select("user_id", "session", "events", F.unix_millis("started_at").alias("started_ms"), "length_ms")


def _signals(s, d):
    """Events with their times drawn together 120-fold, so that absences of seconds occur."""
    kinds = {"view": "hidden", "click": "visible", "purchase": "blur", "signup": "focus"}
    kind = F.create_map(*[F.lit(x) for p in kinds.items() for x in p])[F.col("event_type")]
    return T.scan(s, d, "events").select("user_id", F.col("event_id").alias("seq"), kind.alias("kind"), F.floor(F.unix_millis("ts") / 1200).alias("at_ms"), F.floor("value").alias("chars"))


def proctor_away(s, d):
    return proctor.away_segments(_signals(s, d), ["user_id"])


def proctor_pastes(s, d):
    return proctor.pastes(_signals(s, d).where("kind = 'blur'").drop("kind"), ["user_id"])


def late_event_filter(s, d):
    e = T.proctor_events(s, d)
    closes = e.groupBy("attempt_id").agg((F.min("at") + F.expr("INTERVAL 6 HOURS")).alias("closed_at"))
    return proctor.late_filter(e, closes, most=3)


def _notes(s, d):
    e = T.scan(s, d, "events")
    return e.select("user_id", F.col("event_id").alias("note_id"), (F.floor(F.unix_millis("ts") / 7_200_000) * 7_200_000).alias("at_ms"), F.when(F.col("user_id") % 3 != 0, 1320).alias("quiet_start"), F.lit(420).alias("quiet_end"), "event_type")


def notify_schedule(s, d):
    return notify.schedule_all(_notes(s, d))


def notify_dedupe(s, d):
    n = _notes(s, d).select((F.col("user_id") % 4).alias("tenant_id"), F.concat_ws(":", F.col("event_type"), F.col("at_ms").cast("string")).alias("dedupe_key"), "note_id", "user_id")
    known = n.where("note_id % 10 = 0").select("tenant_id", "dedupe_key")
    return notify.dedupe(n, known)


def delivery_states(s, d):
    e = T.scan(s, d, "events")
    status, wait = notify.next_state(F.when(F.col("event_type") == "signup", "SENT").otherwise("PENDING"), (F.col("event_id") % 6).cast("int"), F.col("value") > 20, F.col("event_type") == "error")
    return e.select("event_id", status.alias("status"), wait.alias("wait_min"))


def stream_tumbling(s, d):
    e = stream(s, d, "events").select("event_id", F.col("ts").alias("at"), F.col("event_type").alias("type"))
    x = run_available(live.tumbling_counts(e), "complete")
    return x.select(F.unix_millis("window_start").alias("start_ms"), "type", "n")


def stream_sessions(s, d):
    e = stream(s, d, "events").select("user_id", F.col("ts").alias("at"))
    x = run_available(live.session_windows(e), "complete")
    return x.select("user_id", F.unix_millis("started_at").alias("started_ms"), F.unix_millis("ended_at").alias("ended_ms"), "events")


def stream_on_time(s, d):
    """Streamed events joined with a static table of closing times."""
    e = stream(s, d, "events").select("event_id", F.concat_ws("-", F.col("user_id").cast("string"), F.date_format("ts", "yyyyMMdd")).alias("attempt_id"), F.col("ts").alias("at"))
    closes = T.proctor_events(s, d).groupBy("attempt_id").agg((F.min("at") + F.expr("INTERVAL 6 HOURS")).alias("closed_at"))
    return run_available(live.on_time(e, closes)).select("event_id", "attempt_id")


def stream_throttle(s, d):
    """Stateful throttling; at most three notices a minute and recipient."""
    e = stream(s, d, "events").select("user_id", F.col("event_id").alias("note_id"), (F.floor(F.unix_millis("ts") / 7_200_000) * 7_200_000).alias("at_ms"))
    return run_available(live.throttled(e))


def stream_tracker(s, d):
    """The tracker's standing away records in four triggers; they equal the batch operator's."""
    x = _signals(s, d).where("kind is not null").select(F.col("user_id").alias("attempt_id"), "seq", "kind", "at_ms", F.lit(None).cast("long").alias("value"))
    out = tracker.standing(run_available(tracker.tracked(replayed(x, "at_ms", 4)), rocksdb=True))
    return out.where("type in ('TAB_VISIBLE', 'WINDOW_FOCUS', 'LONG_ABSENCE')").select(F.col("attempt_id").alias("user_id"), "type", "at_ms", "duration_ms", F.col("bursts").cast("long").alias("bursts"))


def autosave_merge(s, d):
    """Events as autosaves of a user's answers, in three triggers that each run twice: the last value of each, the first batch compacted in between."""
    x = T.scan(s, d, "events").select("user_id", F.col("event_type").alias("question"), F.col("event_id").alias("version"), "value")
    path, keys = new_path(s, "autosave"), ["user_id", "question"]
    put = merge.keep_latest(path, keys, "version")

    def twice(batch, n):
        put(batch, n)
        put(batch, n)
        if n == 1:
            merge.compact(s, path, x.schema, keys, "version", 0)

    q = replayed(x, "version", 3).writeStream.option("checkpointLocation", new_path(s, "autosave-state")).trigger(availableNow=True).foreachBatch(twice)
    q.start().awaitTermination()
    return merge.merged(s, path, x.schema, keys, "version")


def claimed_notices(s, d):
    """Notices that several batches claim: the first claim counts, whatever is repeated."""
    x = T.scan(s, d, "events").select((F.col("event_id") % 400).alias("note_id"), F.col("event_id").alias("claim"), F.col("user_id").alias("worker"))
    path = new_path(s, "claims")
    put = merge.keep_latest(path, ["note_id"], "claim", first=True)
    replayed(x, "claim", 3).writeStream.option("checkpointLocation", new_path(s, "claims-state")).trigger(availableNow=True).foreachBatch(put).start().awaitTermination()
    return merge.merged(s, path, x.schema, ["note_id"], "claim", first=True)


def answered_gaps(s, d):
    k = F.col("o_orderkey")
    o = T.scan(s, d, "orders").select("o_orderkey", F.when(k % 13 > 0, k % 9).alias("here"), F.when(k % 17 > 0, k % 7).alias("there"), (k % 4).alias("unsent"))
    return o.select("o_orderkey", merge.answered_gap("here", "there", "unsent").alias("state"))


def _edges(s, d):
    """A chain of classes with short cuts, and a cycle among the last."""
    c = T.classes(s, d).select(F.col("class_id").cast("long").alias("src"))
    down = c.where("src < 19").withColumn("dst", F.explode(F.array(F.col("src") + 1, F.col("src") * 2 + 1))).where("dst < 20")
    ring = c.where("src >= 20").withColumn("dst", F.when(F.col("src") == 24, 20).otherwise(F.col("src") + 1).cast("long"))
    into = c.where("src = 5").withColumn("dst", F.lit(21).cast("long"))
    return down.union(ring).union(into).distinct()


def graph_closure(s, d):
    return graph.closure(_edges(s, d))


def graph_cycles(s, d):
    return graph.cycles(_edges(s, d))


def graph_levels(s, d):
    e = _edges(s, d)
    nodes = e.select(F.col("src").alias("node")).union(e.select("dst"))
    return graph.levels(e, nodes)


def connected_components(s, d):
    """Customers in tens by chains with gaps at multiples of three."""
    c = T.scan(s, d, "customer").select(F.col("c_custkey").alias("src")).where("src % 10 <> 0 and src % 3 <> 0")
    return graph.components(c.withColumn("dst", F.col("src") - 1))


NAMES = [
    proctor_summary, proctor_baseline, proctor_outliers, proctor_sessions, proctor_away, proctor_pastes, late_event_filter, notify_schedule, notify_dedupe, delivery_states, stream_tumbling, stream_sessions, stream_on_time, stream_throttle, stream_tracker, autosave_merge, claimed_notices, answered_gaps, graph_closure, graph_cycles, graph_levels, connected_components,
]
QUERIES = {f.__name__: f for f in NAMES}

_SUMMARY = """stepped AS (SELECT *, sum(CASE WHEN type = 'FULLSCREEN_EXIT' THEN 1 WHEN type = 'FULLSCREEN_ENTER' AND duration_ms < 1500 THEN -1 ELSE 0 END) OVER (PARTITION BY attempt_id ORDER BY seen, event_id) AS s FROM proctor_events),
floored AS (SELECT *, least(0, min(s) OVER (PARTITION BY attempt_id ORDER BY seen, event_id)) AS low FROM stepped),
summary AS (SELECT attempt_id, count(*) AS events, count(*) FILTER (type = 'TAB_VISIBLE') AS away, CAST(coalesce(sum(duration_ms) FILTER (type = 'TAB_VISIBLE'), 0) AS BIGINT) AS away_ms, coalesce(max(duration_ms) FILTER (type = 'TAB_VISIBLE'), 0) AS longest_ms,
  count(*) FILTER (type = 'PASTE') AS pastes, CAST(arg_max(s - low, (seen, event_id)) AS BIGINT) AS exits FROM floored GROUP BY 1)"""
_DAYS = _SUMMARY + """,
days AS (SELECT *, split_part(attempt_id, '-', -1) AS day FROM summary),
base AS (SELECT day, count(*) AS students, CAST(floor(quantile_cont(away, 0.5) + 0.5) AS BIGINT) AS median, max(away) AS most, count(*) FILTER (away > 0) AS with_events, count(*) >= 5 AND count(*) FILTER (away >= 3) >= count(*) * 0.6 AS widespread FROM days GROUP BY 1)"""
_E = """edges AS (SELECT DISTINCT src, dst FROM (SELECT n_nationkey::BIGINT AS src, unnest([n_nationkey + 1, n_nationkey * 2 + 1])::BIGINT AS dst FROM nation WHERE n_nationkey < 19) WHERE dst < 20
  UNION SELECT n_nationkey, CASE n_nationkey WHEN 24 THEN 20 ELSE n_nationkey + 1 END FROM nation WHERE n_nationkey >= 20 UNION SELECT 5, 21)"""
_REACH = f"""WITH RECURSIVE {_E}, walk(src, dst, hops) AS (SELECT src, dst, 1 FROM edges UNION SELECT w.src, e.dst, w.hops + 1 FROM walk w JOIN edges e ON e.src = w.dst WHERE w.hops < 30),
reach AS (SELECT src, dst, min(hops) AS hops FROM walk GROUP BY 1, 2)"""
_SIGNALS = "signals AS (SELECT user_id, event_id AS seq, CASE event_type WHEN 'view' THEN 'hidden' WHEN 'click' THEN 'visible' WHEN 'purchase' THEN 'blur' WHEN 'signup' THEN 'focus' END AS kind, epoch_us(ts) // 1000 // 1200 AS at_ms, CAST(floor(value) AS BIGINT) AS chars FROM events)"
ORACLES = {
    "proctor_away": f"""WITH {_SIGNALS},
flags AS (SELECT *, coalesce(last_value(CASE kind WHEN 'hidden' THEN true WHEN 'visible' THEN false END IGNORE NULLS) OVER w, false) AS hid, coalesce(last_value(CASE kind WHEN 'blur' THEN true WHEN 'focus' THEN false END IGNORE NULLS) OVER w, false) AS blurred FROM signals WINDOW w AS (PARTITION BY user_id ORDER BY at_ms, seq)),
moves AS (SELECT *, hid OR blurred AS away, coalesce(lag(hid OR blurred) OVER (PARTITION BY user_id ORDER BY at_ms, seq), false) AS was FROM flags),
numbered AS (SELECT *, sum(CAST(away AND NOT was AS INT)) OVER (PARTITION BY user_id ORDER BY at_ms, seq) AS seg FROM moves),
segs AS (SELECT user_id, seg, min(at_ms) AS s, max(at_ms) FILTER (NOT away) AS e, bool_or(hid AND away) AS hid FROM numbered WHERE away OR was GROUP BY 1, 2),
chained AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY seg) AS island FROM (SELECT *, CAST(coalesce(s - lag(e) OVER (PARTITION BY user_id ORDER BY seg) > 2000, true) AS INT) AS new FROM segs)),
whole AS (SELECT user_id, island, min(s) AS s, max(e) AS at_ms, bool_or(hid) AS hid, bool_or(e IS NULL) AS is_open, count(*) AS bursts FROM chained GROUP BY 1, 2)
SELECT user_id, CASE WHEN at_ms - s >= 30000 THEN 'LONG_ABSENCE' WHEN hid THEN 'TAB_VISIBLE' ELSE 'WINDOW_FOCUS' END AS type, at_ms, at_ms - s AS duration_ms, bursts FROM whole WHERE NOT is_open AND at_ms - s >= 1500""",
    "proctor_pastes": f"""WITH {_SIGNALS} SELECT user_id, max(at_ms) AS at_ms, CAST(sum(greatest(chars, 0)) AS BIGINT) AS chars, count(*) AS count FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY at_ms, seq) AS run FROM (
  SELECT *, coalesce(CAST(at_ms - lag(at_ms) OVER (PARTITION BY user_id ORDER BY at_ms, seq) > 2000 AS INT), 1) AS new FROM signals WHERE kind = 'blur')) GROUP BY user_id, run""",
    "proctor_summary": T.sql("SELECT * FROM summary", "proctor_events", extra=_SUMMARY),
    "proctor_baseline": T.sql("SELECT * FROM base", "proctor_events", extra=_DAYS),
    "proctor_outliers": T.sql(
        "SELECT day, attempt_id, away, longest_ms, CAST(row_number() OVER (PARTITION BY day ORDER BY away DESC, longest_ms DESC, attempt_id) AS INT) AS position FROM days JOIN base USING (day) WHERE (away >= greatest(2 * median, 3) OR longest_ms >= 120000) AND NOT widespread", "proctor_events", extra=_DAYS),
    "proctor_sessions": T.sql(
        """SELECT user_id, session, count(*) AS events, min((epoch_us(seen) // 1000)) AS started_ms, max((epoch_us(seen) // 1000)) - min((epoch_us(seen) // 1000)) AS length_ms FROM (SELECT *, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY seen, event_id) AS BIGINT) AS session FROM (
  SELECT *, coalesce(CAST((epoch_us(seen) // 1000) - lag((epoch_us(seen) // 1000)) OVER (PARTITION BY user_id ORDER BY seen, event_id) > 1800000 AS INT), 1) AS new FROM proctor_events)) GROUP BY 1, 2""", "proctor_events"),
    "late_event_filter": T.sql(
        """SELECT event_id, attempt_id, CASE WHEN late THEN 'CLOSED' WHEN row_number() OVER (PARTITION BY attempt_id, late ORDER BY seen, event_id) > 3 THEN 'FULL' ELSE 'OK' END AS fate FROM (
  SELECT *, (epoch_us(seen) // 1000) > min((epoch_us(seen) // 1000)) OVER (PARTITION BY attempt_id) + 21600000 + 300000 AS late FROM proctor_events)""", "proctor_events"),
    "notify_dedupe": """WITH n AS (SELECT user_id % 4 AS tenant_id, event_type || ':' || CAST((epoch_us(ts) // 1000) // 7200000 * 7200000 AS VARCHAR) AS dedupe_key, event_id AS note_id, user_id FROM events)
SELECT tenant_id, dedupe_key, min(note_id) AS note_id, arg_min(user_id, note_id) AS user_id FROM n GROUP BY 1, 2 HAVING count(*) FILTER (note_id % 10 = 0) = 0""",
    "delivery_states": """SELECT event_id, CASE WHEN event_type = 'signup' THEN 'SENT' WHEN event_type = 'error' THEN 'SKIPPED' WHEN value > 20 THEN 'SENT' WHEN event_id % 6 + 1 >= 5 THEN 'FAILED' ELSE 'PENDING' END AS status,
  CASE WHEN event_type NOT IN ('signup', 'error') AND NOT value > 20 AND event_id % 6 + 1 < 5 THEN least(15.0, pow(2.0, event_id % 6)) END AS wait_min FROM events""",
    "stream_tumbling": "SELECT (epoch_us(ts) // 1000) // 3600000 * 3600000 AS start_ms, event_type AS type, count(*) AS n FROM events GROUP BY 1, 2",
    "stream_sessions": """SELECT user_id, min((epoch_us(ts) // 1000)) AS started_ms, max((epoch_us(ts) // 1000)) AS ended_ms, count(*) AS events FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nth FROM (
  SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 30 MINUTES THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, nth""",
    "stream_on_time": T.sql("SELECT event_id, attempt_id FROM (SELECT *, min((epoch_us(seen) // 1000)) OVER (PARTITION BY attempt_id) AS first FROM proctor_events) WHERE (epoch_us(seen) // 1000) <= first + 21600000 + 300000", "proctor_events"),
    "graph_closure": _REACH + " SELECT src, dst, CAST(hops AS INT) AS hops FROM reach",
    "graph_cycles": _REACH + " SELECT least(min(a.dst), a.src) AS cycle, a.src AS node FROM reach a JOIN reach b ON b.src = a.dst AND b.dst = a.src GROUP BY a.src",
    "graph_levels": _REACH + """, nodes AS (SELECT src AS node FROM edges UNION SELECT dst FROM edges), bad AS (SELECT src FROM reach WHERE dst IN (SELECT src FROM reach WHERE src = dst) UNION SELECT src FROM reach WHERE src = dst),
paths AS (SELECT src, max(hops) AS h FROM walk WHERE src NOT IN (SELECT src FROM bad) GROUP BY 1)
SELECT node, CASE WHEN node IN (SELECT src FROM bad) THEN NULL ELSE CAST(coalesce(h, 0) AS INT) END AS level FROM nodes LEFT JOIN paths ON src = node""",
    "connected_components": """WITH e AS (SELECT c_custkey AS src FROM customer WHERE c_custkey % 10 <> 0 AND c_custkey % 3 <> 0), n AS (SELECT src AS node FROM e UNION SELECT src - 1 FROM e)
SELECT node, CAST(min(node) OVER (PARTITION BY grp) AS BIGINT) AS component FROM (SELECT node, sum(CASE WHEN node IN (SELECT src FROM e) THEN 0 ELSE 1 END) OVER (ORDER BY node) AS grp FROM n)""",
}
ORACLES["stream_tracker"] = ORACLES["proctor_away"]
ORACLES["autosave_merge"] = "SELECT user_id, event_type AS question, max(event_id) AS version, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2"
ORACLES["claimed_notices"] = "SELECT event_id % 400 AS note_id, min(event_id) AS claim, arg_min(user_id, event_id) AS worker FROM events GROUP BY 1"
ORACLES["answered_gaps"] = """SELECT o_orderkey, CASE WHEN h IS NULL OR t IS NULL THEN 'unknown' WHEN h <= t THEN 'ok' WHEN h - t <= o_orderkey % 4 THEN 'pending' ELSE 'lost' END AS state
FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 13 > 0 THEN o_orderkey % 9 END AS h, CASE WHEN o_orderkey % 17 > 0 THEN o_orderkey % 7 END AS t FROM orders)"""
