"""Queries on the library: games made of documents, jobs of conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import library as op
from ..sources.adapters import PAGE_PATHS, page_paths
from .register import query, table

_OPS = ("analyze", "optimize", "mount", "launch", "stop", "unmount", "verify")
_SESSIONS = ("mounted", "running", "preparing")
_GAMES = """games AS (
  SELECT 'g' || doc_id AS id, doc_id, 'Game ' || lang || ' ' || source || ' ' || doc_id AS name, doc_id % 2 = 0 AS verified, doc_id % 7 = 0 AS analyzed,
         CASE WHEN doc_id % 9 < 3 THEN (['mounted', 'running', 'preparing'])[doc_id % 9 + 1] END AS session, CASE WHEN doc_id % 11 = 0 THEN 'broken' END AS error,
         n_chars AS original_bytes, CASE WHEN doc_id % 4 < 3 THEN n_chars // 2 END AS store_bytes, CASE WHEN doc_id % 5 < 4 THEN doc_id END AS overlay_bytes,
         (['Unknown', 'Compatible', 'Broken', 'Unsupported'])[doc_id % 4 + 1] AS compatibility, doc_id % 3 < 2 AS confirmed FROM documents
)"""
_JOBS = """jobs AS (
  SELECT conv_id * 100 + turn AS id, 'g' || conv_id AS game_id, (['analyze', 'optimize', 'mount', 'launch', 'stop', 'unmount', 'verify'])[(conv_id + turn) % 7 + 1] AS operation,
         CASE WHEN turn = 3 AND conv_id % 3 = 0 THEN 'running' WHEN length(text) % 5 = 0 THEN 'failed' ELSE 'done' END AS state,
         (['scanning', 'packing', 'verifying', 'odd_stage'])[turn % 4 + 1] AS stage, conv_id * 86400000 + turn * 1000 AS started_at,
         CASE WHEN NOT (turn = 3 AND conv_id % 3 = 0) THEN conv_id * 86400000 + turn * 1000 + 500 END AS finished_at FROM conversations
)"""


def _pick(values, i):
    return F.element_at(F.array(*map(F.lit, values)), (i + 1).cast("int"))


def games(spark, sf_dir):
    d, i = table(spark, sf_dir, "documents"), F.col("doc_id")
    return d.select(
        F.concat(F.lit("g"), i).alias("id"), i, F.concat_ws(" ", F.lit("Game"), "lang", "source", i.cast("string")).alias("name"), (i % 2 == 0).alias("verified"), (i % 7 == 0).alias("analyzed"),
        F.when(i % 9 < 3, _pick(_SESSIONS, i % 9)).alias("session"), F.when(i % 11 == 0, "broken").alias("error"), F.col("n_chars").alias("original_bytes"),
        F.when(i % 4 < 3, F.expr("n_chars div 2")).alias("store_bytes"), F.when(i % 5 < 4, i).alias("overlay_bytes"),
        _pick(("Unknown", "Compatible", "Broken", "Unsupported"), i % 4).alias("compatibility"), (i % 3 < 2).alias("confirmed"))


def jobs(spark, sf_dir):
    c, conv, turn = table(spark, sf_dir, "conversations"), F.col("conv_id"), F.col("turn")
    running, start = (turn == 3) & (conv % 3 == 0), conv * 86400000 + turn * 1000
    return c.select(
        (conv * 100 + turn).alias("id"), F.concat(F.lit("g"), conv).alias("game_id"), _pick(_OPS, (conv + turn) % 7).alias("operation"),
        F.when(running, "running").when(F.length("text") % 5 == 0, "failed").otherwise("done").alias("state"), _pick(("scanning", "packing", "verifying", "odd_stage"), turn % 4).alias("stage"),
        start.alias("started_at"), F.when(~running, start + 500).alias("finished_at"))


@query(f"WITH {_JOBS} SELECT game_id, id, operation, state, stage, started_at FROM jobs QUALIFY row_number() OVER (PARTITION BY game_id ORDER BY started_at DESC, id DESC) = 1")
def latest_job(spark, sf_dir):
    return op.latest_jobs(jobs(spark, sf_dir))


_CURRENT = """cur AS (SELECT game_id, id, operation, state, stage FROM jobs QUALIFY row_number() OVER (PARTITION BY game_id ORDER BY state = 'running' DESC,
  CASE WHEN state = 'running' THEN -started_at ELSE started_at END DESC, CASE WHEN state = 'running' THEN -id ELSE id END DESC) = 1)"""


@query(f"WITH {_JOBS}, {_CURRENT} SELECT * FROM cur")
def current_job(spark, sf_dir):
    return op.current_jobs(jobs(spark, sf_dir))


_STATES = f"""{_GAMES}, {_JOBS}, {_CURRENT}, states AS (SELECT g.*, CASE WHEN c.operation IS NOT NULL THEN coalesce(map {{'optimize': 'optimizing', 'mount': 'mounting', 'launch': 'launching', 'stop': 'stopping', 'unmount': 'unmounting'}}[c.operation], 'needs_attention')
  WHEN session IN ('mounted', 'running') THEN session WHEN session IS NOT NULL OR error IS NOT NULL THEN 'needs_attention' WHEN store_bytes IS NOT NULL THEN CASE WHEN verified THEN 'ready' ELSE 'needs_attention' END
  WHEN analyzed THEN 'analyzed' ELSE 'unoptimized' END AS state FROM games g LEFT JOIN (SELECT * FROM cur WHERE state = 'running') c ON c.game_id = g.id)"""


@query(f"WITH {_STATES} SELECT id, state FROM states")
def runtime_state(spark, sf_dir):
    return op.runtime_states(games(spark, sf_dir), jobs(spark, sf_dir)).select("id", "state")


@query(f"""WITH {_STATES} SELECT id, array_to_string(list_filter([CASE WHEN verified AND session IS NULL THEN 'mount' END,
  CASE WHEN state = 'mounted' AND compatibility NOT IN ('Unsupported', 'Broken') AND confirmed THEN 'launch' END, CASE WHEN state = 'running' THEN 'stop' END,
  CASE WHEN session IS NOT NULL AND state <> 'running' THEN 'unmount' END, CASE WHEN session IS NOT NULL AND state <> 'running' THEN 'recover' END], lambda x: x IS NOT NULL), ',') AS actions FROM states""")
def available_actions(spark, sf_dir):
    return op.actions(op.runtime_states(games(spark, sf_dir), jobs(spark, sf_dir))).select("id", F.array_join("actions", ",").alias("actions"))


@query(f"""WITH {_GAMES} SELECT count(*) AS games, sum(original_bytes)::BIGINT AS original, sum(store_bytes + overlay_bytes)::BIGINT AS effective, sum(original_bytes - store_bytes - overlay_bytes)::BIGINT AS saved
FROM games WHERE verified AND store_bytes IS NOT NULL AND overlay_bytes IS NOT NULL""")
def library_totals(spark, sf_dir):
    return op.totals(games(spark, sf_dir))


@query(f"""WITH {_GAMES} SELECT id, 'original' AS representation, original_bytes AS bytes FROM games UNION ALL SELECT id, 'store', store_bytes FROM games UNION ALL SELECT id, 'overlay', overlay_bytes FROM games""")
def storage_representations(spark, sf_dir):
    return op.representations(games(spark, sf_dir))


@query(f"WITH {_JOBS} SELECT id, game_id, state, finished_at FROM jobs WHERE state = 'running' OR coalesce(finished_at, 0) > 90 * 86400000::BIGINT - 30 * 86400000::BIGINT ORDER BY id DESC LIMIT 200")
def job_retention(spark, sf_dir):
    return op.retained(jobs(spark, sf_dir), 90 * op.DAY_MS).select("id", "game_id", "state", "finished_at")


@query("""WITH p AS (SELECT user_id AS job, event_id AS seq, event_id * 7 AS at_ms, event_type AS stage FROM events),
l AS (SELECT *, lag(stage) OVER w AS s, lag(at_ms) OVER w AS t FROM p WINDOW w AS (PARTITION BY job ORDER BY seq)) SELECT job, seq, at_ms, stage FROM l WHERE s IS NULL OR s <> stage OR at_ms - t >= 100""")
def job_progress(spark, sf_dir):
    p = table(spark, sf_dir, "events").select(F.col("user_id").alias("job"), F.col("event_id").alias("seq"), (F.col("event_id") * 7).alias("at_ms"), F.col("event_type").alias("stage"))
    return op.shown_progress(p)


@query(f"WITH {_GAMES} SELECT id, name FROM games WHERE lower(name) LIKE '%fr src1%'")
def library_search(spark, sf_dir):
    return op.search(games(spark, sf_dir), "FR src1").select("id", "name")


@query(f"WITH {_GAMES} SELECT id, verified, compatibility, session AS runtime, error IS NOT NULL AS has_error, store_bytes FROM games")
def diagnostics(spark, sf_dir):
    return op.diagnostics(games(spark, sf_dir))


_SYS = """rep AS (SELECT event_id AS id, (['macos', 'windows', 'linux', 'plan9', NULL])[event_id % 5 + 1] AS os, ([true, false, NULL])[event_id // 5 % 3 + 1] AS available,
  CASE WHEN event_id % 31 = 0 THEN 'unsupported' ELSE 'fuse' END AS backend, CASE WHEN event_id % 37 = 0 THEN 'UNSUPPORTED_VERSION' END AS diagnostic, (['PASS', 'FAIL', 'BLOCKED', NULL])[event_id // 15 % 4 + 1] AS test FROM events)"""


@query(f"""WITH {_SYS} SELECT id, CASE WHEN os = 'plan9' OR diagnostic IS NOT NULL OR backend = 'unsupported' THEN 'Unsupported' WHEN available = false THEN 'Action required' WHEN test = 'PASS' THEN 'Ready'
  WHEN test = 'FAIL' OR (test = 'BLOCKED' AND os IS DISTINCT FROM 'windows') THEN 'Action required' ELSE 'Unknown' END AS state,
  coalesce(available, false) AND test IS DISTINCT FROM 'FAIL' AND NOT (test IS NOT DISTINCT FROM 'BLOCKED' AND os IS DISTINCT FROM 'windows') AS can_mount FROM rep""")
def readiness(spark, sf_dir):
    i = F.col("event_id")
    div = lambda n: F.expr(f"event_id div {n}")
    none = F.lit(None).cast("string")
    pick = lambda values, at: F.element_at(F.array(*(none if v is None else F.lit(v) for v in values)), (at + 1).cast("int"))
    available = F.element_at(F.array(F.lit(True), F.lit(False), F.lit(None).cast("boolean")), (div(5) % 3 + 1).cast("int"))
    rep = table(spark, sf_dir, "events").select(
        i.alias("id"), pick(("macos", "windows", "linux", "plan9", None), i % 5).alias("os"), available.alias("available"), F.when(i % 31 == 0, "unsupported").otherwise("fuse").alias("backend"),
        F.when(i % 37 == 0, "UNSUPPORTED_VERSION").alias("diagnostic"), pick(("PASS", "FAIL", "BLOCKED", None), div(15) % 4).alias("test"))
    return op.readiness(rep).select("id", "state", "can_mount")


@query("""SELECT DISTINCT ([NULL, 'running', 'launching', 'launcher_exited_but_game_running', 'exited', 'needs_attention'])[event_id % 6 + 1] AS lifecycle,
([NULL, 'running', 'running', 'launcher_exited_but_game_running', 'mounted', 'needs_attention'])[event_id % 6 + 1] AS state FROM events WHERE event_id % 6 > 0""")
def session_states(spark, sf_dir):
    life = _pick(("", "running", "launching", "launcher_exited_but_game_running", "exited", "needs_attention"), F.col("event_id") % 6)
    rows = table(spark, sf_dir, "events").where("event_id % 6 > 0").select(life.alias("lifecycle")).distinct()
    return rows.withColumn("state", op.pick(op.LIFECYCLES, F.col("lifecycle"), F.lit("needs_attention")))


@query(f"WITH {_JOBS} SELECT DISTINCT stage, CASE stage WHEN 'scanning' THEN 'Scanning files' WHEN 'packing' THEN 'Building compressed store' WHEN 'verifying' THEN 'Verifying exact bytes' ELSE 'odd stage' END AS label FROM jobs")
def stage_labels(spark, sf_dir):
    return jobs(spark, sf_dir).select("stage").distinct().withColumn("label", op.pick(op.STAGES, F.col("stage"), F.replace(F.col("stage"), F.lit("_"), F.lit(" "))))


@query("""WITH r AS (SELECT doc_id AS id, CASE WHEN doc_id % 6 = 0 THEN '../x' WHEN doc_id % 6 = 1 THEN '' ELSE 'bin/game' END AS target, CASE WHEN doc_id % 10 = 3 THEN 'a' || chr(7) ELSE 'fine' END AS limitation,
  CASE WHEN doc_id % 8 = 5 THEN 'rumour' ELSE 'CI simulation' END AS level, (['Unknown', 'Tested', 'Broken'])[doc_id % 3 + 1] AS status, CASE WHEN doc_id % 4 > 0 THEN '1.0' END AS version FROM documents)
SELECT id, CASE WHEN target = '../x' THEN 'launch target' WHEN limitation <> 'fine' THEN 'limitation' WHEN level = 'rumour' THEN 'evidence' ELSE 'untested' END AS reason FROM r
WHERE target = '../x' OR limitation <> 'fine' OR level = 'rumour' OR (status <> 'Unknown' AND version IS NULL)""")
def compat_violations(spark, sf_dir):
    i = F.col("doc_id")
    evidence = F.array(F.struct(F.when(i % 8 == 5, "rumour").otherwise("CI simulation").alias("level"), F.lit("r").alias("receipt"), F.lit("0" * 40).alias("commit")))
    rec = table(spark, sf_dir, "documents").select(
        i.alias("id"), F.when(i % 6 == 0, "../x").when(i % 6 == 1, "").otherwise("bin/game").alias("launch_target"), F.array(F.when(i % 10 == 3, "a\x07").otherwise("fine")).alias("limitations"),
        _pick(("Unknown", "Tested", "Broken"), i % 3).alias("status"), F.when(i % 4 > 0, "1.0").alias("tested_version"), F.lit("2024-01-01").alias("test_date"), evidence.alias("evidence"))
    return op.compatibility_violations(rec)


@query("""SELECT doc_id AS id, CASE WHEN doc_id % 2 = 0 AND doc_id % 3 < 2 AND doc_id % 5 = 1 AND doc_id % 7 = 0 THEN 'NOT RUN' ELSE 'BLOCKED' END AS status FROM documents""")
def evidence_gate(spark, sf_dir):
    i = F.col("doc_id")
    env = table(spark, sf_dir, "documents").select(i.alias("id"), (i % 2 == 0).alias("attested"), (i % 3 < 2).alias("is_client"), (i % 5).alias("product_type"), F.when(i % 7 == 0, False).when(i % 7 == 1, True).alias("virtual"))
    return op.may_claim_physical(env).select("id", "status")


@query(f"""WITH {PAGE_PATHS}, f AS (SELECT path || (['', '.setup', '/Contents/x', ''])[page_id % 4 + 1] AS path, CASE WHEN page_id % 3 = 0 THEN 493 ELSE 420 END AS mode FROM page_paths)
SELECT path, regexp_extract(path, '([^/]*)$', 1) AS label, greatest(0, 80 - 5 * (len(string_split(path, '/')) - 1))::INT AS rank FROM f
WHERE mode = 493 AND NOT contains(path, '.setup') AND NOT regexp_matches(lower(regexp_extract(path, '([^/]*)$', 1)), 'uninstall|updater|crash|reporter|redist|setup|helper') AND NOT contains(path, '/Contents/') ORDER BY rank DESC, path LIMIT 30""")
def launch_candidates(spark, sf_dir):
    i = F.col("page_id")
    f = page_paths(spark, sf_dir).select(F.concat("path", _pick(("", ".setup", "/Contents/x", ""), i % 4)).alias("path"), F.when(i % 3 == 0, 493).otherwise(420).alias("mode"))
    return op.launch_candidates(f)


@query(f"""WITH {PAGE_PATHS}, n AS (SELECT DISTINCT CASE WHEN page_id % 2 = 0 THEN regexp_replace(path, '/[^/]*$', '') ELSE path END AS p FROM page_paths),
k AS (SELECT DISTINCT path AS p FROM page_paths) SELECT n.p AS new, k.p AS known FROM n, k WHERE n.p = k.p OR starts_with(n.p, k.p || '/') OR starts_with(k.p, n.p || '/')""")
def prefix_overlap(spark, sf_dir):
    p, i = page_paths(spark, sf_dir), F.col("page_id")
    n = p.select(F.when(i % 2 == 0, F.regexp_replace("path", "/[^/]*$", "")).otherwise(F.col("path")).alias("path"))
    return op.overlapping(n, p)


@query("SELECT CASE WHEN doc_id % 3 = 0 THEN 'g_' ELSE 'g-' END || doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN 'id' ELSE 'source' END AS reason FROM documents WHERE doc_id % 3 = 0 OR doc_id % 5 = 0")
def backup_violations(spark, sf_dir):
    i = F.col("doc_id")
    rows = table(spark, sf_dir, "documents").select(F.concat(F.when(i % 3 == 0, "g_").otherwise("g-"), i).alias("id"), F.when(i % 5 == 0, "games/x").otherwise("/games/x").alias("source"))
    return op.backup_violations(rows)


@query("""SELECT 'g' || doc_id AS id, CASE WHEN doc_id % 4 > 1 THEN 's' || doc_id END AS store, doc_id % 4 > 1 AND doc_id % 3 > 0 AS verified, CASE WHEN doc_id % 5 = 0 THEN 'needs_attention' END AS session,
CASE WHEN doc_id % 4 = 1 THEN NULL WHEN doc_id % 6 = 0 THEN 'source missing' ELSE 'old' END AS error FROM documents WHERE doc_id < 900 AND doc_id <> 7 UNION ALL SELECT 'new', NULL, false, NULL, NULL""")
def library_changes(spark, sf_dir):
    """A library of the first entries, no more than one may have: loaded, lost stores forgotten, one entry removed, one added."""
    i = F.col("doc_id")
    rows = table(spark, sf_dir, "documents").where("doc_id < 900").select(F.concat(F.lit("g"), i).alias("id"), F.concat(F.lit("lib/g"), i).alias("source"), F.when(i % 4 > 0, F.concat(F.lit("s"), i)).alias("store"), (i % 3 > 0).alias("verified"), F.when(i % 5 == 0, "running").alias("session"), F.lit("old").alias("error"))
    nth = F.substring("id", 2, 9).cast("long")
    stores, sources = rows.where("store is not null").where(nth % 4 != 1).select("store"), rows.where(nth % 6 != 0).select("source")
    seen = op.loaded(rows, sources, stores).withColumn("verified", F.col("verified") & F.col("store").isNotNull())
    kept = op.remove(op.forget_stores(seen, stores), "g7")
    new = spark.createDataFrame([("new", "lib/other")], "id string, source string")
    return op.add(kept, new, "storage").select("id", "store", F.coalesce("verified", F.lit(False)).alias("verified"), "session", "error")


@query("""SELECT event_id AS id, CASE WHEN event_type = 'view' THEN 'interrupted' ELSE event_type END AS state, event_type <> 'view' AND user_id % 2 = 0 AS cancellable,
CASE WHEN event_type = 'view' THEN 99 ELSE user_id END AS finished_at, CASE WHEN event_type = 'view' THEN 'stopped before completion' END AS error FROM events""")
def jobs_after_start(spark, sf_dir):
    """Jobs of which those that were running have been interrupted."""
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.when(F.col("event_type") == "view", "running").otherwise(F.col("event_type")).alias("state"), (F.col("user_id") % 2 == 0).alias("cancellable"), F.col("user_id").cast("long").alias("finished_at"), F.lit(None).cast("string").alias("error"))
    return op.loaded_jobs(e, 99)
