"""The library of games, jobs and settings: states, totals, retention, actions, and checks of records.

games: id, name, source, verified, session (its state or null), error, store_bytes, overlay_bytes,
original_bytes, analyzed, compatibility, confirmed. jobs: id, game_id, operation, state, stage,
started_at, finished_at. Times are milliseconds. Unknown measurements are null and stay so.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import ancestors, relative_executable

DAY_MS = 86_400_000
# Words in the names of programs that are no games, and labels of states and stages.
EXCLUDED = ("uninstall", "updater", "crash", "reporter", "redist", "setup", "helper")
RUNNING = {"optimize": "optimizing", "mount": "mounting", "launch": "launching", "stop": "stopping", "unmount": "unmounting"}
SESSIONS = {"mounted": "mounted", "running": "running", "launcher_exited_but_game_running": "running"}
LIFECYCLES = {"running": "running", "launching": "running", "launcher_exited_but_game_running": "launcher_exited_but_game_running", "exited": "mounted", "needs_attention": "needs_attention"}
STAGES = {
    "measuring_source": "Measuring source and temporary requirements", "fixed_scanning": "Scanning files for fixed chunks", "testing_fixed_chunks": "Testing fixed chunks and compression",
    "fixed_verifying": "Verifying fixed-chunk measurements", "fixed_finalizing": "Finalizing fixed-chunk measurements", "cdc_scanning": "Scanning files for content-defined chunks",
    "testing_cdc_chunks": "Testing content-defined chunks and compression", "cdc_verifying": "Verifying content-defined measurements", "cdc_finalizing": "Finalizing content-defined measurements",
    "finalizing_analysis": "Finalizing analysis", "scanning": "Scanning files", "packing": "Building compressed store", "verifying": "Verifying exact bytes", "publishing": "Publishing atomically",
}
EVIDENCE = ("CI simulation", "hosted native test", "physical hardware validation", "commercial game compatibility")
TESTED = ("Tested", "Compatible", "CompatibleWithLimitations", "Broken")
SYSTEMS = ("macos", "windows", "linux")


def pick(table: dict[str, str], key: Column, default: Column) -> Column:
    """The table's value for a key, or the default."""
    literal = F.create_map(*(F.lit(x) for pair in table.items() for x in pair))
    return F.coalesce(F.element_at(literal, key), default)


def launch_candidates(files: DataFrame, most: int = 30) -> DataFrame:
    """Executables that may be the game, best first: path, label, rank. files: path, mode.

    Rank falls by 5 with each directory; ties go by path.
    """
    label = F.substring_index("path", "/", -1)
    depth = F.size(F.split("path", "/")) - 1
    word = F.lower(label).rlike("|".join(EXCLUDED))
    inside = F.array_contains(F.split("path", "/"), "Contents")
    kept = files.where((F.col("mode").bitwiseAND(0o111) != 0) & ~word & ~inside)
    rank = F.greatest(F.lit(0), F.lit(80) - depth * 5)
    return kept.select("path", label.alias("label"), rank.alias("rank")).orderBy(F.col("rank").desc(), "path").limit(most)


def overlapping(new: DataFrame, known: DataFrame) -> DataFrame:
    """Pairs (new, known) of paths one of which is, or is above, the other.

    Equal or above means: one of the other's ancestors or itself; two equi-joins find that, no pairs of
    everything with everything.
    """
    above = lambda c: F.concat(ancestors(F.col(c)), F.array(F.col(c)))
    n, k = new.select(F.col("path").alias("new")).distinct(), known.select(F.col("path").alias("known")).distinct()
    down = n.join(k.withColumn("new", F.explode(above("known"))), "new").select("new", "known")
    up = k.join(n.withColumn("known", F.explode(above("new"))), "known").select("new", "known")
    return down.unionAll(up).distinct()


def latest_jobs(jobs: DataFrame) -> DataFrame:
    """Each game's last job: by start, then id."""
    return jobs.groupBy("game_id").agg(F.max_by(F.struct("id", "operation", "state", "stage", "started_at"), F.struct("started_at", "id")).alias("j")).select("game_id", "j.*")


def current_jobs(jobs: DataFrame) -> DataFrame:
    """Each game's running job (the first of them), else its last one."""
    running = F.col("state") == "running"
    order = F.struct(running.alias("r"), F.when(running, -F.col("started_at")).otherwise(F.col("started_at")).alias("t"), F.when(running, -F.col("id")).otherwise(F.col("id")).alias("i"))
    return jobs.groupBy("game_id").agg(F.max_by(F.struct("id", "operation", "state", "stage"), order).alias("j")).select("game_id", "j.*")


def runtime_states(games: DataFrame, jobs: DataFrame) -> DataFrame:
    """The games with state: what runs, else the session, else errors, store and analysis."""
    running = current_jobs(jobs).where("state = 'running'").select(F.col("game_id").alias("id"), F.col("operation").alias("__op"))
    busy = pick(RUNNING, F.col("__op"), F.lit("needs_attention"))
    state = F.when(F.col("__op").isNotNull(), busy).when(F.col("session").isNotNull(), pick(SESSIONS, F.col("session"), F.lit("needs_attention")))
    state = state.when(F.col("error").isNotNull(), "needs_attention").when(F.col("store_bytes").isNotNull(), F.when(F.col("verified"), "ready").otherwise("needs_attention"))
    return games.join(running, "id", "left").withColumn("state", state.when(F.col("analyzed"), "analyzed").otherwise("unoptimized")).drop("__op")


def actions(states: DataFrame) -> DataFrame:
    """The games with actions: what each may do next, in a fixed order. Jobs are not looked at."""
    free = F.col("session").isNull()
    rules = {
        "mount": F.col("verified") & free,
        "launch": (F.col("state") == "mounted") & ~F.col("compatibility").isin("Unsupported", "Broken") & F.col("confirmed"),
        "stop": F.col("state") == "running",
        "unmount": ~free & (F.col("state") != "running"),
        "recover": ~free & (F.col("state") != "running"),
    }
    listed = F.array(*(F.when(F.coalesce(may, F.lit(False)), F.lit(name)) for name, may in rules.items()))
    return states.withColumn("actions", F.filter(listed, lambda x: x.isNotNull()))


def totals(games: DataFrame) -> DataFrame:
    """One row over verified games all of whose sizes are known: games, original, effective, saved bytes."""
    known = games.where(F.col("verified") & F.col("original_bytes").isNotNull() & F.col("store_bytes").isNotNull() & F.col("overlay_bytes").isNotNull())
    out = known.agg(F.count("*").alias("games"), F.coalesce(F.sum("original_bytes"), F.lit(0)).alias("original"), F.coalesce(F.sum(F.col("store_bytes") + F.col("overlay_bytes")), F.lit(0)).alias("effective"))
    return out.withColumn("saved", F.col("original") - F.col("effective"))


def representations(games: DataFrame) -> DataFrame:
    """id, representation, bytes: the sizes of each game's original, store and overlay as rows."""
    return games.select("id", F.expr("stack(3, 'original', original_bytes, 'store', store_bytes, 'overlay', overlay_bytes) as (representation, bytes)"))


def retained(jobs: DataFrame, now: int, days: int = 30, most: int = 200) -> DataFrame:
    """Jobs that run or ended within ``days``; of more than ``most``, the last by place."""
    kept = jobs.where((F.col("state") == "running") | (F.coalesce("finished_at", F.lit(0)) > now - days * DAY_MS))
    return kept.orderBy(F.col("id").desc()).limit(most)


def shown_progress(progress: DataFrame, least_ms: int = 100) -> DataFrame:
    """The reports shown of each job: the first, and those of another stage than the report before or at
    least ``least_ms`` behind it. progress: job, seq, at_ms, stage."""
    w = Window.partitionBy("job").orderBy("seq")
    last, at = F.lag("stage").over(w), F.lag("at_ms").over(w)
    return progress.withColumn("shown", last.isNull() | (last != F.col("stage")) | (F.col("at_ms") - at >= least_ms)).where("shown").drop("shown")


def readiness(report: DataFrame) -> DataFrame:
    """The rows of system reports with state and can_mount. Unknown is neither available nor missing.

    report: os, available, backend, diagnostic, test.
    """
    unsupported = F.coalesce(~F.col("os").isin(*SYSTEMS), F.lit(False)) | F.coalesce(F.col("diagnostic") == "UNSUPPORTED_VERSION", F.lit(False)) | F.coalesce(F.col("backend") == "unsupported", F.lit(False))
    blocked = F.coalesce(F.col("test") == "BLOCKED", F.lit(False)) & ~F.coalesce(F.col("os") == "windows", F.lit(False))
    failed = F.coalesce(F.col("test") == "FAIL", F.lit(False))
    state = F.when(unsupported, "Unsupported").when(F.col("available").eqNullSafe(F.lit(False)), "Action required").when(F.col("test") == "PASS", "Ready").when(failed | blocked, "Action required").otherwise("Unknown")
    return report.withColumn("state", state).withColumn("can_mount", F.col("available").eqNullSafe(F.lit(True)) & ~failed & ~blocked)


def compatibility_violations(records: DataFrame) -> DataFrame:
    """id, reason of records that are not valid.

    records: id, launch_target, limitations, status, tested_version, test_date, evidence (array of level,
    receipt, commit).
    """
    control = lambda s: s.rlike(r"[\x00-\x1f\x7f-\x9f]") | (F.octet_length(s) > 4096)
    bad = lambda e: ~e["level"].isin(*EVIDENCE) | control(e["receipt"]) | ~e["commit"].rlike(r"^[0-9A-Fa-f]{40}\z")
    reason = F.when((F.size("limitations") > 64) | (F.size("evidence") > 64), "too many")
    reason = reason.when((F.col("launch_target") != "") & ~relative_executable(F.col("launch_target")), "launch target").when(F.exists("limitations", control), "limitation").when(F.exists("evidence", bad), "evidence")
    unproven = F.col("status").isin(*TESTED) & ((F.size("evidence") == 0) | F.col("test_date").isNull() | F.col("tested_version").isNull())
    return records.select("id", reason.when(unproven, "untested").alias("reason")).where("reason is not null")


def may_claim_physical(environment: DataFrame) -> DataFrame:
    """The rows with status: BLOCKED unless attested, a client system, and known to be no virtual machine."""
    sure = F.col("attested") & F.col("is_client") & (F.col("product_type") == 1) & F.col("virtual").eqNullSafe(F.lit(False))
    return environment.withColumn("status", F.when(F.coalesce(sure, F.lit(False)), "NOT RUN").otherwise("BLOCKED"))


def search(games: DataFrame, text: str) -> DataFrame:
    return games.where(F.contains(F.lower("name"), F.lit(text.lower())))


def diagnostics(games: DataFrame) -> DataFrame:
    """What may leave the machine: no names, paths or error texts."""
    return games.select("id", "verified", "compatibility", F.col("session").alias("runtime"), F.col("error").isNotNull().alias("has_error"), "store_bytes")


def backup_violations(games: DataFrame) -> DataFrame:
    """Games of a backup with unsafe ids or sources."""
    reason = F.when(~F.col("id").rlike(r"^g-[A-Za-z0-9-]*\z"), "id").when(~F.startswith("source", F.lit("/")), "source")
    return games.select("id", reason.alias("reason")).where("reason is not null")


MOST_ENTRIES = 1000


def add(entries: DataFrame, new: DataFrame, storage: str) -> DataFrame:
    """The library with ``new`` entries (id, source); one that is a source already, or lies below or above
    one or the storage folder, is an error, and so are more than MOST_ENTRIES."""
    near = overlapping(new.select(F.col("source").alias("path")), entries.select(F.col("source").alias("path")).unionAll(entries.sparkSession.createDataFrame([(storage,)], "path string")))
    clash = near.select("new").distinct().limit(20).collect()
    if clash:
        raise ValueError(f"already registered, or overlaps another entry or the storage: {', '.join(sorted(r[0] for r in clash))}")
    out = entries.unionByName(new, allowMissingColumns=True)
    if out.limit(MOST_ENTRIES + 1).count() > MOST_ENTRIES:
        raise ValueError(f"more than {MOST_ENTRIES} entries")
    return out


def remove(entries: DataFrame, id_: str) -> DataFrame:
    """The library without an entry, which must be there; files stay."""
    if entries.where(F.col("id") == id_).isEmpty():
        raise ValueError(f"unknown entry {id_}")
    return entries.where(F.col("id") != id_)


def forget_stores(entries: DataFrame, stores: DataFrame) -> DataFrame:
    """The library with the stores forgotten that are not among ``stores`` (store): no store, not verified,
    no error. Nothing is deleted; stores that are there stay registered."""
    there = stores.select("store").distinct().withColumn("there", F.lit(True))
    joined = entries.join(there, "store", "left")
    lost = F.col("store").isNotNull() & F.col("there").isNull()
    return joined.select(*(F.when(lost, F.lit(False) if c == "verified" else F.lit(None)).otherwise(F.col(c)).alias(c) if c in ("store", "verified", "error") else F.col(c) for c in entries.columns))


def loaded_jobs(jobs: DataFrame, now: int) -> DataFrame:
    """Jobs as they are after a start: what was running was interrupted, and ended now. jobs: state,
    cancellable, finished_at, error and others."""
    stopped = F.col("state") == "running"
    change = {"state": F.lit("interrupted"), "cancellable": F.lit(False), "finished_at": F.lit(now).cast("long"), "error": F.lit("stopped before completion")}
    return jobs.select(*(F.when(stopped, change[c]).otherwise(F.col(c)).alias(c) if c in change else F.col(c) for c in jobs.columns))


def loaded(entries: DataFrame, sources: DataFrame, committed: DataFrame) -> DataFrame:
    """Entries as they are after a start. A session that was kept needs attention; a store that is not
    among ``committed`` (store) is not verified, whatever was kept of it; a source that is not among
    ``sources`` (source) is an error to show. entries: source, store, verified, session, error and others."""
    known = lambda t, c: t.select(c).distinct().withColumn(f"__{c}", F.lit(True))
    joined = entries.join(known(sources, "source"), "source", "left").join(known(committed, "store"), "store", "left")
    lost = F.col("store").isNotNull() & F.col("__store").isNull()
    error = F.when(lost, "store missing or incomplete").when(F.col("__source").isNull(), "source missing").otherwise(F.col("error"))
    change = {"verified": F.col("verified") & ~lost, "error": error, "session": F.when(F.col("session").isNotNull(), "needs_attention")}
    return joined.select(*(change[c].alias(c) if c in change else F.col(c) for c in entries.columns))
