"""Derivation edges, their checks, run reports and totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talespark.functions.text import is_uuid


#: Rows of an activity table that one task takes; what they expand to is several times as much.
TASK_ROWS = 250_000


def _tasks(*tables: DataFrame) -> int:
    """A number of tasks that grows with the rows. Spark deals out by bytes before the
    expansion, so left to itself it would give a task as much as its memory takes."""
    least = int(tables[0].sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, *(-(-t.count() // TASK_ROWS) for t in tables))


def relations(used: DataFrame, generated: DataFrame) -> DataFrame:
    """(activity, src, dst): every generated entity derives from every used one of its
    activity, once; null entities are none. Rows are dealt out by activity over tasks whose
    number grows with the rows."""
    n = _tasks(used, generated)
    side = lambda table, name: table.select("activity", F.col("entity").alias(name)).filter(F.col(name).isNotNull()).repartition(n, "activity").distinct()
    return side(used, "src").join(side(generated, "dst"), "activity").select("activity", "src", "dst")


def edge_counts(used: DataFrame, generated: DataFrame) -> DataFrame:
    """(dst, edges, sources): how many relations end in an entity, and from how many
    different entities. Pairs are dealt out over as many tasks as the relations."""
    pairs = relations(used, generated).select("dst", "src").repartition(_tasks(used, generated), "dst", "src")
    return pairs.groupBy("dst", "src").agg(F.count("*").alias("n")).groupBy("dst").agg(F.sum("n").alias("edges"), F.count("*").alias("sources"))


def run_totals(entries: DataFrame, source: str | list[str], status: str) -> DataFrame:
    """Counts by source (one column, or provider and source) and status with totals."""
    return entries.rollup(*([source] if isinstance(source, str) else source), status).agg(F.count("*").alias("n"))


def run_summary(entries: DataFrame, failures: DataFrame, dry_run: bool = False, builds: bool = True) -> DataFrame:
    """(source_id, threads, generated, ok, complete) of each source with entries (source_id,
    status, generated) or failures (source_id): ok if nothing failed or is blocked;
    complete if ok, every entry is current or excluded, and the run was a real one of a
    mode that ``builds`` notes. A source with failures only is neither."""
    faults = failures.groupBy("source_id").agg(F.count("*").alias("faults"))
    counted = entries.groupBy("source_id").agg(
        F.count("*").alias("threads"), F.count_if("generated").alias("generated"), F.count_if(F.col("status").isin("failed", "blocked")).alias("bad"),
        F.count_if(~F.col("status").isin("current", "excluded")).alias("open"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0))
    ok = (zero("faults") == 0) & (zero("bad") == 0)
    x = counted.join(faults, "source_id", "full_outer")
    return x.select("source_id", zero("threads").alias("threads"), zero("generated").alias("generated"), ok.alias("ok"), (ok & (zero("open") == 0) & F.lit(builds and not dry_run)).alias("complete"))


def last_run(reports: DataFrame, source: str, finished: str, run: str, status: str, ok: str = "ok") -> DataFrame:
    """The last report of each source; of equal times the larger run id. ``all_ok``: the
    status of all of them is ``ok``."""
    top = F.max(F.struct(F.col(finished), F.col(run), F.col(status))).alias("m")
    return reports.groupBy(source).agg(top, F.bool_and(F.col(status) == ok).alias("all_ok")).select(source, f"m.{finished}", f"m.{run}", f"m.{status}", "all_ok")


def source_status(sources: DataFrame, reports: DataFrame) -> DataFrame:
    """One row for each source (provider, source_id, initialized, migration_required) with
    its last report (provider, source_id, finished_at, run, mode, complete): as_of, last_mode,
    complete. Of equal times the larger run counts; a source without a report is incomplete."""
    keys = ["provider", "source_id"]
    last = reports.groupBy(*keys).agg(F.max_by(F.struct("finished_at", "mode", "complete"), F.struct("finished_at", "run")).alias("r"))
    return sources.join(last, keys, "left").select(
        *keys, "initialized", "migration_required", F.col("r.finished_at").alias("as_of"), F.col("r.mode").alias("last_mode"), F.coalesce("r.complete", F.lit(False)).alias("complete")
    )


def overall_status(status: DataFrame) -> DataFrame:
    """One row over ``source_status``: all initialized, any migration required, all complete.
    Without sources nothing is required and the rest holds."""
    flag = lambda f, c, none: F.coalesce(f(c), F.lit(none)).alias(c)
    return status.agg(F.count("*").alias("sources"), flag(F.bool_and, "initialized", True), flag(F.bool_or, "migration_required", False), flag(F.bool_and, "complete", True))


def publish_index(previous: DataFrame, current: DataFrame, source: str | None = None) -> DataFrame:
    """(id, source, version, status): the rows of ``current`` as they are; earlier rows that
    are not current, inactive if they are of ``source`` (any source, if None), else as they
    were. A source that publishes nothing has all its rows inactive. Ids that
    ``index_faults`` names are errors of the caller."""
    gone = previous.join(current.select("id"), "id", "left_anti")
    own = F.lit(True) if source is None else F.col("source").eqNullSafe(F.lit(source))
    rest = gone.withColumn("status", F.when(own, "inactive").otherwise(F.col("status")))
    return current.select("id", "source", "version", "status").unionByName(rest.select("id", "source", "version", "status"))


def index_faults(previous: DataFrame, current: DataFrame, source: str | None = None) -> DataFrame:
    """(id, fault) that forbid ``publish_index``: ids that repeat in ``current``, and ids
    that an earlier row of another source owns."""
    again = current.groupBy("id").count().filter("count > 1").select("id", F.lit("duplicate-id").alias("fault"))
    if source is None:
        return again
    others = previous.filter(~F.col("source").eqNullSafe(F.lit(source))).select("id").distinct()
    return again.unionByName(current.select("id").distinct().join(others, "id", "left_semi").select("id", F.lit("foreign-owner").alias("fault")))


def index_complete(runs: DataFrame, source: str, complete: bool) -> DataFrame:
    """(sources, complete) of the index after a run of ``source``: its flag replaces the
    earlier one, and all sources' flags (source, complete) must hold."""
    now = runs.filter(~F.col("source").eqNullSafe(F.lit(source))).select("source", "complete")
    one = runs.sparkSession.range(1).select(F.lit(source).alias("source"), F.lit(complete).alias("complete"))
    return now.unionByName(one).agg(F.count("*").alias("sources"), F.bool_and("complete").alias("complete"))


def plan_notes(notes: DataFrame, force: bool = False, generate: bool = True, allow_edited: bool = False, dry_run: bool = False) -> DataFrame:
    """Adds ``status`` and ``reason`` of each note, by the first rule that holds:
    deferred ones stay so; one that exists and is fresh is current, unless it is selected
    and ``force`` is set; unselected ones, and all without ``generate``, are pending; a
    reviewed one is blocked; an edited one too, unless ``allow_edited`` or an interrupted
    run left it (``recoverable``); the rest is generate (planned in a dry run).

    Boolean columns: fresh, exists, edited, reviewed, and if there are any: deferred,
    recoverable (absent: false), selected (absent: true). Nulls count as false.
    """
    flag = lambda c, absent=False: F.coalesce(F.col(c), F.lit(False)) if c in notes.columns else F.lit(absent)
    exists, selected = flag("exists"), flag("selected", True)
    current = exists & flag("fresh") & ~(F.lit(force) & selected)
    waits = ~selected | F.lit(not generate)
    reviewed = exists & flag("reviewed")
    edited = exists & flag("edited") & ~flag("recoverable") & F.lit(not allow_edited)
    status = F.when(flag("deferred"), "deferred").when(current, "current").when(waits, "pending").when(reviewed | edited, "blocked").otherwise("planned" if dry_run else "generate")
    build = "session-note-needs-build"
    reason = F.when(flag("deferred") | current, None).when(waits, build).when(reviewed, "reviewed-session-note").when(edited, "edited-session-note").otherwise(build)
    return notes.withColumn("status", status).withColumn("reason", reason)


def make_entities(rows: DataFrame) -> DataFrame:
    """Entities of (id, sha256, byte_count): version, snapshot reference and key."""
    return rows.select(
        "id", F.concat(F.lit("sha256:"), "sha256").alias("version"), "sha256", "byte_count",
        F.concat(F.lit("data:/blobs/"), F.substring("sha256", 1, 2), F.lit("/"), F.col("sha256")).alias("snapshot_ref"),
        F.sha2(F.concat(F.col("id").cast("string").cast("binary"), F.unhex(F.lit("00")), F.col("sha256").cast("binary")), 256).alias("entity_key"),
    )


def used_entities(captures: DataFrame, events: DataFrame, metadata: DataFrame, last_outputs: DataFrame) -> DataFrame:
    """(activity, entity, role): all that an activity read, prior outputs included."""
    rows = [df.select("activity", "entity", F.lit(role).alias("role")) for df, role in ((captures, "capture"), (events, "events"), (metadata, "metadata"), (last_outputs, "prior-output"))]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3]).distinct()


def validate_index(artifacts: DataFrame, activities: DataFrame, files: DataFrame, version: int) -> DataFrame:
    """(id, fault) of index rows and activities: another schema version, current artifacts
    whose file (ref, sha256) is gone or changed, ids that are no UUID. Columns: artifacts
    id, schema_version, status, ref, sha256; activities id, schema_version, run_id."""
    f = files.select("ref", F.col("sha256").alias("now"))
    wrong = ~F.col("schema_version").eqNullSafe(F.lit(version))
    changed = (F.col("status") == "current") & ~F.col("now").eqNullSafe(F.col("sha256"))
    a = artifacts.join(f, "ref", "left").select("id", F.when(wrong, "schema-version").when(changed, "artifact-changed").alias("fault"))
    uuid = lambda c: F.coalesce(is_uuid(F.col(c)), F.lit(False))
    b = activities.select("id", F.when(wrong, "schema-version").when(~(uuid("id") & uuid("run_id")), "identity").alias("fault"))
    return a.unionByName(b).filter("fault IS NOT NULL")


def index_counts(artifacts: DataFrame, activities: DataFrame, entities: DataFrame) -> DataFrame:
    """One row: artifacts, activities, and distinct snapshots (snapshot_ref, sha256)."""
    one = artifacts.agg(F.count("*").alias("artifacts")), activities.agg(F.count("*").alias("activities")), entities.select("snapshot_ref", "sha256").distinct().agg(F.count("*").alias("snapshots"))
    keyed = [x.withColumn("_k", F.lit(1)) for x in one]
    return keyed[0].join(keyed[1], "_k").join(keyed[2], "_k").drop("_k")


def validate_entities(entities: DataFrame, snapshots: DataFrame, schema_version: int | None = None) -> DataFrame:
    """(id, fault) of entities, in an index or an activity, by the first rule that they break:
    another ``schema_version`` (where one is asked for), an empty id, a wrong digest, version or
    snapshot. Snapshots (snapshot_ref, sha256, byte_count) are joined by name, once each.
    Entities may repeat; only an index's artifacts must not (:func:`repeated_artifacts`)."""
    s = snapshots.select("snapshot_ref", F.col("sha256").alias("s_sha"), F.col("byte_count").alias("s_bytes"))
    other = F.lit(False) if schema_version is None else ~F.col("schema_version").eqNullSafe(F.lit(schema_version))
    fault = (
        F.when(other, "schema-version").when(F.coalesce(F.col("id").cast("string"), F.lit("")) == "", "identity")
        .when(~F.coalesce(F.col("sha256").rlike("^[0-9a-f]{64}$"), F.lit(False)), "digest").when(~F.col("version").eqNullSafe(F.concat(F.lit("sha256:"), "sha256")), "version")
        .when(F.col("s_sha").isNull(), "snapshot-missing").when((F.col("s_sha") != F.col("sha256")) | (F.col("s_bytes") != F.col("byte_count")), "snapshot-corrupt")
    )
    return entities.join(s, "snapshot_ref", "left").select("id", fault.alias("fault")).filter("fault IS NOT NULL")


def repeated_artifacts(artifacts: DataFrame) -> DataFrame:
    """(id, fault) of ids that several rows of an index have."""
    return artifacts.groupBy("id").count().filter("count > 1").select("id", F.lit("duplicate-id").alias("fault"))


def validate_relations(edges: DataFrame, used: DataFrame, generated: DataFrame) -> DataFrame:
    """(activity, src, dst, fault) of edges (activity, src, dst, type) whose type or ends
    are not those of their activity. Where edges have src_version and dst_version, and the
    entities a version, these must agree too. Null versions agree with none."""
    ends = {"src": ["src"], "dst": ["dst"]}
    if "src_version" in edges.columns:
        ends = {"src": ["src", "src_version"], "dst": ["dst", "dst_version"]}
    end = lambda table, name, mark: table.select("activity", *(F.col(c).alias(a) for c, a in zip(("entity", "version"), ends[name])), F.lit(True).alias(mark)).distinct()
    u, g = end(used, "src", "u"), end(generated, "dst", "g")
    fault = F.when(F.col("type") != "derivedFrom", "type").when(F.col("g").isNull(), "unknown-generated").when(F.col("u").isNull(), "unknown-used")
    return edges.join(u, ["activity", *ends["src"]], "left").join(g, ["activity", *ends["dst"]], "left").select("activity", *ends["src"], *ends["dst"], fault.alias("fault")).filter("fault IS NOT NULL")


def relocate_store(artifacts: DataFrame, activities: DataFrame, entities: DataFrame, source: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One source's (artifacts, activities, entities): entities stay if an artifact or an
    activity of the source names them; an artifact whose content no longer has the
    indexed digest becomes protected. Columns: artifacts id, source, activity, sha256,
    now_sha256; activities activity, source, entity; entities entity."""
    own = artifacts.filter(F.col("source") == source)
    status = F.when(F.col("now_sha256").eqNullSafe(F.col("sha256")), "current").otherwise("protected")
    acts = activities.filter(F.col("source") == source)
    reach = own.select(F.col("id").alias("entity")).union(acts.select("entity")).distinct()
    return own.withColumn("status", status), acts, entities.join(reach, "entity", "left_semi")


# A folder's earlier and present name.
RENAMED = ("thread-notes", "session-notes")


def rewrite_locator(c: Column, moved: dict[str, str], own_prefix: str | None = None) -> Column:
    """A locator after a move: ``own_prefix`` (of the source) is cut to its scheme, the old
    folder's name at its head is replaced, then the longest of the ``moved`` places that is
    the locator or holds it gives way to the new one, in which the old folder's name goes
    too. Other texts and nulls stay."""
    before, now = RENAMED
    if own_prefix is not None:
        scheme = own_prefix[: own_prefix.index("/") + 1]
        c = F.when(c.startswith(own_prefix), F.concat(F.lit(scheme), F.substring(c, len(own_prefix) + 1, 2**31 - 1))).otherwise(c)
    head = f"data:/{before}/"
    c = F.when(c.startswith(head), F.concat(F.lit(f"data:/{now}/"), F.substring(c, len(head) + 1, 2**31 - 1))).otherwise(c)
    out = None
    for old in sorted(moved, key=len, reverse=True):
        inside = (c == old) | c.startswith(old if old.endswith("/") else f"{old}/") | c.startswith(f"{old}\\")
        new = F.replace(F.concat(F.lit(moved[old]), F.substring(c, len(old) + 1, 2**31 - 1)), F.lit(before), F.lit(now))
        out = F.when(inside, new) if out is None else out.when(inside, new)
    return c if out is None else out.otherwise(c)


def verify_copy(source: DataFrame, copy: DataFrame) -> DataFrame:
    """(path, state) of two file lists (path, sha256): same, conflict, to-copy, extra."""
    x = source.select("path", F.col("sha256").alias("a")).join(copy.select("path", F.col("sha256").alias("b")), "path", "full_outer")
    state = F.when(F.col("b").isNull(), "to-copy").when(F.col("a").isNull(), "extra").when(F.col("a") == F.col("b"), "same").otherwise("conflict")
    return x.select("path", state.alias("state"))


def plan_signature(files: DataFrame, buckets: int = 4096) -> DataFrame:
    """One digest of a file list (path, sha256), whatever its order: rows are digested,
    digests sorted within hash ranges, and the ranges' digests taken together, so no task
    holds all of them."""
    row = F.sha2(F.concat_ws("\n", "path", "sha256"), 256)
    part = files.select(row.alias("r")).groupBy(F.pmod(F.xxhash64("r"), F.lit(buckets)).alias("b")).agg(F.sha2(F.array_join(F.sort_array(F.collect_list("r")), ""), 256).alias("d"))
    return part.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "d"))), lambda x: x["d"]), ""), 256).alias("signature"))
