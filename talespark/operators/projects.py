"""Project registry, membership history, selection by roots, store references."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talespark.functions.text import ancestors, normalize_path
from talespark.sources.logs import is_safe


def refresh_registry(registry: DataFrame, projects: DataFrame) -> DataFrame:
    """The registry (project, name, roots, aliases, extra) after a look at the app's
    projects (project, name, roots), with ``status`` bound or inactive and ``method`` new,
    project-id or null. Roots that were replaced become aliases, once for each
    normalised path; fields not named here ride along in ``extra``."""
    p = projects.select("project", F.col("name").alias("now_name"), F.col("roots").alias("now_roots"), F.lit(True).alias("seen"))
    r = registry.withColumn("old", F.lit(True))
    x = r.join(p, "project", "full_outer")
    none = F.array().cast("array<string>")
    past = F.concat(F.coalesce("aliases", none), F.coalesce("roots", none))
    norm = lambda a: F.transform(a, lambda v: normalize_path(v))
    gone = F.filter(past, lambda v: ~F.array_contains(norm(F.coalesce("now_roots", none)), normalize_path(v)))
    aliases = F.filter(gone, lambda v, i: F.array_position(norm(gone), normalize_path(v)) == i + 1)
    seen = F.col("seen").isNotNull()
    return x.select(
        "project", F.when(seen, F.col("now_name")).otherwise(F.col("name")).alias("name"), F.when(seen, F.col("now_roots")).otherwise(F.col("roots")).alias("roots"),
        F.when(seen, aliases).otherwise(F.col("aliases")).alias("aliases"), "extra", F.when(seen, "bound").otherwise("inactive").alias("status"),
        F.when(seen & F.col("old").isNull(), "new").when(seen, "project-id").alias("method"),
    )


def append_history(previous: DataFrame, observed: DataFrame) -> DataFrame:
    """(source_id, thread, history): observations (kind, project, at) so far, plus the new
    one if its kind or project differs from the last. Threads not seen now stay."""
    new = observed.select("source_id", "thread", F.struct("kind", "project", "at").alias("o"))
    x = previous.join(new, ["source_id", "thread"], "full_outer")
    last = F.try_element_at("history", F.lit(-1))
    same = F.col("o").isNull() | (last.isNotNull() & last["kind"].eqNullSafe(F.col("o.kind")) & last["project"].eqNullSafe(F.col("o.project")))
    so_far = F.filter(F.coalesce("history", F.array("o")), lambda h: h.isNotNull())
    history = F.when(F.col("history").isNull(), F.array("o")).when(same, so_far).otherwise(F.concat(so_far, F.array("o")))
    return x.select("source_id", "thread", history.alias("history"))


def select_for_roots(events: DataFrame, roots: DataFrame, explicit: DataFrame) -> DataFrame:
    """Events below the roots, and all events of explicitly assigned threads; an event
    without a folder takes its thread's. Folders are compared once each; empty roots and
    those of slashes only hold nothing."""
    at = events.withColumn("_path", normalize_path(F.when(F.coalesce("cwd", F.lit("")) != "", F.col("cwd")).otherwise(F.col("thread_cwd"))))
    up = at.select("_path").distinct().withColumn("_root", F.explode(ancestors(F.col("_path")))).filter("_root <> ''")
    inside = up.join(roots.select(normalize_path(F.col("root")).alias("_root")), "_root", "left_semi").select("_path").distinct()
    assigned = explicit.select("thread").distinct()
    mine = at.join(assigned, "thread", "left_semi")
    others = at.join(assigned, "thread", "left_anti").join(inside, "_path", "left_semi")
    return mine.unionByName(others).drop("_path")


def resolve_refs(refs: DataFrame, aliases: DataFrame) -> DataFrame:
    """Adds ``target`` to (ref): the longest alias ``prefix`` that begins it is replaced
    by ``target``; null if the path is unsafe before or after. Prefixes end in a slash,
    so each is one of the ref's own ancestors: an equi-join."""
    parts = F.split("ref", "/", -1)
    up = F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.concat(F.array_join(F.slice(parts, 1, n), "/"), F.lit("/"))))
    tried = refs.select("ref").distinct().withColumn("prefix", F.explode(up)).join(aliases.select("prefix", F.col("target").alias("new")), "prefix")
    best = tried.groupBy("ref").agg(F.max_by(F.struct("prefix", "new"), F.length("prefix")).alias("b"))
    moved = F.when(F.col("b").isNull(), F.col("ref")).otherwise(F.concat(F.col("b.new"), F.substring("ref", F.length("b.prefix") + 1, F.length("ref"))))
    return refs.join(best, "ref", "left").withColumn("target", F.when(is_safe(F.col("ref")) & is_safe(moved), moved)).drop("b")
