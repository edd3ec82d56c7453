"""Projects: directory containment, membership, checks and fair order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talespark.functions.text import ancestors, normalize_path
from talespark.operators.ranks import key_sizes, ranked, turns_left, turns_served


def within_roots(paths: DataFrame, roots: DataFrame) -> DataFrame:
    """(path columns, project) of each path equal to or below a root: ancestors are
    listed, so the test is an equi-join. Null paths and roots, and those that are empty
    or only slashes, contain and are in nothing."""
    up = paths.withColumn("_root", F.explode(ancestors(normalize_path(F.col("path"))))).filter("_root <> ''")
    return up.join(roots.select(normalize_path(F.col("root")).alias("_root"), "project"), "_root").drop("_root")


def membership(threads: DataFrame, projectless: DataFrame, owners: DataFrame, state: bool = True) -> DataFrame:
    """(thread, kind, project, candidates): projectless, explicit, inferred (one owner),
    ambiguous or unmatched, in this precedence; all state-unavailable without the app's
    ``state``. ``threads`` has (thread, assigned); ``owners`` (thread, project) may repeat.
    ``candidates`` are the sorted owners of an ambiguous thread, else empty."""
    found = owners.groupBy("thread").agg(F.sort_array(F.collect_set("project")).alias("found"))
    t = threads.join(projectless.select("thread", F.lit(True).alias("none")).distinct(), "thread", "left").join(found, "thread", "left")
    n = F.coalesce(F.size("found"), F.lit(0))
    kind = F.when(F.col("none"), "projectless").when(F.col("assigned").isNotNull(), "explicit").when(n == 1, "inferred").when(n > 1, "ambiguous").otherwise("unmatched")
    project = F.when(kind == "explicit", F.col("assigned")).when(kind == "inferred", F.element_at("found", 1))
    if not state:
        kind, project = F.lit("state-unavailable"), F.lit(None).cast(dict(threads.dtypes)["assigned"])
    candidates = F.when(kind == "ambiguous", F.col("found")).otherwise(F.array().cast(dict(found.dtypes)["found"]))
    return t.select("thread", kind.alias("kind"), project.alias("project"), candidates.alias("candidates"))


def double_assignments(assignments: DataFrame) -> DataFrame:
    """Threads assigned to more than one project."""
    return assignments.groupBy("thread").agg(F.countDistinct("project").alias("projects")).filter("projects > 1")


def unknown_projects(assignments: DataFrame, projects: DataFrame) -> DataFrame:
    """Assignments to projects that are not known; a null project is unknown."""
    return assignments.join(projects, "project", "left_anti")


def foreign_threads(notes: DataFrame, assignments: DataFrame) -> DataFrame:
    """(thread, project, owner) of notes kept by one project whose thread is assigned to
    another one. Columns: notes thread, project; assignments thread, project."""
    return notes.join(assignments.select("thread", F.col("project").alias("owner")), "thread").filter("project <> owner").select("thread", "project", "owner").distinct()


ORDER = ["started_at", "thread"]


def round_robin(candidates: DataFrame) -> DataFrame:
    """``turn`` in which each candidate is served: one of each project at a time, in order of
    started_at and thread (nulls first). A null project is one too."""
    return ranked(candidates, ["project"], ORDER, "turn").withColumn("turn", F.col("turn").cast("int"))


def first_served(candidates: DataFrame, n: int) -> DataFrame:
    """The budget: the first n of the fair order. The projects' sizes tell the last turn
    that it reaches; candidates of later turns are dropped before they are ordered."""
    last = turns_served(key_sizes(candidates, "project")[1], n)
    return round_robin(candidates).filter(F.col("turn") <= last).orderBy("turn", "project").limit(n)


def last_served(candidates: DataFrame, n: int) -> DataFrame:
    """The budget of a backfill: the last n of the fair order. Projects that have no
    candidate in its turns are dropped before candidates are ranked, earlier turns before
    they are ordered."""
    sizes, counts = key_sizes(candidates, "project")
    first = turns_left(counts, n)
    long = sizes.filter(F.col("n") > first).select(F.col("project").alias("_project"))
    rest = candidates.join(long, F.col("project").eqNullSafe(F.col("_project")), "left_semi")
    return round_robin(rest).filter(F.col("turn") > first).orderBy(F.desc("turn"), F.desc("project")).limit(n)


def apply_limit(plan: DataFrame, n: int, order: list[str], work: str = "generate") -> DataFrame:
    """``plan`` in which all but the first ``n`` rows of status ``work``, in the given order
    over all sources, are deferred for the limit. ``order`` must tell the rows apart."""
    first = plan.filter(F.col("status") == work).orderBy(*order).limit(n).select(*order, F.lit(True).alias("_first"))
    x = plan.join(first, order, "left")
    rest = (F.col("status") == work) & F.col("_first").isNull()
    return x.withColumn("reason", F.when(rest, "limit").otherwise(F.col("reason"))).withColumn("status", F.when(rest, "deferred").otherwise(F.col("status"))).drop("_first")
