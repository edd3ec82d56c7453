"""App-state files: projects, assignments of threads and threads without a project."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talespark.functions.text import event_epoch, strip
from talespark.sources.tables import written

# The members of an app-state file, the kind of projects that it holds itself, and the shape of their ids.
MEMBERS = ["local-projects", "thread-project-assignments", "projectless-thread-ids"]
LOCAL = "local"
SAFE_ID = r"\A[A-Za-z0-9][A-Za-z0-9._-]*\z"

PROJECT = "id string, name string, rootPaths array<string>, createdAt string, updatedAt string"
ASSIGNMENT = "projectKind string, projectId string, cwd string"


def _object(c: Column) -> Column:
    return F.when(F.startswith(strip(c), F.lit("{")), F.from_json(c, "map<string, string>"))


def app_state_tables(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(projects, assignments, projectless, faults) of app-state files (source, value: the
    whole text). Projects: source, project, name, roots, created_at, updated_at; assignments:
    source, thread, project_kind, project, cwd; projectless: source, thread; all but those
    with a fault. Faults: source, member, item, fault; a file that is no object, or lacks a
    member, has a null item and gives no rows of that member.

    Ids and names lose white space at their ends; an id must be a safe path part and, as it
    is, its key; a project needs a name, a root and a time of creation that can be read; an
    assignment needs kind and project, and a local one a sound project of its file. Numbers
    count as their text. Null texts are no objects. Repeated files give repeated rows.

    Files are split, and projects judged, once: both are written; projects in as many tasks as a shuffle has.
    """
    n = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    text = F.regexp_replace(F.coalesce("value", F.lit("")), r"\A\x{FEFF}", "")
    m = files.repartition(n, "source").select("source", _object(text).alias("m"))
    assigned, projects, free = F.col("m")[MEMBERS[1]], F.col("m")[MEMBERS[0]], F.coalesce(F.col("m")[MEMBERS[2]], F.lit("[]"))
    listed = F.when(F.startswith(strip(free), F.lit("[")), F.from_json(free, "array<string>"))
    plain = listed.isNotNull() & ~F.exists(listed, lambda x: x.isNull())
    shape = m.select("source", "m", _object(projects).alias("p"), _object(assigned).alias("a"), F.when(plain, listed).alias("f"))
    broken = F.array(F.when(F.col("m").isNull(), F.lit("file")), *(F.when(F.col("m").isNotNull() & F.col(c).isNull(), F.lit(k)) for c, k in zip("paf", MEMBERS)))
    shape = written(shape.select("source", "p", "a", "f", F.array_compact(broken).alias("broken")), "app-state")
    lacking = shape.select("source", F.explode("broken").alias("member")).select("source", "member", F.lit(None).cast("string").alias("item"), F.lit("shape").alias("fault"))

    p = shape.select("source", F.explode("p").alias("item", "v")).repartition(n, "source", "item").select("source", "item", _object(F.col("v")).isNotNull().alias("ok"), F.from_json("v", PROJECT).alias("v"))
    ident, name = strip(F.col("v.id")), strip(F.col("v.name"))
    made, changed = event_epoch(F.col("v.createdAt")), event_epoch(F.col("v.updatedAt"))
    fault = (
        F.when(~F.col("ok"), "shape").when(~F.coalesce(ident.rlike(SAFE_ID), F.lit(False)), "id").when(F.coalesce(name, F.lit("")) == "", "name")
        .when(F.coalesce(F.size("v.rootPaths"), F.lit(0)) < 1, "roots").when(made.isNull() | (F.col("v.updatedAt").isNotNull() & changed.isNull()), "time").when(ident != F.col("item"), "key")
    )
    p = p.select("source", "item", ident.alias("project"), name.alias("name"), F.col("v.rootPaths").alias("roots"), F.col("v.createdAt").alias("created_at"), F.col("v.updatedAt").alias("updated_at"), fault.alias("fault"))
    p = written(p, "app-projects")
    sound = p.filter("fault IS NULL").drop("item", "fault")

    a = shape.select("source", F.explode("a").alias("thread", "v")).select("source", "thread", _object(F.col("v")).isNotNull().alias("ok"), F.from_json("v", ASSIGNMENT).alias("v"))
    a = a.select("source", "thread", "ok", F.col("v.projectKind").alias("project_kind"), F.col("v.projectId").alias("project"), F.col("v.cwd").alias("cwd"))
    known = sound.select("source", "project", F.lit(True).alias("known")).distinct()
    fault = F.when(~F.col("ok") | F.col("project_kind").isNull() | F.col("project").isNull(), "shape").when((F.col("project_kind") == LOCAL) & F.col("known").isNull(), "unknown-project")
    a = a.join(known, ["source", "project"], "left").withColumn("fault", fault)
    free = shape.select("source", F.explode("f").alias("thread")).distinct()
    wrong = p.select("source", F.lit(MEMBERS[0]).alias("member"), "item", "fault").unionByName(a.select("source", F.lit(MEMBERS[1]).alias("member"), F.col("thread").alias("item"), "fault"))
    return sound, a.filter("fault IS NULL").select("source", "thread", "project_kind", "project", "cwd"), free, lacking.unionByName(wrong.filter("fault IS NOT NULL"))


def read_app_state(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """:func:`app_state_tables` of the files at a path; ``source`` is a file's own path."""
    files = spark.read.text(path, wholetext=True)
    return app_state_tables(files.select(F.col("_metadata.file_path").alias("source"), "value"))
