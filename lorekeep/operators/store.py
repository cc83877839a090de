"""A store of append-only relations: checked first, all of a batch or none, published last.

A batch's relations are written to folders of their own, whose names nobody else has; one file in
the table of commits, named by the commit's number and created only if it isn't there, makes them
visible together. So two writers can't take one number: the later one reads the commits again and
takes the next. A job that dies leaves nothing that a reader sees. Parquet files are never changed;
a delete names the folders that it takes back and those that stand in their place.

Readers get the rows of the committed folders as of any commit, each with the number of the commit
that brought it (seq). The creation of a commit relies on a file system whose rename or link does
not replace a file.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping, Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scratch

COMMITS, PINS = "_commits", "_pins"
_FOLDER = "struct<relation:string,folder:string,seq:bigint>"
_COMMIT = f"seq long, batch string, adds array<{_FOLDER}>, drops array<{_FOLDER}>"
#: Commits that one writer loses to others before it gives up.
TRIES = 20


def sortable_id(prefix: Column, *parts: Column, at: Column | None = None) -> Column:
    """prefix_, the time `at` in base 32 (ten digits, so that ids sort by it; zeros without one), 16 digits of the parts' hash.

    The same parts give the same id, so a batch that is run again makes no second row.
    """
    millis = F.lit("0") if at is None else F.unix_millis(at).cast("string")
    return F.concat(prefix, F.lit("_"), F.lower(F.lpad(F.conv(millis, 10, 32), 10, "0")), F.substring(F.sha2(F.concat_ws("\x1f", *parts), 256), 1, 16))


class Refused(ValueError):
    """Rows that the checks refuse; nothing of their batch was written."""


class Conflict(RuntimeError):
    """Another batch was committed after what this one was made from."""


# -- files ---------------------------------------------------------------------


def _at(spark: SparkSession, path: str):
    """(file system, path) of Hadoop's."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _at(spark, path)
    return fs.exists(where)


def remove(spark: SparkSession, path: str) -> None:
    fs, where = _at(spark, path)
    fs.delete(where, True)


def create(spark: SparkSession, folder: str, name: str, value: Mapping) -> bool:
    """Create a file of one JSON line, whole or not at all; False if the name is taken."""
    fs, where = _at(spark, folder)
    fs.mkdirs(where)
    path = spark._jvm.org.apache.hadoop.fs.Path
    draft, target = path(where, f".{uuid.uuid4().hex}"), path(where, name)
    out = fs.create(draft, False)
    out.write(bytearray(json.dumps(value, ensure_ascii=False) + "\n", "utf-8"))
    out.close()
    if fs.getUri().getScheme() != "file":
        made = fs.rename(draft, target)
    else:  # here a rename would replace the file, a link doesn't
        file = spark._jvm.java.io.File
        try:
            spark._jvm.java.nio.file.Files.createLink(file(target.toUri().getPath()).toPath(), file(draft.toUri().getPath()).toPath())
            made = True
        except Py4JJavaError as problem:
            if "FileAlreadyExists" not in str(problem.java_exception):
                raise
            made = False
    fs.delete(draft, False)
    return made


# -- commits -------------------------------------------------------------------


def commits(spark: SparkSession, root: str) -> DataFrame:
    """(seq, batch, adds, drops) of every commit."""
    if not exists(spark, f"{root}/{COMMITS}"):
        return spark.createDataFrame([], _COMMIT)
    return spark.read.schema(_COMMIT).json(f"{root}/{COMMITS}")


def last(spark: SparkSession, root: str) -> int:
    """The number of the last commit, 0 without one; told by the names of the commits, so it takes no job."""
    fs, where = _at(spark, f"{root}/{COMMITS}")
    names = [f.getPath().getName() for f in fs.listStatus(where)] if fs.exists(where) else []
    return max((int(n.removesuffix(".json")) for n in names if n[:1].isdigit()), default=0)


def _has(spark: SparkSession, root: str, batch: str) -> bool:
    return bool(commits(spark, root).filter(F.col("batch") == batch).limit(1).count())


def _commit(spark: SparkSession, root: str, batch: str, entry: Callable[[int], Mapping], since: int | None) -> bool:
    """Take the next free number for a batch; False if another writer committed the batch meanwhile."""
    for _ in range(TRIES):
        seq = last(spark, root)
        if since is not None and seq != since:
            raise Conflict(f"{batch}: made from commit {since}, but {seq} is committed")
        if _has(spark, root, batch):
            return False
        if create(spark, f"{root}/{COMMITS}", f"{seq + 1:020d}.json", {"seq": seq + 1, "batch": batch, **entry(seq + 1)}):
            return True
    raise Conflict(f"{batch}: {TRIES} other commits came first")


def append(spark: SparkSession, root: str, batch: str, relations: Mapping[str, DataFrame], checks: Mapping[str, Column] | None = None, since: int | None = None, partition: Mapping[str, Sequence[str]] | None = None) -> bool:
    """Write relations as one batch; False if a batch of that name is committed already.

    checks: for a relation, an ARRAY<STRING> Column of the reasons to refuse a row. One refused
    row anywhere refuses the batch before anything is written. since: the commit that the rows were
    made from; a later one is a Conflict. partition: columns by which a relation's files are parted.
    """
    if _has(spark, root, batch):
        return False
    for name, reasons in (checks or {}).items():
        bad = relations[name].select(reasons.alias("r")).filter(F.size("r") > 0).agg(F.count("*").alias("n"), F.first(F.get("r", 0)).alias("why")).first()
        if bad["n"]:
            raise Refused(f"{name}: {bad['n']} rows refused, first because {bad['why']}")
    folder = uuid.uuid4().hex
    for name, rows in relations.items():
        writer = rows.write.partitionBy(*partition[name]) if partition and name in partition else rows.write
        with scratch.released(spark):
            writer.parquet(f"{root}/{name}/batch={folder}")
    done = _commit(spark, root, batch, lambda seq: {"adds": [{"relation": n, "folder": folder, "seq": seq} for n in relations], "drops": []}, since)
    if not done:
        for name in relations:
            remove(spark, f"{root}/{name}/batch={folder}")
    return done


def _folders(spark: SparkSession, root: str, relation: str, upto: int | None, since: int = 0) -> DataFrame:
    """(folder, of_seq) that a reader sees."""
    known = commits(spark, root)
    known = known if upto is None else known.filter(F.col("seq") <= upto)
    of = lambda c: known.select(F.explode(c).alias("x")).select("x.*").filter(F.col("relation") == relation)
    gone = of("drops").select(F.col("folder").alias("gone"))
    adds = of("adds").filter(F.col("seq") > since).select("folder", F.col("seq").alias("of_seq"))
    return adds.join(gone, F.col("folder") == F.col("gone"), "left_anti")


def read(spark: SparkSession, root: str, relation: str, schema: str, upto: int | None = None, since: int = 0, with_batch: bool = False) -> DataFrame:
    """The committed rows of a relation up to a commit, and seq: the number of the commit that brought them.

    The relation is one scan; its partitions meet the table of commits by a join on their name. No
    column may be called batch.
    """
    extra = ["batch"] if with_batch else []
    if not exists(spark, f"{root}/{relation}"):
        return spark.createDataFrame([], ", ".join([schema, "seq long", *(f"{c} string" for c in extra)]))
    rows = spark.read.schema(f"{schema}, batch string").parquet(f"{root}/{relation}")
    names = [c for c in rows.columns if c != "batch"]
    seen = rows.join(_folders(spark, root, relation, upto, since), F.col("batch") == F.col("folder"))
    return seen.select(*[F.col(f"`{c}`") for c in names], F.col("of_seq").alias("seq"), *extra)


def delete(spark: SparkSession, root: str, batch: str, ids: DataFrame, schemas: Mapping[str, str], keys: Mapping[str, str], pointers: Mapping[str, str] | None = None) -> bool:
    """Take the rows of ids (id) out of several relations at once, as one batch; False if it is committed already.

    keys: of each relation that loses rows, the column that holds the id. Only the folders that
    hold such a row are written again, without it and under the number they had; vacuum() then
    removes the old ones. pointers: relations with a column that names rows; a row that stays and
    points to one that goes is Refused.
    """
    if _has(spark, root, batch):
        return False
    at = last(spark, root)
    doomed = ids.select(F.col("id").alias("doomed")).distinct()
    for relation, column in (pointers or {}).items():
        rows = read(spark, root, relation, schemas[relation], at)
        staying = rows.join(doomed, F.col(keys[relation]) == F.col("doomed"), "left_anti") if relation in keys else rows
        held = staying.join(doomed, F.col(column) == F.col("doomed")).select(column).limit(1).collect()
        if held:
            raise Refused(f"{relation}: a row that stays points to {held[0][0]} by {column}")
    mark, adds, drops = uuid.uuid4().hex, [], []
    for relation, key in keys.items():
        rows = read(spark, root, relation, schemas[relation], at, with_batch=True)
        touched = rows.join(doomed, F.col(key) == F.col("doomed"), "left_semi").select(F.col("batch").alias("touched"), F.col("seq").alias("was")).distinct()
        found = [(r["touched"], r["was"]) for r in touched.collect()]  # folders, not rows: one a batch at most
        if not found:
            continue
        left = rows.filter(F.col("batch").isin([f for f, _ in found])).join(doomed, F.col(key) == F.col("doomed"), "left_anti")
        left.drop("seq").withColumn("batch", F.concat("batch", F.lit(f"-{mark}"))).write.mode("append").partitionBy("batch").parquet(f"{root}/{relation}")
        adds += [{"relation": relation, "folder": f"{f}-{mark}", "seq": was} for f, was in found]
        drops += [{"relation": relation, "folder": f, "seq": was} for f, was in found]
    return _commit(spark, root, batch, lambda _: {"adds": adds, "drops": drops}, since=at)


def vacuum(spark: SparkSession, root: str) -> int:
    """Remove the folders that a later commit has taken back; reads as of earlier commits end. Gives how many."""
    gone = [(r["relation"], r["folder"]) for r in commits(spark, root).select(F.explode("drops").alias("x")).select("x.relation", "x.folder").distinct().collect()]
    for relation, folder in gone:
        remove(spark, f"{root}/{relation}/batch={folder}")
    return len(gone)


def pin(spark: SparkSession, root: str, name: str, upto: int | None = None) -> int:
    """A named snapshot: the commit up to which it reads, the last one by default. A name is given once."""
    seq = last(spark, root) if upto is None else upto
    if not create(spark, f"{root}/{PINS}", f"{name}.json", {"name": name, "seq": seq}):
        raise Refused(f"snapshot {name} exists")
    return seq


def pinned(spark: SparkSession, root: str, name: str) -> int:
    """The commit of a named snapshot, for read(upto=...)."""
    found = spark.read.schema("name string, seq long").json(f"{root}/{PINS}").filter(F.col("name") == name) if exists(spark, f"{root}/{PINS}") else spark.createDataFrame([], "name string, seq long")
    return required(found, f"snapshot {name}").first()["seq"]


def snapshot(spark: SparkSession, root: str, target: str, schemas: Mapping[str, str], upto: int | None = None) -> int:
    """A consistent copy in another store, as of a commit; gives its number.

    Each call adds, as one batch, what was committed since the copy's last one, so it can be
    repeated. After a delete the copy must be begun anew: a folder of the copy's that the delete
    took back is Refused.
    """
    seq = last(spark, root) if upto is None else upto
    name = "snapshot-{:020d}".format
    held = commits(spark, target).filter(F.col("batch").startswith("snapshot-")).agg(F.max(F.substring("batch", 10, 20).cast("long")).alias("s")).first()["s"] or 0
    if seq > held:
        back = commits(spark, root).filter((F.col("seq") > held) & (F.col("seq") <= seq)).select(F.explode("drops").alias("x")).filter(F.col("x.seq") <= held)
        if held and back.limit(1).count():
            raise Refused("rows of the copy were deleted since; copy to a new folder")
        append(spark, target, name(seq), {n: read(spark, root, n, schema, seq, held).drop("seq") for n, schema in schemas.items()})
    return seq


# -- rows ----------------------------------------------------------------------


def superseded(rows: DataFrame, successors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(changes, new rows) of successors (their own id, supersedes and the columns of rows).

    changes (id, status, superseded_by) close the old rows in the log of changes; a successor of a
    row that doesn't exist gives neither. Of several successors of one row the least id closes it.
    """
    known = rows.select(F.col("id").cast("string").alias("supersedes")).distinct()
    good = successors.join(known, "supersedes", "left_semi")
    changes = good.groupBy(F.col("supersedes").alias("id")).agg(F.min("id").alias("superseded_by")).select("id", F.lit("superseded").alias("status"), "superseded_by")
    return changes, good.withColumn("source", F.to_json(F.struct("supersedes"))).select(*[c for c in rows.columns if c in good.columns], "source")


def meta(log: DataFrame, key: str | None = None) -> DataFrame:
    """(key, value): what was last written of each key, or of one, in a log (seq, key, value)."""
    wanted = log if key is None else log.filter(F.col("key") == key)
    return wanted.groupBy("key").agg(F.max_by("value", "seq").alias("value"))


def required(rows: DataFrame, what: str) -> DataFrame:
    """rows, of which there must be one at least."""
    if not rows.limit(1).count():
        raise LookupError(f"{what} does not exist")
    return rows


def with_defaults(rows: DataFrame, defaults: Mapping[str, Callable[[], Column]]) -> DataFrame:
    """rows with columns added where they are missing and filled where they are null."""
    return rows.withColumns({c: F.coalesce(F.col(c), make()) if c in rows.columns else make() for c, make in defaults.items()})
