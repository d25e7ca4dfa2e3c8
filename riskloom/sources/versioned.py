"""Tables of parts, changed as a whole or not at all.

A table's rows lie in parts: the hash buckets of a key, or the values of a partition column. A change writes the parts
it touches into new folders and then commits by adding one small file, the next version, which
names the folder of every part. Readers follow the newest version, so they see all of a change or nothing of it,
and a change that fails before its commit leaves the table as it was. Two writers cannot commit the same version:
the later one fails and can start again. Folders of earlier versions stay until ``vacuum``, so readers of an
earlier version can finish.

The version file holds one entry per part, never anything per row. Streams note their last batch in it, in the same
commit, and a batch that is delivered again is skipped.

A stream's batch has keys of every bucket, and parts rewritten for each of them would be written as often as there are
batches. ``put`` lays a batch's rows on top of the parts instead, as a run. A few runs of a level are merged into one of the
next, and once the runs are as large as the parts both are rewritten, so what is written in all grows with the rows that
come, by the logarithm of their batches. Readers rank the rows of parts and runs by key, those of a table without runs nothing.
Its last two versions stay, and older folders go with each batch.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.common import latest_per
from ..session import discard, materialize, release

BUCKETS = 16
PART, RUN = "_part", "_run"
_VERSIONS, _DATA = "_versions", "data"
#: So many runs of a level become one of the next.
FAN = 8
#: Bytes of stored rows that are ranked and rewritten at a time; a table of more than SLICES times that in SLICES steps.
SLICE, SLICES = 64 << 20, 16


class ConflictError(RuntimeError):
    """Someone else committed the version that this change was to become."""


@dataclass(frozen=True)
class Version:
    """The state of a table: its number, schema, the folder of every part, the number of buckets, each stream's last batch, and
    marks that a job keeps with its data, such as the version of another table that it was made from. ``runs`` lie on the parts,
    the newest last, each with its level, its bytes and its own folder of every part; ``keys`` and ``order`` rank their rows."""

    number: int = 0
    schema: dict | None = None
    parts: dict[str, str] = field(default_factory=dict)
    buckets: int | None = None
    batches: dict[str, int] = field(default_factory=dict)
    marks: dict[str, int] = field(default_factory=dict)
    runs: list[dict] = field(default_factory=list)
    keys: list[str] = field(default_factory=list)
    order: list[str] = field(default_factory=list)

    def text(self) -> str:
        return json.dumps({k: v for k, v in asdict(self).items() if k != "number"})

    def folders(self) -> set[str]:
        """The folders of a change each that hold the version's rows."""
        return {f.split("/")[1] for parts in (self.parts, *(r["parts"] for r in self.runs)) for f in parts.values()}


def _files(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    root = hadoop.Path(path)
    return root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop.Path


def _names(spark: SparkSession, path: str) -> list[str]:
    files, at = _files(spark, path)
    return [s.getPath().getName() for s in files.listStatus(at(path))] if files.exists(at(path)) else []


def _numbers(spark: SparkSession, path: str) -> list[int]:
    names = _names(spark, f"{path}/{_VERSIONS}")
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("."))


def version(spark: SparkSession, path: str, number: int | None = None) -> Version:
    """The newest version of a table, or an earlier one; number 0 if there is none yet."""
    if number is None:
        number = max(_numbers(spark, path), default=0)
    if not number:
        return Version()
    files, at = _files(spark, path)
    stream = files.open(at(f"{path}/{_VERSIONS}/{number:012d}.json"))
    try:
        text = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return Version(number=number, **json.loads(text))


def _commit(spark: SparkSession, path: str, new: Version) -> None:
    """Put the version in place: written under another name first, then renamed, which is one step."""
    files, at = _files(spark, path)
    folder = f"{path}/{_VERSIONS}"
    files.mkdirs(at(folder))
    target, draft = at(f"{folder}/{new.number:012d}.json"), at(f"{folder}/.{uuid.uuid4().hex}")
    out = files.create(draft, True)
    try:
        out.write(bytearray(new.text(), "utf-8"))
    finally:
        out.close()
    if files.exists(target) or not files.rename(draft, target):
        files.delete(draft, False)
        raise ConflictError(f"version {new.number} of {path} exists")


def part_name(value: Column) -> Column:
    """A folder name for a value: the value as text, other characters than letters, digits, - . _ encoded; null has its own."""
    encoded = F.translate(F.url_encode(value.cast("string")), "%*+", "~!@")
    return F.when(value.isNull(), "null").otherwise(F.concat(F.lit("p"), encoded))


def bucket_name(keys: Sequence[str], buckets: int) -> Column:
    return part_name(F.pmod(F.xxhash64(*keys), F.lit(buckets)))


def read_version(spark: SparkSession, path: str, of: Version | None = None, parts: Sequence[str] | None = None) -> DataFrame | None:
    """The rows of a version, or of some of its parts; None if there is no table yet."""
    of = version(spark, path) if of is None else of
    if of.schema is None:
        return None
    own, above = _chosen([of.parts], parts), _chosen([r["parts"] for r in of.runs], parts)
    if above:
        return _ranked(spark, path, of, own + above).drop(RUN)
    schema = StructType.fromJson(of.schema)
    if not own:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{path}/{f}" for f in own])


def _chosen(held: Sequence[dict[str, str]], parts: Sequence[str] | None) -> list[str]:
    some = None if parts is None else set(parts)
    return [f for of in held for p, f in of.items() if some is None or p in some]


def _ranked(spark: SparkSession, path: str, of: Version, folders: Sequence[str]) -> DataFrame:
    """The last row per key of some folders; of equal ones that of the later run. Rows of parts have no run."""
    schema = StructType.fromJson(of.schema).add(RUN, "long")
    rows = spark.read.schema(schema).parquet(*[f"{path}/{f}" for f in folders])
    return latest_per(rows, of.keys, [*of.order, RUN])


def _size(spark: SparkSession, path: str, folders: Sequence[str]) -> int:
    files, at = _files(spark, path)
    return sum(files.getContentSummary(at(f"{path}/{f}")).getLength() for f in folders)


def _write(rows: DataFrame, path: str, number: int) -> dict[str, str]:
    """Write rows, which carry their part, for a version; returns the folder of every part that has some.

    Rows are rebalanced by part: a part goes to one task, and a large one to as many as its size asks for. Hashed ids and
    tokens are text of few different letters, which zstd halves and the default codec leaves as it is.
    """
    folder = f"{_DATA}/{number:012d}-{uuid.uuid4().hex}"
    rows.hint("rebalance", PART).write.option("compression", "zstd").partitionBy(PART).parquet(f"{path}/{folder}")
    written = [n for n in _names(rows.sparkSession, f"{path}/{folder}") if n.startswith(f"{PART}=")]
    return {n.removeprefix(f"{PART}="): f"{folder}/{n}" for n in written}


def replace_parts(
    rows: DataFrame,
    path: str,
    base: Version,
    touched: Sequence[str],
    buckets: int | None = None,
    batch: tuple[str, int] | None = None,
    marks: dict[str, int] | None = None,
) -> Version:
    """Commit ``rows``, which carry their part in ``PART``, as the whole new content of the ``touched`` parts.

    A touched part without rows is gone, and so is what runs hold of it.
    """
    written, gone = _write(rows, path, base.number + 1), set(touched)

    def left(parts: dict[str, str]) -> dict[str, str]:
        return {p: f for p, f in parts.items() if p not in gone}

    batches = dict(base.batches) | ({batch[0]: batch[1]} if batch else {})
    new = replace(
        base,
        number=base.number + 1,
        schema=rows.drop(PART).schema.jsonValue(),
        parts=left(base.parts) | written,
        buckets=buckets or base.buckets,
        batches=batches,
        marks=dict(base.marks) | (marks or {}),
        runs=[r | {"parts": rest} for r in base.runs if (rest := left(r["parts"]))],
    )
    _commit(rows.sparkSession, path, new)
    return new


def parts_of(rows: DataFrame) -> list[str]:
    """The parts that rows lie in: as many names as the table's layout has at most."""
    return sorted(r[0] for r in rows.select(PART).distinct().collect())


def upsert(
    spark: SparkSession,
    path: str,
    incoming: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    buckets: int = BUCKETS,
    batch: tuple[str, int] | None = None,
    removed: DataFrame | None = None,
) -> None:
    """Put the last row per key, by ``order``, into a table bucketed by key; equal orders go to the incoming row.

    Only the buckets of incoming keys are read and rewritten. ``removed`` has keys that go before the rows come.
    A ``batch`` (stream, number) that is not later than the stream's last one changes nothing. ``buckets`` applies
    to a new table; an existing one keeps its number.
    """
    base = version(spark, path)
    if batch and batch[1] <= base.batches.get(batch[0], -1):
        return
    count = base.buckets or buckets
    named = latest_per(incoming, keys, order).withColumn(PART, bucket_name(keys, count)).withColumn("_new", F.lit(1))
    used = [named := materialize(named, "upsert")]
    touched = parts_of(named)
    if removed is not None:
        removed = materialize(removed.select(*keys).distinct().withColumn(PART, bucket_name(keys, count)), "upsert-removed")
        used.append(removed)
        touched = sorted({*touched, *parts_of(removed)})
    current = read_version(spark, path, base, touched)
    if current is not None:
        if removed is not None:
            current = current.join(removed.select(*keys), list(keys), "left_anti")
        current = current.withColumn(PART, bucket_name(keys, count)).withColumn("_new", F.lit(0))
        named = latest_per(current.unionByName(named), keys, [*order, "_new"])
    if touched or base.number == 0 or batch:
        replace_parts(named.drop("_new"), path, base, touched, count, batch)
    for stored in used:
        discard(stored)


def put(
    spark: SparkSession,
    path: str,
    incoming: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    buckets: int = BUCKETS,
    batch: tuple[str, int] | None = None,
    keep: int = 2,
) -> None:
    """``upsert`` for many small changes of all buckets: the rows are written as a run, and the parts stay as they are until the
    runs on them are as large.

    The last ``keep`` versions can be read; folders that only earlier ones name are deleted.
    """
    base, ranking = version(spark, path), {"keys": list(keys), "order": list(order)}
    if batch and batch[1] <= base.batches.get(batch[0], -1):
        return
    alike = base.schema is not None and StructType.fromJson(base.schema).simpleString() == incoming.schema.simpleString()
    if not (alike and base.buckets) or base.runs and ranking != {"keys": base.keys, "order": base.order}:
        upsert(spark, path, incoming, keys, order, buckets, batch)
        _drop(spark, path, keep)
        return
    new = replace(base, number=base.number + 1, batches=dict(base.batches) | ({batch[0]: batch[1]} if batch else {}), **ranking)
    last = latest_per(incoming, keys, order).withColumn(RUN, F.lit(new.number).cast("long"))
    written, made = _write(last.withColumn(PART, bucket_name(keys, base.buckets)), path, new.number), set()
    if written:
        size = _size(spark, path, list(written.values()))
        new = replace(new, runs=[*base.runs, {"level": 0, "size": size, "parts": written}])
        made |= new.folders()
        if sum(r["size"] for r in new.runs) >= _size(spark, path, list(base.parts.values())):
            new = _folded(spark, path, new)
        while len(level := new.runs[-FAN:]) == FAN and len({r["level"] for r in level}) == 1:
            new = replace(new, runs=[*new.runs[:-FAN], _merged(spark, path, new, level)])
            made |= new.folders()
    if written or batch:
        _commit(spark, path, new)
        _drop(spark, path, keep, made)


def fold(spark: SparkSession, path: str, keep: int = 2) -> None:
    """Rewrite the parts that have runs on them, so that readers rank nothing: for the end of a stream, or before many reads."""
    base = version(spark, path)
    if base.runs:
        _commit(spark, path, _folded(spark, path, replace(base, number=base.number + 1)))
        _drop(spark, path, keep)


def _sliced(spark: SparkSession, path: str, of: Version, held: Sequence[dict[str, str]], of_runs: bool) -> dict[str, str]:
    """New folders of all parts that ``held`` names, with their last row per key; some parts at a time, so that the shuffle
    files of a slice are gone before the next one."""
    names, parts = sorted({p for parts in held for p in parts}), {}
    steps = min(len(names), SLICES, math.ceil(_size(spark, path, _chosen(held, names)) / SLICE)) or 1
    for k in range(steps):
        rows = _ranked(spark, path, of, _chosen(held, names[k::steps]))
        rows = (rows if of_runs else rows.drop(RUN)).withColumn(PART, bucket_name(of.keys, of.buckets))
        parts |= _write(rows, path, of.number)
        del rows
        release(spark)
    return parts


def _merged(spark: SparkSession, path: str, of: Version, runs: Sequence[dict]) -> dict:
    parts = _sliced(spark, path, of, [r["parts"] for r in runs], True)
    return {"level": runs[0]["level"] + 1, "size": _size(spark, path, list(parts.values())), "parts": parts}


def _folded(spark: SparkSession, path: str, of: Version) -> Version:
    above = [r["parts"] for r in of.runs]
    touched = {p for parts in above for p in parts}
    under = {p: f for p, f in of.parts.items() if p in touched}
    return replace(of, parts=of.parts | _sliced(spark, path, of, [under, *above], False), runs=[])


def _drop(spark: SparkSession, path: str, keep: int, made: set[str] = frozenset()) -> None:
    """Delete the folders that the version before the last ``keep`` names and none of these, and what was made on the way to the
    newest. Others are left alone: a writer that has not committed yet keeps its own. Version files stay, so a late writer still
    meets the one that it wanted to write."""
    files, at = _files(spark, path)
    numbers = _numbers(spark, path)
    used = {f for n in numbers[-keep:] for f in version(spark, path, n).folders()}
    for name in {f for n in numbers[:-keep][-1:] for f in version(spark, path, n).folders()}.union(made) - used:
        files.delete(at(f"{path}/{_DATA}/{name}"), True)


def rebucket(spark: SparkSession, path: str, target: str, keys: Sequence[str], buckets: int) -> None:
    """The current rows as a new table with another number of buckets."""
    base = version(spark, path)
    rows = read_version(spark, path, base)
    if rows is not None:
        named = rows.withColumn(PART, bucket_name(keys, buckets))
        new = Version(batches=base.batches)
        replace_parts(named, target, new, [], buckets)


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Delete what none of the last ``keep`` versions names; returns the number of folders and files that went.

    Writers that have not committed yet lose their new folders, so run it when none is at work.
    """
    files, at = _files(spark, path)
    numbers = _numbers(spark, path)
    kept = [version(spark, path, n) for n in numbers[-keep:]]
    used = {f for v in kept for f in v.folders()}
    gone = [f"{path}/{_DATA}/{n}" for n in _names(spark, f"{path}/{_DATA}") if n not in used]
    gone += [f"{path}/{_VERSIONS}/{n:012d}.json" for n in numbers[:-keep]]
    for name in gone:
        files.delete(at(name), True)
    return len(gone)
