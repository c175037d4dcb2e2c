"""Tables that change together: data folders, and one snapshot that names what is valid.

A commit writes its tables to fresh folders and then publishes one small snapshot file, by a
rename that fails if another commit took the number first. Readers see the snapshot with the
highest number, so they see all tables of a commit or none, whatever fails in between. Batch
ids of commits are kept: a batch that is committed already is not applied again.

A table can be stored in buckets by a hash of its key. A merge then reads and rewrites only the
buckets that the incoming keys fall into; all other buckets' files stay as they are.
"""

import json
import uuid
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from leadmill.sources.files import remove_folder

_NAME = "snapshot-%012d.json"
_BUCKET = "bucket"


class Conflict(Exception):
    """Another commit was published since the snapshot that this one is based on."""


@dataclass(frozen=True)
class Buckets:
    """A table's key and number of buckets; it should make a bucket a few hundred MB at most."""

    key: str
    count: int = 256

    def of(self, df: DataFrame) -> Column:
        """Rows without a key are spread by all their columns: they match nothing."""
        h = F.when(F.col(self.key).isNotNull(), F.xxhash64(self.key)).otherwise(
            F.xxhash64(*[c for c, t in df.dtypes if "map<" not in t])
        )
        return F.pmod(h, F.lit(self.count)).cast("int")


@dataclass(frozen=True)
class Snapshot:
    """Valid folders: of a plain table a list, of a bucketed one a list per bucket."""

    number: int = 0
    tables: dict[str, list[str] | dict[str, list[str]]] = field(default_factory=dict)
    batches: list[str] = field(default_factory=list)


class TableStore:
    """Tables under a root folder; `buckets` says which are stored in buckets, and how."""

    def __init__(self, spark: SparkSession, root: str, buckets: Mapping[str, Buckets] | None = None):
        self.spark, self.root = spark, root.rstrip("/")
        self.buckets = dict(buckets or {})
        jvm = spark._jvm.org.apache.hadoop.fs
        self._path = jvm.Path
        self._fs = jvm.Path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    # --- reading

    def snapshot(self) -> Snapshot:
        at = self._path(f"{self.root}/snapshots")
        if not self._fs.exists(at):
            return Snapshot()
        names = [s.getPath().getName() for s in self._fs.listStatus(at)]
        names = [n for n in names if n.startswith("snapshot-")]
        if not names:
            return Snapshot()
        text = "\n".join(
            r.value for r in self.spark.read.text(f"{self.root}/snapshots/{max(names)}").collect()
        )
        return Snapshot(**json.loads(text))

    def read(
        self, name: str, schema: StructType, within: Snapshot | None = None,
        only: Iterable[int] | None = None,
    ) -> DataFrame:
        """A table of the newest (or a given) snapshot; of a bucketed one, `only` some buckets."""
        folders = (within or self.snapshot()).tables.get(name, [])
        if isinstance(folders, dict):
            wanted = folders if only is None else [str(b) for b in only if str(b) in folders]
            folders = [f for b in wanted for f in folders[b]]
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{f}" for f in folders])

    # --- writing

    def commit(
        self,
        batch: str,
        replace: Mapping[str, DataFrame] | None = None,
        append: Mapping[str, DataFrame] | None = None,
        merge: Mapping[str, "Merge"] | None = None,
        base: Snapshot | None = None,
    ) -> bool:
        """Publish all changes at once; False, and nothing is done, if the batch was before.

        `base` is the snapshot that the changes were computed from. If another one has been
        published since, Conflict is raised and nothing is valid that was written.
        """
        now = base or self.snapshot()
        if batch in self.snapshot().batches:
            return False
        folder = f"data/{uuid.uuid4().hex}"
        tables = dict(now.tables)
        for name, df in (replace or {}).items():
            tables[name] = self._write(df, name, folder)
        for name, df in (append or {}).items():
            tables[name] = _joined(tables.get(name, []), self._write(df, name, folder))
        for name, change in (merge or {}).items():
            how = self.buckets[name]
            keyed = change.incoming.withColumn(_BUCKET, how.of(change.incoming))
            touched = sorted(r[0] for r in keyed.select(_BUCKET).distinct().collect())
            old = self.read(name, change.schema, now, touched)
            # A bucket that ends up empty has no folder any more.
            kept = {b: f for b, f in dict(tables.get(name) or {}).items() if int(b) not in set(touched)}
            tables[name] = kept | self._write(change.merged(old, change.incoming), name, folder)
        self._publish(Snapshot(now.number + 1, tables, [*now.batches, batch]))
        return True

    def _write(self, df: DataFrame, name: str, folder: str) -> list[str] | dict[str, list[str]]:
        path = f"{folder}/{name}"
        how = self.buckets.get(name)
        if how is None:
            df.write.parquet(f"{self.root}/{path}")
            return [path]
        df.withColumn(_BUCKET, how.of(df)).repartition(how.count, _BUCKET).write.partitionBy(
            _BUCKET
        ).parquet(f"{self.root}/{path}")
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.root}/{path}"))]
        return {n.split("=")[1]: [f"{path}/{n}"] for n in names if n.startswith(f"{_BUCKET}=")}

    def _publish(self, snapshot: Snapshot) -> None:
        name = _NAME % snapshot.number
        draft = self._path(f"{self.root}/snapshots/.draft-{uuid.uuid4().hex}")
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps(snapshot.__dict__).encode()))
        out.close()
        jvm = self.spark._jvm.org.apache.hadoop.fs
        context = jvm.FileContext.getFileContext(
            draft.toUri() if draft.toUri().getScheme() else self._fs.getUri(),
            self.spark._jsc.hadoopConfiguration(),
        )
        none = self.spark.sparkContext._gateway.new_array(jvm.Options.Rename, 0)
        try:
            context.rename(draft, self._path(f"{self.root}/snapshots/{name}"), none)
        except Py4JJavaError as e:
            self._fs.delete(draft, False)
            if "FileAlreadyExists" in str(e.java_exception):
                raise Conflict(f"snapshot {snapshot.number} was published by another commit") from e
            raise

    def vacuum(self) -> list[str]:
        """Remove data folders that the newest snapshot doesn't name, and older snapshots.

        Not while a commit is under way or an older snapshot is being read.
        """
        now = self.snapshot()
        used = {
            f.split("/")[1]
            for folders in now.tables.values()
            for part in (folders.values() if isinstance(folders, dict) else [folders])
            for f in part
        }
        gone = []
        at = self._path(f"{self.root}/data")
        for status in self._fs.listStatus(at) if self._fs.exists(at) else []:
            if status.getPath().getName() not in used:
                gone.append(status.getPath().getName())
                remove_folder(self.spark, status.getPath().toString())
        for status in self._fs.listStatus(self._path(f"{self.root}/snapshots")):
            if status.getPath().getName() != _NAME % now.number:
                self._fs.delete(status.getPath(), False)
        return gone


@dataclass(frozen=True)
class Merge:
    """Rows of a table's schema or with its key, and the table after them: merged(old, incoming).

    `merged` gets the buckets that incoming keys fall into and gives what they hold afterwards.
    """

    incoming: DataFrame
    schema: StructType
    merged: Callable[[DataFrame, DataFrame], DataFrame]


def _joined(old, new):
    if isinstance(new, dict):
        old = dict(old or {})
        return old | {b: [*old.get(b, []), *f] for b, f in new.items()}
    return [*old, *new]
