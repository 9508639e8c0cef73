"""Tables that are committed together: a commit's rows appear in all of them at once, or in none.

A commit writes its rows to folders of its own, which no reader looks at, and then publishes a manifest that names them,
under the next free number. Readers resolve the manifests once and see all tables as of the same commit. A writer that is
killed leaves folders that no manifest names, which sweep() removes. Rows lie in a bounded number of folders by a hash of
their key, so that a reader of few keys reads few folders, and there are no more of them however many keys there are.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pagetide.plans.storage import exists, file_system, removed, renamed

BUCKETS = 64
#: Times that a commit starts again because others have taken its number.
TRIES = 20


def bucket_of(key: str | Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64((F.col(key) if isinstance(key, str) else key).cast("long")), F.lit(buckets)).cast("int")


def in_buckets(rows: DataFrame, key: str, buckets: int = BUCKETS) -> DataFrame:
    """rows with their bucket, dealt so that each task writes to few of the folders and a bucket is written by several tasks if there are more than buckets."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = F.pmod(F.xxhash64(F.col(key).cast("long"), F.lit("part")), F.lit(-(-n // buckets)))
    return rows.withColumn("bucket", bucket_of(key, buckets)).repartition(n, "bucket", part)


def near(rows: DataFrame, key: str, keys: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Of rows, read from folders by bucket, those of the buckets that keys (a column named key) lie in: a condition on folders, so others aren't read. At most buckets numbers come to the driver."""
    own = sorted(r[0] for r in keys.select(bucket_of(key, buckets).alias("b")).distinct().collect())
    return rows.where(F.col("bucket").isin(own))


class Conflict(Exception):
    """Others have committed meanwhile what this commit would add."""


class View:
    """A store's tables as of one commit."""

    def __init__(self, store: Store, manifests: list[dict]):
        self.store, self.manifests = store, manifests
        self.version = manifests[-1]["version"] if manifests else 0
        self.ids = {i for m in manifests for i in m["ids"]}

    def table(self, name: str, keys: DataFrame | None = None) -> DataFrame | None:
        """All rows of a table, or those whose key is among keys (a column of the key's name); None where no commit has written any."""
        own = [m["tables"][name] for m in self.manifests if name in m["tables"]]
        if not own:
            return None
        key, top = self.store.keys[name], f"{self.store.root}/{name}"
        schema = StructType.fromJson(own[-1]["schema"]).add("commit", "string").add("bucket", "integer")
        rows = self.store.spark.read.schema(schema).option("basePath", top).parquet(*(f"{top}/commit={t['folder']}" for t in own))
        if keys is not None:
            rows = near(rows, key, keys, self.store.buckets).join(keys.select(key).distinct(), key, "left_semi")
        return rows.drop("commit", "bucket")


class Store:
    def __init__(self, spark: SparkSession, root: str, keys: dict[str, str], buckets: int = BUCKETS):
        """keys: by table, the column of whole numbers whose hash says in which folder a row lies."""
        self.spark, self.root, self.keys, self.buckets = spark, root.rstrip("/"), keys, buckets

    def view(self) -> View:
        folder = f"{self.root}/_commits"
        if not exists(self.spark, folder):
            return View(self, [])
        found = sorted((json.loads(r[0]) for r in self.spark.read.option("wholetext", True).text(folder).collect()), key=lambda m: m["version"])
        whole = max((i for i, m in enumerate(found) if m["whole"]), default=0)
        return View(self, found[whole:])

    def commit(self, id: str, make: Callable[[View], dict[str, DataFrame]], check: Callable[[dict[str, DataFrame]], None] | None = None, whole: bool = False) -> int:
        """Adds the tables that make() gives, given the view that they are to be added to, and returns the commit's number.

        An id that is committed already adds nothing. check() sees the rows as they are written; if it raises, nothing is
        published. If others have committed meanwhile, all is made anew from what they have left: so rows that depend on
        what is stored are right whoever comes first. whole: the tables take the place of all that was committed before.
        """
        for _ in range(TRIES):
            base = self.view()
            if id in base.ids:
                return base.version
            folder = uuid.uuid4().hex
            staged = {name: f"{self.root}/{name}/commit={folder}" for name in self.keys}
            try:
                tables = make(base)
                for name, rows in tables.items():
                    in_buckets(rows, self.keys[name], self.buckets).write.partitionBy("bucket").parquet(staged[name])
                if check:
                    check({name: self.spark.read.schema(rows.schema).parquet(staged[name]) for name, rows in tables.items()})
                told = {name: {"folder": folder, "schema": rows.schema.jsonValue()} for name, rows in tables.items()}
                ids = sorted(base.ids | {id}) if whole else [id]
                self._publish({"version": base.version + 1, "ids": ids, "whole": whole, "tables": told})
                return base.version + 1
            except BaseException as e:
                for path in staged.values():
                    removed(self.spark, path)
                if not isinstance(e, FileExistsError):
                    raise
        raise Conflict(f"{TRIES} times others were first")

    def _publish(self, manifest: dict) -> None:
        """The manifest under its number, or FileExistsError if another one has it. It is written under a name that readers pass over, then renamed."""
        folder = f"{self.root}/_commits"
        draft = f"{folder}/.{uuid.uuid4().hex}"
        fs, at = file_system(self.spark, draft)
        out = fs.create(at, False)
        try:
            out.write(json.dumps(manifest).encode())
        finally:
            out.close()
        try:
            renamed(self.spark, draft, f"{folder}/{manifest['version']:020d}.json")
        except BaseException:
            removed(self.spark, draft)
            raise

    def compact(self) -> int:
        """All rows as one commit, which readers start from."""

        def all_of(base: View) -> dict[str, DataFrame]:
            tables = {name: base.table(name) for name in self.keys}
            return {name: rows for name, rows in tables.items() if rows is not None}

        return self.commit(f"compact {uuid.uuid4().hex}", all_of, whole=True)

    def sweep(self, hours: float = 24) -> int:
        """Removes folders that no reader's view names and that were last written to so long ago: leftovers of killed writers and what compact() has replaced. Longer than any reader or writer takes."""
        view, n = self.view(), 0
        named = {t["folder"] for m in view.manifests for t in m["tables"].values()}
        before = (time.time() - 3600 * hours) * 1000
        first = view.manifests[0]["version"] if view.manifests else 0
        for name in [*self.keys, "_commits"]:
            fs, at = file_system(self.spark, f"{self.root}/{name}")
            for f in fs.listStatus(at) if fs.exists(at) else []:
                own = f.getPath().getName()
                stale = own.removeprefix("commit=") not in named if name != "_commits" else own.startswith(".") or int(own.split(".")[0]) < first
                if stale and f.getModificationTime() <= before:
                    n += bool(fs.delete(f.getPath(), True))
        return n
