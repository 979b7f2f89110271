"""Stored tables laid out by key, of which a change rewrites only the buckets that get rows.

    data/<change>/_b=<bucket>/...      Parquet, never changed once written
    versions/<number>.json             which folder each bucket is in, by now

A row's bucket is the crc32 of its key. A change writes new folders for its buckets, and then one small file that names them and, for all
other buckets, the folders they were in. That file is the change: until it is there, readers see the version before, and what a broken-off
change has written is garbage that `swept` deletes. Its number may be taken once only, so of two writers one finds it taken, reads what
the other made and lays its rows over that. A version that cannot be read yet is waited for; one whose writer died while writing it
counts for nothing after WAIT seconds. A version names the one it was made of, so a writer that was given up finds out, and tries again.

A null key is a key like any other. Columns that a change brings are null in older rows; rows of a change without a column are null there.
"""

from __future__ import annotations

import json
import time
import uuid
import zlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: How often a writer that finds its number taken tries again.
TRIES, WAIT = 20, 10.0

#: (stored rows of some keys, new rows) to the rows that replace them.
Merge = Callable[[DataFrame, DataFrame], DataFrame]


class Conflict(RuntimeError):
    pass


class Keyed:
    def __init__(self, spark: SparkSession, path: str, key: str = "id", buckets: int = 64):
        """buckets counts for a table that does not exist yet; a stored one keeps its own."""
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets
        self.jvm = spark.sparkContext._jvm
        self.fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def numbers(self) -> list[int]:
        """The numbers taken, whether or not their versions can be read."""
        folder = self._path("versions")
        return sorted(int(f.getPath().getName().split(".")[0]) for f in self.fs.listStatus(folder)) if self.fs.exists(folder) else []

    def _read(self, number: int) -> dict | None:
        stream = self.fs.open(self._path(f"versions/{number:08d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        except ValueError:
            return None
        finally:
            stream.close()

    def version(self) -> tuple[int, dict] | None:
        """(number, version) of the last one that can be read."""
        for number in reversed(self.numbers()):
            if found := self._read(number):
                return number, found
        return None

    def settled(self) -> tuple[int, dict] | None:
        """`version`, once no later number is still being written."""
        until = time.monotonic() + WAIT
        while True:
            found, numbers = self.version(), self.numbers()
            if not numbers or (found and found[0] == numbers[-1]) or time.monotonic() > until:
                return found
            time.sleep(0.1)

    def _leads_to(self, number: int) -> bool:
        """Whether the last version was made of this one."""
        at, version = self.version() or (0, {})
        while at > number:
            at, version = version["base"], self._read(version["base"]) or {"base": 0}
        return at == number

    def exists(self) -> bool:
        return self.version() is not None

    def bucket(self, many: int) -> Column:
        return (F.crc32(F.coalesce(F.col(self.key).cast("string"), F.lit(""))) % many).cast("int")

    def _folders(self, version: dict, buckets: list[int]) -> DataFrame:
        schema = T.StructType.fromJson(version["schema"])
        paths = [f"{self.path}/{version['folders'][str(b)]}" for b in buckets if str(b) in version["folders"]]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def rows(self, keys: list | None = None) -> DataFrame:
        """The table, or the rows of some keys, for which only their buckets are read."""
        found = self.version()
        if found is None:
            raise FileNotFoundError(self.path)
        version = found[1]
        if keys is None:
            return self._folders(version, range(version["buckets"]))
        mine = sorted({zlib.crc32(("" if k is None else str(k)).encode()) % version["buckets"] for k in keys})
        wanted = F.col(self.key).isin([k for k in keys if k is not None]) | (F.col(self.key).isNull() if None in keys else F.lit(False))
        return self._folders(version, mine).filter(wanted)

    def upsert(self, new: DataFrame, merge: Merge | None = None) -> int:
        """Lays rows over the stored ones by key, the last of several new ones counting; or what `merge` makes of the stored rows of the
        buckets that get rows, and the new ones. Returns the version's number."""
        for _ in range(TRIES):
            found = self.settled()
            number, version = found or (0, {"buckets": self.buckets, "folders": {}, "schema": new.schema.jsonValue()})
            many = version["buckets"]
            touched = [r[0] for r in new.select(self.bucket(many).alias("b")).distinct().collect()]
            old = self._folders(version, touched)
            merged = merge(old, new) if merge and found else new if merge else self._laid(old, new)
            change = f"data/{uuid.uuid4().hex}"
            # One file a bucket: a bucket is what a task writes.
            merged.withColumn("_b", self.bucket(many)).repartition(max(1, len(touched)), "_b").write.partitionBy("_b").parquet(f"{self.path}/{change}")
            fields = {f.name: f for f in [*T.StructType.fromJson(version["schema"]), *merged.schema]}
            folders = version["folders"] | {str(b): f"{change}/_b={b}" for b in touched if self.fs.exists(self._path(f"{change}/_b={b}"))}
            made = {"base": number, "buckets": many, "folders": folders, "schema": T.StructType([T.StructField(f.name, f.dataType) for f in fields.values()]).jsonValue()}
            next_ = max([number, *self.numbers()]) + 1
            # What came between was not read: it is read now.
            if (self.settled() or (0, None))[0] == number and self._take(next_, made) and self._leads_to(next_):
                return next_
        raise Conflict(f"{self.path}: {TRIES} other changes came first")

    def _laid(self, old: DataFrame, new: DataFrame) -> DataFrame:
        new = new.withColumn("_seq", F.monotonically_increasing_id())
        last = Window.partitionBy(self.key).orderBy(F.desc("_seq"))
        new = new.withColumn("_n", F.row_number().over(last)).filter("_n = 1").drop("_n", "_seq")
        keys = new.select(F.col(self.key).alias("_key"))
        return old.join(keys, F.col(self.key).eqNullSafe(F.col("_key")), "left_anti").unionByName(new, allowMissingColumns=True)

    def _take(self, number: int, version: dict) -> bool:
        """Writes a version under a number that nobody has; whether it did."""
        path = self._path(f"versions/{number:08d}.json")
        try:
            stream = self.fs.create(path, False)
        except Exception:  # noqa: BLE001 - the file system's own error: somebody was there first
            if self.fs.exists(path):
                return False
            raise
        try:
            stream.write(bytearray(json.dumps(version).encode()))
        finally:
            stream.close()
        return True

    def swept(self) -> int:
        """Deletes the buckets' folders that the last version does not name, and older versions; how many folders went. No reader
        may still read an older version, and no writer be at work."""
        found = self.version()
        if found is None:
            return 0
        number, version = found
        used, gone = set(version["folders"].values()), 0
        for change in self.fs.listStatus(self._path("data")):
            name = change.getPath().getName()
            own = [f.getPath() for f in self.fs.listStatus(change.getPath()) if f.isDirectory()]
            stale = [f for f in own if f"data/{name}/{f.getName()}" not in used]
            for path in [change.getPath()] if len(stale) == len(own) else stale:
                self.fs.delete(path, True)
            gone += len(stale)
        for old in self.numbers():
            if old != number:
                self.fs.delete(self._path(f"versions/{old:08d}.json"), False)
        return gone
