"""Tables with a natural key that are changed by batches, each of which counts once.

Rows lie in hash buckets of their key, so a batch reads and rewrites the
buckets of its own keys only.  A batch first writes new files and then one
small manifest that names the files of every bucket; the manifest appears
whole or not at all, so a batch that dies half-way leaves the table as it was.
The manifest also holds the last batch of each writer, so a batch that is sent
again changes nothing.  A table has one writer at a time; a second one that
commits the same version is refused.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Manifests kept for readers that still use an older version.
KEPT_VERSIONS = 10


def _same(left: str, right: str, keys: list[str]) -> Column:
    """Equal keys; a null is a key like any other."""
    equal = F.lit(True)
    for key in keys:
        equal = equal & F.col(f"{left}.{key}").eqNullSafe(F.col(f"{right}.{key}"))
    return equal


class KeyedTable:
    """``keys`` identify a row; ``buckets`` is fixed when the table is first written.

    Choose the buckets so that one of them is some hundred megabytes at the
    size the table will reach: it is the unit that an update rewrites.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], buckets: int = 64):
        self._spark, self._path, self._keys, self._buckets = spark, path.rstrip("/"), keys, buckets
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._hadoop.Path(self._path).getFileSystem(self._conf)

    # --- manifest ---

    def _names(self, folder: str) -> list[str]:
        place = self._hadoop.Path(f"{self._path}/{folder}")
        return [f.getPath().getName() for f in self._fs.listStatus(place)] if self._fs.exists(place) else []

    def _manifest(self, version: int | None = None) -> dict:
        versions = [int(n[:-5]) for n in self._names("versions") if n.endswith(".json") and n[:-5].isdigit()]
        if not versions:
            return {"version": 0, "buckets": self._buckets, "schema": None, "files": {}, "applied": {}}
        stream = self._fs.open(self._hadoop.Path(f"{self._path}/versions/{version or max(versions)}.json"))
        try:
            return json.loads(self._spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, manifest: dict) -> None:
        manifest["version"] += 1
        name = f"{self._path}/versions/{manifest['version']}.json"
        draft = self._hadoop.Path(f"{self._path}/versions/.{uuid.uuid4().hex}")
        out = self._fs.create(draft, True)
        out.write(bytearray(json.dumps(manifest), "utf-8"))
        out.close()
        rename = self._hadoop.Options.Rename
        options = self._spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.NONE  # fails where the version exists
        self._hadoop.FileContext.getFileContext(self._fs.getUri(), self._conf).rename(draft, self._hadoop.Path(name), options)
        self._fs.delete(self._hadoop.Path(f"{self._path}/versions/{manifest['version'] - KEPT_VERSIONS}.json"), False)

    def applied(self, batch: int, writer: str = "default") -> bool:
        """Whether the batch, or a later one of the writer, has been committed."""
        return self._manifest()["applied"].get(writer, -1) >= batch

    # --- rows ---

    def bucket(self, buckets: int) -> Column:
        return F.pmod(F.xxhash64(*self._keys), F.lit(buckets)).cast("int")

    def _read(self, manifest: dict, buckets: list[str]) -> DataFrame | None:
        paths = [f"{self._path}/{folder}" for b in buckets for folder in manifest["files"].get(b, [])]
        if not paths:
            return None
        return self._spark.read.schema(StructType.fromJson(manifest["schema"])).parquet(*paths)

    def read(self) -> DataFrame | None:
        """All rows; None before the first batch."""
        manifest = self._manifest()
        if manifest["schema"] is None:
            return None
        rows = self._read(manifest, list(manifest["files"]))
        return self._spark.createDataFrame([], StructType.fromJson(manifest["schema"])) if rows is None else rows

    def read_for(self, probes: DataFrame) -> DataFrame | None:
        """The rows of the buckets that the keys of ``probes`` fall into; None where there are none."""
        manifest = self._manifest()
        if manifest["schema"] is None:
            return None
        types = {f.name: f.dataType for f in StructType.fromJson(manifest["schema"]).fields}
        cast = probes.select(*[F.col(k).cast(types[k]).alias(k) for k in self._keys])
        touched = cast.select(self.bucket(manifest["buckets"]).alias("b")).distinct().collect()  # one number a bucket
        return self._read(manifest, [str(r["b"]) for r in touched])

    def _write(self, rows: DataFrame, buckets: int) -> dict[str, str]:
        """Write rows to a new folder; the folder of every bucket that got some."""
        folder = f"data/{uuid.uuid4().hex}"
        # rebalancing cuts large buckets into several files and joins small ones in a task
        rows.withColumn("_bucket", self.bucket(buckets)).hint("rebalance", "_bucket").write.partitionBy("_bucket").parquet(
            f"{self._path}/{folder}")
        return {n.split("=")[1]: f"{folder}/{n}" for n in self._names(folder) if n.startswith("_bucket=")}

    def _staged(self, rows: DataFrame, order: list[str], last: bool, manifest: dict) -> dict[str, str]:
        """The last (or first) row of each key by ``order``, then by the other columns, written by bucket."""
        columns = rows.columns
        if manifest["schema"]:
            columns = [F.col(f.name).cast(f.dataType).alias(f.name) for f in StructType.fromJson(manifest["schema"]).fields]
        pick = F.max if last else F.min
        chosen = pick(F.struct(F.struct(*order).alias("by"), F.struct(*columns).alias("row"))).alias("best")
        one = rows.groupBy(*[F.col(k).alias(f"_{k}") for k in self._keys]).agg(chosen).select("best.row.*")
        if manifest["schema"] is None:
            manifest["schema"] = one.schema.jsonValue()
        return self._write(one, manifest["buckets"])

    def upsert(self, updates: DataFrame, order: list[str], batch: int, writer: str = "default") -> None:
        """Insert the rows, or put them in place of those of equal keys; of several of a key the last by ``order`` counts."""
        manifest = self._manifest()
        if manifest["applied"].get(writer, -1) >= batch:
            return
        staged = self._staged(updates, order, True, manifest)
        old = self._read(manifest, list(staged))
        files = {b: [folder] for b, folder in staged.items()}
        if old is not None:
            shared = [b for b in staged if manifest["files"].get(b)]
            schema = StructType.fromJson(manifest["schema"])
            new = self._spark.read.schema(schema).parquet(*[f"{self._path}/{staged[b]}" for b in shared])
            kept = old.alias("o").join(new.select(*self._keys).alias("n"), _same("o", "n", self._keys), "left_anti")
            files.update({b: [folder] for b, folder in self._write(kept.unionByName(new), manifest["buckets"]).items()})
        manifest["files"].update(files)
        manifest["applied"][writer] = batch
        self._commit(manifest)

    def append_new(self, rows: DataFrame, order: list[str], batch: int, writer: str = "default") -> DataFrame:
        """Add the rows whose key is not there yet, the first of a key by ``order``.

        Returns the keys of the batch with ``created``; a batch sent again
        gets the answer of the first time.
        """
        log = f"{self._path}/log/{writer}/batch={batch}"
        manifest = self._manifest()
        if manifest["applied"].get(writer, -1) < batch:
            staged = self._staged(rows, order, False, manifest)
            schema = StructType.fromJson(manifest["schema"])
            old = self._read(manifest, list(staged))
            if staged:
                new = self._spark.read.schema(schema).parquet(*[f"{self._path}/{f}" for f in staged.values()])
            else:
                new = self._spark.createDataFrame([], schema)
            if old is None:
                fresh, answered = staged, new.select(*self._keys, F.lit(True).alias("created"))
            else:
                known = old.select(*self._keys, F.lit(True).alias("_known")).alias("o")
                marked = new.alias("n").join(known, _same("n", "o", self._keys), "left").select(
                    "n.*", F.col("_known").isNull().alias("created"))
                answered = marked.select(*self._keys, "created")
                fresh = self._write(marked.filter("created").drop("created"), manifest["buckets"])
            answered.write.mode("overwrite").parquet(log)
            for bucket, folder in fresh.items():
                manifest["files"].setdefault(bucket, []).append(folder)
            manifest["applied"][writer] = batch
            self._commit(manifest)
        return self._spark.read.parquet(log)

    def compact(self, most: int = 8) -> None:
        """Rewrite the buckets that lie in more than ``most`` folders as one."""
        manifest = self._manifest()
        scattered = [b for b, folders in manifest["files"].items() if len(folders) > most]
        if scattered:
            rewritten = self._write(self._read(manifest, scattered), manifest["buckets"])
            manifest["files"].update({b: [folder] for b, folder in rewritten.items()})
            self._commit(manifest)

    def vacuum(self) -> None:
        """Delete files that no kept manifest names: replaced buckets and what unfinished batches left."""
        named = set()
        for name in self._names("versions"):
            if name.endswith(".json"):
                files = self._manifest(int(name[:-5]))["files"]
                named.update(folder.split("/")[1] for folders in files.values() for folder in folders)
        for folder in self._names("data"):
            if folder not in named:
                self._fs.delete(self._hadoop.Path(f"{self._path}/data/{folder}"), True)

    def files_of(self) -> dict[str, list[str]]:
        """The folders of every bucket in the newest version."""
        return self._manifest()["files"]
