"""Tables that are replaced as a whole: a new version is written beside the old one, then named by one renamed file.

Readers take the version that the manifest names. A write that fails half-way leaves the manifest as it was, and so the old
rows. The rename replaces the manifest in one step on file systems whose renames do so (HDFS, local disks). Versions that no
manifest names go when `drop_old` is called, when nobody reads them any more.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

MANIFEST = "_manifest"  # with an underscore, so that no scan takes it for data


class Files:
    """The few file operations needed, on whatever file system a path names."""

    def __init__(self, spark: SparkSession):
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self.gateway = spark.sparkContext._gateway

    def _at(self, path: str):
        found = self.jvm.org.apache.hadoop.fs.Path(path)
        return found.getFileSystem(self.conf), found

    def exists(self, path: str) -> bool:
        system, at = self._at(path)
        return system.exists(at)

    def read(self, path: str) -> str:
        system, at = self._at(path)
        stream = system.open(at)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def replace(self, path: str, text: str) -> None:
        """All of the new text or all of the old one, never a part."""
        draft = f"{path}-{uuid.uuid4().hex}"
        system, at = self._at(draft)
        stream = system.create(at, False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        fs = self.jvm.org.apache.hadoop.fs
        how = self.gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 1)
        how[0] = getattr(fs, "Options$Rename").OVERWRITE
        context = fs.FileContext.getFileContext(system.getUri(), self.conf)
        context.rename(system.makeQualified(at), system.makeQualified(self._at(path)[1]), how)

    def names(self, folder: str) -> list[str]:
        system, at = self._at(folder)
        return sorted(s.getPath().getName() for s in system.listStatus(at)) if system.exists(at) else []

    def delete(self, path: str) -> None:
        system, at = self._at(path)
        system.delete(at, True)


class VersionedTable:
    """One table at `path`, its versions in folders `version=...`."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.files = spark, path.rstrip("/"), Files(spark)

    def manifest(self) -> dict | None:
        """What was told of the published version, and its name; None before the first."""
        at = f"{self.path}/{MANIFEST}"
        return json.loads(self.files.read(at)) if self.files.exists(at) else None

    def publish(self, df: DataFrame, **about) -> None:
        """`df` as the table from now on. It may read the version that it replaces."""
        name = uuid.uuid4().hex
        df.write.parquet(f"{self.path}/version={name}")
        self.files.replace(f"{self.path}/{MANIFEST}", json.dumps(about | {"version": name}))

    def folder(self) -> str:
        told = self.manifest()
        if told is None:
            raise FileNotFoundError(f"nothing has been published at {self.path}")
        return f"{self.path}/version={told['version']}"

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.folder())

    def drop_old(self) -> list[str]:
        """Delete versions that are not published, those of failed writes too, and unfinished manifests."""
        told = self.manifest()
        keep = {MANIFEST} | ({f"version={told['version']}"} if told else set())
        gone = [n for n in self.files.names(self.path) if n not in keep and n.startswith(("version=", MANIFEST))]
        for name in gone:
            self.files.delete(f"{self.path}/{name}")
        return gone
