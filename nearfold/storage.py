"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import json
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a temporary folder only where it is unset and all runs on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="nearfold-")
    return f"file://{_own[app]}"


def hadoop(spark: SparkSession, path: str):
    """The path and its file system."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = hadoop(spark, path)
    return fs.exists(p)


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write df once and read it back: cuts lineage, and what was computed is computed no more."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/nearfold-{label}-{uuid.uuid4().hex}"
    p, fs = hadoop(spark, path)
    fs.deleteOnExit(p)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Conflict(RuntimeError):
    """Another writer has made the manifest that was to come next."""


class Manifest:
    """What is valid in a folder, as numbered JSON texts of which the newest counts.

    A text is one file that is written aside and then takes its name, so a reader sees one whole state or the one
    before, and of two writers of one number the second fails: a distributed file system renames no file to a name that
    is taken, and on a local one the name is a link, which isn't made where something is.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _numbers(self) -> list[int]:
        p, fs = hadoop(self.spark, self.folder)
        names = [x.getPath().getName() for x in fs.listStatus(p)] if fs.exists(p) else []
        return sorted(int(m[1]) for n in names if (m := re.fullmatch(r"manifest-(\d+)", n)))

    def read(self) -> tuple[int, dict]:
        """The newest number (0: none) and its content."""
        numbers = self._numbers()
        if not numbers:
            return 0, {}
        p, fs = hadoop(self.spark, f"{self.folder}/manifest-{numbers[-1]}")
        stream = fs.open(p)
        try:
            return numbers[-1], json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def write(self, number: int, content: dict) -> None:
        """Make a number's text; Conflict if there is one or a later one."""
        target, fs = hadoop(self.spark, f"{self.folder}/manifest-{number}")
        aside = hadoop(self.spark, f"{self.folder}/.manifest-{number}-{uuid.uuid4().hex}")[0]
        out = fs.create(aside, False)
        out.write(bytearray(json.dumps(content).encode()))
        out.close()
        try:
            made = max(self._numbers(), default=0) < number and self._name(fs, aside, target)
        finally:
            if fs.exists(aside):
                fs.delete(aside, False)
        if not made:
            raise Conflict(f"another writer has made manifest {number} of {self.folder}")
        for old in self._numbers():
            if old < number - 2:  # a reader may have just listed the newest
                fs.delete(hadoop(self.spark, f"{self.folder}/manifest-{old}")[0], True)

    def _name(self, fs, aside, target) -> bool:
        if fs.getUri().getScheme() != "file":
            return fs.rename(aside, target)
        path = self.spark.sparkContext._jvm.java.nio.file.Paths.get
        none = self.spark.sparkContext._gateway.new_array(self.spark.sparkContext._jvm.java.lang.String, 0)
        try:
            self.spark.sparkContext._jvm.java.nio.file.Files.createLink(path(target.toUri().getPath(), none), path(aside.toUri().getPath(), none))
        except Exception as e:
            if "FileAlreadyExists" in str(e):
                return False
            raise
        return True
