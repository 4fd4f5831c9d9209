"""Resumable stages: a stage's table is made again only if its inputs, settings or code changed."""

from __future__ import annotations

import hashlib
import inspect
import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from granary.sources.sinks import exists, remove


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def listing(spark: SparkSession, path: str) -> list[list]:
    """(name, length, time) of all files below a path, in order; a missing path has none."""
    fs, at = _fs(spark, path)
    if not fs.exists(at):
        return []
    files, out = fs.listFiles(at, True), []
    while files.hasNext():
        f = files.next()
        out.append([f.getPath().toString(), f.getLen(), f.getModificationTime()])
    return sorted(out)


def read_text(spark: SparkSession, path: str) -> str | None:
    if not exists(spark, path):
        return None
    fs, at = _fs(spark, path)
    stream = fs.open(at)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Written beside its place and moved in, so a reader sees the old or the new text; a local rename replaces, others need the old one gone."""
    fs, at = _fs(spark, path)
    beside = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.new")
    stream = fs.create(beside, True)
    stream.write(bytearray(text.encode()))
    stream.close()
    if fs.exists(at):
        fs.delete(at, False)
    if not fs.rename(beside, at):
        raise OSError(f"could not write {path}")


@dataclass
class Stages:
    """Stages of a build below ``root``, one folder each, whose ``manifest.json`` names the committed table and what it was made from.

    ``ran`` and ``skipped`` list the stages of this build in order. A stage's fingerprint holds its settings, its code, the files of its
    inputs (name, length, time) and the fingerprints of the stages that it reads. Tables are written into a folder of the fingerprint;
    the manifest changes after Spark's commit, so a build that broke off goes on behind its last whole stage, and readers of the old
    table aren't disturbed.
    """

    spark: SparkSession
    root: str
    ran: list[str] = field(default_factory=list)
    skipped: list[str] = field(default_factory=list)
    prints: dict[str, str] = field(default_factory=dict)

    def manifest(self, name: str) -> dict | None:
        text = read_text(self.spark, f"{self.root}/{name}/manifest.json") or read_text(self.spark, f"{self.root}/{name}/manifest.json.new")
        try:
            return json.loads(text) if text else None
        except ValueError:  # broken off while it was written
            return None

    def _print(self, name: str, make: Callable, inputs: dict[str, str], after: list[str], settings: dict) -> str:
        code = inspect.getsource(make) if inspect.isfunction(make) else repr(make)
        told = {"name": name, "code": code, "inputs": {k: [v, listing(self.spark, v)] for k, v in sorted(inputs.items())}, "after": [[a, self.prints[a]] for a in after], "settings": settings}
        return hashlib.sha256(json.dumps(told, sort_keys=True, default=str).encode()).hexdigest()[:24]

    def run(self, name: str, make: Callable[..., DataFrame], inputs: dict[str, str] | None = None, after: list[str] | None = None, **settings) -> DataFrame:
        """The stage's table: ``make(spark, inputs and earlier stages by name as DataFrames, **settings)``, or what an earlier build committed."""
        inputs, after = inputs or {}, after or []
        print_ = self._print(name, make, inputs, after, settings)
        old = self.manifest(name)
        path = f"{self.root}/{name}/{print_}"
        if old and old["fingerprint"] == print_ and exists(self.spark, f"{path}/_SUCCESS"):
            self.skipped.append(name)
        else:
            tables = {k: self.spark.read.parquet(v) for k, v in inputs.items()} | {a: self.table(a) for a in after}
            make(self.spark, **tables, **settings).write.mode("overwrite").parquet(path)
            write_text(self.spark, f"{self.root}/{name}/manifest.json", json.dumps({"fingerprint": print_, "settings": settings, "after": after}, default=str))
            if old and old["fingerprint"] != print_:
                remove(self.spark, f"{self.root}/{name}/{old['fingerprint']}")
            self.ran.append(name)
        self.prints[name] = print_
        return self.table(name)

    def table(self, name: str) -> DataFrame:
        told = self.manifest(name)
        if told is None:
            raise ValueError(f"stage {name} has no table")
        return self.spark.read.parquet(f"{self.root}/{name}/{told['fingerprint']}")
