"""Atomic publication of several tables and the run's state.

A table's data are generations: Parquet folders beside each other, one of them live. What
is live, of all tables of a schema and with the state of all tasks, stands in one file,
the manifest; replacing that file publishes everything at once. Until then readers see
the former generation, and a failed run leaves nothing but folders that carry its name.

Data go through Spark and so to any file system; manifest and locks need a file system
that the driver mounts, with atomic rename and flock.
"""

from __future__ import annotations

import contextlib
import datetime as dt
import errno
import fcntl
import hashlib
import json
import os
import random
import shutil
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerflow.operators.projections import TABLE_NAME, check_name

MANIFEST, MARKER = "_MANIFEST.json", "_OWNER.json"
STRATEGIES = ("replace", "refill")
RESERVED = ("_locks",)


class PublishError(RuntimeError):
    pass


class Busy(PublishError):
    """Another run holds what this one needs."""


@dataclass(frozen=True)
class Staged:
    """A generation that is written and verified, but not live."""

    table: str
    generation: str
    rows: int
    schema: str
    strategy: str


def _path_of(uri: str) -> str:
    return uri.removeprefix("file://")


class Publisher:
    """The tables of one schema below root."""

    def __init__(self, spark: SparkSession, root: str, schema: str = "public", keep_generations: int = 1, attempts: int = 5, wait_seconds: float = 0.2):
        self.spark, self.schema = spark, check_name(schema, TABLE_NAME)
        self.root = f"{_path_of(root).rstrip('/')}/{schema}"
        self.keep, self.attempts, self.wait = keep_generations, attempts, wait_seconds
        os.makedirs(self.root, exist_ok=True)

    # what is live

    def manifest(self) -> dict:
        try:
            with open(f"{self.root}/{MANIFEST}", encoding="utf-8") as f:
                return json.load(f)
        except FileNotFoundError:
            return {"tables": {}, "state": {}}

    def read(self, table: str) -> DataFrame:
        entry = self.manifest()["tables"].get(table)
        if entry is None:
            raise PublishError(f"table {table!r} isn't published")
        return self.spark.read.schema(T.StructType.fromJson(json.loads(entry["schema"]))).parquet(self._folder(table, entry["generation"]))

    def schema_of(self, table: str) -> T.StructType:
        """The live table's schema as recorded: nullability is as declared, which files don't keep."""
        return T.StructType.fromJson(json.loads(self.manifest()["tables"][table]["schema"]))

    def provenance(self, table: str) -> dict:
        """Task, run, rows and time of the live generation."""
        e = self.manifest()["tables"][table]
        return {k: e[k] for k in ("task", "run", "rows", "published_at", "strategy")}

    def state(self, task: str) -> dict[str, dict]:
        return self.manifest()["state"].get(task, {})

    def _folder(self, table: str, generation: str) -> str:
        return f"{self.root}/{table}/{generation}"

    # locks

    @contextlib.contextmanager
    def _locked(self, name: str) -> Iterator[None]:
        os.makedirs(f"{self.root}/_locks", exist_ok=True)
        fd = os.open(f"{self.root}/_locks/{name}", os.O_CREAT | os.O_RDWR)
        try:
            try:
                fcntl.flock(fd, fcntl.LOCK_EX | fcntl.LOCK_NB)
            except OSError as e:
                if e.errno in (errno.EAGAIN, errno.EACCES):
                    raise Busy(f"{name} is locked") from None
                raise
            yield
        finally:
            os.close(fd)

    def task_lock(self, task: str):
        """Held for a whole run; Busy if another run of the task holds it. The system frees it when the process ends."""
        return self._locked("task-" + hashlib.blake2b(task.encode(), digest_size=8).hexdigest())

    # preparation

    def preflight(self, tables: list[str], declared: dict[str, bool] | None = None, strategies: dict[str, str] | None = None, columns: dict[str, list[str]] | None = None) -> None:
        """What can be wrong with names of tables and columns, and with strategies, before any work."""
        for t in tables:
            check_name(t, TABLE_NAME)
            if t in RESERVED:
                raise PublishError(f"{t}: the publisher keeps its own files under that name")
        for t, names in (columns or {}).items():
            for c in names:
                check_name(c)
            if twice := sorted({c for c in names if names.count(c) > 1}):
                raise PublishError(f"{t}: columns more than once: {', '.join(twice)}")
        if twice := sorted({t for t in tables if tables.count(t) > 1}):
            raise PublishError(f"tables more than once: {', '.join(twice)}")
        for t, s in (strategies or {}).items():
            if s not in STRATEGIES:
                raise PublishError(f"{t}: strategy {s!r}")
            if s == "refill" and not (declared or {}).get(t):
                raise PublishError(f"{t}: only declared schemas are refilled")

    def stage(self, df: DataFrame, table: str, task: str, run: str, strategy: str = "replace", schema: T.StructType | None = None) -> Staged:
        """Writes a generation, counting rows on the way, and checks what is there to read. schema: as declared, which is what is
        recorded; else df's own, whose nullability is the plan's."""
        self.preflight([table])
        if schema is not None and [(f.name, f.dataType) for f in schema] != [(f.name, f.dataType) for f in df.schema]:
            raise PublishError(f"{table}: the rows don't have the declared schema")
        generation = f"gen={run}"
        folder = self._folder(table, generation)
        os.makedirs(folder, exist_ok=False)
        with open(f"{folder}/{MARKER}", "w", encoding="utf-8") as f:
            json.dump({"task": task, "run": run, "table": table}, f)
        seen = Observation()
        df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("append").parquet(folder)
        rows = seen.get["rows"]
        back = self.spark.read.parquet(folder)
        if [(f.name, f.dataType) for f in back.schema] != [(f.name, f.dataType) for f in df.schema]:
            raise PublishError(f"{table}: what was written has another schema")
        if back.count() != rows:
            raise PublishError(f"{table}: {rows} rows were written, others are there")
        return Staged(table, generation, rows, (schema or df.schema).json(), strategy)

    def check_refill(self, s: Staged) -> None:
        """A refill keeps the live table's schema exactly: names, order, types and nullability."""
        live = self.manifest()["tables"].get(s.table)
        if live is not None and json.loads(live["schema"]) != json.loads(s.schema):
            raise PublishError(f"{s.table}: a refill must have the live table's schema")

    # publication

    def commit(self, staged: list[Staged], task: str, run: str, state: dict[str, dict] | None = None) -> None:
        """Makes all generations live and replaces the task's state, or nothing of it. A lock that is held is waited for a
        bounded time; no other failure is tried again."""
        if not staged and state is None:
            return
        for attempt in range(self.attempts):
            try:
                with self._locked("manifest"):
                    return self._swap(staged, task, run, state)
            except Busy:
                if attempt + 1 == self.attempts:
                    raise
                time.sleep(self.wait * (1 + random.random()))

    def _swap(self, staged: list[Staged], task: str, run: str, state: dict[str, dict] | None) -> None:
        now = self.manifest()
        for s in sorted(staged, key=lambda s: s.table):
            with open(f"{self._folder(s.table, s.generation)}/{MARKER}", encoding="utf-8") as f:
                if json.load(f)["run"] != run:
                    raise PublishError(f"{s.table}: the generation isn't this run's")
            if s.strategy == "refill":
                self.check_refill(s)
            former = now["tables"].get(s.table)
            now["tables"][s.table] = {
                "generation": s.generation, "rows": s.rows, "schema": s.schema, "strategy": s.strategy, "task": task, "run": run, "published_at": dt.datetime.now(dt.UTC).isoformat(),
                "former": ([former["generation"], *former.get("former", [])] if former else [])[: self.keep],
            }
        if state is not None:
            now["state"][task] = state
        temp = f"{self.root}/{MANIFEST}.{uuid.uuid4().hex}"
        with open(temp, "w", encoding="utf-8") as f:
            json.dump(now, f, ensure_ascii=False, sort_keys=True)
            f.flush()
            os.fsync(f.fileno())
        os.replace(temp, f"{self.root}/{MANIFEST}")

    def rollback(self, staged: list[Staged], run: str) -> None:
        """Drops the run's own generations; never raises."""
        for s in staged:
            if s.generation == f"gen={run}":
                shutil.rmtree(self._folder(s.table, s.generation), ignore_errors=True)

    def clean_up(self, task: str) -> list[str]:
        """Drops generations of the task that no manifest names. Folder name and marker must agree; what is unknown stays."""
        named = {(t, g) for t, e in self.manifest()["tables"].items() for g in (e["generation"], *e.get("former", []))}
        gone = []
        for table in sorted(os.listdir(self.root)):
            folder = f"{self.root}/{table}"
            if not os.path.isdir(folder) or table.startswith("_"):
                continue
            for generation in sorted(os.listdir(folder)):
                try:
                    with open(f"{folder}/{generation}/{MARKER}", encoding="utf-8") as f:
                        mark = json.load(f)
                except (OSError, ValueError):
                    continue
                if mark.get("task") == task and mark.get("table") == table and generation == f"gen={mark.get('run')}" and (table, generation) not in named:
                    shutil.rmtree(f"{folder}/{generation}")
                    gone.append(f"{table}/{generation}")
        return gone
