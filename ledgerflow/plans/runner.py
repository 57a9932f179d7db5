"""Pipelines and their runs.

A pipeline is a class with a spec and ``run(ctx, **roles) -> DataFrame``. A run binds the
sources that its pipelines name (others are never opened), skips if nothing changed since
the last one, stages every output by one Spark job, and publishes all of them with the
sources' fingerprints in one step.
"""

from __future__ import annotations

import datetime as dt
import logging
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerflow.operators.projections import Contract, project
from ledgerflow.plans.publish import Busy, Publisher, Staged
from ledgerflow.schema import Column, apply_inferred, enforce, infer_schema, struct_of
from ledgerflow.sources import files as fs
from ledgerflow.sources.csv import CsvOptions, read_csv, read_csv_set
from ledgerflow.sources.xlsx import Workbook, read_workbooks

log = logging.getLogger("ledgerflow")


class SpecError(ValueError):
    pass


@dataclass(frozen=True)
class Source:
    """Where data come from. load(env) gives what pipelines get; fingerprint(env), if there, makes the source tracked."""

    name: str
    load: Callable[[Environment], Any]
    fingerprint: Callable[[Environment], fs.Fingerprint] | None = None


@dataclass(frozen=True)
class Environment:
    spark: SparkSession
    base_path: str | None = None
    access: fs.FileAccess | None = None

    def path(self, p: str) -> str:
        return fs.resolve(p, self.base_path)


def custom(name: str, load: Callable[[Environment], Any], fingerprint: Callable[[Environment], fs.Fingerprint] | None = None) -> Source:
    return Source(name, load, fingerprint)


def _one(env: Environment, path: str) -> fs.FoundFile:
    return fs.fixed_file(env.path(path), env.access)


def csv_file(name: str, path: str, options: CsvOptions = CsvOptions(), tracked: bool = True) -> Source:
    return Source(name, lambda e: read_csv(e.spark, _one(e, path), options, position=True, access=e.access), (lambda e: fs.file_fingerprint(_one(e, path))) if tracked else None)


def latest_csv(name: str, folder: str, pattern: str = "*.csv", options: CsvOptions = CsvOptions(), tracked: bool = True, **how) -> Source:
    pick = lambda e: fs.latest_file(e.path(folder), pattern, access=e.access, **how)
    return Source(name, lambda e: read_csv(e.spark, pick(e), options, position=True, access=e.access), (lambda e: fs.file_fingerprint(pick(e))) if tracked else None)


def csv_file_set(name: str, folder: str, pattern: str = "*.csv", options: CsvOptions = CsvOptions(), on_empty: str = "raise", tracked: bool = True, **how) -> Source:
    found = lambda e: fs.file_set(e.path(folder), pattern, on_empty, access=e.access, **how)
    return Source(
        name, lambda e: read_csv_set(e.spark, e.path(folder), pattern, options, on_empty, position=True, access=e.access, **how), (lambda e: fs.set_fingerprint(found(e), e.path(folder), pattern, how.get("recursive", False))) if tracked else None,
    )


def xlsx_file(name: str, path: str, tracked: bool = True) -> Source:
    return Source(name, lambda e: Workbook(e.spark, _one(e, path), e.access), (lambda e: fs.file_fingerprint(_one(e, path))) if tracked else None)


def latest_xlsx(name: str, folder: str, pattern: str = "*.xlsx", tracked: bool = True, **how) -> Source:
    pick = lambda e: fs.latest_file(e.path(folder), pattern, access=e.access, **how)
    return Source(name, lambda e: Workbook(e.spark, pick(e), e.access), (lambda e: fs.file_fingerprint(pick(e))) if tracked else None)


def xlsx_file_set(name: str, folder: str, pattern: str = "*.xlsx", sheet: str | int = 0, on_empty: str = "raise", tracked: bool = True, **how) -> Source:
    found = lambda e: fs.file_set(e.path(folder), pattern, on_empty, access=e.access, **how)
    return Source(name, lambda e: read_workbooks(e.spark, found(e), sheet, e.access), (lambda e: fs.set_fingerprint(found(e), e.path(folder), pattern, how.get("recursive", False))) if tracked else None)


@dataclass(frozen=True)
class Output:
    """What becomes of a pipeline's result. A contract maps and names columns; a schema is declared, or inferred if absent."""

    table: str | None = None
    contract: Contract | Callable[[list[str]], Contract] | None = None
    schema: tuple[Column, ...] | None = None
    strategy: str = "replace"
    updated_at: str | None = None
    excel: str | None = None
    share_as: str | None = None
    show: bool = False

    def __post_init__(self):
        if self.schema is not None and self.contract is not None:
            raise SpecError("a declared schema takes no contract")
        if self.table is None and (self.schema or self.contract or self.updated_at):
            raise SpecError("only published outputs have a contract, a schema or a time of update")
        if self.strategy == "refill" and self.schema is None:
            raise SpecError("only declared schemas are refilled")


class Pipeline:
    """Subclasses set output and roles (parameter -> source name) and implement run."""

    output: Output = Output()
    roles: dict[str, str] = {}

    def run(self, ctx: Context, **roles) -> DataFrame:
        raise NotImplementedError


class Context:
    """A run's sources, each loaded once, results by pipeline and shared values."""

    def __init__(self, env: Environment, sources: dict[str, Source]):
        self.env, self.spark, self._sources = env, env.spark, sources
        self._loaded: dict[str, Any] = {}
        self.results: dict[str, DataFrame] = {}
        self._shared: dict[str, list] = {}

    def source(self, name: str):
        if name not in self._loaded:
            if name not in self._sources:
                raise KeyError(f"no source {name!r}")
            self._loaded[name] = self._sources[name].load(self.env)
        return self._loaded[name]

    def push(self, name: str, value) -> None:
        self._shared.setdefault(name, []).append(value)

    def shared(self, name: str) -> list:
        if name not in self._shared:
            raise KeyError(f"nothing is shared as {name!r}")
        return self._shared[name]

    def close(self) -> list[Exception]:
        """Closes all sources that can be; errors are gathered, the first stops nothing."""
        errors = []
        for x in self._loaded.values():
            try:
                if callable(close := getattr(x, "close", None)):
                    close()
            except Exception as e:  # noqa: BLE001
                errors.append(e)
        return errors


@dataclass
class RunResult:
    status: str
    run: str
    reason: str | None = None
    rows: dict[str, int] = field(default_factory=dict)
    cleaned: list[str] = field(default_factory=list)


def prepare(df: DataFrame, out: Output, at: dt.datetime) -> DataFrame:
    """The result in the shape that is published."""
    if out.contract is not None:
        df = project(df, out.contract(df.columns) if callable(out.contract) else out.contract)
    df = enforce(df, out.schema) if out.schema is not None else apply_inferred(df, infer_schema(df))
    if out.updated_at:
        if out.updated_at in df.columns:
            raise SpecError(f"the output has a column {out.updated_at!r} of its own")
        df = df.withColumn(out.updated_at, F.lit(at).cast("timestamp"))
    return df


def declared_schema(df: DataFrame, out: Output) -> T.StructType | None:
    """The declared schema with what is added to it, df being ready to be published."""
    if out.schema is None:
        return None
    own = struct_of(out.schema)
    return T.StructType([*own, *[f for f in df.schema if f.name not in own.names]])


def validate(pipelines: list[type[Pipeline]], sources: dict[str, Source], publisher: Publisher | None) -> None:
    names = [p.__name__ for p in pipelines]
    if len(set(names)) != len(names):
        raise SpecError("pipelines of one name")
    for p in pipelines:
        if missing := sorted(set(p.roles.values()) - set(sources)):
            raise SpecError(f"{p.__name__}: no source {', '.join(missing)}")
    published = [p.output for p in pipelines if p.output.table]
    if published and publisher is None:
        raise SpecError("outputs are published, but there is no publisher")
    if publisher:
        columns = {o.table: [c.name for c in o.schema or ()] or list(o.contract.columns.values() if isinstance(o.contract, Contract) else ()) for o in published}
        for o in published:
            columns[o.table] += [o.updated_at] if o.updated_at else []
        publisher.preflight([o.table for o in published], {o.table: o.schema is not None for o in published}, {o.table: o.strategy for o in published}, columns)


def run_pipelines(spark: SparkSession, task: str, pipelines: list[type[Pipeline]], sources: Iterable[Source] = (), publisher: Publisher | None = None, base_path: str | None = None, force: bool = False, access: fs.FileAccess | None = None, keep_snapshots: bool = False) -> RunResult:
    """One run of a task. Its status is published, done (nothing to publish) or skipped, with the reason. keep_snapshots: the
    state has what each source's signature was made of."""
    known = {}
    for s in sources:
        if s.name in known:
            raise SpecError(f"sources of one name: {s.name}")
        known[s.name] = s
    validate(pipelines, known, publisher)
    run = dt.datetime.now(dt.UTC).strftime("%Y%m%d%H%M%S") + uuid.uuid4().hex[:8]
    active = {n: known[n] for p in pipelines for n in p.roles.values()}
    ctx = Context(Environment(spark, base_path, access), active)
    if publisher is None:
        return _run(ctx, task, run, pipelines, None, None)
    try:
        with publisher.task_lock(task):
            cleaned = publisher.clean_up(task)
            state = {n: {k: v for k, v in s.fingerprint(ctx.env).row().items() if keep_snapshots or k != "snapshot"} for n, s in sorted(active.items()) if s.fingerprint}
            before = publisher.state(task)
            if state and not force and before.keys() == state.keys() and all(before[n]["signature"] == state[n]["signature"] for n in state):
                return RunResult("skipped", run, "sources_unchanged", cleaned=cleaned)
            result = _run(ctx, task, run, pipelines, publisher, state)
            result.cleaned = cleaned
            return result
    except Busy as e:
        if "task-" in str(e):
            return RunResult("skipped", run, "task_already_running")
        raise


def _run(ctx: Context, task: str, run: str, pipelines: list[type[Pipeline]], publisher: Publisher | None, state: dict | None) -> RunResult:
    from ledgerflow.sinks.xlsx import write_xlsx

    at, staged, kept = dt.datetime.now(dt.UTC), [], []
    result = RunResult("done", run)
    failed = True
    try:
        for p in pipelines:
            out = p.output
            df = p().run(ctx, **{role: ctx.source(name) for role, name in p.roles.items()})
            if not isinstance(df, DataFrame):
                raise TypeError(f"{p.__name__}: run() gives a DataFrame, not {type(df).__name__}")
            consumers = bool(out.table) * (1 if out.schema is not None else 2) + bool(out.excel) + bool(out.share_as) + out.show
            if consumers > 1:
                df = df.persist()
                kept.append(df)
            ctx.results[p.__name__] = df
            if out.share_as:
                ctx.push(out.share_as, df)
            if out.show:
                df.show(1000, truncate=False)
            if out.excel:
                write_xlsx(df, out.excel)
            if out.table:
                ready = prepare(df, out, at)
                s: Staged = publisher.stage(ready, out.table, task, run, out.strategy, declared_schema(ready, out))
                staged.append(s)
                if out.strategy == "refill":
                    publisher.check_refill(s)
                result.rows[out.table] = s.rows
        if publisher is not None:
            publisher.commit(staged, task, run, state or None)
            result.status = "published" if staged else "done"
        failed = False
        return result
    finally:
        if failed and publisher is not None:
            publisher.rollback(staged, run)
        for df in kept:
            df.unpersist()
        for e in ctx.close():
            log.warning("a source was not closed: %s", e)
