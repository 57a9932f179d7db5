"""File selection and fingerprints. A listing runs on the driver; files are read where Spark puts the tasks."""

from __future__ import annotations

import base64
import datetime as dt
import fnmatch
import hashlib
import json
import os
import pickle
import posixpath
import stat
import time
from collections.abc import Iterable
from dataclasses import asdict, dataclass
from pathlib import PurePath
from typing import BinaryIO, Protocol

from pyspark import cloudpickle


class NoMatchingFilesError(FileNotFoundError):
    """The folder is there, but no file in it fits."""


@dataclass(frozen=True)
class FoundFile:
    path: str
    relative_path: str
    size: int
    mtime_ns: int
    hidden: bool = False
    system: bool = False


class FileAccess(Protocol):
    """What is needed of a file system: listing for selection, and content for the readers. Local files are the one that comes
    with it; another one (a share, an archive, memory) is sent to the tasks that read, so it must be picklable."""

    def walk(self, folder: str, recursive: bool) -> Iterable[FoundFile]: ...

    def one(self, path: str) -> FoundFile: ...

    def open(self, path: str) -> BinaryIO: ...


class LocalFiles:
    def walk(self, folder: str, recursive: bool) -> Iterable[FoundFile]:
        if os.path.isfile(folder):
            raise ValueError(f"{folder} is a file, not a folder; fixed_file() selects one file")
        if not os.path.isdir(folder):
            raise FileNotFoundError(f"no folder {folder}")
        for top, dirs, names in os.walk(folder):
            if not recursive:
                dirs.clear()
            for name in names:
                full = os.path.join(top, name)
                try:
                    info = os.stat(full)
                except FileNotFoundError:  # gone since it was listed
                    continue
                if stat.S_ISREG(info.st_mode):
                    yield FoundFile(full, os.path.relpath(full, folder).replace(os.sep, "/"), info.st_size, info.st_mtime_ns, *_attributes(info))

    def one(self, path: str) -> FoundFile:
        if not os.path.isfile(path):
            raise FileNotFoundError(f"no file {path}")
        info = os.stat(path)
        return FoundFile(path, os.path.basename(path), info.st_size, info.st_mtime_ns, *_attributes(info))

    def open(self, path: str) -> BinaryIO:
        return open(path, "rb")


def _attributes(info: os.stat_result) -> tuple[bool, bool]:
    """Whether the system marks the file as hidden, and as its own."""
    flags = getattr(info, "st_file_attributes", 0)
    return bool(flags & stat.FILE_ATTRIBUTE_HIDDEN), bool(flags & stat.FILE_ATTRIBUTE_SYSTEM)


def sent(access: FileAccess | None) -> str | None:
    """An access as text, for the tasks that read through it."""
    return None if access is None else base64.b64encode(cloudpickle.dumps(access)).decode()


def received(text: str | None) -> FileAccess:
    return LocalFiles() if text is None else pickle.loads(base64.b64decode(text))  # noqa: S301  our own driver's


def resolve(path: str, base: str | None = None) -> str:
    """An absolute or network path as it is; another below base. Dots are resolved."""
    if path.startswith(("\\\\", "//")) or os.path.isabs(path) or "://" in path:
        return path if "://" in path or path.startswith("\\\\") else os.path.normpath(path)
    return os.path.normpath(os.path.join(base or os.getcwd(), path))


def _order(f: FoundFile) -> tuple[str, str]:
    return f.relative_path.lower(), f.relative_path


def select_files(folder: str, pattern: str = "*", *, recursive: bool = False, hidden: bool = False, system: bool = False, temporary: bool = False, min_age_seconds: float = 0, access: FileAccess | None = None) -> list[FoundFile]:
    """Files whose name (or, for a pattern with a slash, relative path) fits, in order of their relative paths. Names that
    begin with a dot are hidden, as are files that the system marks so, and with ~$ temporary; system files are those that the
    system marks as its own. Each kind is left out unless asked for. Younger files than min_age_seconds may still be written."""
    newest = time.time_ns() - int(min_age_seconds * 1e9)
    out = []
    for f in (access or LocalFiles()).walk(folder, recursive):
        name = posixpath.basename(f.relative_path)
        if not hidden and (f.hidden or any(p.startswith(".") for p in PurePath(f.relative_path).parts)) or not temporary and name.startswith("~$") or not system and f.system:
            continue
        if not fnmatch.fnmatchcase((f.relative_path if "/" in pattern else name).lower(), pattern.lower()):
            continue
        if min_age_seconds and f.mtime_ns > newest:
            continue
        out.append(f)
    if not out:
        raise NoMatchingFilesError(f"no file in {folder} fits {pattern!r}")
    return sorted(out, key=_order)


def latest_file(folder: str, pattern: str = "*", **how) -> FoundFile:
    """The file last written; of several the last by path."""
    return max(select_files(folder, pattern, **how), key=lambda f: (f.mtime_ns, f.path))


def fixed_file(path: str, access: FileAccess | None = None) -> FoundFile:
    return (access or LocalFiles()).one(path)


def file_set(folder: str, pattern: str = "*", on_empty: str = "raise", **how) -> list[FoundFile]:
    """As select_files(); on_empty="empty" makes no match an empty list. A folder that is missing is always an error."""
    if on_empty not in ("raise", "empty"):
        raise ValueError(f"on_empty {on_empty!r}")
    try:
        return select_files(folder, pattern, **how)
    except NoMatchingFilesError:
        if on_empty == "raise":
            raise
        return []


def canonical(value) -> str:
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"), default=_scalar)


def _scalar(v):
    import decimal

    if isinstance(v, (dt.datetime, dt.date, dt.time)):
        return v.isoformat()
    if isinstance(v, decimal.Decimal):
        return str(v)
    raise TypeError(f"{type(v).__name__} has no canonical form")


def signature_of(value) -> str:
    return hashlib.md5(canonical(value).encode()).hexdigest()


@dataclass(frozen=True)
class Fingerprint:
    """What a source looked like: equal signatures mean that nothing has to run."""

    kind: str
    root: str
    mask: str
    recursive: bool
    files: int
    total_size: int
    newest_ns: int
    signature: str
    snapshot: tuple = ()

    def row(self) -> dict:
        return asdict(self)


def file_fingerprint(f: FoundFile) -> Fingerprint:
    snapshot = ({"path": f.relative_path, "size": f.size, "mtime": f.mtime_ns},)
    return Fingerprint("file", f.path, f.relative_path, False, 1, f.size, f.mtime_ns, signature_of(snapshot), snapshot)


def set_fingerprint(files: list[FoundFile], root: str, mask: str, recursive: bool = False) -> Fingerprint:
    snapshot = tuple({"path": f.relative_path, "size": f.size, "mtime": f.mtime_ns} for f in sorted(files, key=_order))
    return Fingerprint("file_set", root, mask, recursive, len(files), sum(f.size for f in files), max((f.mtime_ns for f in files), default=0), signature_of(snapshot), snapshot)


def query_fingerprint(spark, sql: str) -> Fingerprint:
    """Over the one row that the query returns."""
    rows = spark.sql(sql)
    if len(set(rows.columns)) != len(rows.columns):
        raise ValueError("the fingerprint query has columns of one name")
    got = rows.limit(2).collect()
    if len(got) != 1:
        raise ValueError(f"the fingerprint query returns {'no row' if not got else 'more than one row'}")
    snapshot = (got[0].asDict(),)
    return Fingerprint("query", "", sql, False, 0, 0, 0, signature_of(snapshot), snapshot)
