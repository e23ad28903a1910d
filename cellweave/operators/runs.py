"""Runs that a new session can take up: a ledger of scopes on the shared store, and records that are written once.

A run is a folder with an identity (inputs and configuration) and scopes, each
of which makes one table.  Everything that decides is an exclusive create, so
two sessions cannot both win: the identity, each numbered attempt at a scope,
and the record that names the attempt whose table counts.  A table is written
before its record, so a session that dies leaves an attempt without a record,
and the next session makes a new attempt.  Records carry the digest of their
table and are checked before a finished scope is skipped.

A frozen selection and the single claim of a locked test are records of the
same kind, linked by digest.

The folder is on a POSIX file system that all sessions share.
"""

from __future__ import annotations

import hashlib
import json
import os
import time
from collections.abc import Callable
from pathlib import Path
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.sinks import table_digest


class RunError(ValueError):
    """The run on the store is not the one that is asked for."""


def _canonical(value) -> str:
    return json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":"))


def digest(value) -> str:
    return hashlib.sha256(_canonical(value).encode()).hexdigest()


def create(path: Path, value) -> bool:
    """Write a record under its name if nobody has; it is whole as soon as it has the name."""
    path.parent.mkdir(parents=True, exist_ok=True)
    draft = path.with_name(f".{path.name}.{os.getpid()}.{time.monotonic_ns()}")
    with open(draft, "x", encoding="utf-8") as f:
        f.write(_canonical(value))
        f.flush()
        os.fsync(f.fileno())
    try:
        os.link(draft, path)
        return True
    except FileExistsError:
        return False
    finally:
        os.unlink(draft)


def read(path: Path):
    return json.loads(path.read_text(encoding="utf-8")) if path.exists() else None


class Ledger:
    """The scopes of a run under `folder`; `identity` must be what the run was begun with."""

    def __init__(self, spark: SparkSession, folder: str, identity: dict, lease: float = 6 * 3600.0):
        self.spark, self.lease = spark, lease
        self.folder = Path(folder.removeprefix("file://").removeprefix("file:"))
        self.identity = digest(identity)
        record = {"identity": self.identity, "of": identity}
        if not create(self.folder / "identity.json", record) and (held := read(self.folder / "identity.json"))["identity"] != self.identity:
            changed = sorted(k for k in {*held["of"], *identity} if held["of"].get(k) != json.loads(_canonical(identity)).get(k))
            raise RunError(f"the run was begun with other inputs or another configuration: {', '.join(changed)}")

    def _scope(self, scope: str) -> Path:
        return self.folder / "scopes" / quote(scope, safe="")

    def attempts(self, scope: str) -> list[dict]:
        return [read(p) for p in sorted(self._scope(scope).glob("attempt-*.json"))]

    def table(self, scope: str) -> DataFrame | None:
        """The table of a finished scope (None before); an error if it is not what its record says."""
        done = read(self._scope(scope) / "done.json")
        if done is None:
            return None
        if done["identity"] != self.identity:
            raise RunError(f"scope {scope} belongs to another run")
        table = self.spark.read.parquet(str(self._scope(scope) / done["table"]))
        if table_digest(table) != done["digest"]:
            raise RunError(f"the table of scope {scope} was changed")
        return table

    def claim(self, scope: str) -> int | None:
        """The number of a new attempt, or None while another session's is within its lease."""
        held = self.attempts(scope)
        open_ = [a for k, a in enumerate(held) if read(self._scope(scope) / f"failed-{k + 1:04d}.json") is None]
        if any(time.time() - a["begun"] < self.lease for a in open_ if a["session"] != self.spark.sparkContext.applicationId):
            return None
        n = len(held) + 1
        record = {"attempt": n, "begun": time.time(), "session": self.spark.sparkContext.applicationId, "identity": self.identity}
        return n if create(self._scope(scope) / f"attempt-{n:04d}.json", record) else None

    def run(self, scopes: dict[str, Callable[[], DataFrame]]) -> dict[str, DataFrame | None]:
        """The table of each scope, made here if it is neither finished nor claimed by another session (then None)."""
        out: dict[str, DataFrame | None] = {}
        for scope, make in scopes.items():
            if (table := self.table(scope)) is None and (n := self.claim(scope)) is not None:
                name = f"table-{n:04d}"
                try:
                    make().write.parquet(str(self._scope(scope) / name))
                except Exception as error:
                    create(self._scope(scope) / f"failed-{n:04d}.json", {"attempt": n, "error": f"{type(error).__name__}: {str(error)[:500]}"})
                    raise
                written = self.spark.read.parquet(str(self._scope(scope) / name))
                create(self._scope(scope) / "done.json", {"attempt": n, "table": name, "digest": table_digest(written), "identity": self.identity})
                table = self.table(scope)
            out[scope] = table
        return out

    def finished(self, scopes) -> set[str]:
        return {s for s in scopes if (self._scope(s) / "done.json").exists()}


def freeze(folder: str, selection: dict, evidence: dict) -> dict:
    """Fix a selection and what it was chosen by; once, for good.  The same selection again gives the same record."""
    record = {"kind": "selection", "selection": selection, "evidence": evidence}
    record["digest"] = digest(record)
    if not create(Path(folder) / "selection.json", record) and (held := read(Path(folder) / "selection.json"))["digest"] != record["digest"]:
        raise RunError(f"another selection was frozen: {held['digest']}")
    return read(Path(folder) / "selection.json")


def claim_locked_test(folder: str, selection: dict, groups: list[str]) -> dict:
    """Take the locked groups for the one test of the frozen selection; an error the second time, or for another selection."""
    frozen = read(Path(folder) / "selection.json")
    if frozen is None:
        raise RunError("no selection was frozen")
    if _canonical(frozen["selection"]) != _canonical(selection):
        raise RunError("the selection is not the frozen one")
    record = {"kind": "locked_test", "after": frozen["digest"], "groups": sorted(groups)}
    record["digest"] = digest(record)
    if not create(Path(folder) / "locked_test.json", record):
        raise RunError("the locked test was already claimed")
    return record


def record_locked_result(folder: str, metrics: dict) -> dict:
    """The result of the claimed test; once."""
    claim = read(Path(folder) / "locked_test.json")
    if claim is None:
        raise RunError("the locked test was not claimed")
    record = {"kind": "locked_result", "after": claim["digest"], "metrics": metrics}
    record["digest"] = digest(record)
    if not create(Path(folder) / "locked_result.json", record):
        raise RunError("the locked test has a result")
    return record


def broken_links(folder: str) -> list[str]:
    """Records whose digest is not their content's, or that do not follow the record before them."""
    found, before = [], None
    for name in ("selection", "locked_test", "locked_result"):
        record = read(Path(folder) / f"{name}.json")
        if record is None:
            continue
        body = {k: v for k, v in record.items() if k != "digest"}
        if digest(body) != record["digest"] or (before is not None and record.get("after") != before) or (name != "selection" and before is None):
            found.append(name)
        before = record["digest"]
    return found


def input_identity(tables: dict[str, DataFrame]) -> dict[str, str]:
    """A digest of the rows of each input, for an identity."""
    return {name: table_digest(t) for name, t in sorted(tables.items())}


def union_of(tables: dict[str, DataFrame | None], name: str) -> DataFrame:
    """All finished tables with the scope in a column; an error while one is missing."""
    missing = [k for k, t in tables.items() if t is None]
    if missing:
        raise RunError(f"scopes without a table: {', '.join(missing)}")
    out: DataFrame | None = None
    for scope, table in tables.items():
        named = table.withColumn(name, F.lit(scope))
        out = named if out is None else out.unionByName(named)
    return out
