"""Immutable table versions behind an atomically replaced pointer, with a lock, idempotent calls and an event log.

``root/schema/table/v=N`` holds version N as parquet; ``CURRENT.json`` names the version in force.  Publishing writes a
new pointer and replaces the old one in one step, so a reader sees one version or the other and a crash leaves only an
orphan directory, which ``recover`` removes.  Undoing is pointing back.  The pointer lies on a shared file system.
"""

from __future__ import annotations

import contextlib
import fcntl
import hashlib
import json
import os
import re
import shutil
from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from tidemark.functions.hashing import Fingerprint, fingerprint, signature

IDENTIFIER = re.compile(r"^[A-Za-z][A-Za-z0-9_]{0,127}$")


class StoreError(ValueError):
    """A refused operation; ``code`` says why."""

    def __init__(self, code: str, message: str = ""):
        super().__init__(f"{code}: {message}" if message else code)
        self.code = code


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, Path(root)
        self.root.mkdir(parents=True, exist_ok=True)

    @contextlib.contextmanager
    def lock(self, name: str = "store") -> Iterator[None]:
        """Exclusive among all processes that share the root."""
        with open(self.root / f".{name}.lock", "w") as f:
            fcntl.flock(f, fcntl.LOCK_EX)
            yield

    def _dir(self, table: str) -> Path:
        parts = table.split(".")
        if len(parts) != 2 or not all(IDENTIFIER.match(p) for p in parts):
            raise StoreError("BAD_NAME", table)
        return self.root / parts[0].upper() / parts[1].upper()

    def pointer(self, table: str) -> dict:
        path = self._dir(table) / "CURRENT.json"
        if not path.exists():
            raise StoreError("NO_SUCH_TABLE", table)
        return json.loads(path.read_text())

    def exists(self, table: str) -> bool:
        return (self._dir(table) / "CURRENT.json").exists()

    def tables(self) -> list[str]:
        return sorted(f"{p.parent.parent.name}.{p.parent.name}" for p in self.root.glob("*/*/CURRENT.json"))

    def read(self, table: str, version: int | None = None) -> DataFrame:
        version = self.pointer(table)["version"] if version is None else version
        return self.spark.read.parquet(str(self._dir(table) / f"v={version}"))

    def write_version(self, table: str, df: DataFrame) -> int:
        """A new version, not yet in force."""
        home = self._dir(table)
        home.mkdir(parents=True, exist_ok=True)
        version = 1 + max([int(p.name[2:]) for p in home.glob("v=*")], default=0)
        df.write.parquet(str(home / f"v={version}"))
        return version

    def publish(self, table: str, version: int, key: str | None = None, mark: Fingerprint | None = None) -> dict:
        """Put a version in force; the previous pointer is kept inside the new one."""
        df = self.read(table, version)
        before = self.pointer(table) if self.exists(table) else None
        mark = mark or fingerprint(df)
        entry = {"version": version, "fingerprint": [str(mark.n), str(mark.s1), str(mark.s2)], "signature": signature(df), "key": key or (before or {}).get("key"), "previous": (before or {}).get("version")}
        path = self._dir(table) / "CURRENT.json"
        with open(tmp := path.with_suffix(".tmp"), "w") as f:
            json.dump(entry, f)
            f.flush()
            os.fsync(f.fileno())
        (path.parent / f"v={version}" / "_PUBLISHED").touch()  # a version once in force is kept, also when undone
        os.replace(tmp, path)
        return entry

    def create(self, table: str, df: DataFrame, key: str | None = None) -> dict:
        with self.lock():
            return self.publish(table, self.write_version(table, df), key)

    def fingerprint(self, table: str) -> Fingerprint:
        return Fingerprint(*map(int, self.pointer(table)["fingerprint"]))

    def rollback(self, table: str, version: int) -> dict:
        """Put an earlier version in force again."""
        if not (self._dir(table) / f"v={version}").exists():
            raise StoreError("NO_SUCH_VERSION", f"{table} v={version}")
        return self.publish(table, version)

    def insert(self, table: str, df: DataFrame, expected: int) -> dict:
        """Publish ``df`` as the table's next version if it has the expected number of rows; else nothing changes."""
        with self.lock():
            version = self.write_version(table, df)
            if (n := self.read(table, version).count()) != expected:
                shutil.rmtree(self._dir(table) / f"v={version}")
                raise StoreError("ROW_COUNT_MISMATCH", f"{table}: {n} of {expected}")
            return self.publish(table, version)

    def reseed(self, table: str, seed: DataFrame, key: str | None = None) -> Fingerprint:
        """Put a seed in force as a new version; earlier versions stay."""
        with self.lock():
            self.publish(table, self.write_version(table, seed), key)
        return self.fingerprint(table)

    def clear_run_state(self, keep: tuple[str, ...] = ("precedents",)) -> int:
        """Forget logs, stored calls and branches, as a switch of datasets does; returns how many files went."""
        gone = [p for p in [*self.root.glob("*.jsonl"), *self.root.glob("_calls/*.json"), *self.root.glob("_control.json")] if p.stem not in keep]
        for p in gone:
            p.unlink()
        shutil.rmtree(self.root / "_branches", ignore_errors=True)
        return len(gone)

    def drop(self, table: str) -> None:
        shutil.rmtree(self._dir(table), ignore_errors=True)

    def recover(self, keep: int = 1000) -> list[str]:
        """Remove versions that were written but never put in force; returns their paths."""
        gone = []
        with self.lock():
            for path in self.root.glob("*/*/CURRENT.json"):
                last = json.loads(path.read_text())["version"]
                for p in path.parent.glob("v=*"):
                    if int(p.name[2:]) > last and not (p / "_PUBLISHED").exists():
                        shutil.rmtree(p)
                        gone.append(str(p))
        return gone[:keep]

    # calls that are made once, whatever happens
    @staticmethod
    def call_key(run_id: str, tool: str, args: dict) -> str:
        text = json.dumps(args, sort_keys=True, separators=(",", ":"), default=str)
        return hashlib.sha256(f"{run_id}|{tool}|{text}".encode()).hexdigest()

    def once(self, key: str, call: Callable[[], dict]) -> dict:
        """The stored result of an earlier call with this key, or the call's own, stored."""
        path = self.root / "_calls" / f"{key}.json"
        path.parent.mkdir(exist_ok=True)
        with self.lock(f"call-{key}"):  # claimed before the call: who comes meanwhile waits and gets the result
            if path.exists():
                return json.loads(path.read_text()) | {"replayed": True}
            result = call()
            tmp = path.with_suffix(".tmp")
            tmp.write_text(json.dumps(result, default=str))
            os.replace(tmp, path)
            return result

    def log(self, name: str, row: dict) -> None:
        """Append a row to a control log; a sink that fails never breaks the caller."""
        with contextlib.suppress(OSError), self.lock("log"), open(self.root / f"{name}.jsonl", "a") as f:
            f.write(json.dumps(row, default=str) + "\n")

    def rows(self, name: str) -> list[dict]:
        path = self.root / f"{name}.jsonl"
        return [json.loads(x) for x in path.read_text().splitlines()] if path.exists() else []
