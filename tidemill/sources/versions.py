"""Versioned products: every write is a new folder, a commit log says which one counts.

A branch is a log of its own, one file for each commit, named by its number. A commit takes the
next number by creating that file, which fails if another writer was first; then it looks at
the new head and tries again. So two writers never take one number, and a reader sees a commit
whole or not at all. A new branch begins with the head it came from; merging is a commit, too.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.session import PARQUET, delete_path, list_files, path_exists
from tidemill.sources import atomic
from tidemill.sources.files import read_product

LOG_SCHEMA = (
    "commit_id string, seq bigint, product string, path string, num_rows bigint, "
    "num_columns int, content_hash string, metadata map<string,string>, committed_at string, "
    "parent string"
)


def content_hash(df: DataFrame) -> Column:
    """Order-free hash of all rows; null flags tell (null, x) from (x, null).

    A decimal sum neither overflows nor cancels duplicate rows.
    """
    columns = []
    for item in df.schema.fields:
        value = F.col(f"`{item.name}`")
        hashed = F.to_json(value) if _holds_map(item.dataType) else value
        columns += [hashed, value.isNull()]
    return F.coalesce(
        F.sum(F.xxhash64(*columns).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")
    )


def _holds_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(_holds_map(item.dataType) for item in kind.fields)
    if isinstance(kind, T.ArrayType):
        return _holds_map(kind.elementType)
    return isinstance(kind, T.MapType)


class NotFound(FileNotFoundError):
    """No such product, branch or commit."""


class Conflict(RuntimeError):
    """Another commit came first and the caller has to decide."""


@dataclass(frozen=True)
class Repository:
    """Versioned products below one folder. Any number of drivers may commit."""

    spark: SparkSession
    base: str
    extra: dict = field(default_factory=dict)

    def _log_path(self, product: str, branch: str = "main") -> str:
        if not branch or "/" in branch or branch.startswith(("_", ".")):
            raise ValueError(f"not a branch name: {branch!r}")
        return f"{self.base}/{product}/_log/{branch}"

    def _entries(self, product: str, branch: str = "main", last: int | None = None) -> list[dict]:
        folder = self._log_path(product, branch)
        found = atomic.numbers(self.spark, folder)
        return atomic.read_entries(self.spark, folder, found if last is None else found[-last:])

    def log(self, product: str, branch: str = "main") -> DataFrame:
        """All commits of a branch, oldest first. One small row per commit."""
        names = [part.split()[0] for part in LOG_SCHEMA.split(", ")]
        rows = [tuple(entry.get(name) for name in names) for entry in self._entries(product, branch)]
        return self.spark.createDataFrame(rows, LOG_SCHEMA)

    def head(self, product: str, branch: str = "main") -> dict | None:
        """The newest commit; reads the log's last file only."""
        found = self._entries(product, branch, last=1)
        return found[0] if found else None

    def branches(self, product: str) -> list[str]:
        """Names of the product's branches, sorted."""
        folder = f"{self.base}/{product}/_log"
        if not path_exists(self.spark, folder):
            return []
        return list_files(self.spark, folder)

    def branch(self, product: str, name: str, source: str = "main") -> dict:
        """Start a branch at a commit or at another branch's head; nothing is copied."""
        commit = self._commit(product, source)
        if atomic.numbers(self.spark, self._log_path(product, name)) or not atomic.append_entry(
            self.spark, self._log_path(product, name), commit, commit["seq"]
        ):
            raise Conflict(f"{product} has a branch {name} already")
        return commit

    def merge(self, product: str, source: str, into: str = "main") -> dict:
        """Let `into` point to what `source` has; refused if `into` went on since they parted."""
        ours, theirs = self.head(product, into), self._commit(product, source)
        if ours is None:
            raise NotFound(f"{product} has no branch {into}")
        if ours["commit_id"] == theirs["commit_id"]:
            return {**ours, "committed": False}
        line = {entry["commit_id"] for entry in self._entries(product, source)}
        if ours["commit_id"] not in line:
            raise Conflict(f"{product}: {into} has commits that {source} does not know")
        merged = {**theirs, "parent": ours["commit_id"]}
        if not atomic.append_entry(self.spark, self._log_path(product, into), merged, ours["seq"] + 1):
            raise Conflict(f"{product}: {into} went on during the merge")
        return {**merged, "seq": ours["seq"] + 1, "committed": True}

    def write(
        self, df: DataFrame, product: str, run_id: str = "", branch: str = "main", expected: str | None = None, **metadata
    ) -> dict:
        """Write and commit; without a change in content there is no new commit.

        The count and the hash are taken while the rows are written, so the frame is worked
        out once. If other writers commit meanwhile, the commit is placed behind theirs;
        with `expected`, the commit id the rows were made from, it is refused instead. A
        crash before the commit leaves a folder that no commit names.
        """
        commit_id = uuid.uuid4().hex
        path = f"{self.base}/{product}/v={commit_id}"
        seen = Observation()
        observed = df.observe(
            seen, F.count(F.lit(1)).alias("rows"), content_hash(df).alias("hash")
        )
        observed.write.options(**PARQUET).parquet(path)
        schema_tag = df.schema.simpleString()
        found = f"{seen.get['hash']}:{seen.get['rows']}:{schema_tag}"
        notes = {"run_id": run_id, "product": product, **metadata}
        row = {
            "commit_id": commit_id,
            "product": product,
            "path": path,
            "num_rows": seen.get["rows"],
            "num_columns": len(df.columns),
            "content_hash": found,
            "metadata": {name: str(value) for name, value in notes.items()},
            "committed_at": datetime.now(timezone.utc).isoformat(),
        }
        while True:
            head = self.head(product, branch)
            known = None if head is None else head["commit_id"]
            if expected is not None and expected != known:
                delete_path(self.spark, path)
                raise Conflict(f"{product}: {branch} is at {known}, not at {expected}")
            if head is not None and head["content_hash"] == found:
                delete_path(self.spark, path)
                return {**head, "committed": False}
            seq = 0 if head is None else head["seq"] + 1
            if atomic.append_entry(self.spark, self._log_path(product, branch), {**row, "parent": known}, seq):
                return {**row, "seq": seq, "parent": known, "committed": True}

    def _commit(self, product: str, ref: str) -> dict:
        names = self.branches(product)
        if ref in names:
            return self.head(product, ref)
        for name in names:
            for entry in self._entries(product, name):
                if entry["commit_id"] == ref:
                    return entry
        raise NotFound(f"{product} not found at {ref}. Run the job that writes it first.")

    def read(self, product: str, ref: str = "main") -> DataFrame:
        """The product at a branch's newest commit or at a commit id."""
        return read_product(self.spark, self._commit(product, ref)["path"])
