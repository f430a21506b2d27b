"""Partitions that are written once, snapshots of them, and a window that can be read once.

Rows are Parquet, written and checked by Spark; manifests are small files made on the driver, so the root is a folder
that the driver can reach by path.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from datetime import UTC, date, datetime
from functools import reduce
from pathlib import Path
from typing import Any, TypeVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.documents import accept, create_only, digest
from tidemark.operators.quality import conflicts
from tidemark.sources.market import file_hashes

T = TypeVar("T")
KEY = ["instrument_id", "timestamp"]


def _manifest(root: str | Path, kind: str, name: str) -> Path:
    if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9._-]*", name):
        raise ValueError(f"unsupported name: {name!r}")
    return Path(root) / kind / f"{name}.json"


def _hashes(spark: SparkSession, folder: Path) -> list[dict[str, str]]:
    rows = file_hashes(spark, f"{folder}/*.parquet").collect()  # one row per file
    return sorted(({"path": r.path.rpartition("/")[2], "sha256": r.sha256} for r in rows), key=lambda r: r["path"])


def ingest(root: str | Path, partition: str, chunks: list[DataFrame], about: dict[str, Any]) -> dict[str, Any]:
    """Write chunks as one partition, equal repeats once; different rows of one key, or an existing partition, are errors.

    The manifest comes last, so a partition without one is unfinished and is replaced by the next try.
    """
    target = _manifest(root, "partitions", partition)
    if target.exists():
        raise FileExistsError(f"partition exists: {partition}")
    if not chunks or not set(KEY) <= set(chunks[0].columns):
        raise ValueError("chunks with instrument_id and timestamp are needed")
    if any(set(c.columns) != set(chunks[0].columns) for c in chunks):
        raise ValueError("chunks differ in columns")
    rows, folder = reduce(DataFrame.unionByName, chunks), Path(root) / "rows" / partition
    if twice := conflicts(rows, KEY).limit(1).collect():
        raise ValueError(f"different rows of one key: {twice[0][:2]}")
    rows.dropDuplicates().sortWithinPartitions(*KEY).write.mode("overwrite").parquet(str(folder))
    spark = rows.sparkSession
    got = spark.read.parquet(str(folder)).agg(F.count("*").alias("n"), F.min("timestamp").cast("string").alias("first"), F.max("timestamp").cast("string").alias("last")).first()
    found = {"schema_version": 1, "kind": "partition", "partition_id": partition, **about, "schema": rows.columns, "rows": got.n, "first": got["first"], "last": got["last"], "files": _hashes(spark, folder)}
    create_only(target, json.dumps(found, sort_keys=True, indent=1))
    return found


def publish(root: str | Path, snapshot: str, partitions: list[str]) -> dict[str, Any]:
    """A snapshot: the manifests of its partitions, and a hash over all; an existing one is an error."""
    if not partitions:
        raise ValueError("a snapshot needs a partition")
    held = [json.loads(_manifest(root, "partitions", p).read_text()) for p in sorted(set(partitions))]
    found = {"schema_version": 1, "kind": "snapshot", "snapshot_id": snapshot, "partitions": held}
    found["manifest_sha256"] = digest(found)
    create_only(_manifest(root, "snapshots", snapshot), json.dumps(found, sort_keys=True, indent=1))
    return found


def resolve(root: str | Path, snapshot: str) -> dict[str, Any]:
    """A snapshot's manifest, its hash tested."""
    found = json.loads(_manifest(root, "snapshots", snapshot).read_text())
    if digest({k: v for k, v in found.items() if k != "manifest_sha256"}) != found["manifest_sha256"]:
        raise ValueError(f"the hash of snapshot {snapshot} differs")
    return found


def read(spark: SparkSession, root: str | Path, snapshot: str, verify: bool = True) -> DataFrame:
    """Rows of a snapshot; with verify, its files are hashed first."""
    held = resolve(root, snapshot)["partitions"]
    folders = [Path(root) / "rows" / p["partition_id"] for p in held]
    if verify and (bad := [p["partition_id"] for p, f in zip(held, folders, strict=True) if _hashes(spark, f) != p["files"]]):
        raise ValueError(f"files differ: {', '.join(bad)}")
    return reduce(DataFrame.unionByName, (spark.read.parquet(str(f)) for f in folders))


def read_once(folder: str | Path, protocol: dict, experiment: str, load: Callable[[date, date], T], reader: str = "unknown", today: date | None = None) -> T:
    """What load gives for the protocol's retention window. It counts as read even if load fails; a second try is an error."""
    own = accept(protocol, "protocol")
    today = today or datetime.now(UTC).date()
    if today < date.fromisoformat(protocol["retention_available_after"]):
        raise PermissionError(f"not to be read before {protocol['retention_available_after']}")
    window = protocol["date_windows"]["retention"]
    note = {"protocol_id": protocol["protocol_id"], "protocol_hash": own, "experiment_id": experiment, "reader": reader, "window": window, "read_at": datetime.now(UTC).isoformat()}
    create_only(_manifest(folder, protocol["protocol_id"], experiment), json.dumps(note, sort_keys=True, indent=1))
    return load(date.fromisoformat(window["start"]), date.fromisoformat(window["end"]))
