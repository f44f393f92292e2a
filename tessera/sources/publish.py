"""Generations: immutable folders of tables, with a manifest written last and a pointer that is moved in one step.

All of it goes through the file system that the root's path names, so that tables, manifest and pointer lie together on a
cluster's store.
"""

from __future__ import annotations

import hashlib
import json
import secrets
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession

from ..model import Graph
from ..operators.graph import fold
from ..operators.validate import manifest_errors
from .storage import Storage

KEEP = 2
POINTER = "CURRENT"
HASHES = "artifact_sha256"


def generation_id(content_hash: str, now: datetime | None = None) -> str:
    """Sorts by time; no two are equal."""
    return f"{(now or datetime.now(UTC)):%Y%m%dT%H%M%SZ}-{content_hash[:8]}-{secrets.token_hex(3)}"


def table_hash(df: DataFrame) -> str:
    """A digest of a table's rows, whatever their order and files."""
    return fold(df).first()["digest"]


def output_hash(g: Graph) -> str:
    """Of all rows of a graph, whatever their order; one pass, with sums as the only thing shuffled."""
    return hashlib.sha256(json.dumps([table_hash(g.nodes), table_hash(g.edges)]).encode()).hexdigest()


def write(root: str, name: str, tables: dict[str, DataFrame], manifest: dict) -> str:
    """Writes a generation's tables, then its manifest with a digest of each; without all of the manifest's keys nothing is written."""
    manifest = {"generation_id": name, **manifest}
    if errors := manifest_errors(manifest):
        raise ValueError("; ".join(errors))
    s = Storage(f"{root}/generations/{name}")
    hashes = {}
    for t, df in tables.items():
        df.write.mode("overwrite").parquet(s.at(t))
        hashes[t] = table_hash(df.sparkSession.read.parquet(s.at(t)))
    s.write(".manifest", json.dumps({**manifest, "tables": sorted(tables), HASHES: hashes}, sort_keys=True))
    s.replace(".manifest", "manifest.json")
    return s.root


def flip(root: str, name: str) -> None:
    """Moves the pointer; readers see the old or the new generation, never a part."""
    s = Storage(root)
    if not s.exists(f"generations/{name}/manifest.json"):
        raise ValueError(f"{name} is not complete")
    tmp = f".{POINTER}.{secrets.token_hex(4)}"
    s.write(tmp, name)
    s.replace(tmp, POINTER)


def current(root: str) -> str | None:
    text = Storage(root).read(POINTER)
    return text.strip() if text else None


def artifact_errors(spark: SparkSession, root: str, name: str, manifest: dict) -> list[str]:
    """What does not hold of a generation's tables against the digests in its manifest: listed and missing, there and not listed, or with other rows. A manifest without digests is not held against any."""
    want = manifest.get(HASHES)
    if not isinstance(want, dict):
        return []
    s = Storage(f"{root}/generations/{name}", spark)
    there = {x for x in s.names() if not x.startswith((".", "_")) and x != "manifest.json"}
    errors = [f"{t}: listed and missing" for t in sorted(set(want) - there)] + [f"{t}: there and not listed" for t in sorted(there - set(want))]
    return errors + [f"{t}: other rows than listed" for t in sorted(there & set(want)) if table_hash(spark.read.parquet(s.at(t))) != want[t]]


def read(spark: SparkSession, root: str, name: str | None = None, verify: bool = False) -> tuple[dict[str, DataFrame], dict]:
    """The tables and manifest of a generation, by default the current one; counts that do not hold are an error, and with verify digests that do not hold."""
    name = name or current(root)
    if not name:
        raise FileNotFoundError("no generation is published")
    s = Storage(f"{root}/generations/{name}", spark)
    manifest = json.loads(s.read("manifest.json") or "null")
    if manifest is None:
        raise FileNotFoundError(f"{name} has no manifest")
    if verify and (errors := artifact_errors(spark, root, name, manifest)):
        raise ValueError(f"{name}: {'; '.join(errors)}")
    tables = {t: spark.read.parquet(s.at(t)) for t in manifest["tables"] if s.exists(t)}
    if missing := sorted(set(manifest["tables"]) - set(tables)):
        raise ValueError(f"{name}: no table {', '.join(missing)}")
    for t, k in (("nodes", "output_node_count"), ("edges", "output_edge_count")):
        if t in tables and tables[t].count() != manifest[k]:
            raise ValueError(f"{name}: {t} has not {manifest[k]} rows")
    return tables, manifest


def prune(root: str, keep: int = KEEP) -> list[str]:
    """Removes all but the newest complete generations and the current one; incomplete ones go and never count."""
    s = Storage(root)
    pinned, gone, left = current(root), [], 0
    for name in sorted(s.names("generations"), reverse=True):
        complete = s.exists(f"generations/{name}/manifest.json")
        if name == pinned:
            left += complete
        elif complete and left < keep:
            left += 1
        else:
            s.delete(f"generations/{name}")
            gone.append(name)
    return gone
