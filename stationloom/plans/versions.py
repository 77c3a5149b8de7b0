"""Stored folders that change as a whole.

What is saved goes into a new version of the folder. A manifest, written last and renamed into place, makes
the version count, so a save that dies half-way, or a driver lost in it, leaves the version before in force.
Readers take the newest version with a manifest; those loaded before aren't touched.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession

VERSIONS, MANIFESTS = "versions", "manifests"


def _file_system(path: str):
    spark = SparkSession.active()
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def _names(path: str) -> list[str]:
    fs, target = _file_system(path)
    return sorted(s.getPath().getName() for s in fs.listStatus(target)) if fs.exists(target) else []


def committed(folder: str, write: Callable[[str], None]) -> str:
    """Let ``write`` fill the folder of a new version, then make that version count; its path comes back."""
    started = [int(name.split("-")[0]) for name in _names(f"{folder}/{VERSIONS}")]
    version = f"{max(started, default=0) + 1:08d}-{uuid.uuid4().hex[:8]}"
    path = f"{folder}/{VERSIONS}/{version}"
    write(path)
    fs, draft = _file_system(f"{folder}/{MANIFESTS}/_{version}")
    out = fs.create(draft, True)
    try:
        out.write(json.dumps({"version": version, "parts": _names(path)}).encode())
    finally:
        out.close()
    if not fs.rename(draft, _file_system(f"{folder}/{MANIFESTS}/{version}")[1]):
        raise OSError(f"the manifest of version {version} in {folder!r} could not be put in place")
    return path


def versions(folder: str) -> list[str]:
    """Names of the whole versions of a folder, oldest first."""
    return [name for name in _names(f"{folder}/{MANIFESTS}") if name[0] not in "_."]


def current(folder: str, version: str | None = None) -> str:
    """Path of the newest whole version, or of the named one."""
    whole = versions(folder)
    if version is not None and version not in whole:
        raise FileNotFoundError(f"no whole version {version!r} in {folder!r}")
    if not whole:
        raise FileNotFoundError(f"nothing stored at {folder!r}")
    return f"{folder}/{VERSIONS}/{version or whole[-1]}"
