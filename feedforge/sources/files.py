"""Files of the landing area through Hadoop's file systems: whether they are there, which name they have, putting them in place whole.

Also settings from the environment, which a .env file can fill in.
"""

from __future__ import annotations

import os
import time
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import SparkSession

from ..operators.ingest import hour_key


def load_settings(path: str) -> dict[str, str]:
    """NAME=VALUE lines of a file, put in the environment where the name isn't set yet; blank lines and comments don't count. A missing file has none."""
    if not os.path.exists(path):
        return {}
    with open(path, encoding="utf-8") as f:
        pairs = [line.strip().partition("=") for line in f if "=" in line and not line.lstrip().startswith("#")]
    return {name.strip(): os.environ.setdefault(name.strip(), value.strip()) for name, _, value in pairs}


def _located(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    store, at = _located(spark, path)
    return store.exists(at)


def put(spark: SparkSession, source: str, target: str) -> str:
    """Copy a file under a temporary name, then rename it: readers see all of it or nothing. A file of that name is replaced; a failed copy leaves nothing."""
    from_store, there = _located(spark, source)
    store, part = _located(spark, target + ".part")
    final = spark._jvm.org.apache.hadoop.fs.Path(target)
    try:
        spark._jvm.org.apache.hadoop.fs.FileUtil.copy(from_store, there, store, part, False, True, spark._jsc.hadoopConfiguration())
        store.delete(final, False)
        if not store.rename(part, final):
            raise OSError(f"{target} can't be put in place")
    finally:
        store.delete(part, False)
    return target


def resolve(spark: SparkSession, landing: str, at: datetime) -> str | None:
    """The file of an hour by its usual names (folders by date parts, by day and hour, none), else the first by name in the day's folder; None if there is none."""
    name, day = f"{hour_key(at)}.json.gz", f"{landing}/{at:%Y/%m/%d}"
    for path in (f"{day}/{name}", f"{landing}/{at:%Y-%m-%d}/{at.hour}/{name}", f"{landing}/{name}"):
        if exists(spark, path):
            return path
    store, pattern = _located(spark, f"{day}/*-{at.hour}.json.gz*")
    return min((s.getPath().toString() for s in store.globStatus(pattern) or []), default=None)


def wait_until(ready: Callable[[], bool], every: float = 300, at_most: float = 7200, sleep: Callable[[float], None] = time.sleep) -> bool:
    """Ask until the answer is yes (True) or time is up (False). A network error counts as no."""
    waited = 0.0
    while True:
        try:
            if ready():
                return True
        except OSError:
            pass
        if waited >= at_most:
            return False
        sleep(every)
        waited += every
