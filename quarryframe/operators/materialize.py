"""The immutable tables of a generation, derived from files, symbols and relationships; result caches; sanitised diagnostics.

Equal rows are one (the first by extractor); nulls in a part of an identity give no row; an empty identity gets its default.
"""

from __future__ import annotations

import hashlib
import threading
from collections import OrderedDict
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import digest, prefixed


def nodes(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """(entity_id, kind, label, path): one node per file and per symbol of a file, by digest of generation, kind, identity and path."""
    f = files.select("generation_id", F.lit("file").alias("kind"), F.col("path").alias("label"), F.concat_ws(":", F.lit("file"), "path").alias("identity"), "path")
    own = F.when(F.coalesce("identity", F.lit("")) == "", F.concat_ws(":", F.lit("syntax"), "path", "kind", "name", F.col("start_byte").cast("string"))).otherwise(F.col("identity"))
    s = symbols.select("generation_id", F.concat(F.lit("symbol:"), "kind").alias("kind"), F.col("name").alias("label"), own.alias("identity"), "path")
    both = f.unionByName(s.join(files.select("generation_id", "path").distinct(), ["generation_id", "path"], "left_semi").select(*f.columns))
    return both.select(prefixed("e-", "generation_id", "kind", "identity", "path").alias("entity_id"), "kind", "label", "path").where("entity_id is not null").distinct()


def not_indexed(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """(path, symbols): symbols of paths that the manifest doesn't have."""
    return symbols.join(files.select("generation_id", "path").distinct(), ["generation_id", "path"], "left_anti").groupBy("path").agg(F.count("*").alias("symbols"))


def sanitized(diagnostics: DataFrame, allowed: tuple[str, ...]) -> DataFrame:
    """(code, path_hash, events): codes outside the allowed ones are 'other', paths are told by a short hash."""
    path = F.when(F.col("path") != "", F.concat(F.lit("h_"), F.substring(F.sha2("path", 256), 1, 24))).otherwise("")
    return diagnostics.groupBy(F.when(F.col("code").isin(*allowed), F.col("code")).otherwise("other").alias("code"), path.alias("path_hash")).agg(F.count("*").alias("events"))


def evicted(entries: DataFrame, key: str, at: str, size: str, most_rows: int, most_bytes: int) -> DataFrame:
    """Entries that a cache drops, oldest first, until both bounds hold; sums are per day first, so that no task holds all entries."""
    day = F.to_date(F.col(at))
    e = entries.select(F.col(key).alias("key"), F.col(at).alias("at"), F.col(size).cast("long").alias("size"), day.alias("day"))
    per = e.groupBy("day").agg(F.count("*").alias("n"), F.sum("size").alias("s"))
    newer = Window.orderBy(F.desc("day")).rowsBetween(Window.unboundedPreceding, -1)
    base = per.select("day", F.coalesce(F.sum("n").over(newer), F.lit(0)).alias("n0"), F.coalesce(F.sum("s").over(newer), F.lit(0)).alias("s0"))
    w = Window.partitionBy("day").orderBy(F.desc("at"), F.desc("key")).rowsBetween(Window.unboundedPreceding, 0)
    rows = e.withColumn("n1", F.count("*").over(w)).withColumn("s1", F.sum("size").over(w)).join(base, "day")
    return rows.where((F.col("n0") + F.col("n1") > most_rows) | (F.col("s0") + F.col("s1") > most_bytes)).select("key")


class ResultCache:
    """Results by fingerprint, least recently used first out; a key that is being computed is computed once."""

    def __init__(self, most: int = 2048) -> None:
        self.most, self._items, self._lock, self._busy = most, OrderedDict(), threading.Lock(), {}
        self.hits = self.misses = 0

    @staticmethod
    def fingerprint(*parts: str) -> str:
        return hashlib.sha256("\0".join(parts).encode()).hexdigest()

    def get(self, key: str, compute: Callable[[], Any]) -> Any:
        while True:
            with self._lock:
                if key in self._items:
                    self._items.move_to_end(key)
                    self.hits += 1
                    return self._items[key]
                other = self._busy.get(key)
                if other is None:
                    mine = self._busy[key] = threading.Event()
                    self.misses += 1
            if other is not None:
                other.wait()
                continue
            try:
                value = compute()
                with self._lock:
                    self._items[key] = value
                    while len(self._items) > self.most:
                        self._items.popitem(last=False)
                return value
            finally:
                with self._lock:
                    del self._busy[key]
                mine.set()

    def drop(self, matches: Callable[[str], bool]) -> int:
        with self._lock:
            gone = [k for k in self._items if matches(k)]
            for k in gone:
                del self._items[k]
            return len(gone)


__all__ = ["ResultCache", "digest", "evicted", "nodes", "not_indexed", "sanitized"]
