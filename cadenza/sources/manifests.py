"""Versions of a stored table: small files, each naming what the table consists of.

A new version is put in place in one rename.  Whoever finds the number taken starts
again from the version that took it, so writers and compactions may run side by side.
Object stores without an atomic rename need a table format in place of this.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import SparkSession

from cadenza.sources import files

FOLDER = "_manifests"


@dataclass(frozen=True)
class Manifests:
    spark: SparkSession
    path: str

    def versions(self) -> list[int]:
        return [int(n[2:]) for n in files.names(self.spark, f"{self.path}/{FOLDER}") if n[:2] == "v="]

    def load(self, version: int | None = None) -> dict | None:
        """The newest version, or the one asked for."""
        if version is None:
            known = self.versions()
            if not known:
                return None
            version = known[-1]
        return json.loads(files.read_text(self.spark, f"{self.path}/{FOLDER}/v={version:012d}"))

    def commit(self, change: Callable[[dict | None], dict | None]) -> dict | None:
        """Make ``change`` of the newest version the next one; None if it has nothing to do."""
        while True:
            old = self.load()
            new = change(old)
            if new is None:
                return None
            new = {**new, "version": old["version"] + 1 if old else 1}
            if files.publish(self.spark, f"{self.path}/{FOLDER}", f"v={new['version']:012d}", json.dumps(new)):
                return new

    def expire(self, keep: int, segments: Callable[[dict], set[str]], folder: str) -> None:
        """Forget all but the newest ``keep`` versions, and delete the segments only those had."""
        known = self.versions()
        needed = set().union(*(segments(self.load(v)) for v in known[-keep:]))
        for version in known[:-keep]:
            for segment in segments(self.load(version)) - needed:
                files.delete(self.spark, f"{self.path}/{folder}={segment}")
            files.delete(self.spark, f"{self.path}/{FOLDER}/v={version:012d}")


def batch_of(spark: SparkSession, batch_id: int) -> tuple[str, str]:
    """Under what a micro-batch is known: its stream, and the name of its segment.

    Batches of a stream come in order; calls outside of streams are known one by one.
    """
    run = files.current_run(spark) or f"batch-{batch_id}"
    return run, f"c-{run}-{batch_id:012d}"


def is_applied(known: dict | None, run: str, batch_id: int) -> bool:
    return known is not None and known["applied"].get(run, -1) >= batch_id


def with_applied(known: dict, run: str, batch_id: int) -> dict:
    return {**known["applied"], run: max(batch_id, known["applied"].get(run, -1))}
