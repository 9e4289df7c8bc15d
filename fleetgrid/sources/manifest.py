"""A small document in numbered versions, replaced in one step."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import SparkSession

from fleetgrid.sources.files import file_names, read_text, remove, write_new_text

# Versions that stay readable.
KEPT = 3


class Manifest:
    """What is live below a folder. Readers take the newest version; there is one writer at a time.

    A version appears whole by a rename, so a reader sees the old one or the new one. A second writer that
    started from the same version fails.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path

    def newest(self) -> tuple[int, dict[str, Any]]:
        """Number and content of the newest version; 0 and nothing before the first."""
        versions = self._versions()
        if not versions:
            return 0, {}
        return versions[-1], json.loads(read_text(self.spark, self._file(versions[-1])))

    def replace(self, version: int, content: dict[str, Any]) -> None:
        """Make ``content`` the version after ``version``."""
        write_new_text(self.spark, self._file(version + 1), json.dumps(content, sort_keys=True))
        for old in self._versions()[:-KEPT]:
            remove(self.spark, self._file(old))

    def _versions(self) -> list[int]:
        names = file_names(self.spark, self.path)
        return sorted(int(name[1:-5]) for name in names if name.startswith("v") and name.endswith(".json"))

    def _file(self, version: int) -> str:
        return f"{self.path}/v{version:012}.json"
