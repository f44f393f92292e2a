"""Following a published dataset.

The reference system has no streams, so there are no windows or watermarks here; what it has is a server that notices
when the pointer moves. `follow` is that: one read of a small file, and a reload only when it names another generation.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import SparkSession

from ..sources.publish import current


class Follower:
    """The current generation of a root, loaded again when the pointer has moved; a generation that cannot be loaded leaves the one before in place, with the error as a marker."""

    def __init__(self, spark: SparkSession, root: str, load: Callable):
        self.spark, self.root, self.load = spark, root, load
        self.name: str | None = None
        self.generation = None
        self.rejected: tuple[str, str] | None = None

    def get(self):
        name = current(self.root)
        if name and name != self.name and (self.rejected or ("", ""))[0] != name:
            try:
                self.generation, self.name, self.rejected = self.load(self.spark, self.root), name, None
            except Exception as e:
                self.rejected = (name, str(e)[:200])
                if self.generation is not None:
                    self.generation.degraded = sorted({*self.generation.degraded, "reload_rejected"})
        return self.generation
