"""Folders of a stream's output that are merged as they grow in number, under committed manifests.

Every micro-batch adds one folder of level 0. Folders of one level are merged into one of the next
level, as digits of a binary counter are carried, so after n micro-batches at most log2(n) + 1 folders
are left and a row has been rewritten at most log2(n) times. A manifest per micro-batch names the
folders that count. It is written last, and a repeated micro-batch starts from the manifest before its
own, whose folders stay until the micro-batch after the next.
"""

import json

from pyspark.sql import DataFrame, SparkSession

from ..plans.sizing import discard, paths_in, read_text, write_text


def carried(folders: list[tuple[int, str]], name: str) -> tuple[list[tuple[int, str]], list[str]]:
    """(folders that stay, those that are merged with the new one) when `name` is added at level 0."""
    stay, level = list(folders), 0
    merged = []
    while stay and stay[-1][0] == level:
        merged.append(stay.pop()[1])
        level += 1
    return [*stay, (level, name)], merged


class CompactedFolder:
    """Folders of rows under `root`, one micro-batch after the other."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def _read(self, batch_id: int) -> list[tuple[int, str]]:
        text = read_text(self.spark, f"{self.root}/manifest/{batch_id}.json")
        return [(level, name) for level, name in json.loads(text)]

    def committed(self, before: int | None = None) -> int | None:
        """The number of the newest manifest, or of the newest one in front of `before`."""
        found = paths_in(self.spark, f"{self.root}/manifest/*.json")
        numbers = [int(path.split("/")[-1].removesuffix(".json")) for path in found]
        return max((n for n in numbers if before is None or n < before), default=None)

    def folders(self, batch_id: int | None) -> list[tuple[int, str]]:
        return [] if batch_id is None else self._read(batch_id)

    def paths(self) -> list[str]:
        """The folders that count."""
        return [f"{self.root}/rows/{name}" for _, name in self.folders(self.committed())]

    def add(self, batch_id: int, rows: DataFrame, merge) -> None:
        """Add the rows of a micro-batch. `merge` makes one table of the union of several."""
        last = self.committed(batch_id)
        before = self.folders(last)
        stay, merged = carried(before, str(batch_id))
        if merged:
            paths = [f"{self.root}/rows/{name}" for name in merged]
            old = self.spark.read.schema(rows.schema).parquet(*paths)
            rows = merge(old.unionByName(rows))
        rows.write.mode("overwrite").parquet(f"{self.root}/rows/{batch_id}")
        write_text(self.spark, f"{self.root}/manifest/{batch_id}.json", json.dumps(stay))
        # What the manifest before named may be read again, what only older ones named may not.
        if last is not None:
            older = self.committed(last)
            named = {name for _, name in [*before, *stay]}
            gone = [name for _, name in self.folders(older) if name not in named]
            discard(self.spark, *[f"{self.root}/rows/{name}" for name in gone])
            if older is not None:
                discard(self.spark, f"{self.root}/manifest/{older}.json")
