"""A table kept as a compacted base and a short tail of newer parts, switched by one small snapshot file.

Parts are numbered upwards by their writer, for a stream by its batch. A part counts once its snapshot is in place; a number
that counts already is not written again, so a batch or delta that is repeated changes nothing. When the tail is long, base and
tail are merged to a new base. A reader opens the base and at most `most` parts, however many there have been. Files that a
snapshot no longer names stay until the next merge, so readers can finish. There is one writer at a time.
"""

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SNAPSHOTS_KEPT = 3
NOTHING = {"snapshot": 0, "number": -1, "base": None, "tail": [], "old": []}


@dataclass(frozen=True)
class Log:
    """A folder that all executors share. `merge` folds stored rows, with their `version`, to fewer rows of the same columns."""

    spark: SparkSession
    folder: str
    merge: Callable[[DataFrame], DataFrame]
    most: int = 16

    def _path(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _snapshots(self) -> list[str]:
        path, files = self._path("snapshots")
        if not files.exists(path):
            return []
        return sorted(s.getPath().getName() for s in files.listStatus(path) if s.getPath().getName().endswith(".json"))

    def state(self) -> dict:
        """The newest snapshot."""
        names = self._snapshots()
        if not names:
            return NOTHING
        return json.loads(self.spark.read.text(f"{self.folder}/snapshots/{names[-1]}", wholetext=True).first()[0])

    def _switch(self, now: dict, **changed) -> None:
        """Puts a new snapshot in place by a rename and forgets all but the last few."""
        new = {**now, **changed, "snapshot": now["snapshot"] + 1}
        target, files = self._path(f"snapshots/{new['snapshot']:012d}.json")
        draft, _ = self._path(f"drafts/{uuid.uuid4().hex}")
        out = files.create(draft)
        out.write(bytearray(json.dumps(new).encode()))
        out.close()
        files.mkdirs(target.getParent())
        if not files.rename(draft, target):
            raise RuntimeError(f"another writer has put {target} in place")
        for name in self._snapshots()[:-SNAPSHOTS_KEPT]:
            files.delete(self._path(f"snapshots/{name}")[0], False)

    def append(self, number: int, rows: DataFrame) -> bool:
        """Adds a part unless a part of that or a later number counts already."""
        now = self.state()
        if number <= now["number"]:
            return False
        path = f"parts/{uuid.uuid4().hex}"
        rows.withColumn("version", F.lit(number).cast("long")).write.parquet(f"{self.folder}/{path}")
        self._switch(now, number=number, tail=[*now["tail"], path])
        if len(now["tail"]) + 1 >= self.most:
            self.compact()
        return True

    def compact(self) -> None:
        """Base and tail become one base; what the merge before this one replaced is deleted."""
        now = self.state()
        replaced = [p for p in (now["base"], *now["tail"]) if p]
        path = f"parts/{uuid.uuid4().hex}"
        self.merge(self.read()).write.parquet(f"{self.folder}/{path}")
        self._switch(now, base=path, tail=[], old=replaced)
        for name in now["old"]:
            part, files = self._path(name)
            files.delete(part, True)

    def read(self) -> DataFrame:
        """All rows that count, with their versions, merged only as far as the base is."""
        now = self.state()
        paths = [f"{self.folder}/{p}" for p in (now["base"], *now["tail"]) if p]
        if not paths:
            raise ValueError(f"nothing is stored in {self.folder}")
        return self.spark.read.parquet(*paths)
