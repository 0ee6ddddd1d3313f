"""The commit log of a stored star: a load is visible in all five tables or in none.

Every load writes its rows into partitions of its own (one value of the
``load_id`` column in each table) and becomes visible when one small file is
added to ``_loads`` in the star's folder; readers ask for the partitions that
the log names. A load that dies before that leaves partitions no reader sees.

* ``claim-N``: a range of row ids, taken before the rows are written, so that
  two loads at once get disjoint ids. A load that is run again takes the range
  it claimed before.
* ``commit-N``: the partition of one load, on top of the N - 1 commits before
  it. Of two loads that both saw N - 1 commits one gets the file; the other
  looks again at what is stored (a facility may be known now) and tries N + 1.

Files are made with "create, and fail if it exists" of the file system of the
star's folder, which must do both in one step (HDFS does; on a local disk the
system call is used).
"""

from __future__ import annotations

import json
import time
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

LOG_FOLDER = "_loads"
WAIT_S = 5.0


@dataclass
class State:
    """What the log says: ``version`` commits; ``parts`` visible partitions by load,
    ``since`` the commit that replaced the star last, ``last_id`` the largest id in use;
    ``rows`` and ``facts``: what was counted while each load was written."""
    version: int = 0
    since: int = 0
    parts: dict[str, str] = field(default_factory=dict)
    rows: dict[str, dict] = field(default_factory=dict)
    facts: dict[str, dict] = field(default_factory=dict)
    last_id: int = 0


class LoadLog:
    def __init__(self, spark: SparkSession, star_path: str):
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.folder = f"{star_path.rstrip('/')}/{LOG_FOLDER}"
        self.fs = self._path("").getFileSystem(self.conf)

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def _create(self, name: str, entry: dict) -> bool:
        """Add a file; False if it is there already."""
        path = self._path(name)
        if self.fs.getScheme() == "file":  # whose create looks first and makes the file then; the system call does both at once
            self.fs.mkdirs(self._path(""))
            plain = self.jvm.org.apache.hadoop.fs.Path.getPathWithoutSchemeAndAuthority(path).toString()
            if not self.jvm.java.io.File(plain).createNewFile():
                return False
        try:
            out = self.fs.create(path, self.fs.getScheme() == "file")
        except Py4JJavaError as e:
            if "FileAlreadyExists" in e.java_exception.getClass().getName():
                return False
            raise
        out.write(bytearray(json.dumps(entry).encode()))
        out.close()
        return True

    def _read(self, name: str) -> dict:
        until = time.monotonic() + WAIT_S
        while True:
            try:
                reader = self.jvm.java.io.BufferedReader(self.jvm.java.io.InputStreamReader(self.fs.open(self._path(name)), "UTF-8"))
                line = reader.readLine()
                reader.close()
                return json.loads(line)
            except (TypeError, ValueError, Py4JJavaError):  # made by another load that has not written it yet
                if time.monotonic() > until:
                    raise RuntimeError(f"{self.folder}/{name} has no content: its writer died; delete the file and run the load again") from None
                time.sleep(0.1)

    def _entries(self, kind: str) -> list[tuple[int, dict]]:
        if not self.fs.exists(self._path("")):
            return []
        names = sorted(f.getPath().getName() for f in self.fs.listStatus(self._path("")))
        return [(int(n[len(kind) + 1:-5]), self._read(n)) for n in names if n.startswith(kind + "-") and n.endswith(".json")]

    def exists(self) -> bool:
        return self.fs.exists(self._path(""))

    def state(self) -> State:
        s = State()
        for n, e in self._entries("commit"):
            if e["replace"]:
                s.parts, s.rows, s.facts, s.last_id, s.since = {}, {}, {}, 0, n
            s.parts.update(e["parts"])
            s.rows.update({k: e["rows"] for k in e["parts"]})
            s.facts.update({k: e["facts"] for k in e["parts"]})
            s.version, s.last_id = n, max(s.last_id, e["last_id"])
        return s

    def claim(self, load_id: str, rows: int) -> int:
        """The id before the first of ``rows`` ids that belong to this load alone."""
        while True:
            now, claims = self.state(), self._entries("claim")
            valid = [c for _, c in claims if c["since"] == now.since]
            mine = [c for c in valid if c["load_id"] == load_id and c["rows"] == rows]
            if mine:
                return mine[-1]["start"]
            start = max([now.last_id, *(c["start"] + c["rows"] for c in valid)])
            if self._create(f"claim-{(claims[-1][0] if claims else 0) + 1:010d}.json",
                            {"load_id": load_id, "start": start, "rows": rows, "since": now.since}):
                return start

    def commit(self, version: int, parts: dict[str, str], last_id: int, replace: bool = False, rows: dict | None = None, facts: dict | None = None) -> bool:
        """Make ``parts`` (partition of each load) visible; False if other loads came in since ``version``."""
        return self._create(f"commit-{version + 1:010d}.json",
                            {"parts": parts, "last_id": last_id, "replace": replace, "rows": rows or {}, "facts": facts or {}, "at": time.time()})
