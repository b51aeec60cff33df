"""Which folders a store's tables consist of: numbered manifests, of which the last whole one counts.

Every write goes to a new folder, which no reader sees until a manifest names it. A commit writes the next number; two
writers cannot take the same one, the later takes the commit before it into account and tries again. So a reader sees
one snapshot, a job that breaks off leaves folders that nobody reads, and steps that are still to do are in the manifest.

A manifest is JSON: ``tables`` (name -> list of {folder, replaces}), and lists of things to do. It grows by a line a
batch; ``KnowledgeBase.compact`` makes one folder of many.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession

from .durable import filesystem

TODO = ("pending", "unwritten")


class Manifest:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        self.dir = f"{root}/tables/_manifest"

    def _names(self, path: str) -> list[str]:
        fs, where = filesystem(self.spark, path)
        return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []

    def _load(self, name: str) -> dict | None:
        fs, where = filesystem(self.spark, f"{self.dir}/{name}")
        fs.setVerifyChecksum(False)
        stream = fs.open(where)
        text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        try:
            return json.loads(text)
        except ValueError:  # its writer broke off
            return None

    def read(self) -> dict:
        """The current snapshot."""
        for name in reversed([n for n in self._names(self.dir) if re.fullmatch(r"\d{12}\.json", n)]):
            if (got := self._load(name)) is not None:
                return got
        return self._without()

    def _without(self) -> dict:
        """A store from before there were manifests: its folders count, and sources of a batch that has no extractions wait.
        Folders named as ``folder`` does are no such ones: nobody has committed them."""
        own = lambda n: n.startswith("batch") and not re.fullmatch(r"batch-\d{12}-[0-9a-f]{12}", n)
        folders = {t: [n for n in self._names(f"{self.root}/tables/{t}") if own(n)] for t in self._names(f"{self.root}/tables") if not t.startswith("_")}
        waiting = [n for n in folders.get("sources", []) if n not in folders.get("extractions", [])]
        return {"number": 0, "tables": {t: [{"folder": n, "replaces": False} for n in names] for t, names in folders.items()}, "pending": waiting, "unwritten": [], "pages_since": 0}

    def folder(self) -> str:
        """A new folder's name; names rise with the commits before them."""
        return f"batch-{self.read()['number'] + 1:012d}-{uuid.uuid4().hex[:12]}"

    def commit(self, change: Callable[[dict], None]) -> dict:
        """Apply ``change`` to the current snapshot and make it the next one."""
        while True:
            taken = [int(n[:12]) for n in self._names(self.dir) if re.fullmatch(r"\d{12}\.json", n)]
            new = self.read()
            change(new)
            new["number"] = max([0, *taken]) + 1
            fs, where = filesystem(self.spark, f"{self.dir}/{new['number']:012d}.json")
            try:
                out = fs.create(where, False)
            except Exception as e:
                if "AlreadyExists" in str(e) or "already exists" in str(e):
                    continue  # another commit took the number
                raise
            out.write(bytearray(json.dumps(new).encode()))
            out.close()
            return new

    def add(self, folders: dict[str, str], replaces: bool = False, **todo: tuple[list[str], list[str]]) -> dict:
        """Make ``folders`` (table -> folder) part of the store; ``todo``: (entries that come, entries that go) of each list."""

        def change(m: dict) -> None:
            for table, name in folders.items():
                m["tables"].setdefault(table, []).append({"folder": name, "replaces": replaces})
            for key, (come, go) in todo.items():
                m[key] = [x for x in m[key] if x not in go] + come

        return self.commit(change)
