"""A revisioned, project-scoped entry store on Parquet.

The store is an append-only table of events, a folder for each commit; entries,
history and revision counters are views of it. A commit is published by creating
its marker file, which fails if another writer did so first: writers compare and
swap, readers pin the commits they list.
"""

from __future__ import annotations

import json
import os
import time
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import text as X

KINDS = ("decision", "fact", "preference", "task", "note")
# Largest sizes in UTF-8 bytes.
LIMITS = {"project": 200, "key": 200, "title": 300, "content": 65536, "tag": 64, "source": 1000}
MAX_TAGS = 20
SCHEMA = "commit long, op string, project string, key string, title string, content string, kind string, tags array<string>, source string, revision long, created_at long, updated_at long, id long"
FIELDS = ("project", "key", "title", "content", "kind", "tags", "source", "revision", "created_at", "updated_at")
VERSION = 2


class Conflict(Exception):
    """The entry's revision isn't the expected one."""


class NotFound(KeyError):
    pass


def checked(name: str, value: str, most: int) -> None:
    if not value.strip() or "\0" in value or len(value.encode()) > most:
        raise X.Invalid(f"{name}: not blank, no NUL, at most {most} bytes")


def invalid_reason(name: str, most: int) -> F.Column:
    """The same rule as an expression: null if the value is fine."""
    c = F.col(name)
    return F.when(F.trim(c) == "", "blank").when(F.octet_length(c) > most, "too long").when(F.contains(c, F.lit("\0")), "nul")


def current(log: DataFrame) -> DataFrame:
    """Entries: the last event of each (project, key), unless it deletes."""
    last = F.max_by(F.struct(*log.columns), "commit").alias("e")
    return log.groupBy("project", "key").agg(last).select("e.*").where("op = 'put'")


def history(log: DataFrame) -> DataFrame:
    """Revisions since the last deletion of each (project, key)."""
    cut = log.where("op = 'delete'").groupBy("project", "key").agg(F.max("commit").alias("cut"))
    return log.where("op = 'put'").join(cut, ["project", "key"], "left").where("cut is null or commit > cut").drop("cut")


def heads(log: DataFrame) -> DataFrame:
    """Revision counters, which survive deletion."""
    return log.groupBy("project", "key").agg(F.max("revision").alias("revision"))


def fold_commits(requests: DataFrame) -> DataFrame:
    """What becomes of a batch of writes: requests (project, key, seq, op, expected) gain ok and revision.

    Whether a write holds depends on all before it, so a key's writes are dealt to one task and sorted there, on disk
    where need be; the fold streams over them and holds two numbers."""
    schema = "project string, key string, seq long, ok boolean, revision long"
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, head, now = None, 0, 0
        for batch in batches:
            ok, revision = [], []
            columns = [batch.column(c).to_pylist() for c in ("project", "key", "op", "expected")]
            for project, key, op, expected in zip(*columns):
                if own != (project, key):
                    own, head, now = (project, key), 0, 0
                good = int(expected or 0) == now and (op == "put" or now > 0)
                if good:
                    head += op == "put"
                    now = head if op == "put" else 0
                ok.append(good)
                revision.append(now)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names[:3]], pa.array(ok, pa.bool_()), pa.array(revision, pa.int64())], names)

    rows = requests.select("project", "key", F.col("seq").cast("long").alias("seq"), "op", F.col("expected").cast("long").alias("expected"))
    return rows.repartition("project", "key").sortWithinPartitions("project", "key", "seq").mapInArrow(run, schema)


class Store:
    def __init__(self, spark: SparkSession, root: str, read_only: bool = False, clock=lambda: int(time.time() * 1000)):
        self.spark, self.root, self.read_only, self.clock = spark, Path(root), read_only, clock
        self.root.mkdir(parents=True, exist_ok=True)
        (self.root / "commits").mkdir(exist_ok=True)
        version = self.root / "version"
        if version.exists() and int(version.read_text()) > VERSION:
            raise X.Invalid("the store is of a later version")
        if not version.exists():
            version.write_text(str(VERSION))

    def commits(self) -> list[int]:
        return sorted(int(p.stem) for p in (self.root / "commits").glob("*.json"))

    def log(self) -> DataFrame:
        """The events of all published commits, as of now."""
        names = [json.loads((self.root / "commits" / f"{c:012d}.json").read_text())["data"] for c in self.commits()]
        if not names:
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(*[str(self.root / n) for n in names])

    def _publish(self, number: int, event: dict) -> None:
        data = f"data/{number:012d}-{os.getpid()}-{time.time_ns()}"
        self.spark.createDataFrame([tuple(event.get(c.split()[0]) for c in SCHEMA.split(", "))], SCHEMA).coalesce(1).write.parquet(str(self.root / data))
        try:
            handle = os.open(self.root / "commits" / f"{number:012d}.json", os.O_CREAT | os.O_EXCL | os.O_WRONLY)
        except FileExistsError:
            raise Conflict(event["key"]) from None
        with os.fdopen(handle, "w") as f:
            f.write(json.dumps({"data": data}))

    def _writable(self) -> None:
        if self.read_only:
            raise X.Invalid("the store is read-only")

    def _state(self, project: str, key: str) -> tuple[dict | None, int, int]:
        """Entry, revision counter and last commit, of one snapshot."""
        commits = self.commits()
        own = self.log().where((F.col("project") == project) & (F.col("key") == key)).orderBy("commit").collect()
        entry = own[-1].asDict() if own and own[-1]["op"] == "put" else None
        return entry, max((r["revision"] for r in own), default=0), commits[-1] if commits else 0

    def remember(self, project: str, key: str, title: str, content: str, kind: str = "note", tags: list[str] | None = None, source: str | None = None, expected_revision: int | None = None) -> dict:
        """Writes an entry if its revision is the expected one (none: it must not exist). All fields are replaced."""
        self._writable()
        tags = tags or []
        for name, value in (("project", project), ("key", key), ("title", title), ("content", content)):
            checked(name, value, LIMITS[name])
        if kind not in KINDS or len(tags) > MAX_TAGS:
            raise X.Invalid("kind or number of tags")
        for t in tags:
            checked("tag", t, LIMITS["tag"])
        if source is not None:
            checked("source", source, LIMITS["source"])
        old, head, last = self._state(project, key)
        if (expected_revision or 0) != (old["revision"] if old else 0):
            raise Conflict(key)
        now = self.clock()
        event = {"commit": last + 1, "op": "put", "project": project, "key": key, "title": title, "content": content, "kind": kind, "tags": tags, "source": source, "revision": head + 1, "created_at": old["created_at"] if old else now, "updated_at": now, "id": old["id"] if old else last + 1}
        self._publish(last + 1, event)
        return {f: event[f] for f in FIELDS}

    def forget(self, project: str, key: str, expected_revision: int) -> None:
        """Deletes the entry and its history; its revision counter stays."""
        self._writable()
        checked("project", project, LIMITS["project"])
        checked("key", key, LIMITS["key"])
        old, head, last = self._state(project, key)
        if old is None:
            raise NotFound(key)
        if old["revision"] != expected_revision:
            raise Conflict(key)
        self._publish(last + 1, {"commit": last + 1, "op": "delete", "project": project, "key": key, "revision": head})

    def get(self, project: str, key: str) -> dict:
        rows = current(self.log().where((F.col("project") == project) & (F.col("key") == key))).collect()
        if not rows:
            raise NotFound(key)
        return {f: rows[0][f] for f in FIELDS}

    def history(self, project: str, key: str, limit: int = 10) -> list[dict]:
        """Newest first; empty for a missing key."""
        if not 1 <= limit <= 50:
            raise X.Invalid("limit: 1 to 50")
        rows = history(self.log().where((F.col("project") == project) & (F.col("key") == key)))
        return [{f: r[f] for f in FIELDS} for r in rows.orderBy(F.desc("revision")).limit(limit).collect()]

    def recall(self, project: str, query: str = "", limit: int = 10, max_bytes: int = 16000) -> dict:
        """Entries of a project by relevance, or by recency for a blank query, within a byte budget."""
        checked("project", project, LIMITS["project"])
        if not 1 <= limit <= 50 or not 512 <= max_bytes <= 65536 or len(query.encode()) > 1000:
            raise X.Invalid("limit 1 to 50, max_bytes 512 to 65536, query at most 1000 bytes")
        terms = X.query_terms(query)
        if query.strip() and not terms:
            raise X.Invalid("the query needs a word")
        rows = current(self.log())
        if not terms:
            found = rows.where(F.col("project") == project).orderBy(F.desc("updated_at"), F.desc("id"))
        else:
            phrases = [X.index_tokens(t) for t in terms]
            if not all(phrases):
                return X.within_budget([], limit, max_bytes)
            tagged = rows.withColumn("_tags", F.to_json("tags")).withColumnRenamed("tags", "_list").withColumnRenamed("_tags", "tags")
            indexed = X.folded_tokens(tagged, ["title", "content", "tags"]).drop("tags").withColumnRenamed("_list", "tags")
            found = X.ranked(indexed, phrases).where(F.col("project") == project).orderBy("score", F.desc("updated_at"), F.desc("id"))
        return X.within_budget([{f: r[f] for f in FIELDS} for r in found.limit(limit + 1).collect()], limit, max_bytes)


def revisions(log: DataFrame) -> DataFrame:
    """Revision numbers of a log by (project, key) in commit order, deletions included in the count's order but not in it."""
    w = Window.partitionBy("project", "key").orderBy("commit")
    return log.withColumn("revision", F.sum(F.when(F.col("op") == "put", 1).otherwise(0)).over(w))
