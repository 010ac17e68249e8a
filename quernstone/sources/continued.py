"""A stream over recorded envelopes, whose offsets are how each stratum goes on: by page, Link or cursor.

``spark.readStream.format("continued").option("path", folder).option("kind", kind).option("strata", json)``
reads ``folder/stratum/token.json``, one envelope a file; the first token is ``1``, or ``*`` for
cursors.  An envelope has ``items``, and what tells of the next one: ``has_more`` or ``next`` (kind
``page``), the header ``link`` (kind ``link``), or ``cursor`` (kind ``cursor``).

An offset is the number of envelopes taken of each stratum, the token of the next one, and whether
the stratum has ended.  The latest offset follows the recorded envelopes as far as they go, so it
doesn't depend on the process; a batch reads the envelopes between two offsets, a stratum a task, and
reads the same ones again after a restart.  A stratum ends with an envelope that names no next one,
with one without items, or with a cursor that stays; an envelope that isn't recorded yet is waited
for.  The folder must be one that driver and executors share; tokens are quoted as in URLs.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "stratum string, number int, place int, payload string"
#: A Link header's next page.
_NEXT = re.compile(r'<[^>]*[?&]page=([0-9]+)[^>]*>\s*;[^,]*\brel="?next"?', re.I)


def next_token(kind: str, token: str, envelope: dict) -> str | None:
    """The token of the envelope after this one, or None."""
    if not envelope.get("items"):
        return None
    if kind == "cursor":
        cursor = envelope.get("cursor")
        return cursor if cursor and cursor != token else None
    if kind == "link":
        found = _NEXT.search(envelope.get("link") or "")
        return found[1] if found and found[1] != token else None
    return str(int(token) + 1) if envelope.get("has_more") or envelope.get("next") else None


def recorded(path: str, stratum: str, token: str) -> dict | None:
    system, folder = fs.FileSystem.from_uri(path)
    place = f"{folder}/{quote(stratum, safe='')}/{quote(token, safe='')}.json"
    if system.get_file_info(place).type == fs.FileType.NotFound:
        return None
    with system.open_input_stream(place) as f:
        return json.loads(f.read())


@dataclass
class Span(InputPartition):
    """The envelopes of a stratum from one token on."""

    stratum: str
    first: int
    token: str
    stop: int


class ContinuedReader(DataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.path, self.kind, self.strata = options["path"].rstrip("/"), options["kind"], json.loads(options["strata"])
        if self.kind not in ("page", "link", "cursor"):
            raise ValueError(f"unknown kind of continuation: {self.kind}")
        self.reached = self.initialOffset()

    def initialOffset(self) -> dict:
        return {s: {"taken": 0, "token": "*" if self.kind == "cursor" else "1", "ended": False} for s in self.strata}

    def latestOffset(self) -> dict:
        for stratum, at in self.reached.items():
            while not at["ended"] and (envelope := recorded(self.path, stratum, at["token"])) is not None:
                token = next_token(self.kind, at["token"], envelope)
                at.update(taken=at["taken"] + 1, token=token or at["token"], ended=token is None)
        return json.loads(json.dumps(self.reached))

    def partitions(self, start: dict, end: dict) -> list[Span]:
        spans = [Span(s, start[s]["taken"], start[s]["token"], end[s]["taken"]) for s in self.strata if s in start and s in end and start[s]["taken"] < end[s]["taken"]]
        return spans or [Span("", 0, "", 0)]

    def read(self, partition: Span) -> Iterator[tuple]:
        token = partition.token
        for number in range(partition.first, partition.stop):
            envelope = recorded(self.path, partition.stratum, token)
            if envelope is None:
                raise ValueError(f"envelope {number + 1} of {partition.stratum} is gone")
            for place, item in enumerate(envelope.get("items") or ()):
                yield (partition.stratum, number + 1, place, json.dumps(item, sort_keys=True, ensure_ascii=False))
            token = next_token(self.kind, token, envelope)

    def commit(self, end: dict) -> None:
        """Envelopes stay where they were recorded."""


class Continued(DataSource):
    @classmethod
    def name(cls) -> str:
        return "continued"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema: object) -> ContinuedReader:
        return ContinuedReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Continued)
