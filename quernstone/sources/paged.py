"""A Python data source that pages through a service: one partition a stratum.

``spark.read.format("paged").option("transport", "module:function")`` calls
``function(stratum, page, options)``, which returns a dict with ``items`` (payloads), ``more``
(whether pages follow), and optionally ``bytes``, ``retry_after`` or ``error``.  Budgets, retries with
backoff and pacing hold within a stratum, and a wait that would outlast the deadline is not begun;
nothing here opens a connection by itself.

The option ``fields`` names payload fields to read as columns, as JSON from column to field.  The
format ``paged_query``, which needs ``spark.sql.python.filterPushdown.enabled``, pushes filters:
comparisons, IN and prefixes of these columns reach the function as ``predicates`` (JSON) and
``query`` (the service's language), and strata that a filter rules out are not asked for.
"""

from __future__ import annotations

import importlib
import json
import time
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, StringStartsWith

SCHEMA = "stratum string, page int, place int, payload string, attempts int, termination string"


@dataclass
class Stratum(InputPartition):
    name: str


@dataclass
class Budget:
    """Requests, attempts, bytes and seconds that a stratum may use."""

    requests: int = 12
    attempts: int = 24
    bytes: int = 30 << 20
    seconds: float = 180.0
    base_pause: float = 1.0
    longest_pause: float = 8.0
    retries: int = 2


#: Errors of a transport that end a run under their own name, by the transport's word for them.
ENDS = {"rate_limited": "rate_limit_exhausted", "rate_limit_exhausted": "rate_limit_exhausted", "backoff_budget_exhausted": "backoff_budget_exhausted", "smoke_deadline_exhausted": "smoke_deadline_exhausted"}
#: Signs of the predicates that a service can be asked for, by Spark's filters.
SIGNS = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<=", In: "IN", StringStartsWith: "STARTS"}


class PagedReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options = dict(options)
        self.fields = json.loads(self.options.get("fields", "{}"))
        self.strata = json.loads(self.options["strata"])
        self.budget = Budget(**{k: type(v)(float(self.options[k.lower().replace("_", "")])) for k, v in vars(Budget()).items() if k.lower().replace("_", "") in self.options})

    def partitions(self) -> list[Stratum]:
        return [Stratum(s) for s in self.strata] or [Stratum("")]

    def read(self, partition: Stratum) -> Iterator[tuple]:
        if not partition.name:
            return
        module, name = self.options["transport"].split(":")
        fetch = getattr(importlib.import_module(module), name)
        spent, page, began, used, previous = 0, 0, time.monotonic(), 0, None
        none = (None,) * len(self.fields)
        while True:
            page += 1
            stop = self._stop(page - 1, spent, used, began)
            if stop:
                yield (partition.name, page, None, None, spent, stop, *none)
                return
            tries, reply = 0, None
            while reply is None:
                tries += 1
                spent += 1
                found = fetch(partition.name, page, self.options)
                error = found.get("error")
                used += int(found.get("bytes") or 0)  # a reply with an error has cost its bytes too
                if error is None:
                    reply = found
                    break
                wait = pause(tries, self.budget, found.get("retry_after"))
                late = time.monotonic() - began + wait > self.budget.seconds
                if error != "retryable" or tries > self.budget.retries or spent >= self.budget.attempts or late:
                    yield (partition.name, page, None, None, spent, "smoke_deadline_exhausted" if error == "retryable" and late else ENDS.get(error, "transport_error"), *none)
                    return
                time.sleep(wait)
            payloads = [json.dumps(x, sort_keys=True, ensure_ascii=False) for x in reply["items"]]
            used += 0 if "bytes" in reply else sum(len(p.encode()) for p in payloads)
            for place, (payload, item) in enumerate(zip(payloads, reply["items"])):
                yield (partition.name, page, place, payload, spent, None, *[_text(item.get(f)) if isinstance(item, dict) else None for f in self.fields.values()])
            if not payloads or not reply.get("more") or payloads == previous:
                yield (partition.name, page, None, None, spent, "source_exhausted", *none)
                return
            previous = payloads

    def _stop(self, requests: int, attempts: int, used: int, began: float) -> str | None:
        """The reason not to ask for another page, in the order in which budgets are looked at."""
        b = self.budget
        if requests >= b.requests:
            return "request_budget_exhausted"
        if attempts >= b.attempts:
            return "transport_error"
        return "smoke_deadline_exhausted" if time.monotonic() - began >= b.seconds else "transport_error" if used >= b.bytes else None


class QueryingReader(PagedReader):
    """A reader that asks the service for what the query's filters let through."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Predicates on fields become the query that the transport is asked; strata that aren't wanted are not read.

        A predicate on a field would turn away the rows that tell how a stratum ended, as they have no
        fields.  What can't be asked for is left to Spark.
        """
        asked = []
        for f in filters:
            column, sign = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None, SIGNS.get(type(f))
            value = list(f.value) if sign == "IN" else getattr(f, "value", None)
            if column == "stratum" and sign in ("=", "IN"):
                self.strata = [s for s in self.strata if s in (value if sign == "IN" else [value])]
            elif column in self.fields and sign and all(isinstance(v, str) for v in (value if sign == "IN" else [value])):
                asked.append([self.fields[column], sign, value])
                yield f  # a service may return more than it was asked for
            else:
                yield f
        self.options["predicates"] = json.dumps(asked)
        self.options["query"] = " AND ".join(map(_shown, asked))


def _text(value: object) -> str | None:
    return value if value is None or isinstance(value, str) else json.dumps(value, sort_keys=True, ensure_ascii=False)


def _shown(predicate: list) -> str:
    """A predicate as the service's query language has it."""
    field, sign, value = predicate
    return f"{field} = {value}*" if sign == "STARTS" else f"{field} IN ({' '.join(value)})" if sign == "IN" else f"{field} {sign} {value}"


def answers(item: dict, predicates: list[list]) -> bool:
    """Whether a payload meets pushed predicates; for transports that serve recorded pages."""
    tests = {"=": lambda x, v: x == v, ">": lambda x, v: x > v, ">=": lambda x, v: x >= v, "<": lambda x, v: x < v, "<=": lambda x, v: x <= v, "IN": lambda x, v: x in v, "STARTS": lambda x, v: x.startswith(v)}
    return all(isinstance(item.get(field), str) and tests[sign](item[field], value) for field, sign, value in predicates)


def pause(attempt: int, budget: Budget, retry_after: float | None) -> float:
    """Seconds before the next attempt: what the service asks for, else doubling up to the longest."""
    return float(retry_after) if retry_after is not None else min(budget.base_pause * 2 ** (attempt - 1), budget.longest_pause)


class PagedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return SCHEMA + "".join(f", `{name}` string" for name in json.loads(self.options.get("fields", "{}")))

    def reader(self, schema: object) -> PagedReader:
        return PagedReader(self.options)


class QueryingSource(PagedSource):
    @classmethod
    def name(cls) -> str:
        return "paged_query"

    def reader(self, schema: object) -> QueryingReader:
        return QueryingReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PagedSource)
    spark.dataSource.register(QueryingSource)
