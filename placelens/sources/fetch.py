"""Web services as a Spark data source: one partition for each request.

``spark.read.format("place_fetch")`` sends each request of the option
``requests`` (a JSON list of [name, query]) in a task of its own and gives one
row with the checked body.  How a request is sent is an option too, so that the
rules of retrying can be tested, and used, without a network.
"""

from __future__ import annotations

import importlib
import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .scans import ELEMENTS


@dataclass(frozen=True)
class Response:
    status: int
    body: bytes
    cached: bool = False


@dataclass(frozen=True)
class Rules:
    """How often a request is sent, how long is waited in between, what is sent again, and what a whole body is."""

    attempts: int
    first_wait: float
    most_wait: float
    busy: frozenset[int]
    every_failure: bool
    varied: bool
    cached_wait: float
    check: Callable[[bytes], None]


class Truncated(ValueError):
    """A body that is not whole."""


class TooHeavy(RuntimeError):
    """Two answers of the service itself broke off at the same length: sending the request again can't help."""


def whole_elements(body: bytes) -> None:
    """A map extract: JSON with at least one element."""
    try:
        found = json.loads(body).get("elements")
    except (ValueError, AttributeError) as e:
        raise Truncated("no JSON object") from e
    if not isinstance(found, list):
        raise Truncated("no elements")
    if not found:
        raise ValueError("zero elements")


def whole_bindings(body: bytes) -> None:
    """A query result: JSON with results.bindings; a service may break off or report an error in the middle of a body, whatever its status says."""
    try:
        found = json.loads(body)["results"]["bindings"]
    except (ValueError, KeyError, TypeError) as e:
        raise Truncated("no results.bindings") from e
    if not isinstance(found, list):
        raise Truncated("results.bindings is no list")


#: Attempts, waits in seconds and statuses of the two services.
MAP_RULES = Rules(6, 20.0, 300.0, frozenset({429, 502, 503, 504}), every_failure=True, varied=False, cached_wait=0.0, check=whole_elements)
DATA_RULES = Rules(4, 15.0, 120.0, frozenset({429, 500, 502, 503, 504}), every_failure=False, varied=True, cached_wait=5.0, check=whole_bindings)
RULES = {"elements": MAP_RULES, "bindings": DATA_RULES}


def fetch(name: str, query: str, send: Callable[[str], Response], rules: Rules, wait: Callable[[float], None] = time.sleep) -> tuple[bytes, int]:
    """The body of a request and the attempts that it took.

    A busy service is asked again after a wait that doubles up to a limit.  With
    ``every_failure`` so is one that refuses or can't be reached; otherwise that
    is an error at once.  A body that broke off is asked for with another text,
    so that no cache answers: two such answers of the same length that came from
    no cache mean that the request is too heavy.  A whole body without an element
    is an error that no retry can mend.
    """
    pause, text, broken, last = rules.first_wait, query, set(), ""
    for attempt in range(1, rules.attempts + 1):
        longer, now = True, pause
        try:
            got = send(text)
            if got.status in rules.busy:
                last = f"status {got.status}"
            elif got.status >= 400:
                if not rules.every_failure:
                    raise RuntimeError(f"{name}: status {got.status}")
                last = f"status {got.status}"
            else:
                rules.check(got.body)
                return got.body, attempt
        except ConnectionError as e:
            if not rules.every_failure:
                raise
            last = str(e)
        except Truncated as e:
            if not rules.varied:
                raise
            last, longer, now = str(e), not got.cached, rules.cached_wait if got.cached else pause
            if longer:
                if len(got.body) in broken:
                    raise TooHeavy(f"{name}: broke off twice at {len(got.body)} bytes") from e
                broken.add(len(got.body))
            text = f"{query}\n# attempt {attempt + 1}"
        if attempt < rules.attempts:
            wait(now)
        if longer:
            pause = min(2 * pause, rules.most_wait)
    raise RuntimeError(f"{name}: no answer in {rules.attempts} attempts, last {last}")


@dataclass
class _Request(InputPartition):
    name: str
    query: str


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.requests = json.loads(options["requests"])
        self.transport, self.kind, self.pace = options["transport"], options.get("kind", "elements"), float(options.get("pace", "1"))
        if self.kind not in RULES:
            raise ValueError(f"kind is one of {', '.join(RULES)}")

    def partitions(self) -> list[InputPartition]:
        return [_Request(*x) for x in self.requests]

    def read(self, partition: _Request) -> Iterator[tuple]:
        module, _, function = self.transport.partition(":")
        send = getattr(importlib.import_module(module), function)
        body, attempts = fetch(partition.name, partition.query, send, RULES[self.kind], lambda s: time.sleep(s * self.pace))
        yield partition.name, body.decode("utf-8"), len(body), attempts


class PlaceFetch(DataSource):
    """(name, body, bytes, attempts) of each request.

    Options: requests (JSON list of [name, query]), transport ("module:function"
    that takes a query and gives a ``Response``), kind (elements or bindings),
    pace (factor of all waits).
    """

    @classmethod
    def name(cls) -> str:
        return "place_fetch"

    def schema(self) -> str:
        return "name string, body string, bytes long, attempts int"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def fetched(spark: SparkSession, requests: list[tuple[str, str]], transport: str, kind: str, pace: float = 1.0) -> DataFrame:
    """(name, body, bytes, attempts) of the requests: areas of a map, or parts of a query."""
    spark.dataSource.register(PlaceFetch)
    reader = spark.read.format("place_fetch").option("requests", json.dumps(requests)).option("transport", transport)
    return reader.option("kind", kind).option("pace", str(pace)).load()


def fetched_elements(bodies: DataFrame) -> DataFrame:
    """(area, place, type, id, lat, lon, tags) of the elements in fetched map extracts, in their order."""
    rows = bodies.select(F.col("name").alias("area"), F.posexplode(F.from_json("body", ELEMENTS)["elements"]).alias("place", "e"))
    e = F.col("e")
    return rows.select("area", "place", e["type"].alias("type"), e["id"].alias("id"), F.coalesce(e["lat"], e["center"]["lat"]).alias("lat"), F.coalesce(e["lon"], e["center"]["lon"]).alias("lon"), e["tags"].alias("tags"))


def fetched_bindings(bodies: DataFrame) -> DataFrame:
    """(name, row, values: map from variable to value) of the rows in fetched query results, in their order."""
    kind = "results struct<bindings: array<map<string, struct<type: string, value: string>>>>"
    rows = bodies.select("name", F.posexplode(F.from_json("body", kind)["results"]["bindings"]).alias("row", "b"))
    return rows.select("name", "row", F.transform_values("b", lambda k, v: v["value"]).alias("values"))
