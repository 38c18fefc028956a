"""The issue tracker's search as a Python data source: in batch each page is a
partition that a worker fetches itself; as a stream, issues arrive in order of
creation and key, a page at a time, behind a cursor over both.

The search is put in order of creation whatever order the caller asks for, so
issues that are created while it runs come at its end and move no page. The
cursor names an issue, not a place, so it holds when issues go as well."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

from ..session import ship
from . import jira

SEARCH = "/rest/api/3/search"


class Page(InputPartition):
    def __init__(self, at: int):
        self.at = at


def page_of(client: jira.Client, query: str, at: int, size: int) -> dict:
    wanted = {"jql": query, "startAt": at, "maxResults": size, "fields": ",".join(jira.FIELDS)}
    status, payload = client.call("GET", SEARCH, wanted)
    if status != 200:
        raise RuntimeError(f"search failed with status {status}")
    return payload


def cursor(issue: dict) -> dict:
    fields = issue.get("fields") or {}
    return {"created": fields.get("created") or issue.get("created") or "", "key": issue.get("key") or ""}


def place(at: dict) -> tuple:
    """Where a cursor stands: by time, whatever zone it is written in, then by the
    key's project and number."""
    if not at["created"]:
        return (0.0, "", 0)
    when = datetime.fromisoformat(re.sub(r"([+-]\d\d)(\d\d)$", r"\1:\2", at["created"].replace("Z", "+00:00")))
    project, _, number = at["key"].rpartition("-")
    return (when.timestamp(), project, int(number) if number.isdigit() else 0)


def behind(client: jira.Client, query: str, at: dict) -> Iterator[list[dict]]:
    """The issues behind a cursor, oldest first, by page. The tracker compares whole
    minutes, and in the asker's zone, so the search begins a day before the
    cursor and what lies before it is passed over."""
    since = None
    if at["created"]:
        since = (datetime.fromtimestamp(place(at)[0], timezone.utc) - timedelta(days=1)).strftime("%Y-%m-%d %H:%M")
    asked, k = jira.oldest_first(query, since), 0
    while True:
        got = page_of(client, asked, k, client.page).get("issues", [])
        if not got:
            return
        new = [i for i in got if place(cursor(i)) > place(at)]
        if new:
            yield new
        k += len(got)


def issue_source(connect: Callable[[], jira.Client], query: str) -> type[DataSource]:
    """A data source over one search; ``connect`` makes a client wherever pages are
    fetched, so nothing of a connection is shipped."""

    class Pages(DataSourceReader):
        def partitions(self) -> list[InputPartition]:
            client = connect()
            total = page_of(client, jira.oldest_first(query), 0, 0).get("total", 0)
            return [Page(at) for at in range(0, total, client.page)]

        def read(self, partition: Page) -> Iterator[tuple]:
            client = connect()
            got = page_of(client, jira.oldest_first(query), partition.at, client.page).get("issues", [])
            client.sleep(client.page_pause)  # a worker's pace
            for issue in got:
                yield (json.dumps(issue),)

    class Polled(SimpleDataSourceStreamReader):
        def initialOffset(self) -> dict:  # noqa: N802
            return {"created": "", "key": ""}

        def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
            client = connect()
            new = next(behind(client, query, start), [])
            end = cursor(new[-1]) if new else start
            return iter([(json.dumps(i),) for i in new]), end

        def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:  # noqa: N802
            for some in behind(connect(), query, start):
                for issue in some:
                    if place(cursor(issue)) > place(end):
                        return
                    yield (json.dumps(issue),)

    class Issues(DataSource):
        @classmethod
        def name(cls) -> str:
            return "issues"

        def schema(self) -> str:
            return "raw_json string"

        def reader(self, schema) -> DataSourceReader:
            return Pages()

        def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:  # noqa: N802
            return Polled()

    return Issues


def read_issues(spark: SparkSession, connect: Callable[[], jira.Client], query: str) -> DataFrame:
    """jira_defects rows of a search, fetched by the workers page by page."""
    ship(spark)
    spark.dataSource.register(issue_source(connect, query))
    return jira.defects(spark.read.format("issues").load())


def stream_issues(spark: SparkSession, connect: Callable[[], jira.Client], query: str) -> DataFrame:
    """The same as a stream: each issue once, those too that are created while it
    runs."""
    ship(spark)
    spark.dataSource.register(issue_source(connect, query))
    return jira.defects(spark.readStream.format("issues").load())
