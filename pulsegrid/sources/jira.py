"""Issue-tracker sources: JSON files of any of four shapes, in-memory records, and
the REST interface behind an injectable transport."""

from __future__ import annotations

import json
import os
import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..session import ship

#: Fixed: node types of the document format whose children are lines.
LINE_NODES = frozenset("paragraph bulletList listItem orderedList heading blockquote codeBlock panel".split())
FIELDS = "summary description status priority reporter created updated labels components issuetype project comment".split()
RECORD = (
    "key string, project string, summary string, description string, reporter string, reporter_name string, reporter_email string, "
    "status string, priority string, issuetype string, labels string, components string, created string, fields string"
)


def document_text(node) -> str:
    """Plain text of a document tree; its depth is unbounded, hence Python."""
    if node is None:
        return ""
    if isinstance(node, list):
        return "\n".join(map(document_text, node))
    if not isinstance(node, dict):
        return str(node)
    kind = node.get("type", "")
    if kind == "text":
        return node.get("text", "")
    if kind in ("hardBreak", "rule"):
        return "\n"
    return ("\n" if kind in LINE_NODES else "").join(map(document_text, node.get("content", [])))


def _document_texts(column: pd.Series) -> pd.Series:
    def one(s: str | None) -> str | None:
        if not s or s[0] not in "{[":
            return s
        try:
            return document_text(json.loads(s))
        except ValueError:
            return s

    return column.map(one)


def records(raw: DataFrame, column: str = "value") -> DataFrame:
    """(raw_json) of every issue in whole JSON texts: one object, a list,
    {"issues": [...]} or a dictionary of objects."""
    c = F.trim(F.col(column))
    issues = F.get_json_object(c, "$.issues")
    each = (
        F.when(c.startswith("["), F.from_json(c, "array<string>"))
        .when(issues.isNotNull(), F.from_json(issues, "array<string>"))
        .when(F.get_json_object(c, "$.key").isNotNull(), F.array(c))
        .otherwise(F.map_values(F.from_json(c, "map<string,string>")))
    )
    return raw.select(F.explode(each).alias("raw_json"))


def _first(*cs: Column) -> Column:
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in cs])


def _named(c: Column, name: str) -> Column:
    """A string, or one member of an object written as JSON."""
    return F.when(c.startswith("{"), F.get_json_object(c, f"$.{name}")).otherwise(c)


def _strings(c: Column) -> Column:
    each = F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>"))
    return F.transform(each, lambda x: F.when(x.startswith("{"), F.coalesce(F.get_json_object(x, "$.name"), F.lit(""))).otherwise(x))


def defects(raw: DataFrame) -> DataFrame:
    """Rows of jira_defects from raw_json records, flat or nested; records without
    a key or a readable creation time are dropped."""
    ship(raw.sparkSession)
    flatten = F.pandas_udf(_document_texts, "string")
    t = raw.select("raw_json", F.from_json("raw_json", RECORD).alias("r")).select("raw_json", "r.*")
    t = t.withColumn("f", F.coalesce(F.from_json("fields", RECORD), F.from_json("raw_json", RECORD)))
    reporter = F.coalesce("f.reporter", F.lit(""))
    nested = reporter.startswith("{")
    name = F.when(nested, F.get_json_object(reporter, "$.displayName")).otherwise(_first(F.col("reporter_name"), F.col("reporter")))
    email = F.when(nested, F.get_json_object(reporter, "$.emailAddress")).otherwise(_first(F.col("reporter_email"), F.col("reporter_name")))

    def either(c: str, member: str) -> Column:
        return _first(_named(F.col(c), member), _named(F.col(f"f.{c}"), member))

    out = t.select(
        F.trim("key").alias("defect_id"),
        F.coalesce(either("project", "key"), F.lit("")).alias("project"),
        F.coalesce(_first(F.col("summary"), F.col("f.summary")), F.lit("")).alias("summary"),
        F.nullif(F.trim(flatten(F.coalesce("description", "f.description"))), F.lit("")).alias("description"),
        _first(name).alias("reporter_name"),
        text.normalise_email(email).alias("reporter_email"),
        either("status", "name").alias("status"),
        either("priority", "name").alias("priority"),
        either("issuetype", "name").alias("issue_type"),
        _strings(F.coalesce("labels", "f.labels")).alias("labels"),
        _strings(F.coalesce("components", "f.components")).alias("components"),
        F.coalesce(text.parse_issue_time("created"), text.parse_issue_time("f.created")).alias("created"),
        "raw_json",
    )
    return out.filter("defect_id is not null and defect_id <> '' and created is not null")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    return defects(records(spark.read.text(path, wholetext=True)))


def from_list(spark: SparkSession, issues: list[dict]) -> DataFrame:
    rows = [(json.dumps(i),) for i in issues]
    return defects(spark.createDataFrame(rows, "raw_json string"))


def comment_texts(raw: DataFrame) -> DataFrame:
    """(defect_id, comments): plain texts of an issue's comments."""
    ship(raw.sparkSession)
    body = F.explode_outer(F.from_json(F.get_json_object("raw_json", "$.fields.comment.comments"), "array<struct<body:string>>"))
    t = raw.select(F.get_json_object("raw_json", "$.key").alias("defect_id"), body.alias("c")).withColumn("body", F.pandas_udf(_document_texts, "string")(F.col("c.body")))
    return t.groupBy("defect_id").agg(F.collect_list("body").alias("comments"))


# --- REST ---------------------------------------------------------------------

#: (method, path, query, body) -> (status, payload); tests and callers supply it.
Transport = Callable[[str, str, dict, dict | None], tuple[int, dict]]


def http_transport(base_url: str, email: str, token: str, timeout: float = 30.0) -> Transport:
    """JSON over HTTP with basic authentication, from the standard library."""
    import base64
    from urllib import error, parse, request

    secret = base64.b64encode(f"{email}:{token}".encode()).decode()

    def send(method: str, path: str, query: dict, body: dict | None) -> tuple[int, dict]:
        url = base_url.rstrip("/") + path + ("?" + parse.urlencode(query) if query else "")
        head = {"Authorization": f"Basic {secret}", "Accept": "application/json", "Content-Type": "application/json"}
        asked = request.Request(url, json.dumps(body).encode() if body is not None else None, head, method=method)
        try:
            with request.urlopen(asked, timeout=timeout) as r:
                text_ = r.read().decode()
                return r.status, json.loads(text_) if text_ else {}
        except error.HTTPError as e:
            return e.code, {}

    return send


def jql(projects: list[str], extra: str | None = None, since_days: int | None = None) -> str:
    """Bugs of the projects, newest first; ``since_days`` is honoured if given."""
    parts = ["project IN (" + ", ".join(f'"{p}"' for p in projects) + ")", "issuetype = Bug"]
    if since_days:
        parts.append(f"created >= -{since_days}d")
    if extra:
        parts.append(f"({extra})")
    return " AND ".join(parts) + " ORDER BY created DESC"


def oldest_first(query: str, since: str | None = None) -> str:
    """The search in order of creation, then key, so that new issues come at its
    end; ``since`` (minutes, as the tracker compares them) leaves out older ones."""
    asked = re.sub(r"\s+ORDER\s+BY\s.*$", "", query, flags=re.IGNORECASE | re.DOTALL)
    if since:
        asked = f'({asked}) AND created >= "{since}"'
    return f"{asked} ORDER BY created ASC, key ASC"


@dataclass(frozen=True)
class ProjectConfig:
    confirm_threshold: float
    automation_field: str
    window_days: int


def project_config(project: str, env: dict[str, str] | None = None) -> ProjectConfig:
    """Settings with the project's prefix, else the global ones, else defaults."""
    env = dict(os.environ) if env is None else env
    prefix = project.upper().replace("-", "_")

    def of(own: str, general: str, default: str) -> str:
        return env.get(f"{prefix}_{own}", env.get(general, default))

    return ProjectConfig(float(of("CONFIRM_THRESHOLD", "CONFIRM_THRESHOLD", "0.5")), of("AUTOMATION_FIELD", "AUTOMATION_FIELD", ""), int(of("WINDOW_DAYS", "DEFECT_WINDOW_DAYS", "7")))


@dataclass
class Client:
    transport: Transport
    page: int = 100
    page_pause: float = 1.0
    retries: int = 5
    backoff: float = 1.5
    sleep: Callable[[float], None] = field(default=time.sleep)

    def call(self, method: str, path: str, query: dict | None = None, body: dict | None = None) -> tuple[int, dict]:
        """Retries when throttled or on server errors."""
        for attempt in range(self.retries):
            status, payload = self.transport(method, path, query or {}, body)
            if status != 429 and status < 500:
                break
            if attempt + 1 < self.retries:
                self.sleep(self.backoff**attempt)
        return status, payload

    def test_connection(self) -> bool:
        return self.call("GET", "/rest/api/3/myself")[0] == 200

    def search(self, query: str) -> Iterator[dict]:
        """Issues page by page until the total, or an empty page."""
        at = 0
        while True:
            status, payload = self.call("GET", "/rest/api/3/search", {"jql": query, "startAt": at, "maxResults": self.page, "fields": ",".join(FIELDS)})
            if status != 200:
                raise RuntimeError(f"search failed with status {status}")
            issues = payload.get("issues", [])
            yield from issues
            at += len(issues)
            if not issues or at >= payload.get("total", 0):
                return
            self.sleep(self.page_pause)

    def comment(self, issue: str, body: dict) -> int:
        return self.call("POST", f"/rest/api/3/issue/{issue}/comment", body={"body": body})[0]

    def set_field(self, issue: str, name: str, value) -> int:
        return self.call("PUT", f"/rest/api/3/issue/{issue}", body={"fields": {name: value}})[0]


def fetch(spark: SparkSession, client: Client, query: str) -> DataFrame:
    """jira_defects rows of a search; the tracker pages one after another."""
    return from_list(spark, list(client.search(query)))
