"""Articles from the web in rounds, one for each redirect: links are dealt by host, each host's robots file is read once and joined,
and where a page points elsewhere the next round goes there if the policy allows.

A client does the requests, on the executors. An article has SECONDS for all its requests; what is late, too large, of another
kind or not allowed is a row with a code. Rounds are written, so that no page is asked for again when an executor is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkdigest.functions.url import fetch_policy
from sparkdigest.operators.store import robots_allow
from sparkdigest.session import scratch

ARTICLE = "url string, final_url string, content_type string, body binary, hops int, error string"

# Redirects, bytes of a page and of a robots file, seconds for an article and for a robots file, kinds of content.
REDIRECTS, BYTES, ROBOTS_BYTES, SECONDS, ROBOTS_SECONDS = 5, 2 << 20, 256 << 10, 30.0, 2.0
KINDS = ("text/html", "application/xhtml+xml", "text/plain")
BLOCKED, REDIRECT, LATE, TIMEOUT, KIND, LARGE, DENIED, FAILED = (
    "ARTICLE_URL_BLOCKED",
    "ARTICLE_REDIRECT_BLOCKED",
    "ARTICLE_FETCH_DEADLINE_EXCEEDED",
    "ARTICLE_FETCH_TIMEOUT",
    "ARTICLE_CONTENT_TYPE_UNSUPPORTED",
    "ARTICLE_TOO_LARGE",
    "ARTICLE_ROBOTS_DENIED",
    "ARTICLE_FETCH_FAILED",
)
#: Tasks at most that ask one host at the same time, so that a host with a large share of the links isn't one task.
LANES = 4


@dataclass(frozen=True)
class Page:
    """A client's answer. seconds is what it took; body may be cut after one byte more than was asked for."""

    status: int
    headers: dict[str, str] = field(default_factory=dict)
    body: bytes = b""
    seconds: float = 0.0


class Client(Protocol):
    """What a fetch needs: one request without redirects, of so many bytes and seconds at most. TimeoutError if the site doesn't
    answer in time, any other exception if it can't be read."""

    def get(self, url: str, most: int, seconds: float) -> Page: ...


class ScriptedWeb:
    """Stand-in without a network: the path /<moves>/<answer>/... of a link says how often it moves on and what it then is: ok, pdf,
    large, late, silent, or a status. Hosts whose name begins with shut let no reader in, those that begin with half none below
    /0/pdf."""

    def get(self, url: str, most: int, seconds: float) -> Page:
        where = urlsplit(url)
        if where.path == "/robots.txt":
            rule = {"shut": "/", "half": "/0/pdf"}.get(where.netloc[:4])
            return Page(200, {}, f"User-agent: *\nDisallow: {rule}".encode()) if rule else Page(404)
        _, moves, answer, *rest = where.path.split("/")
        if moves != "0":
            return Page(302, {"Location": f"/{int(moves) - 1}/{answer}/{'/'.join(rest)}"}, seconds=1.0)
        if answer == "silent":
            raise TimeoutError
        kind = {"content-type": "application/pdf" if answer == "pdf" else "text/html; charset=utf-8"}
        body = b"x" * (most + 1) if answer == "large" else url.encode()
        return Page(int(answer) if answer.isdigit() else 200, kind, body, 40.0 if answer == "late" else 0.1)


def _asked(client: Client, url: str, used: float) -> tuple:
    """(location, content_type, body, seconds used, error) of one request of an article."""
    try:
        page = client.get(url, BYTES, SECONDS - used)
    except TimeoutError:
        return None, None, None, SECONDS, TIMEOUT
    except Exception:  # whatever a site does, its row says so
        return None, None, None, used, FAILED
    used += page.seconds
    headers = {k.lower(): v for k, v in page.headers.items()}
    if used > SECONDS:
        return None, None, None, used, LATE
    if len(page.body) > BYTES:
        return None, None, None, used, LARGE
    if 300 <= page.status < 400:
        try:
            to = urljoin(url, headers.get("location", ""))
        except ValueError:
            to = None
        missing = not to or "location" not in headers
        return None if missing else to, None, None, used, REDIRECT if missing else None
    kind = headers.get("content-type", "").partition(";")[0].strip().lower()
    if not 200 <= page.status < 300:
        return None, None, None, used, FAILED
    return (None, None, None, used, KIND) if kind not in KINDS else (None, kind, page.body, used, None)


def _requests(client: Callable[[], Client]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        one = client()
        for b in batches:
            told = [_asked(one, u, x) for u, x in zip(b["at"], b["used"], strict=True)]
            b = b.drop(columns=["used"])
            yield b.assign(**{c: [t[k] for t in told] for k, c in enumerate(("location", "content_type", "body", "used", "error"))})

    return run


def _robots(client: Callable[[], Client]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """(host, status, robots) of each host; a file that can't be read in time, or is too large, forbids nothing."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        one = client()
        for b in batches:
            rows = []
            for host in b["host"]:
                try:
                    page = one.get(f"{host}/robots.txt", ROBOTS_BYTES, ROBOTS_SECONDS)
                    ok = page.seconds <= ROBOTS_SECONDS and len(page.body) <= ROBOTS_BYTES
                    rows.append((host, page.status if ok else 0, page.body.decode("utf-8", "replace") if ok else ""))
                except Exception:  # no file that could forbid anything
                    rows.append((host, 0, ""))
            yield pd.DataFrame(rows, columns=["host", "status", "robots"])

    return run


@F.pandas_udf(T.StringType())
def host_of(urls: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Scheme and host of a link that the policy allows."""
    for batch in urls:
        yield batch.map(lambda u: "{0.scheme}://{0.netloc}".format(urlsplit(u)).lower(), na_action="ignore")


def articles(urls: DataFrame, client: Callable[[], Client], agent: str) -> DataFrame:
    """ARTICLE of every distinct link in urls(url). client() makes a client in each task; agent is the name that robots files
    are read for. A null link is blocked, as any that the policy doesn't allow."""
    spark = urls.sparkSession
    folder = scratch(spark, "articles")

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    done, known = [], None
    seen = urls.select("url").distinct().select("url", F.col("url").alias("at"), F.lit(0).alias("hops"), F.array("url").alias("seen"), F.lit(0.0).alias("used"))
    result = lambda df, **new: df.select("url", *[new.get(c, F.lit(None)).cast(t).alias(c) for c, t in (("final_url", "string"), ("content_type", "string"), ("body", "binary"))], F.col("hops"), new["error"].alias("error"))
    for round_ in range(REDIRECTS + 1):
        judged = kept(seen.withColumn("why", fetch_policy("at")), f"judged-{round_}")
        done.append(result(judged.where("why is not null"), error=F.when(F.col("hops") == 0, BLOCKED).otherwise(REDIRECT)))
        open_ = judged.where("why is null").drop("why").withColumn("host", host_of("at"))
        hosts = open_.select("host").distinct()
        new = hosts if known is None else hosts.join(known.select("host"), "host", "left_anti")
        found = kept(new.repartition("host").mapInPandas(_robots(client), "host string, status int, robots string"), f"robots-{round_}")
        known = found if known is None else known.unionByName(found)
        ruled = open_.join(known, "host").withColumn("allowed", robots_allow(agent)("status", "robots", "at")).drop("status", "robots")
        ruled = kept(ruled, f"ruled-{round_}")
        done.append(result(ruled.where("not allowed"), error=F.lit(DENIED)))
        lane = F.pmod(F.xxhash64("url"), F.lit(LANES))
        asked = ruled.where("allowed").drop("allowed").repartition("host", lane)
        schema = "url string, at string, hops int, seen array<string>, host string, location string, content_type string, body binary, used double, error string"
        got = kept(asked.select("url", "at", "hops", "seen", "host", "used").mapInPandas(_requests(client), schema), f"pages-{round_}")
        done.append(result(got.where("error is not null"), error=F.col("error")))
        done.append(result(got.where("body is not null"), final_url=F.col("at"), content_type=F.col("content_type"), body=F.col("body"), error=F.lit(None).cast("string")))
        moved = got.where("location is not null").withColumn("hops", F.col("hops") + 1)
        again = F.array_contains("seen", F.col("location")) | (F.col("hops") > REDIRECTS)
        done.append(result(moved.where(again), error=F.lit(REDIRECT)))
        seen = moved.where(~again).select("url", F.col("location").alias("at"), "hops", F.concat("seen", F.array("location")).alias("seen"), "used")
    out = done[0]
    for df in done[1:]:
        out = out.unionByName(df)
    return out.select("url", "final_url", "content_type", "body", "hops", "error")
