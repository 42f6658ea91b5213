"""Fetching in rounds, with a web that a dictionary describes."""

from __future__ import annotations

import os
import uuid

from sparkdigest.sources import articles as a

HTML = {"Content-Type": "text/html; charset=utf-8"}


class Web:
    """Leaves a file for each request."""

    def __init__(self, pages, folder):
        self.pages, self.folder = pages, folder

    def get(self, url, most, seconds):
        open(f"{self.folder}/{url.replace('/', '+')}~{uuid.uuid4().hex}", "w").close()
        if url.endswith("/robots.txt") and url not in self.pages:
            return a.Page(404)
        page = self.pages[url]
        if isinstance(page, Exception):
            raise page
        return page


def _moved(to):
    return a.Page(302, {"Location": to} if to is not None else {}, seconds=1.0)


def _asked(folder):
    return sorted(x.partition("~")[0].replace("+", "/") for x in os.listdir(folder))


def _fetched(spark, folder, urls, pages):
    df = a.articles(spark.createDataFrame([(u,) for u in urls], "url string"), lambda: Web(pages, str(folder)), "reader")
    assert df.columns == ["url", "final_url", "content_type", "body", "hops", "error"]
    return {r.url: (r.final_url, r.hops, r.error) for r in df.collect()}


def test_redirects_policy_robots_limits_and_deadlines(spark, tmp_path):
    s = "https://s.example"
    pages = {f"{s}/{k}": _moved(f"/{k + 1}") for k in range(10)} | {f"{s}/5": a.Page(200, HTML, b"five"), f"{s}/19": a.Page(200, HTML, b"end")}
    pages |= {f"{s}/{k}": _moved(f"{s}/{k + 1}") for k in range(12, 19)}
    pages |= {
        f"{s}/loop": _moved("/loop2"),
        f"{s}/loop2": _moved("/loop"),
        f"{s}/inside": _moved("http://127.0.0.1/x"),
        f"{s}/nowhere": _moved(None),
        f"{s}/pdf": a.Page(200, {"content-type": "application/pdf"}, b"x"),
        f"{s}/large": a.Page(200, HTML, b"x" * (a.BYTES + 1)),
        f"{s}/broken": a.Page(500, HTML),
        f"{s}/error": ValueError("x"),
        "https://slow.example/": TimeoutError(),
        "https://late.example/a": a.Page(302, {"location": "/b"}, seconds=20.0),
        "https://late.example/b": a.Page(200, HTML, b"x", 11.0),
        "https://shut.example/robots.txt": a.Page(200, {}, b"User-agent: *\nDisallow: /private"),
        "https://shut.example/private/x": a.Page(200, HTML, b"x"),
        "https://shut.example/open": a.Page(200, {"content-type": "text/plain"}, b"x"),
        f"{s}/to-shut": _moved("https://shut.example/private/x"),
        "https://lazy.example/robots.txt": a.Page(200, {}, b"User-agent: *\nDisallow: /", seconds=3.0),
        "https://lazy.example/": a.Page(200, HTML, b"x"),
    }
    urls = [f"{s}/0", f"{s}/12", f"{s}/13", f"{s}/14", *(f"{s}/{x}" for x in ("loop", "inside", "nowhere", "pdf", "large", "broken", "error", "to-shut")), "https://slow.example/", "https://late.example/a", "https://shut.example/private/x", "https://shut.example/open", "https://lazy.example/", "ftp://x.example/", "https://u:p@x.example/", "http://10.0.0.1/", "", None, f"{s}/0"]
    found = _fetched(spark, tmp_path, urls, pages)
    assert found == {
        f"{s}/0": (f"{s}/5", 5, None),
        f"{s}/12": (None, 6, a.REDIRECT),
        f"{s}/13": (None, 6, a.REDIRECT),
        f"{s}/14": (f"{s}/19", 5, None),
        f"{s}/loop": (None, 2, a.REDIRECT),
        f"{s}/inside": (None, 1, a.REDIRECT),
        f"{s}/nowhere": (None, 0, a.REDIRECT),
        f"{s}/pdf": (None, 0, a.KIND),
        f"{s}/large": (None, 0, a.LARGE),
        f"{s}/broken": (None, 0, a.FAILED),
        f"{s}/error": (None, 0, a.FAILED),
        f"{s}/to-shut": (None, 1, a.DENIED),
        "https://slow.example/": (None, 0, a.TIMEOUT),
        "https://late.example/a": (None, 1, a.LATE),
        "https://shut.example/private/x": (None, 0, a.DENIED),
        "https://shut.example/open": ("https://shut.example/open", 0, None),
        "https://lazy.example/": ("https://lazy.example/", 0, None),
        "ftp://x.example/": (None, 0, a.BLOCKED),
        "https://u:p@x.example/": (None, 0, a.BLOCKED),
        "http://10.0.0.1/": (None, 0, a.BLOCKED),
        "": (None, 0, a.BLOCKED),
        None: (None, 0, a.BLOCKED),
    }
    asked = _asked(tmp_path)
    robots = [u for u in asked if u.endswith("robots.txt")]
    assert len(robots) == len(set(robots)) == 5  # once a host, also where a redirect leads to it
    assert not [u for u in asked if "private" in u or "127.0" in u]
    assert asked.count(f"{s}/0") == 1


def test_nothing_to_fetch(spark, tmp_path):
    assert _fetched(spark, tmp_path, [], {}) == {} and _asked(tmp_path) == []
