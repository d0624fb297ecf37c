"""Fetching pages over HTTP, politely; the opener is given in tests and used on executors."""

from __future__ import annotations

import re
import time
import urllib.error
import urllib.request
from collections.abc import Callable
from urllib.parse import urljoin

TRIES, WAIT_AT_MOST, DELAY_AT_MOST = 3, 30, 5.0
LEAST_CHARS = 50

Opener = Callable[[str], tuple[int, dict[str, str], bytes]]


def open_url(url: str, agent: str = "quern", timeout: float = 20.0) -> tuple[int, dict[str, str], bytes]:
    """(status, headers in lower case, body)."""
    request = urllib.request.Request(url, headers={"User-Agent": agent})
    try:
        with urllib.request.urlopen(request, timeout=timeout) as r:
            return r.status, {k.lower(): v for k, v in r.headers.items()}, r.read()
    except urllib.error.HTTPError as e:
        return e.code, {k.lower(): v for k, v in e.headers.items()}, e.read()


class Fetcher:
    """url -> (status, content type, body): waits between requests, tries a 429 again, prefers a page's own Markdown.

    A 429 doubles the delay, to five seconds at most; Retry-After is followed up to thirty. A Markdown version counts when it
    has fifty characters. Each task has a copy of its own.
    """

    def __init__(self, opener: Opener = open_url, delay: float = 0.5, sleep: Callable[[float], None] = time.sleep):
        self.opener, self.delay, self.sleep = opener, delay, sleep

    def __call__(self, url: str) -> tuple[int, str, str]:
        self.sleep(self.delay)
        for k in range(TRIES):
            status, headers, body = self.opener(url)
            if status != 429 or k + 1 == TRIES:
                break
            after = headers.get("retry-after", "")
            self.sleep(min(int(after) if after.isdigit() else 2**k, WAIT_AT_MOST))
            self.delay = min(self.delay * 2, DELAY_AT_MOST)
        kind, text = headers.get("content-type", ""), body.decode("utf-8", "replace")
        if status == 200 and "text/html" in kind and (other := markdown_link(text, url)):
            s, _, b = self.opener(other)
            md = b.decode("utf-8", "replace")
            if s == 200 and len(md.strip()) >= LEAST_CHARS:
                return status, "text/html; text/markdown", md
        return status, kind, text


def markdown_link(html: str, base: str) -> str | None:
    """The absolute address of a page's Markdown version."""
    for tag in re.findall(r"(?is)<link\b[^>]*>", html):
        if re.search(r"""(?i)rel\s*=\s*["']?alternate""", tag) and re.search(r"""(?i)type\s*=\s*["']?text/markdown""", tag) and (m := re.search(r"""(?i)href\s*=\s*["']([^"']+)""", tag)):
            return urljoin(base, m[1])
    return None
