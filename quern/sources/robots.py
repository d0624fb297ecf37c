"""robots.txt: which addresses a crawler may fetch, and the sitemaps it names."""

from __future__ import annotations

from collections.abc import Callable
from urllib.robotparser import RobotFileParser


def sitemaps(robots: str) -> list[str]:
    """Addresses after ``sitemap:``, in any case."""
    return [u for line in robots.splitlines() if line.strip().lower().startswith("sitemap:") and (u := line.split(":", 1)[1].strip())]


def allowed(robots: str | None, agent: str) -> Callable[[str], bool]:
    """A test of addresses; without a robots.txt everything is allowed. Blank lines do not end a record."""
    if robots is None:
        return lambda url: True
    parser = RobotFileParser()
    parser.parse([line for line in robots.splitlines() if line.strip()])
    return lambda url: parser.can_fetch(agent, url)
