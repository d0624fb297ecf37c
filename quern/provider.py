"""Calls to a language model behind one small protocol, with retries and a deterministic stand-in for tests."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator
from typing import Protocol

ATTEMPTS, FIRST_WAIT = 3, 5.0


class ModelAuthError(RuntimeError):
    """The provider refuses the credentials; trying again is of no use."""


class ModelProvider(Protocol):
    """What operators need of a model: one call that returns text. It is shipped to executors, and so must pickle."""

    def __call__(self, prompt: str, model: str, max_tokens: int) -> str: ...


def retrying(call: Callable[..., str], attempts: int = ATTEMPTS, wait: float = FIRST_WAIT, sleep: Callable[[float], None] = time.sleep) -> Callable[..., str]:
    """The call, tried up to ``attempts`` times with doubled waits; refused credentials end it at once."""

    def run(*args, **kwargs) -> str:
        for k in range(attempts):
            try:
                return call(*args, **kwargs)
            except ModelAuthError:
                raise
            except Exception:
                if k + 1 == attempts:
                    raise
                sleep(wait * 2**k)
        raise AssertionError("no attempt was made")

    return run


def retrying_stream(call: Callable[..., Iterator[str]], attempts: int = ATTEMPTS, wait: float = FIRST_WAIT, sleep: Callable[[float], None] = time.sleep) -> Callable[..., Iterator[str]]:
    """As ``retrying`` for streams; nothing is tried again once a part was handed out."""

    def run(*args, **kwargs) -> Iterator[str]:
        for k in range(attempts):
            begun = False
            try:
                for part in call(*args, **kwargs):
                    begun = True
                    yield part
                return
            except ModelAuthError:
                raise
            except Exception:
                if begun or k + 1 == attempts:
                    raise
                sleep(wait * 2**k)

    return run


class EchoModel:
    """Answers every kind of prompt from the prompt alone: the same input, the same reply."""

    def __call__(self, prompt: str, model: str = "", max_tokens: int = 0) -> str:
        if pages := re.findall(r"^### PAGE (p\d+).*\n(.*)", prompt, re.M):
            return json.dumps({"pages": [{"id": i, "title": t[:40] or "Ohne Titel", "summary": t[:80], "keypoints": [t[:20]], "entities": [{"name": w, "label": "Begriff", "props": {}} for w in re.findall(r"[A-ZÄÖÜ]\w{3,}", t)[:3]], "edges": []} for i, t in pages]})
        if docs := re.findall(r"^### DOC (\S+)$", prompt, re.M):
            return json.dumps({"assignments": [], "new_clusters": [{"slug": "sammlung", "name": "Sammlung", "description": "", "members": docs}]})
        return "none"
