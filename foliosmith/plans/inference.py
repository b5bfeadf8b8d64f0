"""Inference steps behind a registry of backends; the engine ships a deterministic stub.

A backend turns (prompt, image reference) requests into answers; ``infer`` asks once a row, in Arrow batches, with one
client a Python worker, made when the first row arrives.  Failures become an ``error`` column and never raise for a row.
What a backend answers with (its name, models, server and sampling) is its identity, which is part of every memo key.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from abc import ABC, abstractmethod
from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import partial
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..sources.journal import Journal


class Backend(ABC):
    """Text out of prompts and image references; an image reference names a page image, and a pixel box of it after ``#``."""

    name = ""
    supports_grounding = False
    #: The least build of a server that it works with, and the most tokens of an answer; None: no such bound.
    least_build: int | None = None
    max_tokens: int | None = None

    def __init__(self, model: str = "", projector: str = "", endpoint: str = "", server: str = ""):
        self.model, self.projector, self.endpoint, self.server = model, projector, endpoint, server

    def page_prompt(self) -> str:
        """What a page image is sent with."""
        return ""

    def sampling(self) -> dict[str, Any]:
        return {"temperature": 0}

    def template_options(self) -> dict[str, Any] | None:
        return None

    def identity(self) -> dict[str, str]:
        """All that decides the answer to a request; part of its key."""
        model = f"endpoint:{self.endpoint}:{self.model}" if self.endpoint else self.model
        settings = {"sampling": self.sampling() | ({"max_tokens": self.max_tokens} if self.max_tokens else {}), "template": self.template_options()}
        return {"backend": self.name, "model": model, "projector": self.projector, "server": self.server, "settings": json.dumps(settings, sort_keys=True)}

    @abstractmethod
    def answer(self, prompt: str, image: str | None) -> tuple[str, str]:
        """(text, finish reason) of one request."""


class StubBackend(Backend):
    """A deterministic stand-in: its answer is made of the request's digest, a page's a text block of it."""

    name = "stub"
    supports_grounding = True

    def page_prompt(self) -> str:
        return "<page>"

    def answer(self, prompt: str, image: str | None) -> tuple[str, str]:
        mark = hashlib.sha256(f"{image}\n{prompt}".encode()).hexdigest()[:12]
        if prompt == self.page_prompt():
            return f"text[[10, 10, 900, 900]]Stub page {mark}.", "stop"
        return f"<img_desc>Stub description {mark}.</img_desc>", "stop"


_BACKENDS: dict[str, Callable[..., Backend]] = {"stub": StubBackend}


def register(name: str, make: Callable[..., Backend]) -> None:
    """Makes a backend known; ``make`` takes model, projector, endpoint and server."""
    _BACKENDS[name] = make


def known_backends() -> list[str]:
    return sorted(_BACKENDS)


def maker(name: str, **options: str) -> Callable[[], Backend]:
    """What makes a backend; looked up here, so that it goes to workers that know of no registration."""
    if name not in _BACKENDS:
        raise ValueError(f"unknown backend {name!r}; known: {', '.join(known_backends())}")
    return partial(_BACKENDS[name], **options)


def get_backend(name: str, **options: str) -> Backend:
    return maker(name, **options)()


#: What a request is tried again after; anything else is an error of its row at once.
PASSING = (ConnectionError, TimeoutError)


def _answered(backend: Backend, prompt: str, image: str | None, tries: int, pause: float) -> tuple[str | None, str | None, str | None]:
    """(text, finish reason, error) of one request; after a passing failure it is tried again, each time after twice the pause."""
    for left in range(tries - 1, -1, -1):
        try:
            return *backend.answer(prompt, image), None
        except PASSING as e:
            if not left:
                return None, None, str(e)
            time.sleep(pause)
            pause *= 2
        except Exception as e:  # a failed request is data, not a failed job
            return None, None, str(e)
    raise ValueError("a request needs at least one try")


def _in_order(requests: Iterator[tuple], ask: Callable[[tuple], tuple], in_flight: int) -> Iterator[tuple]:
    """``ask`` of each request, at most ``in_flight`` at once, in the order of the requests; none is taken before there is room for it."""
    if in_flight == 1:
        yield from map(ask, requests)
        return
    with ThreadPoolExecutor(in_flight) as pool:
        window: deque = deque()
        for request in requests:
            window.append(pool.submit(ask, request))
            if len(window) == in_flight:
                yield window.popleft().result()
        while window:
            yield window.popleft().result()


def infer(misses: DataFrame, make: Callable[[], Backend], key: str = "key", prompt: str = "prompt", image: str = "image", in_flight: int = 1, tries: int = 3, pause: float = 0.5, journal: Journal | None = None) -> DataFrame:
    """(key, text, finish_reason, error) of distinct misses; nothing starts where there are none.

    A worker has one client and keeps at most ``in_flight`` requests waiting for it at once; a client that is no safe thing for several threads takes 1.
    With a ``journal`` each task commits its answers as they come, so that a run that is stopped loses at most one batch a task.
    """
    if in_flight < 1 or tries < 1:
        raise ValueError("in_flight and tries are at least 1")
    run_id = uuid.uuid4().hex

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        backend, log = None, None
        for batch in batches:
            if not len(batch):
                continue
            backend = backend or make()
            log = log or (journal.writer(run_id) if journal else None)
            rows = []
            ask = lambda row: (row[0], *_answered(backend, row[1], row[2], tries, pause))
            for row in _in_order(batch.itertuples(index=False), ask, in_flight):
                rows.append(row)
                if log and row[3] is None:
                    log.add(*row[:3])
            yield pd.DataFrame(rows, columns=["key", "text", "finish_reason", "error"])
        if log:
            log.commit()

    return misses.select(key, prompt, F.col(image).cast("string")).mapInPandas(run, "key string, text string, finish_reason string, error string").withColumnRenamed("key", key)
