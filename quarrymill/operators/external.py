"""Models behind services: embedders, extractors and generators, with offline stand-ins.

A service is a plain object made once per task; results of paid calls should be stored before they are used
twice, so the columns are marked as non-deterministic and Spark never evaluates them again on its own.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from hashlib import sha256
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrymill.config import ANSWER_RULES, EXTRACT_RULES, SETTINGS, SITE_SECTIONS
from quarrymill.functions.urls import netloc, scheme


class Embedder(Protocol):
    def embed(self, texts: list[str]) -> list[list[float]]: ...


class TextModel(Protocol):
    def complete(self, prompt: str, system: str = "", schema: dict | None = None, temperature: float = 0.0) -> str: ...


class Throttled(Exception):
    """The service asks to slow down."""


def delays(first: float = SETTINGS.first_delay, longest: float = SETTINGS.longest_delay, tries: int = SETTINGS.retries) -> list[float]:
    """Pauses between the tries: doubling up to the longest."""
    return [min(first * 2**i, longest) for i in range(tries - 1)]


def with_retries(call: Callable, pauses: list[float] | None = None, sleep: Callable[[float], None] = time.sleep):
    """The result of ``call``; only a Throttled service is asked again, after each pause, and then fails."""
    for pause in [*(delays() if pauses is None else pauses), None]:
        try:
            return call()
        except Throttled:
            if pause is None:
                raise
            sleep(pause)


class HashEmbedder:
    """Signed hashing of words into a unit vector: deterministic, offline, no model."""

    def __init__(self, dimension: int = SETTINGS.dimension):
        self.dimension = dimension

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self.dimension), np.float64)
        for i, t in enumerate(texts):
            for w in (t or "").lower().split():
                h = int.from_bytes(sha256(w.encode()).digest()[:8], "little")
                out[i, h % self.dimension] += 1 if h >> 63 else -1
            n = np.linalg.norm(out[i])
            if n:
                out[i] /= n
        return out.tolist()


class EchoModel:
    """Answers with the first line of the context; an offline stand-in for a language model."""

    def complete(self, prompt: str, system: str = "", schema: dict | None = None, temperature: float = 0.0) -> str:
        lines = prompt.split("\n")
        return lines[1] if len(lines) > 1 else ""


def embed(text: Column, make: Callable[[], Embedder] = HashEmbedder, batch: int = SETTINGS.embed_batch, pause: float = 0.0) -> Column:
    """Vectors of texts, at most ``batch`` to a call, ``pause`` seconds after each; null for null."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for b in batches:
            out: list = [None] * len(b)
            at = [i for i, t in enumerate(b) if t is not None]
            for lo in range(0, len(at), batch):
                part = at[lo : lo + batch]
                for i, v in zip(part, with_retries(lambda part=part: model.embed([b.iloc[i] for i in part]))):
                    out[i] = v
                if pause:
                    time.sleep(pause)
            yield pd.Series(out, dtype=object)

    return run.asNondeterministic()(text)


class FirstSentences:
    """Takes the first sentences of a site for its summary; an offline stand-in for an extracting model."""

    def complete(self, prompt: str, system: str = "", schema: dict | None = None, temperature: float = 0.0) -> str:
        text = prompt.rpartition("\n\nText:\n")[2]
        return json.dumps({"website_summary": ". ".join(text.split(". ")[:2])}, ensure_ascii=False)


def complete(prompt: Column, make: Callable[[], TextModel] = EchoModel, pause: float = 0.0, system: str = ANSWER_RULES) -> Column:
    """Answers to prompts under the given rules, one call each at temperature 0; null for null."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for b in batches:
            out = []
            for p in b:
                out.append(None if p is None else with_retries(lambda p=p: model.complete(p, system=system, temperature=0.0)))
                if pause and p is not None:
                    time.sleep(pause)
            yield pd.Series(out, dtype=object)

    return run.asNondeterministic()(prompt)


def reply_schema() -> dict:
    """What an extractor's reply must look like, as a JSON schema."""
    listed = {"type": "array", "items": {"type": "string"}}
    return {"type": "object", "properties": {k: {"type": "string"} if k == "website_summary" else listed for k in SITE_SECTIONS}, "required": list(SITE_SECTIONS)}


def extract(text: Column, make: Callable[[], TextModel] = FirstSentences, pause: float = 0.0, rules: str = EXTRACT_RULES) -> Column:
    """The facts of a site's text as a JSON object; a reply that is none gives ``{}``. Null for null."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model, schema = make(), reply_schema()
        for b in batches:
            out = []
            for t in b:
                if t is None:
                    out.append(None)
                    continue
                reply = with_retries(lambda t=t: model.complete(f"{rules}\n\nText:\n{t}", schema=schema, temperature=0.0))
                try:
                    good = isinstance(json.loads(reply), dict)
                except (TypeError, ValueError):
                    good = False
                out.append(reply if good else "{}")
                if pause:
                    time.sleep(pause)
            yield pd.Series(out, dtype=object)

    return run.asNondeterministic()(text)


def _open(url: str, agent: str, timeout: float) -> tuple[int, str, bytes]:
    """(status, content type, body) of a page; error statuses are no exceptions."""
    request = urllib.request.Request(url, headers={"User-Agent": agent})
    try:
        with urllib.request.urlopen(request, timeout=timeout) as r:
            return r.status, r.headers.get("Content-Type") or "", r.read()
    except urllib.error.HTTPError as e:
        return e.code, e.headers.get("Content-Type") or "", e.read()


def responses(df: DataFrame, url: str, open_: Callable[[str, str, float], tuple[int, str, bytes]] = _open, agent: str = SETTINGS.agent, timeout: float = SETTINGS.timeout, delay: float = SETTINGS.delay) -> DataFrame:
    """``df`` with status, content_type, body, detected (charset) and error of each address; pages of a host are fetched one after the other."""
    names = df.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for u in b[url]:
                try:
                    status, kind, body = open_(u, agent, timeout)
                    error = None
                except TimeoutError:
                    status, kind, body, error = None, None, None, "timeout"
                except (OSError, ValueError) as e:
                    reason = getattr(e, "reason", None)
                    slow = isinstance(reason, TimeoutError)
                    status, kind, body, error = None, None, None, "timeout" if slow else type(reason if isinstance(reason, Exception) else e).__name__
                guess = None
                if body is not None:
                    try:
                        body.decode("utf-8")
                        guess = "utf-8"
                    except UnicodeDecodeError:
                        guess = "cp1252"
                rows.append((status, kind, body, guess, error))
                if delay:
                    time.sleep(delay)
            got = pd.DataFrame(rows, columns=["status", "content_type", "body", "detected", "error"], index=b.index)
            got["status"] = got["status"].astype("Int32")
            yield pd.concat([b, got], axis=1)

    form = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.repartition(netloc(F.col(url))).select(*names).mapInPandas(run, f"{form}, status int, content_type string, body binary, detected string, error string")


def http_fetch(open_: Callable[[str, str, float], tuple[int, str, bytes]] = _open, **how) -> Callable[[DataFrame, str], DataFrame]:
    """A fetcher for ``crawl`` and the jobs: html by declared, else detected charset, and why there is none."""
    from quarrymill.operators.crawl import decoded, failure

    def fetch(df: DataFrame, url: str) -> DataFrame:
        got = responses(df, url, open_, **how).withColumn("reason", failure(F.col("status"), F.col("content_type"), F.col("error")))
        html = F.when(F.col("reason").isNull(), decoded(F.col("body"), F.col("content_type"), F.col("detected")))
        return got.withColumn("html", html).drop("status", "content_type", "body", "detected", "error")

    return fetch


def robots_rules(sites: DataFrame, url: str, open_: Callable[[str, str, float], tuple[int, str, bytes]] = _open, **how) -> DataFrame:
    """(scheme, host, status, body) of robots.txt, fetched once for each scheme and host of the sites."""
    hosts = sites.select(scheme(F.col(url)).alias("scheme"), netloc(F.col(url)).alias("host")).where("host <> ''").distinct()
    got = responses(hosts.withColumn("url", F.concat("scheme", F.lit("://"), "host", F.lit("/robots.txt"))), "url", open_, **how)
    return got.select("scheme", "host", "status", F.decode("body", "UTF-8").alias("body"))
