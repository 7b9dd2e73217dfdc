"""Translation backends behind one protocol, as column expressions or Arrow functions."""

from __future__ import annotations

import json
import re
import urllib.parse
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.harvest import Throttle, http, with_retry
from .chunk import chunks
from .routing import KNOWN_PAIRS


class Backend(Protocol):
    name: str
    supports_glossary: bool

    def translate(self, text: Column, source: str, target: str) -> Column: ...

    def supported_languages(self) -> list[str]: ...


class Identity:
    """Returns the text."""

    name, supports_glossary = "identity", False

    def translate(self, text: Column, source: str, target: str) -> Column:
        return text

    def supported_languages(self) -> list[str]:
        return []


class Prefix(Identity):
    """Marks the text with the target language; stays in the JVM and so can be checked by SQL."""

    name = "prefix"

    def translate(self, text: Column, source: str, target: str) -> Column:
        return F.concat(F.lit(f"{target.upper()}:"), text)


class Dictionary:
    """Replaces whole words by a fixed table."""

    name, supports_glossary = "dictionary", True

    def __init__(self, table: dict[str, str]):
        self.table = table

    def translate(self, text: Column, source: str, target: str) -> Column:
        words = F.split(text, " ")
        entries = F.create_map(*[F.lit(x) for kv in self.table.items() for x in kv]) if self.table else None
        return text if entries is None else F.array_join(F.transform(words, lambda w: F.coalesce(entries[F.lower(w)], w)), " ")

    def supported_languages(self) -> list[str]:
        return []


class Chat:
    """An OpenAI-compatible service, one request a chunk, with retry and throttling in the worker."""

    name, supports_glossary = "chat", True

    def __init__(
        self, url: str, model: str, interval: float = 0.0, fetch: Callable[[str, bytes | None], bytes] = http,
        glossary: tuple[tuple[str, str], ...] = (),
    ):
        self.url, self.model, self.interval, self.fetch, self.glossary = url, model, interval, fetch, tuple(glossary)

    @staticmethod
    def messages(text: str, source: str, target: str, glossary: list[tuple[str, str]] = ()) -> list[dict]:
        rules = f"Translate from {source} to {target}. Return the translation only."
        if glossary:
            rules += " Use these terms: " + "; ".join(f"{a} = {b}" for a, b in glossary)
        return [{"role": "system", "content": rules}, {"role": "user", "content": text}]

    def one(self, text: str, source: str, target: str, throttle: Throttle) -> str:
        out = []
        for part in chunks(text, 4000):
            throttle.wait()
            messages = self.messages(part, source, target, terms_of(part, self.glossary))
            body = {"model": self.model, "temperature": 0, "max_tokens": 2048, "messages": messages}
            answer = with_retry(lambda body=body: self.fetch(self.url, json.dumps(body).encode()))
            out.append(guarded(part, answer_text(json.loads(answer))))
        return "\n".join(out)

    def translate(self, text: Column, source: str, target: str) -> Column:
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            throttle = Throttle(self.interval)
            for s in batches:
                yield s.map(lambda t: self.one(t, source, target, throttle) if t else t)

        return F.pandas_udf(T.StringType())(run)(text)

    def supported_languages(self) -> list[str]:
        return []


class FormService(Chat):
    """A service with one address a language pair that takes a form and returns plain text, one request a chunk; a pair it
    does not know goes to the model that serves for all (``FALLBACK_PAIR``), languages included."""

    name, supports_glossary = "form", False

    def one(self, text: str, source: str, target: str, throttle: Throttle) -> str:
        out = []
        if f"{source}-{target}" not in KNOWN_PAIRS:
            source, target = FALLBACK_PAIR
        for part in chunks(text, 4000):
            throttle.wait()
            body = urllib.parse.urlencode({"input_text": part, "src": source, "tgt": target}).encode()
            answer = with_retry(lambda body=body: self.fetch(f"{self.url}/{self.model}/{source}-{target}", body))
            out.append(answer.decode().rstrip("\n"))
        return "\n".join(out)


def annotated(df: DataFrame, key: str, text: str, url: str, fetch: Callable[[str, bytes | None], bytes] = http) -> DataFrame:
    """(``key``, ``conllu``): texts annotated by a service, chunk by chunk; a failing chunk is left out."""
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t in batch.column(1).to_pylist():
                parts = []
                for part in chunks(t, 4000):
                    try:
                        answer = with_retry(lambda part=part: fetch(url, urllib.parse.urlencode({"data": part}).encode()))
                        parts.append(json.loads(answer)["result"])
                    except Exception:
                        continue
                out.append("\n".join(parts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=[key, "conllu"])

    return df.select(key, text).mapInArrow(run, f"{key} {kind}, conllu string")


#: Terms of the glossary a request names at most, the longest first: a limit of the prompt, as the services know it.
MOST_TERMS = 40
FALLBACK_PAIR = ("cs", "en")


def terms_of(text: str, glossary: tuple[tuple[str, str], ...], most: int = MOST_TERMS) -> list[tuple[str, str]]:
    """The terms of a glossary that stand in a text as whole words, in any case, the longest first."""
    low = text.lower()
    found = [(a, b) for a, b in glossary if a.lower() in low and re.search(rf"(?<!\w){re.escape(a.lower())}(?!\w)", low)]
    return sorted(found, key=lambda x: -len(x[0]))[:most]


def guarded(source: str, target: str, least_chars: int = 16, low: float = 0.25, high: float = 4.0) -> str:
    """The translation; an error if it is empty or, for a source of some length, out of proportion."""
    n, m = len(source.strip()), len(target.strip())
    if not m or (n >= least_chars and not n * low <= m <= n * high):
        raise ValueError(f"answer of {m} characters to a text of {n}")
    return target


def answer_text(answer: dict) -> str:
    """The text of a chat answer; an answer without one is an error."""
    try:
        return answer["choices"][0]["message"]["content"].strip()
    except (KeyError, IndexError, TypeError, AttributeError) as e:
        raise ValueError("answer holds no text") from e


_registry: dict[str, Callable[..., Backend]] = {"identity": Identity, "prefix": Prefix, "dictionary": Dictionary, "chat": Chat, "form": FormService}


def register(name: str, factory: Callable[..., Backend]) -> None:
    _registry[name] = factory


def names() -> list[str]:
    return sorted(_registry)


def create(name: str, **options) -> Backend:
    if name not in _registry:
        raise ValueError(f"unknown backend {name!r}; known: {', '.join(names())}")
    return _registry[name](**options)
