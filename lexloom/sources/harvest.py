"""Paged and queried web sources as Python data sources, with retry, back-off and throttling.

A source reads in one task, since each page names the next. What had been read before a failure is kept.
"""

from __future__ import annotations

import json
import random
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader

from .xml_nodes import shred

RETRYABLE = frozenset({429, 500, 502, 503, 504})
Fetch = Callable[[str, bytes | None], bytes]


class Throttle:
    """At least ``interval`` seconds between calls of one worker."""

    def __init__(self, interval: float, clock=time.monotonic, sleep=time.sleep):
        self.interval, self.clock, self.sleep, self.last = interval, clock, sleep, None

    def wait(self) -> None:
        now = self.clock()
        if self.last is not None and now - self.last < self.interval:
            self.sleep(self.interval - (now - self.last))
        self.last = self.clock()


def with_retry(call: Callable[[], bytes], tries: int = 5, base: float = 1.0, sleep=time.sleep) -> bytes:
    """``call`` again after network errors and busy answers, waiting base * 2 ** k and a little; other errors at once."""
    for k in range(tries):
        try:
            return call()
        except urllib.error.HTTPError as e:
            if e.code not in RETRYABLE or k + 1 == tries:
                raise
        except (urllib.error.URLError, TimeoutError, ConnectionError):
            if k + 1 == tries:
                raise
        sleep(base * 2**k + random.uniform(0, 0.25))
    raise AssertionError("unreachable")


def http(url: str, body: bytes | None = None, timeout: float = 60.0) -> bytes:
    request = urllib.request.Request(url, data=body, headers={"Content-Type": "application/json"} if body else {})
    with urllib.request.urlopen(request, timeout=timeout) as answer:
        return answer.read()


def oai_records(base: str, prefix: str, fetch: Fetch = http, delay: float = 0.0, sleep=time.sleep) -> Iterator[tuple[str, str, str]]:
    """(id, lang, label) of every record of a paged listing; stops quietly at a failing or malformed page."""
    url = f"{base}?verb=ListRecords&metadataPrefix={urllib.parse.quote(prefix)}"
    while url:
        try:
            nodes = shred(fetch(url, None))  # refuses entities, loads nothing from outside
        except Exception:
            return
        record, ident = -1, {}
        owner = []  # the record each element is in
        for n in nodes:
            record = n.node_id if n.tag == "record" else owner[n.parent_id] if n.parent_id >= 0 else -1
            owner.append(record)
            if n.tag == "identifier" and record >= 0:
                ident.setdefault(record, n.text or "")
        for n, record in zip(nodes, owner):
            lang = n.attrs.get("lang")
            if record >= 0 and lang and n.text and n.text.strip():
                yield ident.get(record, ""), lang, n.text.strip()
        token = next((n.text for n in nodes if n.tag == "resumptionToken" and n.text), None)
        url = f"{base}?verb=ListRecords&resumptionToken={urllib.parse.quote(token)}" if token else ""
        if url and delay:
            sleep(delay)


def graphql(url: str, query: str, fetch: Fetch = http, variables: dict | None = None) -> dict:
    """The data of a query; an answer with errors raises."""
    body = {"query": query} | ({"variables": variables} if variables else {})
    answer = json.loads(fetch(url, json.dumps(body).encode()))
    if answer.get("errors"):
        raise ValueError(f"query failed: {answer['errors']}")
    return answer.get("data") or {}


INTROSPECTION = "{ __schema { types { name fields { name args { name } type { name ofType { name ofType { name } } } } } } }"


def offered(url: str, fetch: Fetch = http) -> tuple[dict[str, dict], dict[str, list[str]]]:
    """(queries a service offers by name, fields of its types by name); both empty where it does not describe itself."""
    try:
        types = graphql(url, INTROSPECTION, fetch).get("__schema", {}).get("types") or []
    except Exception:
        return {}, {}
    fields = {t["name"]: [f["name"] for f in t.get("fields") or []] for t in types}
    queries = next((t.get("fields") or [] for t in types if t["name"] == "Query"), [])
    return {f["name"]: f for f in queries}, fields


def inner_type(kind: dict | None) -> str | None:
    """The name of a type inside its lists and non-nulls."""
    while kind and kind.get("ofType"):
        kind = kind["ofType"]
    return (kind or {}).get("name")


def search_query(args: list[str], lang: str, fields: list[str] = ("id", "name", "url"), limit: int = 99_999) -> tuple[str, dict]:
    """(query, variables) of a search for everything, written for the arguments the service offers."""
    known = {"language": ("$lang: Language!", "language: $lang", "lang", lang.upper()), "limit": ("$limit: Int!", "limit: $limit", "limit", limit)}
    used = [known[a] for a in ("limit", "language") if a in args]
    head = f"({', '.join(u[0] for u in used)})" if used else ""
    given = ", ".join(['value: ""', *[u[1] for u in used]])
    return f"query GetSearch{head} {{ search({given}) {{ {' '.join(fields)} }} }}", {u[2]: u[3] for u in used}


def searched(url: str, source: str = "cs", target: str = "en", fetch: Fetch = http) -> Iterator[tuple[str, str, str]]:
    """(id, lang, label) of all terms of a service that offers a search, in two languages; nothing where it does not."""
    queries, types = offered(url, fetch)
    search = queries.get("search")
    if search is None:
        return
    fields = types.get(inner_type(search.get("type")) or "") or ["id", "name", "url"]
    pick = lambda *hints: next((f for h in hints for f in fields if h in f.lower()), None)
    key, label = pick("id"), pick("name", "term")
    if not key or not label:
        return
    for lang in (source, target):
        query, variables = search_query([a["name"] for a in search.get("args") or []], lang, fields)
        items = graphql(url, query, fetch, variables).get("search")
        for item in items if isinstance(items, list) else []:
            yield str(item.get(key) or ""), lang, (item.get(label) or "").strip()


def exported(url: str, parse: Callable[[bytes], list[tuple[str, str, str]]] | None, fetch: Fetch = http) -> list[tuple[str, str, str]]:
    """The terms of a service's whole export, read by ``parse``; none where it offers no export or no reader is given."""
    if parse is None or "exportAll" not in offered(url, fetch)[0]:
        return []
    try:
        at = graphql(url, "{ exportAll }", fetch).get("exportAll")
        return parse(fetch(at, None)) if isinstance(at, str) and at.startswith("http") else []
    except Exception:
        return []


def harvested(url: str, parse: Callable[[bytes], list[tuple[str, str, str]]] | None = None, fetch: Fetch = http) -> list[tuple[str, str, str]]:
    """The whole export of a service where it offers one that can be read, else what its search finds."""
    return exported(url, parse, fetch) or list(searched(url, fetch=fetch))


class SearchSource(DataSource):
    """``spark.dataSource.register(SearchSource)``; option ``url``: the terms of a queried service."""

    @classmethod
    def name(cls) -> str:
        return "search_terms"

    def schema(self) -> str:
        return "id string, lang string, label string"

    def reader(self, schema) -> DataSourceReader:
        return _SearchReader(self.options)


class _SearchReader(DataSourceReader):
    def __init__(self, options):
        self.url = options["url"]

    def read(self, partition):
        yield from harvested(self.url, fetch=lambda u, body: with_retry(lambda: http(u, body)))


class OaiSource(DataSource):
    """``spark.dataSource.register(OaiSource)``; options ``url`` (http or file), ``prefix`` and ``delay`` (seconds between pages)."""

    @classmethod
    def name(cls) -> str:
        return "oai_terms"

    def schema(self) -> str:
        return "id string, lang string, label string"

    def reader(self, schema) -> DataSourceReader:
        return _OaiReader(self.options)


class _OaiReader(DataSourceReader):
    def __init__(self, options):
        self.url, self.prefix = options["url"], options.get("prefix", "oai_dc")
        self.delay = float(options.get("delay") or 0.0)

    def read(self, partition):
        def fetch(url: str, body: bytes | None) -> bytes:
            if url.startswith("file://"):
                token = urllib.parse.parse_qs(urllib.parse.urlparse(url).query).get("resumptionToken", ["1"])[0]
                with open(urllib.parse.urlparse(url).path + f"/page{token}.xml", "rb") as f:
                    return f.read()
            return with_retry(lambda: http(url, body))

        yield from oai_records(self.url, self.prefix, fetch, self.delay)


def fetched(urls, prefix: str = "", fetch: Fetch = http, tries: int = 5):
    """(``url``, ``name``, ``content``, ``error``) of every url of a DataFrame; a failure is kept as an error, not raised."""
    import pyarrow as pa
    from pyspark.sql import functions as F

    from ..functions.text import url_safe_name

    def read(batches):
        for batch in batches:
            out = []
            for url in batch.column(0).to_pylist():
                try:
                    out.append((with_retry(lambda url=url: fetch(url, None), tries), None))
                except Exception as e:
                    out.append((None, str(e)[:200]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.string())],
                names=["url", "name", "content", "error"],
            )

    named = urls.select("url", url_safe_name(F.col("url"), prefix).alias("name"))
    return named.mapInArrow(read, "url string, name string, content binary, error string")
