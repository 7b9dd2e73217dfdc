"""XML as a node table, simple paths over it, layout reading, and value-exact rewriting.

The shredder is an expat pass that expands no entities and loads nothing from outside. It notes for every element its
path, its text before the first child and the byte range of that text, and for every attribute the byte range of its
value, so a rewritten file differs from its source in those bytes only.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from xml.parsers import expat
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NODES = (
    "node_id int, parent_id int, depth int, tag string, ns_uri string, path string, attrs map<string,string>, text string, "
    "text_from int, text_to int, tag_from int, tag_to int, declared array<string>"
)


@dataclass(slots=True)
class Node:
    node_id: int
    parent_id: int
    depth: int
    tag: str
    ns_uri: str
    path: str
    attrs: dict[str, str]
    parts: list[str] = field(default_factory=list)
    open_text: bool = True
    text_from: int = -1
    text_to: int = -1
    tag_from: int = -1
    tag_to: int = -1
    scopes: tuple[tuple[str | None, str], ...] = ()

    @property
    def declared(self) -> list[str]:
        """The namespaces the element declares, in order."""
        return [uri for _, uri in self.scopes]

    @property
    def text(self) -> str | None:
        return "".join(self.parts) if self.parts else None


def shred(content: bytes) -> list[Node]:
    """All elements in document order; raises ``ValueError`` for a file that is not well-formed or declares entities."""
    parser = expat.ParserCreate(namespace_separator="\n")
    parser.buffer_text = False
    parser.ordered_attributes = True
    nodes: list[Node] = []
    stack: list[Node] = []
    scopes: list[tuple[str | None, str]] = []  # prefixes and namespaces of the element to come

    def start(name: str, attrs: list[str]) -> None:
        uri, _, local = name.rpartition("\n")
        at = parser.CurrentByteIndex
        if stack:
            close_text(stack[-1], at)
        parent = stack[-1] if stack else None
        pairs = {a.rpartition("\n")[2]: v for a, v in zip(attrs[::2], attrs[1::2])}
        path = (parent.path if parent else "") + "/" + local
        node = Node(len(nodes), parent.node_id if parent else -1, len(stack), local, uri, path, pairs, tag_from=at, scopes=tuple(scopes))
        scopes.clear()
        nodes.append(node)
        stack.append(node)

    def close_text(node: Node, at: int) -> None:
        if node.open_text:
            node.open_text = False
            if node.text_from >= 0:
                node.text_to = at

    def data(text: str) -> None:
        node = stack[-1]
        if node.open_text:
            if node.text_from < 0:
                node.text_from = parser.CurrentByteIndex
            node.parts.append(text)

    def end(_: str) -> None:
        close_text(stack.pop(), parser.CurrentByteIndex)

    def stop_text(*_) -> None:
        if stack:
            close_text(stack[-1], parser.CurrentByteIndex)

    def refuse(*_) -> None:
        raise ValueError("entity declarations are refused")

    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, data
    parser.CommentHandler = parser.ProcessingInstructionHandler = stop_text
    parser.EntityDeclHandler = refuse
    parser.StartNamespaceDeclHandler = lambda prefix, uri: scopes.append((prefix, uri)) if uri else None
    try:
        parser.Parse(content, True)
    except expat.ExpatError as e:
        raise ValueError(str(e)) from e
    for node in nodes:
        node.tag_to = _tag_end(content, node.tag_from)
    return nodes


def _tag_end(content: bytes, at: int) -> int:
    """The byte after the ``>`` of the start tag at ``at``; quotes may hide a ``>``."""
    end = content.find(b">", at) + 1
    tag = content[at:end]
    if end and tag.count(b'"') % 2 == 0 and tag.count(b"'") % 2 == 0:
        return end
    quote = 0
    for i in range(at, len(content)):
        c = content[i]
        if quote:
            quote = 0 if c == quote else quote
        elif c in (34, 39):
            quote = c
        elif c == 62:
            return i + 1
    return len(content)


def node_table(files: DataFrame, key: str = "doc_id", content: str = "content") -> DataFrame:
    """(``key``, NODES) of every well-formed file; others come out as one row with a null ``node_id``."""
    kind = dict(files.dtypes)[key]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k, c in zip(*(x.to_pylist() for x in batch.columns)):
                try:
                    found = shred(bytes(c) if not isinstance(c, str) else c.encode())
                except (ValueError, TypeError):
                    rows.append((k, *[None] * 13))
                    continue
                rows += [
                    (k, n.node_id, n.parent_id, n.depth, n.tag, n.ns_uri, n.path, list(n.attrs.items()), n.text, n.text_from, n.text_to, n.tag_from, n.tag_to, n.declared)
                    for n in found
                ]
            i, s = pa.int32(), pa.string()
            types = (batch.schema.field(0).type, i, i, i, s, s, s, pa.map_(s, s), s, i, i, i, i, pa.list_(s))
            names = [key, *[x.split()[0] for x in NODES.split(", ")]]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate(types)], names=names)

    return files.select(key, content).mapInArrow(read, f"{key} {kind}, {NODES}")


_step = re.compile(r"(//|/|)(?:([^\W\d][\w.-]*):)?([^\W\d][\w.-]*|\*)((?:\[[^\]]*\])*)")
_test = re.compile(r"""\[\s*(?:(\d+)|(last\(\))|(@?)(?:([^\W\d][\w.-]*):)?(text\(\)|[^\W\d][\w.-]*)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'))?)\s*\]""")


def parsed_path(xpath: str) -> list[tuple[bool, str | None, str, list[tuple]]]:
    """The steps of a path as (whether at any depth, prefix, name or ``*``, predicates).

    Child and descendant steps with predicates on the position, an attribute, a child's text or the own one; anything else
    is refused. A path without a slash begins at the children of the root element.
    """
    steps, at = [], 0
    for m in _step.finditer(xpath):
        if m.start() != at or (at and not m[1]):
            raise ValueError(f"unsupported path: {xpath}")
        at, tests, end = m.end(), [], 0
        for t in _test.finditer(m[4]):
            if t.start() != end:
                break
            end = t.end()
            tests.append((int(t[1]) if t[1] else -1 if t[2] else None, t[3] == "@", t[4], t[5], t[6] if t[6] is not None else t[7]))
        if end != len(m[4]):
            raise ValueError(f"unsupported predicate: {xpath}")
        if not steps and not m[1]:
            steps.append((False, None, "*", []))
        steps.append((m[1] == "//", m[2], m[3], tests))
    if at != len(xpath) or not steps:
        raise ValueError(f"unsupported path: {xpath}")
    return steps


def _prefixes(steps: list[tuple]) -> set[str]:
    return {p for _, p, _, _ in steps if p} | {t[2] for *_, tests in steps for t in tests if t[2]}


def _passes(below: dict[int, list[Node]], hits: list[Node], test: tuple, uris: dict[str, str]) -> list[Node]:
    """The hits among the children of one element that a predicate lets through."""
    place, is_attribute, prefix, name, value = test
    if place is not None:
        return hits[-1:] if place < 0 else hits[place - 1 : place] if place else []
    if is_attribute:
        return [n for n in hits if name in n.attrs and (value is None or n.attrs[name] == value)]
    if name == "text()":
        return [n for n in hits if n.text is not None and (value is None or n.text == value)]
    uri = uris[prefix] if prefix else ""
    of = lambda n: (c for c in below.get(n.node_id, ()) if c.tag == name and c.ns_uri == uri)
    return [n for n in hits if any(value is None or (c.text or "") == value for c in of(n))]


def found(nodes: list[Node], steps: list[tuple], uris: dict[str, str]) -> list[Node]:
    """The elements of a path, in document order; names without a prefix are in no namespace."""
    below: dict[int, list[Node]] = {}
    for n in nodes:
        below.setdefault(n.parent_id, []).append(n)
    now: set[int] = {-1}  # the document
    for deep, prefix, name, tests in steps:
        uri = uris[prefix] if prefix else ""
        parents = now
        if deep:
            parents = set(now)
            for n in nodes:  # a parent stands before its children
                if n.parent_id in parents:
                    parents.add(n.node_id)
        out = set()
        for p in parents:
            hits = [n for n in below.get(p, ()) if name == "*" or (n.tag == name and n.ns_uri == uri)]
            for test in tests:
                hits = _passes(below, hits, test, uris)
            out.update(n.node_id for n in hits)
        now = out
    return [nodes[i] for i in sorted(now)]


def declared_namespace(nodes: list[Node], part: str) -> str | None:
    """The first namespace declared in a file that holds ``part``."""
    return next((uri for n in nodes for uri in n.declared if part in uri), None)


def fields(
    files: DataFrame, xpaths: list[str], prefixes: dict[str, tuple[str, str | None]], key: str = "doc_id", content: str = "content"
) -> DataFrame:
    """(``key``, ``xpath_ord``, ``hit_ord``, ``xpath``, ``node_id``, ``original``): non-blank leading texts by path, in order.

    ``prefixes`` gives for every prefix what its namespace holds and which one stands in where a file declares none such;
    paths that cannot be read, or whose prefix a file does not resolve, give nothing. A file is read once for all paths
    and nothing is shuffled; files that are not well-formed give no rows.
    """
    paths = []
    for i, xpath in enumerate(xpaths):
        try:
            paths.append((i, xpath, parsed_path(xpath)))
        except ValueError:
            continue
    kind = dict(files.dtypes)[key]
    i32, s = pa.int32(), pa.string()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k, c in zip(*(x.to_pylist() for x in batch.columns)):
                try:
                    nodes = shred(bytes(c) if not isinstance(c, str) else c.encode())
                except (ValueError, TypeError):
                    continue
                uris = {p: declared_namespace(nodes, part) or default for p, (part, default) in prefixes.items()}
                for i, xpath, steps in paths:
                    if any(uris.get(p) is None for p in _prefixes(steps)):
                        continue
                    texts = [(n.node_id, n.text) for n in found(nodes, steps, uris) if n.text and n.text.strip()]
                    rows += [(k, i, j + 1, xpath, node, text) for j, (node, text) in enumerate(texts)]
            types = (batch.schema.field(0).type, i32, i32, s, i32, s)
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate(types)], names=[key, "xpath_ord", "hit_ord", "xpath", "node_id", "original"])

    return files.select(key, content).mapInArrow(read, f"{key} {kind}, xpath_ord int, hit_ord int, xpath string, node_id int, original string")


def namespaces(nodes: DataFrame, record_fallback: str, key: str = "doc_id") -> DataFrame:
    """(``key``, ``record_ns``, ``oai_ns``): the first namespace a file declares for the record format, else the fallback, and
    for the envelope, else null."""
    holds = lambda part: F.get(F.filter("declared", lambda u: F.contains(u, F.lit(part))), F.lit(0))
    first = lambda part: F.min_by(holds(part), F.when(holds(part).isNotNull(), F.col("node_id")))
    return nodes.groupBy(key).agg(F.coalesce(first("amcr"), F.lit(record_fallback)).alias("record_ns"), first("OAI-PMH").alias("oai_ns"))


LAYOUT = "page_idx int, block_idx int, line_idx int, line_id string, str_idx int, content string"


def layout_of(nodes: list[Node]) -> Iterator[tuple[int, int, int, str, int, str]]:
    """(page, block, line, line id, string, content) of every string, all from 1 in document order within what holds them;
    blocks may be nested in other elements; a line without an id is called by its number. Elements count in the default
    namespace of the root, else in the one it calls ``alto``, else in none."""
    scopes = dict(nodes[0].scopes) if nodes else {}
    own = scopes.get(None) or scopes.get("alto") or ""
    page = block = line = string = 0
    line_id = ""
    for n in nodes:
        if n.ns_uri != own:
            continue
        if n.tag == "Page":
            page, block, line, string = page + 1, 0, 0, 0
        elif n.tag == "TextBlock":
            block, line, string = block + 1, 0, 0
        elif n.tag == "TextLine":
            line, string = line + 1, 0
            line_id = n.attrs.get("ID") or str(line)
        elif n.tag == "String":
            string += 1
            yield page, block, line, line_id, string, n.attrs.get("CONTENT", "")


def layout_strings(files: DataFrame, key: str = "doc_id", content: str = "content") -> DataFrame:
    """(``key``, LAYOUT) of every well-formed layout file, in one pass and without a shuffle."""
    kind = dict(files.dtypes)[key]
    i, s = pa.int32(), pa.string()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, rows = [], []
            for k, c in zip(*(x.to_pylist() for x in batch.columns)):
                try:
                    found = list(layout_of(shred(bytes(c) if not isinstance(c, str) else c.encode())))
                except (ValueError, TypeError):
                    continue
                keys += [k] * len(found)
                rows += found
            if rows:
                columns = [pa.array(keys, batch.schema.field(0).type)] + [pa.array(x, t) for x, t in zip(zip(*rows), (i, i, i, s, i, s))]
                yield pa.RecordBatch.from_arrays(columns, names=[key, *[x.split()[0] for x in LAYOUT.split(", ")]])

    return files.select(key, content).mapInArrow(read, f"{key} {kind}, {LAYOUT}")


def splice(content: bytes, texts: dict[int, str], contents: dict[int, str]) -> bytes:
    """The file with new leading texts (by node id) and new CONTENT values, every other byte as it was."""
    nodes = shred(content)
    cuts: list[tuple[int, int, bytes]] = []
    for i, text in texts.items():
        n = nodes[i]
        if n.text_from >= 0:
            cuts.append((n.text_from, n.text_to, escape(text).encode()))
    for i, text in contents.items():
        n = nodes[i]
        tag = content[n.tag_from : n.tag_to]
        value = escape(text, {'"': "&quot;"}).encode()
        m = re.search(rb"""(\sCONTENT\s*=\s*)("[^"]*"|'[^']*')""", tag)
        if m:
            cuts.append((n.tag_from + m.start(2), n.tag_from + m.end(2), b'"' + value + b'"'))
        else:  # a string without the attribute gets one
            at = n.tag_to - (2 if tag.rstrip().endswith(b"/>") else 1)
            cuts.append((at, at, b' CONTENT="' + value + b'"'))
    for a, b, value in sorted(cuts, reverse=True):
        content = content[:a] + value + content[b:]
    return content


def evaluation_segments(
    files: DataFrame, xpaths: list[str], prefixes: dict[str, tuple[str, str | None]], limit: int = 0
) -> DataFrame:
    """(``file``, ``kind``, ``id``, ``src``): the blocks of layout files and the described fields of others, files in order of
    name, malformed ones left out; ``limit`` keeps the first segments (0: all)."""
    from pyspark.sql import Window as W

    layout = layout_strings(files.where(F.lower("name").endswith(".alto.xml")).select("name", "content"), "name")
    lines = layout.where("content <> ''").groupBy("name", "page_idx", "block_idx", "line_idx").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("str_idx", "content"))), lambda x: x["content"]), " ").alias("line")
    )
    blocks = lines.groupBy("name", "page_idx", "block_idx").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_idx", "line"))), lambda x: x["line"]), " ").alias("src")
    )
    nth = F.row_number().over(W.partitionBy("name").orderBy("page_idx", "block_idx")) - 1
    a = blocks.select(F.col("name").alias("file"), F.lit("alto").alias("kind"), nth.alias("n"), "src")
    hits = fields(files.where(~F.lower("name").endswith(".alto.xml")).select("name", "content"), xpaths, prefixes, "name")
    nth = F.row_number().over(W.partitionBy("name").orderBy("xpath_ord", "hit_ord")) - 1
    b = hits.select(F.col("name").alias("file"), F.lit("metadata").alias("kind"), nth.alias("n"), F.trim("original").alias("src"))
    out = a.unionByName(b).withColumn("id", F.concat(F.when(F.col("kind") == "alto", "block").otherwise("field"), "n"))
    if limit:
        out = out.orderBy("file", "n").limit(limit)
    return out.select("file", "kind", "id", "src")
