"""Relations inside one source text: calls, references and flow edges of integration languages and XML."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Built-in functions of the transformation language that are no calls of the text's own.
BUILT_IN = frozenset("map filter reduce mapObject find forEach groupBy if fun var type import output input".split())
_JS_DECLARED = re.compile(r"(?:function\s+(\w+)\s*\(|(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s+)?(?:function\b|\([^)]*\)\s*=>|\w+\s*=>)|^\s*(?:static\s+|async\s+)*(\w+)\s*\([^)]*\)\s*\{)", re.M)
_CALL = re.compile(r"(?<![\w.])(\w+)\s*\(")
_NO_CALL = frozenset("if for while switch catch function return typeof super".split())


def _blocks(text: str, heads: Iterator[re.Match]) -> Iterator[tuple[str, str]]:
    """(name, text up to the next declaration) of each declaration."""
    found = [(next(g for g in m.groups() if g), m.start(), m.end()) for m in heads]
    for i, (name, _, at) in enumerate(found):
        yield name, text[at : found[i + 1][1] if i + 1 < len(found) else len(text)]


def script_edges(text: str) -> list[tuple[str, str, str]]:
    """Calls between functions that the text declares, and what its classes extend."""
    heads = [m for m in _JS_DECLARED.finditer(text) if next(g for g in m.groups() if g) not in _NO_CALL]
    names = {next(g for g in m.groups() if g) for m in heads}
    out = [("call", a, c) for a, body in _blocks(text, iter(heads)) for c in _CALL.findall(body) if c in names and c != a]
    return out + [("inheritance", a, b) for a, b in re.findall(r"class\s+(\w+)\s+extends\s+(\w+)", text)]


def esql_edges(text: str) -> list[tuple[str, str, str]]:
    """CALL and SET calls of each function or procedure."""
    heads = re.finditer(r"CREATE\s+(?:FUNCTION|PROCEDURE)\s+(\w+)", text, re.I)
    out = []
    for name, body in _blocks(text, heads):
        out += [("call", name, x) for x in re.findall(r"\bCALL\s+([\w.]+)\s*\(", body)]
        out += [("set", name, x) for x in re.findall(r"\bSET\s+[\w.]+\s*=\s*([\w.]+)\s*\(", body)]
    return out


def dataweave_edges(text: str) -> list[tuple[str, str, str]]:
    """Calls, variable and type references between what the text declares; the part after --- is main."""
    head, _, main = text.partition("\n---")
    declared = {k: re.findall(rf"(?m)^\s*{k}\s+(\w+)", head) for k in ("fun", "var", "type")}
    bodies = [*_blocks(head, re.finditer(r"(?m)^\s*(?:fun|var|type)\s+(\w+)", head)), ("main", main)]
    out = []
    for name, body in bodies:
        out += [("function-call", name, x) for x in _CALL.findall(body) if x in declared["fun"] and x not in BUILT_IN and x != name]
        if name == "main" or name in declared["fun"]:
            out += [("variable-reference", name, x) for v in declared["var"] for x in re.findall(rf"\b{v}\b", body)]
        out += [("type-reference", name, x) for x in re.findall(r":\s*(\w+)", body) if x in declared["type"]]
    return out


def xml_edges(text: str) -> list[tuple[str, str, str]]:
    """Flow references to flows that the text defines, configuration references, transformations, and connections of
    message flows."""
    try:
        root = ET.fromstring(text)
    except ET.ParseError:
        return []
    local = lambda t: t.rsplit("}", 1)[-1] if isinstance(t, str) else ""
    attribute = lambda n, k: next((v for a, v in n.attrib.items() if a.rsplit("}", 1)[-1] == k), None)
    flows = {attribute(n, "name") for n in root.iter() if local(n.tag) in ("flow", "sub-flow")} - {None}
    out, stack = [], [(root, None)]
    while stack:
        n, flow = stack.pop()
        tag, name = local(n.tag), attribute(n, "name")
        inside = name if tag in ("flow", "sub-flow") and name else flow
        if tag == "flow-ref" and inside and name in flows:
            out.append(("flow-reference", inside, name))
        if inside and attribute(n, "config-ref"):
            out.append(("config-reference", inside, attribute(n, "config-ref")))
        if inside and tag in ("transform", "transform-message"):
            out.append(("dataweave", inside, "dataweave-transformation"))
        if tag in ("connections", "connection") and attribute(n, "sourceNode") and attribute(n, "targetNode"):
            out.append(("connection", attribute(n, "sourceNode"), attribute(n, "targetNode")))
        stack += [(c, inside) for c in reversed(n)]
    return out


EDGES = {"javascript": script_edges, "typescript": script_edges, "esql": esql_edges, "dataweave": dataweave_edges, "xml": xml_edges}


def relationships(df: DataFrame, key: str, text: str, language: str) -> DataFrame:
    """(key as string, type, source, target): the edges of each text by the analyzer of its language (a column).

    Other languages, null and malformed texts give no rows; an edge stands once for each place.
    """
    schema = pa.schema([("key", pa.string()), ("type", pa.string()), ("source", pa.string()), ("target", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(k, *e) for k, t, x in zip(*(b.column(i).to_pylist() for i in range(3))) if t and x in EDGES for e in EDGES[x](t)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(zip(*rows), schema.types)], schema=schema)

    wanted = df.where(F.col(language).isin(*EDGES) & F.col(text).isNotNull())
    return wanted.select(F.col(key).cast("string"), text, language).mapInArrow(run, "key string, type string, source string, target string")


def call_graph(edges: DataFrame) -> DataFrame:
    """(key, source, callees): the different callees of each caller, in order."""
    return edges.where("type in ('call', 'set', 'function-call')").groupBy("key", "source").agg(F.array_sort(F.collect_set("target")).alias("callees"))
