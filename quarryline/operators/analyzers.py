"""Structure of code chunks by regular expressions, language by language, as JVM expressions; XML by Python's parser."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Patterns of imports, functions, classes, comments and documentation, with the group that is the name.
_BLOCK, _LINE = r"/\*[\s\S]*?\*/", r"(?m)//.*$"
PATTERNS: dict[str, dict[str, list[tuple[str, str, int]]]] = {
    "javascript": {
        "imports": [
            ("es6", r"import\s+(?:(?:\{[^}]*\}|\*\s+as\s+\w+|\w+)(?:\s*,\s*(?:\{[^}]*\}|\*\s+as\s+\w+|\w+))*\s+from\s+)?['\"`]([^'\"`]+)['\"`]", 1),
            ("commonjs", r"(?:const|let|var)\s+(?:\{[^}]*\}|\w+)\s*=\s*require\(['\"`]([^'\"`]+)['\"`]\)", 1),
        ],
        "functions": [
            ("declaration", r"(?:async\s+)?function\s+(\w+)\s*\(([^)]*)\)\s*\{", 1),
            ("arrow", r"(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s+)?\(([^)]*)\)\s*=>", 1),
        ],
        "classes": [("class", r"class\s+(\w+)(?:\s+extends\s+(\w+))?\s*\{", 1)],
        "comments": [("single", _LINE, 0), ("multi", _BLOCK, 0)],
        "docstrings": [("jsdoc", r"/\*\*[\s\S]*?\*/", 0)],
    },
    "python": {
        "imports": [("import", r"(?m)^\s*import\s+([^\s#]+)(?:\s+as\s+(\w+))?", 1), ("from", r"(?m)^\s*from\s+([^\s#]+)\s+import\s+([^#\n]+)", 1)],
        "functions": [("function", r"(?:@\w+(?:\([^)]*\))?\s*\n\s*)*def\s+(\w+)\s*\(([^)]*)\)(?:\s*->\s*([^:]+))?:", 1)],
        "classes": [("class", r"class\s+(\w+)(?:\(([^)]*)\))?:", 1)],
        "comments": [("single", r"(?m)#.*$", 0)],
        "docstrings": [("docstring", r"\"\"\"[\s\S]*?\"\"\"|'''[\s\S]*?'''", 0)],
    },
    "java": {
        "imports": [("import", r"import\s+(?:static\s+)?([^;]+);", 1)],
        "functions": [("method", r"(?:public|private|protected)?\s*(?:static\s+)?(?:final\s+)?(\w+)\s+(\w+)\s*\(([^)]*)\)\s*(?:throws\s+[^{]+)?\s*\{", 2)],
        "classes": [("class", r"(?:public\s+)?(?:abstract\s+)?class\s+(\w+)(?:\s+extends\s+(\w+))?(?:\s+implements\s+([^{]+))?\s*\{", 1)],
        "comments": [("single", _LINE, 0), ("multi", _BLOCK, 0)],
        "docstrings": [("javadoc", r"/\*\*[\s\S]*?\*/", 0)],
    },
    "cpp": {
        "imports": [("include", r"#include\s*[<\"]([^>\"]+)[>\"]", 1)],
        "functions": [("function", r"(\w+)\s+(\w+)\s*\(([^)]*)\)\s*\{", 2)],
        "classes": [("class", r"class\s+(\w+)(?:\s*:\s*(?:public|private|protected)\s+(\w+))?\s*\{", 1)],
        "comments": [("single", _LINE, 0), ("multi", _BLOCK, 0)],
        "docstrings": [("doxygen", r"(?m)/\*\*[\s\S]*?\*/|///.*$", 0)],
    },
    "dart": {
        "imports": [("import", r"import\s+['\"]([^'\"]+)['\"](?:\s+as\s+(\w+))?;", 1)],
        "functions": [("method", r"([\w<>]+)\s+(\w+)\s*\(([^)]*)\)\s*(?:async\s*)?\{", 2), ("factory", r"factory\s+(\w+)\.(\w+)\s*\(([^)]*)\)\s*\{", 2)],
        "classes": [("class", r"class\s+(\w+)(?:\s*extends\s+(\w+))?\s*\{", 1)],
        "comments": [("single", _LINE, 0), ("multi", _BLOCK, 0)],
        "docstrings": [("dartdoc", r"/\*\*[\s\S]*?\*/", 0)],
    },
    "yaml": {"comments": [("single", r"(?m)#.*$", 0)]},
    "esql": {
        "imports": [("schema", r"(?i)BROKER\s+SCHEMA\s+([\w.]+)", 1), ("path", r"(?i)PATH\s+([\w.]+)", 1)],
        "functions": [("function", r"(?i)CREATE\s+FUNCTION\s+(\w+)", 1), ("procedure", r"(?i)CREATE\s+PROCEDURE\s+(\w+)", 1)],
        "classes": [("module", r"(?i)CREATE\s+(?:COMPUTE\s+|FILTER\s+|DATABASE\s+)?MODULE\s+(\w+)", 1)],
        "comments": [("dash", r"(?m)--.*$", 0), ("multi", _BLOCK, 0)],
    },
    "dataweave": {
        "imports": [("import", r"(?m)^\s*import\s+([^\n]+)", 1)],
        "functions": [("fun", r"(?m)^\s*fun\s+(\w+)\s*\(", 1)],
        "classes": [("type", r"(?m)^\s*type\s+(\w+)\s*=", 1)],
        "comments": [("single", _LINE, 0), ("multi", _BLOCK, 0)],
    },
    "": {"comments": [("c-style", _LINE, 0), ("c-style", _BLOCK, 0), ("hash", r"(?m)#.*$", 0), ("dash", r"(?m)--.*$", 0)]},
}
PATTERNS["typescript"] = PATTERNS["javascript"]
#: Words the C-like function pattern also matches.
NOT_FUNCTIONS = ("if", "for", "while", "switch", "catch", "return")
KINDS = ("imports", "functions", "classes", "comments", "docstrings")


def symbols(text: Column, language: str, kind: str, patterns: dict | None = None) -> Column:
    """array<struct(type, name)> of one kind, pattern after pattern, in the order of the text. `patterns` in the place of
    PATTERNS bring further languages."""
    empty = F.array().cast("array<struct<type:string,name:string>>")

    def named(kind_: str, pattern: str, group: int) -> Column:
        return F.transform(F.regexp_extract_all(text, F.lit(pattern), group), lambda x: F.struct(F.lit(kind_).alias("type"), F.trim(x).alias("name")))

    table = patterns or PATTERNS
    found = [named(*p) for p in table.get(language, table[""]).get(kind, [])]
    out = F.concat(*found) if found else empty
    if kind == "functions" and language in ("cpp", "java", "dart"):
        out = F.filter(out, lambda x: ~x["name"].isin(*NOT_FUNCTIONS))
    return F.coalesce(out, empty)


def structure(df: DataFrame, text: str, language: str) -> DataFrame:
    """Adds the five kinds of symbols for texts of one language, and kind: what the text mainly is.

    A function before a class before an import before a comment, else code; unknown languages are always code.
    """
    out = df.withColumns({k: symbols(F.col(text), language, k) for k in KINDS})
    if language not in PATTERNS:
        return out.withColumn("kind", F.lit("code"))
    some = lambda k: F.size(k) > 0
    order = ["classes", "functions", "imports", "comments"] if language == "dart" else ["functions", "classes", "imports", "comments"]
    if language in ("javascript", "typescript"):
        order = ["functions", "classes", "imports", "comments"]
    names = {"functions": "function", "classes": "class", "imports": "import", "comments": "comment"}
    kind = F.lit("code")
    for k in reversed(order):
        if not (language in ("yaml", "dataweave") and k in ("imports", "comments")):
            kind = F.when(some(k), names[k]).otherwise(kind)
    return out.withColumn("kind", kind)


def split_parameters(text: Column) -> Column:
    """Parameters split at commas that stand in no bracket and no quotes (a fold over the characters)."""
    zero = F.struct(F.lit(0).alias("depth"), F.lit("").alias("quote"), F.lit("").alias("now"), F.array().cast("array<string>").alias("out"))

    def step(a, c):
        quoted = a["quote"] != ""
        quote = F.when(quoted, F.when(c == a["quote"], "").otherwise(a["quote"])).when(c.isin("'", '"'), c).otherwise("")
        depth = a["depth"] + F.when(quoted, 0).when(c.isin("(", "[", "{", "<"), 1).when(c.isin(")", "]", "}", ">"), -1).otherwise(0)
        cut = ~quoted & (a["depth"] == 0) & (c == ",")
        return F.struct(depth.alias("depth"), quote.alias("quote"), F.when(cut, "").otherwise(F.concat(a["now"], c)).alias("now"), F.when(cut, F.concat(a["out"], F.array(a["now"]))).otherwise(a["out"]).alias("out"))

    parts = F.aggregate(F.split(text, ""), zero, step, lambda a: F.concat(a["out"], F.array(a["now"])))
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: F.length(x) > 0)


def call_edges(df: DataFrame, key: str, text: str, language: str) -> DataFrame:
    """(key, callee): names declared in a text that the same text also calls elsewhere (resolved within the text)."""
    declared = F.transform(symbols(F.col(text), language, "functions"), lambda x: x["name"])
    called = F.regexp_extract_all(F.col(text), F.lit(r"(?<![A-Za-z0-9_.])(\w+)\s*\("), 1)
    times = lambda n: F.size(F.filter(called, lambda c: c == n))
    return df.select(key, F.explode(F.array_distinct(F.filter(declared, lambda n: times(n) > 1))).alias("callee"))


XML_NODES = T.ArrayType(T.StructType([T.StructField("path", T.StringType()), T.StructField("tag", T.StringType()), T.StructField("attributes", T.MapType(T.StringType(), T.StringType())), T.StructField("text", T.StringType())]))


def _nodes(text: str | None) -> list[tuple]:
    try:
        root = ET.fromstring(text or "")
    except ET.ParseError:
        return []
    out, stack = [], [(root, "")]
    while stack:
        node, above = stack.pop()
        tag = node.tag.rsplit("}", 1)[-1] if isinstance(node.tag, str) else ""
        path = f"{above}/{tag}"
        out.append((path, tag, {f"@_{k.rsplit('}', 1)[-1]}": v for k, v in node.attrib.items()}, (node.text or "").strip()))
        stack += [(child, path) for child in reversed(node)]
    return out


def xml_nodes(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, path, tag, attributes, text) of every element, in document order; texts that are no XML give no rows."""

    def run(batches: Iterator) -> Iterator:
        for pdf in batches:
            pdf["nodes"] = pdf["text"].map(_nodes)
            yield pdf[["key", "nodes"]]

    rows = df.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text")).mapInPandas(run, T.StructType([T.StructField("key", T.StringType()), T.StructField("nodes", XML_NODES)]))
    return rows.select("key", F.explode("nodes").alias("n")).select("key", "n.*")


def flow_references(nodes: DataFrame) -> DataFrame:
    """(key, target): references to a flow that the same document defines."""
    named = F.col("attributes").getItem("@_name")
    flows = nodes.where("tag in ('flow', 'sub-flow')").select(F.col("key").alias("_k"), named.alias("_n"))
    refs = nodes.where("tag = 'flow-ref'").select("key", named.alias("target"))
    return refs.join(flows, (F.col("key") == F.col("_k")) & (F.col("target") == F.col("_n")), "left_semi")
