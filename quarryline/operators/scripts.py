"""Structure of JavaScript and TypeScript files from their tokens: imports, functions, classes, calls, variables and scopes."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.functions.lexers import Lexed, lex_braces

SCHEMA = "key string, kind string, name string, type string, owner string, target string, line int, parameters array<string>, flags array<string>"
_ARROW = pa.schema([("key", pa.string()), ("kind", pa.string()), ("name", pa.string()), ("type", pa.string()), ("owner", pa.string()), ("target", pa.string()), ("line", pa.int32()), ("parameters", pa.list_(pa.string())), ("flags", pa.list_(pa.string()))])
_MODIFIERS = frozenset("static async get set readonly public private protected abstract declare override accessor".split())
_TYPE_BEFORE = frozenset((":", "|", "&", "<", ",", "=>", "(", "["))


class Script:
    """One pass over the tokens of a file. Functions are named by their declaration, by the variable they are given to, or by
    their class; what stands in a function belongs to the innermost one around it, else to `global`."""

    def __init__(self, text: str, language: str):
        self.text, self.x = text, lex_braces(text, language)
        self.rows: list[tuple] = []
        self.regions: list[tuple[int, int, str]] = []  # first and last token of a function's body, and its name
        self.members: set[int] = set()  # tokens that name a method: no calls
        self.line_starts = [0]
        for at, c in enumerate(text):
            if c == "\n":
                self.line_starts.append(at + 1)

    def line(self, i: int) -> int:
        return bisect_right(self.line_starts, self.x.starts[i])

    def at(self, i: int) -> str:
        return self.x.values[i] if 0 <= i < len(self.x.values) else ""

    def kind(self, i: int) -> str:
        return self.x.kinds[i] if 0 <= i < len(self.x.kinds) else ""

    def add(self, kind: str, name: str, i: int, type_: str | None = None, target: str | None = None, parameters: list[str] | None = None, flags: list[str] | None = None) -> None:
        self.rows.append((kind, name, type_, i, target, self.line(i), parameters, flags))

    def parameters(self, o: int) -> list[str]:
        """Names of the parameters in the brackets at token o; a pattern is `unknown`."""
        end, out, fresh, j = self.x.match.get(o, o), [], True, o + 1
        while j < end:
            if self.kind(j) == ",":
                fresh = True
            elif fresh and self.kind(j) in ("{", "["):
                out.append("unknown")
                fresh = False
            elif fresh and self.kind(j) == "i" and not (self.at(j) in _MODIFIERS and self.kind(j + 1) == "i"):
                out.append(self.at(j))
                fresh = False
            j = self.x.match.get(j, j) + 1 if self.kind(j) in ("(", "[", "{") else j + 1
        return out

    def body(self, close: int) -> tuple[int, int] | None:
        """First and last token of the block that follows the parameters, past a return type; None if there is none."""
        j = close + 1
        if self.kind(j) == ":":
            j += 1
            while j < len(self.x.kinds) and not (self.kind(j) == "{" and self.at(j - 1) not in _TYPE_BEFORE) and self.kind(j) not in (";", "}"):
                j = self.x.match.get(j, j) + 1 if self.kind(j) in ("(", "[", "{") else j + 1
        return (j, self.x.match[j]) if self.kind(j) == "{" and j in self.x.match else None

    def expression_end(self, j: int) -> int:
        """The last token of an expression that begins at token j."""
        first = j
        while j < len(self.x.kinds):
            k = self.kind(j)
            if k in (")", "]", "}", ";", ",") or j > first and self.x.fresh[j] and k in ("i", "k") and self.kind(j - 1) in ("i", "n", "s", "t", ")", "]", "}"):
                return j - 1
            j = self.x.match.get(j, j) + 1 if k in ("(", "[", "{") else j + 1
        return j - 1

    def variable_of(self, i: int) -> str | None:
        """The variable that the expression beginning at token i is given to where it is declared."""
        j = i - 1
        if self.kind(j) != "=":
            return None
        j -= 1
        while j > 0 and not (self.at(j - 1) in ("const", "let", "var") and self.kind(j) == "i"):
            if self.kind(j) in (";", "{", "}") and self.x.match.get(j, j) >= j or self.kind(j) == ",":
                return self.at(j + 1) if self.kind(j) == "," and self.kind(j + 1) == "i" else None
            j = self.x.match[j] - 1 if self.kind(j) in (")", "]", "}") and j in self.x.match else j - 1
        return self.at(j) if j > 0 else None

    def inferred(self, i: int) -> str:
        k, v = self.kind(i), self.at(i)
        if v in ("function", "async") or k == "i" and self.at(i + 1) == "=>" or k == "(" and self.at(self.x.match.get(i, i) + 1) == "=>":
            return "function"
        end = self.expression_end(i)
        alone = end == i or k in ("[", "{") and self.x.match.get(i) == end
        if not alone:
            return "any"
        return {"s": "string", "n": "number", "[": "array", "{": "object", "i": "unknown"}.get(k, "boolean" if v in ("true", "false") else "any")

    def run(self) -> list[tuple]:
        x = self.x
        i = 0
        while i < len(x.kinds):
            k, v = x.kinds[i], x.values[i]
            if k == "k" and v == "import":
                self.imports(i)
            elif k == "k" and v == "function":
                self.function(i)
            elif k == "o" and v == "=>":
                self.arrow(i)
            elif k == "k" and v == "class" and self.kind(i + 1) == "i":
                self.class_(i)
            elif (k == "k" and v in ("const", "var") or k == "i" and v == "let" and self.kind(i + 1) in ("i", "{", "[")) and self.kind(i - 1) != ".":
                self.variables(i)
            elif k == "i" and self.kind(i + 1) == "(" and i not in self.members and self.at(i - 1) not in ("function", "new", "*"):
                self.call(i)
            i += 1
        regions = sorted(self.regions)

        def owner(i: int) -> str:
            inside = [r for r in regions if r[0] <= i <= r[1]]
            return max(inside)[2] if inside else "global"

        return [(kind, name, type_, owner(i), target, line, parameters, flags) for kind, name, type_, i, target, line, parameters, flags in self.rows]

    def imports(self, i: int) -> None:
        j = i + 1
        if self.kind(j) in ("(", "."):
            return
        names, alias, flags = [], "default", []
        while j < len(self.x.kinds) and self.kind(j) not in ("s", ";"):
            v = self.at(j)
            if v == "*":
                alias = "namespace"
            elif v == "{":
                alias = "named"
            elif v == "}":
                alias = "default"
            elif self.kind(j) == "i" and v not in ("from", "as", "type") and self.at(j + 1) != "as":
                names.append((v, alias))
            j += 1
        if self.kind(j) == "s":
            module = self.at(j)[1:-1]
            for name, alias in names or [("", "effect")]:
                self.add("import", name, i, alias, module, flags=flags)

    def function(self, i: int) -> None:
        flags = ["async"] if self.at(i - 1) == "async" else []
        j = i + 1
        if self.at(j) == "*":
            flags.append("generator")
            j += 1
        named = self.kind(j) == "i"
        o = j + named
        while self.kind(o) not in ("(", "{", ";", ""):  # type parameters
            o += 1
        if self.kind(o) != "(" or o not in self.x.match:
            return
        first = i - (self.at(i - 1) == "async")
        before = self.at(first - 1)
        given = self.variable_of(first)
        declared = named and not given and (before in ("", ";", "{", "}", "export", "default", ")") or self.x.fresh[first])
        name = given or (self.at(j) if declared else None)
        span = self.body(self.x.match[o])
        if span:
            self.regions.append((o, span[1], name or (self.at(j) if named else "anonymous")))
            if name:
                self.add("function", name, first, "declaration" if declared else "expression", "any" if "return " in self.text[self.x.starts[span[0]] : self.x.starts[span[1]]] else "void", self.parameters(o), flags)

    def arrow(self, i: int) -> None:
        if self.kind(i - 1) == "i" and self.at(i - 2) not in (":", "|", "&", "."):
            first, parameters = i - 1, [self.at(i - 1)]
        else:
            j = i - 1
            while j > 0 and self.kind(j) != ")":  # a return type
                j = self.x.match[j] - 1 if self.kind(j) in ("]", "}") and j in self.x.match else j - 1
            if j <= 0 or j not in self.x.match:
                return
            first = self.x.match[j]
            parameters = self.parameters(first)
            if self.at(first - 1) == ">":  # type parameters
                while first > 0 and self.at(first) != "<":
                    first -= 1
        flags = []
        if self.at(first - 1) == "async":
            first, flags = first - 1, ["async"]
        name = self.variable_of(first)
        block = self.kind(i + 1) == "{" and i + 1 in self.x.match
        end = self.x.match[i + 1] if block else self.expression_end(i + 1)
        self.regions.append((first, end, name or "anonymous"))
        if name:
            returns = block and "return " in self.text[self.x.starts[i + 1] : self.x.starts[end]]
            self.add("function", name, first, "arrow", "any" if returns else "void", parameters, flags)

    def class_(self, i: int) -> None:
        name, j = self.at(i + 1), i + 2
        above, implements, now = None, [], ""
        while j < len(self.x.kinds) and self.kind(j) != "{":
            v = self.at(j)
            if v in ("extends", "implements"):
                now = v
            elif self.kind(j) == "i" and self.kind(j - 1) != "." and now == "extends" and above is None:
                above = v if self.kind(j + 1) not in (".", "(") else "Expression"
            elif self.kind(j) == "i" and now == "implements" and self.at(j - 1) in ("implements", ","):
                implements.append(v)
            j += 1
        if j not in self.x.match:
            return
        self.add("class", name, i, None, above, implements)
        if above:
            self.add("inheritance", name, i, None, above)
        end, j = self.x.match[j], j + 1
        while j < end:
            flags = []
            while self.at(j) in ("static", "async", "*", "@") or self.kind(j) == "i" and self.at(j) in _MODIFIERS and self.kind(j + 1) in ("i", "s", "[", "k") and not self.x.fresh[j + 1]:
                if self.at(j) == "@":  # a decorator and its arguments
                    j += 2
                    j = self.x.match.get(j, j) + 1 if self.kind(j) == "(" else j
                    continue
                flags.append("generator" if self.at(j) == "*" else self.at(j))
                j += 1
            member, at = self.at(j), j
            if self.kind(j) not in ("i", "k", "s"):
                j = self.x.match.get(j, j) + 1 if self.kind(j) in ("(", "[", "{") else j + 1
                continue
            o = j + 1
            if self.at(o) == "<":
                while o < end and self.kind(o) != "(":
                    o += 1
            if self.kind(o) == "(" and o in self.x.match:
                self.members.add(at)
                span = self.body(self.x.match[o])
                kind = next((f for f in flags if f in ("get", "set")), "constructor" if member == "constructor" else "method")
                if span:
                    self.regions.append((o, span[1], member))
                if member != "constructor":
                    self.add("method", member, at, kind, name, self.parameters(o), [f for f in flags if f in ("static", "async", "generator")])
                j = (span[1] if span else self.x.match[o]) + 1
                while not span and j < end and self.kind(j) != ";" and not self.x.fresh[j]:  # no body: past the type
                    j += 1
                continue
            self.add("property", member, at, "static" if "static" in flags else "instance", name)
            j += 1
            while j < end and self.kind(j) != ";" and not (self.x.fresh[j] and self.kind(j) in ("i", "k", "@", "*") and self.kind(j - 1) not in ("=", ",", "o", ":", "|", "&", ".", "?")):
                j = self.x.match.get(j, j) + 1 if self.kind(j) in ("(", "[", "{") else j + 1

    def variables(self, i: int) -> None:
        j = i + 1
        while self.kind(j) == "i":
            name, at = self.at(j), j
            j += 1
            while j < len(self.x.kinds) and self.kind(j) not in ("=", ",", ";", ")", "}") and not (self.x.fresh[j] and self.kind(j) in ("i", "k")) and self.at(j) not in ("of", "in"):
                j = self.x.match.get(j, j) + 1 if self.kind(j) in ("(", "[", "{") else j + 1
            type_ = None
            if self.kind(j) == "=":
                type_ = self.inferred(j + 1)
                j = self.expression_end(j + 1) + 1
            self.add("variable", name, at, type_)
            if self.kind(j) != ",":
                return
            j += 1

    def call(self, i: int) -> None:
        if self.at(i) == "require" and self.kind(i + 2) == "s":
            self.add("import", "", i, "commonjs", self.at(i + 2)[1:-1])
        name, own = self.at(i), self.at(i)
        if self.at(i - 1) in (".", "?."):
            plain = self.kind(i - 2) == "i" and self.at(i - 3) not in (".", "?.")
            if plain and self.at(i - 3) == "new":
                return
            name = f"{self.at(i - 2)}.{own}" if plain else "member.expression"
        self.add("call", name, i, None, own)


def script_structure(df: DataFrame, key: str, text: str, language: str) -> DataFrame:
    """Rows of SCHEMA for every text whose language (a column) is javascript or typescript.

    kind is import (type: default, namespace, named, commonjs or effect; target: the module), function (declaration,
    expression, arrow; target: any where it returns something, else void), class (target: what it extends, parameters:
    what it implements), method and property (target: their class), inheritance, call (name: `f`, `a.f`, or member.expression for other objects; target: the last name) and
    variable (type inferred from its value). owner is the innermost function around. A text that ends in the middle gives what its
    tokens up to there tell; null and empty texts give no rows. A map over partitions: nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, t, x in zip(*(b.column(i).to_pylist() for i in range(3))):
                if rows := [(k, *r) for r in Script(t, x).run()] if t else []:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)

    wanted = df.where(F.col(language).isin("javascript", "typescript") & F.col(text).isNotNull())
    return wanted.select(F.col(key).cast("string"), text, language).mapInArrow(run, SCHEMA)


def resolved_calls(structure: DataFrame) -> DataFrame:
    """(key, caller, callee, line): calls of functions and methods that the same text declares, by their last name; a call is
    resolved whether it stands before or after the declaration."""
    declared = structure.where("kind in ('function', 'method')").select("key", F.col("name").alias("callee")).distinct()
    calls = structure.where("kind = 'call'").select("key", F.col("owner").alias("caller"), F.col("target").alias("callee"), "line")
    return calls.join(declared, ["key", "callee"], "left_semi").select("key", "caller", "callee", "line")
