"""Functions paired with their documentation (problem 6)."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from quarryline.llm.corpus import current_chunks, map_texts
from quarryline.llm.grammar import analyse
from quarryline.functions.lexers import Lexed

#: Words before a declared name, articles, and openings of remarks that a description is still to be written.
JS_MODIFIERS = frozenset("export default async declare static public private protected readonly override abstract get set accessor".split())
JAVA_MODIFIERS = frozenset("public protected private static final abstract synchronized native default strictfp transient volatile sealed".split())
ARTICLES = frozenset("a an the le la les l un une des der die das den dem ein eine einen el los las lo una unos unas".split())
TO_BE_WRITTEN = re.compile(
    r"\W*(?:todo|fixme|xxx|tbd|tba|wip|hack)\b|\W*(?:to be (?:written|documented|described|done|added)|not (?:yet )?(?:documented|written|described)|no (?:description|documentation)\b|(?:add|write|insert|missing|needs?) (?:a |the |some )?(?:description|documentation|docs?|docstring|comment)\b|(?:description|documentation|docs?) (?:goes here|here|missing|pending|to come|follows|needed)|undocumented\b|document (?:me|this)\b|describe (?:me|this|later)\b|à (?:faire|compléter|documenter)\b|noch zu (?:beschreiben|dokumentieren)|por (?:hacer|documentar|escribir)\b)",
    re.I,
)
SECTION = re.compile(r"\s*(?:args|arguments|parameters|params|returns?|raises|yields?|attributes|keyword arguments|other parameters|throws|exceptions)\s*:?\s*$", re.I)
FIELD = re.compile(r"\s*:(?:param|parameter|arg|argument|key|keyword|type|raises?|except|exception|var|ivar|cvar|vartype|returns?|rtype|yields?)\b[^:]*:")
WORD = re.compile(r"[^\W\d_]+")
NAME_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[^\W\d_]+")


def block_description(comment: str) -> str:
    """What a /** */ block says before its first tag."""
    lines = [re.sub(r"^\s*\*+", "", x).strip() for x in comment[3:-2].split("\n")]
    out = []
    for x in lines:
        if x.startswith("@"):
            m = re.match(r"@(?:description|desc|summary)\b\s*(.*)", x)
            if not m:
                break
            x = m[1]
        out.append(x)
    return re.sub(r"\{@inheritDoc\}", "", "\n".join(out), flags=re.I).strip()


def docstring_description(value: str) -> str:
    """What a docstring says without its fields and parameter sections."""
    out, section, margin = [], False, 0
    for x in value.expandtabs().split("\n"):
        bare = x.strip()
        if FIELD.match(x) or bare.startswith("@param") or bare.startswith("@return"):
            section, margin = True, len(x) - len(x.lstrip())
        elif SECTION.match(x):
            section, margin = True, len(x) - len(x.lstrip())
        elif section and bare and not set(bare) <= set("-="):
            if len(x) - len(x.lstrip()) <= margin:
                section = False
        if not section:
            out.append(bare)
    return "\n".join(out).strip()


def trivial(description: str, name: str) -> bool:
    """Whether a description says nothing: empty, only punctuation, only a remark that it is still to be written, or only the name's words and articles."""
    lines = [x for x in description.split("\n") if x.strip() and not TO_BE_WRITTEN.match(x)]
    words = [w.lower() for x in lines for w in WORD.findall(x)]
    known = {p.lower() for p in NAME_PART.findall(name)} | {name.lower()} | ARTICLES
    return all(w in known for w in words)


def _skip_angle(x: Lexed, i: int) -> int:
    """Index after a type list that begins with < at i."""
    depth = 0
    while i < len(x.kinds):
        v = x.values[i]
        if v == "<":
            depth += 1
        elif v in (">", ">>", ">>>"):
            depth -= len(v)
            if depth <= 0:
                return i + 1
        elif v in "([{":
            i = x.match.get(i, len(x.kinds))
        elif v in (";", ")", "}"):
            return len(x.kinds)
        i += 1
    return i


def _skip_annotations(x: Lexed, i: int) -> int:
    while i + 1 < len(x.kinds) and x.kinds[i] == "@" and x.values[i + 1] != "interface":
        i += 2
        while i + 1 < len(x.kinds) and x.values[i] == ".":
            i += 2
        if i < len(x.kinds) and x.values[i] == "(":
            i = x.match[i] + 1
    return i


def _at(x: Lexed, i: int) -> str:
    return x.values[i] if 0 <= i < len(x.values) else ""


def _body(x: Lexed, i: int) -> int:
    """Index of the { of a body at or after i, over a return type; -1 if the declaration has none."""
    while i < len(x.kinds):
        v = x.values[i]
        if v == "{":
            if _at(x, i - 1) in (":", "|", "&", "<", ",", "=>") and x.values[i - 1] != ")":  # an object type
                i = x.match[i] + 1
                continue
            return i
        if v in (";", "}", ")", "=") or x.kinds[i] == "k" and v not in ("void", "null", "this", "typeof", "true", "false", "throws", "default", "extends", "int", "long", "boolean", "double", "float", "char", "byte", "short", "import", "new", "in"):
            return -1
        i = x.match[i] + 1 if v in ("(", "[") else i + 1
    return -1


def _value_is_function(x: Lexed, i: int) -> int:
    """Index of the last token of the function that is the value beginning at i; -1 if it is none."""
    if _at(x, i) == "async":
        i += 1
    if _at(x, i) == "function":
        i += 1
        while i < len(x.kinds) and x.values[i] != "(":
            if x.values[i] == "<":
                i = _skip_angle(x, i)
                continue
            if x.values[i] in ("{", ";"):
                return -1
            i += 1
        b = _body(x, x.match[i] + 1) if i < len(x.kinds) else -1
        return x.match[b] if b >= 0 else -1
    if _at(x, i) == "<":
        i = _skip_angle(x, i)
    if _at(x, i) == "(":
        i = x.match[i] + 1
        if _at(x, i) == ":":  # a return type
            depth_end = i + 1
            while depth_end < len(x.kinds) and x.values[depth_end] != "=>":
                if x.values[depth_end] in (";", "}", ")"):
                    return -1
                depth_end = x.match[depth_end] + 1 if x.values[depth_end] in ("(", "[", "{") else depth_end + 1
            i = depth_end
    elif i < len(x.kinds) and x.kinds[i] == "i":
        i += 1
    else:
        return -1
    if _at(x, i) != "=>":
        return -1
    i += 1
    if _at(x, i) == "{":
        return x.match[i]
    while i < len(x.kinds) and x.values[i] not in (";", ",", ")", "}", "]"):
        i = x.match[i] + 1 if x.values[i] in ("(", "[", "{") else i + 1
    return max(0, i - 1)


def _js_function(x: Lexed, i: int) -> tuple[int, int] | None:
    """(token of the name, last token) of the function or method declared at token i."""
    i = _skip_annotations(x, i)
    n = len(x.kinds)
    while i < n and x.values[i] in JS_MODIFIERS and _at(x, i + 1) not in ("(", "=", ":", "<", "?", ";", "}"):
        i += 1
        i = _skip_annotations(x, i)
    if i >= n:
        return None
    v = x.values[i]
    if v == "*":
        i += 1
        v = _at(x, i)
    if v == "function":
        i += 1 + (_at(x, i + 1) == "*")
        if i >= n or x.kinds[i] != "i":
            return None
        p = i + 1
        if _at(x, p) == "<":
            p = _skip_angle(x, p)
        if _at(x, p) != "(":
            return None
        b = _body(x, x.match[p] + 1)
        return (i, x.match[b]) if b >= 0 else None
    if v in ("const", "let", "var"):
        i += 1
    elif x.kinds[i] == "k":
        return None
    if i >= n or x.kinds[i] not in ("i", "s", "n"):
        return None
    name, p = i, i + 1
    while _at(x, p) == "." and p + 1 < n:  # exports.name = function
        name, p = p + 1, p + 2
    if _at(x, p) in ("?", "!"):
        p += 1
    q = _skip_angle(x, p) if _at(x, p) == "<" else p
    if _at(x, q) == "(" and name == i and v not in ("const", "let", "var"):
        b = _body(x, x.match[q] + 1)
        return (name, x.match[b]) if b >= 0 else None
    if _at(x, p) == ":":
        end = _value_is_function(x, p + 1)  # a property of an object
        if end >= 0 and v not in ("const", "let", "var"):
            return name, end
        p += 1
        while p < n and x.values[p] != "=":
            if x.values[p] in (";", "}", ")"):
                return None
            p = x.match[p] + 1 if x.values[p] in ("(", "[", "{") else p + 1
    if _at(x, p) == "=":
        end = _value_is_function(x, p + 1)
        return (name, end) if end >= 0 else None
    return None


def _java_function(x: Lexed, i: int) -> tuple[int, int] | None:
    n = len(x.kinds)
    i = _skip_annotations(x, i)
    while i < n and x.values[i] in JAVA_MODIFIERS:
        i = _skip_annotations(x, i + 1)
    if _at(x, i) == "<":
        i = _skip_angle(x, i)
    i = _skip_annotations(x, i)
    while i < n:
        v = x.values[i]
        if v == "(":
            if x.kinds[i - 1] != "i":
                return None
            after = x.match[i] + 1
            b = _body(x, after)
            if b >= 0:
                return i - 1, x.match[b]
            while after < n and x.values[after] not in (";", "}"):
                after += 1
            return (i - 1, after) if _at(x, after) == ";" else None
        if v in ("=", ";", "{", "}", ")") or v in ("class", "interface", "enum", "import", "package", "new", "return") or v == "record" and x.kinds[i + 1 : i + 2] == ["i"]:
            return None
        i = _skip_angle(x, i) if v == "<" else i + 1
    return None


def functions(text: str, language: str, x: Lexed) -> Iterator[tuple[int, str, str, str]]:
    """(line of the name, name, description, code) of each function with a documentation comment of its language."""
    ends = [m.start() for m in re.finditer("\n", text)]
    if language == "python":
        yield from _python(text, x, ends)
        return
    declared = _java_function if language == "java" else _js_function
    before = {i: (s, e) for s, e, i in x.docs}  # of several, the last
    for i, (s, e) in before.items():
        found = declared(x, i) if i < len(x.kinds) else None
        if found:
            name, last = found
            word = x.values[name].strip("'\"").removeprefix("#")
            at = x.starts[name]
            yield bisect_right(ends, at - 1) + 1, word, block_description(text[s:e]), text[x.starts[i] : x.starts[last] + len(x.values[last])]


def _python(text: str, x: Lexed, ends: list[int]) -> Iterator[tuple[int, str, str, str]]:
    n = len(x.kinds)
    open_: list[tuple[int, int, tuple]] = []
    for i in range(n):
        if not x.fresh[i]:
            continue
        column = x.starts[i] - (text.rfind("\n", 0, x.starts[i]) + 1)
        while open_ and column <= open_[-1][0]:
            yield (*open_[-1][2], text[open_[-1][1] : x.starts[i]].rstrip())
            open_.pop()
        d = i + (x.values[i] == "async")
        if _at(x, d) != "def" or d + 2 >= n:
            continue
        p = d + 2
        while p < n and x.values[p] != "(":  # type parameters
            p = x.match[p] + 1 if x.values[p] == "[" else n
        p = x.match.get(p, n) + 1
        while p < n and x.values[p] != ":":
            p = x.match[p] + 1 if x.values[p] in ("(", "[", "{") else p + 1
        value, p = [], p + 1
        first = p
        while p < n and x.kinds[p] == "s" and (p == first or not x.fresh[p]):
            value.append(x.values[p])
            p += 1
        if not value or p < n and not x.fresh[p] and x.values[p] != ";":
            continue
        parts = [re.match(r"([A-Za-z]*)(\"\"\"|'''|\"|')", v) for v in value]
        if any(set(m[1].lower()) & set("bft") for m in parts):
            continue
        doc = "".join(v[m.end() : -len(m[2])] if m[1].lower() == "r" else v[m.end() : -len(m[2])].replace("\\\n", "").replace("\\n", "\n") for v, m in zip(value, parts))
        name = d + 1
        open_.append((column, x.starts[i], (bisect_right(ends, x.starts[name] - 1) + 1, x.values[name], docstring_description(doc))))
    for _, at, what in reversed(open_):
        yield (*what, text[at:].rstrip())


def documented_functions(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """(file_id, relative_path, line_no, function_name, description, code): functions with a telling description in current texts.

    Files that do not parse give no rows; so do functions without documentation or with a trivial one (see trivial). Rows
    of repeated or earlier versions do not count; empty and null texts give no rows; other columns are ignored.
    """
    arrow = pa.schema([("file_id", pa.int64()), ("relative_path", pa.string()), ("line_no", pa.int32()), ("function_name", pa.string()), ("description", pa.string()), ("code", pa.string())])

    def each(file_id, repo_id, path, size, language, text):
        if language != "python" and "/**" not in text or language == "python" and "def" not in text:
            return
        error, lexed = analyse(text, language)
        if error:
            return
        for line, name, description, code in functions(text, language, lexed):
            if not trivial(description, name):
                yield file_id, path, line, name, description, code

    current = current_chunks(files, chunks, ("python", "javascript", "typescript", "java"))
    return map_texts(current, each, "file_id long, relative_path string, line_no int, function_name string, description string, code string", arrow)
