"""Lexers with a pushdown stack for Python, JavaScript, TypeScript, Java and JSON.

`lex_braces` and `lex_python` return a Lexed: the tokens, the doc comments, and the first error found. The lexers decide what
a complete, balanced text is; `grammar_error` adds which neighbours a language's tokens can't have.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

#: The language of a path's ending.
LANGUAGES = {".py": "python", ".js": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".ts": "typescript", ".java": "java", ".json": "json"}
CLOSES = {")": "(", "]": "[", "}": "{"}
_PY_KINDS = {"name": "i", "string": "s", "number": "n"}
_BLANK = frozenset(" \t\r\f\v\u00a0\ufeff")


@dataclass
class Lexed:
    """kinds has one character a token: i name, k reserved word, n number, s string, t template, r regular expression, a bracket
    or sign itself, o other operator; values and starts go with it. lines: a token starts a line. match: the index of the partner of each bracket.
    docs: (start, end, index of the next token) of documentation comments. error: what is wrong, or ''."""

    kinds: list = field(default_factory=list)
    values: list = field(default_factory=list)
    starts: list = field(default_factory=list)
    fresh: list = field(default_factory=list)
    match: dict = field(default_factory=dict)
    docs: list = field(default_factory=list)
    error: str = ""


#: White space before a token is part of its match, so that it costs no match of its own.
_COMMON = r"""
[ \t\r\f\v ﻿]*(?:(?P<nl>\n\s*)|(?P<done>\Z)
|(?P<conflict>(?<![^\n])(?:<{7}|>{7}|\|{7}|={7})(?=[ \r\n]|\Z))
|(?P<line>//[^\n]*)|(?P<block>/\*[^*]*\*+(?:[^/*][^*]*\*+)*/)
"""
_JS = re.compile(
    _COMMON
    + r"""
|(?P<name>(?:[^\W\d]|\$)[\w$]*)
|(?P<string>"(?:[^"\\\n]|\\(?:\r\n|[\s\S]))*"|'(?:[^'\\\n]|\\(?:\r\n|[\s\S]))*')
|(?P<number>(?:0[xX][\da-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_]*(?:\.[\d_]*)?|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?)n?(?![\w$]))
|(?P<open>[(\[{])|(?P<close>[)\]}])
|(?P<op>>>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|>>>|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|\*\*|[-+*/%&|^!~<>=?:;,.])
|(?P<tick>`)|(?P<private>\#(?:[^\W\d]|\$)[\w$]*)|(?P<at>@))
""",
    re.X,
).match
_JAVA = re.compile(
    _COMMON
    + r"""
|(?P<name>(?:[^\W\d]|\$)[\w$]*)
|(?P<string>\"\"\"[ \t]*\r?\n(?:[^"\\]|\\[\s\S]|"(?!""))*\"\"\"|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\(?:u+[\da-fA-F]{4}|[0-7]{1,3}|.))')
|(?P<number>(?:0[xX][\da-fA-F_.]+(?:[pP][+-]?\d+)?|0[bB][01_]+|(?:\d[\d_]*(?:\.[\d_]*)?|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?)[lLfFdD]?(?![\w$]))
|(?P<open>[(\[{])|(?P<close>[)\]}])
|(?P<op>\.\.\.|->|::|==|!=|<=|&&|\|\||\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<=|[-+*/%&|^!~<>=?:;,.])
|(?P<at>@))
""",
    re.X,
).match
_REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*\])+/[a-zA-Z]*").match
_TICK = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*").match

#: Reserved words of the languages.
JS_WORDS = frozenset(
    "break case catch class const continue debugger default delete do else export extends finally for function if import in instanceof new return super switch this throw try typeof var void while with null true false enum".split()
)
JAVA_WORDS = frozenset(
    "abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import instanceof int interface long native new package private protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while true false null".split()
)
#: Words after which an expression begins, so that a slash begins a regular expression.
_BEFORE_OPERAND = frozenset("return typeof case in of delete void throw new else do instanceof yield await default extends".split())


def lex_braces(text: str, language: str) -> Lexed:
    """Tokens of JavaScript, TypeScript or Java."""
    java = language == "java"
    match, words = (_JAVA, JAVA_WORDS) if java else (_JS, JS_WORDS)
    out = Lexed()
    kinds, values, starts, fresh = out.kinds, out.values, out.starts, out.fresh
    stack: list[tuple[str, int]] = []  # bracket and its token; '`' for a template that an expression interrupts
    pos, n, new_line = 0, len(text), True
    if text.startswith("#!") and not java:
        pos = text.find("\n") if "\n" in text else n

    def add(kind: str, value: str, at: int) -> None:
        kinds.append(kind)
        values.append(value)
        starts.append(at)
        fresh.append(new_line)

    while pos < n:
        m = match(text, pos)
        if m is None:
            while text[pos] in _BLANK:
                pos += 1
            c = text[pos]
            if text.startswith("/*", pos):
                out.error = "unterminated comment"
            elif c in "\"'":
                out.error = "unterminated string"
            elif c.isdigit():
                out.error = "malformed number"
            else:
                out.error = "unexpected character"
            return out
        group = m.lastgroup
        end = m.end()
        v = m[group]
        at = end - len(v)
        if group == "name":
            add("k" if v in words and not (kinds and values[-1] in (".", "?.")) else "i", v, at)
        elif group == "op":
            if v in ("/", "/=") and not java:
                last = kinds[-1] if kinds else ""
                if last not in ("i", "n", "s", "t", "r", ")", "]", "k") or (last in "ik" and values[-1] in _BEFORE_OPERAND and (len(values) < 2 or values[-2] != ".")):
                    r = _REGEX(text, at)
                    if r is None:
                        if last != "}":
                            out.error = "unterminated regular expression"
                            return out
                    else:
                        add("r", r[0], at)
                        new_line, pos = False, r.end()
                        continue
            add(v if len(v) == 1 else "o", v, at)
        elif group == "nl":
            new_line, pos = True, end
            continue
        elif group == "open":
            stack.append((v, len(kinds)))
            add(v, v, at)
        elif group == "close":
            if not stack or stack[-1][0] != CLOSES[v]:
                if v == "}" and stack and stack[-1][0] == "`":  # the template goes on
                    stack.pop()
                    end = _template(text, end, stack, len(kinds), out)
                    if out.error:
                        return out
                    add("t", "}", at)
                    new_line, pos = False, end
                    continue
                out.error = "unbalanced bracket"
                return out
            partner = stack.pop()[1]
            out.match[partner] = len(kinds)
            out.match[len(kinds)] = partner
            add(v, v, at)
        elif group == "string":
            add("s", v, at)
        elif group == "number":
            add("n", v, at)
        elif group == "tick":
            end = _template(text, end, stack, len(kinds), out)
            if out.error:
                return out
            add("t", "`", at)
        elif group in ("line", "block"):
            if group == "block":
                if v.startswith("/**") and len(v) > 4:
                    out.docs.append((at, end, len(kinds)))
                if "\n" in v:
                    new_line = True
            pos = end
            continue
        elif group == "conflict":
            out.error = "merge conflict marker"
            return out
        elif group == "private":
            add("i", v, at)
        elif group == "done":
            break
        else:
            add("@", "@", at)
        new_line, pos = False, end
    if stack:
        out.error = "unterminated template" if stack[-1][0] == "`" else "unbalanced bracket at the end"
    return out


def _template(text: str, pos: int, stack: list, token: int, out: Lexed) -> int:
    """Position after a template's part that begins at pos: its end, or the opening of an expression, which is pushed."""
    end = _TICK(text, pos).end()
    if end >= len(text):
        out.error = "unterminated template"
    elif text[end] == "`":
        return end + 1
    else:
        stack.append(("`", token))
        return end + 2
    return end


_PY = re.compile(
    r"""
(?:[ \t\r\f]+|\\\r?\n)*(?:(?P<nl>\n\s*)|(?P<done>\Z)
|(?P<conflict>(?<![^\n])(?:<{7}|>{7}|\|{7}|={7})(?=[ \r\n]|\Z))
|(?P<comment>\#[^\n]*)
|(?P<string>(?:[rR][bBfFtT]?|[bBfFtT][rR]?|[uU])?(?:\"\"\"(?:[^"\\]|\\[\s\S]|"(?!""))*\"\"\"|'''(?:[^'\\]|\\[\s\S]|'(?!''))*'''|"(?!"")(?:[^"\\\n]|\\(?:\r\n|[\s\S]))*"|'(?!'')(?:[^'\\\n]|\\(?:\r\n|[\s\S]))*'))
|(?P<name>[^\W\d]\w*)
|(?P<number>(?:0[xX][\da-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_]*(?:\.[\d_]*)?|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?)[jJ]?(?!\w))
|(?P<open>[(\[{])|(?P<close>[)\]}])
|(?P<op>\*\*=|//=|>>=|<<=|\.\.\.|:=|->|==|!=|<=|>=|\*\*|//|<<|>>|\+=|-=|\*=|/=|%=|&=|\|=|\^=|@=|[-+*/%&|^~<>=.,:;@!]))
""",
    re.X,
).match


def lex_python(text: str) -> Lexed:
    """Tokens of Python, with the indentation as a stack; a token that begins a logical line has fresh set."""
    out = Lexed()
    kinds, values, starts, fresh = out.kinds, out.values, out.starts, out.fresh
    stack: list[tuple[str, int]] = []
    indents, pos, n, new_line = [0], 0, len(text), True
    while pos < n:
        m = _PY(text, pos)
        if m is None:
            while text[pos] in _BLANK:
                pos += 1
            c = text[pos]
            out.error = "unterminated string" if c in "\"'" else "malformed number" if c.isdigit() else "unexpected character"
            return out
        group, end = m.lastgroup, m.end()
        if group == "nl":
            if not stack:
                new_line = True
        elif group == "comment":
            pass
        elif group == "conflict":
            out.error = "merge conflict marker"
            return out
        elif group == "done":
            break
        else:
            v = m[group]
            start = end - len(v)
            if new_line:
                at = text.rfind("\n", 0, start) + 1
                width = len(text[at:start].expandtabs(8))
                if width > indents[-1]:
                    if kinds and values[-1] != ":" or not kinds:
                        out.error = "unexpected indent"
                        return out
                    indents.append(width)
                else:
                    while width < indents[-1]:
                        indents.pop()
                    if width != indents[-1]:
                        out.error = "indentation that matches no block"
                        return out
            if group == "open":
                stack.append((v, len(kinds)))
            elif group == "close":
                if not stack or stack[-1][0] != CLOSES[v]:
                    out.error = "unbalanced bracket"
                    return out
                at = stack.pop()[1]
                out.match[at] = len(kinds)
                out.match[len(kinds)] = at
            kinds.append(_PY_KINDS.get(group) or (v if len(v) == 1 else "o"))
            values.append(v)
            starts.append(start)
            fresh.append(new_line)
            new_line = False
        pos = end
    if stack:
        out.error = "unbalanced bracket at the end"
    return out


_JSON = re.compile(r'[ \t\r\n]*(?:("(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[\da-fA-F]{4}))*")|(-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?(?![\w.])|true(?!\w)|false(?!\w)|null(?!\w))|([\[\]{}:,])|(\Z))').match


def json_error(text: str) -> str:
    """What keeps text from being one strict JSON value: a pushdown automaton over its tokens."""
    stack: list[str] = []
    state, pos = "value", 0  # value, first (value or ]), key, first key (key or }), colon, after
    while True:
        m = _JSON(text, pos)
        if m is None:
            return "merge conflict marker" if re.match(r"\s*(<{7}|>{7}|={7}|\|{7})", text[pos : pos + 4096]) else "unexpected character or unterminated string"
        pos = m.end()
        s, v, p = m[1], m[2], m[3]
        if s or v:
            if s and state in ("key", "first key"):
                state = "colon"
            elif state in ("value", "first"):
                state = "after"
            else:
                return "value out of place"
        elif p:
            if p in "[{" and state in ("value", "first"):
                stack.append(p)
                state = "first" if p == "[" else "first key"
            elif p == ":" and state == "colon":
                state = "value"
            elif p == "," and state == "after" and stack:
                state = "value" if stack[-1] == "[" else "key"
            elif p in "]}" and stack and stack[-1] == CLOSES[p] and state in ("after", "first" if p == "]" else "first key"):
                stack.pop()
                state = "after"
            else:
                return "sign out of place"
        elif stack or state != "after":
            return "premature end"
        else:
            return ""
