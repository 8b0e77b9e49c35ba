"""What the lexers' token sequences can't be in a valid text, and the verdict on a whole file (problem 2)."""

from __future__ import annotations

import ast
import json
import warnings

from quarryline.functions.lexers import Lexed, json_error, lex_braces, lex_python

#: Names that may stand directly before another name on a line, and those that may stand directly after one.
_JS_BEFORE = frozenset("async get set static of let from as await yield accessor using".split())
_JS_AFTER = frozenset("of from as".split())
_TS_BEFORE = _JS_BEFORE | frozenset("type interface declare namespace module abstract readonly public private protected is keyof infer unique override satisfies asserts implements out global enum".split())
_TS_AFTER = _JS_AFTER | frozenset("is implements satisfies keyof asserts".split())
_JAVA_BEFORE = frozenset("record sealed permits yield when var module requires exports opens uses provides with to transitive open".split())
#: Reserved words that begin a statement or declaration and so can't follow an operand on its line.
_JS_STARTS = frozenset("class const var function if for while do switch try return throw break continue import export debugger case default delete typeof new void null true false this super".split())
_JAVA_STARTS = frozenset("package import if for while do switch try return throw break continue else case new assert const goto".split())
_INFIX = frozenset("= == === != !== && || + - * / % . ?. ?? => < <= >= += -= *= /= %= &= |= ^= <<= >>= >>>= << >> >>> ** ~ ... & | ^ :: ->".split())
_NEVER_FIRST = frozenset("== === != !== && || % ?. ?? => <= >= += *= /= %= &= |= ^= <<= >>= >>>= >> >>> ** = :: ->".split())
_OPENING = frozenset("([{,;")


def grammar_error(x: Lexed, language: str) -> str:
    """The first pair or triple of tokens that the language has nowhere; '' if there is none."""
    java, script = language == "java", language == "javascript"
    before = _JAVA_BEFORE if java else _JS_BEFORE if script else _TS_BEFORE
    after = frozenset() if java else _JS_AFTER if script else _TS_AFTER
    starts = _JAVA_STARTS if java else _JS_STARTS
    kinds, values, fresh, match = x.kinds, x.values, x.fresh, x.match
    n = len(kinds)
    if not n:
        return ""
    first = values[0]
    if java:
        if not (first in ("package", "import", "class", "interface", "enum", "@", "public", "abstract", "final", "strictfp", ";") or kinds[0] == "i" and first in ("record", "sealed", "non", "open", "module")):
            return "no declaration"
    elif first == "<" or first == "{" and n > 2 and kinds[1] == "s" and values[2] == ":":
        return "no program"
    stack: list[str] = []
    a, av, b4 = "", "", ""
    for i in range(n):
        k, v = kinds[i], values[i]
        line = fresh[i]
        if k in "([{":
            if av in ("const", "let", "var", "class") and k == "{" and i + 1 < n and kinds[i + 1] == "{":
                return "template placeholder"
            if java and k == "(" and not stack and i > 1 and values[i - 2] != "record" and a == "i" and values[i - 2] not in ("@", "."):
                return "code outside a class"
            if script and k == "[" and i + 1 < n and kinds[i + 1] == "]" and a in ("i", ")", "]", "s") and not line and not (a == "i" and av in ("of", "await", "yield")):
                return "type in a script"
            stack.append(k)
        elif k in ")]}":
            if stack:
                stack.pop()
            if a == "o" and av in _INFIX or a in _INFIX and not (a == "*" and not script and not java) and not (java and a == "<"):
                return "operator without operand"
        elif k == ";":
            if (a == "o" and av in _INFIX) or (a in _INFIX and not (java and a == "*")) or a == ",":
                return "operator without operand"
        elif k == "%" and a in ("{", "<"):
            return "template placeholder"
        elif k == "@":
            if i + 1 == n or kinds[i + 1] != "i" and values[i + 1] != "interface" and not (not java and kinds[i + 1] == "("):
                return "sign out of place"
        elif v in _NEVER_FIRST and a in _OPENING and a and not (v == "=" and a == ";"):
            return "operator without operand"
        elif k == "i":
            if not line:
                if a == "i":
                    if java:
                        if b4 == "i" and av not in before and values[i - 2] not in before and v not in before and not fresh[i - 1]:
                            return "names without a sign between"
                    elif av not in before and v not in after:
                        return "names without a sign between"
                elif a in ("n", "s", "r") and v not in after and not (java and v in ("when",)):
                    return "operands without a sign between"
            if script and a == "i" and not line and i + 1 < n and (av in ("interface", "enum", "namespace") and values[i + 1] == "{" or av == "type" and values[i + 1] in ("=", "<") or av == "readonly"):
                return "type in a script"
        elif k in "nsr":
            if a in ("n", "s", "r") and not (line and not java) or a == "i" and not line and av != "yield" and (java or av not in ("from", "of", "await", "as", "module", "case")) and k != "r":
                return "operands without a sign between"
        elif k == ":":
            if script:
                if av == "?" and values[i - 1] == "?":
                    return "type in a script"
                if a == "i" and b4 in ("(", "k") and (b4 == "(" or values[i - 2] in ("const", "let", "var")):
                    return "type in a script"
                if a == ")" and i + 2 < n and (values[i + 2] == "{" and kinds[i + 1] == "i" or values[i + 1] == "void" and values[i + 2] in ("{", "=>")):
                    return "type in a script"
        elif k == ">":
            if a == "<" and not java:
                return "empty type list"
            if script and a in ("}", "]"):
                return "type in a script"
        elif k == "<":
            if script and a == "i" and i > 1 and values[i - 2] == "function":
                return "type in a script"
        elif k == "k":
            if java:
                if v in ("const", "goto"):
                    return "unused reserved word"
                if v == "class" and i + 1 < n and kinds[i + 1] != "i":
                    return "class without name"
                if v in ("import", "package") and not _dotted(x, i, v == "import"):
                    return "malformed import"
                if v in starts and v not in ("new", "case", "else", "switch") and (a in ("i", "n", "s", "]") and not _annotation(x, i - 1)):
                    return "statement without end"
                if v in ("return", "throw", "break", "continue", "if", "for", "while", "try") and a == ")" and _call(x, i - 1):
                    return "statement without end"
            else:
                if not line and v in starts and a in ("i", "n", "s", "r", "]") and av not in before and av not in ("default",) and not (a == "i" and b4 in ("@",)):
                    return "statement after an operand"
                if v in ("const", "var") and av not in ("as", "<") and i + 1 < n and kinds[i + 1] not in ("i", "[", "{") and values[i + 1] != "enum":
                    return "declaration without name"
                if v == "import" and i + 1 < n and not stack and not _imports(x, i):
                    return "malformed import"
                if v == "void" and av in ("private", "public", "protected", "static") and a == "i" and i + 1 < n and kinds[i + 1] == "i":
                    return "names without a sign between"
        if java and line and k == "i" and stack and stack[-1] == "{" and (a in ("n", "s", "]") or a == ")" and _call(x, i - 1)) and v not in ("when",):
            return "statement without end"
        b4, a, av = a, k, v
    return ""


#: Words before a condition in brackets, and what may follow them where they are names of members.
_CONDITIONS = frozenset(("if", "while", "switch", "for"))
_OPERAND = frozenset("insrt)]}")
#: Kinds of tokens that decide anything, and names that act as reserved words.
_DECIDING, _CONTEXTUAL = frozenset("k{}()[]:="), frozenset(("let", "implements", "extends"))
_PRIMITIVES = frozenset("boolean byte char short int long float double".split())
_UNFINISHED = frozenset("= , . + - * / % & | ? < ! ~ @".split())
_VALUE_BEFORE = frozenset("= ( [ , ? + - * / % & | ! ~".split())


def structure_error(x: Lexed, language: str) -> str:
    """What the productions of statements rule out, by a stack of what each open bracket is; '' if nothing.

    Productions: conditions and loops with their heads, else / catch / finally with what they belong to, try with what
    must follow it, case in a switch, headers of types, declarations with what they must have, entries of objects, and
    in Java the end of each statement of a block.
    """
    java, script = language == "java", language == "javascript"
    kinds, values, fresh, match = x.kinds, x.values, x.fresh, x.match
    n = len(kinds)
    if not n:
        return ""
    last = kinds[-1]
    if (last not in ("}", ";")) if java else (last in _UNFINISHED or last == "o" and values[-1] in _INFIX):
        return "premature end"
    open_: list[str] = []
    for i, k in enumerate(kinds):
        if k == "i":
            v = values[i]
            if v in _CONTEXTUAL:
                after = kinds[i + 1] if i + 1 < n else ""
                if v == "let" and not java and i and kinds[i - 1] == "," and after == "i":
                    return "declaration after a comma"
                if v != "let" and after in ("{", ";") and i and kinds[i - 1] in ("i", ">"):
                    return "header without name"
            continue
        if k not in _DECIDING:
            continue
        if k == "{":
            open_.append(_brace(x, i, java, open_))
            continue
        if k == "(" or k == "[":
            open_.append(k)
            if k == "(" and i + 1 < n and kinds[i + 1] == ",":
                return "operator without operand"
            continue
        if k == "}" or k == ")" or k == "]":
            top = open_.pop() if open_ else ""
            if java:
                before = kinds[i - 1]
                if k == "}" and top in ("block", "switch") and before not in ("{", "}", ";") and not (top == "switch" and before == ":"):
                    return "statement without end"
                if k == ")" and before == ",":
                    return "operator without operand"
                if top == "array" and i + 1 < n and kinds[i + 1] in ("i", "k", "n", "s", "{", "@"):
                    return "statement without end"
            continue
        if k == "=":
            if i and kinds[i - 1] == ":":
                return "type without name"
            continue
        after = kinds[i + 1] if i + 1 < n else ""
        if k == ":":
            if script and open_ and open_[-1] == "object" and i > 1 and kinds[i - 1] in ("i", "s", "n") and (kinds[i - 2] in _OPERAND and values[i - 2] not in _JS_BEFORE or values[i - 2] in ("true", "false", "null")):
                return "entries without a sign between"
            continue
        v = values[i]
        if not java and after == ":":
            continue
        before = kinds[i - 1] if i else ""
        if v in _CONDITIONS:
            if after != "(" and (java or after in ("", "i", "n", "s", "k", "{", "!", "o", "-", "[") and not (v == "for" and values[i + 1 : i + 2] == ["await"])):
                return "condition without brackets"
            if v == "for" and after == "(" and not _loop(x, i + 1, java):
                return "malformed loop"
        elif v == "else":
            if error := _else_error(x, i, java):
                return error
        elif v == "try":
            at = i + 1
            resources = java and after == "("
            if resources:
                at = match.get(at, n) + 1
            if at < n and kinds[at] == "{":
                end = match.get(at, n) + 1
                if not resources and not (end < n and values[end] in ("catch", "finally")):
                    return "try without catch"
            elif java or after != "(":
                return "try without block"
        elif v in ("catch", "finally"):
            if java:
                o = match.get(i - 1, 0) if before == "}" else 0
                head = values[o - 1] if o else ""
                if head == ")" and (q := match.get(o - 1, 0)):
                    head = values[q - 1]
                if head not in ("try", "catch"):
                    return f"{v} without try"
            elif after == "{" and before != "}":
                return f"{v} without try"
        elif v == "case":
            if (java or after not in ("(", ",", "}", "=", "?", ".", "")) and (not open_ or open_[-1] != "switch"):
                return "case outside a switch"
        elif v in ("extends", "implements", "throws", "enum", "class") and (after in (";", ",") or after == "{" and (v != "class" or java) or not after):
            return "header without name"
        elif v == "new" and after in (";", ")", "]", "}", ",", "="):
            return "operator without operand"
        elif v == "throw" and after in (";", "}"):
            return "operator without operand"
        elif v in ("const", "var") and not java:
            if before == "," and not (v == "const" and not script):
                return "declaration after a comma"
            if script and v == "const" and after == "i" and kinds[i + 2 : i + 3] == [";"]:
                return "constant without value"
        elif v == "function" and after in ("{", ";", "o") and values[i + 1] != "**":
            return "function without parameters"
        elif java and v in _PRIMITIVES and (before in ("n", "s") or before == "i" and i > 1 and kinds[i - 2] in ("=", "+", "-", "*", "/") or before == ")" and _call(x, i - 1)):
            return "statement without end"
    return ""


def _brace(x: Lexed, i: int, java: bool, open_: list[str]) -> str:
    """What the brace at token i opens: switch, enum, array (Java), object (scripts), else block; '' where it can't be told."""
    if not i:
        return "block" if java else ""
    kinds, values, k = x.kinds, x.values, x.kinds[i - 1]
    outer = open_[-1] if open_ else ""
    if k == ")":
        o = x.match.get(i - 1, 0)
        return "switch" if o and values[o - 1] == "switch" and kinds[o - 1] == "k" else "block"
    if not java:
        return "object" if k in _VALUE_BEFORE and not (k == "?" and outer == "block") or values[i - 1] == "return" and kinds[i - 1] == "k" or k == ":" and outer == "object" else ""
    if k in ("=", ",", "(", "]") or k == "{" and outer == "array":
        return "array"
    if k in ("i", ">"):
        j = i - 1
        while j >= 0 and kinds[j] not in (";", "{", "}"):
            if values[j] == "enum" and kinds[j] == "k":
                return "enum"
            j = x.match.get(j, j) - 1 if kinds[j] == ")" else j - 1
    return "block"


def _loop(x: Lexed, o: int, java: bool) -> bool:
    """Whether the brackets at token o hold the head of a loop: two signs between three parts, or a name of what is gone through."""
    end, j, signs, through = x.match.get(o, o), o + 1, 0, False
    while j < end:
        k, v = x.kinds[j], x.values[j]
        if k in "([{":
            j = x.match.get(j, j)
        elif k == ";":
            signs += 1
        elif k == ":" and java or not java and v in ("in", "of"):
            through = True
        j += 1
    return signs == 2 or not signs and through


def _else_error(x: Lexed, i: int, java: bool) -> str:
    """Why no if can belong to the else at token i."""
    kinds, values, match = x.kinds, x.values, x.match
    before = kinds[i - 1] if i else ""
    if before == "}":
        o = match.get(i - 1, 0)
        while o > 1:
            if kinds[o - 1] == ")":
                q = match.get(o - 1, 0)
                if q and values[q - 1] == "if" and kinds[q - 1] == "k":
                    break
                return "else without if" if java and q > 1 and kinds[q - 1] == "i" and values[q - 2] not in ("new", ".") else ""
            if kinds[o - 1] in (";", "{", "}") or java and kinds[o - 1] == "i":
                return "else without if"
            if values[o - 1] != "else" or kinds[o - 2] != "}":
                return ""
            o = match.get(o - 2, 0)  # the block before the other else: the chain must not begin a statement
            q = match.get(o - 1, 0) if o and kinds[o - 1] == ")" else 0
            if not q or values[q - 1] != "if":
                return ""
            if q < 2 or kinds[q - 2] in (";", "{", "}"):
                return "else without if"
            if values[q - 2] != "else" or kinds[q - 3] != "}":
                return ""
            o = match.get(q - 3, 0)
            if not (o and kinds[o - 1] == ")"):
                return ""
            while True:  # up to the first if of the chain
                q = match.get(o - 1, 0)
                if not q or values[q - 1] != "if":
                    return ""
                if q < 2 or kinds[q - 2] in (";", "{", "}"):
                    return "else without if"
                if values[q - 2] != "else" or kinds[q - 3] != "}":
                    return ""
                o = match.get(q - 3, 0)
                if not (o and kinds[o - 1] == ")"):
                    return ""
        return ""
    if before == ";":
        j = i - 2
        while j >= 0 and kinds[j] not in (";", "{"):
            if values[j] in ("if", "else") and kinds[j] == "k":
                return ""
            j = match.get(j, j) - 1 if kinds[j] in (")", "]", "}") else j - 1
        return "else without if"
    return "else without if" if java or before in ("i", "n", "s", "]", ")") and not x.fresh[i] or not before else ""


def _dotted(x: Lexed, i: int, star: bool) -> bool:
    """Whether a Java package or import statement begins at token i."""
    i += 1
    if star and i < len(x.kinds) and x.values[i] == "static":
        i += 1
    while i + 1 < len(x.kinds) and (x.kinds[i] == "i" or star and x.values[i] == "*"):
        if x.values[i + 1] == ";":
            return True
        if x.values[i + 1] != ".":
            return False
        i += 2
    return False


def _imports(x: Lexed, i: int) -> bool:
    """Whether an import of a script or module can begin at token i."""
    k, v = x.kinds[i + 1], x.values[i + 1]
    if k == "i":
        after = x.values[i + 2] if i + 2 < len(x.kinds) else ""
        return after in ("from", ",", "=") or v in ("type", "defer", "source") and (after in ("{", "*") or i + 2 < len(x.kinds) and x.kinds[i + 2] == "i")
    return k in ("s", "{", "*", "(", ".")


def _annotation(x: Lexed, i: int) -> bool:
    while i > 1 and x.kinds[i] == "i" and x.values[i - 1] == ".":
        i -= 2
    return i > 0 and x.kinds[i - 1] == "@"


def _call(x: Lexed, i: int) -> bool:
    """Whether the closing bracket i ends the arguments of a call (not a condition, annotation or cast)."""
    o = x.match.get(i, 0)
    if o < 1:
        return False
    if x.kinds[o - 1] == "i":
        return not _annotation(x, o - 1)
    return False


def analyse(text: str, language: str) -> tuple[str, Lexed | None]:
    """(error, tokens): what makes text invalid in the language ('' if nothing does), and its tokens (none for JSON).

    The lexer with its stack decides first. For Python and JSON an exact check follows it: the interpreter's own parser and
    the strict JSON reader. For the others the neighbour rules and the productions above follow.
    """
    if language == "json":
        error = json_error(text)
        if not error:
            try:
                json.loads(text)
            except RecursionError:
                pass
            except ValueError as e:
                error = str(e)
        return error, None
    if language == "python":
        text = text.removeprefix("\ufeff")
        lexed = lex_python(text)
        error = lexed.error
        if not error:
            try:
                with warnings.catch_warnings():
                    warnings.simplefilter("ignore")
                    compile(text, "", "exec", ast.PyCF_ONLY_AST, dont_inherit=True)
            except (RecursionError, MemoryError):
                pass
            except (SyntaxError, ValueError) as e:
                error = str(e) or "invalid"
        return error, lexed
    lexed = lex_braces(text, language)
    return lexed.error or grammar_error(lexed, language) or structure_error(lexed, language), lexed


def syntax_error(text: str, language: str) -> str:
    """What makes text invalid in the language; '' if nothing does."""
    return analyse(text, language)[0]
