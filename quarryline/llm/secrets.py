"""Credentials embedded in source code, found and masked (problem 4).

Lines that may hold a secret are cut into lexical tokens; a linear-chain conditional random field labels each token as part
of a secret or not from its shape and context; the spans of the best label sequence say which characters are masked.
"""

from __future__ import annotations

import functools
import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.sources.tables import bounded_sample

#: Parts of names that hold secrets, and parts that say a name holds something else.
SECRET_NAME = re.compile(
    r"pass(?:wd|word|phrase|code)?(?![a-z])|passw|pwd|(?:^|[_.\-])pw(?![a-z])|[a-z]Pw(?![a-z])|secret|token|api[_\-]?key|access[_\-]?key|private[_\-]?key|secret[_\-]?key|signing|encryption[_\-]?key|auth|bearer|credential|\bcreds?(?![a-z])|kennwort|passwort|geheim|schl(?:ü|ue)ssel|mot[_\-]?de[_\-]?passe|mdp\b|jeton|clave|contrase(?:ñ|n)a|senha|parola|jwt|(?:^|[_.\-])pat\b|[a-z]Pat\b|key[_\-]?id|_key(?![a-z])|[a-z]Key(?![a-z])|\bpin\b",
    re.I,
)
OTHER_NAME = re.compile(
    r"hint|label|(?:secret|token|key|pass(?:word)?)[_\-]?(?:name|path|file|url|type|count|length|size|limit|policy|field|column|prefix|version|alias|manager|store|expiry|ttl|rotation)|max[_\-]?tokens?|num[_\-]?tokens?|tokens$|tokeni|tokens\d|public|etag|commit|sha\d*\b|sha\d|hash|checksum|digest|integrity|fingerprint|uuid|guid|request[_\-]?id|trace|nonce|cache[_\-]?key|primary[_\-]?key|foreign[_\-]?key|sort[_\-]?key|partition[_\-]?key|keyboard|keyword|author|icon|image|revision|build[_\-]?id|session[_\-]?id\b|user[_\-]?id|csrf[_\-]?header|auth(?:ors?|ority)\b",
    re.I,
)
#: Forms of secrets that providers publish.
FORMAT = re.compile(
    r"(?:gh[pousr]_[A-Za-z0-9]{30,}|github_pat_\w{40,}|glpat-[\w\-]{16,}|xox[abeoprs]-[\w\-]{12,}|xapp-[\w\-]{20,}|[srp]k_(?:live|test|prod)_[A-Za-z0-9]{12,}|whsec_\w{16,}|SG\.[\w\-]{16,}\.[\w\-]{16,}|(?:AKIA|ASIA|ABIA|ACCA)[A-Z0-9]{16}(?![A-Za-z0-9])|AIza[\w\-]{35}|ya29\.[\w\-]{20,}|npm_[A-Za-z0-9]{30,}|pypi-[\w\-]{30,}|hf_[A-Za-z0-9]{20,}|dop_v1_[a-f0-9]{40,}|shp(?:at|ss|ca)_[a-fA-F0-9]{20,}|sk-(?:ant-|proj-)?[\w\-]{20,}|AC[0-9a-f]{32}|key-[0-9a-f]{32}|eyJ[\w\-]{8,}\.[\w\-]{8,}\.[\w\-]{8,})"
)
PLACEHOLDER = re.compile(
    r"example|change[_\-]?(?:me|it|this)|your[_\-]|[_\-]here\b|dummy|not[_\-]a[_\-]?real|replace|^todo|^fixme|placeholder|^x{4,}$|x{6,}|\*{3,}|\.{3}|^<.*>$|^\[.*\]$|redacted|masked|^sample|^fake|^mock|^test(?:ing)?$|^secret$|^password$|^passwd$|^none$|^null$|^nil$|^undefined$|^true$|^false$|^foo|^bar$|0123456789|^1234|^abc(?:def)?\d*$|insert[_\-]|^n/?a$|^empty$|^-+$|^_+$|^(.)\1+$",
    re.I,
)
REFERENCE = re.compile(r"^\$|\$\{|\{\{|^%\(?\w|^%\w+%$|^@\w+@?$|^#\{|^ENC\[|^vault:|^secret[s]?[:/]|^ref\+|^arn:|^file:|^env[:.]|^op://|^ssm:|process\.env|os\.environ|getenv|<%|^!\w+ |^projects/")
#: A login told in words: a name and a value with a slash or colon between, after a word for it.
SPOKEN = r"((?i:log-?in|sign-?in|credentials?|creds|account|user(?:name)?|zugang|anmeldung|identifiants?|acceso|usuario)(?:\s+(?:was|is|are|were|war|ist|lautet|était|est|era|es|data|details))?\s*:?)\s+([A-Za-z][\w.@\-]+)\s*[/:]\s+([^\s\"'`/][^\s\"'`]{5,})"
#: Literals (in lower case) of which each line with a token that _usable or weak_labels accepts has one, with what must stand
#: there in the text, if more is needed. They cover SECRET_NAME, FORMAT, the words before a value, USER_FLAGS and _SPOKEN; a
#: check may look at the character after, for no token ends before a letter, digit or underscore, but not at the one before.
SIGNALS = {
    "private key": None, "secret": None, "passw": None, "passphrase": None, "passcode": None, "passe": None, "pwd": None, "token": None, "kennwort": None, "geheim": None, "schlüssel": None, "schluessel": None,
    "jeton": None, "clave": None, "contrase": None, "senha": None, "parola": None, "jwt": None, "mdp": None, "signing": None, "log-in": None, "sign-in": None, "zugang": None, "anmeldung": None, "identifiant": None, "bearer": None, "credential": None, "key": None,
    "pass": r"(?i:pass)(?![a-z])|PASS", "pw": r"(?i:pw)(?![A-Za-z])", "pat": r"(?i:pat)(?![A-Za-z])", "pin": r"(?i:pin)(?![A-Za-z])", "cred": r"(?i:creds?)(?![A-Za-z])", "auth": r"(?i:auth(?!ors?\b|ored|oring))",
    "login": rf"(?i:login)\s|{SPOKEN}", "signin": SPOKEN, "account": rf"(?i:account) +(?:was|is|are)|{SPOKEN}", "user": SPOKEN, "usuario": SPOKEN, "acceso": SPOKEN,
    "basic": r"(?i:basic)\s+\S", "://": r"://[^\s/\"'`:@]*:", "-u": r"(?<![\w\-])-u(?:[ =]?[^\s:]+:|(?![\w\-])[^\n]*?[^\s:\"'`/]:[^\s\"'`])", "--user": r"--user(?![\w\-])[^\n]*?[^\s\"'`/]:", "--proxy-user": r"--proxy-user(?![\w\-])[^\n]*?[^\s\"'`/]:",
    "gho_": None, "ghp_": None, "ghu_": None, "ghs_": None, "ghr_": None, "github_pat_": None, "glpat-": None, "whsec_": None, "xapp-": None, "aiza": None, "ya29.": None, "pypi-": None, "dop_v1_": None, "xox": r"xox[abeoprs]-", "k_live_": None, "k_test_": None, "k_prod_": None, "sg.": r"SG\.[\w\-]{8}",
    "akia": r"AKIA[A-Z0-9]", "asia": r"ASIA[A-Z0-9]{8}", "abia": r"ABIA[A-Z0-9]{8}", "acca": r"ACCA[A-Z0-9]{8}", "npm_": r"npm_\w{20}", "hf_": r"hf_\w{20}", "shpat_": None, "shpss_": None, "shpca_": None, "sk-": r"sk-[\w\-]{20}", "eyj": r"eyJ[\w\-]{8}", "ac": r"AC[0-9a-f]{32}",
    "+": r"\+[^\S\n]*[\"'`]",
}
#: Where a plus joins two literals: a published form may stand in both.
_JOINT = re.compile(r"[^\S\n]*[\"'`][^\S\n]*\+[^\S\n]*[\"'`][^\S\n]*")


@functools.cache
def _signals() -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for k, r in SIGNALS.items():
        out.add_word(k, (len(k), re.compile(r).match if r else None))
    out.make_automaton()
    return out


def candidates(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of the lines that may hold a secret, in order: an automaton finds all signals in one pass."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(x if len(x) == 1 else c for c, x in ((c, c.lower()) for c in text))
    if not low.isascii():  # letters that regular expressions without case take for i and s
        low = low.replace("ı", "i").replace("İ", "i").replace("ſ", "s")
    done = tried = -1
    for end, (size, check) in _signals().iter(low):
        at = end - size + 1
        if at > done and (check is None or check(text, at)):
            start, stop = text.rfind("\n", 0, at) + 1, text.find("\n", at)
            stop = len(text) if stop < 0 else stop
            if low[at] == "+":
                if at <= tried:
                    continue
                tried = stop
                if not FORMAT.search(_JOINT.sub("", text[start:stop])):
                    continue
            done = stop
            yield start, stop


BEGIN = re.compile(r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----")
END = re.compile(r"-----END [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----")
#: The field is fitted on the lines of at most so many chunks of at most so many characters each; all chunks are searched.
FIT_CHUNKS, FIT_LENGTH = 12_000, 20_000
MASK = "*"

_TOKEN = re.compile(
    r"""(?P<url>[A-Za-z][A-Za-z0-9+.\-]*://)|(?P<quote>["'`])|(?P<flag>(?<![\w\-])--?[A-Za-z][\w\-]*)|(?P<name>[A-Za-z_$][\w$.\-]*(?=["'`\])]{0,2}[ \t]*(?:=>|:=|=(?!=)|:(?!//))))"""
    r"""|(?P<sign>=>|:=|[=:,;(){}\[\]<>@+|&])|(?P<word>[^\s"'`,;(){}\[\]<>|&]+)|(?P<space>\s+)"""
)


USER_FLAGS = ("-u", "--user", "--proxy-user")
_SPOKEN = re.compile(SPOKEN).match
_PAIR = re.compile(r"([^\s:\"'`/]+):([^\s\"'`]+)").match


@dataclass(slots=True)
class Token:
    start: int
    end: int
    text: str
    kind: str  # name, sign, quote, flag, url, word (unquoted), value (in quotes or after a sign), user, secret place
    name: str = ""  # the name it is assigned to
    before: str = ""  # the word or role just before
    quoted: bool = False
    whole: str = ""  # the value with the literals that a plus joins to it
    joined: int = 0  # whether it goes on from the literal before (2), or only into the next (1)


def tokens(line: str) -> list[Token]:
    """Lexical tokens of a line. What follows a name and its sign, and what stands in quotes, is not split at signs."""
    out: list[Token] = []
    pos, n, name, quote, role, sure = 0, len(line), "", "", "", False
    while pos < n:
        m = _TOKEN.match(line, pos)
        if m is None:
            pos += 1
            continue
        kind, text, end = m.lastgroup, m[0], m.end()
        if kind == "space":
            pos = end
            continue
        if role in USER_FLAGS and kind in ("word", "name", "value") and (pair := _PAIR(line, pos)):  # a login after a flag
            mid = pair.end(1)
            out += [Token(pos, mid, pair[1], "user", name, role, bool(quote)), Token(mid, mid + 1, ":", "sign"), Token(mid + 1, pair.end(), pair[2], "value", name, "login", bool(quote))]
            pos, role, name = pair.end(), "", ""
            continue
        if kind != "quote" and (pair := _SPOKEN(line, pos)) and (pos == 0 or not line[pos - 1].isalnum()):  # "login was name / value"
            out += [Token(pos, pair.end(1), pair[1], "word", name, "", bool(quote)), Token(pair.start(2), pair.end(2), pair[2], "user", name, "", bool(quote)), Token(pair.end(2), pair.start(3), "/", "sign"), Token(pair.start(3), pair.end(3), pair[3], "value", name, "login", bool(quote))]
            pos = pair.end(3)
            continue
        if kind == "flag" and pos and line[pos - 1].isspace():
            sure = False
        if quote and kind not in ("quote", "url") and not (kind == "flag" and line[pos - 1].isspace()) and not (kind == "name" and "://" not in text and re.match(r"[A-Za-z_][\w.\-]*[=:]\S", line[pos:]) is None and re.match(r"[\w.\-]+\s*:\s", line[pos:])):
            stop = pos
            while stop < n and line[stop] != quote and not line[stop].isspace():
                stop += 2 if line[stop] == "\\" else 1
            stop = min(stop, n)
            end, text, kind = stop, line[pos:stop], "value"
        elif sure and kind in ("word", "name", "sign", "flag") and not (kind == "sign" and text in "([{,;)]}") and not quote:
            end = pos
            while end < n and not line[end].isspace() and not (line[end] in "\"'`" and end > pos and False):
                end += 1
            if line[pos:end].rstrip(";,") != line[pos:end] and ("(" in line[:pos] or line.rstrip().endswith((";", ","))):
                end = pos + len(line[pos:end].rstrip(";,"))
            text, kind = line[pos:end], "value"
            if end == pos:
                pos += 1
                continue
        if kind == "quote":
            if not quote:
                quote = text
            elif quote == text:
                quote = ""
            out.append(Token(pos, end, text, "quote"))
        elif kind == "name":
            if not (len(out) > 1 and out[-1].text == ":" and out[-2].kind == "name" and re.match(r"\s*=", line[end:])):  # else a type
                name = text
            sure = False
            out.append(Token(pos, end, text, "name"))
        elif kind == "flag":
            name, role = text.lstrip("-"), text
            sure = False
            out.append(Token(pos, end, text, "flag"))
            pos = end
            continue
        elif kind == "url":
            out.append(Token(pos, end, text, "url", name, role))
            rest = re.compile(r"([^\s/\"'`:@]*):").match(line, end)
            if rest:
                out.append(Token(end, rest.end() - 1, rest[1], "user", name, "url", bool(quote)))
                out.append(Token(rest.end() - 1, rest.end(), ":", "sign"))
                at = re.compile(r"[^\s/\"'`@]*(?=@)").match(line, rest.end())
                if at and at[0]:
                    out.append(Token(at.start(), at.end(), at[0], "value", name, "login", bool(quote)))
                    end = re.compile(r"[^\s\"'`]*").match(line, at.end()).end()
                elif at is None:  # a login whose rest is in the next literal
                    cut_ = re.compile(r"[^\s/\"'`@]*(?=[\"'`] *\+)").match(line, rest.end())
                    if cut_:
                        if cut_[0] and not cut_[0].isdigit():
                            out.append(Token(cut_.start(), cut_.end(), cut_[0], "value", name, "login", bool(quote)))
                        end, role, pos = cut_.end(), "login", cut_.end()
                        continue
                    end = re.compile(r"[^\s\"'`]*").match(line, rest.end()).end()
            else:
                end = re.compile(r"[^\s\"'`]*").match(line, end).end()
            role = ""
        elif kind == "sign":
            if text in ("=", ":", ":=", "=>") and not quote:
                sure = bool(out and (out[-1].kind in ("name", "flag") or out[-1].kind == "quote" and len(out) > 2 and out[-2].kind in ("name", "value")))
                k = len(out) - 1
                while k >= 0 and (out[k].kind == "quote" or out[k].text in "])"):
                    k -= 1
                if k >= 0 and k < len(out) - 1 and out[k].kind in ("value", "name", "word"):  # "name": or settings["name"] =
                    name, sure = out[k].text, True
            elif text in ",;{(":
                sure = False
                if text in ",;":
                    name, role = "", ""
            out.append(Token(pos, end, text, "sign"))
        else:
            if role == "login" and quote and "@" in text:  # the rest of a login
                text = text[: text.index("@")]
                out.append(Token(pos, pos + len(text), text, "value", name, "login", True))
                role = ""
            else:
                if quote and not name and len(out) > 3 and out[-1].kind == "quote" and out[-2].text in ("to", "is") and out[-3].kind == "quote" and out[-4].kind == "value":
                    name = out[-4].text  # "set `name` to `value`"
                elif quote and len(out) > 5 and out[-1].kind == out[-3].kind == out[-5].kind == "quote" and out[-2].text == "," and out[-4].kind == "value" and out[-6].text == "(":
                    name = out[-4].text  # put("name", "value")
                out.append(Token(pos, pos + len(text), text, "value" if kind == "value" or quote else "word", name, role or (out[-1].text.lower() if out and out[-1].kind in ("word", "value") else ""), bool(quote)))
                if role.startswith("-"):
                    role = ""
            sure = sure and kind == "value" and text.lower() in ("bearer", "basic")
        pos = end
    marks = [(a, b) for a, b in (("{{", "}}"), ("<%", "%>"), ("${", "}")) if a in line]
    for t in out:
        inside = any(line.rfind(a, 0, t.start) > line.rfind(b, 0, t.start) for a, b in marks)
        t.whole = "{{" + t.text if inside else t.text  # a reference
    for i in _joints(out):
        out[i + 4].joined = 2
        out[i].joined = out[i].joined or 1
    chain: list[Token] = []
    # values that a plus joins are one
    for t in [*out, Token(0, 0, "", "value")]:
        if t.kind in ("value", "word"):
            if t.joined == 2 and chain:
                chain.append(t)
                continue
            whole = "".join(x.text for x in chain)
            for x in chain:
                x.whole = whole
            chain = [t] if t.joined else []
    return out


def _joints(line: list[Token]) -> Iterator[int]:
    """Values whose literal a plus joins to the literal of the fifth token from there."""
    for i in range(len(line) - 4):
        if line[i].kind == "value" and line[i + 1].kind == line[i + 3].kind == "quote" and line[i + 2].text == "+" and line[i + 4].kind == "value":
            yield i


def entropy(s: str) -> float:
    n = max(1, len(s))
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values())


_SHAPES = (
    ("uuid", re.compile(r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}")),
    ("number", re.compile(r"[\d.,_%:\-]+")),
    ("hash", re.compile(r"sha\d+[-:].*")),
    ("hex", re.compile(r"[0-9a-f]{16,}|[0-9A-F]{16,}")),
    ("lower", re.compile(r"[a-zà-ÿ]+")),
    ("title", re.compile(r"[A-ZÀ-Þ][a-zà-ÿ]+")),
    ("capitals", re.compile(r"[A-Z]{12,}")),
    ("upper", re.compile(r"[A-Z_]+")),
    ("words", re.compile(r"[A-Za-z]+(?:[-_. ][A-Za-z]+)+")),
    ("words and number", re.compile(r"[A-Za-z]+(?:[-_.][A-Za-z]+)+[-_.]?\d+")),
    ("name", re.compile(r"[a-z_$][\w$]*(?:\.[\w$]+)*(?:\(.*)?")),
    ("path", re.compile(r"[./~]?[\w.\-]*(?:/[\w.\-]+)+")),
)


def _scrambled(s: str) -> bool:
    """Whether the parts of a name or phrase are no words: of three letters or more without a vowel, or capitals inside."""
    parts = re.findall(r"[A-Z]?[a-z]+|[A-Z]+", s)
    return len(s) >= 8 and (sum(1 for x in parts if len(x) > 2 and not re.search(r"[aeiouyAEIOUY]", x)) > 0 and len(parts) > 2 or len(parts) > 3 and sum(map(len, parts)) / len(parts) < 3)


@functools.lru_cache(maxsize=20_000)
def shape(s: str) -> str:
    for k, r in _SHAPES:
        if r.fullmatch(s) and not (k in ("words", "name") and _scrambled(s)) and not (k == "path" and len(s) >= 30 and re.search(r"\d", s) and re.search(r"[A-Z]", s)):
            return k
    classes = [bool(re.search(p, s)) for p in (r"[a-z]", r"[A-Z]", r"\d", r"[^\w]")]
    return "mixed" + "".join("01"[c] for c in classes)


def _owner(name: str) -> str:
    return "none" if not name else "other" if OTHER_NAME.search(name) else "secret" if SECRET_NAME.search(name) else "plain"


@functools.lru_cache(maxsize=20_000)
def _blank(value: str) -> bool:
    """Whether a value is a placeholder, a reference to a value kept elsewhere, or the marker of a key block."""
    return bool(PLACEHOLDER.search(value) or REFERENCE.search(value) or value.startswith("-----"))


_PARTS = re.compile(r"[A-ZÀ-Þ]+(?![a-zß-ÿ])|[A-ZÀ-Þ]?[a-zß-ÿ]+")
_RUNS = re.compile(r"([a-zß-ÿ])[a-zß-ÿ]+|([A-ZÀ-Þ])[A-ZÀ-Þ]+|(\d)\d+")


@functools.lru_cache(maxsize=20_000)
def parts(name: str) -> tuple[str, ...]:
    """The words of a name, without their digits, in lower case."""
    return tuple(x.lower() for x in _PARTS.findall(name))


@functools.lru_cache(maxsize=20_000)
def _value_features(v: str, quoted: bool) -> tuple[str, ...]:
    """What the characters of a value look like; nothing here knows a published form."""
    s, n = shape(v), len(v)
    size = "0" if n < 4 else "4" if n < 6 else "6" if n < 8 else "8" if n < 12 else "12" if n < 16 else "16" if n < 20 else "20" if n < 32 else "32" if n < 48 else "48" if n < 72 else "72" if n < 128 else "128"
    letters = sum(map(str.isalpha, v))
    vowels = sum(map(v.lower().count, "aeiou")) * 8 // max(1, letters)
    digits = sum(map(str.isdigit, v)) * 8 // max(1, n)
    runs = _RUNS.sub(lambda m: "a" if m[1] else "A" if m[2] else "0", "".join("a" if c.islower() else "A" if c.isupper() else "0" if c.isdigit() else c for c in v[:64]))
    turns = len(runs) * 8 // min(n, 64) if n else 0
    code = "".join(c for c in "()[].$<>+/=" if c in v)
    return (f"s={s}", f"n={size}", f"e={int(entropy(v) * 2)}", f"w={vowels}", f"d={digits}", f"t={turns}", f"c={code}", f"c={code},n={size}", f"q={quoted}", f"u={runs[:6]}" if n < 16 else "u=", f"s={s},n={size}", f"s={s},q={quoted}", f"s={s},d={digits}", f"n={size},t={turns}", f"c={code},q={quoted}", f"u0={v[:1] if not v[:1].isalnum() else ''}")


@functools.lru_cache(maxsize=20_000)
def _name_features(name: str, s: str) -> tuple[bool, str, tuple[str, ...]]:
    words, f = parts(name), []
    for w in words:
        f += [f"w:{w}", f"w4:{w[:4]}"]
    last, two = words[-1] if words else "", " ".join(words[-2:])
    f += [f"l:{last}", f"l2:{two}", f"l3:{last[-4:]}", f"l:{last},s={s}", f"l2:{two},s={s}", f"w0:{bool(words)}", f"w0:{bool(words)},s={s}"]
    return bool(words), last, tuple(f)


def _context_features(line: list[Token], i: int) -> list[str]:
    """The words of the name a value is given to, the word before it, and the tokens around it."""
    t = line[i]
    s = shape(t.whole)
    words, last, name = _name_features(t.name, s)
    f = [*name]
    before = t.before if t.before.startswith("-") or t.before.isalpha() and len(t.before) <= 12 else "other" if t.before else ""
    near = [("" if not 0 <= k < len(line) else line[k].kind if line[k].kind in ("value", "word", "name", "user", "flag", "url") else line[k].text[:3]) for k in (i - 2, i - 1, i + 1)]
    f += [f"b:{before}", f"b:{before},q={t.quoted}", f"b:{before},s={s}", f"b:{before},n={len(t.whole) // 8}", f"j={t.joined}", f"j={t.joined},l:{last}"]
    f += [f"p2:{near[0]}", f"p1:{near[1]}", f"f1:{near[2]}", f"p:{near[0]} {near[1]}", f"p:{near[0]} {near[1]},s={s}", f"a:{near[1]} {near[2]}", f"a:{near[1]} {near[2]},w0:{words},s={s}"]
    return f


def features(line: list[Token], context: bool = True) -> list[list[str]]:
    """Shape and context features of each token: characters of values, words of names, neighbours. No list of names, no
    published form and no login rule, from which the labels come, is seen; without `context` nothing but the values is."""
    out = []
    for i, t in enumerate(line):
        if t.kind in ("value", "word", "user"):
            if _blank(t.whole):  # never a secret, and tells nothing of the name
                out.append(["blank"])
                continue
            f = ["bias", "k=" + t.kind, *_value_features(t.whole, t.quoted)]
            out.append(f + _context_features(line, i) if context else f)
        elif t.kind in ("begin", "end"):
            out.append(["bias", "k=" + t.kind, *(f"m:{w}" for w in parts(t.text))])
        elif t.kind == "material":
            out.append(["k=material"])
        else:
            out.append(["bias", "k=" + t.kind])
    return out


#: Labels to fit on: no secret, a secret, and not known.
NO, YES, UNKNOWN = 0, 1, 2
_CODE = re.compile(r"[\[\]().<>]|->|::")


def weak_labels(line: list[Token]) -> list[int]:
    """Labels to fit on: what a secret's published form, a login, or a telling name with a realistic value says for sure; of
    other values with a telling name or word before them nothing is known, and of all the rest that they are none."""
    out = []
    for t in line:
        y = NO
        if t.kind in ("value", "word") and not _blank(t.whole):
            v, s = t.whole, shape(t.whole)
            named = _owner(t.name) == "secret" and t.kind == "value" and t.before != "word" and v.lower() not in ("bearer", "basic")
            if FORMAT.match(v) or t.before == "login" and t.joined != 2:
                y = YES
            elif t.before in ("bearer", "basic"):
                y = YES if len(v) >= 8 and s not in ("lower", "title", "name", "words") or len(v) >= 20 else UNKNOWN
            elif t.before in ("token", "password", "passphrase", "secret", "key") and len(v) >= 20 and (s.startswith("mixed") or s in ("name", "hex")) and re.search(r"\d", v):
                y = YES
            elif named and not t.quoted and _CODE.search(v):
                y = UNKNOWN if len(v) >= 12 else NO
            elif named:
                real = len(v) >= (6 if t.quoted else 8) and s not in ("number", "upper", "title", "path", "uuid", "hash", "lower", "words") and (s != "name" or len(v) >= 20 or len(v) >= 8 and re.search(r"\d", v) is not None)
                y = YES if real else UNKNOWN if len(v) >= 8 and s in ("words", "name", "path", "title", "lower") and t.quoted else NO
            elif t.joined == 2:
                y = UNKNOWN
        elif t.kind in ("begin", "end", "material"):
            y = YES if "PRIVATE KEY" in t.before else NO
        out.append(y)
    return out


class Field:
    """A linear-chain conditional random field with two labels."""

    def __init__(self, weights: dict[str, float], change: list[list[float]]):
        self.weights, self.change = weights, change

    def decode(self, line: list[Token]) -> list[int]:
        """The best label sequence (Viterbi)."""
        get, c = self.weights.get, self.change
        a, b, back = 0.0, -1e9, []
        first = True
        for f in features(line):
            e = sum(get(x, 0.0) for x in f)
            if first:
                a, b, first = 0.0, e, False
                back.append((0, 0))
                continue
            to_a = (a + c[0][0], b + c[1][0])
            to_b = (a + c[0][1], b + c[1][1])
            ka, kb = int(to_a[1] > to_a[0]), int(to_b[1] > to_b[0])
            a, b = to_a[ka], to_b[kb] + e
            back.append((ka, kb))
        y = int(b > a)
        out = []
        for ka, kb in reversed(back):
            out.append(y)
            y = kb if y else ka
        return out[::-1]


def fit(lines: list[list[Token]], epochs: int = 80, rate: float = 0.2, decay: float = 0.02) -> Field:
    """Fit by gradient ascent (with moments) on the likelihood of the known labels, all sequences at once (forward-backward by position, once
    free and once held to the labels that are known).

    Every sequence counts twice: with all features, and with those of the values only. So a label that came from a name
    must be explained by the value as well, and the field tells a secret whose name is on no list.
    """
    lines = [x for x in [*lines, *seeds()] if x]
    index: dict[str, int] = {}
    rows, cols, ys, sizes = [], [], [], []
    for context in (True, False):
        for x in lines:
            ys.extend(weak_labels(x))
            sizes.append(len(x))
            for f in features(x, context):
                k = len(rows) and rows[-1] + 1
                for name in f:
                    rows.append(k)
                    cols.append(index.setdefault(name, len(index)))
    starts = np.cumsum([0, *sizes])
    n, width = int(starts[-1]), len(index)
    row, col, y = np.asarray(rows, np.int32), np.asarray(cols, np.int32), np.asarray(ys)
    begins = np.flatnonzero(np.r_[True, np.diff(row) > 0])
    longest = int(max(sizes))
    live = [starts[:-1][np.diff(starts) > t] + t for t in range(longest)]
    inner = np.ones(n, bool)
    inner[starts[:-1]] = False
    at = np.flatnonzero(inner)
    barred = np.zeros((n, 2))
    barred[y == NO, 1] = barred[y == YES, 0] = -1e4
    w, c = np.zeros(width), np.zeros((2, 2))
    first, second = np.zeros(width + 4), np.zeros(width + 4)

    def expected(emit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The probability that a token is a secret, and how often each pair of labels stands side by side."""
        fwd, bwd = np.zeros((n, 2)), np.zeros((n, 2))
        fwd[live[0]] = emit[live[0]]
        for t in range(1, longest):
            p = fwd[live[t] - 1][:, :, None] + c
            fwd[live[t]] = np.logaddexp(p[:, 0], p[:, 1]) + emit[live[t]]
        for t in range(longest - 1, 0, -1):
            q = c + (emit[live[t]] + bwd[live[t]])[:, None, :]
            bwd[live[t] - 1] = np.logaddexp(q[:, :, 0], q[:, :, 1])
        both = fwd + bwd
        z = np.logaddexp(both[:, 0], both[:, 1])
        pair = fwd[at - 1][:, :, None] + c + (emit[at] + bwd[at])[:, None, :] - z[at][:, None, None]
        return np.exp(both[:, 1] - z), np.exp(pair).sum(0)

    for step in range(1, epochs + 1):
        emit = np.stack([np.zeros(n), np.add.reduceat(w[col], begins)], 1)
        free, pairs = expected(emit)
        held, seen = expected(emit + barred)
        g = np.r_[np.bincount(col, (held - free)[row], width) - decay * w, (seen - pairs).ravel()]
        first, second = 0.9 * first + 0.1 * g, 0.98 * second + 0.02 * g * g
        move = rate * (1 - step / (epochs + 1)) * first / (1 - 0.9**step) / (np.sqrt(second / (1 - 0.98**step)) + 1e-8)
        w += move[:width]
        c += move[width:].reshape(2, 2)
    return Field({k: float(w[i]) for k, i in index.items()}, c.tolist())


def _usable(t: Token) -> bool:
    """The exact check after the field: a value that is no placeholder or reference."""
    return len(t.whole) >= 4 and not _blank(t.whole)


def has_usable(line: list[Token]) -> bool:
    """Whether the field has anything to decide in a line. It is fitted on such lines only, as it is asked about no others."""
    return any(t.kind in ("value", "word") and _usable(t) for t in line)


#: A line of key material, the shorter last one, a run of such lines, and what closes the literal after a last marker.
MATERIAL = r"[\s\"'`+\\]*[A-Za-z0-9+/=]{16,}(?:\\n)?[\s\"'`+;]*"
_MATERIAL, _SHORT = re.compile(MATERIAL), re.compile(r"[\s\"'`+\\]*(?:[A-Za-z0-9+/=]{4})+(?:\\n)?[\s\"'`+;]*")
_TAIL = re.compile(r"(?:[\s\"'`+\\]|\\n)*(?:[A-Za-z0-9+/=]{16,}(?:[\s\"'`+\\]|\\n)*)*")
_CLOSE = re.compile(r"(?:\\n|\\r|[^\S\n])*[\"'`]?")
_MARKER = re.compile(r"-----(BEGIN|END) [A-Z0-9 ]+-----")


def leading_material(text: str) -> int:
    """The length of the lines of key material a text begins with; a short one counts as the last of the text."""
    pos = 0
    while pos < len(text):
        stop = text.find("\n", pos)
        stop = len(text) if stop < 0 else stop
        line = text[pos:stop]
        if line.strip() and not _MATERIAL.fullmatch(line) and not (pos and not text[stop:].strip() and _SHORT.fullmatch(line)):
            return pos
        pos = stop + 1
    return len(text)


def key_edges(text: str) -> tuple[bool, bool, bool]:
    """Whether a text ends inside a private key block, is nothing but key material, and begins inside a block that it ends."""
    first, last = BEGIN.search(text), None
    for last in BEGIN.finditer(text):
        pass
    end = END.search(text)
    opens = last is not None and END.search(text, last.end()) is None and _within(text[last.end() :])
    closes = end is not None and (first is None or end.start() < first.start()) and _within(text[: end.start()])
    return opens, bool(text.strip()) and _within(text), closes


def _within(text: str) -> bool:
    """Whether all lines of a part of a block are key material or its headers."""
    return all(not x.strip(" \t\r\"'`+\\;n") or _MATERIAL.fullmatch(x) or re.fullmatch(r"[\w\-]+: [^\n]*", x) or _SHORT.fullmatch(x) for x in text.split("\n"))


def key_blocks(text: str) -> list[tuple[int, int, int]]:
    """(start of the marker, start and end of what is masked) of private key blocks; the start is -1 where only the end is in the text."""
    out, pos = [], 0
    head = END.search(text)
    first = BEGIN.search(text)
    if head and (not first or head.start() < first.start()):
        lines = text[: head.start()].split("\n")
        size = len(lines[-1])
        for i, x in enumerate(reversed(lines[:-1])):
            if not _MATERIAL.fullmatch(x) and (i or not _SHORT.fullmatch(x)):
                break
            size += len(x) + 1
        out.append((-1, head.start() - size, head.start()))
        pos = head.end()
    while m := BEGIN.search(text, pos):
        stop = END.search(text, m.end())
        following = BEGIN.search(text, m.end())
        if stop and (not following or stop.start() < following.start()):
            end = stop.start()
            pos = stop.end()
        else:  # the end is missing: the lines that look like key material
            end = pos = _TAIL.match(text, m.end()).end()
        body = re.sub(r"\\n|[^A-Za-z0-9+/=]", "", text[m.end() : end])
        if len(body) >= 16 and not PLACEHOLDER.search(body[:64]) or end >= len(text) - 1:
            out.append((m.start(), m.end(), end))
    return out


_CLEAN = re.compile(r"(?:\\n|\\r)|[A-Za-z0-9+/=]+")
#: Kinds of blocks between markers, as published for keys, certificates and messages.
MARKERS = ("PRIVATE KEY", "RSA PRIVATE KEY", "EC PRIVATE KEY", "DSA PRIVATE KEY", "OPENSSH PRIVATE KEY", "ENCRYPTED PRIVATE KEY", "PGP PRIVATE KEY BLOCK", "PUBLIC KEY", "RSA PUBLIC KEY", "PGP PUBLIC KEY BLOCK", "CERTIFICATE", "CERTIFICATE REQUEST", "X509 CRL", "PGP MESSAGE", "PGP SIGNATURE", "DH PARAMETERS")


def block(text: str, begin: str, a: int, b: int, end: str) -> list[Token]:
    """The tokens of a block over several lines: the marker it begins with, runs of key material, the marker it ends with. A
    marker that is in another chunk is an empty token with the words known of it."""
    kind = begin or end
    out = [Token(a, a, begin, "begin", before=kind)]
    out += [Token(*m.span(), m[0], "material", before=kind) for m in _CLEAN.finditer(text, a, b) if not m[0].startswith("\\")]
    return [*out, Token(b, b, end, "end", before=kind)]


def blocks(text: str, inside: bool = False) -> Iterator[tuple[int, list[Token]]]:
    """(start of the first marker or -1, tokens) of what stands between markers of keys and certificates."""
    if inside and (size := leading_material(text)):
        yield -1, block(text, "PRIVATE KEY", 0, size, "PRIVATE KEY")
    if "-----" not in text:
        return
    private = key_blocks(text)
    for s, a, b in private:
        m, e = BEGIN.match(text, s) if s >= 0 else None, END.match(text, b)
        yield s, block(text, m[0].strip("-")[6:] if m else "", a, b, e[0].strip("-")[4:] if e else "")
    for m in _MARKER.finditer(text):
        if m[1] == "BEGIN" and "PRIVATE KEY" not in m[0]:
            yield m.start(), block(text, m[0].strip("-")[6:], m.end(), _TAIL.match(text, m.end()).end(), m[0].strip("-")[6:])


def seeds() -> list[list[Token]]:
    """A sequence for every published marker, whole, without its end and without its beginning, so that the field knows them
    where the sample has none."""
    body = "MIIabcQ7r5Tz9Lk2"
    return [[t for t in block(body, kind if k != 2 else "", 0, len(body), kind if k != 1 else "")] for kind in MARKERS for k in range(3)]


def find(text: str, field: Field, inside: bool = False) -> tuple[list[int], str]:
    """(offsets at which a secret starts, text with the secrets masked): each masked character becomes one MASK. `inside` says
    that the text goes on from a private key block, or is a part of one, whose first marker is elsewhere."""
    starts: list[int] = []
    spans: list[tuple[int, int]] = []
    covered: list[tuple[int, int]] = []
    for s, line in blocks(text, inside):
        a, b = line[0].start, line[-1].end
        m = _MARKER.match(text, b)
        covered.append((s if s >= 0 else a, m.end() if m else b))
        labels = field.decode(line)
        if s >= 0 and labels[0]:
            starts.append(s)
        spans += [(t.start, t.end) for t, y in zip(line[1:-1], labels[1:-1]) if y]
    if covered or "-----" in text:
        covered = sorted(covered + [m.span() for m in _MARKER.finditer(text)])
    for at, stop in candidates(text):
        near = [(a, b) for a, b in covered if a < stop and b > at]
        for a, b in near:
            if a < at:  # what follows a block of earlier lines, after the quote that closes it
                at = max(at, _CLOSE.match(text, b, max(b, stop)).end())
        if at >= stop:
            continue
        line = tokens(text[at:stop])
        if not has_usable(line):
            continue
        labels, i = field.decode(line), 0
        while i < len(line):
            chain = [i]  # a value and the literals joined to it are masked as one
            while chain[-1] + 4 < len(line) and line[chain[-1]].joined and line[chain[-1] + 4].joined == 2:
                chain.append(chain[-1] + 4)
            apart = not any(a < at + line[k].end and b > at + line[k].start for k in chain for a, b in near)
            if apart and line[i].kind in ("value", "word") and any(labels[k] for k in chain) and _usable(line[i]):
                starts.append(at + line[i].start)
                spans += [(at + line[k].start, at + line[k].end) for k in chain]
            i = chain[-1] + 1
    if not spans:
        return starts, text
    out, pos = [], 0
    for a, b in sorted(spans):
        a = max(a, pos)
        if b > a:
            out += [text[pos:a], MASK * (b - a)]
            pos = b
    return starts, "".join(out) + text[pos:]


def fit_on(chunks: DataFrame, most: int = FIT_CHUNKS) -> Field:
    """The field fitted on the lines with signals of at most `most` chunks, chosen by a hash of their id; the bound holds at any size.

    Repeated rows count once: what the sample is taken from are keys and the content's hash, and only its rows are read again.
    """
    keys = ["chunk_id", "start_line", "_c"]
    rows = chunks.where(F.length("content") <= FIT_LENGTH).select("chunk_id", "start_line", F.xxhash64("content").alias("_c"), "content")
    chosen = bounded_sample(rows.select(*keys).groupBy(*keys).agg(F.lit(1).alias("_n")).select(*keys), keys, most).select(*(F.col(k).alias("s" + k) for k in keys))
    same = [F.col(k).eqNullSafe(F.col("s" + k)) for k in keys]
    sample = rows.join(F.broadcast(chosen), same[0] & same[1] & same[2]).groupBy(*keys).agg(F.min("content").alias("content")).orderBy(F.xxhash64(*keys))  # `most` rows
    lines, seen = [], set()
    for r in sample.toLocalIterator():
        lines += [x for _, x in blocks(r["content"])]
        for a, b in candidates(r["content"]):
            x = r["content"][a:b]
            if len(x) < 2000 and "-----" not in x and x not in seen:
                seen.add(x)
                if has_usable(line := tokens(x)):
                    lines.append(line)
    return fit(lines)


def with_neighbours(chunks: DataFrame) -> DataFrame:
    """(chunk_id, start_line, content, inside): inside for chunks that begin with key material which goes on from a private
    key block of the chunks before, or into one of the chunks after, in the same version of the file.

    Only what begins with key material or has a marker is gathered by file, without its content; only the former is joined.
    """
    plain = [F.col("chunk_id"), F.col("start_line"), F.col("content")]
    if not {"file_id", "file_hash"} <= set(chunks.columns):
        return chunks.select(*plain, F.lit(False).alias("inside"))
    keys = ["file_id", "file_hash", "start_line"]
    begins = F.col("content").rlike(rf"\A{MATERIAL}(?:\n|\z)") & F.col("file_id").isNotNull() & F.col("file_hash").isNotNull() & F.col("start_line").isNotNull()
    begins = F.coalesce(begins, F.lit(False))
    schema = pa.schema([("file_id", pa.int64()), ("file_hash", pa.string()), ("start_line", pa.int32()), ("last_line", pa.int32()), ("opens", pa.bool_()), ("whole", pa.bool_()), ("closes", pa.bool_())])

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(f, h, s, s + t.count("\n"), *key_edges(t)) for f, h, s, t in zip(*(b.column(i).to_pylist() for i in range(4)))]
            rows = [r for r in rows if any(r[4:])]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(f, h, s) for f, h, parts in zip(*(b.column(i).to_pylist() for i in range(3))) for s in inside_lines([tuple(x.values()) for x in parts])]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, schema.field(i).type) for i, c in enumerate(zip(*rows))], names=keys)

    near = chunks.where((begins | F.col("content").contains("PRIVATE KEY")) & F.col("file_id").isNotNull() & F.col("file_hash").isNotNull() & F.col("start_line").isNotNull())
    parts = near.select(*keys, "content").mapInArrow(edges, "file_id long, file_hash string, start_line int, last_line int, opens boolean, whole boolean, closes boolean")
    lists = parts.groupBy("file_id", "file_hash").agg(F.sort_array(F.collect_set(F.struct("start_line", "last_line", "opens", "whole", "closes"))).alias("parts"))
    # a chunk that begins with material and goes on otherwise is no part, but may follow one
    follow = chunks.where(begins).select(*keys).distinct().groupBy("file_id", "file_hash").agg(F.collect_set("start_line").alias("heads"))
    lists = lists.join(follow, ["file_id", "file_hash"]).select("file_id", "file_hash", F.sort_array(F.concat("parts", F.transform(F.array_except("heads", F.col("parts.start_line")), lambda s: F.struct(s.alias("start_line"), s.alias("last_line"), F.lit(False).alias("opens"), F.lit(False).alias("whole"), F.lit(False).alias("closes"))))).alias("parts"))
    inside = lists.mapInArrow(chained, "file_id long, file_hash string, start_line int").withColumn("inside", F.lit(True))
    joined = chunks.where(begins).select(*keys, "chunk_id", "content").join(inside, keys, "left").select(*plain, F.coalesce("inside", F.lit(False)).alias("inside"))
    return chunks.where(~begins).select(*plain, F.lit(False).alias("inside")).unionByName(joined)


def inside_lines(parts: list[tuple[int, int, bool, bool, bool]]) -> list[int]:
    """First lines of the parts (first line, last line, opens, whole, closes; sorted) that belong to a block of their neighbours."""
    out: set[int] = set()
    reach = None  # the last line of the open block
    for s, e, opens, whole, _ in parts:
        follows = reach is not None and s <= reach + 1
        if follows:
            out.add(s)
        if opens or follows and whole:
            reach = max(e, reach or e)
        elif not (follows and e <= reach):
            reach = None
    need = None  # the first line of the block that ends below
    for s, e, _, whole, closes in reversed(parts):
        if need is not None and whole and e + 1 >= need:
            out.add(s)
            need = s
        elif closes:
            need = s
        elif need is not None and not whole:
            need = None
    return sorted(out)


def find_secrets(chunks: DataFrame, field: Field | None = None) -> DataFrame:
    """(chunk_id, line_nos, masked): for every chunk that holds a secret, the file's lines at which one starts and the masked content.

    Every masked character is replaced by one `*`, so lines, quotes and all other characters keep their places. Repeated
    rows with the same chunk_id, start_line and content count once. Null content gives no row, a null start_line counts as
    1, chunk_id may be null. Empty tables give no rows. A block whose first marker is in an earlier chunk is masked here but
    starts there; for chunks that hold no marker of it, file_id and file_hash, where the table has them, say whose
    neighbours they are. Other columns are ignored.
    """
    field = field or fit_on(chunks)
    schema = pa.schema([("chunk_id", pa.string()), ("start_line", pa.int32()), ("line_nos", pa.list_(pa.int32())), ("masked", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for cid, line, text, inside in zip(*(b.column(i).to_pylist() for i in range(4))):
                starts, masked = find(text, field, inside)
                if starts or masked != text:
                    ends = [m.start() for m in re.finditer("\n", text)]
                    rows.append((cid, line, sorted({(1 if line is None else line) + bisect_right(ends, s - 1) for s in starts}), masked))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    hits = with_neighbours(chunks.where("content is not null")).mapInArrow(run, "chunk_id string, start_line int, line_nos array<int>, masked string")
    return hits.groupBy("chunk_id", "start_line", "line_nos", "masked").agg(F.lit(1)).select("chunk_id", "line_nos", "masked")
