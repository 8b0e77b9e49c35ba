"""No line that may hold a secret is left out before the field sees it."""

import random
import re._parser as parser

import pytest

from quarryline.llm import secrets

VALUE = "q7Rt2vXb9LmK4sWz8Yc3"
LINES = [
    f"accesskey={VALUE}", f"privatekey: {VALUE}", f"encryptionkey = '{VALUE}'", f"# the key {VALUE}9", f"Login: svc_a / {VALUE}", f"user was svc_a / {VALUE}", f"account svc_a / {VALUE}", f"acceso svc_a : {VALUE}", f"el usuario era svc_a / {VALUE}", f"signin: svc_a / {VALUE}",
    f"curl --user  svc_a:{VALUE} x", f"curl -u  'svc_a:{VALUE}' x", f"f('ghp' + '_{VALUE * 2}', 'x')", f"f('AKI' + 'AQ7RT2VXB' + '9LMK4SWZ', 'x')", f"paſſword = '{VALUE}'", f"basic  {VALUE}",
]


def strings(parsed) -> list[str]:
    """What the parts of a parsed expression may match at the least, with one character for a class."""
    out = [""]
    for op, arg in parsed:
        if op is parser.LITERAL:
            some = [chr(arg)]
        elif op is parser.IN:
            some = [chr(v) if k is parser.LITERAL else chr(v[0]) if k is parser.RANGE else "a" for k, v in arg[:6]]
        elif op is parser.BRANCH:
            some = [x for p in arg[1] for x in strings(p)]
        elif op is parser.SUBPATTERN:
            some = strings(arg[3])
        elif op in (parser.MAX_REPEAT, parser.MIN_REPEAT):
            low, high, p = arg
            some = [x * n for x in strings(p)[: 1 if low > 1 else None] for n in {low, min(high, max(low, 1))}]
        else:
            some = [""]  # a place or a look around
        out = [a + b for a in out for b in some]
    return out


def usable(line: str) -> bool:
    return secrets.YES in secrets.weak_labels(secrets.tokens(line))


@pytest.mark.parametrize("line", LINES)
def test_line(line):
    assert usable(line) and list(secrets.candidates(f"a\n{line}\nb")) == [(2, 2 + len(line))]


def test_all_names_and_forms():
    names, forms = (list(dict.fromkeys(strings(parser.parse(r.pattern)))) for r in (secrets.SECRET_NAME, secrets.FORMAT))
    assert len(names) > 60 and len(forms) > 25
    for x in names:
        for line in (f"{x} = '{VALUE}'", f"{x.upper()}={VALUE}", f'"x_{x}": "{VALUE}"', f"--{x} {VALUE}"):
            assert not usable(line) or list(secrets.candidates(line)), line
    for x in forms:
        assert usable(x) and list(secrets.candidates(x)), x
        assert list(secrets.candidates(f"f('{x[:2]}' + \"{x[2:]}\")")), x


def test_no_usable_token_is_left_out():
    words = "login Login: user was acceso account creds signin basic Bearer token secret key Key _key accesskey apiKey key_id pin pat Pat pw Pw mdp auth author cred creditor pass Pass compass ſecret pİn -u --user -p --pass --key = : := => \" ' ` + , ; / ( ) { } [ ] @ :// http://a:b@c ${ ghp _ sk- AKIA".split()
    words += [VALUE, VALUE * 2, "svc_a", "svc_a:" + VALUE, "a\\", "x9"]
    r, n = random.Random(5), 0
    for _ in range(30_000):
        line = "".join(r.choice(words) + r.choice(["", "", " ", " ", "  "]) for _ in range(r.randint(2, 9)))
        if usable(line):
            n += 1
            assert list(secrets.candidates(line)), line
    assert n > 2000
