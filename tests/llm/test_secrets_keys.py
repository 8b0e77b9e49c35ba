"""Secrets beside key blocks, and key blocks over several chunks."""

from quarryline.llm import secrets
from tests.llm.test_secrets_subjects import FOUND, PEM, field

ROWS = [f"{c}IIabcQ7r5Tz9Lk2" * 4 for c in "ABCDEFGHKL"]
FLAT = PEM.replace("\n", "\\n")
SECRET = "t9vf7N9G0Zv2xeSXDs9XR8HnCUqf"


def test_secret_beside_a_block():
    f = field()
    for block, n in ((FLAT, 1), (FLAT.replace("RSA PRIVATE", "PUBLIC"), 0), (FLAT.replace("RSA PRIVATE KEY", "CERTIFICATE"), 0)):
        text = f'{{"tls_key": "{block}", "client_secret": "{SECRET}"}}'
        starts, masked = secrets.find(text, f)
        assert starts == [text.index("-----BEGIN")] * n + [text.index(SECRET)] and SECRET not in masked
        assert ("MII" in masked) == (n == 0)
    text = f'x = "{PEM}", "client_secret": "{SECRET}"\ny = 1'
    starts, masked = secrets.find(text, f)
    assert starts == [text.index("-----BEGIN"), text.index(SECRET)] and SECRET not in masked and "MII" not in masked and masked.endswith("\ny = 1")
    text = '-----BEGIN PUBLIC KEY-----\n"x"\n' + FOUND[0][0] + "\n-----END PUBLIC KEY-----"
    assert len(secrets.find(text, f)[0]) == 1


def test_short_last_line():
    text = ROWS[0] + "\nQ7r5Tz==\n-----END PRIVATE KEY-----\n"
    assert not {"AII", "Q7r"} & {secrets.find(text, field())[1][i : i + 3] for i in range(90)}


def test_block_over_chunks(spark):
    head, tail = "a = 1\n-----BEGIN PRIVATE KEY-----\n", "\n-----END PRIVATE KEY-----\nb = 2"
    lines = lambda a, b: "\n".join(ROWS[a:b])
    pieces = [(1, head + lines(0, 2)), (5, lines(2, 4)), (6, lines(3, 6)), (9, lines(6, 8)), (11, lines(8, 9) + tail)]
    rows = [(f"a{s}", 1, "h", s, t) for s, t in pieces]
    rows += [(f"b{s}", 2, "h", s, t) for s, t in pieces[:3]]  # no end
    rows += [(f"c{s}", 3, "h", s, t) for s, t in pieces[2:]]  # no begin
    rows += [("d5", 4, "h", 5, lines(2, 4)), ("e1", 5, "h", 1, head + lines(0, 2)), ("e5", 5, "other", 5, lines(2, 4)), ("f9", 6, "h", 9, lines(2, 4)), ("f1", 6, "h", 1, head + lines(0, 2))]  # no neighbours
    rows += [("g1", 7, "h", 1, head + lines(0, 2)), ("g5", 7, "h", 5, lines(2, 4) + "\nx = 3"), ("h5", None, None, 5, lines(2, 4)), ("i5", 8, "h", None, lines(2, 4))]
    table = spark.createDataFrame(rows, "chunk_id string, file_id long, file_hash string, start_line int, content string")
    got = {r.chunk_id: r for r in secrets.find_secrets(table, field()).collect()}
    assert set(got) == {r[0] for r in rows} - {"d5", "e5", "f9", "h5", "i5"}
    assert all("IIabc" not in r.masked for r in got.values())
    assert got["g5"].masked.endswith("*\nx = 3") and got["a5"].line_nos == [] and got["a1"].line_nos == [2]
