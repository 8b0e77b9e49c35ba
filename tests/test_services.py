"""Clients of services against a local server, editor answers and configuration of older versions."""

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from quarryline.config import migrated
from quarryline.operators import embedding as E
from quarryline.operators import providers as S
from quarryline.operators import symbols as Y


class Handler(BaseHTTPRequestHandler):
    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        status, answer = 200, {}
        if self.path == "/api/embeddings":
            status, answer = (500, {"error": "too long"}) if len(body["prompt"]) > 20 else (200, {"embedding": [float(len(body["prompt"])), 1.0]})
        elif self.path == "/v1/embeddings":
            status, answer = (401, {}) if self.headers["Authorization"] != "Bearer k" else (200, {"data": [{"embedding": [float(len(t))]} for t in body["input"]]})
        else:
            answer = {"response": body["prompt"].upper()}
        self.send_response(status)
        self.end_headers()
        self.wfile.write(json.dumps(answer).encode())

    def log_message(self, *args):
        pass


@pytest.fixture(scope="module")
def server():
    s = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}"
    s.shutdown()


def test_clients(server, monkeypatch):
    local, cloud = S.LocalEmbedder(server + "/"), S.CloudEmbedder(server)
    assert local.embed(["ab", ""]) == [[2.0, 1.0], [0.0, 1.0]]
    with pytest.raises(OSError, match="500: .*too long"):
        local.embed(["x" * 30])
    monkeypatch.delenv("OPENAI_API_KEY", raising=False)
    with pytest.raises(OSError, match="no key"):
        cloud.embed(["a"])
    monkeypatch.setenv("OPENAI_API_KEY", "k")
    assert cloud.embed(["a", "bcd"]) == [[1.0], [3.0]]
    assert S.complete("hi", server) == "HI"
    vectors, name, error = E.attempt([S.LocalEmbedder(server), cloud], ["y" * 30], 1)
    assert (vectors, name, error) == ([[30.0]], "openai", "")
    assert E.create("ollama").dimensions == 768


RESULTS = "score double, rel_path string, lines string, context string, language string, function_name string, class_name string, why string"


def test_editor_answers(spark):
    rows = [(0.9, "a\\b.py", "3-7", "def f(): pass", "python", "f", None, "names it"), (0.5, "c.js", "4", "class K {}", "", "", "K", None), (0.4, "d.js", None, None, None, None, None, None), (0.3, None, "1-2", "x", None, None, None, None)]
    df = spark.createDataFrame(rows, RESULTS)
    assert {(r.uri, r.start_line, r.end_line) for r in Y.locations(df, "/r/").collect()} == {("file:///r/a/b.py", 2, 6), ("file:///r/c.js", 3, 3), ("file:///r/d.js", 0, 0)}
    assert [(r.name, r.kind, r.container) for r in Y.workspace_symbols(df, "/r").orderBy("name").collect()] == [("K", 5, "c.js"), ("f", 12, "a\\b.py")]
    assert Y.hover(df, "f").first().value == "**f**\n\n```python\ndef f(): pass\n```\n\n_names it_\n\n📁 File: `a\\b.py`"
    assert Y.hover(df.limit(0), "f").count() == Y.locations(df.limit(0), "/r").count() == 0


def test_migrated_settings():
    old = {"providers": {"openai": {"type": "openai", "model": "m"}}, "performance": {}, "storage": {"backup": {"enabled": True}}, "exclusions": ["*.log"]}
    new = migrated(old)
    assert new["version"] == "1.0.0" and new["providers"]["openai"]["model"] == "m" and new["providers"]["openai"]["rateLimit"]["requestsPerMinute"] == 3000 and new["providers"]["ollama"]["dimensions"] == 768
    assert new["storage"]["backup"] == {"enabled": True} and new["storage"]["cleanup"]["maxAge"] == 30 and new["storage"]["compression"]["level"] == 6
    assert new["exclusions"]["patterns"] == ["*.log"] and new["performance"] == {"cache": {"enabled": True, "maxSize": 100, "ttl": 3600, "type": "memory"}, "adaptiveBatching": True} and new["logging"]["level"] == "info"
    assert "version" not in old and "rateLimit" not in old["providers"]["openai"]
    part = migrated({"version": "0.3.0", "providers": {"x": {"rateLimit": {"retry": {}}}}})
    assert part["providers"]["x"]["rateLimit"]["retry"] == {"jitter": True} and "storage" not in part
    assert migrated({"version": "2.0.0"}) == {"version": "2.0.0"} and migrated({}, "0.2.0")["version"] == "0.2.0"
    with pytest.raises(ValueError, match="0.2.5"):
        migrated({"version": "0.2.5"})
