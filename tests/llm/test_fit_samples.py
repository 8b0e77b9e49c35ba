"""Repeated rows do not change what the field is fitted on."""

from quarryline.llm import secrets
from tests.llm.test_secrets_subjects import CHUNK


def test_repeated_rows_count_once(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(secrets, "fit", lambda lines: seen.append(sorted("".join(t.text for t in x) for x in lines)))
    rows = [(f"c{i}", 1, f'password = "Xk3!vQ9z_p{i:03d}"', 0, "") for i in range(40)] + [(None, None, 'token = "Xk3!vQ9z_pnull"', 0, "")]
    for n in (1, 60):
        more = [r for r in rows for _ in range(n if r[0] in ("c1", "c2", "c3", "c4", "c5", "c6", None) else 1)]
        secrets.fit_on(spark.createDataFrame(more, CHUNK), 20)
    secrets.fit_on(spark.createDataFrame(rows, CHUNK), 100)
    assert seen[0] == seen[1] and len(seen[0]) == 20 and len(seen[2]) == 41
