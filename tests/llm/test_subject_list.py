"""All subjects of the list count, however long it is."""

from quarryline.llm import subjects
from tests.llm.test_secrets_subjects import corpus


def test_all_subjects(spark, monkeypatch):
    docs, labels, names = corpus(spark)
    kept = []
    monkeypatch.setattr(subjects, "fit", lambda *x: kept.append(x[1]))
    many = names.union(spark.createDataFrame([(f"s{i}", "x") for i in range(1500)] * 2, "subject string, description string"))
    subjects.fit_on(docs, labels, many)
    assert len(kept[0]) == 1504
