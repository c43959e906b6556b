"""What the fit of personal data learns from and sets its thresholds on."""

from terrace.llm import pii


def test_trees_and_thresholds_count_all_documents(spark, monkeypatch):
    learned, calibrated = [], []
    boost, threshold = pii.boost, pii.threshold
    monkeypatch.setattr(pii, "boost", lambda x, right, weight: learned.append(weight.sum()) or boost(x, right, weight))
    monkeypatch.setattr(pii, "threshold", lambda score, right, weight: calibrated.append(weight.sum()) or threshold(score, right, weight))
    rows = [(i, f"write to ann{i}@host{i % 7}.org about it") for i in range(80)]
    pii.Redactor.fit(spark.createDataFrame(rows, "doc_id long, text string"))
    assert calibrated == [max(learned)]
