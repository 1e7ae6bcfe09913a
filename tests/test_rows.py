"""Hidden characters are found where a row lies: nothing is shuffled, and every row gets what its own text holds."""

import pytest

from signalroom.operators import layer_a
from signalroom.plans import hidden, marks


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("rows")
    spark.createDataFrame([(12, "x th y"), (12, "plain"), (12, "x th y th"), (None, "a​b"), (24, None)], "doc_id bigint, text string").write.parquet(f"{top}/documents.parquet")
    return str(top)


def test_no_text_is_shuffled(spark):
    docs = spark.createDataFrame([(1, "a​b")], "doc_id int, t string")
    for found in (layer_a.inspect(docs), layer_a.inspect(docs, aggressive=True), layer_a.kind_counts(docs), layer_a.clean(docs), layer_a.bidi_pairs(docs)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Window" not in plan


def test_signs_of_later_unicode(spark):
    """Marks of format that Java 17 doesn't know yet."""
    docs = spark.createDataFrame([(1, "a࢐b\U0001343fc")], "doc_id int, t string")
    assert [(r.codepoint, r.kind, r.places) for r in layer_a.inspect(docs).orderBy("codepoint").collect()] == [(0x890, "other_cf", "1"), (0x1343F, "other_cf", "3")]
    assert layer_a.clean(docs).first().cleaned == "abc"


def test_report(spark, folder):
    rows = sorted((r.length or 0, r.suspicious_total, r.hits) for r in hidden.QUERIES["layer_a_doc_report"](spark, folder).where("doc_id = 12").collect())
    assert rows == [(5, 0, 0), (7, 1, 1), (11, 2, 1)]
    assert "Exchange" not in hidden.report(spark, folder)._jdf.queryExecution().executedPlan().toString()


def test_items(spark, folder):
    rows = marks.text_items(spark, folder)
    assert sorted((r.path, r.suspicious_total, r.findings, r.levels) for r in rows.where("page_id = 12").collect()) == [("doc/12", 0, [], []), ("doc/12", 1, ["layer-a [zwj_family] U+200B x1"], ["probable"]), ("doc/12", 2, ["layer-a [zwj_family] U+200B x2"], ["probable"])]
    assert rows.count() == 5 and "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()


def test_risk(spark, folder):
    rows = marks.risk(spark, folder)
    assert sorted(r.score for r in rows.where("doc_id = 12").collect()) == [5, 25, 25]
    assert rows.count() == 5 and "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
