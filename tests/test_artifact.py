"""A stored model is checked before it scores."""

import pytest

from tenuis.operators import artifact as art
from tenuis.operators import model as ml
from tenuis.operators.features import NUMERIC, STRUCTURED


def features(spark, change=()):
    names = [("intercept", "intercept"), *(("structured", n) for n in STRUCTURED), *(("numeric", n) for n in NUMERIC), ("domain", "D"), ("text", "pump")]
    rows = [[g, n, i, 1.0, 0.0, 1.0, 0.25] for i, (g, n) in enumerate(names)]
    for at, column, value in change:
        rows[at][column] = value
    return spark.createDataFrame([tuple(r) for r in rows], art.COLUMNS)


def table(spark, domain="D"):
    row = ("c", domain, "g", None, 1, "pump pump", *[True] * len(STRUCTURED), *[0.5] * len(NUMERIC))
    kind = ", ".join(["candidate_id string", "domain string", "group_id string", "negative_class string", "target int", "model_text string", *[f"{n} boolean" for n in STRUCTURED], *[f"{n} double" for n in NUMERIC]])
    return spark.createDataFrame([row], kind)


def test_a_good_model_scores(spark, tmp_path):
    path = str(tmp_path / "model")
    art.save_model(features(spark), path)
    data = table(spark)
    model = art.checked_model(spark, path, data)
    pairs = data.selectExpr("'stored' AS model", "'text_structured' AS variant", "candidate_id")
    out = ml.score(pairs, data, ml.term_counts(data), model).collect()
    assert len(out) == 1 and 0.5 < out[0]["score"] < 1
    with pytest.raises(Exception, match="(?i)exists"):
        art.save_model(features(spark), path)


def test_a_misfit_is_refused(spark, tmp_path):
    path = str(tmp_path / "model")
    art.save_model(features(spark), path, threshold=2.0)
    with pytest.raises(ValueError, match="threshold_outside"):
        art.checked_model(spark, path, table(spark))
    got = {(r["violation"], r["name"]) for r in art.incompatible(*art.load_model(spark, path), table(spark, "E").drop(NUMERIC[0]).withColumn(STRUCTURED[0], ml.F.lit("x"))).collect()}
    assert got == {("threshold_outside", None), ("unknown_domain", "E"), ("column_missing", NUMERIC[0]), ("column_type_differs", STRUCTURED[0])}


@pytest.mark.parametrize(
    ("change", "violation"),
    [
        ((), None), (((1, 0, "image"),), "unknown_group"), (((1, 1, " "),), "blank_name"), (((1, 6, float("nan")),), "coefficient_not_finite"), (((1, 6, None),), "coefficient_not_finite"),
        (((-1, 3, None),), "idf_not_finite"), (((-3, 5, float("inf")),), "scaling_not_finite"), (((-3, 5, 0.0),), "scale_not_positive"), (((1, 2, 99),), "places_broken"),
        (((2, 1, STRUCTURED[0]),), "repeated_feature"), (((0, 0, "domain"),), "not_one_intercept"), (((-1, 0, "domain"),), "no_text"),
    ],
)
def test_every_rule_of_a_model_table(spark, change, violation):
    got = {r["violation"] for r in art.broken_features(features(spark, change)).collect()}
    assert got == set() if violation is None else violation in got
