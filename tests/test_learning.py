"""Forests learn the planted substitutions, and stored models come back the same."""

import json

import pytest
from pyspark.sql import functions as F

from cytoquill.operators import features, forest
from cytoquill.operators.verify import label_candidates, truth_snps
from cytoquill.queries import learning

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def trained(spark):
    return learning.small_forests(spark, SF)


def test_scores_separate_true_from_false(spark, trained):
    cols, models = trained
    scored = forest.score(cols, models)
    assert scored.where("score < 0 or score > 1 or score is null").count() == 0
    labelled = label_candidates(scored, learning.planted_truth(spark, SF))
    means = {(r["model"], r["label"]): r["m"] for r in labelled.groupBy("model", "label").agg(F.avg("score").alias("m")).collect()}
    for model in forest.MODELS:
        assert means[model, 1] > means[model, 0] + 0.2, means


def test_stored_models_score_alike_and_foreign_layouts_are_refused(spark, trained, tmp_path):
    cols, models = trained
    path = str(tmp_path / "m")
    forest.save(models, path)
    back = forest.load(spark, path)
    one = {tuple(r) for r in forest.score(cols, {"cpg": models["cpg"]}).collect()}
    two = {tuple(r) for r in forest.score(cols, {"cpg": back["cpg"]}).collect()}
    assert one == two
    weights = forest.importances(models, spark).groupBy("model").agg(F.sum("importance").alias("w")).collect()
    assert all(abs(r["w"] - 1) < 1e-6 for r in weights)
    spark.createDataFrame([(json.dumps({"platt": {"a": 0, "b": 0}, "layout": "other"}),)], "value string").write.mode("overwrite").text(f"{path}/cpg/meta")
    with pytest.raises(ValueError, match="layout"):
        forest.load(spark, path)


def test_layout_sizes():
    assert {m: len(f) for m, f in features.LAYOUTS.items()} == {"cpg": 60, "denovo": 61, "other": 59}


def test_truth_keys(spark):
    rows = [("c", 1, "A", "T", "PASS"), ("c", 2, "ACC", "GCC", "PASS"), ("c", 3, "AC", "GT", "PASS"), ("c", 4, "A", "AT", "PASS"), ("c", 5, "A", "T", "q10"), ("c", 6, "N", "T", "PASS")]
    got = truth_snps(spark.createDataFrame(rows, "contig string, pos bigint, ref string, alt string, filter string"))
    assert sorted((r["pos"], r["ref"], r["alt"]) for r in got.collect()) == [(1, "A", "T"), (2, "A", "G")]
