"""Classifiers are really trained: on small tables, to the end that their held-out rows set."""

import math

import pytest
from pyspark.sql import functions as F

from packetloom.catalog import queries as qs
from packetloom.operators import models as md
from packetloom.operators.metrics import confusion_counts, overall
from packetloom.operators.sampling import with_sample_weight


@pytest.fixture(scope="module")
def rows(spark):
    """Three classes on a plane with some noise, a fifth of the rows held out."""
    def point(i):
        label = "abc"[i % 3]
        turn = 2.1 * (i % 3) + 0.6 * math.sin(i * 12.9898)
        return label, math.cos(turn) + 0.1 * math.sin(i * 7.7), math.sin(turn) + 0.1 * math.cos(i * 3.3), i % 5 == 0

    return spark.createDataFrame([point(i) for i in range(240)], "label string, x double, y double, held_out boolean").coalesce(1)


def macro_f1(model, table):
    return overall(confusion_counts(md.predict(model, table, ["x", "y"]))).first()["macro_f1"]


def test_boosting_ends_by_the_held_out_rows(spark, rows):
    model = md.fit("xgb", rows, ["x", "y"], 1, rounds=15, depth=2, held_out="held_out")
    trees = [m.getNumTrees for m in model.stages[-1].stages]
    assert len(trees) == 3 and all(1 <= t <= 15 for t in trees)
    assert macro_f1(model, rows.where("held_out")) > 0.8
    # each class ends before the first round that gains too little on held-out rows
    for k, own in enumerate(model.stages[-1].stages):
        table = model.stages[1].transform(model.stages[0].transform(with_sample_weight(rows, "label").where("held_out")))
        loss = own.evaluateEachIteration(table.withColumn("_own", (F.col(md.CODE) == k).cast("double")))
        assert loss == sorted(loss, reverse=True)


def test_boosting_without_held_out_rows_runs_all_rounds(rows):
    model = md.fit("xgb", rows, ["x", "y"], 1, rounds=2, depth=2)
    assert [m.getNumTrees for m in model.stages[-1].stages] == [2, 2, 2]


def test_margins_decide_and_models_can_be_stored(spark, rows, tmp_path):
    from pyspark.ml import PipelineModel

    model = md.fit("xgb", rows, ["x", "y"], 1, rounds=1, depth=2)
    model.write().overwrite().save(str(tmp_path / "m"))
    again = PipelineModel.load(str(tmp_path / "m"))
    pick = lambda m: sorted(map(tuple, md.predict(m, rows, ["x", "y"]).select("x", "y_true", "y_pred").collect()))
    assert pick(model) == pick(again)


def test_perceptron_goes_on_from_its_last_weights(spark, rows):
    train, valid = rows.where("not held_out"), rows.where("held_out")
    model, history = md.train_on(train, valid, ["x", "y"], 1, step=4, most=8, patience=2)
    found = [tuple(r) for r in history.orderBy("epoch").collect()]
    assert [r[:2] for r in found] == [(e, 4 * (e + 1)) for e in range(len(found))]
    best = max(range(len(found)), key=lambda e: (found[e][2], -e))
    assert len(found) == 2 or len(found) - 1 - best == 2
    assert macro_f1(model, valid) == pytest.approx(found[best][2])
    first = md.fit("mlp", train, ["x", "y"], 1, rounds=4)
    second = md.fit("mlp", train, ["x", "y"], 1, rounds=4, weights=first.stages[-1].weights)
    assert macro_f1(second, valid) == pytest.approx(found[1][2])


@pytest.mark.parametrize("name", ["gnb", "svm"])
def test_other_models_learn(rows, name):
    train, test = rows.where("not held_out"), rows.where("held_out")
    stacked = md.run_models([name], train, test, ["x", "y"], 1)
    assert md.model_summary(stacked).first()["macro_f1"] > 0.7


def test_registered_models_keep_their_full_rounds():
    assert {f"classifier_{n}" for n in ("xgb", "gnb", "logreg", "svm", "mlp")} <= set(qs.QUERIES)
    trees = md.TRAINERS["xgb"](1, 2, 3)[0].classifier
    assert (trees.getMaxIter(), trees.getStepSize(), trees.getMaxDepth()) == (600, 0.08, 6)
    with pytest.raises(ValueError):
        md.fit("other", None, [])
    assert md.run_models(["rf", "mlp"], None, None, [], dry_run=True) == ["rf", "mlp"]


def test_a_forest_is_grown_in_parts(spark, rows):
    train, test = rows.where("not held_out"), rows.where("held_out")
    model = md.fit("rf", train, ["x", "y"], 1, trees=10, depth=4, parallel=4)
    parts = model.stages[-1].stages
    assert [p.getNumTrees for p in parts] == [3, 3, 2, 2] and len({p.getSeed() for p in parts}) == 4
    assert macro_f1(model, test) > 0.8
    # votes are added over all trees, as one forest adds them
    scored = model.transform(test).collect()
    names = model.stages[0].labels
    sums = [[sum(r[f"{md.VOTES}{k}"][c] for k in range(4)) for c in range(3)] for r in scored]
    expected = sorted((r.x, r.y, names[s.index(max(s))]) for r, s in zip(scored, sums))
    assert sorted((r.x, r.y, r.y_pred) for r in md.predict(model, test, ["x", "y"]).collect()) == expected
    shares = {r.feature: r.importance for r in md.importances(model, ["x", "y"], spark).collect()}
    assert sum(shares.values()) == pytest.approx(1.0) and set(shares) == {"x", "y"}


def test_margins_are_trained_side_by_side_and_small_tables_in_few_tasks(spark, rows, monkeypatch):
    assert md.TRAINERS["svm"](1, 6, 2)[0].getParallelism() == 6
    seen = []
    fit = md.Pipeline.fit
    monkeypatch.setattr(md.Pipeline, "fit", lambda self, df: seen.append((df.rdd.getNumPartitions(), df.count())) or fit(self, df))
    spread = rows.where("not held_out").repartition(7)
    md.fit("gnb", spread, ["x", "y"], 1)
    monkeypatch.setattr(md, "TASK_VALUES", 100)
    md.fit("gnb", spread, ["x", "y"], 1)
    assert seen == [(1, 192), (4, 192)]


def test_rows_are_prepared_once_for_all_epochs(rows, monkeypatch):
    calls = []
    weighed = md.with_sample_weight
    monkeypatch.setattr(md, "with_sample_weight", lambda *a: calls.append(a) or weighed(*a))
    _, history = md.train_on(rows.where("not held_out"), rows.where("held_out"), ["x", "y"], 1, step=2, most=6, patience=3)
    assert history.count() == 3 and len(calls) == 1
