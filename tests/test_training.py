import pytest
from pyspark.sql import functions as F

from answerloom.operators import confusion as cm, metrics as mt, training as tr
from answerloom.plans import load


@pytest.fixture(scope="module")
def rows(spark):
    words = F.array(F.lit("wrong no"), F.lit("half maybe"), F.lit("right yes"))
    label = (F.col("id") % 3).cast("int")
    return spark.range(90).select(
        F.concat_ws(" ", F.lit("Answer:"), F.element_at(words, label + 1), F.col("id")).alias("text"),
        label.alias("labels"),
    )


def test_training_learns_separable_texts(rows):
    model = tr.train(rows, features=1 << 10, iterations=20)
    scored = tr.predict(model, rows)
    assert set(scored.columns) == {"text", "labels", "y_pred", "y_true"}
    assert mt.summary(cm.cells(scored)).first().accuracy == 1.0
    assert "y_true" not in tr.predict(model, rows.drop("labels")).columns


def test_grid_search_uses_the_validation_rows_only(rows):
    base = tr.pipeline(features=1 << 10)
    grid = tr.param_grid(base, regularization=[0.001, 0.01], iterations=[10])
    val = rows.limit(30)
    results, models = tr.grid_search(rows, val, grid, base)
    found = results.orderBy("combination_idx").collect()
    assert [r.combination_idx for r in found] == [1, 2] and len(models) == 2
    assert {r.support for r in found} == {30}
    assert "regParam=0.001" in found[0].params
    best = tr.best_combination(results).first()
    assert best.combination_idx == min(
        r.combination_idx for r in found if r.metric_value == max(x.metric_value for x in found)
    )


def test_load_splits(spark, tmp_path):
    header = "task_id;question;reference_answer;topic;student_answer;labels\n"
    (tmp_path / "train.csv").write_text(header + '1;q;r;a;"x;\ny";correct\n1;q;r;a;z;0\n')
    (tmp_path / "val.csv").write_text(header + "t7;q;;b;z;Partial\n")
    out = load.load_splits(
        spark, str(tmp_path / "table"), str(tmp_path / "train.csv"), str(tmp_path / "val.csv")
    )
    rows = out["answers"].collect()
    assert {(r.task_id, r.split, r.y_true) for r in rows} == {
        ("1", "train", 2), ("1", "train", 0), ("t7", "val", 1),
    }
    assert len({r.row_id for r in rows}) == 3
    assert {(r.topic, r.n) for r in out["topic_counts"].collect()} == {("a", 2), ("b", 1)}
    sizes = {(r.split, r.y_true): r.n for r in out["sizes"].collect()}
    assert sizes[(None, None)] == 3 and sizes[("train", None)] == 2
    assert {r.n for r in out["class_counts"].filter("split = 'test'").collect()} == {0}
    (tmp_path / "bad.csv").write_text(header + "1;q;r;a;z;maybe\n")
    with pytest.raises(Exception, match="no label class"):
        load.load_splits(spark, str(tmp_path / "t2"), str(tmp_path / "bad.csv"), str(tmp_path / "val.csv"))
