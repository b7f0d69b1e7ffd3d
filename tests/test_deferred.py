import pytest

from leafgrid.functions.features import layout_features
from leafgrid.operators import trainable
from leafgrid.plans.deferred import ConfigError, Graph
from leafgrid.plans.pipeline import Pipeline, registry

MADE = []


@registry.register("noted", "thing")
def noted(size: int, of: object = None) -> tuple:
    MADE.append(size)
    return ("thing", size, of)


def graph(config):
    return Graph(config, registry.get)


def test_references_are_one_object_built_once_and_late():
    MADE.clear()
    g = graph({"a": {"@thing": "noted", "size": "${n}", "of": ["${b}", {"deep": "${b}"}]}, "b": {"@thing": "noted", "size": 2}, "n": 7, "never": {"@thing": "noted", "size": 9}, "text": "n is ${n}."})
    assert MADE == []
    _, size, of = g.get("a")
    assert size == 7 and of[0] is of[1]["deep"] is g.get("b") and sorted(MADE) == [2, 7] and g.get("text") == "n is 7."


@pytest.mark.parametrize(("config", "path", "what"), [
    ({"a": "${b}", "b": {"x": "${a}"}}, "b.x", "refers to itself: a -> b -> b.x -> a"),
    ({"a": {"x": ["${no.where}"]}}, "a.x.0", "no setting no.where"),
    ({"a": {"x": {"@thing": "absent"}}}, "a.x", "no thing named 'absent'"),
    ({"a": {"x": {"@thing": "noted", "size": 1, "colour": 2}}}, "a.x", "unknown argument colour"),
    ({"a": {"x": {"@thing": "noted"}}}, "a.x", "size"),
    ({"a": {"@thing": "noted", "@factory": "noted"}}, "a", "one factory"),
])
def test_errors_name_their_path(config, path, what):
    with pytest.raises(ConfigError, match=what) as e:
        graph(config).get("a")
    assert e.value.path == path


def test_nested_config_with_a_trained_classifier_comes_back_from_its_folder(spark, tmp_path):
    rows = [(d, b, 0, 0.1, 0.5, b / 10, b / 10 + 0.05, "12 34" if b % 2 else "ein Wort", "number" if b % 2 else "text") for d in range(6) for b in range(8)]
    boxes = layout_features(spark.createDataFrame(rows, "doc_id long, box_idx int, page_num int, x0 double, x1 double, y0 double, y1 double, text string, label string"))
    model, _ = trainable.train(trainable.box_vectors(boxes, dims=32), steps=30)
    for scheme in ("file://", ""):
        first = f"{scheme}{tmp_path}/model{len(scheme)}"
        model.save(spark, first)
        config = {
            "pipeline": ["classifier", "merger"], "shared": {"dims": 32, "model": {"@model": "saved", "path": first}},
            "components": {"classifier": {"@factory": "text-classifier", "model": "${shared.model}", "dims": "${shared.dims}"}, "merger": "${shared.other}"},
        }
        config["shared"]["other"] = {"@factory": "merge-boxes"}
        made = Pipeline.from_config(config, spark=spark)
        folder = f"{scheme}{tmp_path}/saved{len(scheme)}"
        made.save(spark, folder)
        made.save(spark, folder)
        back = Pipeline.load(spark, folder)
        assert back.pipe_names == ["classifier", "merger"] and back.config()["components"]["classifier"]["dims"] == 32
        with back.select_pipes(enable=["classifier"]):
            found = {(r.doc_id, r.box_idx): r.label for r in back(boxes).collect()}
        assert found == {r[:2]: r[-1] for r in rows}
    with pytest.raises(ConfigError, match="no model is saved") as e:
        Pipeline.load(spark, folder, {"classifier.model.path": "weights/none"})
    assert e.value.path == "components.classifier.model"
