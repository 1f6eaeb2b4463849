"""Publication that is cut off after any step: readers see one whole bundle, and recovery finishes or drops the other."""

import pytest

from tideline.sources import publish


class Killed(Exception):
    pass


def tables(spark, mark):
    return {"models": spark.createDataFrame([(f"{mark}{k}", k) for k in range(5)], "key string, n long"), "notes": spark.createDataFrame([(mark,)], "text string")}


def seen(spark, root):
    return sorted(r.key for r in publish.read_active(spark, root, "models").collect()), [r.text for r in publish.read_active(spark, root, "notes").collect()]


def whole(mark):
    return [f"{mark}{k}" for k in range(5)], [mark]


STEPS = {"intent": "dropped", "table models": "dropped", "table notes": "dropped", "manifest": "finished", "pointer": "finished"}


@pytest.mark.parametrize("step", STEPS)
def test_killed_after_each_step(spark, tmp_path, step):
    root = str(tmp_path / "store")
    assert publish.publish(spark, root, "first", tables(spark, "a")) == 1

    def kill(done):
        if done == step:
            raise Killed

    with pytest.raises(Killed):
        publish.publish(spark, root, "second", tables(spark, "b"), kill)
    assert seen(spark, root) == whole("b" if step == "pointer" else "a")  # before any recovery
    assert publish.recover(spark, root) == {"second": STEPS[step]}
    assert publish.recover(spark, root) == {}
    assert seen(spark, root) == whole("b" if STEPS[step] == "finished" else "a")
    if STEPS[step] == "dropped":
        assert publish.publish(spark, root, "second", tables(spark, "c")) == 2 and seen(spark, root) == whole("c")
    else:
        with pytest.raises(ValueError):
            publish.publish(spark, root, "second", tables(spark, "c"))
        assert publish.publish(spark, root, "third", tables(spark, "d")) == 3 and seen(spark, root) == whole("d")


def test_a_bundle_whose_tables_changed_is_dropped(spark, tmp_path):
    root = str(tmp_path / "store")
    publish.publish(spark, root, "first", tables(spark, "a"))

    def kill(done):
        if done == "manifest":
            raise Killed

    with pytest.raises(Killed):
        publish.publish(spark, root, "second", tables(spark, "b"), kill)
    tables(spark, "x")["models"].write.mode("overwrite").parquet(f"{root}/bundles/second/models")
    assert publish.recover(spark, root) == {"second": "dropped"} and seen(spark, root) == whole("a")


def test_nothing_published(spark, tmp_path):
    assert publish.active(spark, str(tmp_path)) is None and publish.recover(spark, str(tmp_path)) == {}
    with pytest.raises(ValueError):
        publish.read_active(spark, str(tmp_path), "models")
