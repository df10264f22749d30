"""The helpers that keep the shared folder small."""

import glob

import pytest

from rowkeel.llm.common import save, scratch, shared_dir


def tables(spark):
    return set(glob.glob(shared_dir(spark).removeprefix("file://") + "/rowkeel-*"))


def test_scratch(spark):
    had = tables(spark)
    with scratch(spark) as settle:
        one = settle(save(spark.range(5)).where("id > 1"))
        assert len(tables(spark) - had) == 1 and one.count() == 3
        two = settle(save(one).where("id > 2"))
        assert len(tables(spark) - had) == 1
        save(two)
    assert len(tables(spark) - had) == 1 and [r.id for r in two.orderBy("id").collect()] == [3, 4]
    with pytest.raises(RuntimeError), scratch(spark):
        save(spark.range(2))
        raise RuntimeError
    assert len(tables(spark) - had) == 1
    save(two)  # nothing is deleted outside
    assert len(tables(spark) - had) == 2
