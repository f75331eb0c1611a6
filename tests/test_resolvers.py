"""Resolvers that a user registers: scope, several answers, ties, and one that takes another's place."""

import pytest
from pyspark.sql.functions import udtf

from glyphmill.operators.resolvers import Resolvers


@udtf(returnType="target string, confidence double")
class Upper:
    def eval(self, name: str, path: str):
        if name:
            yield name.upper(), 0.5
            yield None, 0.9
            yield "nothing", None


@udtf(returnType="target string, confidence double")
class Twice:
    def eval(self, name: str, path: str):
        yield "b", 0.5
        yield "a", 0.5


def test_registry(spark):
    refs = spark.createDataFrame([(1, "go", "x", "p"), (2, "py", "y", "p"), (3, "py", None, None), (4, None, "z", "p")], "ref long, language string, name string, path string")
    own = Resolvers(spark)
    assert own.resolve(refs, "ref").count() == 0
    own.register("upper", Upper)
    assert sorted(map(tuple, own.resolve(refs, "ref").collect())) == [(1, "upper", "X", 0.5), (2, "upper", "Y", 0.5), (4, "upper", "Z", 0.5)]
    own.register("again", Twice, ("py",))
    found = sorted(map(tuple, own.resolve(refs, "ref").collect()))
    assert found == [(1, "upper", "X", 0.5), (2, "again", "a", 0.5), (3, "again", "a", 0.5), (4, "upper", "Z", 0.5)] and own.candidates(refs).count() == 3 + 4
    own.register("upper", Twice, ("go",))  # takes the place of the first
    assert sorted(map(tuple, own.resolve(refs, "ref").collect()))[0] == (1, "upper", "a", 0.5) and own.candidates(refs).count() == 2 + 4
    own.unregister("again")
    assert own.resolve(refs, "ref").count() == 1
    with pytest.raises(ValueError, match="no name"):
        own.register("a b", Upper)
