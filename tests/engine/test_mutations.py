import pytest

from ferrowick.govern import NotAllowed
from ferrowick.model import Mask, Role, SemanticModel, Table
from ferrowick.operators import mutations
from ferrowick.session import Engine


@pytest.fixture
def engine(spark):
    df = spark.createDataFrame([(1, "west", 5, "x"), (2, "east", 6, "x"), (3, None, 7, "x")], "id int, region string, amount int, by string")
    role = Role("r", rows={"t": "region = 'west'"}, masks={("t", "by"): Mask("constant")})
    model = SemanticModel.of(tables=[Table("t", ("id",), presets=(("by", "'r'"),))], roles=[role, Role("all")])
    return Engine(spark, model, lambda _: df, "r")


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_only_visible_rows_change(engine, spark):
    assert rows(mutations.delete(engine, "t", {})) == [(2, "east", 6, "x"), (3, None, 7, "x")]
    assert rows(mutations.update(engine, "t", {"amount": "amount + 1"}, {"id": {"lte": 2}})) == [(1, "west", 6, "r"), (2, "east", 6, "x"), (3, None, 7, "x")]
    new = spark.createDataFrame([(1, "west", 9), (2, "west", 9), (4, "east", 9)], "id int, region string, amount int")
    assert rows(mutations.insert(engine, "t", new, upsert=True)) == [(1, "west", 9, "r"), (2, "east", 6, "x"), (3, None, 7, "x")]
    assert len(rows(mutations.insert(engine, "t", new))) == 5


def test_masked_columns_are_not_set(engine):
    with pytest.raises(NotAllowed):
        mutations.update(engine, "t", {"by": "'me'"}, {})
