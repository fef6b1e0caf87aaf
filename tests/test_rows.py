"""Single rows, advice, rules and the catalogue."""

import pytest

from brindle.errors import NotFound, QueryError
from brindle.model import Model, Relation
from brindle.operators.advice import Rules, analyze, complexity
from brindle.operators.rows import Rows
from brindle.query import Query, query
from brindle.sources.database import Database

OWNERS = Model("owners", "id bigint, name string", ("id",), relations={"pets": Relation("has_many", lambda: PETS, "id", "owner_id")})
PETS = Model("pets", "id bigint, owner_id bigint, name string", ("id",))


@pytest.fixture
def db(spark):
    return Database(spark, tables={"owners": spark.createDataFrame([(1, "Ann")], OWNERS.schema), "pets": spark.createDataFrame([], PETS.schema)})


def test_life_of_a_row(db):
    rows = Rows(db, OWNERS, rules={"name": [("required",), ("max_length", 5)]})
    assert rows.create({"name": "Bob"})["id"] == 2
    with pytest.raises(QueryError):
        rows.create({"name": "too long a name"})
    with pytest.raises(QueryError):
        rows.create({"id": 2, "name": "Eve"})
    rows.save({"id": 2, "name": "Bo"})
    assert rows.reload({"id": 2})["name"] == "Bo"
    with pytest.raises(NotFound):
        rows.update({"id": 9, "name": "No"})
    assert rows.destroy(1) == 1 and not rows.exists(1)
    saved = rows.save_with({"name": "Cy"}, pets=[{"name": "Rex"}, {"name": "Tom"}])
    with db.scope():
        assert [p["name"] for p in query(OWNERS).with_("pets").find(saved["id"])["pets"]] == ["Rex", "Tom"]


def test_advice_and_rules(db):
    wide = Query(OWNERS, db).where_like("name", "%n").order_asc("name")
    assert len(analyze(wide)) == 3 and complexity(wide.inner_join("pets", "owners.id", "pets.owner_id")) == 4
    with pytest.raises(QueryError):
        Rules(max_rows=10).check(wide)
    with pytest.raises(QueryError):
        Rules(forbid_raw=True).check(wide.where_raw("id > 1"))
    Rules(max_rows=10, max_joins=0, max_in_values=2).check(wide.limit(5).where_in("id", [1, 2]))


def test_catalogue(db, spark):
    assert db.ping() and db.has_table("pets") and db.has_column("pets", "name") and not db.has_table("nothing")
    assert db.columns("owners") == [("id", "bigint", True), ("name", "string", True)]
    assert "CREATE TABLE owners" in db.ddl(OWNERS)
    assert db.raw("SELECT count(*) AS n FROM owners WHERE id = :k", {"k": 1}).first()["n"] == 1
