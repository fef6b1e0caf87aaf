"""Semantics that the tables don't show: literal rows, errors and traps."""

import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from brindle.errors import NotFound, QueryError
from brindle.functions import text as X
from brindle.functions.coerce import coerce
from brindle.model import Model, Relation
from brindle.operators import cache
from brindle.operators.relations import Links, load_tree
from brindle.plans import windows as W
from brindle.plans.aggregates import count, max_of, min_of, sum_of
from brindle.query import Query
from brindle.sources.database import Database
from brindle.streaming.windows import windowed
from pyspark.sql import types as T

AUDIT = Model("audit_rows", "id bigint, amount bigint, aggregate_1 bigint", ("id",))
GROUPS = Model("audit_groups", "id bigint, category string, amount bigint", ("id",))
USERS = Model("users", "id bigint, name string, active boolean", ("id",), encrypted=frozenset({"name"}))
BIN = Model("binned", "id bigint, name string, deleted_at timestamp", ("id",), soft_delete="deleted_at")
READINGS = Model("readings", "id bigint, sensor string, value bigint", ("id",))
DOCS = Model("docs", "id bigint, doc string, items array<string>", ("id",), json=frozenset({"doc"}))
TREE = Model("tree_nodes", "id bigint, parent_id bigint, name string, deleted_at timestamp", ("id",), soft_delete="deleted_at")
BOOKS = Model("books", "id bigint, title string", ("id",), relations={"tags": Relation("through", lambda: TAGS, "id", "book_id", pivot="book_tags", pivot_related="tag_id")})
TAGS = Model("tags", "id bigint, name string", ("id",))


@pytest.fixture
def db(spark):
    make = lambda model, rows: spark.createDataFrame(rows, model.schema)
    tables = {
        "audit_rows": make(AUDIT, [(1, 20, 7), (2, 10, 9), (3, 30, 11)]),
        "audit_groups": make(GROUPS, [(1, "empty", None), (2, "a", 2), (3, "a", 3), (4, "b", 8)]),
        "users": make(USERS, [(1, "A", True), (2, "A", False), (3, None, True)]),
        "binned": make(BIN, [(1, "x", None), (2, "y", None)]).unionByName(spark.sql("SELECT 3L AS id, 'z' AS name, TIMESTAMP'2020-01-01' AS deleted_at")),
        "readings": make(READINGS, [(1, "s", 5), (2, "s", None), (3, "s", 7), (4, "t", 1)]),
        "docs": make(DOCS, [(1, '{"a": 1, "b": [1, 2], "n": null}', ["x", None]), (2, '{"a": "1"}', []), (3, "[1, [2]]", None), (4, "not json", ["y"]), (5, None, ["x", "y"]), (6, '{"a": 1e0}', ["z"])]),
        "tree_nodes": make(TREE, [(1, None, "root", None), (2, 1, "b", None), (3, 2, "c", None), (4, 3, "d", None), (1, 4, "loop", None)]),
        "books": make(BOOKS, [(1, "one"), (2, "two")]),
        "tags": make(TAGS, [(1, "t1"), (2, "t2"), (3, "t3")]),
        "book_tags": spark.createDataFrame([(1, 1), (1, 2), (1, 2), (2, 3)], "book_id bigint, tag_id bigint"),
    }
    return Database(spark, tables=tables)


def ids(query):
    return sorted(r["id"] for r in query.frame().collect())


def test_count_ignores_limits_and_aggregates_do_not(db):
    query = Query(AUDIT, db).order_asc("id").limit(2).offset(1)
    assert query.count() == 3
    row = query.aggregates(n=count(), low=min_of("aggregate_1"), total=sum_of("amount")).first()
    assert (row["n"], row["low"], row["total"]) == (2, 9, 40)
    assert Query(AUDIT, db).where_gt("id", 9).sum("amount") == 0
    assert Query(AUDIT, db).where_gt("id", 9).avg("amount") is None


def test_having_sums_missing_values_to_zero(db):
    query = Query(GROUPS, db).select("category").group_by("category")
    assert [r[0] for r in query.having(sum_of("amount").eq(0)).frame().collect()] == ["empty"]
    assert [r[0] for r in query.having(max_of("amount").eq(None)).frame().collect()] == ["empty"]
    with pytest.raises(QueryError):
        sum_of("amount").gt("many")
    with pytest.raises(QueryError):
        max_of("amount").gt(None)


def test_null_rules(db):
    assert ids(Query(USERS, db).where_eq("name", None)) == [3]
    assert ids(Query(USERS, db).where_not("name", "B")) == [1, 2]
    assert ids(Query(USERS, db).where_in("name", ["A", None])) == [1, 2, 3]
    with pytest.raises(QueryError):
        Query(USERS, db).where_gt("id", None).frame()


def test_errors_wait_for_the_terminal_and_the_first_wins(db):
    query = Query(USERS, db).order_by("id", "sideways").only_trashed().limit(1)
    with pytest.raises(QueryError, match="sideways"):
        query.get()
    with pytest.raises(QueryError):
        Query(USERS, db).skip_locked().frame()
    assert len(Query(USERS, db).lock_for_update().skip_locked().get()) == 3


def test_json_rules(db):
    q = Query(DOCS, db)
    assert ids(q.where_json_contains("doc", {"a": 1})) == [1, 6]
    assert ids(q.where_json_contains("doc", 1)) == [3]
    assert ids(q.where_json_contains("doc", [[2]])) == [3]
    assert ids(q.where_json_contained_by("doc", {"a": "1", "z": 0})) == [2]
    assert ids(q.where_eq("doc", {"a": 1.0})) == [6]
    assert ids(q.where_json_key_exists("doc", "n")) == [1]
    assert ids(q.where_json_key_not_exists("doc", "n")) == [2, 3, 4, 6]
    assert ids(q.where_json_path_exists("doc", "b[1]")) == [1]
    assert ids(q.where_json_path_exists("doc", "n")) == [1]


def test_array_rules(db):
    q = Query(DOCS, db)
    assert ids(q.where_array_contains("items", ["x"])) == [1, 5]
    assert ids(q.where_array_contains("items", [])) == [1, 2, 4, 5, 6]
    assert ids(q.where_array_contained_by("items", ["x", None])) == [1, 2]
    assert ids(q.where_array_overlaps("items", ["y", None])) == [1, 4, 5]
    assert ids(q.where_array_overlaps("items", [])) == []


@pytest.mark.parametrize("name", ["eq", "ne", "json_contains", "json_contained_by"])
def test_json_rules_parse_a_document_once(db, name):
    doc = {"a": 1, "b": [1, {"x": [2, "y"]}], "n": None}
    df = getattr(Query(DOCS, db), f"where_{name}")("doc", doc).frame()
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson") == 1 and df.count() == {"eq": 0, "ne": 4, "json_contains": 0, "json_contained_by": 1}[name]


def test_json_rules_on_members_of_any_name(spark):
    names = ["", "a.b", "it's", 'a"b', "a]b", "\\", "é"]
    db = Database(spark, tables={"docs": spark.createDataFrame([(i, json.dumps({n: {n: [i]}}), None) for i, n in enumerate(names)], DOCS.schema)})
    for i, n in enumerate(names):
        q = Query(DOCS, db)
        assert ids(q.where_eq("doc", {n: {n: [i]}})) == ids(q.where_json_contains("doc", {n: {n: [i]}})) == ids(q.where_json_contained_by("doc", {n: {n: [i, -1]}})) == [i]
        assert sorted(ids(q.where_ne("doc", {n: {n: [i]}}))) == [k for k in range(len(names)) if k != i]


def test_json_set_keeps_the_rest(db):
    change = Query(DOCS, db).where_eq("id", 1).update_all().json_set("doc", "c.d", [1]).change()
    row = change.touched.select(F.to_json(F.parse_json("doc"))).first()[0]
    assert row == '{"a":1,"b":[1,2],"c":{"d":[1]},"n":null}'


def test_lag_default_fills_only_beyond_the_edge(db):
    query = Query(READINGS, db).select("id").window(W.lag("w", "value", 1, -1).partition_by("sensor").order_by("id"))
    assert {r["id"]: r["w"] for r in query.frame().collect()} == {1: -1, 2: 5, 3: None, 4: -1}


def test_guards_of_changes(db):
    with pytest.raises(QueryError):
        Query(USERS, db).delete()
    with pytest.raises(QueryError):
        Query(USERS, db).where_not_in("id", []).delete()
    with pytest.raises(QueryError):
        Query(USERS, db).where_raw("1 = 1").delete()
    with pytest.raises(QueryError):
        Query(USERS, db).where_eq("id", 1).delete_all()
    assert Query(USERS, db).where_eq("id", 1).delete().execute() == 1
    assert ids(Query(USERS, db)) == [2, 3]
    assert Query(USERS, db).update_all().execute() == 0


def test_soft_delete_scope(db):
    assert ids(Query(BIN, db)) == [1, 2]
    assert Query(BIN, db).where_eq("id", 1).soft_delete().execute() == 1
    assert ids(Query(BIN, db).only_trashed()) == [1, 3]
    assert Query(BIN, db).only_trashed().restore().execute() == 2
    assert ids(Query(BIN, db)) == [1, 2, 3]


def test_scaling_rounds_half_away_from_zero(db):
    rows = Query(AUDIT, db).where_in("id", [1, 2, 3]).update_all().multiply("aggregate_1", 0.5).change().touched.collect()
    assert sorted((r["id"], r["aggregate_1"]) for r in rows) == [(1, 4), (2, 5), (3, 6)]


def test_encrypted_columns_are_guarded(db):
    with pytest.raises(QueryError):
        Query(USERS, db).select("name").distinct().frame()
    with pytest.raises(QueryError):
        Query(USERS, db).select("name").union(Query(TAGS, db).select("name")).frame()
    with pytest.raises(QueryError):
        Query(USERS, db).max("name")


def test_projection_rules(db):
    assert Query(USERS, db).select("id").select("active").frame().columns == ["active"]
    with pytest.raises(QueryError):
        Query(USERS, db).select("id").get()
    with pytest.raises(QueryError):
        Query(AUDIT, db).select("id").distinct().order_asc("amount").frame()
    with pytest.raises(QueryError):
        Query(AUDIT, db).select("id").union(Query(TAGS, db).select("name")).frame()


def test_fragments_are_checked(db):
    for bad in ("1 = 1; DROP TABLE x", "id = 1 -- no", "id = 1 UNION SELECT 2", "(id = 1", "id = 'x"):
        with pytest.raises(QueryError):
            Query(AUDIT, db).where_raw(bad).frame()
    with pytest.raises(QueryError):
        Query(AUDIT, db).where_raw("id = ?").frame()
    assert ids(Query(AUDIT, db).where_raw("id IN (?, ?) AND '?' = '?'", 1, 3)) == [1, 3]


def test_finding_and_pages(db):
    assert Query(AUDIT, db).find(2)["amount"] == 10
    with pytest.raises(NotFound):
        Query(AUDIT, db).find_or_fail(9)
    page = Query(AUDIT, db).paginate(2, 2)
    assert (page.total, page.last_page, page.has_next_page, [r["id"] for r in page.items]) == (3, 2, False, [3])
    with pytest.raises(QueryError):
        Query(AUDIT, db).paginate(0, 2)
    first = Query(AUDIT, db).cursor_paginate(2)
    second = Query(AUDIT, db).cursor_paginate(2, first.next_cursor)
    assert [r["id"] for r in first.items + second.items] == [1, 2, 3] and second.next_cursor is None
    assert [[r["id"] for r in b] for b in Query(AUDIT, db).chunks(2)] == [[1, 2], [3]]


def test_tree_ends_at_cycles_and_trash(db):
    found = load_tree(Query(TREE, db), 1, "parent_id", 10).collect()
    assert sorted((r["id"], r["depth"]) for r in found) == [(2, 1), (3, 2), (4, 3)]


def test_pivot_links(db):
    links = Links(db, BOOKS, "tags")
    rows = Query(BOOKS, db).with_("tags").get()
    assert {r["id"]: [t["name"] for t in r["tags"]] for r in rows} == {1: ["t1", "t2"], 2: ["t3"]}
    links.attach(2, 3, 1)
    assert {r["id"]: r["n"] for r in links.counts(Query(BOOKS, db).frame()).collect()} == {1: 2, 2: 2}
    assert links.detach(2, 1) == 1
    links.sync(1, 3)
    assert [t["name"] for t in Query(BOOKS, db).with_("tags").find(1)["tags"]] == ["t3"]


def test_values_are_read_as_their_column():
    assert coerce("2.50", T.DecimalType(10, 2)) == Decimal("2.50")
    assert coerce("1.5", T.LongType()) == Decimal("1.5")
    assert coerce(7, T.StringType()) == "7"
    assert str(coerce("2020-01-01T02:00:00+02:00", T.TimestampNTZType())) == "2020-01-01 00:00:00"
    for bad, kind in ((float("nan"), T.DoubleType()), ("x", T.LongType()), ("maybe", T.BooleanType()), ("soon", T.DateType())):
        with pytest.raises(QueryError):
            coerce(bad, kind)


def test_cache_forgets_what_changed(db):
    query = Query(AUDIT, db).cache_for(60)
    assert len(query.get()) == 3 and len(db.cache) == 1
    Query(AUDIT, db).where_eq("id", 1).delete().execute()
    assert not db.cache and len(query.get()) == 2
    cache.clear(db)


def test_validation_and_snippets(spark):
    row = spark.sql("SELECT 'a@b.co' AS mail, 'http://x.org/a' AS url, CAST(NULL AS STRING) AS gone, 'one two three four five' AS text, '<a> & b' AS html")
    ok = row.select(X.valid(F.col("mail"), "email"), X.valid(F.col("url"), "url"), X.valid(F.col("gone"), "required"), X.valid(F.col("gone"), "email"), X.violations({"mail": [("numeric",)]})).first()
    assert list(ok) == [True, True, False, True, ["mail: numeric"]]
    assert row.select(X.snippet(F.col("text"), ["three"], 1)).first()[0] == "...two <b>three</b> four..."
    assert row.select(X.escape_html(F.col("html"))).first()[0] == "&lt;a&gt; &amp; b"


def test_stream_with_watermark(spark, tmp_path):
    source = spark.sql("SELECT TIMESTAMP'2020-01-01 00:00:10' AS ts, 'a' AS k UNION ALL SELECT TIMESTAMP'2020-01-01 00:01:10', 'a' UNION ALL SELECT TIMESTAMP'2020-01-01 00:00:20', 'b'")
    source.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(source.schema).parquet(str(tmp_path / "in"))
    counted = windowed(stream, "ts", "1 minute", ["k"], [F.count(F.lit(1)).alias("n")], late="10 minutes")
    run = counted.writeStream.outputMode("complete").format("memory").queryName("counted").option("checkpointLocation", str(tmp_path / "state")).start()
    run.processAllAvailable()
    run.stop()
    assert sorted((r["k"], r["n"]) for r in spark.table("counted").collect()) == [("a", 1), ("a", 1), ("b", 1)]


def test_entry_and_registry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    names = set(entry.queries())
    assert set(entry.oracle_sql()) <= names and "top_lines" in names


def test_plans_reach_the_scan(spark):
    """Filters and columns reach the Parquet scan; a sorted limit is a top-k, not a sort."""
    from brindle.tables import LINEITEM

    base = Database(spark, "/root/testdata/sf0.001")
    query = Query(LINEITEM, base).select("l_orderkey").where_gt("l_quantity", 10).where_eq("l_returnflag", "R").order_asc("l_orderkey").limit(5)
    plan = query.plan()
    assert "GreaterThan(l_quantity,10.0)" in plan and "EqualTo(l_returnflag,R)" in plan
    assert "TakeOrderedAndProject" in plan and "l_comment" not in plan
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double,l_returnflag:string>" in plan
