"""Results that must hold whatever runs before: caches, keyset cursors, raw SQL by handle, stamps, repeated reads of changes."""

import base64
import json
from datetime import datetime
from itertools import count

import pytest
from pyspark.sql import functions as F

from brindle import catalogue
from brindle.errors import QueryError
from brindle.model import Model, Relation
from brindle.operators import cache
from brindle.operators.mutations import on_conflict
from brindle.operators.relations import Eager, MorphTo
from brindle.operators.session import Session
from brindle.plans import windows as W
from brindle.plans.clauses import Cte
from brindle.plans.predicates import Exists
from brindle.query import Query
from brindle.sources.database import Database
from brindle.sources.schema import Migration, Migrator, Schema, foreign_keys, schema_sql, seed
from brindle.tables import CUSTOMER

ITEMS = Model("items", "id bigint, kind string, n bigint", ("id",))
PARTS = Model("parts", "id bigint, item_id bigint, owner_type string", ("id",), relations={"item": Relation("belongs_to", lambda: ITEMS, "item_id", "id"), "owner": Relation("morph_to", lambda: (ITEMS, BIN), "item_id", morph=("owner_type", None))})
BIN = Model("bin", "id bigint, name string, deleted_at timestamp_ntz", ("id",), soft_delete="deleted_at")
PAIRS = Model("pairs", "a bigint, b string, n bigint", ("a", "b"))


@pytest.fixture
def db(spark):
    make = lambda model, rows: spark.createDataFrame(rows, model.schema)
    return Database(
        spark,
        tables={
            "items": make(ITEMS, [(i, "ab"[i % 2], i * 10) for i in range(1, 7)]),
            "parts": make(PARTS, [(1, 1, "items"), (2, 1, "items"), (3, 2, "bin"), (4, 3, "items"), (5, 3, "items"), (6, 3, None), (7, 4, "nowhere"), (8, 5, "items"), (9, 6, "items")]),
            "bin": make(BIN, [(1, "x", None), (2, "y", None), (3, "z", None)]),
            "pairs": make(PAIRS, [(a, b, 1) for a in (1, 2, 3) for b in "xyz"]),
        },
    )


def ids(rows):
    return [r["id"] for r in rows]


# caches


def test_cache_tells_subqueries_apart(db):
    reads = []
    for turn in range(4):
        for least in (1, 3, 5):
            sub = Query(PARTS, db).select("item_id").where_gte("item_id", least)
            query = Query(ITEMS, db).where_in_subquery("id", sub).order_asc("id").cache_for(60)
            reads.append(ids(query.get()) == list(range(least, 7)))
    assert all(reads) and len(db.cache) == 3
    assert db.cache.stats()["hits"] == 9 and db.cache.stats()["misses"] == 3


def test_cache_tells_every_clause_apart(db):
    base = Query(ITEMS, db)
    queries = [base, base.limit(1), base.limit(2), base.offset(1), base.where_eq("id", 1), base.where_eq("id", "1"), base.where_ne("id", 1), base.where_raw("id = ?", 1), base.where_raw("id = ?", 2)]
    queries += [base.order_asc("id"), base.order_desc("id"), base.select("id"), base.select_raw("id + 1 AS x"), base.distinct(), base.window(W.lag("w", "n", 1).order_by("id")), base.window(W.lag("w", "n", 2).order_by("id"))]
    queries += [base.where_exists(Query(PARTS, db)), base.where_not_exists(Query(PARTS, db)), base.where_has(PARTS, "item_id", "id"), base.where_has(PARTS, "item_id", "id", lambda q: q.where_eq("id", 1)), base.has_related("parts", "item_id", "id", "id", 1), base.has_related("parts", "item_id", "id", "id", 2)]
    queries += [base.union(base.limit(1)), base.union_all(base.limit(1)), base.inner_join("parts", "items.id", "parts.item_id"), base.left_join("parts", "items.id", "parts.item_id"), base.where_any(lambda g: g.where_eq("id", 1)), base.with_trashed()]
    keys = [cache.key_of(q.cache_for(60)) for q in queries]
    assert len(set(keys)) == len(keys)
    assert keys == [cache.key_of(q.cache_for(60)) for q in queries]
    assert cache.key_of(Query(BIN, db).cache_for(1)) != cache.key_of(Query(BIN, Database(db.spark, tables=db.tables)).cache_for(1))


def test_what_has_no_content_is_not_cached(db):
    with pytest.raises(QueryError):
        Query(ITEMS, db).where_eq("id", F.lit(1)).cache_for(60).get()


@pytest.mark.parametrize(
    "build",
    [
        lambda q, db: q.where_in_subquery("id", Query(PARTS, db).select("item_id")),
        lambda q, db: q.where_has(PARTS, "item_id", "id"),
        lambda q, db: q.has_any_related("parts", "item_id", "id"),
        lambda q, db: q.where_any(lambda g: g.where_col(Exists(Query(PARTS, db)))),
        lambda q, db: q.union_all(Query(PARTS, db).select("id").select_raw("'p' AS kind").select_raw("1L AS n")),
        lambda q, db: q.union_all_raw("SELECT id, 'p', 1L FROM parts"),
        lambda q, db: q.with_query("c", Query(PARTS, db)).inner_join("c", "items.id", "c.item_id"),
        lambda q, db: q.where_raw("id IN (SELECT item_id FROM parts)"),
        lambda q, db: q.select_raw("id").select_raw("(SELECT count(*) FROM parts) AS c"),
        lambda q, db: q.inner_join("parts", "items.id", "parts.item_id"),
    ],
)
def test_cache_is_dropped_with_any_table_it_reads(db, build):
    query = build(Query(ITEMS, db), db).cache_for(60)
    before = query._cached().collect()
    assert before and len(db.cache) == 1
    Query(BIN, db).where_eq("id", 1).delete().execute()
    assert len(db.cache) == 1
    Query(PARTS, db).delete_all().execute()
    assert len(db.cache) == 0 and query._cached().collect() != before


def test_tags_and_limits_of_the_cache(db):
    one, two = Query(ITEMS, db).cache_for(60, tags=["a", "b"]), Query(BIN, db).cache_for(60, "k", ["b"])
    one.get(), two.get()
    assert db.cache.invalidate_tag("a") == 1 and len(db.cache) == 1 and db.cache.invalidate_model(BIN) == 1
    db.cache.most = 2
    for n in range(4):
        Query(ITEMS, db).limit(n + 1).cache_for(60).get()
    assert len(db.cache) == 2 and db.cache.stats()["evicted"] == 2
    db.cache.set_tagged("mine", db.table("bin"), -1, "t")
    assert db.cache.get("mine") is None


# keyset batches


def walk(query, size):
    pages, cursor = [], None
    for _ in range(50):
        page = query.cursor_paginate(size, cursor)
        pages.append(page.items)
        cursor = page.next_cursor
        if cursor is None:
            return pages
    raise AssertionError("no end")


def joined(db):
    return Query(ITEMS, db).inner_join("parts", "items.id", "parts.item_id").select("items.id", "parts.id AS part")


def test_cursors_keep_runs_of_a_join_together(db):
    pages = walk(joined(db), 4)
    assert sorted(r["part"] for p in pages for r in p) == list(range(1, 10))
    assert all(not {r["id"] for r in a} & {r["id"] for r in b} for i, a in enumerate(pages) for b in pages[i + 1 :])
    assert sorted(r["part"] for b in joined(db).chunks(3) for r in b) == list(range(1, 10))
    with pytest.raises(QueryError, match="more rows have the key"):
        list(joined(db).chunks(2))
    assert sum(map(len, joined(db).limit(5).chunks(3))) == 5


def test_cursors_follow_the_direction(db):
    query = Query(ITEMS, db).order_desc("id")
    assert [ids(b) for b in query.chunks(4)] == [[6, 5, 4, 3], [2, 1]]
    assert [ids(p) for p in walk(query, 2)] == [[6, 5], [4, 3], [2, 1], []]
    assert [ids(b) for b in query.limit(3).chunks(2)] == [[6, 5], [4]]
    pairs = Query(PAIRS, db).order_desc("a").order_desc("b")
    assert [(r["a"], r["b"]) for p in walk(pairs, 4) for r in p] == [(a, b) for a in (3, 2, 1) for b in "zyx"]
    assert [(r["a"], r["b"]) for p in walk(Query(PAIRS, db), 2) for r in p] == [(a, b) for a in (1, 2, 3) for b in "xyz"]


def test_orders_and_cursors_that_are_refused(db):
    for query in (Query(ITEMS, db).order_asc("n"), Query(PAIRS, db).order_asc("a").order_desc("b"), Query(ITEMS, db).select("n"), Query(ITEMS, db).distinct()):
        with pytest.raises(QueryError):
            list(query.chunks(2))
    for bad in ("!!", base64.urlsafe_b64encode(json.dumps({"a": 1}).encode()).decode(), base64.urlsafe_b64encode(b"[[1,2],true]").decode()):
        with pytest.raises(QueryError):
            Query(ITEMS, db).cursor_paginate(2, bad)
    with pytest.raises(QueryError):
        Query(ITEMS, db).limit(3).cursor_paginate(2)


# raw SQL


def test_raw_sql_reads_its_own_handle(spark):
    small, large = Database(spark, "/root/testdata/sf0.001"), Database(spark, "/root/testdata/sf0.01")
    count = "SELECT count(*) AS n FROM orders, customer WHERE o_custkey = c_custkey"
    n = lambda db: db.raw(count).first()["n"]
    assert (n(small), n(large), n(small)) == (small.table("orders").count(), large.table("orders").count(), small.table("orders").count())
    assert large.raw("WITH customer AS (SELECT 1 AS c) SELECT count(*) AS n FROM customer").first()["n"] == 1
    assert large.execute("SELECT * FROM nation") == 25
    names = {t.name for t in spark.catalog.listTables()}
    assert not names & {"orders", "customer", "nation"} and not any(v.startswith("brindle_") for v in small.views())
    with pytest.raises(Exception, match="(?i)not.found|cannot be found"):
        spark.sql("SELECT * FROM customer")


def test_common_tables_stay_inside_their_query(spark, db):
    Query(ITEMS, db).with_query("chosen", Query(PARTS, db)).inner_join("chosen", "items.id", "chosen.item_id").count()
    assert "chosen" not in {t.name for t in spark.catalog.listTables()}
    both = Query(ITEMS, db).with_query("p", Query(PARTS, db).where_lt("id", 4)).with_cte(Cte("q", "SELECT DISTINCT item_id AS k FROM p")).inner_join("q", "items.id", "q.k")
    assert sorted(ids(both.frame().collect())) == [1, 2]
    assert Query(ITEMS, db).where_raw("id IN (SELECT item_id FROM parts WHERE owner_type = 'bin (select')").count() == 0


def test_catalogue_of_a_handle(db):
    with db.pin_session() as pinned:
        assert pinned is db and db.sequences() == db.enum_types() == db.indexes("items") == []
    assert db.raw("SELECT count(*) AS n FROM ITEMS WHERE Items.id > 2").first()["n"] == 4
    for _ in range(230):
        db.raw("SELECT 1 FROM items")
    assert sum(t.name.startswith(f"brindle_{db.number}_") for t in db.spark.catalog.listTables()) <= 200


def test_raw_queries_are_checked(db):
    for bad in ("DELETE FROM items", "SELECT 1; SELECT 2", "VALUES (1)", "SELECT 1 RETURNING 2", "WITH x AS (SELECT 1)"):
        with pytest.raises(QueryError):
            Query(ITEMS, db).select("id").union_raw(bad).frame()
    assert Query(ITEMS, db).select("kind").union_raw("SELECT replace(kind, 'a', 'c') FROM items").frame().count() == 3
    assert Query(ITEMS, db).where_raw("replace(kind, 'a', 'x') = 'x'").count() == 3


# changes


def test_a_stamp_is_one_value(db):
    change = Query(BIN, db).where_in("id", [1, 2]).soft_delete()
    told = {r["deleted_at"] for r in change.execute_returning()}
    reads = [{r["deleted_at"] for r in Query(BIN, db).only_trashed().get()} for _ in range(2)]
    assert len(told) == 1 and reads == [told, told] and isinstance(next(iter(told)), datetime)


def test_executed_changes_stay_as_they_are(db):
    Query(ITEMS, db).update_all().where_gt("id", 0).set_trusted_raw("n", "CAST(rand() * 1e9 AS BIGINT)").execute()
    one, two = ([r["n"] for r in Query(ITEMS, db).order_asc("id").get()] for _ in range(2))
    assert one == two
    assert Query(ITEMS, db).where_gt("id", 0).update_all().set("n", 0).limit(2).execute() == 2
    assert ids(Query(ITEMS, db).where_eq("n", 0).order_asc("id").get()) == [1, 2]


def test_the_last_given_row_wins(db):
    on_conflict(db, ITEMS, "id").insert([(1, "zz", 9), (1, "aa", 1), (9, "old", 1), (9, "new", 0)]).execute()
    rows = {r["id"]: (r["kind"], r["n"]) for r in Query(ITEMS, db).get()}
    assert rows[1] == ("aa", 1) and rows[9] == ("new", 0) and len(rows) == 7
    on_conflict(db, ITEMS, "id").do_nothing().insert([(1, "no", 0), (10, "first", 1), (10, "second", 2)]).execute()
    rows = {r["id"]: r["kind"] for r in Query(ITEMS, db).get()}
    assert rows[1] == "aa" and rows[10] == "first"


def test_transactions(db):
    with pytest.raises(ZeroDivisionError), db.transaction():
        Query(ITEMS, db).where_gt("id", 3).delete().execute()
        with pytest.raises(KeyError), db.transaction():
            Query(ITEMS, db).delete_all().execute()
            raise KeyError
        assert Query(ITEMS, db).count() == 3
        raise ZeroDivisionError
    assert Query(ITEMS, db).count() == 6
    tries = []

    def work(d):
        tries.append(1)
        Query(ITEMS, d).where_eq("id", 1).delete().execute()
        if len(tries) < 3:
            raise TimeoutError
        return "done"

    assert db.atomically(work, 5, TimeoutError) == "done" and Query(ITEMS, db).count() == 5
    cached = Query(BIN, db).cache_for(60)
    with db.test_transaction():
        Query(BIN, db).where_eq("id", 1).force_delete().execute()
        assert len(cached.get()) == 2
    assert len(cached.get()) == 3


def test_terminals(db):
    q = Query(ITEMS, db)
    assert q.order_desc("n").first()["id"] == 6 and q.last()["id"] == 6 and q.order_asc("id").value("kind") == "b"
    assert q.exists() and not q.where_eq("id", 99).exists() and q.count_distinct("kind") == 2
    assert (q.sum("n"), q.avg("n"), q.min("n"), q.max("n")) == (210, 35.0, 10, 60)
    assert q.where_eq("id", 2).get_json() == [{"id": 2, "kind": "a", "n": 20}]
    assert q.order_asc("id").pluck("n") == [10, 20, 30, 40, 50, 60] and q.paginate(2, 4).map(lambda r: r["id"]).items == [5, 6]
    seen = []
    q.chunk(4, lambda rows: seen.append(len(rows)))
    assert seen == [4, 2] and q.projection_outputs() == ["id", "kind", "n"] and "items" in q.preview()
    eager = Query(PARTS, db).with_("item")
    assert eager.find(3)["item"]["id"] == 2 and eager.first_or_fail() and eager.count() == 9 and len(eager.paginate(2, 5).items) == 4


def test_owners_of_several_types(db):
    owners = MorphTo(db, PARTS.relation("owner"))
    rows = {r["id"]: r["owner"] for r in Eager(Query(PARTS, db)).with_("owner").get()}
    assert rows[1]["items"]["id"] == 1 and rows[1]["bin"] is None and rows[3]["bin"]["name"] == "y" and rows[3]["items"] is None
    assert rows[6]["items"] is None and rows[7]["items"] is None and rows[7]["bin"] is None
    with pytest.raises(QueryError, match="bin|nowhere"):
        owners.load(Query(PARTS, db).frame(), ITEMS)
    assert owners.load(Query(PARTS, db).where_in("id", [1, 6]).frame(), ITEMS).count() == 2


def test_eager_reads_only_children_of_the_owners(spark):
    base = Database(spark, "/root/testdata/sf0.001")
    few = Query(CUSTOMER, base).order_asc("c_custkey").limit(5).with_("orders.lines").frame()
    plan = few._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LeftSemi") >= 2
    rows = few.collect()
    orders = {r["o_orderkey"]: r["o_custkey"] for r in base.table("orders").collect()}
    lines = [r["l_orderkey"] for r in base.table("lineitem").collect()]
    for r in rows:
        mine = {k for k, c in orders.items() if c == r["c_custkey"]}
        assert {o["o_orderkey"] for o in r["orders"]} == mine and sum(len(o["lines"]) for o in r["orders"]) == sum(k in mine for k in lines)


# schema


def test_schema_changes_and_migrations(db):
    schema = Schema(db)
    extra = Model("extra", "id bigint, item_id bigint, note string", ("id",), relations={"item": Relation("belongs_to", lambda: ITEMS, "item_id", "id")})
    assert schema.create_table_if_not_exists(extra) and not schema.create_table_if_not_exists(extra)
    with pytest.raises(QueryError):
        schema.create_table(extra)
    schema.add_column("items", "size", "int", 3)
    schema.rename_column("items", "n", "amount")
    schema.change_column("items", "amount", "string")
    assert db.columns("items") == [("id", "bigint", True), ("kind", "string", True), ("amount", "string", True), ("size", "int", False)]
    schema.drop_column("items", "size")
    schema.rename_table("items", "things")
    assert not db.has_table("items") and db.has_table("things")
    assert schema.drop_table_if_exists("things") and not schema.drop_table_if_exists("things")
    assert foreign_keys(extra) == [("item_id", "items", "id")]
    assert schema_sql([extra, ITEMS]).index("TABLE items") < schema_sql([extra, ITEMS]).index("TABLE extra")
    assert Schema(db).sync(ITEMS, Model("bin", "id bigint, name string, deleted_at timestamp_ntz, more int", ("id",))) == ["items", "bin.more"]

    def broken(s):
        s.drop_column("bin", "name")
        raise ValueError

    steps = (Migration("1 note", lambda s: s.add_column("parts", "note", "string"), lambda s: s.drop_column("parts", "note")), Migration("2 bad", broken))
    with pytest.raises(ValueError):
        Migrator(db, steps).run()
    assert Migrator(db, steps).status() == [("1 note", True), ("2 bad", False)] and db.has_column("bin", "name") and db.has_column("parts", "note")
    assert Migrator(db, steps).rollback() == ["1 note"] and not db.has_column("parts", "note")
    with pytest.raises(RuntimeError):
        seed(db, lambda d: Query(PAIRS, d).delete_all().execute(), lambda d: (_ for _ in ()).throw(RuntimeError()))
    assert Query(PAIRS, db).count() == 9


def test_unit_of_work(db):
    work = Session(db)
    one = work.find_or_fail(ITEMS, 1)
    assert one is work.find(ITEMS, 1) and not one.is_dirty()
    one["n"] = 11
    assert one.changed() == {"n": (10, 11)} and one.is_dirty("n") and not one.is_dirty("kind")
    work.add(ITEMS, {"id": 50, "kind": "c", "n": 1})
    work.remove(work.find(ITEMS, 2))
    assert work.find(ITEMS, 2) is None and work.flush() == 3 and not one.is_dirty()
    rows = {r["id"]: r["n"] for r in Query(ITEMS, db).get()}
    assert rows == {1: 11, 3: 30, 4: 40, 5: 50, 6: 60, 50: 1}
    one["n"] = 0
    one.undo()
    assert one["n"] == 11 and work.find(ITEMS, 99) is None


def test_ranks_over_all_rows_meet_in_no_single_task(db, spark):
    rows = spark.createDataFrame([(i, "ab"[i % 2] if i % 7 else None, (i * 37) % 50 if i % 11 else None) for i in range(500)], ITEMS.schema)
    wide = Database(spark, tables={"items": rows.repartition(5)})
    query = Query(ITEMS, wide)
    for made in (W.rank("w"), W.dense_rank("w"), W.row_number("w")):
        for up in (True, False):
            spread = query.window(made.order_by("n", up).order_by("kind", not up).order_by("id"))
            plain = query.window(made.partition_by("zero").order_by("n", up).order_by("kind", not up).order_by("id"))
            one = {r["id"]: r["w"] for r in spread.select("id").frame().collect()}
            zero = Database(spark, tables={"items": rows.withColumn("zero", F.lit(0))})
            model = Model("items", "id bigint, kind string, n bigint, zero int", ("id",))
            assert one == {r["id"]: r["w"] for r in Query(model, zero, plain.clauses).select("id").frame().collect()}
    tied = query.select("id", "n").window(W.rank("r").order_by("n", True)).window(W.dense_rank("d").order_by("n", True)).window(W.row_number("k").order_by("n", True))
    got = tied.frame().collect()
    values = [None] * sum(r["n"] is None for r in got) + sorted((r["n"] for r in got if r["n"] is not None), reverse=True)
    assert sorted(r["k"] for r in got) == list(range(1, 501))
    assert all(r["r"] == values.index(r["n"]) + 1 and r["d"] == len(dict.fromkeys(values[: values.index(r["n"])])) + 1 for r in got)
    plan = tied.frame()._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan
    tied.validate()


def test_secrets(spark):
    from brindle.functions import secrets

    names = ["0", "-9223372036854775808", "plain", "", None]
    df = spark.createDataFrame([(n,) for n in names], "v string")
    for bound in ("User", "", "A" * 1000, "\u7528\u6237"):
        rows = df.withColumn("t", secrets.sealed(F.col("v"), "key", bound))
        got = rows.select("v", "t", secrets.opened(F.col("t"), "key", bound).alias("back"), secrets.opened(F.col("t"), "key", bound + "x").alias("none"), secrets.opened(F.concat(F.col("t"), F.lit("AAAA")), "key", bound).alias("bad")).collect()
        assert [r["back"] for r in got] == names and all(r["none"] is None and r["bad"] is None for r in got)
        assert all(set(r["t"]) <= set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_") for r in got if r["t"])
    for junk in ("", "!", "abc", "a" * 5000):
        assert spark.range(1).select(secrets.opened(F.lit(junk), "key")).first()[0] is None
    kept = [tuple(r) for r in df.select("v", secrets.hashed(F.col("v"), 10).alias("h")).collect()]
    checks = spark.createDataFrame([(v, h, w) for v, h in kept for w in ("plain", v)], "v string, h string, w string").select("v", "w", secrets.verified(F.col("w"), F.col("h")).alias("ok")).collect()
    assert all(r["ok"] == (None if r["v"] is None or r["w"] is None else r["v"] == r["w"]) for r in checks)
    assert spark.range(1).select(secrets.verified(F.lit("x"), F.lit("no hash"))).first()[0] is False


def test_journal_and_rules(db):
    from brindle.operators.advice import Rules
    from brindle.operators.journal import Journal

    heard = []
    db.journal = Journal(slow=0.0, most=2, sink=heard.append)
    Query(ITEMS, db).get(), Query(ITEMS, db).first(), Query(PARTS, db).with_("item").get()
    with pytest.raises(Exception):
        Query(ITEMS, db).where_raw("assert_true(id < 0) IS NULL").get()
    assert [(r.table, r.rows, r.error is None) for r in heard] == [("items", 6, True), ("items", 1, True), ("parts", 9, True), ("items", None, False)]
    assert len(db.journal.runs) == 2 and db.journal.counts["items"]["errors"] == 1 and db.journal.slow_runs()
    db.rules = Rules(max_rows=3, max_depth=1, max_relations=1)
    with pytest.raises(QueryError):
        Query(ITEMS, db).get()
    assert len(Query(ITEMS, db).limit(3).get()) == 3
    with pytest.raises(QueryError):
        Query(PARTS, db).limit(1).with_("item", "owner").get()
    with pytest.raises(QueryError):
        Query(PARTS, db).limit(1).with_("item.more").get()


# batches at size


def jobs_of(spark, work):
    """What ``work`` returns, and how many Spark jobs it ran."""
    context, group = spark.sparkContext, f"batches {next(GROUPS)}"
    context.setJobGroup(group, group)
    try:
        found = work()
        return found, len(context.statusTracker().getJobIdsForGroup(group))
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)


GROUPS = count()
NUMBERS = Model("numbers", "id bigint, n bigint", ("id",))


@pytest.fixture
def numbers(spark):
    return Database(spark, tables={"numbers": spark.range(500).selectExpr("id", "id % 7 AS n").repartition(5), "twice": spark.range(1000).selectExpr("id AS t", "id DIV 2 AS of")})


def test_batches_do_not_take_a_job_each(spark, numbers):
    for query, want in ((Query(NUMBERS, numbers), range(500)), (Query(NUMBERS, numbers).order_desc("id"), range(499, -1, -1))):
        want = [list(want[i : i + 3]) for i in range(0, 500, 3)]
        found, jobs = jobs_of(spark, lambda q=query: [ids(b) for b in q.chunks(3)])
        assert found == want and jobs < 30
        rows, jobs = jobs_of(spark, lambda q=query: q.batched(3).collect())
        assert sorted((r["batch"], r["id"]) for r in rows) == sorted((i, k) for i, b in enumerate(want) for k in b) and jobs < 30
    some = Query(NUMBERS, numbers).where_gt("n", 2).limit(100)
    assert {(r["id"], i) for i, b in enumerate(some.chunks(9)) for r in b} == {(r["id"], r["nth"]) for r in some.batched(9, "nth").collect()}


def test_batches_of_a_join_do_not_take_a_job_each(spark, numbers):
    query = Query(NUMBERS, numbers).inner_join("twice", "numbers.id", "twice.of").select("numbers.id", "twice.t")
    for size, most in ((2, 1), (5, 2), (4, 2)):
        found, jobs = jobs_of(spark, lambda s=size: list(query.chunks(s)))
        assert jobs < 40 and [r["id"] for b in found for r in b] == [i for i in range(500) for _ in "ab"] and len({r["t"] for b in found for r in b}) == 1000
        assert all(len(set(ids(b))) <= most and len(b) == 2 * len(set(ids(b))) for b in found)
    assert [len(b) for b in query.limit(9).chunks(4)] == [2, 2, 2, 3]
    with pytest.raises(QueryError, match="more rows have the key"):
        list(query.chunks(1))


def test_batches_see_changes_made_between_them(numbers):
    seen = []
    for n, batch in enumerate(Query(NUMBERS, numbers).where_lt("id", 40).chunks(5)):
        seen += ids(batch)
        if n == 2:
            Query(NUMBERS, numbers).where_between("id", 3, 25).delete().execute()
    assert seen == [*range(15), *range(26, 40)]


def test_batches_that_are_refused(db):
    for bad in (lambda: Query(ITEMS, db).batched(0), lambda: joined(db).batched(3), lambda: Query(ITEMS, db).order_asc("n").batched(3), lambda: Query(ITEMS, db).batched(3, "kind")):
        with pytest.raises(QueryError):
            bad()


@pytest.mark.parametrize("name", ["chunks", "chunks_desc"])
def test_queries_of_batches_collect_no_rows(spark, name):
    _, jobs = jobs_of(spark, lambda: catalogue.QUERIES[name](spark, "/root/testdata/sf0.01"))
    assert jobs < 12
