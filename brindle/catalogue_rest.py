"""More registered queries: forms and shorthands of the operators that the first part of the catalogue shows once."""

from __future__ import annotations

from pyspark.sql import functions as F

from brindle.catalogue import NOTES_SQL, SPARSE_SQL, TRASHABLE_SQL, _TOKENS, plain, register
from brindle.functions import secrets
from brindle.functions import text as X
from brindle.operators.mutations import insert_all, on_conflict
from brindle.operators.relations import Eager, Links, MorphTo
from brindle.plans import windows as W
from brindle.plans.aggregates import avg, count, max_of, min_of, sum_of
from brindle.plans.clauses import Cte
from brindle.query import Query
from brindle.tables import CUSTOMER, DOCUMENTS, EVENTS, LINEITEM, NATION, NOTED, OPEN_NOTES, ORDERS, PART, REGION, SPARSE, SUPPLIER, TRASHABLE

# raw SQL


@register("SELECT o_orderkey, c_name FROM orders, customer WHERE o_custkey = c_custkey AND c_acctbal > 9500")
def raw_comma_join(db):
    return db.raw("SELECT o_orderkey, c_name FROM orders, customer WHERE o_custkey = c_custkey AND c_acctbal > ?", [9500])


@register("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'ASIA'")
def raw_named_params(db):
    return db.raw("WITH far AS (SELECT * FROM region WHERE r_name <> :name) SELECT n_name, r_name FROM nation, far WHERE n_regionkey = r_regionkey", {"name": "ASIA"})


@register("SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_size FROM part WHERE p_size BETWEEN 5 AND 9")
def raw_as_with_params(db):
    return db.raw("SELECT p_size, p_partkey, p_name FROM part WHERE p_size BETWEEN ? AND ?", [5, 9], "p_partkey string, p_size int")


@register("SELECT r_regionkey, r_name FROM region WHERE r_regionkey > 2")
def raw_models(db):
    return db.raw_models(REGION, "SELECT * FROM region WHERE r_regionkey > :least", {"least": 2})


@register("SELECT c_custkey FROM customer WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer) AND EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 150000)")
def where_raw_subqueries(db):
    return Query(CUSTOMER, db).select("c_custkey").where_raw("c_acctbal > (SELECT avg(c_acctbal) FROM customer)").where_raw("EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > ?)", 150000).frame()


@register("SELECT r_regionkey AS k, '{\"r_regionkey\":' || r_regionkey || ',\"r_name\":\"' || r_name || '\"}' AS json FROM region WHERE r_regionkey > 1")
def raw_json(db):
    return db.raw_json("SELECT * FROM region WHERE r_regionkey > ?", [1]).select(F.get_json_object("json", "$.r_regionkey").cast("int").alias("k"), "json")


# joins


@register("SELECT n.n_name, s.s_name FROM nation n LEFT JOIN supplier s ON n.n_nationkey = s.s_nationkey")
def left_join_as(db):
    return Query(NATION, db).left_join_as("supplier", "seller", "nation.n_nationkey", "seller.s_nationkey").select("nation.n_name", "seller.s_name").frame()


@register("SELECT s.s_name, n.n_name FROM supplier s RIGHT JOIN nation n ON s.s_nationkey = n.n_nationkey")
def right_join_as(db):
    return Query(SUPPLIER, db).right_join_as("nation", "home", "supplier.s_nationkey", "home.n_nationkey").select("supplier.s_name", "home.n_name").frame()


# aggregates


@register("SELECT avg(o_orderkey) AS mean, min(o_totalprice) AS low, max(o_totalprice) AS high FROM orders WHERE o_orderstatus = 'F'")
def aggregates_mean(db):
    return Query(ORDERS, db).where_eq("o_orderstatus", "F").aggregates(mean=avg("o_orderkey"), low=min_of("o_totalprice"), high=max_of("o_totalprice"))


for _name, _build, _sql in (
    ("gte", lambda: count().gte(12), "count(*) >= 12"),
    ("lt", lambda: max_of("o_totalprice").lt(90000), "max(o_totalprice) < 90000"),
    ("lte", lambda: count().lte(4), "count(*) <= 4"),
    ("eq", lambda: count().eq(7), "count(*) = 7"),
    ("ne", lambda: count().ne(7), "count(*) <> 7"),
    ("avg", lambda: avg("o_orderkey").gt(5000), "avg(o_orderkey) > 5000"),
    ("min", lambda: min_of("o_totalprice").gt(20000), "min(o_totalprice) > 20000"),
    ("sum", lambda: sum_of("o_orderkey").gte(100000), "sum(o_orderkey) >= 100000"),
):
    plain(f"having_{_name}", f"SELECT o_custkey FROM orders GROUP BY o_custkey HAVING {_sql}", (lambda h: lambda db: Query(ORDERS, db).select("o_custkey").group_by("o_custkey").having(h()).frame())(_build))


@register("SELECT CAST(count(*) AS BIGINT) AS total, CAST(ceil(count(*) / 10.0) AS BIGINT) AS pages FROM part")
def page_counts(db):
    rows = Query(PART, db).order_asc("p_partkey").limit(10)._counted().agg(F.count(F.lit(1)).alias("total"))
    return rows.select("total", F.ceil(F.col("total") / 10).cast("bigint").alias("pages"))


# windows

_OVER = "(PARTITION BY o_custkey ORDER BY o_orderkey)"
for _name, _build, _sql in (
    ("rank", lambda q: q.rank("w", "o_custkey", "o_orderkey"), f"CAST(rank() OVER {_OVER} AS INTEGER)"),
    ("dense_rank", lambda q: q.dense_rank("w", "o_custkey", "o_orderkey"), f"CAST(dense_rank() OVER {_OVER} AS INTEGER)"),
    ("lag", lambda q: q.lag("w", "o_orderkey", 1, "o_custkey", "o_orderkey"), f"lag(o_orderkey, 1) OVER {_OVER}"),
    ("lead", lambda q: q.lead("w", "o_orderkey", 2, "o_custkey", "o_orderkey"), f"lead(o_orderkey, 2) OVER {_OVER}"),
    ("running_sum", lambda q: q.running_sum("w", "o_orderkey", "o_custkey", "o_orderkey"), f"CAST(sum(o_orderkey) OVER {_OVER} AS BIGINT)"),
    ("ntile", lambda q: q.ntile("w", 4, "o_custkey", "o_orderkey"), f"CAST(ntile(4) OVER {_OVER} AS INTEGER)"),
    ("max_frame", lambda q: q.window(W.aggregate("w", "max", "o_totalprice").partition_by("o_custkey").order_by("o_orderkey").frame("rows", W.preceding(3), W.preceding(1))), "max(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)"),
    ("avg_frame", lambda q: q.window(W.aggregate("w", "avg", "o_orderkey").partition_by("o_custkey").order_by("o_orderkey").frame("rows", W.UNBOUNDED_PRECEDING, W.UNBOUNDED_FOLLOWING)), "avg(o_orderkey) OVER (PARTITION BY o_custkey)"),
):
    plain(f"window_short_{_name}", f"SELECT o_orderkey, {_sql} AS w FROM orders", (lambda b: lambda db: b(Query(ORDERS, db).select("o_orderkey")).frame())(_build))


@register("SELECT o_orderkey, CAST(row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS nth, CAST(dense_rank() OVER (ORDER BY o_orderpriority) AS INTEGER) AS band FROM orders")
def window_over_all(db):
    nth = W.row_number("nth").order_by("o_totalprice", True).order_by("o_orderkey")
    return Query(ORDERS, db).select("o_orderkey").window(nth).window(W.dense_rank("band").order_by("o_orderpriority")).frame()


# order


@register("SELECT o_orderkey FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 5")
def oldest(db):
    return Query(ORDERS, db).select("o_orderkey").oldest().order_asc("o_orderkey").limit(5).frame()


@register("SELECT c_custkey FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 4")
def latest_by(db):
    return Query(CUSTOMER, db).select("c_custkey").latest_by("c_acctbal").order_asc("c_custkey").limit(4).frame()


@register("SELECT c_custkey FROM customer ORDER BY c_acctbal, c_custkey LIMIT 4")
def oldest_by(db):
    return Query(CUSTOMER, db).select("c_custkey").oldest_by("c_acctbal").order_asc("c_custkey").limit(4).frame()


@register("SELECT c_custkey FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 4")
def order_reversed(db):
    return Query(CUSTOMER, db).select("c_custkey").order_asc("c_acctbal").order_desc("c_custkey").reverse().limit(4).frame()


@register("SELECT o_orderkey, l_linenumber FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderkey >= 300 ORDER BY o_orderkey, l_linenumber LIMIT 12")
def cursor_page_joined(db):
    page = Query(ORDERS, db).inner_join("lineitem", "orders.o_orderkey", "lineitem.l_orderkey").select("orders.o_orderkey", "lineitem.l_linenumber")
    return page._keyset([300], True).order_asc("lineitem.l_linenumber").limit(12).frame()


@register("SELECT s_suppkey, CAST(floor((row_number() OVER (ORDER BY s_suppkey DESC) - 1) / 7) AS BIGINT) AS batch FROM supplier")
def chunks_desc(db):
    return Query(SUPPLIER, db).select("s_suppkey").order_desc("s_suppkey").batched(7)


# common tables


@register("WITH urgent AS (SELECT o_custkey AS k FROM orders WHERE o_orderpriority = '1-URGENT') SELECT c_custkey, count(k) AS n FROM customer JOIN urgent ON c_custkey = k GROUP BY 1")
def common_table_raw(db):
    urgent = Cte("urgent", "SELECT o_custkey AS k FROM orders WHERE o_orderpriority = '1-URGENT'")
    return Query(CUSTOMER, db).with_cte(urgent).inner_join("urgent", "customer.c_custkey", "urgent.k").select("customer.c_custkey").select_raw("count(k) AS n").group_by("customer.c_custkey").frame()


@register("SELECT n_name, (SELECT count(*) FROM customer WHERE c_acctbal > 9000 AND c_nationkey = n_nationkey) AS rich FROM nation")
def common_table_query(db):
    rich = Query(CUSTOMER, db).where_gt("c_acctbal", 9000)
    return Query(NATION, db).with_query("rich", rich).select("n_name").select_raw("(SELECT count(*) FROM rich WHERE c_nationkey = n_nationkey) AS rich").frame()


# relations


@register("SELECT c_custkey, CAST(count(DISTINCT o_orderkey) AS BIGINT) AS orders, CAST(count(l_orderkey) AS BIGINT) AS lines FROM (SELECT * FROM customer ORDER BY c_custkey LIMIT 50) LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def eager_limit_before_join(db):
    rows = Eager(Query(CUSTOMER, db).order_asc("c_custkey").limit(50)).with_("orders.lines").frame()
    lines = F.aggregate(F.transform("orders", lambda o: F.size(o["lines"]).cast("bigint")), F.lit(0).cast("bigint"), lambda a, b: a + b)
    return rows.select("c_custkey", F.size("orders").cast("bigint").alias("orders"), lines.alias("lines"))


@register("SELECT o_orderkey, n_name FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey")
def eager_belongs_to_nested(db):
    return Eager(Query(ORDERS, db)).with_("customer.nation").frame().select("o_orderkey", F.col("customer.nation.n_name").alias("n_name"))


@register("SELECT n_nationkey, CAST((SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS BIGINT) AS customers, CAST((SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS BIGINT) AS suppliers FROM nation")
def eager_with_many(db):
    rows = Eager(Query(NATION, db)).with_many("customers", "suppliers").frame()
    return rows.select("n_nationkey", F.size("customers").cast("bigint").alias("customers"), F.size("suppliers").cast("bigint").alias("suppliers"))


@register(
    f"""SELECT note_id, CASE WHEN owner_type = 'customer' THEN c_name WHEN owner_type = 'supplier' THEN s_name END AS name
    FROM {NOTES_SQL} n LEFT JOIN customer ON c_custkey = owner_id LEFT JOIN supplier ON s_suppkey = owner_id"""
)
def eager_morph_to(db):
    rows = Eager(Query(OPEN_NOTES, db)).with_("owner").frame()
    return rows.select("note_id", F.coalesce("owner.customer.c_name", "owner.supplier.s_name").alias("name"))


@register(f"SELECT note_id, owner_type = 'supplier' AS of_supplier, CASE WHEN owner_type = 'supplier' THEN s_name END AS name FROM {NOTES_SQL} n LEFT JOIN supplier ON s_suppkey = owner_id")
def morph_to_load_as(db):
    owners = MorphTo(db, OPEN_NOTES.relation("owner"))
    rows = owners.load_as(Query(OPEN_NOTES, db).frame(), SUPPLIER)
    return rows.select("note_id", owners.is_type(SUPPLIER).alias("of_supplier"), F.col("owner.s_name").alias("name"))


@register(f"SELECT note_id, c_name FROM {NOTES_SQL} n LEFT JOIN customer ON c_custkey = owner_id WHERE owner_type = 'customer'")
def morph_to_load(db):
    rows = Query(OPEN_NOTES, db).where_eq("owner_type", "customer").frame()
    return MorphTo(db, OPEN_NOTES.relation("owner")).load(rows, CUSTOMER).select("note_id", F.col("owner.c_name").alias("c_name"))


@register("SELECT n_nationkey AS owner, s_suppkey FROM nation JOIN supplier ON s_nationkey = n_nationkey WHERE s_acctbal > 0")
def relation_load_has_one(db):
    return Links(db, NATION, "first_supplier").load(Query(NATION, db).frame(), lambda q: q.where_gt("s_acctbal", 0)).select(F.col("_owner").alias("owner"), "s_suppkey")


@register("SELECT r_regionkey, r_name FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation WHERE n_nationkey < 4)")
def relation_load_belongs_to(db):
    return Links(db, NATION, "region").load(Query(NATION, db).where_lt("n_nationkey", 4).frame()).select("r_regionkey", "r_name")


@register("SELECT DISTINCT l_suppkey AS owner, l_partkey AS p_partkey FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size > 45")
def relation_load_through(db):
    return Links(db, SUPPLIER, "parts").load(Query(SUPPLIER, db).frame(), lambda q: q.where_gt("p_size", 45)).select(F.col("_owner").alias("owner"), "p_partkey")


@register(f"SELECT note_id FROM {NOTES_SQL} n WHERE owner_type = 'customer' AND owner_id IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) AND body = '1-URGENT'")
def relation_load_morph(db):
    owners = Query(NOTED, db).where_raw("c_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)").frame()
    return Links(db, NOTED, "notes").load(owners, lambda q: q.where_eq("body", "1-URGENT")).select("note_id")


@register("SELECT s_suppkey, CAST(count(DISTINCT p_partkey) AS BIGINT) AS n FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey LEFT JOIN part ON p_partkey = l_partkey GROUP BY 1")
def relation_counts_through(db):
    return Links(db, SUPPLIER, "parts").counts(Query(SUPPLIER, db).frame())


@register(f"SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT owner_id FROM {NOTES_SQL} n WHERE owner_type = 'customer')")
def relation_exists_morph(db):
    return Links(db, NOTED, "notes").existing(Query(NOTED, db).frame()).select("c_custkey")


@register("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer)")
def relation_exists_belongs_to(db):
    return Links(db, ORDERS, "customer").existing(Query(ORDERS, db).frame()).select("o_orderkey")


# changes


@register("SELECT p_partkey, CASE WHEN p_size > 40 THEN p_size - 3 ELSE p_size END AS p_size, CASE WHEN p_size > 40 THEN upper(p_name) ELSE p_name END AS p_name, CASE WHEN p_size > 40 THEN p_brand || '/' || p_type ELSE p_brand END AS p_brand FROM part")
def change_expressions(db):
    update = Query(PART, db).where_gt("p_size", 40).update_all().decrement("p_size", 3).set_trusted_raw("p_name", "upper(p_name)").set_value("p_brand", F.concat("p_brand", F.lit("/"), "p_type"))
    return update.change().frame.select("p_partkey", "p_size", "p_name", "p_brand")


@register(f"SELECT event_id, CASE WHEN event_type = 'click' THEN 0 ELSE value END AS value FROM {TRASHABLE_SQL} t")
def change_with_trashed(db):
    return Query(TRASHABLE, db).where_eq("event_type", "click").update_all().with_trashed().set("value", 0).change().frame.select("event_id", "value")


@register(f"SELECT event_id, CASE WHEN event_type = 'click' AND deleted_at IS NULL THEN 0 ELSE value END AS value FROM {TRASHABLE_SQL} t")
def change_without_trashed(db):
    return Query(TRASHABLE, db).with_trashed().update_all().without_trashed().where_eq("event_type", "click").set("value", 0).change().frame.select("event_id", "value")


@register("SELECT CAST(count(*) AS BIGINT) AS n FROM region WHERE FALSE")
def change_delete_all(db):
    return Query(REGION, db).delete_all().frame.agg(F.count(F.lit(1)).alias("n"))


@register(f"SELECT event_id, TRUE AS trashed FROM {TRASHABLE_SQL} t")
def change_delete_all_soft(db):
    return Query(TRASHABLE, db).delete_all().frame.select("event_id", F.col("deleted_at").isNotNull().alias("trashed"))


@register("SELECT r_regionkey, r_name FROM region UNION ALL SELECT 7, 'seven' UNION ALL SELECT 8, 'eight'")
def insert_rows(db):
    return insert_all(db, REGION, [(7, "seven"), (8, "eight")]).frame


@register("SELECT c_custkey, CASE WHEN c_custkey = 1 THEN 'new' ELSE c_name END AS c_name, c_nationkey FROM customer UNION ALL SELECT -5, 'five', 3")
def upsert_some_columns(db):
    rows = [(1, "new", 24, 0.0, "X"), (-5, "five", 3, 1.0, "Y")]
    return on_conflict(db, CUSTOMER, "c_custkey").update_columns("c_name").insert(rows).frame.select("c_custkey", "c_name", "c_nationkey")


@register("SELECT c_custkey, CASE WHEN c_custkey = 1 THEN 'last' ELSE c_name END AS c_name, c_nationkey FROM customer")
def upsert_all_but_some(db):
    rows = [(1, "zz first", 24, 0.0, "X"), (1, "last", 23, 0.0, "X")]
    return on_conflict(db, CUSTOMER, "c_custkey").update_all_except("c_nationkey").insert(rows).frame.select("c_custkey", "c_name", "c_nationkey")


@register("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderkey LIMIT 5)")
def change_limited_by_key(db):
    return Query(ORDERS, db).where_eq("o_orderstatus", "P").limit(5).delete().frame.select("o_orderkey")


# search


@register(
    f"""WITH t AS (SELECT doc_id, {_TOKENS} AS w FROM documents), a AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS at FROM t)
    SELECT DISTINCT x.doc_id FROM a x JOIN a y ON x.doc_id = y.doc_id AND x.word = 'the' AND y.word = 'and' AND abs(x.at - y.at) <= 3"""
)
def search_proximity(db):
    return Query(DOCUMENTS, db).search(["text"], "the and").mode("proximity", 3).frame().select("doc_id")


@register(
    f"""SELECT doc_id, round(0.5 * (CASE WHEN lower(lang) = 'en' THEN 0.5 ELSE 0 END) + 0.25 * a / (a + 1), 9) AS rank
    FROM (SELECT doc_id, lang, CAST(len(list_filter({_TOKENS}, lambda t: t = 'en')) AS DOUBLE) AS a FROM documents) WHERE lang = 'en' OR a > 0"""
)
def search_weighted(db):
    return Query(DOCUMENTS, db).search(["lang", "text"], "en").weighted(0.5, 0.25).ranked("rank").select("doc_id", F.round("rank", 9).alias("rank"))


@register(f"SELECT doc_id FROM documents WHERE list_contains({_TOKENS}, 'and')")
def search_terms(db):
    return Query(DOCUMENTS, db).search(["text"], "a the and").terms_with(min_length=2, max_length=6, stop_words=["The"]).frame().select("doc_id")


@register("SELECT n_nationkey, CASE WHEN n_name IN ('UNITED KINGDOM', 'UNITED STATES') THEN '<i>' || substr(n_name, 1, 6) || '</i>' || substr(n_name, 7) ELSE n_name END AS marked FROM nation")
def search_highlights(db):
    return Query(NATION, db).frame().select("n_nationkey", X.snippet(F.col("n_name"), ["united"], 3, "<i>", "</i>").alias("marked"))


# rules on columns


@register("SELECT r_regionkey, replace(replace('<' || r_name || '> & ''x''', '&', '&amp;'), '<', '&lt;') AS raw FROM region WHERE FALSE UNION ALL SELECT r_regionkey, '&lt;' || r_name || '&gt; &amp; &#39;x&#39;' FROM region")
def escaped(db):
    return Query(REGION, db).frame().select("r_regionkey", X.escape_html(F.concat(F.lit("<"), "r_name", F.lit("> & 'x'"))).alias("raw"))


@register("SELECT event_id, epoch_us(ts) // 1000000 AS seconds, epoch_us(ts) // 1000 AS millis, epoch_us(ts) // 1000000 AS down FROM events")
def unix_times(db):
    millis = X.unix_millis(F.col("ts"))
    return Query(EVENTS, db).frame().select("event_id", X.unix_seconds(F.col("ts")).alias("seconds"), millis.alias("millis"), X.seconds_of_millis(millis).alias("down"))


@register(
    """SELECT p_partkey, CASE WHEN p_size > 30 AND NOT regexp_matches(p_brand, '2') THEN 'p_brand,p_size' WHEN p_size > 30 THEN 'p_size' WHEN NOT regexp_matches(p_brand, '2') THEN 'p_brand' ELSE '' END AS broken,
    CASE WHEN p_size > 30 THEN 'The p_size must not exceed 30' END AS said FROM part"""
)
def validation_errors(db):
    errors = X.Checks().field("p_size").rule("required").rule("max", 30).field("p_brand").rule("regex", "2").errors()
    rows = Query(PART, db).frame().select("p_partkey", errors.alias("e"))
    return rows.select("p_partkey", F.array_join(F.array_sort(F.map_keys("e")), ",").alias("broken"), F.try_element_at(F.col("e"), F.lit("p_size"))[0].alias("said"))


@register("SELECT r_regionkey, CASE WHEN r_regionkey % 2 = 0 THEN 2 ELSE 1 END AS n, r_regionkey % 2 = 0 AS german, 'en' || r_name AS shown FROM region")
def translations_of_fields(db):
    name, even = F.col("r_name"), F.col("r_regionkey") % 2 == 0
    doc = F.concat(F.lit('{"r_name": {"en": "en'), name, F.when(even, F.concat(F.lit('", "de": "de'), name)).otherwise(F.lit("")), F.lit('"}}'))
    rows = Query(REGION, db).frame().withColumn("doc", doc)
    shown = X.render_translations(rows.withColumn("n", F.size(X.all_translations(F.col("doc"), "r_name"))).withColumn("german", X.has_translation(F.col("doc"), "r_name", "de")), "doc", ["r_name"], "xx", "en")
    return shown.select("r_regionkey", "n", "german", F.col("r_name").alias("shown"))


@register("SELECT c_custkey, c_custkey AS back, CAST(NULL AS BIGINT) AS other FROM customer")
def tokens_of_records(db):
    made = secrets.token(F.col("c_custkey"), CUSTOMER, "a secret")
    rows = Query(CUSTOMER, db).select("c_custkey").frame().withColumn("token", made)
    return rows.select("c_custkey", secrets.id_of(F.col("token"), CUSTOMER, "a secret").alias("back"), secrets.id_of(F.col("token"), ORDERS, "a secret").alias("other"))


@register("SELECT n_nationkey, n_name AS plain, TRUE AS hidden, TRUE AS lost FROM nation")
def sealed_columns(db):
    rows = Query(NATION, db).frame().withColumn("s", secrets.sealed(F.col("n_name"), "k"))
    return rows.select("n_nationkey", secrets.opened(F.col("s"), "k").alias("plain"), (~F.col("s").contains(F.col("n_name"))).alias("hidden"), secrets.opened(F.col("s"), "other").isNull().alias("lost"))


@register("SELECT r_regionkey, '{\"r_regionkey\":' || r_regionkey || ',\"r_name\":\"' || r_name || '\"}' AS json FROM region")
def rows_as_json(db):
    return Query(REGION, db).json_rows().select(F.get_json_object("json", "$.r_regionkey").cast("int").alias("r_regionkey"), "json")


@register(f"SELECT event_id, amount FROM {SPARSE_SQL} s WHERE kind = 'click'")
def cached_read(db):
    return Query(SPARSE, db).select("event_id", "amount").where_eq("kind", "click").cache_for(60)._cached()


@register("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 45 AND l_returnflag = 'R'")
def transaction_taken_back(db):
    with db.test_transaction():
        Query(LINEITEM, db).where_gt("l_quantity", 10).delete().execute()
    return Query(LINEITEM, db).select("l_orderkey", "l_linenumber").where_gt("l_quantity", 45).where_eq("l_returnflag", "R").frame()

