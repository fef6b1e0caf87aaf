"""Models of the tables that the registered queries read."""

from __future__ import annotations

from brindle.model import Model, Relation

REGION = Model("region", "r_regionkey int, r_name string", ("r_regionkey",), relations={"nations": Relation("has_many", lambda: NATION, "r_regionkey", "n_regionkey")})
NATION = Model(
    "nation",
    "n_nationkey int, n_name string, n_regionkey int",
    ("n_nationkey",),
    relations={
        "region": Relation("belongs_to", lambda: REGION, "n_regionkey", "r_regionkey"),
        "customers": Relation("has_many", lambda: CUSTOMER, "n_nationkey", "c_nationkey"),
        "suppliers": Relation("has_many", lambda: SUPPLIER, "n_nationkey", "s_nationkey"),
        "first_supplier": Relation("has_one", lambda: SUPPLIER, "n_nationkey", "s_nationkey"),
    },
)
CUSTOMER = Model(
    "customer",
    "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    ("c_custkey",),
    relations={"orders": Relation("has_many", lambda: ORDERS, "c_custkey", "o_custkey"), "nation": Relation("belongs_to", lambda: NATION, "c_nationkey", "n_nationkey")},
)
SUPPLIER = Model(
    "supplier",
    "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    ("s_suppkey",),
    relations={"parts": Relation("through", lambda: PART, "s_suppkey", "l_suppkey", pivot="lineitem", pivot_related="l_partkey")},
)
PART = Model("part", "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double", ("p_partkey",))
ORDERS = Model(
    "orders",
    "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    ("o_orderkey",),
    relations={"lines": Relation("has_many", lambda: LINEITEM, "o_orderkey", "l_orderkey"), "customer": Relation("belongs_to", lambda: CUSTOMER, "o_custkey", "c_custkey")},
    created_at="o_orderdate",
)
LINEITEM = Model(
    "lineitem",
    "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    ("l_orderkey", "l_linenumber"),
)
EVENTS = Model("events", "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string", ("event_id",), json=frozenset({"props"}), created_at="ts")
DOCUMENTS = Model("documents", "doc_id bigint, text string, lang string, source string, n_chars bigint", ("doc_id",))
CONVERSATIONS = Model("conversations", "conv_id bigint, turn bigint, role string, text string", ("conv_id", "turn"))

#: Events as a model with soft delete: a view stamps every seventh as trashed (see catalogue.VIEWS).
TRASHABLE = Model("trashable", "event_id bigint, user_id bigint, event_type string, value double, deleted_at timestamp_ntz", ("event_id",), soft_delete="deleted_at")
#: Events with nulls and an array, from the same view.
SPARSE = Model("sparse", "event_id bigint, user_id bigint, kind string, amount double, tags array<string>, doc string", ("event_id",), json=frozenset({"doc"}))
#: A self-reference over nations: each below the nation of half its number.
TREE = Model("tree", "id int, parent_id int, name string", ("id",), relations={"parent": Relation("belongs_to", lambda: TREE, "parent_id", "id"), "children": Relation("has_many", lambda: TREE, "id", "parent_id")})
#: Notes on customers and suppliers, by a discriminator.
NOTES = Model("notes", "note_id bigint, owner_type string, owner_id bigint, body string", ("note_id",))
NOTED = Model(
    "customer",
    "c_custkey bigint, c_name string",
    ("c_custkey",),
    relations={"notes": Relation("morph_many", lambda: NOTES, "c_custkey", "owner_id", morph=("owner_type", "customer")), "first_note": Relation("morph_one", lambda: NOTES, "c_custkey", "owner_id", morph=("owner_type", "customer"))},
)
#: The same notes with the way back to their owners.
OPEN_NOTES = Model(
    "notes",
    "note_id bigint, owner_type string, owner_id bigint, body string",
    ("note_id",),
    relations={"owner": Relation("morph_to", lambda: (CUSTOMER, SUPPLIER), "owner_id", morph=("owner_type", None))},
)
