"""Queries over the driver's tables, one for each operator or option, and the same in DuckDB SQL."""

from __future__ import annotations

import warnings
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .container import Container
from .operators.context import EntityContext
from .operators.cycles import denormalize_objects, expand, normalize_objects
from .operators.denormalize import denormalize
from .operators.normalize import normalize
from .operators.stats import dedup_stats
from .plans.catalog import PropertyMode, TypeCatalog, many, ref, simple
from .plans.config import GraphConfig
from .shipping import ship
from .sources.shared import shared_path
from .sources.store import read_container, write_container

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{d}/{name}.parquet")


def _e(entity: str, **more) -> dict:
    return {"entity": entity, **more}


def _config(df: DataFrame, root: str, options=None) -> GraphConfig:
    config = GraphConfig(TypeCatalog.from_schema(root, df.schema))
    config.normalize_graph(root, options)
    return config


def _as(x: Column, name: str, **metadata) -> Column:
    return x.alias(name, metadata=metadata)


_LINE_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag", "l_shipdate")


def order_lines(spark: SparkSession, d: str, *fields: str, **metadata) -> DataFrame:
    """Orders as roots: o_orderkey and lines, an array of part structs (of the fields) in line order."""
    lines = _t(spark, d, "lineitem").join(_t(spark, d, "part"), F.col("p_partkey") == F.col("l_partkey"))
    each = F.struct(*_LINE_ORDER, F.struct(*fields).alias("part"))
    grouped = lines.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(each)), lambda x: x["part"]).alias("lines"))
    joined = _t(spark, d, "orders").select("o_orderkey").join(grouped, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return joined.select("o_orderkey", _as(F.col("lines"), "lines", **_e("Part", **metadata)))


_OCC = """occ as (select l_orderkey as root_id, {cols}, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_returnflag, l_shipdate) - 1 as pos
  from lineitem join part on p_partkey = l_partkey where l_orderkey in (select o_orderkey from orders))"""
_PARTS = f"""with {_OCC.format(cols="p_brand, p_size")},
g as (select root_id, p_brand, p_size, min(pos) as first_pos from occ group by all),
e as (select *, row_number() over (partition by root_id order by first_pos) - 1 as idx from g)"""
_BRANDS = f"""with {_OCC.format(cols="p_brand")}, g as (select root_id, p_brand, min(pos) as first_pos from occ group by all)
select root_id, row_number() over (partition by root_id order by first_pos) - 1 as idx, p_brand from g"""


def _listed(c: Container, name: str, *columns: str) -> DataFrame:
    return c[name].select("root_id", F.col("idx").cast("long").alias("idx"), *columns)


@query("select r_regionkey as root_id, 0::bigint as idx, r_name from region")
def simple_entity_list(spark, d):
    df = _t(spark, d, "region")
    return _listed(normalize(df, _config(df, "Region"), "r_regionkey"), "RegionList", "r_name")


def _nation_region(spark, d, required: bool = True) -> DataFrame:
    n, r = _t(spark, d, "nation"), _t(spark, d, "region")
    return n.join(r, n.n_regionkey == r.r_regionkey).select("n_nationkey", "n_name", _as(F.struct("r_regionkey", "r_name"), "region", **_e("Region", required=required)))


@query("select n_nationkey as root_id, 0::bigint as idx, n_name, 0::bigint as region_index from nation")
def ref_to_index(spark, d):
    df = _nation_region(spark, d)
    return _listed(normalize(df, _config(df, "Nation"), "n_nationkey"), "NationList", "n_name", F.col("regionIndex").cast("long").alias("region_index"))


@query("""with r as (select n_regionkey, row_number() over (order by min(n_nationkey)) - 1 as i from nation group by n_regionkey)
select row_number() over (order by n_nationkey) - 1 as idx, n_name, i as region_index from nation join r using (n_regionkey)""")
def global_ref_index(spark, d):
    df = _nation_region(spark, d)
    c = normalize(df, _config(df, "Nation"), "n_nationkey", scope="global")
    return c["NationList"].select(F.col("idx").cast("long").alias("idx"), "n_name", F.col("regionIndex").cast("long").alias("region_index"))


def _customer_nation(spark, d, nullable: bool) -> DataFrame:
    c, n = _t(spark, d, "customer"), _t(spark, d, "nation")
    nation = F.struct("n_nationkey", "n_name")
    nation = F.when(F.col("c_custkey") % 3 != 0, nation) if nullable else nation
    return c.join(n, c.c_nationkey == n.n_nationkey).select("c_custkey", "c_name", _as(nation, "nation", **_e("Nation")))


@query("select c_custkey as root_id, c_name, case when c_custkey % 3 <> 0 then 0::bigint end as nation_index from customer")
def nullable_ref_index(spark, d):
    df = _customer_nation(spark, d, True)
    return normalize(df, _config(df, "Customer"), "c_custkey")["CustomerList"].select("root_id", "c_name", F.col("nationIndex").cast("long").alias("nation_index"))


@query(f"{_PARTS} select occ.root_id, pos, idx from occ join e using (root_id, p_brand, p_size)")
def collection_indices(spark, d):
    df = order_lines(spark, d, "p_brand", "p_size")
    c = normalize(df, _config(df, "Order"), "o_orderkey")
    return c["OrderList"].select("root_id", F.posexplode("linesIndices").alias("pos", "idx")).select("root_id", F.col("pos").cast("long").alias("pos"), F.col("idx").cast("long").alias("idx"))


def _part_list(spark, d, strategy: str) -> DataFrame:
    df = order_lines(spark, d, "p_brand", "p_size")
    return _listed(normalize(df, _config(df, "Order"), "o_orderkey", strategy=strategy), "PartList", "p_brand", "p_size")


@query(f"{_PARTS} select root_id, idx, p_brand, p_size from e")
def part_list_per_order(spark, d):
    """Flagship: the distinct parts of each order in order of first appearance."""
    return _part_list(spark, d, "row")


@query(ORACLE_SQL["part_list_per_order"])
def part_list_by_groups(spark, d):
    return _part_list(spark, d, "shuffle")


@query(ORACLE_SQL["part_list_per_order"])
def part_list_auto(spark, d):
    df = order_lines(spark, d, "p_brand", "p_size")
    return _listed(normalize(df, _config(df, "Order"), "o_orderkey", strategy="auto", row_limit=4), "PartList", "p_brand", "p_size")


@query("""with n as (select n_nationkey, n_name from nation),
occ as (select o_orderkey as root_id, -1 as pos, n_nationkey, n_name from orders join customer on c_custkey = o_custkey join n on n_nationkey = c_nationkey
  union all select l_orderkey, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_returnflag, l_shipdate), n_nationkey, n_name
  from lineitem join supplier on s_suppkey = l_suppkey join n on n_nationkey = s_nationkey where l_orderkey in (select o_orderkey from orders)),
g as (select root_id, n_nationkey, n_name, min(pos) as p from occ group by all)
select root_id, row_number() over (partition by root_id order by p) - 1 as idx, n_name from g""")
def two_paths_one_list(spark, d):
    n = F.struct("n_nationkey", "n_name")
    cust = _t(spark, d, "customer").join(_t(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", _as(F.struct("c_custkey", n.alias("home")), "customer"))
    sup = _t(spark, d, "supplier").join(_t(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", n.alias("base"))
    lines = _t(spark, d, "lineitem").join(sup, F.col("s_suppkey") == F.col("l_suppkey"))
    each = F.struct(*_LINE_ORDER, F.struct("s_suppkey", "base").alias("s"))
    grouped = lines.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(each)), lambda x: x["s"]).alias("suppliers"))
    df = _t(spark, d, "orders").join(cust, F.col("o_custkey") == F.col("c_custkey")).join(grouped, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", "customer", "suppliers")
    types = TypeCatalog({
        "Nation": [simple("n_nationkey", "int"), simple("n_name", "string")],
        "Customer": [simple("c_custkey", "bigint"), ref("home", "Nation")],
        "Supplier": [simple("s_suppkey", "bigint"), ref("base", "Nation")],
        "Order": [simple("o_orderkey", "bigint"), ref("customer", "Customer"), many("suppliers", "Supplier")],
    })
    config = GraphConfig(types)
    config.normalize_graph("Order")
    return _listed(normalize(df, config, "o_orderkey"), "NationList", "n_name")


@query("select o_orderkey as root_id, 0::bigint as n from orders where o_orderkey not in (select l_orderkey from lineitem join part on p_partkey = l_partkey)")
def empty_collection(spark, d):
    df = order_lines(spark, d, "p_brand")
    found = normalize(df, _config(df, "Order"), "o_orderkey")["OrderList"].select("root_id", F.size("linesIndices").cast("long").alias("n"))
    return found.where("n = 0")


@query(f"""with {_OCC.format(cols="l_returnflag")}, g as (select root_id, l_returnflag, min(pos) as p from occ group by all),
e as (select *, row_number() over (partition by root_id order by p) - 1 as idx from g) select occ.root_id, pos, idx from occ join e using (root_id, l_returnflag)""")
def ordered_duplicates(spark, d):
    df = order_lines(spark, d, "l_returnflag")
    c = normalize(df, _config(df, "Order"), "o_orderkey")
    return c["OrderList"].select("root_id", F.posexplode("linesIndices").alias("pos", "idx")).select("root_id", F.col("pos").cast("long").alias("pos"), F.col("idx").cast("long").alias("idx"))


def _brands(spark, d, options=None, fields=("p_brand", "p_size", "p_name")) -> DataFrame:
    df = order_lines(spark, d, *fields)
    config = _config(df, "Order")
    if options:
        options(config)
    return _listed(normalize(df, config, "o_orderkey"), "PartList", "p_brand")


@query(_BRANDS)
def ignore_property(spark, d):
    return _brands(spark, d, lambda c: c.for_type("Part").ignore("p_size", "p_name"))


@query(_BRANDS)
def explicit_only(spark, d):
    return _brands(spark, d, lambda c: c.for_type("Part", lambda t: t.use_property_mode(PropertyMode.EXPLICIT_ONLY).include("p_brand")))


def _marked(spark, d, marks: dict[str, str]) -> DataFrame:
    """Order lines whose part fields carry metadata "normalize"; nested fields keep it in the schema."""
    from pyspark.sql import types as T

    df = order_lines(spark, d, "p_brand", "p_size", "p_name")
    part = df.schema["lines"].dataType.elementType
    tagged = T.StructType([T.StructField(f.name, f.dataType, True, {"normalize": marks[f.name]} if f.name in marks else {}) for f in part])
    schema = T.StructType([df.schema["o_orderkey"], T.StructField("lines", T.ArrayType(tagged), True, _e("Part"))])
    config = GraphConfig(TypeCatalog.from_schema("Order", schema))
    config.normalize_graph("Order")
    if "include" in marks.values():
        config.for_type("Part").use_property_mode(PropertyMode.EXPLICIT_ONLY)
    return _listed(normalize(df, config, "o_orderkey"), "PartList", "p_brand")


@query(_BRANDS)
def metadata_ignore(spark, d):
    return _marked(spark, d, {"p_size": "ignore", "p_name": "ignore"})


@query(_BRANDS)
def metadata_include(spark, d):
    return _marked(spark, d, {"p_brand": "include"})


def _customers(spark, d, options) -> DataFrame:
    df = _customer_nation(spark, d, False)
    config = _config(df, "Customer")
    options(config)
    c = normalize(df, config, "c_custkey")
    column = "nation.n_name" if c.names == ["CustomerList"] else "nationIndex"
    return c["CustomerList"].select("root_id", "c_name", (F.col(column).cast("string")).alias("nation"), F.lit(",".join(c.names)).alias("lists"))


_INLINED = "select c_custkey as root_id, c_name, n_name as nation, 'CustomerList' as lists from customer join nation on n_nationkey = c_nationkey"


@query(_INLINED)
def inline_type(spark, d):
    return _customers(spark, d, lambda c: c.normalize_graph("Customer").inline("Nation"))


@query(_INLINED)
def inline_property(spark, d):
    return _customers(spark, d, lambda c: c.for_type("Customer").inline("nation"))


_EXTRACTED = "select c_custkey as root_id, c_name, '0' as nation, 'NationList,CustomerList' as lists from customer"


@query(_EXTRACTED)
def normalize_property(spark, d):
    return _customers(spark, d, lambda c: (c.normalize_graph("Customer").inline("Nation"), c.for_type("Customer").normalize("nation")))


@query(_INLINED)
def undiscovered_type(spark, d):
    return _customers(spark, d, lambda c: c.normalize_graph("Customer").auto_discover(False))


@query(_EXTRACTED)
def explicit_discovery(spark, d):
    return _customers(spark, d, lambda c: (c.normalize_graph("Customer").auto_discover(False), c.for_type("Nation")))


@query("values ('Customer', 'NationList,CustomerList'), ('Nation', 'NationList')".replace("values", "select * from (values").replace("List')", "List')") + ") as t(root, lists)")
def multi_root_reachability(spark, d):
    df = _customer_nation(spark, d, False)
    config = _config(df, "Customer")
    config.normalize_graph("Nation")
    return spark.createDataFrame([(r, ",".join(config.compile(r).lists.values())) for r in config.roots], "root string, lists string")


def deep_rows(spark: SparkSession, d: str) -> DataFrame:
    """Line items of orders as seven types: Order, Customer, Nation, Region, Line, Part, Brand."""
    nation = _t(spark, d, "nation").join(_t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.struct("n_name", _as(F.struct("r_name"), "region")).alias("nation"))
    cust = _t(spark, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.struct("c_name", "nation").alias("customer"))
    part = F.struct("p_size", F.struct("p_brand").alias("brand")).alias("part")
    lines = _t(spark, d, "lineitem").join(_t(spark, d, "part"), F.col("p_partkey") == F.col("l_partkey"))
    each = F.struct(*_LINE_ORDER, F.struct(F.col("l_linenumber").alias("n"), part).alias("x"))
    grouped = lines.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(each)), lambda y: y["x"]).alias("lines"))
    return _t(spark, d, "orders").join(cust, F.col("o_custkey") == F.col("c_custkey")).join(grouped, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", "customer", _as(F.col("lines"), "lines", **_e("Line")))


@query("""with l as (select l_orderkey as k, l_linenumber as n, p_size, p_brand from lineitem join part on p_partkey = l_partkey where l_orderkey in (select o_orderkey from orders)),
o as (select o_orderkey as k from orders join customer on c_custkey = o_custkey)
select k as root_id, 'OrderList' as list, 1::bigint as n from o union all select k, 'CustomerList', 1 from o union all select k, 'NationList', 1 from o union all select k, 'RegionList', 1 from o
union all select k, 'LineList', count(*) from (select distinct k, n, p_size, p_brand from l) group by k
union all select k, 'PartList', count(*) from (select distinct k, p_size, p_brand from l) group by k
union all select k, 'BrandList', count(distinct p_brand) from l group by k""")
def deep_nesting_7(spark, d):
    df = deep_rows(spark, d)
    rows = normalize(df, _config(df, "Order"), "o_orderkey").rows
    lists = ["OrderList", "CustomerList", "NationList", "RegionList", "LineList", "PartList", "BrandList"]
    sizes = F.explode(F.array(*(F.struct(F.lit(x).alias("list"), F.size(x).cast("long").alias("n")) for x in lists))).alias("x")
    return rows.select("root_id", sizes).select("root_id", "x.list", "x.n").where("n > 0")


def _lines_again(df: DataFrame, scope: str = "root") -> DataFrame:
    back = denormalize(normalize(df, _config(df, "Order"), "o_orderkey", scope=scope))
    each = back.select("root_id", F.posexplode("lines").alias("pos", "x"))
    return each.select("root_id", F.col("pos").cast("long").alias("pos"), "x.*")


@query(f"with {_OCC.format(cols='p_brand, p_size')} select root_id, pos, p_brand, p_size from occ")
def denormalize_roundtrip(spark, d):
    return _lines_again(order_lines(spark, d, "p_brand", "p_size"))


@query(ORACLE_SQL["denormalize_roundtrip"])
def denormalize_global(spark, d):
    return _lines_again(order_lines(spark, d, "p_brand", "p_size"), "global")


@query(f"""with {_OCC.format(cols="l_returnflag")}, g as (select root_id, l_returnflag, min(pos) as p from occ group by all)
select root_id, row_number() over (partition by root_id order by p) - 1 as pos, l_returnflag from g""")
def denormalize_set(spark, d):
    return _lines_again(order_lines(spark, d, "l_returnflag", collection="set"))


@query("select c_custkey as root_id, c_name, case when c_custkey % 3 <> 0 then n_name end as n_name from customer join nation on n_nationkey = c_nationkey")
def denormalize_nullable(spark, d):
    df = _customer_nation(spark, d, True)
    return denormalize(normalize(df, _config(df, "Customer"), "c_custkey")).select("root_id", "c_name", "nation.n_name")


@query("select n_name, count(*) as customers from customer join nation on n_nationkey = c_nationkey group by n_name")
def shared_entry_fan_in(spark, d):
    df = _customer_nation(spark, d, False)
    c = normalize(df, _config(df, "Customer"), "c_custkey", scope="global")
    fan = c["CustomerList"].groupBy("nationIndex").agg(F.count("*").alias("customers"))
    return fan.join(c["NationList"], F.col("nationIndex") == F.col("idx")).select("n_name", "customers")


@query(f"with {_OCC.format(cols='p_brand, p_size')}, g as (select p_brand, p_size, min((root_id, pos)) as f from occ group by all) select row_number() over (order by f) - 1 as idx, p_brand, p_size from g")
def global_scope_list(spark, d):
    df = order_lines(spark, d, "p_brand", "p_size")
    return normalize(df, _config(df, "Order"), "o_orderkey", scope="global")["PartList"].select(F.col("idx").cast("long").alias("idx"), "p_brand", "p_size")


@query(f"""{_PARTS}, o as (select count(*) as n from orders) select 'OrderList' as list, n as occurrences, n as entries from o
union all select 'PartList', (select count(*) from occ), (select count(*) from e)""")
def dedup_statistics(spark, d):
    df = order_lines(spark, d, "p_brand", "p_size")
    return dedup_stats(normalize(df, _config(df, "Order"), "o_orderkey"))


def _turns(spark, d, tracking: bool = False, cycle_key: str = "exclude") -> Container:
    """Conversations as chains: each turn's parent is the one before it, its children the one after it."""
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    turns = _t(spark, d, "conversations").withColumn("oid", F.row_number().over(w).cast("long"))
    last = F.max("oid").over(Window.partitionBy("conv_id"))
    turns = turns.select(F.col("conv_id").alias("root_id"), "oid", "role", "text", F.when(F.col("oid") > 1, F.col("oid") - 1).alias("parent"), F.when(F.col("oid") < last, F.array(F.col("oid") + 1)).otherwise(F.expr("cast(array() as array<bigint>)")).alias("children"))
    config = GraphConfig(TypeCatalog({"Turn": [simple("role", "string"), simple("text", "string"), ref("parent", "Turn"), many("children", "Turn")]}))
    graph = config.normalize_graph("Turn")
    if tracking:
        graph.use_reference_tracking_for_cycles()
    return _quiet(lambda: normalize_objects({"Turn": turns}, turns.where("oid = 1").select("root_id", "oid"), config, cycle_key=cycle_key))


def _quiet(f):
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        return f()


# a turn equal to an earlier one of its conversation is that one, and what follows it is not reached
_TURNS = """with t as (select conv_id, role, text, row_number() over (partition by conv_id order by turn, role, text) as oid from conversations),
u as (select *, row_number() over (partition by conv_id, role, text order by oid) as again from t),
f as (select conv_id, coalesce(min(oid) filter (again > 1), 1000000000) as stop, max(oid) as last from u group by conv_id)
select conv_id as root_id, oid - 1 as idx, role, md5(text) as text_md5, case when oid > 1 then oid - 2 end as parent,
  case when oid + 1 < stop and oid < last then oid when oid < last then (select min(v.oid) - 1 from u v, u n where n.conv_id = u.conv_id and n.oid = u.oid + 1 and v.conv_id = n.conv_id and v.role = n.role and v.text = n.text) end as child
from u join f using (conv_id) where oid < stop"""


def _flat_turns(c: Container) -> DataFrame:
    return c["TurnList"].select("root_id", F.col("idx").cast("long").alias("idx"), "role", F.md5("text").alias("text_md5"), F.col("parentIndex").cast("long").alias("parent"), F.get("childrenIndices", F.lit(0)).cast("long").alias("child"))


@query(_TURNS)
def tree_self_cycle(spark, d):
    return _flat_turns(_turns(spark, d))


def _event_ring(spark, d, tracking: bool) -> DataFrame:
    """Events of each user in a ring; the value of every third one (but not of the last) is NaN, which equals nothing."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("event_id")
    last = F.max("oid").over(Window.partitionBy("user_id"))
    events = _t(spark, d, "events").withColumn("oid", F.row_number().over(w).cast("long"))
    value = F.when((F.col("event_id") % 3 == 0) & (F.col("oid") < last), F.lit(float("nan"))).otherwise(F.col("value"))
    events = events.select(F.col("user_id").alias("root_id"), "oid", "event_id", value.alias("value"), F.when(F.col("oid") < last, F.col("oid") + 1).otherwise(1).alias("next"))
    config = GraphConfig(TypeCatalog({"Event": [simple("event_id", "bigint"), simple("value", "double"), ref("next", "Event")]}))
    graph = config.normalize_graph("Event")
    if tracking:
        graph.use_reference_tracking_for_cycles()
    c = _quiet(lambda: normalize_objects({"Event": events}, events.where("oid = 1").select("root_id", "oid"), config, nan_distinct=True))
    return c["EventList"].select("root_id", F.col("idx").cast("long").alias("idx"), "event_id", F.isnan("value").alias("is_nan"), F.col("nextIndex").cast("long").alias("next"))


_EVENTS = """with e as (select user_id as root_id, event_id, row_number() over (partition by user_id order by event_id) - 1 as idx, count(*) over (partition by user_id) as k from events),
n as (select *, event_id % 3 = 0 and idx < k - 1 as is_nan from e),
r as (select root_id, min(idx) filter (not is_nan) as lead from n group by root_id)"""


@query(f"{_EVENTS} select root_id, idx, event_id, is_nan, (idx + 1) % k as next from n")
def reference_tracking(spark, d):
    """The first event, met again at the end of the ring, is recognised by its identity although its value is NaN."""
    return _event_ring(spark, d, True)


@query(f"""{_EVENTS} select root_id, idx, event_id, is_nan, case when idx < k - 1 then idx + 1 when lead > 0 then k else 0 end as next from n join r using (root_id)
union all select root_id, k + idx, event_id, is_nan, case when idx + 1 < lead then k + idx + 1 else lead end from n join r using (root_id) where idx < lead""")
def nan_without_tracking(spark, d):
    """Events with NaN at the head of the ring are entered again at its end."""
    return _event_ring(spark, d, False)


@query(f"""with {_OCC.format(cols="p_brand, p_size")}, k as (select root_id, pos, p_brand, p_size, case when p_size % 5 = 0 then pos end as nan_pos from occ),
g as (select root_id, p_brand, p_size, nan_pos, min(pos) as first_pos from (select root_id, pos, p_brand, case when nan_pos is null then p_size end as p_size, nan_pos from k) group by all)
select root_id, row_number() over (partition by root_id order by first_pos) - 1 as idx, p_brand, p_size::double as p_size from g""")
def nan_distinct(spark, d):
    """Parts of orders by brand and size, a size that 5 divides being NaN: such a part equals no other."""
    df = order_lines(spark, d, "p_brand", F.when(F.col("p_size") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("p_size").cast("double")).alias("p_size"))
    c = normalize(df, _config(df, "Order"), "o_orderkey", nan_distinct=True)
    return _listed(c, "PartList", "p_brand", F.when(~F.isnan("p_size"), F.col("p_size")).alias("p_size"))


@query("""with t as (select conv_id, role, text, row_number() over (partition by conv_id order by turn, role, text) as oid, count(*) over (partition by conv_id) as last from conversations)
select conv_id as root_id, oid - 1 as idx, role, md5(text) as text_md5, case when oid > 1 then oid - 2 end as parent, case when oid < last then oid end as child from t""")
def cycle_by_identity(spark, d):
    return _flat_turns(_turns(spark, d, cycle_key="oid"))


@query("""with t as (select conv_id, role, text, row_number() over (partition by conv_id order by turn, role, text) as oid, count(*) over (partition by conv_id) as last from conversations)
select conv_id as root_id, oid, role, case when oid > 1 then oid - 1 end as parent, case when oid < last then oid + 1 end as child from t""")
def denormalize_cycle(spark, d):
    turns = denormalize_objects(_turns(spark, d, cycle_key="oid"))["Turn"]
    return turns.select("root_id", (F.col("oid") + 1).alias("oid"), "role", (F.col("parent") + 1).alias("parent"), (F.get("children", F.lit(0)) + 1).alias("child"))


def _numbered(df: DataFrame, by: str) -> DataFrame:
    """root_id, oid (from 1 in order of ``by``) and the other columns."""
    from pyspark.sql import Window

    return df.withColumn("oid", F.row_number().over(Window.partitionBy("root_id").orderBy(by)).cast("long"))


def _all(df: DataFrame) -> DataFrame:
    """The oids of each root's objects, in order."""
    return df.groupBy("root_id").agg(F.array_sort(F.collect_list("oid")).alias("many"))


def _nation_cycle(tables: dict[str, DataFrame], types: dict) -> DataFrame:
    """root_id, list, idx, name, next: index of the reference, or indices of the collection, joined by commas."""
    config = GraphConfig(TypeCatalog(types))
    config.normalize_graph("Nation")
    c = _quiet(lambda: normalize_objects(tables, tables["Nation"].select("root_id", "oid"), config))

    def told(x: str) -> DataFrame:
        link = next(f for f in types[x.removesuffix("List")] if f.target)
        shown = F.array_join(F.col(f"{link.name}Indices").cast("array<string>"), ",") if link.many else F.col(f"{link.name}Index").cast("string")
        return c[x].select("root_id", F.lit(x).alias("list"), F.col("idx").cast("long").alias("idx"), "name", shown.alias("next"))

    return reduce(DataFrame.union, [told(x) for x in c])


def _nations(spark, d, customers: DataFrame) -> DataFrame:
    n = _t(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("root_id"), F.lit(1).cast("long").alias("oid"), F.col("n_name").alias("name"))
    return n.join(_all(customers), "root_id", "left").withColumnRenamed("many", "customers")


def _members(spark, d) -> DataFrame:
    """Customers of each nation: root_id, oid, c_custkey, name, c_mktsegment."""
    found = _t(spark, d, "customer").select(F.col("c_nationkey").cast("long").alias("root_id"), "c_custkey", F.col("c_name").alias("name"), "c_mktsegment")
    return _numbered(found.join(_t(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("root_id")), "root_id", "left_semi"), "c_custkey")


_NATION_CUSTOMERS = """c as (select n_nationkey::bigint as root_id, c_custkey, c_name, c_mktsegment, row_number() over (partition by n_nationkey order by c_custkey) - 1 as idx from customer join nation on n_nationkey = c_nationkey)"""
_NATION_LIST = """select n_nationkey::bigint as root_id, 'NationList' as list, 0::bigint as idx, n_name as name, coalesce((select string_agg(idx::varchar, ',' order by idx) from c where c.root_id = n_nationkey), '') as next from nation"""


@query(f"with {_NATION_CUSTOMERS} {_NATION_LIST} union all select root_id, 'CustomerList', idx, c_name, '0' from c")
def mutual_cycle(spark, d):
    """A nation has customers, told apart by their keys, and each customer has its nation."""
    customers = _members(spark, d).withColumn("nation", F.lit(1).cast("long"))
    types = {"Nation": [simple("name", "string"), many("customers", "Customer")], "Customer": [simple("c_custkey", "bigint"), simple("name", "string"), ref("nation", "Nation")]}
    return _nation_cycle({"Nation": _nations(spark, d, customers), "Customer": customers}, types)


@query(f"""with {_NATION_CUSTOMERS}, s as (select root_id, c_mktsegment, row_number() over (partition by root_id order by min(idx)) - 1 as idx from c group by root_id, c_mktsegment)
{_NATION_LIST} union all select root_id, 'CustomerList', c.idx, c_name, s.idx::varchar from c join s using (root_id, c_mktsegment) union all select root_id, 'SegmentList', idx, c_mktsegment, '0' from s""")
def triangle_cycle(spark, d):
    """A nation has customers, these have segments, of which many customers share one, and a segment has its nation."""
    customers = _members(spark, d)
    segments = _numbered(customers.select("root_id", F.col("c_mktsegment").alias("name")).distinct(), "name").withColumn("nation", F.lit(1).cast("long"))
    customers = customers.join(segments.select("root_id", F.col("name").alias("c_mktsegment"), F.col("oid").alias("segment")), ["root_id", "c_mktsegment"])
    types = {"Nation": [simple("name", "string"), many("customers", "Customer")], "Customer": [simple("name", "string"), ref("segment", "Segment")], "Segment": [simple("name", "string"), ref("nation", "Nation")]}
    return _nation_cycle({"Nation": _nations(spark, d, customers), "Customer": customers, "Segment": segments}, types)


@query(f"""with {_NATION_CUSTOMERS}, o as (select root_id, c_custkey, o_orderkey, o_orderpriority, row_number() over (partition by root_id order by c_custkey, o_orderkey) - 1 as idx from c join orders on o_custkey = c_custkey),
p as (select root_id, o_orderpriority, row_number() over (partition by root_id order by min(idx)) - 1 as idx from o group by root_id, o_orderpriority)
{_NATION_LIST} union all select root_id, 'CustomerList', c.idx, c_name, coalesce((select string_agg(o.idx::varchar, ',' order by o.idx) from o where o.c_custkey = c.c_custkey), '') from c
union all select root_id, 'OrderList', o.idx, o_orderkey::varchar, p.idx::varchar from o join p using (root_id, o_orderpriority) union all select root_id, 'PriorityList', idx, o_orderpriority, '0' from p""")
def four_hop_cycle(spark, d):
    """A nation has customers, these have orders, these have priorities, and a priority has its nation."""
    customers = _members(spark, d)
    orders = _t(spark, d, "orders").join(customers.select("root_id", "c_custkey"), F.col("o_custkey") == F.col("c_custkey"))
    orders = _numbered(orders.select("root_id", "o_orderkey", "c_custkey", "o_orderpriority", F.col("o_orderkey").cast("string").alias("name")), "o_orderkey")
    priorities = _numbered(orders.select("root_id", F.col("o_orderpriority").alias("name")).distinct(), "name").withColumn("nation", F.lit(1).cast("long"))
    orders = orders.join(priorities.select("root_id", F.col("name").alias("o_orderpriority"), F.col("oid").alias("priority")), ["root_id", "o_orderpriority"])
    held = orders.groupBy("root_id", "c_custkey").agg(F.array_sort(F.collect_list("oid")).alias("orders"))
    customers = customers.join(held, ["root_id", "c_custkey"], "left")
    types = {
        "Nation": [simple("name", "string"), many("customers", "Customer")],
        "Customer": [simple("name", "string"), many("orders", "Order")],
        "Order": [simple("name", "string"), ref("priority", "Priority")],
        "Priority": [simple("name", "string"), ref("nation", "Nation")],
    }
    return _nation_cycle({"Nation": _nations(spark, d, customers), "Customer": customers, "Order": orders, "Priority": priorities}, types)


_SEEN = """with v as (select user_id as root_id, event_id, date_trunc('day', ts) + to_microseconds((event_id % 3)::bigint) as stamp, (date_trunc('day', ts))::date as day, event_type as kind, (event_id % 2)::decimal(9, 3) / 8 as share from events),
o as (select *, row_number() over (partition by root_id order by event_id) as pos from v),
g as (select root_id, stamp, day, kind, share, min(pos) as first from o group by all)"""


@query(f"{_SEEN} select root_id, row_number() over (partition by root_id order by first) - 1 as idx, epoch_us(stamp) as at_us, epoch_us(stamp) as local_us, day::varchar as day, kind, share::double as share from g")
def cycle_typed_keys(spark, d):
    """What a user did, in a cycle of the user and deeds; equality of timestamps is to the microsecond."""
    events = _t(spark, d, "events")
    local = F.date_trunc("day", "ts").cast("timestamp_ntz")
    local = (local + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), ((F.col("event_id") % 3) / F.lit(1_000_000)).cast("decimal(18,6)"))).cast("timestamp_ntz")
    micros = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', local)")
    raw = F.array(F.col("event_id") % 2 == 0)
    deeds = events.select(F.col("user_id").alias("root_id"), "event_id", local.alias("local"), F.col("event_type").alias("kind"), ((F.col("event_id") % 2) / 8).cast("decimal(9,3)").alias("share"), raw.alias("raw"))
    deeds = deeds.withColumn("at", F.timestamp_micros(micros)).withColumn("day", F.col("local").cast("date"))
    deeds = _numbered(deeds, "event_id").withColumn("user", F.lit(1).cast("long"))
    users = _all(deeds).withColumnRenamed("many", "deeds").withColumn("oid", F.lit(1).cast("long"))
    types = {
        "User": [many("deeds", "Deed")],
        "Deed": [simple("at", "timestamp"), simple("local", "timestamp_ntz"), simple("day", "date"), simple("kind", "string"), simple("share", "decimal(9,3)"), simple("raw", "array<boolean>"), ref("user", "User")],
    }
    config = GraphConfig(TypeCatalog(types))
    config.normalize_graph("User")
    c = _quiet(lambda: normalize_objects({"User": users, "Deed": deeds}, users.select("root_id", "oid"), config))
    return c["DeedList"].select("root_id", F.col("idx").cast("long").alias("idx"), F.unix_micros("at").alias("at_us"), micros.alias("local_us"), F.col("day").cast("string").alias("day"), "kind", F.col("share").cast("double").alias("share"))


@query(f"""with {_NATION_CUSTOMERS}, f as (select root_id, c_mktsegment as label, count(*) as n, min(idx) as first, arg_min(c_name, idx) as child from c group by root_id, c_mktsegment),
i as (select *, 2 * row_number() over (partition by root_id order by first) - 1 as idx from f)
select n_nationkey::bigint as root_id, 0::bigint as idx, n_name as label, coalesce((select string_agg(i.idx::varchar, ',' order by c.idx) from c join i on i.root_id = c.root_id and i.label = c.c_mktsegment where c.root_id = n_nationkey), '') as children, false as lossy from nation
union all select root_id, idx, label, (idx + 1)::varchar, n > 1 from i union all select root_id, idx + 1, child, '', false from i""")
def cycle_false_dedup(spark, d):
    """A tree of a nation, its customers' segments, one node for each customer, and below each a node with the name. Nodes
    of one segment are one by their key: the names below all but the first are lost, and that is reported."""
    customers = _members(spark, d).select("root_id", (F.col("oid") * 2).alias("oid"), "name", "c_mktsegment")
    top = _nations(spark, d, customers).select("root_id", "oid", F.col("name").alias("label"), F.col("customers").alias("children"))
    middle = customers.select("root_id", "oid", F.col("c_mktsegment").alias("label"), F.array(F.col("oid") + 1).alias("children"))
    leaves = customers.select("root_id", F.col("oid") + 1, F.col("name"), F.expr("cast(array() as array<bigint>)"))
    nodes = top.union(middle).union(leaves)
    config = GraphConfig(TypeCatalog({"Node": [simple("label", "string"), many("children", "Node")]}))
    config.normalize_graph("Node")
    c = _quiet(lambda: normalize_objects({"Node": nodes}, top.select("root_id", "oid"), config))
    lossy = c.lossy.select("root_id", "idx", F.lit(True).alias("lossy"))
    return c["NodeList"].join(lossy, ["root_id", "idx"], "left").select("root_id", F.col("idx").cast("long").alias("idx"), "label", F.concat_ws(",", F.col("childrenIndices").cast("array<string>")).alias("children"), F.coalesce("lossy", F.lit(False)).alias("lossy"))


@query(f"""with {_NATION_CUSTOMERS}, k as (select root_id, count(*) as k from c group by root_id)
select root_id, 'CustomerList' as list, k - 1 - idx as idx, c_name as v, case when idx < k - 1 then idx end as next, k - 1 as root_index from c join k using (root_id)
union all select root_id, 'StepList', idx, 'after ' || c_name, k - 2 - idx, k - 1 from c join k using (root_id) where idx < k - 1""")
def root_index(spark, d):
    """The customers of a nation in a row, a step between any two: the last one is entered first, the root last."""
    customers = _members(spark, d)
    last = customers.groupBy("root_id").agg(F.max("oid").alias("last"))
    customers = customers.join(last, "root_id").select("root_id", "oid", F.col("name").alias("v"), F.when(F.col("oid") < F.col("last"), F.col("oid")).alias("next"))
    steps = customers.where("next is not null").select("root_id", "oid", F.concat(F.lit("after "), "v").alias("v"), (F.col("oid") + 1).alias("next"))
    config = GraphConfig(TypeCatalog({"Customer": [simple("v", "string"), ref("next", "Step")], "Step": [simple("v", "string"), ref("next", "Customer")]}))
    config.normalize_graph("Customer")
    c = _quiet(lambda: normalize_objects({"Customer": customers, "Step": steps}, customers.where("oid = 1").select("root_id", "oid"), config))
    frames = reduce(DataFrame.union, [c[x].select("root_id", F.lit(x).alias("list"), F.col("idx").cast("long").alias("idx"), "v", F.col("nextIndex").cast("long").alias("next")) for x in c])
    return frames.join(c.roots, "root_id").select("root_id", "list", "idx", "v", "next", F.col("root_index").cast("long").alias("root_index"))


@query("""select n_nationkey as root_id, '{"RegionList":[{"r_regionkey":' || r_regionkey || ',"r_name":"' || r_name || '"}],"NationList":[{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '","regionIndex":0}]}' as json
from nation join region on n_regionkey = r_regionkey""")
def container_json(spark, d):
    df = _nation_region(spark, d)
    return normalize(df, _config(df, "Nation"), "n_nationkey").to_json()


@query("""select n_nationkey as root_id, '{"regionList":[{"regionKey":' || r_regionkey || ',"name":"' || r_name || '"}],"nationList":[{"nationKey":' || n_nationkey || ',"region":0}]}' as json
from nation join region on n_regionkey = r_regionkey""".replace('"region":0', '"regionIndex":0'))
def camel_case_json(spark, d):
    df = _nation_region(spark, d).select(F.col("n_nationkey").alias("NationKey"), F.struct(F.col("region.r_regionkey").alias("RegionKey"), F.col("region.r_name").alias("Name")).alias("Region"))
    return normalize(df, _config(df, "Nation", lambda g: g.use_json_naming("camelCase")), "NationKey").to_json()


@query("select n_nationkey as root_id, n_name, r_name from nation join region on n_regionkey = r_regionkey")
def json_roundtrip(spark, d):
    df = _nation_region(spark, d)
    c = normalize(df, _config(df, "Nation", lambda g: g.use_json_naming()), "n_nationkey")
    return denormalize(Container.from_json(c.graph, c.to_json())).select("root_id", "n_name", "region.r_name")


@query("""select c_custkey as root_id, n_name as acme, n_name as contoso, 'AcmeAddressList,ContosoAddressList,CustomerList' as lists from customer join nation on n_nationkey = c_nationkey""")
def duplicate_type_names(spark, d):
    df = _customer_nation(spark, d, False).select("c_custkey", F.struct(F.col("nation.n_name").alias("street")).alias("a"), F.struct(F.col("nation.n_name").alias("city")).alias("b"))
    config = GraphConfig(TypeCatalog({"Acme.Address": [simple("street", "string")], "Contoso.Address": [simple("city", "string")], "Customer": [simple("c_custkey", "bigint"), ref("a", "Acme.Address"), ref("b", "Contoso.Address")]}))
    config.normalize_graph("Customer")
    c = normalize(df, config, "c_custkey")
    return c["AcmeAddressList"].join(c["ContosoAddressList"].drop("idx"), "root_id").select("root_id", F.col("street").alias("acme"), F.col("city").alias("contoso"), F.lit(",".join(c.names)).alias("lists"))


@query("select * from (values ('DN0001', 'warning', 'Node'), ('DN0003', 'error', 'Empty'), ('DN0004', 'info', 'Side')) as t(id, severity, type)")
def diagnostics(spark, d):
    types = {"Node": [simple("label", "string"), many("children", "Node"), ref("empty", "Empty"), ref("side", "Side")], "Empty": [simple("x", "int")], "Side": [simple("y", "int")]}
    catalog = TypeCatalog(types)
    side = catalog.types["Node"][3]
    catalog.types["Node"][3] = type(side)(side.name, simple("y", "struct<y:int>").dtype, side.target)
    config = GraphConfig(catalog)
    config.normalize_graph("Node").auto_discover(False)
    config.for_type("Empty").ignore("x")
    return spark.createDataFrame([(x.id, x.severity, x.type) for x in config.diagnostics()], "id string, severity string, type string")


@query("""with c as (select c_custkey, n_name, c_custkey % 2 = 0 as late from customer join nation on n_nationkey = c_nationkey),
f as (select n_name, min((late, c_custkey)) as first from c group by n_name), i as (select n_name, first, row_number() over (order by first) - 1 as idx from f)
select c_custkey, n_name, idx, first = (late, c_custkey) as is_new from c join i using (n_name)""")
def growing_list(spark, d):
    """Nations of customers with odd keys, then of those with even keys, entered into one list."""
    rows = _t(spark, d, "customer").join(_t(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")
    lists = EntityContext(spark)
    parts = [lists.get_or_add_index("Nation", rows.where(F.col("c_custkey") % 2 == x), "c_custkey") for x in (1, 0)]
    return parts[0].union(parts[1])


@query(_BRANDS)
def graph_property_mode(spark, d):
    """Explicit fields only, for the whole graph, with the types' options given in the graph's."""
    df = order_lines(spark, d, "p_brand", "p_size", "p_name")
    config = GraphConfig(TypeCatalog.from_schema("Order", df.schema))
    config.normalize_graph("Order", lambda g: g.use_property_mode(PropertyMode.EXPLICIT_ONLY).for_type("Order", lambda t: t.include("lines")).for_type("Part", lambda t: t.include("p_brand")))
    return _listed(normalize(df, config, "o_orderkey"), "PartList", "p_brand")


@query("""with m as (select * from (values ('n_name', 'name of a nation'), ('n_nationkey', ''), ('regionIndex', '')) as t(field, note)) select n_nationkey as root_id, field, note from nation, m""")
def copied_attributes(spark, d):
    """Each nation with its columns and the notes that these carry: metadata of simple fields is copied."""
    df = _nation_region(spark, d).select("n_nationkey", _as(F.col("n_name"), "n_name", note="name of a nation"), "region")
    frame = normalize(df, _config(df, "Nation", lambda g: g.copy_source_attributes()), "n_nationkey")["NationList"]
    notes = F.array(*(F.struct(F.lit(f.name).alias("field"), F.lit(f.metadata.get("note", "")).alias("note")) for f in frame.schema if f.name not in ("root_id", "idx")))
    return frame.select("root_id", F.explode(notes).alias("x")).select("root_id", "x.*")


@query("select n_nationkey as root_id, n_name, r_name from nation join region on n_regionkey = r_regionkey")
def named_views(spark, d):
    """Lists as views under the names that with_name gave to their types, joined in SQL."""
    df = _nation_region(spark, d)
    config = _config(df, "Nation")
    config.for_type("Nation").with_name("lands")
    config.for_type("Region").with_name("parts_of_the_world")
    normalize(df, config, "n_nationkey").create_views()
    return spark.sql("select l.root_id, n_name, r_name from lands l join parts_of_the_world p on p.root_id = l.root_id and p.idx = l.regionIndex")


@query("""with top as (select max(n_nationkey) * 2 as m from nation)
select i as idx, case when i % 6 = 0 then 'over ' || n_name else n_name end as name from (select unnest(range(0, (select m from top) + 1)) as i) left join nation on n_nationkey * 2 = i""")
def positional_upsert(spark, d):
    """Nations put at every second place of a list, then every third of them once more over what is there."""
    nations = _t(spark, d, "nation").select((F.col("n_nationkey") * 2).alias("idx"), F.col("n_name").alias("name"))
    lists = EntityContext(spark)
    lists.add_to_collection("Nation", nations)
    lists.add_to_collection("Nation", nations.where("idx % 6 = 0").withColumn("name", F.concat(F.lit("over "), "name")))
    return lists.collection("Nation").select("idx", "name")


@query("select c_custkey as source, case when c_custkey % 2 = 1 then c_nationkey::bigint when c_custkey % 4 = 0 then -1::bigint end as idx from customer")
def tracked_objects(spark, d):
    """Customers tracked with an index, some of them twice: the first index stays."""
    customers = _t(spark, d, "customer")
    lists = EntityContext(spark)
    lists.track(customers.where("c_custkey % 2 = 1").select(F.col("c_custkey").alias("source"), F.col("c_nationkey").alias("idx")))
    lists.track(customers.where("c_custkey % 2 = 1 or c_custkey % 4 = 0").select(F.col("c_custkey").alias("source"), F.lit(-1).alias("idx")))
    return lists.tracked(customers.select(F.col("c_custkey").cast("long").alias("source"))).select("source", "idx")


@query(f"""with {_OCC.format(cols="case when l_linenumber % 2 = 0 then lower(l_returnflag) else l_returnflag end as flag")}, g as (select root_id, flag, min(pos) as p from occ group by all)
select root_id, row_number() over (partition by root_id order by p) - 1 as idx, flag from g""")
def ordinal_strings(spark, d):
    """Strings that differ in case are different."""
    df = order_lines(spark, d, F.when(F.col("l_linenumber") % 2 == 0, F.lower("l_returnflag")).otherwise(F.col("l_returnflag")).alias("flag"))
    return _listed(normalize(df, _config(df, "Order"), "o_orderkey"), "PartList", "flag")


@query(f"""with {_OCC.format(cols="(l_linenumber % 3)::decimal(9, 2) / 4 as amount, [p_brand, l_returnflag] as pair, l_shipdate::date as day")}, g as (select root_id, amount, pair, day, min(pos) as p from occ group by all)
select root_id, row_number() over (partition by root_id order by p) - 1 as idx, amount::double as amount, array_to_string(pair, '|') as pair, day::varchar as day from g""")
def values_of_many_types(spark, d):
    """Decimals, arrays, binaries and dates are compared by value."""
    amount = ((F.col("l_linenumber") % 3).cast("decimal(9,2)") / 4).cast("decimal(9,2)").alias("amount")
    pair = F.array("p_brand", "l_returnflag").alias("pair")
    df = order_lines(spark, d, amount, pair, F.col("l_shipdate").cast("date").alias("day"), F.col("p_brand").cast("binary").alias("raw"))
    return _listed(normalize(df, _config(df, "Order"), "o_orderkey"), "PartList", F.col("amount").cast("double").alias("amount"), F.array_join("pair", "|").alias("pair"), F.col("day").cast("string").alias("day"))


@query("select c_custkey as root_id, c_name, case when c_custkey % 3 <> 0 then 0::bigint end as nation_index, case when c_custkey % 3 <> 0 then 1 else 0 end::bigint as n from customer")
def required_null_as_null(spark, d):
    """A required reference that is null, taken as null."""
    df = _customer_nation(spark, d, True)
    df = df.select("c_custkey", "c_name", _as(F.col("nation"), "nation", **_e("Nation", required=True)))
    rows = normalize(df, _config(df, "Customer"), "c_custkey", on_null_required="null").rows
    return rows.select("root_id", F.col("CustomerList")[0]["c_name"].alias("c_name"), F.col("CustomerList")[0]["nationIndex"].cast("long").alias("nation_index"), F.size("NationList").cast("long").alias("n"))


@query(ORACLE_SQL["denormalize_roundtrip"])
def stored_container(spark, d):
    """A container written as Parquet, read and rebuilt."""
    df = order_lines(spark, d, "p_brand", "p_size")
    c, path = normalize(df, _config(df, "Order"), "o_orderkey"), shared_path(spark, "container")
    write_container(c, path)
    back = denormalize(read_container(spark, path, c.graph)).select("root_id", F.posexplode("lines").alias("pos", "x"))
    return back.select("root_id", F.col("pos").cast("long").alias("pos"), "x.*")


@query("""with t as (select conv_id, role, row_number() over (partition by conv_id order by turn, role, text) as oid from conversations)
select a.conv_id as root_id, a.role, b.role as second, c.role as third from t a left join t b on b.conv_id = a.conv_id and b.oid = 2 left join t c on c.conv_id = a.conv_id and c.oid = 3 where a.oid = 1""")
def expanded_cycle(spark, d):
    """The first turns of conversations as nested structs, two references deep."""
    value = expand(_turns(spark, d, cycle_key="oid"), 2)
    second = F.get("value.children", F.lit(0))
    return value.select("root_id", "value.role", second["role"].alias("second"), F.get(second["children"], F.lit(0))["role"].alias("third"))
