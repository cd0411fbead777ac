"""Factoring and rebuilding: fixtures, options, edge cases and random graphs."""

import datetime as dt
import json
import random
import warnings
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T
from sequential import Sequential

from graphfactor.container import Container
from graphfactor.functions import naming
from graphfactor.operators.context import EntityContext
from graphfactor.operators.cycles import _Pass, _Plan, denormalize_objects, expand, normalize_objects
from graphfactor.operators.denormalize import denormalize
from graphfactor.operators.normalize import normalize
from graphfactor.operators.stats import dedup_stats
from graphfactor.plans.analyze import analyze
from graphfactor.plans.catalog import PropertyMode, PropKind, TypeCatalog, many, ref, simple
from graphfactor.plans.config import ConfigError, GraphConfig
from graphfactor.queries import mutual_cycle
from graphfactor.sources.shared import shared_path
from graphfactor.sources.store import read_container, write_container, write_json
from graphfactor.streaming.stream import factor_stream

warnings.filterwarnings("ignore", message="DN0001")

PERSON = TypeCatalog({
    "Address": [simple("Street", "string"), simple("City", "string"), simple("ZipCode", "string")],
    "PhoneNumber": [simple("Number", "string"), simple("Type", "string")],
    "Person": [simple("Name", "string"), simple("Age", "int"), ref("HomeAddress", "Address", nullable=False), ref("WorkAddress", "Address"), many("PhoneNumbers", "PhoneNumber")],
})
ADDRESS = "struct<Street:string,City:string,ZipCode:string>"
PEOPLE = f"Name string, Age int, HomeAddress {ADDRESS}, WorkAddress {ADDRESS}, PhoneNumbers array<struct<Number:string,Type:string>>"
MAIN, OAK = ("123 Main St", "Springfield", "62701"), ("456 Oak Ave", "Shelbyville", "62702")
HOME, WORK = ("555-0100", "Home"), ("555-0200", "Work")


def config(catalog, root, *more):
    c = GraphConfig(catalog)
    c.normalize_graph(root)
    for f in more:
        f(c)
    return c


def people(spark, *rows):
    return spark.createDataFrame(list(rows), PEOPLE)


def rows(df, *drop):
    return sorted((tuple(r) for r in df.drop(*drop).collect()), key=repr)


@pytest.mark.parametrize("strategy", ["row", "shuffle", "auto"])
def test_person_cases(spark, strategy):
    df = people(spark, ("A", 30, MAIN, MAIN, [HOME, WORK]), ("B", 1, MAIN, OAK, [HOME, HOME]), ("C", 2, OAK, None, []), ("D", None, MAIN, None, None))
    c = normalize(df, config(PERSON, "Person"), "Name", strategy=strategy, row_limit=1)
    assert c.names == ["AddressList", "PhoneNumberList", "PersonList"]
    assert rows(c["PersonList"]) == [("A", 0, "A", 30, 0, 0, [0, 1]), ("B", 0, "B", 1, 0, 1, [0, 0]), ("C", 0, "C", 2, 0, None, []), ("D", 0, "D", None, 0, None, [])]
    assert rows(c["AddressList"]) == [("A", 0, *MAIN), ("B", 0, *MAIN), ("B", 1, *OAK), ("C", 0, *OAK), ("D", 0, *MAIN)]
    assert rows(c["PhoneNumberList"]) == [("A", 0, *HOME), ("A", 1, *WORK), ("B", 0, *HOME)]
    back = {r.Name: r for r in denormalize(c).collect()}
    assert back["A"].WorkAddress == back["A"].HomeAddress and back["C"].WorkAddress is None
    assert [tuple(x) for x in back["B"].PhoneNumbers] == [HOME, HOME] and back["D"].PhoneNumbers == []


def test_required_reference_and_null_elements(spark):
    df = people(spark, ("A", 1, None, None, []))
    with pytest.raises(Exception, match="HomeAddress is required and null"):
        normalize(df, config(PERSON, "Person"), "Name")["PersonList"].collect()
    assert normalize(df, config(PERSON, "Person"), "Name", on_null_required="null")["PersonList"].first().HomeAddressIndex is None
    holes = people(spark, ("A", 1, MAIN, None, [None, HOME]))
    with pytest.raises(Exception, match="null element"):
        normalize(holes, config(PERSON, "Person"), "Name")["PersonList"].collect()
    c = normalize(holes, config(PERSON, "Person"), "Name", on_null_required="null")
    assert c["PersonList"].first().PhoneNumbersIndices == [None, 0]
    assert denormalize(c).first().PhoneNumbers[0] is None


def test_empty_table(spark):
    c = normalize(people(spark), config(PERSON, "Person"), "Name")
    assert all(c[n].collect() == [] for n in c) and denormalize(c).collect() == []
    g = normalize(people(spark), config(PERSON, "Person"), "Name", scope="global")
    assert all(g[n].collect() == [] for n in g)


def test_sample_order(spark):
    address = "struct<Street:string,City:string,ZipCode:string>"
    schema = f"OrderId int, Customer struct<Name:string,Email:string,BillingAddress:{address}>, ShippingAddress {address}, Lines array<struct<Product:struct<Name:string,Price:decimal(10,2)>,Quantity:int>>"
    from decimal import Decimal

    widget, gadget = ("Widget", Decimal("9.99")), ("Gadget", Decimal("24.99"))
    df = spark.createDataFrame([(1001, ("Alice Smith", "alice@example.com", MAIN), MAIN, [(widget, 3), (widget, 1), (gadget, 2)])], schema)
    tagged = TypeCatalog.from_schema("Order", df.schema)  # the two addresses have one structure, so they are one type
    c = normalize(df, config(tagged, "Order"), "OrderId")
    assert c.names == ["BillingAddressList", "CustomerList", "ProductList", "LinesList", "OrderList"]
    assert rows(c["BillingAddressList"], "root_id") == [(0, *MAIN)]
    assert rows(c["CustomerList"], "root_id") == [(0, "Alice Smith", "alice@example.com", 0)]
    assert rows(c["ProductList"], "root_id") == [(0, *widget), (1, *gadget)]
    assert rows(c["LinesList"], "root_id") == [(0, 0, 3), (1, 0, 1), (2, 1, 2)]
    assert rows(c["OrderList"], "root_id") == [(0, 1001, 0, 0, [0, 1, 2])]
    assert denormalize(c).drop("root_id").collect() == df.collect()
    stats = {r["list"]: (r.occurrences, r.entries) for r in dedup_stats(c).collect()}
    assert stats["ProductList"] == (3, 2) and stats["OrderList"] == (1, 1) and stats["BillingAddressList"] == (2, 1)


def chain(levels):
    types = {f"L{i}": [simple("Name", "string"), ref("Next", f"L{i + 1}"), many("All", f"L{i + 1}")] for i in range(levels - 1)}
    types[f"L{levels - 1}"] = [simple("Name", "string")]
    return types


def random_value(types, kind, rnd):
    out = {}
    for f in types[kind]:
        if f.target is None:
            out[f.name] = rnd.choice(["x", "y", None])
        elif f.many:
            out[f.name] = None if rnd.random() < 0.2 else [random_value(types, f.target, rnd) for _ in range(rnd.randrange(3))]
        else:
            out[f.name] = None if rnd.random() < 0.3 else random_value(types, f.target, rnd)
    return out


def struct_of(types, kind):
    return T.StructType([T.StructField(f.name, f.dtype if f.target is None else T.ArrayType(struct_of(types, f.target)) if f.many else struct_of(types, f.target)) for f in types[kind]])


@pytest.mark.parametrize("shape", ["chain", "diamond"])
def test_random_graphs_equal_sequential_factoring(spark, shape):
    if shape == "chain":
        types = chain(4)
    else:
        types = {
            "L0": [ref("A", "A"), simple("Name", "string"), many("Bs", "B"), ref("C", "C")],
            "A": [ref("C", "C"), simple("Name", "string")],
            "B": [many("Cs", "C"), ref("A", "A"), simple("Name", "string")],
            "C": [simple("Name", "string"), simple("Other", "string")],
        }
    rnd = random.Random(shape)
    values = [random_value(types, "L0", rnd) for _ in range(120)]
    schema = struct_of(types, "L0").add("key", "integer")
    df = spark.createDataFrame([{**v, "key": i} for i, v in enumerate(values)], schema)
    cfg = config(TypeCatalog(types), "L0")
    plan = {t: [(f.name, f.target, f.many) for f in fs] for t, fs in types.items()}
    want = []
    for v in values:
        s = Sequential(plan)
        s.enter("L0", v)
        want.append(s.lists)
    for strategy in ("row", "shuffle"):
        c = normalize(df, cfg, "key", strategy=strategy)
        for t in types:
            found = {}
            for r in c[c.graph.lists[t]].collect():
                found.setdefault(r.root_id, {})[r.idx] = {f.name: r[p.column] for f, p in zip(types[t], c.graph.by_name[t].props, strict=True)}
            for i, lists in enumerate(want):
                assert [x for _, x in sorted(found.get(i, {}).items())] == lists[t], (strategy, t, i)
        back = {r.root_id: r.asDict(recursive=True) for r in denormalize(c).collect()}
        full = lambda x, t: {f.name: [full(y, f.target) for y in x[f.name] or []] if f.many else x[f.name] and full(x[f.name], f.target) if f.target else x[f.name] for f in types[t]}
        assert all({k: x for k, x in back[i].items() if k != "root_id"} == full(v, "L0") for i, v in enumerate(values))


def test_global_scope_numbers_by_first_appearance(spark):
    df = people(spark, ("B", 1, OAK, MAIN, []), ("A", 1, MAIN, None, [WORK]), ("C", 1, OAK, None, [HOME, WORK]))
    c = normalize(df, config(PERSON, "Person"), "Name", scope="global")
    assert rows(c["AddressList"]) == [(0, *MAIN), (1, *OAK)] and rows(c["PhoneNumberList"]) == [(0, *WORK), (1, *HOME)]
    assert rows(c["PersonList"]) == [(0, "A", 1, 0, None, [0]), (1, "B", 1, 1, 0, []), (2, "C", 1, 1, None, [1, 0])]
    assert sorted(map(tuple, c.roots.select("root_id", "root_index").collect())) == [("A", 0), ("B", 1), ("C", 2)]
    assert {r["list"]: r.n for r in c.counts().collect()} == {"AddressList": 2, "PhoneNumberList": 2, "PersonList": 3}
    assert rows(denormalize(c).select("root_id", "HomeAddress.City")) == [("A", "Springfield"), ("B", "Shelbyville"), ("C", "Shelbyville")]
    with pytest.raises(ValueError):
        c.rows  # noqa: B018


def test_ignored_and_explicit_fields(spark):
    types = {"Employee": [simple("Name", "string"), simple("Age", "int", nullable=False), simple("Department", "string"), simple("Secret", "string", normalize="ignore"), simple("Office", "string", normalize="include")]}
    df = spark.createDataFrame([("Bob", 25, "Engineering", "s", "A101")], "Name string, Age int, Department string, Secret string, Office string")
    c = normalize(df, config(TypeCatalog(types), "Employee", lambda c: c.for_type("Employee", lambda t: t.ignore("Age"))), "Name")
    assert c["EmployeeList"].columns == ["root_id", "idx", "Name", "Department", "Office"]
    back = denormalize(c).first()
    assert (back.Age, back.Secret, back.Office) == (0, None, "A101")
    explicit = config(TypeCatalog(types), "Employee", lambda c: c.for_type("Employee").use_property_mode(PropertyMode.EXPLICIT_ONLY).include("Name"))
    assert normalize(df, explicit, "Name")["EmployeeList"].columns == ["root_id", "idx", "Name", "Office"]
    by_graph = config(TypeCatalog(types), "Employee", lambda c: c.normalize_graph("Employee").use_property_mode(PropertyMode.EXPLICIT_ONLY))
    assert normalize(df, by_graph, "Name")["EmployeeList"].columns == ["root_id", "idx", "Office"]
    none = config(TypeCatalog(types), "Employee", lambda c: c.for_type("Employee").ignore("Name", "Age", "Department", "Office"))
    with pytest.raises(ConfigError, match="DN0003"):
        none.compile()


def test_inlining_discovery_and_reachability(spark):
    schema = T.StructType().add("Name", "string").add("Meta", T.StructType().add("Key", "string"), True, {"entity": "Metadata", "doc": "kept"})
    df = spark.createDataFrame([("a", ("k",)), ("b", None)], schema)
    catalog = TypeCatalog.from_schema("Person", schema)
    kinds = lambda c: {p.name: p.kind for p in analyze(c, "Person").by_name["Person"].props}
    assert kinds(config(catalog, "Person"))["Meta"] is PropKind.NORMALIZED
    for option in (lambda c: c.normalize_graph("Person").inline("Metadata"), lambda c: c.for_type("Person").inline("Meta"), lambda c: c.normalize_graph("Person").auto_discover(False)):
        c = normalize(df, config(catalog, "Person", option), "Name")
        assert c.names == ["PersonList"] and c["PersonList"].orderBy("root_id").collect()[0].Meta.Key == "k"
        assert [r.Meta and r.Meta.Key for r in denormalize(c).orderBy("root_id").collect()] == ["k", None]
    both = config(catalog, "Person", lambda c: c.normalize_graph("Person").inline("Metadata").copy_source_attributes(), lambda c: c.for_type("Person").normalize("Meta"))
    assert kinds(both)["Meta"] is PropKind.NORMALIZED
    copied = config(catalog, "Person", lambda c: c.normalize_graph("Person", lambda g: g.inline("Metadata").copy_source_attributes()))
    assert normalize(df, copied, "Name")["PersonList"].schema["Meta"].metadata["doc"] == "kept"
    undiscovered = config(catalog, "Person", lambda c: c.normalize_graph("Person").auto_discover(False))
    assert [(d.id, d.severity, d.type) for d in undiscovered.diagnostics()] == [("DN0004", "info", "Metadata")]
    assert kinds(config(catalog, "Person", lambda c: c.normalize_graph("Person").auto_discover(False), lambda c: c.for_type("Metadata")))["Meta"] is PropKind.NORMALIZED
    several = config(PERSON, "Person", lambda c: c.normalize_graph("Address"))
    assert list(several.compile("Address").by_name) == ["Address"]
    with pytest.raises(ConfigError, match="name one of the roots"):
        several.compile()
    with pytest.raises(ConfigError, match="unknown type"):
        several.for_type("Nobody")


def test_classification_of_schema_types():
    schema = T._parse_datatype_string("a int, b array<string>, c map<string,int>, d binary, e struct<x:int>, f array<struct<x:int>>, g array<array<struct<x:int>>>, h timestamp_ntz, i interval day to second")
    kinds = [p.kind.value for p in analyze(config(TypeCatalog.from_schema("R", schema), "R"), "R").by_name["R"].props]
    assert kinds == ["simple"] * 4 + ["normalized", "collection"] + ["simple"] * 3
    with pytest.raises(ValueError, match="variant"):
        TypeCatalog.from_schema("R", T.StructType().add("v", T.VariantType()))
    with pytest.raises(ValueError, match="unknown type"):
        TypeCatalog({"A": [ref("x", "B")]})


def test_simple_values_of_every_kind_are_compared_by_value(spark):
    df = spark.createDataFrame([(1, [({"b": 1, "a": 2}, [1], bytearray(b"x"), float("nan"), None), ({"a": 2, "b": 1}, [1], bytearray(b"x"), float("nan"), None), ({}, None, None, -0.0, 1), ({}, None, None, 0.0, 1)])], "id int, es array<struct<m:map<string,int>,l array<int>,b binary,d double,n int>>".replace("l array", "l:array"))
    for strategy in ("row", "shuffle"):
        c = normalize(df, config(TypeCatalog.from_schema("R", df.schema), "R"), "id", strategy=strategy)
        assert c["RList"].first().esIndices == [0, 0, 1, 1] and c["EsList"].count() == 2
        assert denormalize(c).first().es[1].m == {"a": 2, "b": 1}


def test_set_collections_and_order_of_elements(spark):
    types = TypeCatalog({"Tag": [simple("T", "string")], "Owner": [simple("N", "string"), many("Tags", "Tag", distinct=True)], "Root": [simple("id", "int"), many("Owners", "Owner")]})
    df = spark.createDataFrame([(1, [("o", [("p",), ("q",)]), ("o", [("q",), ("p",)]), ("o", [("p",), ("q",)])])], "id int, Owners array<struct<N:string,Tags:array<struct<T:string>>>>")
    c = normalize(df, config(types, "Root"), "id")
    assert c["RootList"].first().OwnersIndices == [0, 1, 0]
    again = spark.createDataFrame([(1, [("o", [("p",), ("p",)])])], df.schema)
    assert [t.T for t in denormalize(normalize(again, config(types, "Root"), "id")).first().Owners[0].Tags] == ["p"]


def test_same_short_names_and_json(spark):
    types = TypeCatalog({"Acme.Address": [simple("Street", "string", json="road")], "Contoso.Address": [simple("City", "string")], "Person": [simple("ID", "int"), ref("XMLParser", "Acme.Address"), ref("b", "Contoso.Address")]})
    df = spark.createDataFrame([(1, ("s",), None)], "ID int, XMLParser struct<Street:string>, b struct<City:string>")
    cfg = config(types, "Person", lambda c: c.normalize_graph("Person").use_json_naming("camelCase"))
    c = normalize(df, cfg, "ID")
    assert c.names == ["AcmeAddressList", "ContosoAddressList", "PersonList"]
    document = c.to_json().first().json
    assert list(json.loads(document)) == ["acmeAddressList", "contosoAddressList", "personList"]
    assert json.loads(document)["personList"] == [{"id": 1, "xmlParserIndex": 0, "bIndex": None}] and '"road":"s"' in document
    assert denormalize(Container.from_json(c.graph, c.to_json())).collect() == denormalize(c).collect()
    with pytest.raises(ConfigError):
        cfg.normalize_graph("Person").use_json_naming("snake_case")
    with pytest.raises(KeyError):
        c["NoList"]
    assert c.get("NoList") is None


def test_names():
    assert [naming.camel_case(x) for x in ("Person", "ID", "XMLParser", "already", "", "A", "IOStream")] == ["person", "id", "xmlParser", "already", "", "a", "ioStream"]
    assert naming.row_type("a.b.Person") == "a.b.NormalizedPerson" and naming.container_type("Person") == "NormalizedPersonResult"


def test_stores_and_streams(spark, tmp_path):
    df = people(spark, ("A", 30, MAIN, MAIN, [HOME, WORK]), ("B", 1, MAIN, OAK, [HOME, HOME]))
    cfg = config(PERSON, "Person")
    for strategy in ("row", "shuffle"):
        c = normalize(df, cfg, "Name", strategy=strategy)
        write_container(c, f"{tmp_path}/{strategy}")
        again = read_container(spark, f"{tmp_path}/{strategy}", c.graph)
        assert rows(denormalize(again)) == rows(denormalize(c)) and rows(again["AddressList"]) == rows(c["AddressList"])
    write_json(c, f"{tmp_path}/json")
    assert spark.read.text(f"{tmp_path}/json").count() == 2
    df.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    factor_stream(stream, cfg, "Name", f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    assert rows(read_container(spark, f"{tmp_path}/out", cfg.compile())["PersonList"]) == rows(c["PersonList"])


def test_views_by_key(spark):
    c = normalize(people(spark, ("A", 30, MAIN, OAK, [])), config(PERSON, "Person", lambda c: c.for_type("Address").with_name("places")), "Name")
    c.create_views()
    assert spark.sql("select count(*) as n from places join Person using (root_id)").first().n == 2 and c.names[0] == "AddressList"


def test_factoring_needs_no_shuffle(spark):
    df = people(spark, ("A", 30, MAIN, MAIN, [HOME]))
    c = normalize(df, config(PERSON, "Person"), "Name")
    plan = denormalize(c)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


# cycles


def objects(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


TREE = TypeCatalog({"TreeNode": [simple("Label", "string"), ref("Parent", "TreeNode"), many("Children", "TreeNode")]})
TREE_ROW = "root_id int, oid long, Label string, Parent long, Children array<long>"


def tree(spark, rows, **options):
    nodes = objects(spark, [(1, *r) for r in rows], TREE_ROW)
    return normalize_objects({"TreeNode": nodes}, objects(spark, [(1, rows[0][0])], "root_id int, oid long"), config(TREE, "TreeNode", lambda c: c.normalize_graph("TreeNode").use_reference_tracking_for_cycles()), **options)


def test_tree(spark):
    c = tree(spark, [(1, "Root", None, [2, 3]), (2, "Child1", 1, [4]), (3, "Child2", 1, []), (4, "Grandchild", 2, None), (9, "unreachable", None, [])])
    assert rows(c["TreeNodeList"], "root_id") == [(0, "Root", None, [1, 3]), (1, "Child1", 0, [2]), (2, "Grandchild", 1, []), (3, "Child2", 0, [])]
    assert c.roots.first().root_index == 0 and c.lossy.count() == 0
    back = denormalize_objects(c)["TreeNode"]
    assert back.where("oid = 0").first().Children == [1, 3]
    top = expand(c, 2).first().value
    assert [x.Label for x in top.Children] == ["Child1", "Child2"] and top.Children[0].Children[0].Label == "Grandchild" and top.Children[1].Children == []


def test_equal_nodes_with_different_children(spark):
    nodes = [(1, "R", None, [2, 3]), (2, "X", None, [4]), (3, "X", None, [5, 5]), (4, "a", None, []), (5, "b", None, [])]
    c = tree(spark, nodes)
    assert rows(c["TreeNodeList"], "root_id") == [(0, "R", None, [1, 1]), (1, "X", None, [2]), (2, "a", None, [])] and [r.idx for r in c.lossy.collect()] == [1]
    assert tree(spark, nodes, cycle_key="shape")["TreeNodeList"].count() == 5
    assert tree(spark, nodes, cycle_key="oid").lossy.count() == 0


def test_deep_trees_need_no_recursion(spark):
    n = 5000
    c = tree(spark, [(i, f"n{i}", i - 1 if i else None, [i + 1] if i < n - 1 else []) for i in range(n)])
    assert c["TreeNodeList"].count() == n and c["TreeNodeList"].agg(F.max("idx")).first()[0] == n - 1


@pytest.mark.parametrize("n", [2, 3, 4])
def test_rings(spark, n):
    types = TypeCatalog({f"T{i}": [simple("Name", "string"), ref("Next", f"T{(i + 1) % n}")] for i in range(n)})
    tables = {f"T{i}": objects(spark, [(1, 7, f"name{i}", 7)], "root_id int, oid long, Name string, Next long") for i in range(n)}
    c = normalize_objects(tables, objects(spark, [(1, 7)], "root_id int, oid long"), config(types, "T0"))
    assert c.names == [f"T{i}List" for i in reversed(range(n))]
    assert all(rows(c[x], "root_id") == [(0, f"name{x[1]}", 0)] for x in c)
    assert sum(p.circular for node in c.graph.nodes for p in node.props) == 1 and c.graph.by_name[f"T{n - 1}"].props[1].circular
    other = analyze(config(types, "T1"), "T1")
    assert other.by_name["T0"].props[1].circular
    assert {d.id for d in analyze(config(types, "T0"), "T0").diagnostics} == {"DN0001"}
    with pytest.raises(ConfigError):
        normalize(tables["T0"], config(types, "T0"), "oid")


def test_dangling_and_null_references(spark):
    with pytest.raises(Exception, match="doesn't have"):
        tree(spark, [(1, "R", 77, [])])
    with pytest.raises(Exception, match="null element"):
        tree(spark, [(1, "R", None, [None])])
    c = tree(spark, [(1, "R", None, [None, 1])], on_null_required="null")
    assert c["TreeNodeList"].first().ChildrenIndices == [None, 0]


CYCLIC = {
    "two": {"A": [simple("V", "string"), ref("B", "B"), many("Bs", "B")], "B": [simple("V", "string"), ref("A", "A")]},
    "cross": {"A": [simple("V", "string"), ref("B", "B"), ref("C", "C")], "B": [ref("A", "A"), simple("V", "string")], "C": [simple("V", "string"), ref("B", "B"), ref("D", "D")], "D": [simple("V", "string")]},
    "self": {"A": [many("Kids", "A"), ref("D", "D"), simple("V", "string"), ref("Up", "A")], "D": [simple("V", "string")]},
}


@pytest.mark.parametrize("name", CYCLIC)
def test_random_cyclic_graphs_equal_sequential_factoring(spark, name):
    types, rnd = CYCLIC[name], random.Random(name)
    graph = analyze(config(TypeCatalog(types), "A"), "A")
    circular = {(n.name, p.name) for n in graph.nodes for p in n.props if p.circular}
    two_phase = {n.name for n in graph.nodes if n.two_phase}
    plan = {t: [(f.name, f.target, f.many) for f in fs] for t, fs in types.items()}
    tables, want = {t: [] for t in types}, {}
    for root in range(60):
        pool = {t: [{} for _ in range(rnd.randrange(1, 5))] for t in types}
        for t, fields in types.items():
            for oid, obj in enumerate(pool[t]):
                row = [root, oid]
                for f in fields:
                    if f.target is None:
                        obj[f.name] = rnd.choice("xy")
                        row.append(obj[f.name])
                    elif f.many:
                        ids = [rnd.randrange(len(pool[f.target])) for _ in range(rnd.randrange(3))]
                        obj[f.name] = [pool[f.target][i] for i in ids]
                        row.append(ids)
                    else:
                        i = None if rnd.random() < 0.4 else rnd.randrange(len(pool[f.target]))
                        obj[f.name] = None if i is None else pool[f.target][i]
                        row.append(i)
                tables[t].append(tuple(row))
        s = Sequential(plan, circular, two_phase)
        want[root] = s.enter("A", pool["A"][0]), s.lists
    frames = {t: spark.createDataFrame(tables[t], "root_id int, oid long, " + ", ".join(f"{f.name} {'string' if f.target is None else 'array<long>' if f.many else 'long'}" for f in types[t])) for t in types}
    c = normalize_objects(frames, spark.range(60).select(F.col("id").cast("int").alias("root_id"), F.lit(0).alias("oid")), config(TypeCatalog(types), "A"))
    assert {r.root_id: r.root_index for r in c.roots.collect()} == {i: w[0] for i, w in want.items()}
    for t in types:
        found = {}
        for r in c[c.graph.lists[t]].collect():
            found.setdefault(r.root_id, {})[r.idx] = {p.name: r[p.column] for p in c.graph.by_name[t].props}
        for i, (_, lists) in want.items():
            assert [x for _, x in sorted(found.get(i, {}).items())] == lists[t], (t, i)


@pytest.mark.parametrize("key_mode", ["exclude", "oid"])
def test_members_that_lead_back_are_followed_once_each(monkeypatch, key_mode):
    n, visits, visit = 300, [], _Pass._visit
    monkeypatch.setattr(_Pass, "_visit", lambda self, *me: visits.append(me) or visit(self, *me))
    # A team has groups and guests, a group has members, and members and guests have the team.
    plans = [_Plan([1, 2], [True, True], [0, 1], [], [False] * 2, True), _Plan([2], [True], [0], [], [False], True), _Plan([0], [False], [], [0], [False], True)]
    links = {(0, 0): [list(range(n // 10)), list(range(n, 2 * n))]} | {(1, i): [list(range(10 * i, 10 * i + 10))] for i in range(n // 10)} | {(2, i): [[0]] for i in range(2 * n)}
    work = _Pass(plans, key_mode, "error", {x: str(x) for x in links}, links, set(), False)
    assert work.enter(0, 0) == 0 and not work.lossy
    assert sorted(work.rows) == [(0, 0, 0, links[0, 0])] + [(1, i, i, links[1, i]) for i in range(n // 10)] + [(2, i, i, [[0]]) for i in range(2 * n)]
    assert len(visits) < 8 * n


def test_customers_of_one_name_in_a_mutual_cycle(spark, tmp_path):
    spark.createDataFrame([(k, "same" if k % 2 else f"n{k}", k % 2) for k in range(12)], "c_custkey long, c_name string, c_nationkey int").withColumn("c_mktsegment", F.lit("")).write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(0, "A"), (1, "B"), (2, "C")], "n_nationkey int, n_name string").write.parquet(f"{tmp_path}/nation.parquet")
    lists = [(x, "NationList", 0, "ABC"[x], "0,1,2,3,4,5" if x < 2 else "") for x in range(3)]
    members = [(k % 2, "CustomerList", k // 2, "same" if k % 2 else f"n{k}", "0") for k in range(12)]
    assert sorted(tuple(r) for r in mutual_cycle(spark, str(tmp_path)).collect()) == sorted(lists + members)


def nearby(kind, rnd):
    """Values of a type, of which some are equal and some differ in their last digit only."""
    micros = lambda: dt.timedelta(microseconds=rnd.randrange(3), milliseconds=rnd.randrange(2))
    start = dt.datetime(2024, 3, 31, 1, 59, 59, 999_000)
    return {
        "timestamp": lambda: start.replace(tzinfo=dt.UTC) + micros(),
        "timestamp_ntz": lambda: start + micros(),
        "date": lambda: dt.date(1, 1, 1) + dt.timedelta(days=rnd.randrange(3)),
        "double": lambda: rnd.choice([0.0, -0.0, 0.1, 0.1 + 2**-56, 1e300, float("inf"), float("nan"), 5e-324]),
        "float": lambda: rnd.choice([0.0, -0.0, 0.5, 0.5 + 2**-24, float("-inf")]),
        "decimal(38,18)": lambda: Decimal(rnd.choice(["1", "1.000000000000000001", "12345678901234567890.000000000000000001", "0E-18"])),
        "bigint": lambda: rnd.choice([2**63 - 1, 2**63 - 2, -(2**63), 2**53, 2**53 + 1]),
        "binary": lambda: bytearray(rnd.choice([b"", b"\0", b"\xff\xfe", b"\xff\xff"])),
        "string": lambda: rnd.choice(["a", "A", "é", "e\u0301", '"', "\\", "\0", "null", ""]),
        "boolean": lambda: rnd.random() < 0.5,
        "array<timestamp_ntz>": lambda: [start + micros() for _ in range(rnd.randrange(3))],
        "map<string,timestamp_ntz>": lambda: {k: start + micros() for k in rnd.sample("ab", rnd.randrange(3))},
    }[kind]


KINDS = ["timestamp", "timestamp_ntz", "date", "double", "float", "decimal(38,18)", "bigint", "binary", "string", "boolean", "array<timestamp_ntz>", "map<string,timestamp_ntz>"]


def shown(x):
    if isinstance(x, float):
        return "NaN" if x != x else x + 0.0
    return bytes(x) if isinstance(x, bytearray) else sorted(x.items()) if isinstance(x, dict) else x


@pytest.mark.parametrize("kind", KINDS)
def test_values_of_every_type_in_cycles_and_json(spark, kind):
    rnd = random.Random(kind)
    draw = nearby(kind, rnd)
    values = [None, *(draw() for _ in range(40))]
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        kids = spark.createDataFrame([(1, i + 1, v, 1) for i, v in enumerate(values)], f"root_id int, oid long, V {kind}, Up long")
        up = spark.createDataFrame([(1, 1, list(range(1, len(values) + 1)))], "root_id int, oid long, Kids array<long>")
        types = TypeCatalog({"Top": [many("Kids", "Kid")], "Kid": [simple("V", kids.schema["V"].dataType), ref("Up", "Top")]})
        c = normalize_objects({"Top": up, "Kid": kids}, up.select("root_id", "oid"), config(types, "Top"))
        got = [r.V for r in c["KidList"].orderBy("idx").collect()]
        want = []
        for v in values:
            if shown(v) not in [shown(w) for w in want]:
                want.append(v)
        as_read = [r.V for r in spark.createDataFrame([(v,) for v in want], f"V {kind}").collect()]
        assert [shown(v) for v in got] == [shown(v) for v in as_read]
        flat = spark.createDataFrame([(1, [(v,) for v in values])], f"id int, kids array<struct<V:{kind}>>")
        box = normalize(flat, config(TypeCatalog.from_schema("Root", flat.schema), "Root"), "id")
        back = Container.from_json(box.graph, box.to_json()).rows.first()
        assert [shown(r.V) for r in back.KidsList] == [shown(r.V) for r in box.rows.first().KidsList] and back.RootList == box.rows.first().RootList
        assert [shown(r.V) for r in box.rows.first().KidsList] == [shown(v) for v in as_read]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


@pytest.mark.parametrize("strategy,scope", [("row", "root"), ("shuffle", "root"), ("auto", "root"), ("row", "global")])
def test_nan_may_equal_nothing(spark, strategy, scope):
    nan = float("nan")
    df = spark.createDataFrame([(1, [((nan,),), ((nan,),), ((1.0,),), ((1.0,),)]), (2, [((nan,),), ((1.0,),)])], "id int, ls array<struct<p:struct<x:double>>>")
    cfg = config(TypeCatalog.from_schema("Root", df.schema), "Root")
    c = normalize(df, cfg, "id", scope=scope, strategy=strategy, row_limit=2, nan_distinct=True)
    counts = {r.list: r.n for r in c.counts().collect()}
    assert counts == ({"PList": 5, "LsList": 5, "RootList": 2} if scope == "root" else {"PList": 4, "LsList": 4, "RootList": 2})
    assert [str(r.ls) for r in denormalize(c).orderBy("root_id").collect()] == [str(r.ls) for r in df.orderBy("id").collect()]
    assert {r.list: r.n for r in normalize(df, cfg, "id").counts().collect()} == {"PList": 4, "LsList": 4, "RootList": 2}


def test_reference_tracking_tells_objects_with_nan_by_identity(spark):
    nan = float("nan")
    ring = objects(spark, [(1, 1, nan, 2), (1, 2, nan, 3), (1, 3, 0.5, 1)], "root_id int, oid long, V double, Next long")
    types, root = TypeCatalog({"N": [simple("V", "double"), ref("Next", "N")]}), spark.createDataFrame([(1, 1)], "root_id int, oid long")

    def links(tracking, rows=ring, **options):
        cfg = config(types, "N", lambda c: c.normalize_graph("N").use_reference_tracking_for_cycles() if tracking else None)
        c = normalize_objects({"N": rows}, root, cfg, **options)
        return [r.NextIndex for r in c["NList"].orderBy("idx").collect()]

    assert links(True, nan_distinct=True) == [1, 2, 0]
    assert links(False, nan_distinct=True) == [1, 2, 3, 4, 2]
    assert links(True) == links(False) == [0]
    endless = ring.where("oid < 3").withColumn("Next", F.lit(3) - F.col("oid"))
    assert links(True, endless, nan_distinct=True) == [1, 0]
    with pytest.raises(Exception, match="no end"):
        links(False, endless, nan_distinct=True)


def test_intermediate_tables_need_a_shared_folder_on_a_cluster(spark):
    class Session:
        conf, sparkContext = type("Conf", (), {"get": lambda *_: None})(), type("Context", (), {"master": "yarn"})()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_path(Session(), "x")


def test_growing_lists(spark):
    lists = EntityContext(spark)
    df = lambda *x: spark.createDataFrame([(i, *r) for i, r in enumerate(x)], "pos long, Name string, Age int")
    enter = lambda key, rows: [(r.idx, r.is_new) for r in lists.get_or_add_index(key, rows, "pos").orderBy("pos").collect()]
    assert lists.collection("P").collect() == []
    assert enter("P", df(("a", 1), ("b", None), ("a", 1), ("b", None))) == [(0, True), (1, True), (0, False), (1, False)]
    assert enter("P", df(("b", None), ("c", 3), (None, None))) == [(1, False), (2, True), (3, True)]
    assert enter("Q", df(("c", 3))) == [(0, True)] and enter("P", df()) == []
    assert rows(lists.collection("P")) == [(0, "a", 1), (1, "b", None), (2, "c", 3), (3, None, None)]
    with pytest.raises(TypeError):
        lists.get_or_add_index("P", spark.createDataFrame([(1, 2)], "pos long, Name int"), "pos")
    put = lambda *x: lists.add_to_collection("R", spark.createDataFrame(list(x), "idx int, Name string"))
    put((0, "a"), (3, "d"))
    put((0, "z"), (1, "b"))
    assert rows(lists.collection("R")) == [(0, "z"), (1, "b"), (2, None), (3, "d")]
    with pytest.raises(IndexError):
        put((-1, "x"))
    ids = spark.createDataFrame([(7,), (8,)], "source long")
    assert rows(lists.tracked(ids)) == [(7, None), (8, None)]
    lists.track(spark.createDataFrame([(7, 1)], "source long, idx long"))
    lists.track(spark.createDataFrame([(7, 5), (9, 2)], "source long, idx long"))
    assert rows(lists.tracked(ids)) == [(7, 1), (8, None)]
