"""Nested JSON records to related flat tables by shared inlining.

A schema graph of elements is declared once. inline_plan analyses it: the root, and every element that is repeated, shared
by several parents or recursive, becomes a table; an element that occurs at most once in its only parent is inlined there
as prefixed columns. shred turns documents into rows of all tables in one pass, each with the keys of its parents.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataform.runtime import cut


@dataclass
class Child:
    """A link of the graph. form: one, list, map (of names to values) or pairs (a map, or a list of name and value).

    A map given as a list, or a list given as a single object, is read all the same; single names the field by which a
    single object in place of a map is told.
    """

    path: str
    element: str
    form: str = "list"
    single: str | None = None
    name: str | None = None


@dataclass
class Element:
    """columns: scalar field -> Spark type (json: any value, as JSON text). key: the field that names a row, if any."""

    name: str
    columns: dict[str, str] = field(default_factory=dict)
    key: str | None = None
    children: list[Child] = field(default_factory=list)


@dataclass
class TablePlan:
    element: str
    parents: list[str]
    why: str
    columns: dict[str, tuple[str, str]]


def _reaches(graph: dict[str, Element], start: str, goal: str) -> bool:
    seen, todo = set(), [c.element for c in graph[start].children]
    while todo:
        x = todo.pop()
        if x == goal:
            return True
        if x not in seen:
            seen.add(x)
            todo += [c.element for c in graph[x].children]
    return False


def inline_plan(graph: dict[str, Element], root: str) -> dict[str, TablePlan]:
    """The tables of a schema graph, with the reason for each and its columns (name -> JSON path and type)."""
    links = [(e.name, c) for e in graph.values() for c in e.children]
    entering = Counter(c.element for _, c in links)
    why = {root: "root"}
    for name in graph:
        if name == root:
            continue
        if _reaches(graph, name, name):
            why[name] = "recursive"
        elif any(c.element == name and c.form != "one" for _, c in links):
            why[name] = "repeated"
        elif entering[name] > 1:
            why[name] = "shared"

    def inlined(name: str, path: str, prefix: str) -> Iterable[tuple[str, tuple[str, str]]]:
        for column, kind in graph[name].columns.items():
            yield prefix + column, (f"{path}.{column}", kind)
        for c in graph[name].children:
            if c.element not in why:
                yield from inlined(c.element, f"{path}.{c.path}", f"{prefix}{c.path}_")

    def holders(name: str) -> list[str]:
        out: list[str] = []
        for parent, c in links:
            if c.element == name:
                out += [parent] if parent in why else holders(parent)
        return sorted(set(out))

    return {n: TablePlan(n, holders(n) if n != root else [], w, dict(inlined(n, "$", ""))) for n, w in why.items()}


def json_objects(df: DataFrame, text: str, into: str) -> DataFrame:
    """Adds into, a variant: the object that text holds, directly or inside one JSON string; rows without one are dropped."""
    strip = lambda c: F.regexp_replace(c, r"^[\s﻿]+|[\s﻿]+$", "")
    outer = strip(F.col(text))
    inner = strip(F.try_variant_get(F.try_parse_json(outer), "$", "string"))
    body = F.when(outer.startswith('"'), inner).otherwise(outer)
    return df.withColumn("_body", body).filter(F.col("_body").startswith("{")).withColumn(into, F.try_parse_json("_body")).drop("_body").filter(F.col(into).isNotNull())


def _members(v: F.Column, child: Child, path: str) -> F.Column:
    """Array of (pos, name, value) of a child of v; null elements are counted but not kept."""
    at = f"{path}.{child.path}"
    as_list = F.try_variant_get(v, at, "array<variant>")
    as_map = F.try_variant_get(v, at, "map<string,variant>")
    one = F.try_variant_get(v, at, "variant")
    item = lambda pos, name, value: F.struct(pos.cast("int").alias("pos"), name.cast("string").alias("name"), value.alias("value"))
    named = (lambda x: F.try_variant_get(x, f"$.{child.name}", "string")) if child.name else (lambda x: F.lit(None))
    of_list = F.transform(as_list, lambda x, i: item(i, named(x), x))
    alone = F.array(item(F.lit(0), named(one), one))
    if child.form in ("map", "pairs"):
        entries = F.transform(F.map_entries(as_map), lambda e, i: item(i, e["key"], e["value"]))
        if child.single:
            is_single = F.map_contains_key(as_map, child.single) & F.try_variant_get(one, f"$.{child.single}", "string").isNotNull() & F.try_variant_get(one, f"$.{child.single}", "map<string,variant>").isNull()
            from_map = F.when(is_single, alone).otherwise(entries)
        else:
            from_map = entries
    else:
        from_map = F.when(as_map.isNotNull(), alone)
    got = F.coalesce(of_list, from_map, F.array().cast("array<struct<pos:int,name:string,value:variant>>"))
    if child.form == "pairs":  # a name with a null value is a row; a list element must be an object with a name
        return F.filter(got, lambda x: x["name"].isNotNull())
    return F.filter(got, lambda x: x["value"].isNotNull() & ~F.is_variant_null(x["value"]))


def _made(c: Child, own: str | None, leads_on: bool):
    """The function that makes a row of a child's element from a member of the array of _members."""

    def made(m: F.Column) -> F.Column:
        field_of = F.try_variant_get(m["value"], f"$.{own}", "string") if own else F.lit(None).cast("string")
        k = F.coalesce(field_of, m["name"], F.lit(None).cast("string") if own else m["pos"].cast("string"))
        place = F.concat_ws("/", F.col("row_id"), F.lit(c.path), m["name"], m["pos"].cast("string"))
        return F.struct(
            F.lit(c.element).alias("element"), F.lit(leads_on).alias("open"), F.concat(F.col("pos"), F.array(m["pos"])).alias("pos"), F.concat(F.col("keys"), F.array(k)).alias("keys"),
            F.col("row_id").alias("parent"), place.alias("row_id"), m["value"].alias("value"),
        )

    return made


def shred(df: DataFrame, key: str, value: str, graph: dict[str, Element], root: str, wanted: set[str], keep_values: bool = True) -> DataFrame:
    """Rows of all wanted tables: doc_key, element, pos, keys (both from the outermost element inwards), parent, row_id, value.

    keys holds an element's own key field, else the name it had in a map, else its position. parent is the row_id of the
    row that holds it. One pass: every step replaces the open rows by themselves, closed, and their children. Elements
    that can't lead to a wanted table aren't followed. Recursive elements are followed to the end, in further passes.
    """
    plan = inline_plan(graph, root)
    leads = {n for n in plan if n in wanted or any(w in graph and _reaches(graph, n, w) for w in wanted)}

    def links(name: str, path: str = "$") -> list[tuple[str, Child]]:
        out: list[tuple[str, Child]] = []
        for c in graph[name].children:
            out += [(path, c)] if c.element in plan else links(c.element, f"{path}.{c.path}")
        return [x for x in out if x[1].element in leads]

    row = "struct<element:string,open:boolean,pos:array<int>,keys:array<string>,parent:string,row_id:string,value:variant>"
    with_links = [n for n in plan if links(n)]
    depth = 0

    def longest(name: str, seen: tuple[str, ...]) -> int:
        return 0 if name in seen else max([0, *(1 + longest(c.element, (*seen, name)) for _, c in links(name))])

    depth = longest(root, ())

    def children(name: str) -> F.Column:
        parts = []
        for path, c in links(name):
            made = _made(c, graph[c.element].key, bool(links(c.element)))
            parts.append(F.transform(_members(F.col("value"), c, path), made))
        return F.concat(*parts)

    def step(rows: DataFrame) -> DataFrame:
        me = F.struct("element", F.lit(False).alias("open"), "pos", "keys", "parent", "row_id", (F.col("value") if keep_values else F.lit(None).cast("variant")).alias("value"))
        choice = F.array().cast(f"array<{row}>")
        for n in with_links:
            grown = F.concat(F.array(me), children(n)) if n in wanted else children(n)
            choice = F.when(F.col("open") & (F.col("element") == n), grown.cast(f"array<{row}>")).otherwise(choice)
        full = F.when(~F.col("open"), F.array(F.struct("element", "open", "pos", "keys", "parent", "row_id", "value"))).otherwise(choice)
        return rows.select("doc_key", F.explode(full).alias("r")).select("doc_key", "r.*")

    rows = df.select(
        F.col(key).alias("doc_key"), F.lit(root).alias("element"), F.lit(bool(links(root))).alias("open"), F.array().cast("array<int>").alias("pos"), F.array().cast("array<string>").alias("keys"),
        F.lit(None).cast("string").alias("parent"), F.lit("").alias("row_id"), F.col(value).alias("value"),
    )
    for _ in range(depth):
        rows = step(rows)
    if any(plan[n].why == "recursive" for n in leads):
        done = []
        while True:
            rows = cut(rows)
            done.append(rows.filter("not open"))
            rows = rows.filter("open")
            if rows.isEmpty():
                break
            rows = step(rows)
        rows = done[0]
        for more in done[1:]:
            rows = rows.unionByName(more)
    return rows.filter(F.col("element").isin(*wanted)).drop("open")


def flat_table(rows: DataFrame, plan: TablePlan) -> DataFrame:
    """One table of shred's rows: doc_key, row_id, parent, pos and the element's own and inlined columns."""
    def column(path: str, kind: str) -> F.Column:
        if kind == "json":
            return F.to_json(F.try_variant_get("value", path, "variant"))
        if kind == "string":
            return F.try_variant_get("value", path, "string")
        # Numbers may come as strings.
        return F.coalesce(F.try_variant_get("value", path, kind), F.expr(f"try_cast(trim(try_variant_get(value, '{path}', 'string')) AS {kind})"))

    one = rows.filter(F.col("element") == plan.element)
    return one.select("doc_key", "row_id", "parent", F.try_element_at("pos", F.lit(-1)).alias("pos"), *[column(p, k).alias(n) for n, (p, k) in plan.columns.items()])


def schema_paths(df: DataFrame, value: str, maps: set[str]) -> DataFrame:
    """(path, kind, n) of every kind of value found at every path of the variants; [] for elements, * for names of maps.

    The documents are walked level by level; what is kept of each level is one row a path and kind.
    """
    rows = cut(df.select(F.lit("$").alias("path"), F.col(value).alias("v")))
    found = None
    while True:
        kind = F.regexp_extract(F.schema_of_variant("v"), r"^\w+", 0)
        counts = rows.groupBy("path", F.when(kind.startswith("DECIMAL"), "DOUBLE").otherwise(kind).alias("kind")).agg(F.count("*").alias("n"))
        found = cut(counts) if found is None else found.unionByName(cut(counts))
        of_list = F.transform(F.try_variant_get("v", "$", "array<variant>"), lambda x: F.struct(F.concat("path", F.lit("[]")).alias("path"), x.alias("v")))
        is_map = F.substring_index("path", ".", -1).isin(*maps)
        of_map = F.transform(F.map_entries(F.try_variant_get("v", "$", "map<string,variant>")), lambda e: F.struct(F.concat("path", F.lit("."), F.when(is_map, F.lit("*")).otherwise(e["key"])).alias("path"), e["value"].alias("v")))
        rows = cut(rows.select(F.explode(F.coalesce(of_list, of_map)).alias("r")).select("r.*"))
        if rows.isEmpty():
            break
    return found
