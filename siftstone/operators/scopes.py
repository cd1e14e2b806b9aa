"""Calls and bases of Python sources, resolved by scope.

A name means what its file says it means: a definition there, else what an import
binds it to, through as many files as pass it on, else a star import.  ``self`` and
``super()`` look along the method order of the class they stand in, a class name or a
variable made by calling one along that class's.  What cannot be known from the text (an
attribute of anything else, a name that is a parameter) gives no edge, so a call
never meets its namesakes in other files.

The parser is a small helper that lists names, a file at a time.  The resolution is
joins on (module, name) and (class, method), whose one side holds each key once, so that
a module that all files import costs a row a use.  Imports that pass names on, and the
orders of classes whose bases are known, are found in rounds until one finds nothing;
each round is written, and rings of imports or bases end by themselves.
"""

from __future__ import annotations

import ast
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftstone.functions.lineage import dealt, kept
from siftstone.operators.code import parse_units

FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)
SITES = "path string, caller string, owner string, kind string, receiver string, name string"
BINDINGS = "path string, alias string, level int, module string, member string"


def _rows(schema: str, of: Callable[[str, str], list[dict]]):
    names = [f.split(" ") for f in schema.split(", ")]
    arrow = pa.schema([(n, pa.int32() if t == "int" else pa.string()) for n, t in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pylist([r for p, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for r in of(p, s or "")], schema=arrow)

    return run


def _tree(source: str) -> ast.Module:
    try:
        return ast.parse(source)
    except (SyntaxError, ValueError):
        return ast.Module([], [])


def dotted(node: ast.AST) -> str | None:
    """``a.b.c`` of names and attributes alone."""
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Attribute):
        before = dotted(node.value)
        return before and f"{before}.{node.attr}"
    return None


def sites_of(path: str, source: str) -> list[dict]:
    """Calls in functions and methods, each form once a caller: kind name (``f()``), self, super,
    dotted (``a.b.f()``) or instance (``x.f()`` after ``x = A()``)."""
    found = {}

    def body(node: ast.AST, owner: str | None) -> None:
        caller = f"{path}::{owner + '.' if owner else ''}{node.name}"
        args = [a.arg for a in (*node.args.posonlyargs, *node.args.args, *node.args.kwonlyargs, node.args.vararg, node.args.kwarg) if a]
        me = args[0] if owner and args else None
        made: dict[str, set[str | None]] = {a: {None} for a in args}
        for n in ast.walk(node):
            if isinstance(n, ast.Assign):
                value = dotted(n.value.func) if isinstance(n.value, ast.Call) else None
                for t in n.targets:
                    for x in ast.walk(t):
                        if isinstance(x, ast.Name) and isinstance(x.ctx, ast.Store):
                            made.setdefault(x.id, set()).add(value if x is t else None)
            elif isinstance(n, ast.Name) and isinstance(n.ctx, ast.Store):
                made.setdefault(n.id, set())
        for n in ast.walk(node):
            if not isinstance(n, ast.Call):
                continue
            kind = receiver = None
            if isinstance(n.func, ast.Name):
                kind, name = ("name", n.func.id) if n.func.id not in made else (None, None)
            elif isinstance(n.func, ast.Attribute):
                name, value = n.func.attr, n.func.value
                if isinstance(value, ast.Call) and isinstance(value.func, ast.Name) and value.func.id == "super":
                    kind = "super"
                elif isinstance(value, ast.Call):
                    kind, receiver = "instance", dotted(value.func)
                elif isinstance(value, ast.Name) and value.id == me:
                    kind = "self"
                elif isinstance(value, ast.Name) and value.id in made:
                    kind, receiver = "instance", next(iter(made[value.id])) if len(made[value.id]) == 1 else None
                else:
                    kind, receiver = "dotted", dotted(value)
                if kind in ("instance", "dotted") and receiver is None:
                    kind = None
            if kind:
                found[caller, kind, receiver, name] = {"path": path, "caller": caller, "owner": owner, "kind": kind, "receiver": receiver, "name": name}

    for node in _tree(source).body:
        if isinstance(node, FUNCTIONS):
            body(node, None)
        elif isinstance(node, ast.ClassDef):
            for child in node.body:
                if isinstance(child, FUNCTIONS):
                    body(child, node.name)
    return list(found.values())


def bindings_of(path: str, source: str) -> list[dict]:
    """What imports bind: ``alias`` to a module, or to a member of one ("*": all)."""
    out = []
    for n in ast.walk(_tree(source)):
        if isinstance(n, ast.Import):
            out += [{"path": path, "alias": a.asname or a.name, "level": 0, "module": a.name, "member": None} for a in n.names]
        elif isinstance(n, ast.ImportFrom):
            out += [{"path": path, "alias": a.asname or a.name, "level": n.level, "module": n.module or "", "member": a.name} for a in n.names]
    return out


def module_of(path: Column) -> Column:
    """The dotted name of a file, or of its folder for ``__init__``."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(path, r"\.\w+$", ""), "(^|/)__init__$", ""), "/", ".")


def linear(own: str, orders: list[list[str]]) -> list[str] | None:
    """The method order of a class from those of its bases, in their order: each
    next is a head that stands in no other list's rest; None if there is none."""
    out, left = [own], [list(o) for o in (*orders, [o[0] for o in orders]) if o]
    while left:
        head = next((o[0] for o in left if not any(o[0] in p[1:] for p in left)), None)
        if head is None:
            return None
        out.append(head)
        left = [p for p in ([x for x in o if x != head] for o in left) if p]
    return out


def _linear(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(c, linear(c, [b["mro"] for b in sorted(bases, key=lambda b: b["place"])]) or [c]) for c, bases in zip(*(batch.column(i).to_pylist() for i in range(2)))]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.list_(pa.string()))], ["class_id", "mro"])


class Scopes:
    """What names mean in files (path, source)."""

    def __init__(self, files: DataFrame):
        files = files.select("path", "source")
        self.units = kept(parse_units(files).select("path", "id", "name", "type", "parent_class", "bases").dropDuplicates(["id"]))
        modules = kept(files.select("path", module_of(F.col("path")).alias("own")).groupBy("own").agg(F.min("path").alias("path")))
        self.modules = modules
        bound = dealt(files, "path").mapInArrow(_rows(BINDINGS, bindings_of), BINDINGS).join(modules, "path")
        # A relative import starts at the file's package and goes up a package a further dot.
        parts = F.split("own", r"\.")
        package = F.when(F.col("path").rlike(r"(^|/)__init__\.\w+$"), parts).otherwise(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))))
        up = F.array_join(F.slice(package, 1, F.greatest(F.size(package) - F.col("level") + 1, F.lit(0))), ".")
        module = F.when(F.col("level") == 0, F.col("module")).when(F.col("module") == "", up).when(up == "", F.col("module")).otherwise(F.concat_ws(".", up, "module"))
        bound = bound.select("path", "own", "alias", module.alias("module"), "member")
        # ``from package import module`` binds a module, where there is one of that name.
        inner = modules.select(F.col("own").alias("module_member"))
        whole = F.when(F.col("module") == "", F.col("member")).otherwise(F.concat_ws(".", "module", "member"))
        bound = bound.withColumn("of", whole).join(inner, F.col("of") == F.col("module_member"), "left")
        self.aliases = kept(bound.select("path", "alias", F.when(F.col("member").isNull(), F.col("module")).otherwise(F.col("module_member")).alias("module")).where("module is not null").groupBy("path", "alias").agg(F.min("module").alias("module")))
        self.names = self._names(bound.where("member is not null and module_member is null"), modules)
        self.orders = self._orders()

    def _names(self, links: DataFrame, modules: DataFrame) -> DataFrame:
        """(own, name, id): what a name at the top of a module means, each once."""
        top = self.units.where("parent_class is null and type <> 'constant'").join(modules, "path").select("own", "name", "id")
        known = fresh = kept(top.groupBy("own", "name").agg(F.min("id").alias("id")))
        named = kept(links.where("member <> '*'").select("own", "alias", "module", "member").distinct())
        stars = kept(links.where("member = '*'").select("own", "module").distinct())
        while True:
            by_name = named.join(fresh.select(F.col("own").alias("module"), F.col("name").alias("member"), "id"), ["module", "member"]).select("own", F.col("alias").alias("name"), "id", F.lit(0).alias("star"))
            by_star = stars.join(fresh.where("name not like '\\\\_%'").select(F.col("own").alias("module"), "name", "id"), "module").select("own", "name", "id", F.lit(1).alias("star"))
            found = by_name.unionByName(by_star).join(known, ["own", "name"], "left_anti")
            fresh = kept(found.groupBy("own", "name").agg(F.min(F.struct("star", "id")).alias("x")).select("own", "name", F.col("x.id").alias("id")))
            if fresh.isEmpty():
                return known
            known = kept(known.unionByName(fresh))

    def members(self, rows: DataFrame, receiver: str, name: str) -> DataFrame:
        """``rows`` (path, ...) with ``target``: what receiver.name means where the
        receiver is a module's alias."""
        aliases = self.aliases.select("path", F.col("alias").alias(receiver), F.col("module").alias("own"))
        names = self.names.select("own", F.col("name").alias(name), F.col("id").alias("target"))
        return rows.join(aliases, ["path", receiver]).join(names, ["own", name]).drop("own")

    def plain(self, rows: DataFrame, name: str) -> DataFrame:
        """``rows`` (path, ...) with ``target``: what the bare name means in the file."""
        names = self.names.select("own", F.col("name").alias(name), F.col("id").alias("target"))
        return rows.join(self.modules, "path").join(names, ["own", name]).drop("own")

    def any(self, rows: DataFrame, expression: str) -> DataFrame:
        """``rows`` with ``target`` of a dotted expression."""
        cut = rows.withColumns({"cut_from": F.regexp_extract(expression, r"^(.*)\.[^.]+$", 1), "cut_name": F.regexp_extract(expression, r"([^.]+)$", 1)})
        one = self.plain(cut.where("cut_from = ''"), "cut_name").drop("cut_from", "cut_name")
        return one.unionByName(self.members(cut.where("cut_from <> ''"), "cut_from", "cut_name").drop("cut_from", "cut_name"))

    def extends(self) -> DataFrame:
        """(class_id, place, base_id) of the bases that are known."""
        classes = self.units.where("type = 'class'").select("path", F.col("id").alias("class_id"), F.posexplode("bases").alias("place", "base"))
        ids = self.units.where("type = 'class'").select(F.col("id").alias("base_id"))
        return self.any(classes, "base").select("class_id", "place", F.col("target").alias("base_id")).join(ids, "base_id", "left_semi").where("class_id <> base_id")

    def _orders(self) -> DataFrame:
        """(class_id, place, ancestor): method orders, the class itself at place 0."""
        bases = kept(self.extends())
        classes = self.units.where("type = 'class'").select(F.col("id").alias("class_id"))
        done = kept(classes.join(bases, "class_id", "left_anti").select("class_id", F.array("class_id").alias("mro")))
        counts = kept(bases.groupBy("class_id").agg(F.count(F.lit(1)).alias("n")))
        while True:
            ready = bases.join(done.select("class_id").withColumnRenamed("class_id", "known"), bases.class_id == F.col("known"), "left_anti")
            ready = ready.join(done.select(F.col("class_id").alias("base_id"), "mro"), "base_id").groupBy("class_id").agg(F.collect_list(F.struct("place", "mro")).alias("orders"))
            ready = ready.join(counts, "class_id").where(F.size("orders") == F.col("n")).select("class_id", "orders")
            fresh = kept(ready.mapInArrow(_linear, "class_id string, mro array<string>"))
            if fresh.isEmpty():
                break
            done = kept(done.unionByName(fresh))
        ring = classes.join(done, "class_id", "left_anti").select("class_id", F.array("class_id").alias("mro"))
        return kept(done.unionByName(ring).select("class_id", F.posexplode("mro").alias("place", "ancestor")))

    def methods(self, rows: DataFrame, above: int = 0) -> DataFrame:
        """``rows`` (class_id, name, ...) with ``target``: the first method of that name in
        the class's order, from place ``above`` on."""
        own = self.units.where("parent_class is not null").select(F.concat_ws("::", "path", "parent_class").alias("ancestor"), F.col("name"), F.col("id").alias("target"))
        asked = rows.select("class_id", "name").distinct()
        found = asked.join(self.orders.where(F.col("place") >= above), "class_id").join(own, ["ancestor", "name"]).groupBy("class_id", "name").agg(F.min_by("target", "place").alias("target"))
        return rows.join(found, ["class_id", "name"])

    def calls(self, files: DataFrame) -> DataFrame:
        """(source, target): calls between units."""
        sites = kept(dealt(files.select("path", "source"), "path").mapInArrow(_rows(SITES, sites_of), SITES))
        own = sites.where("kind in ('self', 'super')").withColumn("class_id", F.concat_ws("::", "path", "owner"))
        through = sites.where("kind in ('dotted', 'instance')")
        classes = self.any(through, "receiver").withColumnRenamed("target", "class_id")
        found = [self.plain(sites.where("kind = 'name'"), "name"), self.members(sites.where("kind = 'dotted'"), "receiver", "name"),
                 self.methods(own.where("kind = 'self'")), self.methods(own.where("kind = 'super'"), 1), self.methods(classes)]
        out = found[0].select("caller", "target")
        for f in found[1:]:
            out = out.unionByName(f.select("caller", "target"))
        return out.where("caller <> target").distinct().select(F.col("caller").alias("source"), "target")


def scoped_edges(files: DataFrame) -> DataFrame:
    """Calls, extends and contains between units: (source, target, type)."""
    scopes = Scopes(files)
    extends = scopes.extends().select(F.col("class_id").alias("source"), F.col("base_id").alias("target"), F.lit("extends").alias("type")).distinct()
    inside = scopes.units.where("parent_class is not null").select(F.concat_ws("::", "path", "parent_class").alias("source"), F.col("id").alias("target"), F.lit("contains").alias("type"))
    return scopes.calls(files).withColumn("type", F.lit("calls")).unionByName(extends).unionByName(inside)
