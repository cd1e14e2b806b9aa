"""Units, calls and complexity of Python and JavaScript sources."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftstone.functions.lineage import dealt

UNIT = "path string, id string, name string, type string, start_line int, end_line int, signature string, docstring string, parent_class string, decorators array<string>, parameters array<string>, calls array<string>, bases array<string>, is_async boolean, is_private boolean, is_test boolean, complexity int"
_BRANCHES = (ast.If, ast.While, ast.For, ast.ExceptHandler, ast.ListComp, ast.DictComp, ast.SetComp, ast.GeneratorExp)


def complexity(node: ast.AST) -> int:
    """One, and one more for each branch, comprehension and further operand."""
    return 1 + sum(len(n.values) - 1 if isinstance(n, ast.BoolOp) else isinstance(n, _BRANCHES) for n in ast.walk(node))


def called(node: ast.AST) -> list[str]:
    names = {getattr(n.func, "id", None) or getattr(n.func, "attr", None) for n in ast.walk(node) if isinstance(n, ast.Call)}
    return sorted(n for n in names if n)


def parameters(args: ast.arguments) -> list[str]:
    """Names with types; defaults are marked, star arguments keep their stars."""
    plain = [*args.posonlyargs, *args.args]
    with_default = len(plain) - len(args.defaults)
    typed = lambda a: a.arg + (f": {ast.unparse(a.annotation)}" if a.annotation else "")
    out = [typed(a) + (" = ..." if i >= with_default else "") for i, a in enumerate(plain)]
    if args.vararg:
        out.append("*" + typed(args.vararg))
    out += [typed(a) + (" = ..." if d is not None else "") for a, d in zip(args.kwonlyargs, args.kw_defaults)]
    if args.kwarg:
        out.append("**" + typed(args.kwarg))
    return out


def units_of(path: str, source: str) -> list[dict]:
    """Classes, functions, methods, properties and upper-case constants of a
    module; none if it does not parse."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError):
        return []
    found = []

    def unit(node: ast.AST, name: str, kind: str, owner: str | None = None, **more) -> None:
        own = f"{owner}.{name}" if owner else name
        blank = {"signature": None, "docstring": None, "decorators": [], "parameters": [], "calls": [], "bases": [], "is_async": False, "is_private": False, "is_test": False, "complexity": None}
        found.append({"path": path, "id": f"{path}::{own}", "name": name, "type": kind, "start_line": node.lineno, "end_line": node.end_lineno or node.lineno, "parent_class": owner, **blank, **more})

    def function(node: ast.FunctionDef | ast.AsyncFunctionDef, owner: str | None = None) -> None:
        is_async = isinstance(node, ast.AsyncFunctionDef)
        marks = [ast.unparse(d.func if isinstance(d, ast.Call) else d) for d in node.decorator_list]
        kind = ("property" if "property" in marks else "method") if owner else "async_function" if is_async else "function"
        args = parameters(node.args)
        returns = f" -> {ast.unparse(node.returns)}" if node.returns else ""
        unit(node, node.name, kind, owner, signature=f"{'async ' * is_async}def {node.name}({', '.join(args)}){returns}", docstring=ast.get_docstring(node), decorators=marks, parameters=args, calls=called(node),
             is_async=is_async, is_private=node.name.startswith("_") and not node.name.startswith("__"), is_test=node.name.startswith("test"), complexity=complexity(node))

    for node in tree.body:
        if isinstance(node, ast.ClassDef):
            bases = [ast.unparse(b) for b in node.bases if isinstance(b, (ast.Name, ast.Attribute))]
            unit(node, node.name, "class", signature=f"class {node.name}" + (f"({', '.join(bases)})" if bases else ""), docstring=ast.get_docstring(node), bases=bases, calls=called(node),
                 decorators=[ast.unparse(d.func if isinstance(d, ast.Call) else d) for d in node.decorator_list], is_private=node.name.startswith("_"), is_test=node.name.startswith("Test") or node.name.endswith("Test"))
            for child in node.body:
                if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef)):
                    function(child, node.name)
        elif isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            function(node)
        elif isinstance(node, ast.Assign):
            for target in node.targets:
                if isinstance(target, ast.Name) and target.id.isupper():
                    unit(node, target.id, "constant")
    return found


def imports_of(path: str, source: str) -> list[dict]:
    """Imported modules: (path, module, names, level)."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError):
        return []
    out = []
    for n in ast.walk(tree):
        if isinstance(n, ast.Import):
            out += [{"path": path, "module": a.name, "names": [], "level": 0} for a in n.names]
        elif isinstance(n, ast.ImportFrom):
            out.append({"path": path, "module": n.module, "names": [a.name for a in n.names], "level": n.level})
    return out


def parse_units(files: DataFrame) -> DataFrame:
    """Files (path, source) to units, a row each."""
    kinds = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}
    schema = pa.schema([(p.split(" ")[0], kinds[p.split(" ")[1]]) for p in UNIT.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pylist([u for p, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for u in units_of(p, s or "")], schema=schema)

    return dealt(files.select("path", "source"), "path").mapInArrow(run, UNIT)


def script_units(files: DataFrame) -> DataFrame:
    """Functions, arrow functions and classes of JavaScript or TypeScript, by
    pattern: (path, name, type)."""
    patterns = {"function": r"(?m)^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*([A-Za-z_$][\w$]*)", "arrow": r"(?m)^\s*(?:export\s+)?(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*=\s*(?:async\s*)?\(?[^=\n]*\)?\s*=>", "class": r"(?m)^\s*(?:export\s+)?(?:default\s+)?class\s+([A-Za-z_$][\w$]*)"}
    found = [files.select("path", F.explode(F.regexp_extract_all("source", F.lit(p), F.lit(1))).alias("name"), F.lit(k).alias("type")) for k, p in patterns.items()]
    return found[0].unionByName(found[1]).unionByName(found[2])


def code_edges(units: DataFrame) -> DataFrame:
    """Calls, extends, contains and tests between units, by name."""
    named = units.select(F.col("id").alias("target"), "name", "type")
    edge = lambda df, kind: df.select("source", "target", F.lit(kind).alias("type"), F.lit(1.0).alias("weight")).where("source <> target")
    body = units.where("type not in ('class', 'constant')").select(F.col("id").alias("source"), F.explode("calls").alias("name"))
    calls = edge(body.join(named.where("type <> 'constant'").drop("type"), "name"), "calls")
    extends = edge(units.select(F.col("id").alias("source"), F.explode("bases").alias("name")).join(named.where("type = 'class'").drop("type"), "name"), "extends")
    owners = units.where("type = 'class'").select(F.col("id").alias("source"), "path", F.col("name").alias("parent_class"))
    contains = edge(units.where("parent_class is not null").select(F.col("id").alias("target"), "path", "parent_class").join(owners, ["path", "parent_class"]), "contains")
    tested = units.where("is_test and type <> 'class'").select(F.col("id").alias("source"), F.regexp_replace("name", "^test_?", "").alias("name")).where("name <> ''")
    tests = edge(tested.join(named.drop("type"), "name"), "tests")
    return calls.unionByName(extends).unionByName(contains).unionByName(tests)


def find_symbol(units: DataFrame, name: str, fuzzy: bool = False) -> DataFrame:
    """Units of that name, or whose name contains it or is two edits away."""
    c = F.lower("name")
    return units.where((c.contains(name.lower())) | (F.levenshtein(c, F.lit(name.lower())) <= 2)) if fuzzy else units.where(F.col("name") == name)


def parse_imports(files: DataFrame) -> DataFrame:
    """(path, module, names, level) of the imports of Python files."""
    schema = pa.schema([("path", pa.string()), ("module", pa.string()), ("names", pa.list_(pa.string())), ("level", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pylist([i for p, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for i in imports_of(p, s or "")], schema=schema)

    return dealt(files.select("path", "source"), "path").mapInArrow(run, "path string, module string, names array<string>, level int")


def script_imports(files: DataFrame) -> DataFrame:
    """(path, module) of the imports and requires of JavaScript or TypeScript."""
    pattern = r"""(?:\bfrom\s*|\bimport\s*\(?\s*|\brequire\s*\(\s*)['"]([^'"\n]+)['"]"""
    return files.select("path", F.explode(F.array_distinct(F.regexp_extract_all("source", F.lit(pattern), F.lit(1)))).alias("module"))


def importers(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(path, importer): which files import a file, by its dotted path (or that
    of its folder, for ``__init__``)."""
    dotted = F.regexp_replace(F.regexp_replace(F.regexp_replace("path", r"\.\w+$", ""), "/__init__$", ""), "/", ".")
    return files.select("path", dotted.alias("module")).join(imports.select(F.col("path").alias("importer"), "module").distinct(), "module").where("path <> importer").select("path", "importer")


def file_summary(units: DataFrame, imports: DataFrame | None = None) -> DataFrame:
    """Names of classes, functions and methods of each file, and with its
    imports also these and the files that import it."""
    names = lambda kinds: F.array_sort(F.collect_list(F.when(F.col("type").isin(*kinds), F.col("name"))))
    out = units.groupBy("path").agg(names(["class"]).alias("classes"), names(["function", "async_function"]).alias("functions"), names(["method", "property"]).alias("methods"))
    if imports is None:
        return out
    none = F.array().cast("array<string>")
    mine = imports.groupBy("path").agg(F.array_sort(F.collect_set("module")).alias("imports"))
    theirs = importers(imports, out.select("path")).groupBy("path").agg(F.array_sort(F.collect_set("importer")).alias("importers"))
    out = out.join(mine, "path", "left").join(theirs, "path", "left")
    return out.withColumns({c: F.coalesce(c, none) for c in ("imports", "importers")})
