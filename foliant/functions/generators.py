"""User-supplied generator code: a check of its syntax tree, and a registry of checked functions.

Code is never run unless its author's trust is stated by registering it. It finds only the built-ins
and modules that are listed here, and of a module only what is public and no module itself; the check
refuses beforehand what could reach the system behind it.
"""

from __future__ import annotations

import ast
import builtins
import importlib
import json
from collections.abc import Callable, Iterator
from functools import lru_cache
from types import ModuleType, SimpleNamespace
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

# What generator code must not touch, and its size.
MODULES = frozenset({"os", "sys", "subprocess", "shutil", "pathlib", "socket", "http", "urllib", "requests", "ctypes", "multiprocessing", "threading", "pickle", "marshal", "importlib"})
CALLS = frozenset({"__import__", "eval", "exec", "compile", "open", "globals", "locals"})
MOST_BYTES = 256 * 1024
#: What it may import, and the built-ins that it finds.
IMPORTS = frozenset({"base64", "bisect", "calendar", "collections", "collections.abc", "copy", "dataclasses", "datetime", "decimal", "enum", "fractions", "functools", "hashlib", "html", "itertools", "json", "math", "operator", "re", "statistics", "string", "textwrap", "time", "typing", "unicodedata", "uuid"})
BUILTINS = (
    "abs all any ascii bin bool bytes callable chr classmethod complex dict divmod enumerate filter float format frozenset hash hex int isinstance issubclass iter len list map max min next object oct ord pow print property range repr reversed round set slice sorted "
    "staticmethod str sum super tuple type zip None True False NotImplemented Ellipsis ArithmeticError AssertionError AttributeError Exception IndexError KeyError LookupError NameError NotImplementedError OverflowError RuntimeError StopIteration TypeError UnicodeError ValueError ZeroDivisionError __build_class__"
).split()


def violations(code: str) -> list[str]:
    """What is wrong with generator code; empty if nothing is."""
    if len(code) > MOST_BYTES:
        return ["size"]
    try:
        tree = ast.parse(code)
    except (SyntaxError, ValueError, RecursionError):
        return ["syntax"]
    found = []
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            found += [f"import {a.name}" for a in node.names if a.name not in IMPORTS]
        if isinstance(node, ast.ImportFrom) and (node.level or node.module not in IMPORTS):
            found.append(f"import {node.module or '.'}")
        if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and node.func.id in CALLS:
            found.append(f"call {node.func.id}")
        if isinstance(node, ast.Attribute) and node.attr.startswith("__") and node.attr.endswith("__"):
            found.append(f"attribute {node.attr}")
    return found


def _open_part(name: str) -> SimpleNamespace:
    """What generator code sees of a module: its public names that are no modules, and those of its submodules that may be imported."""
    module = importlib.import_module(name)
    seen = {k: v for k, v in vars(module).items() if not k.startswith("_") and not isinstance(v, ModuleType)}
    below = {n.removeprefix(f"{name}."): _open_part(n) for n in IMPORTS if n.startswith(f"{name}.")}
    return SimpleNamespace(**(seen | below))


def _imported(name: str, _globals: Any = None, _locals: Any = None, fromlist: tuple = (), level: int = 0) -> SimpleNamespace:
    if level or name not in IMPORTS:
        raise ImportError(f"{name} may not be imported")
    return _open_part(name if fromlist else name.split(".")[0])


def register(spark: SparkSession, name: str, function: Callable, returns: str, source: str) -> None:
    """Makes a function available to SQL if its source passes the check."""
    wrong = violations(source)
    if wrong:
        raise ValueError("; ".join(wrong[:5]))
    spark.udf.register(name, function, returns)


@lru_cache(maxsize=32)
def maker_of(code: str) -> Callable[[dict], Any]:
    """What checked code makes of a dictionary: by its function generate, else by the first of its classes with such a method.

    Without code, the dictionary as JSON.
    """
    if not code.strip():
        return lambda data: json.dumps(data, ensure_ascii=False, indent=2)
    wrong = violations(code)
    if wrong:
        raise ValueError("; ".join(wrong[:5]))
    names: dict = {"__name__": "generator", "__builtins__": {n: getattr(builtins, n) for n in BUILTINS} | {"__import__": _imported}}
    exec(compile(code, "<generator>", "exec"), names)  # noqa: S102 - the caller has said that the author is trusted
    function = names.get("generate")
    if callable(function):
        return function
    for kind in names.values():
        if isinstance(kind, type) and callable(getattr(kind, "generate", None)):
            return lambda data: kind(data).generate()
    raise ValueError("no generate(data) and no class with generate()")


def _trusted(code: str, trusted: bool) -> None:
    """Raises where code may not be run: its author is not trusted, or it does not pass the check."""
    if code.strip() and not trusted:
        raise ValueError("say trusted=True to run generator code")
    maker_of(code)


def _error(e: Exception) -> str:
    return f"{type(e).__name__}: {e}"


def generated(table: DataFrame, code: str = "", data: str = "data", trusted: bool = False) -> DataFrame:
    """table with document, what the code makes of each row's data (a JSON object), and error, why there is none.

    Code other than the default is only run if its author is said to be trusted and it passes the check.
    """
    _trusted(code, trusted)

    @F.arrow_udf(StructType([StructField("document", StringType()), StructField("error", StringType())]))
    def made(column: pa.Array) -> pa.Array:
        make, out = maker_of(code), []
        for text in column.to_pylist():
            try:
                result = make(json.loads(text or "{}"))
                out.append({"document": result, "error": None} if isinstance(result, str) else {"document": None, "error": f"{type(result).__name__} instead of str"})
            except Exception as e:  # what a user's code raises is a result of its row
                out.append({"document": None, "error": _error(e)})
        return pa.array(out, pa.struct([("document", pa.string()), ("error", pa.string())]))

    return table.withColumn("_made", made(F.col(data))).select(*table.columns, "_made.document", "_made.error")


def generated_rows(table: DataFrame, code: str, data: str = "data", trusted: bool = False) -> DataFrame:
    """table with part, document and error: a row for each text that the code makes of a row's data, which gives a text or any number of them.

    Parts count from 0; what was made before an error stays. A row without any part is one with nulls.
    """
    _trusted(code, trusted)

    class Parts:
        def eval(self, text: str) -> Iterator[tuple]:
            part = 0
            try:
                result = maker_of(code)(json.loads(text or "{}"))
                for document in [result] if isinstance(result, str) else result:
                    if not isinstance(document, str):
                        yield part, None, f"{type(document).__name__} instead of str"
                    else:
                        yield part, document, None
                    part += 1
            except Exception as e:  # as above
                yield part, None, _error(e)

    parts = F.udtf(Parts, returnType="part int, document string, error string")
    return table.lateralJoin(parts(F.col(data).outer()), on=F.lit(True), how="left")


def checked(templates: DataFrame, code: str = "code") -> DataFrame:
    """templates with problems, what is wrong with their code, joined; empty where nothing is."""

    @F.arrow_udf(StringType())
    def problems(column: pa.Array) -> pa.Array:
        return pa.array([";".join(violations(x)) if x else "" for x in column.to_pylist()], pa.string())

    return templates.withColumn("problems", problems(F.col(code)))
