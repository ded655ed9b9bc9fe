"""Functions on program text, as pandas functions over Arrow batches: the syntax tree has no counterpart in the JVM."""

from __future__ import annotations

import ast
import io
import sys
import tokenize
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructType

#: Calls that a program must not make, and modules that it must not import.
FORBIDDEN_CALLS = ("open", "eval", "exec", "compile", "__import__", "input", "breakpoint")
FORBIDDEN_MODULES = (
    "asyncio", "ftplib", "http", "multiprocessing", "os", "pathlib", "shutil", "smtplib", "socket", "subprocess", "tempfile",
    "urllib", "webbrowser",
)
FACTS = ("parses", "docstring", "loose_string", "top_assert", "forbidden_call", "forbidden_import")


def _struct(kind, *names: str) -> StructType:
    out = StructType()
    for n in names:
        out = out.add(n, kind)
    return out


def _tree(source: str | None) -> ast.Module | None:
    try:
        return ast.parse(source) if source is not None else None
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None


def allowed_module(name: str | None) -> bool:
    """Whether a module belongs to the standard library and is not forbidden."""
    root = (name or "").partition(".")[0]
    return root in sys.stdlib_module_names and root not in FORBIDDEN_MODULES


def _imports(tree: ast.Module) -> Iterator[str | None]:
    """Modules that a program imports; None for one relative to its own place."""
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            yield from (a.name for a in node.names)
        elif isinstance(node, ast.ImportFrom):
            yield None if node.level else node.module


def _facts(source: str | None) -> tuple:
    tree = _tree(source)
    if tree is None:
        return (False,) * len(FACTS)
    scopes = [n for n in ast.walk(tree) if isinstance(n, (ast.Module, ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef))]
    # Text of the module itself that is not its docstring.
    loose = [n for n in tree.body[1:] if isinstance(n, ast.Expr) and isinstance(n.value, ast.Constant) and isinstance(n.value.value, str)]
    calls = [n for n in ast.walk(tree) if isinstance(n, ast.Call) and isinstance(n.func, ast.Name)]
    return (
        True,
        any(ast.get_docstring(n, clean=False) is not None for n in scopes),
        bool(loose),
        any(isinstance(n, ast.Assert) for n in tree.body),
        any(n.func.id in FORBIDDEN_CALLS for n in calls),
        any(not allowed_module(m) for m in _imports(tree)),
    )


@F.pandas_udf(_struct(BooleanType(), *FACTS))
def source_facts(source: pd.Series) -> pd.DataFrame:
    """What a program text holds; all false when it does not parse, which includes null."""
    return pd.DataFrame([_facts(s) for s in source], columns=list(FACTS))


class _Shape(ast.NodeVisitor):
    """A syntax tree without names and values."""

    def __init__(self, target: str | None):
        self.target = target

    def shape(self, node: ast.AST) -> str:
        if isinstance(node, ast.Name):
            return "TARGET" if node.id == self.target else "NAME"
        if isinstance(node, ast.Constant):
            return type(node.value).__name__
        if isinstance(node, ast.Attribute):
            return f"{self.shape(node.value)}.ATTR"
        inner = []
        for _, value in ast.iter_fields(node):
            for x in value if isinstance(value, list) else [value]:
                if isinstance(x, ast.AST) and not isinstance(x, ast.expr_context):
                    inner.append(self.shape(x))
        return f"{type(node).__name__}({','.join(inner)})" if inner else type(node).__name__


def _tests(text: str) -> list[tuple[str, ast.Module | None]]:
    """The lines of a text that are not blank, each with its syntax tree."""
    return [(line.strip(), _tree(line.strip())) for line in text.split("\n") if line.strip()]


def assertion_shapes(text: str | None, target: str | None) -> list[str] | None:
    """One form per assert statement in the text, in order, without names, attributes and values.

    A line without an assert statement has the form of its whole, one that does not parse is ``SYNTAX_ERROR``.
    """
    if text is None:
        return None
    out, shape = [], _Shape(target).shape
    for _, tree in _tests(text):
        asserts = [n for n in tree.body if isinstance(n, ast.Assert)] if tree else []
        out += [shape(n.test) for n in asserts] or [shape(tree) if tree else "SYNTAX_ERROR"]
    return out


@F.pandas_udf(ArrayType(StringType()))
def assertion_structures(text: pd.Series, target: pd.Series) -> pd.Series:
    return pd.Series([assertion_shapes(t, n) for t, n in zip(text, target)])


class _Rename(ast.NodeTransformer):
    def __init__(self, target: str):
        self.target = target

    def visit_Name(self, node: ast.Name) -> ast.Name:
        return ast.Name(id="target", ctx=node.ctx) if node.id == self.target else node


def normal_assertions(text: str | None, target: str | None) -> list[str] | None:
    """Each assert statement in one layout, with the tested function under one name, beside ``assertion_shapes``.

    A line without an assert statement is laid out as a whole; one that does not parse stays as it is.
    """
    if text is None:
        return None
    out = []
    for line, tree in _tests(text):
        renamed = _Rename(target or "").visit(tree) if tree else None
        asserts = [n for n in renamed.body if isinstance(n, ast.Assert)] if renamed else []
        out += [ast.unparse(n) for n in asserts] or [ast.unparse(renamed) if renamed else line]
    return out


@F.pandas_udf(ArrayType(StringType()))
def normalised_assertions(text: pd.Series, target: pd.Series) -> pd.Series:
    return pd.Series([normal_assertions(t, n) for t, n in zip(text, target)])


@F.pandas_udf(_struct(StringType(), "name", "signature").add("parameters", IntegerType()))
def first_function(source: pd.Series) -> pd.DataFrame:
    """Name, signature and number of parameters of the first function; nulls when there is none."""
    rows = []
    for s in source:
        tree = _tree(s)
        node = next((n for n in (tree.body if tree else []) if isinstance(n, ast.FunctionDef)), None)
        if node is None:
            rows.append((None, None, None))
        else:
            a = node.args
            count = len(a.posonlyargs) + len(a.args) + len(a.kwonlyargs) + bool(a.vararg) + bool(a.kwarg)
            rows.append((node.name, f"def {node.name}({ast.unparse(a)})", count))
    return pd.DataFrame(rows, columns=["name", "signature", "parameters"]).astype({"parameters": "Int32"})


@F.pandas_udf(_struct(IntegerType(), "comment_tokens", "comment_lines"))
def comment_counts(source: pd.Series) -> pd.DataFrame:
    """Comments and the lines that hold one; what was counted before an error in the text stays."""
    rows = []
    for s in source:
        tokens, lines = 0, set()
        try:
            for t in tokenize.generate_tokens(io.StringIO(s or "").readline):
                if t.type == tokenize.COMMENT:
                    tokens += 1
                    lines.add(t.start[0])
        except (tokenize.TokenError, SyntaxError, IndentationError):
            pass
        rows.append((tokens, len(lines)))
    return pd.DataFrame(rows, columns=["comment_tokens", "comment_lines"], dtype="int32")
