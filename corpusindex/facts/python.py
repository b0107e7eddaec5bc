"""Facts of Python sources, from the language's own syntax tree."""

from __future__ import annotations

import ast
import re
import textwrap

from pyspark.sql import DataFrame

from corpusindex.facts.blank import blanked, extracted

CALLABLE = "name:string,async:boolean,sig:string,decorators:array<string>,deps:array<string>,line:int"
FACT = (
    "repo string, path string, hash string, parse_error string, "
    f"types array<struct<name:string,bases:array<string>,decorators:array<string>,methods:array<struct<{CALLABLE}>>,fields:array<struct<name:string,type:string>>,line:int>>, "
    f"functions array<struct<{CALLABLE}>>, assigns array<struct<name:string,value:string,line:int>>"
)


def _depends(node: ast.AST | None) -> list[str]:
    """Names inside Depends(...) calls, in order."""
    if node is None:
        return []
    calls = [n for n in ast.walk(node) if isinstance(n, ast.Call) and ast.unparse(n.func).split(".")[-1] == "Depends" and n.args]
    return [ast.unparse(c.args[0]) for c in calls]


def _callable(node) -> dict:
    args = node.args
    each = [*args.posonlyargs, *args.args, *args.kwonlyargs]
    deps = [d for part in (*[a.annotation for a in each], *args.defaults, *[d for d in args.kw_defaults if d]) for d in _depends(part)]
    returns = f" -> {ast.unparse(node.returns)}" if node.returns else ""
    return {
        "name": node.name, "async": isinstance(node, ast.AsyncFunctionDef), "sig": f"({ast.unparse(args)}){returns}",
        "decorators": ["@" + ast.unparse(d) for d in node.decorator_list], "deps": list(dict.fromkeys(deps)), "line": node.lineno,
    }


FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)


def _facts_of(body: list, found: dict) -> None:
    for node in body:
        if isinstance(node, FUNCTIONS):
            found["functions"].append(_callable(node))
        elif isinstance(node, ast.ClassDef):
            found["types"].append(_class(node))
        elif isinstance(node, (ast.Assign, ast.AnnAssign)) and node.value is not None:
            target = node.targets[0] if isinstance(node, ast.Assign) else node.target
            if isinstance(target, ast.Name):
                found["assigns"].append({"name": target.id, "value": ast.unparse(node.value), "line": node.lineno})


def _class(node: ast.ClassDef) -> dict:
    fields = []
    for inner in node.body:
        if isinstance(inner, ast.AnnAssign) and isinstance(inner.target, ast.Name):
            fields.append({"name": inner.target.id, "type": ast.unparse(inner.annotation)})
        elif isinstance(inner, ast.Assign) and isinstance(inner.targets[0], ast.Name):
            value = inner.value.func if isinstance(inner.value, ast.Call) else inner.value
            fields.append({"name": inner.targets[0].id, "type": ast.unparse(value)})
    return {
        "name": node.name, "bases": [ast.unparse(b) for b in node.bases], "decorators": ["@" + ast.unparse(d) for d in node.decorator_list],
        "methods": [_callable(n) for n in node.body if isinstance(n, FUNCTIONS)], "fields": fields, "line": node.lineno,
    }


HEAD = re.compile(r"\s*(?:async\s+def|def|class)\b")


def _statements(lines: list[str], code: list[str], low: int, high: int):
    """(first, last) of the statements between two lines: each begins at the least indentation, decorators at their own."""
    indents = [len(c) - len(c.lstrip()) if c.strip() else None for c in code[low:high]]
    least = min((i for i in indents if i is not None), default=0)
    start, depth, decorated = None, 0, False
    for at in range(low, high):
        line = code[at]
        if HEAD.match(line) and indents[at - low] <= least:
            depth = 0  # a bracket left open does not swallow the next definition
        if line.strip() and depth == 0 and indents[at - low] <= least and not decorated:
            if start is not None:
                yield start, at
            start = at
        if line.strip() and depth == 0:
            decorated = line.lstrip().startswith("@")
        depth = max(0, depth + sum(line.count(c) for c in "([{") - sum(line.count(c) for c in ")]}"))
    if start is not None:
        yield start, high


def _tolerant(text: str, found: dict) -> None:
    """The facts of what can be read of a text that can't be read as a whole, statement by statement.

    Of a function whose body can't be read its head counts; of a class its head and each member.
    """
    lines, code = text.split("\n"), blanked(text, "python").split("\n")

    def read(first: int, last: int, add: list[str] = ()) -> list:
        part = textwrap.dedent("\n".join([*lines[first:last], *add]))
        try:
            tree = ast.parse(part)
        except (SyntaxError, ValueError):
            return []
        return ast.increment_lineno(tree, first).body

    def body_of(first: int, last: int) -> int | None:
        """The line after a head: that in which its colon stands outside brackets."""
        depth = 0
        for at in range(first, last):
            if depth == 0 and code[at].lstrip().startswith("@"):
                depth += sum(code[at].count(c) for c in "([{") - sum(code[at].count(c) for c in ")]}")
                continue
            depth += sum(code[at].count(c) for c in "([{") - sum(code[at].count(c) for c in ")]}")
            if depth <= 0 and code[at].rstrip().endswith(":"):
                return at + 1
        return None

    def visit(first: int, last: int) -> list:
        whole = read(first, last)
        if whole or not any(HEAD.match(c) for c in code[first:last]):
            return whole
        inner = body_of(first, last)
        if inner is None:
            return []
        indent = " " * (len(code[inner - 1]) + 1)
        head = read(first, inner, [f"{indent}pass"])
        if head and isinstance(head[0], ast.ClassDef):
            members = [n for a, b in _statements(lines, code, inner, last) for n in visit(a, b)]
            head[0].body = members or head[0].body
        return head

    for first, last in _statements(lines, code, 0, len(lines)):
        _facts_of(visit(first, last), found)


def parse_python(text: str) -> dict:
    """Types, functions and module-level names; with `parse_error` where only parts of the text could be read."""
    found = {"types": [], "functions": [], "assigns": []}
    try:
        body = ast.parse(text).body
    except (SyntaxError, ValueError) as e:
        _tolerant(text, found)
        return found | {"parse_error": f"{type(e).__name__}: {e}"}
    _facts_of(body, found)
    return found


def extract_python_facts(files: DataFrame) -> DataFrame:
    """One fact row per file (repo, path, hash, content).

    A file with a syntax error keeps the facts of the statements that can be read, and a parse_error.
    """
    return extracted(files, parse_python, FACT, {"types": [], "functions": [], "assigns": []})
