"""Facts of Node sources: decorated and called routes, classes, framework signals."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from corpusindex.facts.blank import Source, extracted, split_top

MEMBERS = "bases:array<string>,methods:array<struct<name:string,sig:string,line:int>>,props:array<struct<name:string,type:string>>"
FACT = (
    "repo string, path string, hash string, parse_error string, "
    f"types array<struct<kind:string,name:string,decorators:array<string>,ctorDeps:array<string>,basePath:string,line:int,{MEMBERS}>>, "
    "routes array<struct<verb:string,path:string,target:string,kind:string,line:int>>, fw array<string>"
)
# Receivers that are routers, and the marks of each framework.
RECEIVER = re.compile(r"(?:app|router|server|fastify|api|route|r|v\d+)$", re.I)
SIGNALS = {
    "nestjs": r"@nestjs/|@(?:Controller|Injectable|Module)\b|@(?:Get|Post|Put|Delete|Patch)\s*\(",
    "express": r"""from\s+['"]express['"]|require\(\s*['"]express['"]|express\s*\(\)|\bRouter\s*\(\)""",
    "fastify": r"""from\s+['"]fastify['"]|require\(\s*['"]fastify['"]|\bfastify\s*\(""",
}
CALL = re.compile(r"\b([A-Za-z_$][\w$]*)\s*\.\s*(get|post|put|delete|patch|all|options|head)\s*\(")
DECORATOR = re.compile(r"@([\w.]+)\s*")
VERB = re.compile(r"(?i)@(get|post|put|delete|patch|all|options|head)$")
CLASS = re.compile(r"\bclass\s+([\w$]+)[^{};]*\{")
BASES = re.compile(r"\b(?:extends|implements)\s+(.*?)(?=\bextends\b|\bimplements\b|\{|$)", re.S)
MEMBER = re.compile(r"([\w$]+)\s*[?!]?\s*(?:<[^<>()]*>\s*)?([(:=;])")
BLOCK_WORDS = {"if", "for", "while", "switch", "catch", "return", "constructor", "function", "super", "await", "new", "typeof"}
QUOTED = re.compile(r"[`'\"]([^`'\"]*)[`'\"]")


def _decorators(src: Source, start: int, end: int) -> list[str]:
    found, at = [], start
    while m := DECORATOR.search(src.code, at, end):
        at = m.end()
        if at < end and src.code[at] == "(":
            at = src.end(at, end - 1) + 1
        found.append(src.text[m.start() : at].strip())
    return found


def _first_string(raw: str) -> str:
    m = QUOTED.search(raw)
    return m.group(1) if m else ""


def join_path(base: str, sub: str) -> str:
    path = re.sub(r"/{2,}", "/", "/" + "/".join(p for p in (base, sub) if p))
    return path[:-1] if len(path) > 1 and path.endswith("/") else path


def members(src: Source, head: str, body: int, close: int) -> dict:
    """Base types, methods with their parameters and return type, and typed fields of a class, nested code left out."""
    methods, props, at = [], [], body
    step = re.compile(r"[({\[]|" + MEMBER.pattern)
    while m := step.search(src.code, at, close):
        name, mark = m.group(1), m.group(2)
        at = m.end()
        if name is None:
            at = src.end(m.start(), close) + 1
        elif mark == "(":
            end = src.end(m.end() - 1, close)
            tail = re.compile(r"\)\s*(?::\s*([^{};=]+?))?\s*[{;]").match(src.code, end)
            if tail and name not in BLOCK_WORDS:
                plain = re.sub(r"@[\w.]+\s*(?:\([^()]*\))?\s*", "", src.code[m.end() : end])
                given = ", ".join(" ".join(p.split("=")[0].split()) for p in split_top(plain))
                returns = f": {' '.join(tail.group(1).split())}" if tail.group(1) else ""
                methods.append({"name": name, "sig": f"({given}){returns}", "line": src.line(m.start())})
            at = end + 1
        elif mark == ":":
            kind = re.compile(r"\s*([^=;{}()\n]+)").match(src.code, m.end(), close)
            if kind:
                props.append({"name": name, "type": kind.group(1).strip()})
                at = kind.end()
            rest = re.compile(r"[^;\n({\[]*").match(src.code, at, close)
            at = rest.end()
        else:
            at = re.compile(r"[^;\n({\[]*").match(src.code, at, close).end()
    bases = [" ".join(b.split()) for group in BASES.findall(head) for b in split_top(group)]
    return {"bases": bases, "methods": methods, "props": props}


def _class(src: Source, m: re.Match, before: int) -> tuple[dict, list[dict]]:
    body, close = m.end(), src.end(m.end() - 1, len(src.code))
    decorators = _decorators(src, before, m.start())
    controller = next((d for d in decorators if d.startswith("@Controller")), None)
    base = _first_string(controller) if controller else ""
    deps, routes, at = [], [], body
    ctor = re.compile(r"\bconstructor\s*\(").search(src.code, body, close)
    if ctor:
        for part in split_top(src.code[ctor.end() : src.end(ctor.end() - 1, close)]):
            kind = part.split(":", 1)[1] if ":" in part else ""
            deps += re.findall(r"^\s*([\w$]+)", kind)
    while d := DECORATOR.search(src.code, at, close):
        at = d.end()
        verb = VERB.match(d.group().strip())
        stop = src.end(at, close - 1) + 1 if src.code[at : at + 1] == "(" else at
        if verb:
            name = re.compile(r"(?:@[\w.]+\s*(?:\([^)]*\))?\s*)*(?:public\s+|async\s+)*([\w$]+)\s*\(").match(src.code, stop + len(src.code[stop:]) - len(src.code[stop:].lstrip()))
            if name:
                path = join_path(base, _first_string(src.text[at:stop]))
                routes.append({"verb": verb.group(1).upper(), "path": path, "target": f"{m.group(1)}.{name.group(1)}", "kind": "endpoint", "line": src.line(d.start())})
        at = max(at, stop)
    entry = {"kind": "class", "name": m.group(1), "decorators": decorators, "ctorDeps": list(dict.fromkeys(deps)), "basePath": base or None, "line": src.line(m.start())}
    entry |= members(src, m.group(), body, close)
    return entry, routes


def _called(src: Source) -> list[dict]:
    routes = []
    for m in CALL.finditer(src.code):
        close = src.end(m.end() - 1, len(src.code))
        parts = split_top(src.text[m.end() : close])
        path = QUOTED.fullmatch(parts[0].strip()) if parts else None
        if not path or not (RECEIVER.match(m.group(1)) or path.group(1).startswith("/")):
            continue
        handler = re.fullmatch(r"[A-Za-z_$][\w$.]*", parts[-1].strip()) if len(parts) > 1 else None
        routes.append({"verb": m.group(2).upper(), "path": path.group(1), "target": handler.group() if handler else "(inline)", "kind": "endpoint", "line": src.line(m.start())})
    return routes


def parse_node(text: str) -> dict:
    src = Source(text, "typescript")
    types, routes, before = [], [], 0
    for m in CLASS.finditer(src.code):
        entry, own = _class(src, m, before)
        types.append(entry)
        routes += own
        before = src.end(m.end() - 1, len(src.code))
    routes += _called(src)
    distinct = {(r["verb"], r["path"]): r for r in reversed(routes)}
    signals = [name for name, pattern in SIGNALS.items() if re.search(pattern, text)]
    return {"types": types, "routes": sorted(distinct.values(), key=lambda r: r["line"]), "fw": signals}


def extract_node_facts(files: DataFrame) -> DataFrame:
    """One fact row per file (repo, path, hash, content); a route stands once per verb and path of a file."""
    return extracted(files, parse_node, FACT, {"types": [], "routes": [], "fw": []})
