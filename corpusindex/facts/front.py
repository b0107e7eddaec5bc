"""Facts of Angular and React sources: classes, functional symbols, routes."""

from __future__ import annotations

import re
from bisect import bisect_left

from pyspark.sql import DataFrame

from corpusindex.facts.blank import Source, extracted, split_top
from corpusindex.facts.node import CLASS, MEMBERS, _decorators, members

ROUTES = "routes array<struct<path:string,target:string,kind:string,line:int,guards:array<string>>>"
ANGULAR = (
    "repo string, path string, hash string, parse_error string, types array<struct<name:string,decorators:array<string>,ctorDeps:array<string>,"
    f"inputs:array<string>,outputs:array<string>,http:array<struct<verb:string,url:string>>,line:int,uses:array<string>,{MEMBERS}>>, "
    f"functionals array<struct<name:string,kind:string,deps:array<string>,line:int>>, {ROUTES}"
)
REACT = (
    "repo string, path string, hash string, parse_error string, "
    f"functionals array<struct<name:string,kind:string,hooks:array<string>,deps:array<string>,props:array<string>,line:int,class:boolean>>, {ROUTES}"
)
# Types that are no dependencies, functional kinds, hooks of the framework itself.
PRIMITIVES = {"String", "Number", "Boolean", "Array", "Object", "Promise", "Date", "Map", "Set", "Function", "Record", "Partial"}
FUNCTIONALS = {
    "CanActivateFn": "guard", "CanActivateChildFn": "guard", "CanMatchFn": "guard", "CanDeactivateFn": "guard", "CanLoadFn": "guard",
    "HttpInterceptorFn": "interceptor", "ResolveFn": "resolver",
}
BUILT_IN_HOOKS = set(
    "useState useEffect useContext useReducer useMemo useCallback useRef useLayoutEffect useImperativeHandle useTransition useDeferredValue useId useSyncExternalStore".split()
)
INJECT = re.compile(r"\binject\(\s*([A-Za-z_]\w*)")
STRING = re.compile(r"""`([^`]*)`|'([^'\n]*)'|"([^"\n]*)\"""")
CLIENT = re.compile(r"(\w+)\s*[?!]?\s*:\s*HttpClient\b|(\w+)\s*(?::[^=;\n]+)?=\s*inject\(\s*HttpClient\b")
RESOURCE = re.compile(r"\bhttpResource\b\s*(?:<[^()]*>)?\s*\(")
FIELD = re.compile(r"(?m)^\s*(?:(?:public|private|protected|readonly|static)\s+)*(\w+)\s*(?::[^=;\n]+)?=\s*([`'\"])")
PATH = re.compile(r"\bpath\s*:")
TAG = re.compile(r"<(?:/?\s*[A-Za-z][\w.]*|)(?=[\s/>])")
HOOK_CALL = re.compile(r"(?<![\w.])(use[A-Z]\w*)(?=\s*[(<])")
SYMBOL = re.compile(r"(?m)^[ \t]*(?:export\s+)?(?:default\s+)?(?:(?:async\s+)?function\s+(\w+)\s*\(|const\s+(\w+)\s*[:=])")
REACT_CLASS = re.compile(r"\bclass\s+([A-Z]\w*)\s+extends\s+(?:React\.)?(?:Pure)?Component\b[^{]*\{")


def _distinct(values) -> list[str]:
    return list(dict.fromkeys(values))


def _string(raw: str) -> str | None:
    m = STRING.match(raw.strip())
    return next((g for g in m.groups() if g is not None), "") if m else None


def _url(raw: str, fields: dict[str, str]) -> str | None:
    """A URL literal with each interpolation reduced to its last name; a field is replaced by its initial string."""
    own = re.fullmatch(r"this\.(\w+)", raw.strip())
    text = fields.get(own.group(1)) if own else _string(raw)
    if text is None:
        return None
    text = re.sub(r"\$\{\s*this\.(\w+)\s*\}", lambda m: fields.get(m.group(1), m.group()), text)
    return re.sub(r"\$\{\s*([^}]+?)\s*\}", lambda m: "{" + re.sub(r"\(.*$", "", m.group(1).split(".")[-1]).strip() + "}", text)


def _span(src: Source, at: int) -> int:
    """Where the declaration that begins at `at` ends: after its outermost brackets, at a semicolon or the text's end."""
    while m := re.compile(r"[(\[{;]").search(src.code, at):
        if m.group() == ";":
            return m.start()
        at = src.end(m.start(), len(src.code)) + 1
        if m.group() == "{" and not re.compile(r"\s*[=)]").match(src.code, at):
            return at
    return len(src.code)


def _angular_class(src: Source, m: re.Match, before: int) -> dict:
    body, close = m.end(), src.end(m.end() - 1, len(src.code))
    code, raw = src.code[body:close], src.text[body:close]
    deps = []
    ctor = re.search(r"\bconstructor\s*\(", code)
    if ctor:
        for part in split_top(code[ctor.end() : src.end(body + ctor.end() - 1, close) - body]):
            kind = re.match(r"\s*([A-Za-z_$][\w$]*)", part.split(":", 1)[1]) if ":" in part else None
            if kind and kind.group(1)[0].isupper() and kind.group(1) not in PRIMITIVES:
                deps.append(kind.group(1))
    deps += INJECT.findall(code)
    marked = lambda name, call: _distinct(re.findall(rf"@{name}\b\s*(?:\([^)]*\))?\s*(?:(?:public|readonly|set|get)\s+)*(\w+)", code) + re.findall(rf"(\w+)\s*=\s*{call}\b\s*(?:\.required)?\s*(?:<[^()]*>)?\s*\(", code))
    fields = {}
    for f in FIELD.finditer(raw):
        value = _string(raw[f.end() - 1 :])
        if value is not None:
            fields[f.group(1)] = _url(f"`{value}`", {}) or ""
    http = []
    clients = {"http", "httpClient", *(name for pair in CLIENT.findall(code) for name in pair if name)}
    calls = rf"(?:\bthis\s*\.\s*|(?<![\w$.]))(?:{'|'.join(sorted(clients))})\s*\.\s*(get|post|put|delete|patch)\b\s*(?:<[^()]*>)?\s*\("
    for call in re.finditer(calls, code):
        args = split_top(raw[call.end() : src.end(body + call.end() - 1, close) - body])
        http.append({"verb": call.group(1).upper(), "url": _url(args[0], fields) if args else None})
    for call in RESOURCE.finditer(code):
        config = raw[call.end() : src.end(body + call.end() - 1, close) - body]
        url, method = re.search(r"\burl\s*:\s*([^,}]+(?:\}[^,}]*)*)", config), re.search(r"\bmethod\s*:\s*['\"`](\w+)", config)
        http.append({"verb": method.group(1).upper() if method else "GET", "url": _url(url.group(1) if url else re.sub(r"^\s*\(\)\s*=>\s*", "", config), fields)})
    decorators = _decorators(src, before, m.start())
    imported = next((i.group(1) for d in decorators if (i := re.search(r"\bimports\s*:\s*\[([^\]]*)\]", d)) and d.startswith("@Component")), "")
    return members(src, m.group(), body, close) | {
        "name": m.group(1), "decorators": decorators, "uses": [x for part in imported.split(",") if re.fullmatch(r"[A-Z]\w*", x := part.strip())], "ctorDeps": _distinct(deps), "inputs": marked("Input", "input"),
        "outputs": marked("Output", "output"), "http": http, "line": src.line(m.start()),
    }


# Words of files with routes; a route's keys by rank with the kind that each makes; keys that list guards.
ROUTED = ("Route", "Routes", "RouterModule", "provideRouter")
ROUTE_KINDS = {"redirectTo": "redirect", "loadComponent": "lazy", "loadChildren": "lazy-children", "component": "component", "children": "parent"}
GUARD_KEYS = ("canActivate", "canActivateChild", "canMatch", "canDeactivate", "canLoad")
NG_KEY = re.compile(r"[({\[]|\b(" + "|".join(("path", *ROUTE_KINDS, *GUARD_KEYS)) + r")\s*:")


def _target(key: str, value: str) -> str | None:
    """What a route's key leads to: a path, a module, a class, or nothing by itself."""
    if key == "redirectTo":
        return _string(value)
    if key.startswith("load"):
        module = re.search(r"\bimport\(\s*", value)
        return (_string(value[module.end() :]) if module else None) or "(lazy)"
    name = re.match(r"\s*([A-Za-z_]\w*)", value)
    return name.group(1) if key == "component" and name else None


def _angular_routes(src: Source) -> list[dict]:
    """Routes of the objects that have a path of their own, nested ones too, in the order of the text."""
    if not any(re.search(rf"\b{word}\b", src.text) for word in ROUTED):
        return []
    out = []
    for open_ in sorted(o for o in src.closes if src.code[o] == "{"):
        keys = _object_keys(src, open_, NG_KEY)
        path = _string(src.text[keys["path"] :]) if "path" in keys else None
        if path is None:
            continue
        ends = sorted([*keys.values(), src.end(open_, len(src.code))])
        value = {key: src.text[at : ends[bisect_left(ends, at) + 1]] for key, at in keys.items()}
        key = next((k for k in ROUTE_KINDS if k in keys), "component")
        lists = [src.code.find("[", keys[k]) for k in sorted((k for k in GUARD_KEYS if k in keys), key=keys.get) if value[k].lstrip().startswith("[")]
        guards = split_top(src.text[lists[0] + 1 : src.end(lists[0], len(src.code))]) if lists else []
        line = src.line(src.code.rfind("path", open_, keys["path"]))
        out.append({"path": path, "target": _target(key, value.get(key, "")), "kind": ROUTE_KINDS[key], "line": line, "guards": [g.strip() for g in guards]})
    return out


def parse_angular(text: str) -> dict:
    src = Source(text, "typescript")
    types, before = [], 0
    for m in CLASS.finditer(src.code):
        types.append(_angular_class(src, m, before))
        before = src.end(m.end() - 1, len(src.code))
    functionals = []
    for m in re.finditer(rf"\bexport\s+const\s+(\w+)\s*:\s*({'|'.join(FUNCTIONALS)})\b", src.code):
        deps = _distinct(INJECT.findall(src.code[m.end() : _span(src, m.end())]))
        functionals.append({"name": m.group(1), "kind": FUNCTIONALS[m.group(2)], "deps": deps, "line": src.line(m.start())})
    return {"types": types, "functionals": functionals, "routes": _angular_routes(src)}


def _props(code: str) -> list[str] | None:
    """Keys of a destructured first parameter, at most 8, else its type's name."""
    head = re.search(r"\(", code)
    first = split_top(code[head.end() :].split(")")[0])[:1] if head else []
    if not first:
        return None
    pattern, _, kind = first[0].strip().partition("}") if first[0].strip().startswith("{") else ("", "", "")
    if pattern:
        return [re.split(r"[:=]", part)[0].strip() for part in pattern[1:].split(",") if part.strip()][:8]
    named = re.fullmatch(r"\w+\s*\??\s*:\s*([\w.]+).*", first[0].strip(), re.S)
    return [named.group(1)] if named else None


ROUTE_KEY = re.compile(r"[({\[]|\b(path|element|Component)\s*:")
ELEMENT = re.compile(r"\s*\{?\s*<?\s*([A-Z][\w.]*)")


def _tag(src: Source, at: int) -> str:
    """The source of a tag's attributes from `at` on; what stands in braces belongs to them."""
    start = at
    while m := re.compile(r"[{>]").search(src.code, at):
        if m.group() == ">":
            return src.text[start : m.start()]
        at = src.end(m.start(), len(src.code)) + 1
    return src.text[start:]


def _object_keys(src: Source, open_: int, wanted: re.Pattern = ROUTE_KEY) -> dict[str, int]:
    """Where the values of an object's own keys begin, of those that are wanted; nested brackets are skipped."""
    found, at, close = {}, open_ + 1, src.end(open_, len(src.code))
    while m := wanted.search(src.code, at, close):
        at = m.end() if m.group(1) else src.end(m.start(), close) + 1
        if m.group(1):
            found.setdefault(m.group(1), m.end())
    return found


def _react_routes(src: Source) -> list[dict]:
    """Routes of tags and of route objects; an index route has the path `(index)`."""
    if not re.search(r"<Route\b|create\w+Router\b|\buseRoutes\b|\bRouterProvider\b", src.text):
        return []
    out = []

    def add(at: int, path: str, target: str | None) -> None:
        out.append({"path": path, "target": target, "kind": "route", "line": src.line(at), "guards": []})

    for m in re.finditer(r"<Route\b", src.text):
        tag = _tag(src, m.end())
        path = re.search(r"\bpath\s*=\s*\{?\s*(['\"`])(.*?)\1", tag)
        shown = re.search(r"\b(?:element|component|Component)\s*=", tag)
        target = ELEMENT.match(tag, shown.end()) if shown else None
        index = not path and re.search(r"\bindex\b", tag[: shown.start()] + tag[shown.end() :] if shown else tag)
        if path or index or target:
            add(m.start(), path.group(2) if path else "(index)" if index else "", target.group(1) if target else None)
    opens = sorted(o for o in src.closes if src.code[o] == "{")
    for m in PATH.finditer(src.code):
        around = next((o for o in reversed(opens[: bisect_left(opens, m.start())]) if src.closes[o] > m.start()), None)
        path = _string(src.text[m.end() :])
        keys = _object_keys(src, around) if around is not None else {}
        shown = keys.get("element", keys.get("Component"))
        if path is not None and shown is not None and keys.get("path") == m.end():
            target = ELEMENT.match(src.text, shown)
            add(m.start(), path, target.group(1) if target else None)
    return sorted(out, key=lambda r: r["line"])


def _renders(code: str) -> bool:
    """Whether blanked code holds a JSX element: a tag where a value can stand."""
    return any(re.search(r"(?:[=(,?:&|\[{>]|\breturn|^)\s*$", code[: m.start()]) for m in TAG.finditer(code))


def parse_react(text: str) -> dict:
    src = Source(text, "typescript")
    found = []
    for m in SYMBOL.finditer(src.code):
        name = m.group(1) or m.group(2)
        code = src.code[m.start() : _span(src, m.end() - 1 if m.group(1) else m.end())]
        hook = bool(re.match(r"use[A-Z]", name))
        if not hook and not (name[0].isupper() and _renders(code)):
            continue
        hooks = _distinct(h for h in HOOK_CALL.findall(code) if h != name)
        found.append({
            "name": name, "kind": "hook" if hook else "component", "hooks": hooks, "deps": [h for h in hooks if h not in BUILT_IN_HOOKS],
            "props": _props(code), "line": src.line(m.start() + len(m.group()) - len(m.group().lstrip())), "class": False,
        })
    for m in REACT_CLASS.finditer(src.code):
        found.append({"name": m.group(1), "kind": "component", "hooks": [], "deps": [], "props": None, "line": src.line(m.start()), "class": True})
    return {"functionals": sorted(found, key=lambda f: f["line"]), "routes": _react_routes(src)}


def extract_angular_facts(files: DataFrame) -> DataFrame:
    """One fact row per file (repo, path, hash, content)."""
    return extracted(files, parse_angular, ANGULAR, {"types": [], "functionals": [], "routes": []})


def extract_react_facts(files: DataFrame) -> DataFrame:
    """One fact row per file (repo, path, hash, content)."""
    return extracted(files, parse_react, REACT, {"functionals": [], "routes": []})
