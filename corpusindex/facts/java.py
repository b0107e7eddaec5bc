"""Facts of Java sources: types with annotations, methods and fields."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from corpusindex.facts.blank import FACT, Source, extracted, split_top

PACKAGE = re.compile(r"\bpackage\s+([\w.]+)\s*;")
TYPE = re.compile(r"(?<!\.)(@interface|\bclass|\binterface|\benum|\brecord)\s+(\w+)")
ANNOTATION = re.compile(r"@(?!interface\b)[\w.]+\s*")
MODIFIERS = re.compile(r"\b(?:public|protected|private|static|final|abstract|default|synchronized|native|transient|volatile|sealed|strictfp)\b")
CALLABLE = re.compile(r"([\w$]+)\s*\($")
SPACES = re.compile(r"\s+")


def _neat(text: str) -> str:
    """A type's text with single spaces, none inside angle or square brackets but after commas."""
    text = re.sub(r"\s*([<\[.])\s*", r"\1", SPACES.sub(" ", text).strip())
    return re.sub(r",\s*", ", ", re.sub(r"\s+([>\],])", r"\1", text))


def _annotations(src: Source, start: int, end: int) -> tuple[list[str], str]:
    """Raw annotations of a member's head, and the head's code without them."""
    found, rest, at = [], [], start
    while m := ANNOTATION.search(src.code, at, end):
        stop = m.end()
        if stop < end and src.code[stop] == "(":
            stop = src.end(stop, end - 1) + 1
        found.append(SPACES.sub(" ", src.text[m.start() : stop]).strip())
        rest.append(src.code[at : m.start()])
        at = stop
    return found, "".join(rest) + src.code[at:end]


def _members(src: Source, start: int, end: int):
    """(start, head's end, body) of each member between two positions; body is None or the positions inside its braces."""
    at = begin = start
    while m := re.compile(r"[({;]").search(src.code, at, end):
        c, at = m.group(), m.end()
        if c == "(":
            at = src.end(m.start(), end) + 1
        elif c == "{":
            close = src.end(m.start(), end)
            at = close + 1
            if "=" not in re.sub(r"\([^)]*\)", "", src.code[begin : m.start()]):
                yield begin, m.start(), (m.end(), close)
                begin = at
        else:
            yield begin, m.start(), None
            begin = at


def _parameters(src: Source, start: int, end: int) -> tuple[list[str], str | None]:
    types, body = [], None
    at = start
    for part in split_top(src.code[start:end]):
        here = src.code.index(part, at)
        at = here + len(part)
        annotations, code = _annotations(src, here, at)
        words = _neat(MODIFIERS.sub(" ", code)).rsplit(" ", 1)
        types.append(words[0].strip())
        if any(re.match(r"@(?:[\w.]*\.)?RequestBody\b", a) for a in annotations):
            body = types[-1]
    return types, body


def _type(src: Source, start: int, head_end: int, body: tuple[int, int], out: list) -> None:
    annotations, head = _annotations(src, start, head_end)
    kind, name = TYPE.search(head).groups()
    tail = head[TYPE.search(head).end() :]
    ext = re.search(r"\bextends\s+(.*?)(?:\bimplements\b|\bpermits\b|$)", tail, re.S)
    impls = re.search(r"\bimplements\s+(.*?)(?:\bpermits\b|$)", tail, re.S)
    entry = {
        "kind": kind, "name": name, "ann": annotations, "line": src.line(src.code.index(name, TYPE.search(src.code, start).start())),
        "ext": _neat(ext.group(1)) if ext else None, "impls": _neat(impls.group(1)) if impls else None, "methods": [], "fields": [],
    }
    out.append(entry)
    members = _members(src, *body)
    if kind == "enum":
        next(members, None)  # the constants
    for begin, end, inner in members:
        annotations, code = _annotations(src, begin, end)
        if inner and TYPE.search(code):
            _type(src, begin, end, inner, out)
            continue
        first = begin + len(src.code[begin:end]) - len(src.code[begin:end].lstrip())
        open_ = next((i for i in range(begin, end) if src.code[i] == "(" and not _within_annotation(src, begin, end, i)), None)
        equals = code.find("=")
        if open_ is not None and (equals < 0 or code.find("(") < equals):
            m = CALLABLE.search(src.code, begin, open_ + 1)
            if not m:
                continue
            before = _neat(MODIFIERS.sub(" ", code[: code.index("(")]))
            returns = re.sub(r"^<[^>]*>\s*", "", before[: -len(m.group(1))].strip())
            types, request = _parameters(src, open_ + 1, src.end(open_, end))
            ctor = m.group(1) == name and not returns
            entry["methods"].append({
                "name": m.group(1), "sig": f"({', '.join(types)})" + ("" if ctor else f":{returns}"), "isCtor": ctor,
                "reqBody": request, "ann": annotations, "line": src.line(m.start()),
            })
        elif inner is None:
            declared = _neat(MODIFIERS.sub(" ", code[:equals] if equals >= 0 else code)).rsplit(" ", 1)
            if len(declared) == 2:
                entry["fields"].append({"name": declared[1], "type": declared[0], "ann": annotations, "line": src.line(first)})


def _within_annotation(src: Source, begin: int, end: int, at: int) -> bool:
    word = re.compile(r"@[\w.]+\s*$").search(src.code, begin, at)
    return bool(word) or any(src.code[i] == "(" and i < at < src.end(i, end) for i in range(begin, at))


def parse_java(text: str) -> dict:
    src = Source(text, "java")
    package = PACKAGE.search(src.code)
    types: list[dict] = []
    start = 0
    for begin, end, body in _members(src, start, len(src.code)):
        if body and TYPE.search(src.code, begin, end):
            _type(src, begin, end, body, types)
    return {"pkg": package.group(1) if package else None, "types": types}


def extract_java_facts(files: DataFrame) -> DataFrame:
    """One fact row per file (repo, path, hash, content). A file that can't be read has no types and a parse_error."""
    return extracted(files, parse_java, FACT, {"pkg": None, "types": []})
