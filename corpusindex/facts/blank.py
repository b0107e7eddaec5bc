"""Source text with comments and strings blanked, at the same length and with the same lines."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

C_STRINGS = r'"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\''
C_COMMENTS = r"//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)"
PATTERNS = {
    "java": re.compile(r'"""[\s\S]*?(?:"""|\Z)|' + C_STRINGS + "|" + C_COMMENTS),
    "typescript": re.compile("`|" + C_STRINGS + "|" + C_COMMENTS),
    "python": re.compile(
        r"(?i:\b[rbuf]{1,2})?(?:\"\"\"[\s\S]*?(?:\"\"\"|\Z)|'''[\s\S]*?(?:'''|\Z)|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*')|\#[^\n]*"
    ),
}
IN_TEMPLATE = re.compile(r"\\.|`|\$\{", re.S)
IN_INTERPOLATION = re.compile("[`{}]|" + C_STRINGS + "|" + C_COMMENTS)
_VISIBLE = re.compile(r"[^\n]")


def template_end(source: str, at: int) -> int:
    """Where the template literal that begins at `at` ends, whatever its interpolations hold, templates too."""
    inside, at = ["`"], at + 1
    while inside:
        m = (IN_TEMPLATE if inside[-1] == "`" else IN_INTERPOLATION).search(source, at)
        if m is None:
            return len(source)
        at, piece = m.end(), m.group()
        if piece in ("`", "}") and piece == {"`": "`", "{": "}"}[inside[-1]]:
            inside.pop()
        elif piece in ("`", "{", "${"):
            inside.append(piece[-1])
    return at


def blanked(source: str, lang: str) -> str:
    out, at = [], 0
    while m := PATTERNS[lang].search(source, at):
        end = template_end(source, m.start()) if m.group() == "`" else m.end()
        out += [source[at : m.start()], _VISIBLE.sub(" ", source[m.start() : end])]
        at = end
    return "".join(out) + source[at:]


def with_code_only(files: DataFrame, lang: str) -> DataFrame:
    """`files` with `code`: `content` blanked. A null content gives null."""

    @F.pandas_udf("string")
    def code(content: pd.Series) -> pd.Series:
        return content.map(lambda s: None if s is None else blanked(s, lang))

    return files.withColumn("code", code("content"))


class Source:
    """A blanked source with its brackets paired."""

    def __init__(self, text: str, lang: str):
        self.text, self.code = text, blanked(text, lang)
        self.closes: dict[int, int] = {}
        stack: list[tuple[str, int]] = []
        for m in re.finditer(r"[(){}\[\]]", self.code):
            c = m.group()
            if c in "({[":
                stack.append((c, m.start()))
            elif stack and stack[-1][0] + c in ("()", "{}", "[]"):
                self.closes[stack.pop()[1]] = m.start()

    def line(self, at: int) -> int:
        return self.code.count("\n", 0, at) + 1

    def end(self, at: int, limit: int) -> int:
        """Where the bracket at `at` closes, or `limit` where it never does."""
        return self.closes.get(at, limit)


def split_top(text: str, separator: str = ",") -> list[str]:
    """Parts between separators outside any bracket, angle brackets too."""
    parts, depth, start = [], 0, 0
    for i, c in enumerate(text):
        if c in "(<[{":
            depth += 1
        elif c in ")>]}":
            depth -= c != ">" or text[i - 1 : i] not in ("=", "-")
        elif c == separator and depth <= 0:
            parts.append(text[start:i])
            start = i + 1
    return [p for p in (*parts, text[start:]) if p.strip()]


FACT = (
    "repo string, path string, pkg string, hash string, parse_error string, types array<struct<kind:string,name:string,ann:array<string>,line:int,"
    "ext:string,impls:string,methods:array<struct<name:string,sig:string,isCtor:boolean,reqBody:string,ann:array<string>,line:int>>,"
    "fields:array<struct<name:string,type:string,ann:array<string>,line:int>>>>"
)


def extracted(files: DataFrame, parse, schema: str, empty: dict) -> DataFrame:
    """`schema` rows of `files` (repo, path, hash, content) by `parse`, a function of a text; a failure becomes parse_error."""

    def run(frames):
        for frame in frames:
            rows = []
            for repo, path, hash_, content in zip(frame["repo"], frame["path"], frame["hash"], frame["content"]):
                try:
                    found, error = parse(content or ""), None
                except Exception as e:  # a file that can't be read is quarantined, the job goes on
                    found, error = empty, f"{type(e).__name__}: {e}"
                rows.append({"repo": repo, "path": path, "hash": hash_, "parse_error": error, **found})
            yield pd.DataFrame(rows)

    return files.select("repo", "path", "hash", "content").mapInPandas(run, schema)
