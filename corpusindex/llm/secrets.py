"""Secret scan: pattern spans, and high-entropy windows per character class with an allow-list."""

from __future__ import annotations

import math
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusindex.llm.common import record, sliced

# The kinds in the order in which they are listed, and their patterns.
BASE_KINDS = ("assign", "access", "hex")
ENTROPY_KINDS = ("entropy_hex", "entropy_base64")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
CLASS_RUNS = {
    "entropy_hex": re.compile(r"[0-9a-fA-F]+"),
    "entropy_base64": re.compile(r"[A-Za-z0-9+/_=-]+"),
}
#: Characters of a window, and its least entropy in bits for each class.
WINDOW, HEX_BITS, BASE64_BITS = 20, 3.0, 3.9
#: A window that matches one of these is no secret, however mixed its characters are.
ALLOW = tuple(
    re.compile(p)
    for p in (
        r"(?i)example|sample|placeholder|changeme|dummy|redacted|xxxx",
        r"(?i)0123456789|abcdefghij|qwertyuiop",
        r"^[0-9-]+$",
        r"^(?:[A-Za-z]+[_/=-])+[A-Za-z]*$",
    )
)
#: A digest that a run begins with is no secret; what follows it may be.
DIGEST = re.compile(r"(?i)sha(?:1|256|384|512)-[A-Za-z0-9+/]*={0,2}")


def entropy_windows(text: str, window: int, threshold: float, allowed=None) -> list[tuple[int, int]]:
    """The unions of all windows of `window` characters whose Shannon entropy is at least `threshold` bits.

    A window for which `allowed(start, end)` holds is left out before windows are united.

    One step of the window changes two counts, so the sum of c*log2(c) is carried on instead of being summed anew.
    """
    n = len(text)
    if n < window:
        return []
    xlog = [0.0] + [c * math.log2(c) for c in range(1, window + 2)]
    counts: dict[str, int] = {}
    total = 0.0
    found: list[tuple[int, int]] = []
    most = window * (math.log2(window) - threshold) + 1e-9
    for at, char in enumerate(text):
        c = counts.get(char, 0)
        total += xlog[c + 1] - xlog[c]
        counts[char] = c + 1
        if at >= window:
            old = text[at - window]
            c = counts[old]
            total += xlog[c - 1] - xlog[c]
            counts[old] = c - 1
        if at >= window - 1 and total <= most:
            start = at - window + 1
            if allowed and allowed(start, at + 1):
                continue
            if found and start <= found[-1][1]:
                found[-1] = (found[-1][0], at + 1)
            else:
                found.append((start, at + 1))
    return found


def _entropy_spans(text: str, window: int, thresholds: dict[str, float]) -> list[tuple[int, int, str]]:
    spans = []
    for candidate in CANDIDATE.finditer(text):
        string = candidate.group()
        if not any(c.isdigit() for c in string):
            continue
        for kind in ENTROPY_KINDS:
            for run in CLASS_RUNS[kind].finditer(string):
                digest = DIGEST.match(run.group())
                known = digest.end() if digest else 0

                def allowed(start: int, end: int, part: str = run.group(), known: int = known) -> bool:
                    return end <= known or any(p.search(part[start:end]) for p in ALLOW)

                for start, end in entropy_windows(run.group(), window, thresholds[kind], allowed):
                    piece = run.group()[max(known, start - window) : end + window]  # a key's digits may stand beside its windows
                    mixed = any(c.isdigit() for c in piece) and any(c.isalpha() for c in piece)
                    if kind == "entropy_base64":
                        mixed = mixed and any(c.isupper() for c in piece) and any(c.islower() for c in piece)
                    if mixed:
                        at = candidate.start() + run.start()
                        spans.append((at + start, at + end, kind))
    return spans


def find_secrets(text: str, window: int, thresholds: dict[str, float]) -> tuple[list, list]:
    """Base spans and added spans of one text, as (start, end, kind) in code points, end exclusive."""
    base = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    base += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    base += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    added = [
        s for s in _entropy_spans(text, window, thresholds) if not any(b[0] <= s[0] and s[1] <= b[1] for b in base)
    ]
    order = {k: i for i, k in enumerate(BASE_KINDS + ENTROPY_KINDS)}
    base.sort(key=lambda s: (s[0], order[s[2]]))
    return base, sorted(added, key=lambda s: (s[0], order[s[2]]))


def scan_secrets(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    hex_bits: float = HEX_BITS,
    base64_bits: float = BASE64_BITS,
) -> DataFrame:
    """One row per row of `docs`: the id, and `found`, the spans of secrets as structs (kind, start, end, base).

    Base spans come from the patterns; `window`-character windows whose entropy reaches `hex_bits` or `base64_bits` add
    spans, unless the allow-list names the window or a base span holds them. Spans are in code points, ordered by start, then
    kind. A null or empty text has no spans; a null id stays null; repeated rows each give a row; other columns are not
    read. The scan is one pass without a shuffle.
    """
    thresholds = {"entropy_hex": hex_bits, "entropy_base64": base64_bits}
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())])
    id_type = docs.schema[id_col].dataType.simpleString()

    def scan(batches):
        for batch in sliced(batches):
            rows = []
            for text in batch.column(1).to_pylist():
                base, added = find_secrets(text or "", window, thresholds)
                both = sorted(
                    [(*s, True) for s in base] + [(*s, False) for s in added],
                    key=lambda s: (s[0], (BASE_KINDS + ENTROPY_KINDS).index(s[2])),
                )
                rows.append([{"kind": k, "start": a, "end": b, "base": x} for a, b, k, x in both])
            ids = batch.column(0)
            yield record(pa.schema([("id", ids.type), ("found", pa.list_(span))]), [ids, rows])

    schema = f"id {id_type}, found array<struct<kind:string,start:bigint,end:bigint,base:boolean>>"
    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return picked.mapInArrow(scan, schema).withColumnRenamed("id", id_col)


def span_list(found: Column) -> Column:
    """`kind:start:end`, comma-joined in the order of the array."""
    return F.concat_ws(
        ",", F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    )


def secret_digest(docs: DataFrame) -> DataFrame:
    """The scan's counts, digest and span list for each document."""
    found = scan_secrets(docs)
    base = F.filter("found", lambda s: s["base"])

    def count(kind: str) -> Column:
        return F.size(F.filter("found", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *[count(k) for k in BASE_KINDS],
        F.sha2(span_list(base), 256).alias("base_sha256"),
        span_list(F.col("found")).alias("spans"),
        F.size(F.filter("found", lambda s: ~s["base"])).cast("long").alias("n_entropy"),
    )


def mask_secrets(docs: DataFrame, mask: str = "[SECRET]", window: int = WINDOW, hex_bits: float = HEX_BITS, base64_bits: float = BASE64_BITS) -> DataFrame:
    """`docs` with the span of every secret in `text` replaced by `mask`; other columns as they are, `n_chars` renewed.

    Overlapping spans are replaced as one. A null text stays null. Every row stays.
    """
    thresholds = {"entropy_hex": hex_bits, "entropy_base64": base64_bits}
    names = docs.columns

    def scan(batches):
        for batch in sliced(batches):
            texts = []
            for text in batch.column("text").to_pylist():
                if text:
                    base, added = find_secrets(text, window, thresholds)
                    out, at = [], 0
                    for start, end, _ in sorted(base + added):
                        if start >= at:
                            out += [text[at:start], mask]
                        at = max(at, end)
                    text = "".join(out) + text[at:]
                texts.append(text)
            columns = dict(zip(batch.schema.names, batch.columns))
            columns["text"] = pa.array(texts, type=batch.schema.field("text").type)
            if "n_chars" in columns:
                chars = pa.array([None if t is None else len(t) for t in texts], type=pa.int64())
                columns["n_chars"] = chars.cast(batch.schema.field("n_chars").type)
            yield pa.RecordBatch.from_arrays([columns[n] for n in names], schema=batch.schema)

    return docs.mapInArrow(scan, docs.schema)
