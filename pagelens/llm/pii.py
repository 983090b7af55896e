"""Personal data: patterns propose spans, checksums confirm them, context words adjust a score."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import rows_of

#: Kinds in the order in which ties of start are listed; the last ones are added to the base ones.
BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "ssn")
KINDS = BASE + ADDED

# The local part of an address starts at the start of its run of characters, or where the match before ended.
_LOCAL = "A-Za-z0-9._%+-"
_EMAIL = re.compile(rf"(?<![{_LOCAL}])[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_EMAIL_HERE = re.compile(rf"[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")

#: Words that speak for a kind, in any of four languages, looked for in WINDOW characters before the span.
CONTEXT = {
    "email": ("email", "e-mail", "mail", "contact", "correo", "courriel", "kontakt"),
    "ip": ("ip", "address", "host", "server", "login", "adresse", "servidor"),
    "card": ("card", "visa", "mastercard", "credit", "payment", "carte", "karte", "tarjeta"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "telefon", "appeler", "llamar"),
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta"),
    "ssn": ("ssn", "social", "security", "tax"),
}
WINDOW = 40
#: Score of a span by kind where no context word is near, what one adds, and the least score that is kept.
PRIOR = {"email": 0.9, "ip": 0.7, "card": 0.8, "phone": 0.7, "iban": 0.9, "ssn": 0.4}
BONUS, LEAST = 0.25, 0.5
_NEAR = {k: re.compile(r"(?i)\b(?:" + "|".join(map(re.escape, w)) + r")\b") for k, w in CONTEXT.items()}


def luhn(digits: str) -> bool:
    """Whether the digits pass the mod-10 checksum."""
    odd = sum(map(int, digits[-1::-2]))
    even = sum((0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(d)] for d in digits[-2::-2])
    return (odd + even) % 10 == 0


def mod97(iban: str) -> bool:
    """Whether an IBAN without spaces passes its checksum."""
    return 15 <= len(iban) <= 34 and int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    at = 0
    while (m := _EMAIL.search(text, at)) is not None:
        yield m.span()
        at = m.end()
        while (m := _EMAIL_HERE.match(text, at)) is not None:  # the rest of the run in which the match ended
            yield m.span()
            at = m.end()


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def find_pii(text: str | None) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) by start, then kind; offsets count code points, the end is exclusive.

    Base spans are always kept, whatever their score; added kinds only with a score of LEAST or more.
    """
    if not text:
        return []
    found: list[tuple[str, int, int]] = []
    if "@" in text:
        found += [("email", *s) for s in _emails(text)]
    for m in _CARD.finditer(text):
        d = _digits(m[0])
        if 12 <= len(d) <= 19 and luhn(d):
            found.append(("card", *m.span()))
    if "." in text:
        for m in _IP.finditer(text):
            if all(len(p := g.lstrip("0")) <= 3 and int(p or "0") <= 255 for g in m.groups()):
                found.append(("ip", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(m[0])) <= 15:
                found.append(("phone", *m.span()))
    for m in _IBAN.finditer(text):
        if mod97(m[0].replace(" ", "")):
            found.append(("iban", *m.span()))
    if "-" in text:
        found += [("ssn", *m.span()) for m in _SSN.finditer(text)]
    out = []
    for kind, a, b in found:
        score = min(1.0, PRIOR[kind] + BONUS * bool(_NEAR[kind].search(text[max(0, a - WINDOW) : a])))
        if kind in BASE or score >= LEAST:
            out.append((kind, a, b, score))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def redact(text: str, spans: list[tuple[str, int, int, float]]) -> str:
    """The text with each span (overlapping ones as one, by the first one's kind) replaced by [KIND]."""
    out, at = [], 0
    for kind, a, b, *_ in spans:
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


SPANS = "array<struct<kind:string,start:long,end:long,score:double>>"


def scan_pii(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """Per row: id, spans (array of kind, start, end, score) and, with_text, the redacted text.

    One pass without a shuffle; each text is read whole. Null and empty texts have no spans (a null text stays
    null when redacted). Repeated rows and null ids are passed through, an empty table gives an empty one, other columns are
    not read. Ties of start are in the order of KINDS. Memory is bounded by a few MB of text and the longest text.
    """
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("spans", T._parse_datatype_string(SPANS))])
    if with_text:
        schema = schema.add("redacted", "string")
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in rows_of(whole):
                texts = b.column("text").to_pylist()
                spans = [find_pii(t) for t in texts]
                cols = [b.column("id"), pa.array([[dict(zip(("kind", "start", "end", "score"), s, strict=True)) for s in x] for x in spans], kind)]
                if with_text:
                    cols.append(pa.array([t and redact(t, x) for t, x in zip(texts, spans, strict=True)], pa.string()))
                yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return docs.selectExpr(f"`{id_col}` as id", f"`{text_col}` as text").mapInArrow(scan, schema)


def mask_pii(docs: DataFrame, *, text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """The rows of docs with their texts redacted, all columns kept in order; count_col gets the new length.

    One pass without a shuffle or a join: rows are read with their other columns. Null texts stay null.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    names, schema = docs.columns, to_arrow_schema(docs.schema)
    at = names.index(text_col)
    n = names.index(count_col) if count_col else None

    def mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            whole = whole.rename_columns([f"c{k}" for k in range(len(names))])
            for b in rows_of(whole, col=f"c{at}"):
                cols = b.columns
                new = [t and redact(t, find_pii(t)) for t in b.column(at).to_pylist()]
                cols[at] = pa.array(new, pa.string())
                if n is not None:
                    cols[n] = pa.array([x if t is None else len(t) for t, x in zip(new, b.column(n).to_pylist(), strict=True)], schema.field(n).type)
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return docs.mapInArrow(mask, docs.schema)


def base_digest(spans: list[tuple[str, int, int]]) -> str:
    """SHA-256 of kind:start:end of the base spans, comma-joined."""
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b, *_ in spans if k in BASE).encode()).hexdigest()
