"""Personal data found by anchor expansion.

An Aho-Corasick automaton finds the anchors: at-signs, plus-signs, digits, schemes and identifier cues.
At each anchor a local parser reads to the left and right and validates what it has read. Nothing else
of a text is looked at twice.

Kinds: ``email``, ``ip``, ``card``, ``phone`` by their fixed definitions, leftmost and not overlapping
within a kind; then, as additions, ``secret`` (a value of 16 characters or more assigned to a name such
as token or api_key), ``account`` (an IBAN with right check digits, or 6 to 18 digits after an account
cue) and ``url`` (an address that carries user information).

Defined cases: a null or empty text has no spans; a very long text is read in one pass; offsets count
code points, end exclusive; rows are independent, so repeated rows and ties need no rule; other columns
of the input pass through or are left out as asked.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sinktrace.llm.caches import release
from sinktrace.llm.columns import texts_of, without
from sinktrace.storage import spread

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret", "account", "url")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_RUN = re.compile(r"[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_SECRET = re.compile(r"""["']?[ \t]{0,3}(?:=|:|=>)[ \t]{0,3}["']?([A-Za-z0-9+/_.=~-]{16,})""")
_ACCOUNT = re.compile(r"(?:[ \t](?:number|no\.?|nr\.?))?[ \t]{0,3}[:=#]?[ \t]{0,3}([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{2,4}){3,8}|[0-9](?:[ -]?[0-9]){5,17})")
_URL = re.compile(r"[^\s<>\"'@/]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}(?:[:/?#][^\s<>\"']*)?")
_SECRET_CUES = ("token", "secret", "password", "passwd", "api_key", "api-key", "apikey", "access_key", "private_key")
_ACCOUNT_CUES = ("iban", "account", "acct")
_SCHEMES = ("http://", "https://", "ftp://", "sftp://", "ssh://")
_AUTOMATON: list = []


def luhn(digits: str) -> bool:
    """Whether the digits pass the Luhn check."""
    return sum(int(d) if k % 2 == 0 else sum(divmod(2 * int(d), 10)) for k, d in enumerate(reversed(digits))) % 10 == 0


def _iban(value: str) -> bool:
    compact = value.replace(" ", "")
    return 15 <= len(compact) <= 34 and int("".join(str(int(c, 36)) for c in compact[4:] + compact[:4])) % 97 == 1


def _automaton():
    if not _AUTOMATON:
        import ahocorasick

        found = ahocorasick.Automaton()
        for anchor, kind in [("@", "at"), ("+", "plus"), *((str(d), "digit") for d in range(10)), *((x, "url") for x in _SCHEMES)]:
            found.add_word(anchor, (kind, len(anchor)))
        for kind, cues in (("secret", _SECRET_CUES), ("account", _ACCOUNT_CUES)):
            for cue in cues:
                for form in {cue, cue.upper(), cue.capitalize()}:
                    found.add_word(form, (kind, len(form)))
        found.make_automaton()
        _AUTOMATON.append(found)
    return _AUTOMATON[0]


def find_spans(text: str) -> list[tuple[str, int, int]]:
    """All spans of a text, by kind in the order of KINDS, then start."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    past = dict.fromkeys(KINDS, 0)  # where the last match of each kind ended, or the last try
    for last, (anchor, size) in _automaton().iter(text):
        if anchor == "digit":
            if last >= past["card"] and (m := _CARD.match(text, last)):
                past["card"] = m.end()
                digits = m[0].replace(" ", "").replace("-", "")
                if 16 <= len(digits) <= 19 and luhn(digits):
                    out["card"].append(m.span())
            if last >= past["ip"]:
                if m := _DOTTED.match(text, last):
                    past["ip"] = m.end()
                    if all(len(x) <= 3 and int(x or 0) <= 255 for x in (y.lstrip("0") for y in m[0].split("."))):
                        out["ip"].append(m.span())
                else:
                    past["ip"] = _RUN.match(text, last).end()
        elif anchor == "at":
            start = last
            while start > past["email"] and text[start - 1] in _LOCAL:
                start -= 1
            if start < last and (m := _DOMAIN.match(text, last + 1)):
                past["email"] = m.end()
                out["email"].append((start, m.end()))
        elif anchor == "plus":
            if last >= past["phone"] and (m := _PHONE.match(text, last)):
                past["phone"] = m.end()
                if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                    out["phone"].append(m.span())
        else:
            start = last - size + 1
            if start and text[start - 1].isalnum() or start < past[anchor]:
                continue
            m = {"secret": _SECRET, "account": _ACCOUNT, "url": _URL}[anchor].match(text, last + 1)
            if anchor == "url" and m:
                past["url"] = m.end()
                out["url"].append((start, m.end()))
            elif m and (anchor == "secret" or m[1][0].isdigit() or _iban(m[1])):
                past[anchor] = m.end()
                out[anchor].append(m.span(1))
    return [(kind, a, b) for kind in KINDS for a, b in sorted(out[kind])]


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span replaced by its kind in angle brackets; of overlapping spans the first and longest counts for all."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"<{kind.upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def annotate(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), redacted: bool = False) -> DataFrame:
    """Columns ``keep`` of docs, then n_email, n_ip, n_card, n_phone, base_sha256, spans, and pii_text (redacted) if asked for."""
    keep = without(keep, *(f"n_{k}" for k in BASE_KINDS), "base_sha256", "spans", "pii_text", "__text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            rows = []
            for text in texts_of(batch.column("__text")):
                spans = find_spans(text or "")
                base = [s for s in spans if s[0] in BASE_KINDS]
                row = [*(sum(s[0] == k for s in base) for k in BASE_KINDS), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)]
                rows.append(row + [text if text is None else redact(text, spans)] * redacted)
            names = [*(f"n_{k}" for k in BASE_KINDS), "base_sha256", "spans", *["pii_text"] * redacted]
            types = [pa.int64()] * 4 + [pa.string()] * (2 + redacted)
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)] if rows else [pa.array([], t) for t in types]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *columns], [*keep, *names])

    held = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.select(*keep).schema)
    schema = held + "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string" + ", pii_text string" * redacted
    return docs.select(*keep, F.col("text").cast("string").alias("__text")).mapInArrow(run, schema)


def redacted(docs: DataFrame) -> DataFrame:
    """The rows and columns of docs with personal data redacted in text; n_chars, if there is such a column, follows the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            texts = [None if t is None else redact(t, find_spans(t)) for t in texts_of(batch.column("text"))]
            new = {"text": texts, "n_chars": [None if t is None else len(t) for t in texts]}
            yield pa.RecordBatch.from_arrays([pa.array(new[f.name], f.type) if f.name in new else batch.column(f.name) for f in batch.schema], schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every text of documents."""
    return annotate(spread(spark.read.parquet(f"{sf_dir}/documents.parquet")))
