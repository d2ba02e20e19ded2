"""Span tables: what source files hold, as tagged rows with their places, from one pass over each file's tokens.

A pass keeps a stack of open brackets, so declarations and arguments may spread over lines, and every row knows the
method, the type and the block around it. A place is a number that orders the places of a file: the line above 20
bits, the column below. Rows of all kinds share one table; joins and windows on it do the rest.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TRACKED = ("java", "csharp", "cpp", "kotlin", "scala", "go", "php", "rust", "javascript")
COLUMNS = "path string, lang string, kind string, pos long, end_pos long, block_end long, method_pos long, method_end long, owner string, anonymous boolean, name string, receiver string, args array<string>, value string, type string"

_TOKEN = re.compile(
    r"(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z)|(?<![^\s])\#(?![\[!])[^\n]*)"
    r"|(?P<string>\"\"\".*?(?:\"\"\"|\Z)|(?:u8|[LuUR])?\"(?:[^\"\\\n]|\\.)*\"?|`[^`]*`?|'(?:[^'\\\n]|\\.)*')"
    r"|(?P<word>[A-Za-z_$@][\w$]*)|(?P<number>\d[\w.]*)"
    r"|(?P<mark>->|::|=>|<=|>=|==|!=|\+=|-=|\*=|/=|&&|\|\||\?\.|:=|[^\s\w])",
    re.S,
)
_DECLARES = {"kotlin": "fun", "scala": "def", "go": "func", "rust": "fn", "php": "function", "javascript": "function"}
_TYPES = {"class", "interface", "enum", "record", "struct", "trait", "object", "impl", "union"}
_WORDS = {"if", "for", "while", "switch", "catch", "return", "new", "else", "do", "try", "throw", "sizeof", "when", "match", "with", "lock", "using", "synchronized", "foreach", "elseif", "await", "case", "in", "delete", "throws"}
_NO_SEMICOLON = ("kotlin", "scala", "go", "javascript")
_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}"}, {")", "]", "}"}


@dataclass
class _Frame:
    """An open bracket: its token, what it is of, where its commas are, the assignments that wait for their end, and rows that wait for the block's end."""

    at: int
    mark: str
    of: str = ""
    name: str = ""
    value: str = ""
    anonymous: bool = False
    head: int = 0
    receiver: str = ""
    args: list[str] = field(default_factory=list)
    commas: list[int] = field(default_factory=list)
    waiting: list[tuple[int, int, str, str]] = field(default_factory=list)
    rows: list[list] = field(default_factory=list)


class _Pass:
    """One pass over a file's tokens."""

    def __init__(self, text: str, lang: str):
        self.text, self.lang, self.rows, self.stack = text, lang, [], [_Frame(-1, "{", "file")]
        self.heads: dict[tuple[int, int], tuple[str, list[str]]] = {}  # calls and constructions by their first token and the one after
        starts = [0, *(m.end() for m in re.finditer(r"\r\n|\r|\n", text))]
        self.tokens: list[tuple[str, str, int, int, int]] = []  # kind, text, start, end, place
        line = 0
        for m in _TOKEN.finditer(text):
            if m.lastgroup == "comment" and not (m[0][0] == "#" and lang != "php"):
                continue
            while line + 1 < len(starts) and starts[line + 1] <= m.start():
                line += 1
            self.tokens.append((m.lastgroup, m[0], m.start(), m.end(), (line + 1) << 20 | (m.start() - starts[line])))
        self.last = len(starts) << 20

    def place(self, at: int) -> int:
        return self.tokens[at][4] if at < len(self.tokens) else self.last

    def is_(self, at: int, *texts: str) -> bool:
        return 0 <= at < len(self.tokens) and self.tokens[at][1] in texts

    def kind(self, at: int) -> str:
        return self.tokens[at][0] if 0 <= at < len(self.tokens) else ""

    def source(self, low: int, high: int) -> str:
        """The text of tokens low to high - 1, a blank where there was white space."""
        return re.sub(r"\s+", " ", self.text[self.tokens[low][2] : self.tokens[high - 1][3]]) if high > low else ""

    def add(self, kind: str, low: int, high: int, name: str = "", receiver: str = "", args: list[str] | None = None, value: str = "", type_: str = "") -> list:
        """A row of the tokens low to high - 1, waiting for the ends of what is around it."""
        method = next((f for f in reversed(self.stack) if f.of == "method"), None)
        owner = next((f for f in reversed(self.stack) if f.of == "type"), None)
        high = min(high, len(self.tokens))  # brackets that are not closed end with the file
        end = self.place(high - 1) + len(self.tokens[high - 1][1]) - 1
        row = [kind, self.place(low), end, None, self.place(method.head) if method else None, None, owner.name if owner else "", owner.anonymous if owner else False, name, receiver, args or [], value, type_]
        next(f for f in reversed(self.stack) if f.mark == "{").rows.append(row)
        if method:
            method.rows.append(row)
        self.rows.append(row)
        return row

    def chain(self, at: int) -> int:
        """Where the expression that ends before token ``at`` with a dot or arrow begins."""
        low = at
        while self.is_(low - 1, ".", "->", "::", "?."):
            low -= 2
            while self.is_(low, ")", "]"):  # over a call or an index, back to its name
                depth = 0
                while low >= 0:
                    depth += (self.tokens[low][1] in _CLOSE) - (self.tokens[low][1] in _OPEN)
                    if depth == 0:
                        break
                    low -= 1
                low -= 1 if self.kind(low - 1) == "word" or self.is_(low - 1, ")", "]") else 0
            if self.is_(low - 1, "new"):
                low -= 1
        return max(low, 0)

    def flush(self, frame: _Frame, at: int) -> None:
        """Assignments of the frame end before token ``at``."""
        for low, begin, target, _ in frame.waiting:
            if at > begin:
                first = low
                while self.kind(first - 1) == "word" or self.is_(first - 1, "<", ">", "[", "]", "*", "&", "::", ".") or self.is_(first - 1, ",") and self.is_(first, "<", ">"):
                    first -= 1
                form, args = self.form(begin, at)
                self.add("assign", low, at, target, form, args, self.source(begin, at), self.source(first, low))
        frame.waiting.clear()

    def form(self, low: int, high: int) -> tuple[str, list[str]]:
        """What a value is and its parts: a call or construction and its arguments, a list in braces and its elements, a sum and its terms."""
        if (low, high) in self.heads:
            return self.heads[low, high]
        brace = next((k for k in range(low, min(high, low + 8)) if self.tokens[k][1] == "{"), None)
        if brace is not None and self.is_(high - 1, "}") and (brace == low or self.is_(low, "new")):
            return "{}", self.split(brace + 1, high - 1)
        terms = self.split(low, high, "+")
        return ("+", terms) if len(terms) > 1 else ("", [])

    def split(self, low: int, high: int, at: str = ",") -> list[str]:
        """The tokens low to high - 1, parted at a mark outside of brackets."""
        out, begin, depth = [], low, 0
        for k in range(low, high):
            t = self.tokens[k][1]
            depth += (t in _OPEN) - (t in _CLOSE)
            if t == at and depth == 0:
                out.append(self.source(begin, k))
                begin = k + 1
        return [*out, self.source(begin, high)] if high > low else []

    def opened(self, at: int) -> _Frame:
        t, frame = self.tokens[at][1], _Frame(at, self.tokens[at][1])
        if t == "(" and self.kind(at - 1) == "word" and self.tokens[at - 1][1] not in _WORDS and not (self.lang == "go" and self.is_(at - 1, "func")):
            low, name = self.chain(at - 1), self.tokens[at - 1][1]
            frame.name, frame.head, frame.of = name, low, "call"
            frame.receiver = self.source(low, at - 2) if low < at - 1 else ""
            if name[0] == "@":
                frame.of, frame.name = "mark", name[1:]
            elif self.is_(low - 1, "new"):
                frame.of, frame.name, frame.receiver, frame.head = "new", self.source(low, at).replace(" ", ""), "", low - 1
            elif self.declares(at - 1, low):
                frame.of = "declaration"
        elif t == "(" and self.is_(at - 1, ">") and (low := self.generic(at - 1)) is not None:
            frame.of, frame.name, frame.head = "new", self.source(low + 1, at), low
        elif t == "{":
            self.brace(frame, at)
        return frame

    def generic(self, at: int) -> int | None:
        """Where ``new T<...`` before the token begins, if that is what stands there."""
        for k in range(at, max(at - 16, -1), -1):
            if self.is_(k, "new"):
                return k
            if self.is_(k, ";", "{", "}", "(", ")"):
                return None
        return None

    def declares(self, at: int, low: int) -> bool:
        """Whether the name at token ``at`` is one that is being declared, as far as what stands before it says."""
        if self.declared is not None:  # the members that a constructor sets before its block
            return False
        word = _DECLARES.get(self.lang)
        if word and self.is_(at - 1, word):
            return True
        if self.lang == "go" and self.is_(at - 1, ")") or self.lang == "kotlin" and low < at and self.is_(low - 1, word):
            return self.head_has(at, word)
        if self.lang in ("kotlin", "scala", "go", "php", "rust"):
            return False
        around = self.stack[-1]
        if around.mark != "{" or around.of not in ("type", "file", "namespace") or around.waiting:
            return False
        return self.ends_in_body(at + 1)

    def head_has(self, at: int, word: str) -> bool:
        for k in range(at - 1, max(at - 40, -1), -1):
            if self.is_(k, word):
                return True
            if self.is_(k, ";", "{", "}"):
                return False
        return False

    def ends_in_body(self, at: int) -> bool:
        """Whether a block follows the parentheses that open at token ``at``, with nothing but a signature's words between."""
        depth = 0
        for k in range(at, min(len(self.tokens), at + 400)):
            t = self.tokens[k][1]
            if depth == 0 and k > at and t in ("{", ";", "=", "=>"):
                return t == "{"
            depth += (t in "([") - (t in ")]")
        return False

    def brace(self, frame: _Frame, at: int) -> None:
        """What a block is of: a method, a type, a namespace or a mere block."""
        around = self.stack[-1]
        pending = next((f for f in reversed(self.stack) if f.of == "pending"), None)
        if pending is not None and pending is around:
            return
        done = getattr(self, "declared", None)
        if done is not None:
            frame.of, frame.name, frame.head, frame.args, frame.value, frame.receiver = "method", *done
            self.declared = None
            return
        low = at - 1
        while low >= 0 and not self.is_(low, ";", "{", "}") and not (self.is_(low, ")") and self.lang not in ("kotlin", "scala", "csharp", "java")):
            low -= 1
        head = [self.tokens[k][1] for k in range(low + 1, at)]
        if self.is_(at - 1, ")", "]") and self.just_new is not None:
            frame.of, frame.name, frame.anonymous = "type", re.sub(r"<.*", "", self.just_new).split(".")[-1], True
        elif (k := self.type_word(head)) is not None:
            names = [w for w in head[k + 1 :] if re.match(r"[A-Za-z_$][\w$]*$", w)]
            if self.lang == "cpp" and len(names) > 1 and len(names[0]) > 2 and names[0].isupper():
                names = names[1:]  # a macro
            if head[k] == "impl" and "for" in head:
                names = head[head.index("for") + 1 :]
            frame.of, frame.name = "type", names[0] if names else ""
            row = self.add("type", low + 1, at, frame.name, "", None, self.source(low + 1, at))
            frame.rows.append(row)
        elif "namespace" in head or "package" in head or "extern" in head:
            frame.of = "namespace"

    def type_word(self, head: list[str]) -> int | None:
        """The place of the word that declares a type in what stands before a block; annotations may have parentheses."""
        depth = 0
        for k, w in enumerate(head):
            if depth == 0 and w in _TYPES and k + 1 < len(head) and "=" not in head[:k]:
                return k
            depth += (w == "(") - (w == ")")
        return None

    def closed(self, frame: _Frame, at: int) -> None:
        self.flush(frame, at)
        self.just_new = None
        if frame.mark == "(" and frame.of in ("call", "new", "mark"):
            args = self.split(frame.at + 1, at)
            self.add(frame.of, frame.head, at + 1, frame.name, frame.receiver, args, self.source(frame.head, at + 1))
            whole = f"new {frame.name}" if frame.of == "new" else f"{frame.receiver}.{frame.name}" if frame.receiver else frame.name
            self.heads[frame.head, at + 1] = whole, args
            if len(args) == 1 and len(terms := self.split(frame.at + 1, at, "+")) > 1:
                self.add("sum", frame.head, at + 1, frame.name, frame.receiver, terms, args[0], "new" if frame.of == "new" else "")
            if frame.of == "new":
                self.just_new = frame.name
        elif frame.mark == "(" and frame.of == "declaration":
            begin = frame.at - 1
            while begin > 0 and not self.is_(begin - 1, ";", "{", "}"):
                begin -= 1
            args: list[str] = []
            for part in self.split(frame.at + 1, at):  # a comma within angle brackets parts no parameters
                joins = args and args[-1].count("<") > args[-1].replace("->", "").replace("=>", "").count(">")
                args[-1:] = [f"{args[-1]}, {part}"] if joins else [*args[-1:], part]
            destroys = self.is_(frame.at - 2, "~")
            self.declared = ("~" * destroys + frame.name, begin, args, self.source(begin, frame.at - 1 - destroys), frame.receiver)
        elif frame.mark == "{":
            end = self.place(at)
            if not frame.of and self.is_(frame.at - 1, "]") and (low := self.generic(frame.at - 1)) is not None and at < len(self.tokens):
                self.add("array", low, at + 1, self.source(low + 1, frame.at), "", self.split(frame.at + 1, at), self.source(low, at + 1))
            for row in frame.rows:
                if row[0] == "type" and row[3] is None and frame.of == "type" and row[8] == frame.name:
                    row[2] = end
                elif frame.of == "method" and row[4] == self.place(frame.head) and row[5] is None:
                    row[5] = end
                if row[3] is None and row[0] != "type":
                    row[3] = end
            if frame.of == "method":
                row = self.add("method", frame.head, at + 1, frame.name, frame.receiver, frame.args, frame.value)
                row[2] = end

    def run(self) -> list[list]:
        self.declared, self.just_new, returned = None, None, None
        for at, (kind, t, *_rest) in enumerate(self.tokens):
            frame = self.stack[-1]
            if frame.waiting and self.lang in _NO_SEMICOLON and self.place(at) >> 20 > self.place(at - 1) >> 20 and not self.is_(at, ".", "+", "?.", "||", "&&", ")", ":") and not self.is_(at - 1, "+", "=", ",", "(", "||", "&&", ".", "=>", ":"):
                self.flush(frame, at)
            if kind == "string":
                self.add("literal", at, at + 1, "", "", None, t)
            elif t in _OPEN:
                self.stack.append(self.opened(at))
                self.just_new = None
            elif t in _CLOSE:
                while len(self.stack) > 1:
                    top = self.stack.pop()
                    self.closed(top, at)
                    if _OPEN[top.mark] == t:
                        break
            elif t in ("=", ":="):
                low = at - 1
                while self.is_(low, "]"):
                    low = next((k for k in range(low, -1, -1) if self.is_(k, "[")), 0) - 1
                if self.kind(low) == "word":
                    begin = self.chain(low)
                    frame.waiting.append((begin, at + 1, self.source(begin, low + 1).replace(" ", ""), t))
            elif t in (";", ","):
                if t == ";" or frame.mark == "{":
                    self.flush(frame, at)
                if t == ";":
                    self.declared = None
                    if returned is not None and returned[0] is frame:
                        self.add("return", returned[1], at, "", "", None, self.source(returned[1], at))
                        returned = None
            elif t == "delete" and self.lang == "cpp":
                low = at + 3 if self.is_(at + 1, "[") else at + 1
                end = next((k for k in range(low, min(low + 40, len(self.tokens))) if self.is_(k, ";", ")", ",")), low)
                self.add("delete", at, max(end, at + 1), self.source(low, end).replace(" ", ""), "", None, "[]" if low == at + 3 else "")
            elif t == "return" and at + 1 < len(self.tokens):
                returned = (frame, at + 1)
            if t not in _CLOSE and t not in ("{",):
                self.just_new = None if t not in ("(", "[") else self.just_new
        while len(self.stack) > 1:
            self.closed(self.stack.pop(), len(self.tokens))
        self.flush(self.stack[0], len(self.tokens))
        for row in self.rows:
            row[3] = self.last if row[3] is None else row[3]
            row[5] = self.last if row[4] is not None and row[5] is None else row[5]
        return self.rows


def tracked(files: DataFrame) -> DataFrame:
    """The span table of files (path, lang, text) in languages with braces.

    Kinds: type (name; value is its head), method (name, args are its parameters; value is what stands before its name; receiver qualifies it),
    mark (an annotation with arguments), call and new (name, receiver, args), array (args are its elements), sum (the terms of a call's only
    argument), assign (name is what is assigned, of what type if it is declared there; receiver tells the value's form and args its parts: a call and
    its arguments, a list in braces, a sum), return and literal (value), delete (name; value tells the form).
    ``block_end`` is the end of the block around a row, ``method_pos`` and ``method_end`` are the bounds of its method.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}
        for batch in batches:
            named = [c.split() for c in COLUMNS.split(", ")]
            arrow = pa.schema([pa.field(n, batch.schema.field("path").type if n == "path" else kinds[k]) for n, k in named])
            rows: list[list] = []
            for k, row in enumerate(batch.to_pylist()):
                rows += [[row["path"], row["lang"], *found] for found in _Pass(row["text"] or "", row["lang"]).run()]
                if rows and (len(rows) > 10_000 or k == len(batch) - 1):
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)
                    rows = []

    return files.where(F.col("lang").isin(*TRACKED)).select("path", "lang", "text").mapInArrow(run, COLUMNS.replace("path string", f"path {files.schema['path'].dataType.simpleString()}"))


def line(pos):
    """The line of a place."""
    return F.shiftright(pos, 20).cast("int")
