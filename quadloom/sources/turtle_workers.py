"""Task-side helpers of the Turtle reader: tokens and statements of one byte range."""

from __future__ import annotations

import codecs
import json
import re
from urllib.parse import urljoin

from .workers import open_plain, open_raw

# --- fixed values: tokens and vocabulary of Turtle (public grammar) ---
TOKEN = re.compile(r"""
    (?P<skip>[ \t\r\n]+|\#[^\n]*)
  | (?P<iri><[^<>"{}|^`\x00-\x20]*>)
  | (?P<long>\"\"\"[^"\\]*(?:(?:\\.|"(?!""))[^"\\]*)*\"\"\"|'''[^'\\]*(?:(?:\\.|'(?!''))[^'\\]*)*''')
  | (?P<open>\"\"\"|''')
  | (?P<str>"[^"\\\n\r]*(?:\\.[^"\\\n\r]*)*"|'[^'\\\n\r]*(?:\\.[^'\\\n\r]*)*')
  | (?P<at>@[a-zA-Z]+(?:-[a-zA-Z0-9]+)*)
  | (?P<dt>\^\^)
  | (?P<punct>[;,\[\]()])
  | (?P<num>[+-]?(?:(?:\d+\.\d*|\.\d+|\d+)[eE][+-]?\d+|\d*\.\d+|\d+))
  | (?P<blank>_:\w(?:[\w\-\u00B7]+|\.+(?=[\w\-\u00B7]))*)
  | (?P<pname>(?:[^\W\d_](?:[\w\-]+|\.+(?=[\w\-]))*)?:(?:[\w:%\-\u00B7]+|\\[_~.\-!$&'()*+,;=/?\#@%]|\.+(?=[\w:%\-\u00B7\\]))*)
  | (?P<word>[a-zA-Z]+)
  | (?P<dot>\.)
  | (?P<bad>.)
""", re.X | re.S)
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
XSD = "http://www.w3.org/2001/XMLSchema#"
ECHAR = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f", '"': '"', "'": "'", "\\": "\\"}
# --- end of fixed values ---
ESCAPE = re.compile(r"\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|(.))", re.S)
LONG = {"D": '"""', "S": "'''"}
INSIDE = {
    state: re.compile(r"[^\\%s]*(?:(?:\\.|%s(?!%s))[^\\%s]*)*" % (q[0], q[0], q[0] * 2, q[0]), re.S)
    for state, q in LONG.items()
}
BLOCK = 1 << 20
ROWS = 5000


def unescape(text: str) -> str:
    if "\\" not in text:
        return text

    def one(m):
        if m.group(3) is None:
            return chr(int(m.group(1) or m.group(2), 16))
        if m.group(3) not in ECHAR:
            raise ValueError(f"unknown escape \\{m.group(3)}")
        return ECHAR[m.group(3)]
    return ESCAPE.sub(one, text)


# ---------------------------------------------------------------- text of a range
def blocks(path: str, start: int, end: int, splittable: bool):
    """``(text, inside)`` blocks of whole lines: the lines that begin in the range, then
    those after it for a statement that runs on."""
    stream = open_raw(path) if splittable else open_plain(path)
    with stream:
        at = 0
        if start > 0:
            stream.seek(start - 1)
            at = start - 1 + len(_line(stream))
        pending, size, inside = [], 0, end < 0 or at < end
        while line := _line(stream):
            now = end < 0 or at < end
            if pending and (now != inside or size >= BLOCK):
                yield b"".join(pending).decode("utf-8"), inside
                pending, size = [], 0
            inside = now
            pending.append(line)
            size += len(line)
            at += len(line)
        if pending:
            yield b"".join(pending).decode("utf-8"), inside


def _line(stream) -> bytes:
    return stream.readline()


def first_line(path: str, start: int) -> int:
    """Where the first line that begins in a range does."""
    if start == 0:
        return 0
    with open_raw(path) as stream:
        stream.seek(start - 1)
        return start - 1 + len(_line(stream))


class Tokens:
    """Token stream of a range, starting in state N, or inside a long string (D or S).

    ``inside`` tells whether the current token begins in the range itself.
    """

    def __init__(self, source, state: str = "N", first: int = 0):
        self.source, self.state = source, state
        self.buffer, self.limit, self.inside = "", 0, True
        self.start = self.stop = self.char = 0
        self.byte = first  # where in the file the character at ``char`` of the buffer begins

    def offset(self, char: int) -> int:
        """Byte offset in the file of a character of the buffer, never before the last one asked."""
        self.byte += len(self.buffer[self.char:char].encode())
        self.char = char
        return self.byte

    def _drop(self, n: int):
        self.offset(n)
        self.buffer, self.limit, self.char = self.buffer[n:], max(0, self.limit - n), 0

    def _more(self) -> bool:
        block = next(self.source, None)
        if block is None:
            return False
        text, inside = block
        if inside and self.limit == len(self.buffer):
            self.limit += len(text)
        self.buffer += text
        return True

    def run(self):
        at = 0
        while True:
            if self.state != "N":
                quote = LONG[self.state]
                found = INSIDE[self.state].match(self.buffer, at).end()
                if not self.buffer.startswith(quote, found):
                    if not self._more():
                        return
                    continue
                at, self.state = found + 3, "N"
            if at >= len(self.buffer):
                self._drop(at)
                at = 0
                if not self._more():
                    return
                continue
            m = TOKEN.match(self.buffer, at)
            kind = m.lastgroup
            if kind == "open":
                if self._more():
                    continue
                self.state = "D" if m.group() == '"""' else "S"
                self.inside = at < self.limit
                self.start, self.stop = at, len(self.buffer)
                yield "open", m.group()
                return
            if at > BLOCK:
                self._drop(at)
                at = 0
                continue
            at = m.end()
            if kind != "skip":
                self.inside = m.start() < self.limit
                self.start, self.stop = m.span()
                yield kind, m.group()


# ---------------------------------------------------------------- what a range does to its successors
def end_state(source, state: str) -> str:
    tokens = Tokens(source, state)
    for _ in tokens.run():
        pass
    return tokens.state


def range_states(batches):
    """State at the end of every range for each state it may start in.

    A range without long quotes, the usual case, ends as it starts; only others are
    read again token by token, once per possible start.
    """
    for pdf in batches:
        out = {"N": [], "D": [], "S": []}
        for r in pdf.itertuples():
            def text(row=r):
                return _inside(blocks(row.path, row.start, row.end, True))
            plain = all('"""' not in t and "'''" not in t for t, _ in text())
            for state, column in out.items():
                column.append(state if plain else end_state(text(), state))
        yield pdf.assign(from_n=out["N"], from_d=out["D"], from_s=out["S"])


def _inside(source):
    for text, inside in source:
        if not inside:
            return
        yield text, inside


def range_directives(batches):
    """Prefix and base declarations that begin in a range, and whether it ends between
    statements (``open`` 0), within one (1), or holds no token at all (-1)."""
    for pdf in batches:
        found, ends = [], []
        for r in pdf.itertuples():
            declared, last = [], -1
            tokens = Tokens(blocks(r.path, r.start, r.end, True), r.state)
            stream = tokens.run()
            for kind, text in stream:
                if not tokens.inside:
                    break
                last = 0 if kind == "dot" else 1
                word = text.lower()
                if (kind == "at" and word in ("@prefix", "@base")) or (
                        kind == "word" and word in ("prefix", "base")):
                    name = next(stream, ("end", ""))[1] if word.endswith("prefix") else ""
                    target = next(stream, ("end", ""))[1]
                    declared.append([name, target[1:-1]])
                    last = 1 if kind == "at" else 0
            found.append(json.dumps(declared))
            ends.append(last)
        yield pdf.assign(declared=found, open=ends)


def carry_states(pdf):
    """Start state of every range of one file, from the end states of those before it."""
    state, states = "N", []
    pdf = pdf.sort_values("start")
    for r in pdf.itertuples():
        states.append(state)
        state = {"N": r.from_n, "D": r.from_d, "S": r.from_s}[state]
    return pdf.assign(state=states)[["source_idx", "file_idx", "path", "start", "end", "state"]]


def carry_declarations(pdf):
    """Declarations in force, and whether a statement is under way, where a range starts."""
    pdf = pdf.sort_values("start")
    base, env, running, envs, opens = "", {}, 0, [], []
    for r in pdf.itertuples():
        envs.append(json.dumps({"base": base, "prefixes": env}))
        opens.append(running)
        for name, target in json.loads(r.declared):
            full = urljoin(base, unescape(target)) if base else unescape(target)
            if name:
                env = {**env, name: full}
            else:
                base = full
        running = running if r.open == -1 else r.open
    return pdf.assign(env=envs, running=opens)[
        ["source_idx", "file_idx", "path", "start", "end", "state", "env", "running"]]


# ---------------------------------------------------------------- statements
class Statements:
    """Triples of the statements that begin in a range."""

    def __init__(self, row):
        known = json.loads(row.env)
        self.base, self.prefixes = known["base"], known["prefixes"]
        self.scope = f"{row.source_idx}/{row.file_idx}/"
        self.fresh = f"{self.scope}.{row.start}."
        self.n = 0
        splittable = row.end >= 0
        self.tokens = Tokens(blocks(row.path, row.start, row.end, splittable), row.state,
                             first_line(row.path, row.start))
        self.stream = self.tokens.run()
        self.running = bool(row.running) or row.state != "N"
        self.rows: list = []
        self.statement_no = 0
        self.held = self.last = None

    def fetch(self):
        return next(self.stream, ("end", ""))

    def next(self):
        token = self.fetch() if self.held is None else self.held
        self.held, self.last = None, token[0]
        return token

    def peek(self):
        if self.held is None:
            self.held = self.fetch()
        return self.held

    def take(self, kind, text=None):
        token = self.next()
        if token[0] != kind or (text is not None and token[1] != text):
            raise ValueError(f"expected {text or kind}, found {token[1]!r}")
        return token[1]

    def skip_statement(self):
        while (token := self.next())[0] not in ("dot", "end"):
            pass

    def run(self):
        """Yield lists of rows, each with the number of its statement; a faulty statement gives one
        reject row with its place in the file, whatever of it was handed over before."""
        if self.running:
            self.skip_statement()
        while True:
            self.last = None
            self.statement_no += 1
            kind, text = self.peek()
            if kind == "end" or not self.tokens.inside:
                break
            begin = self.tokens.offset(self.tokens.start)
            try:
                yield from self.statement()
            except ValueError as error:
                if self.last != "dot":
                    self.skip_statement()
                place = (begin, self.tokens.offset(self.tokens.stop))
                self.rows.append((None,) * 7 + (self.statement_no, str(error), *place))
            if len(self.rows) >= ROWS:
                yield self.rows
                self.rows = []
        if self.rows:
            yield self.rows

    def statement(self):
        kind, text = self.peek()
        word = text.lower()
        if (kind == "at" and word in ("@prefix", "@base")) or (
                kind == "word" and word in ("prefix", "base")):
            self.next()
            name = self.take("pname") if word.endswith("prefix") else None
            target = self.resolve(self.take("iri"))
            if name is None:
                self.base = target
            else:
                self.prefixes = {**self.prefixes, name: target}
            if kind == "at":
                self.take("dot")
            return
        if kind == "punct" and text == "[":
            self.next()
            subject = self.new_blank()
            if self.peek() == ("punct", "]"):
                self.next()
            else:
                self.properties(subject, "]")
                self.take("punct", "]")
                if self.peek()[0] == "dot":
                    self.next()
                    return
        elif kind == "punct" and text == "(":
            self.next()
            subject = self.collection()
        else:
            subject = self.term()
            if subject[0] == 2:
                raise ValueError("a literal cannot be a subject")
        yield from self.predicates(subject)
        self.take("dot")

    def predicates(self, subject):
        for _ in self.verbs(subject, ("dot", "end"), None):
            if len(self.rows) >= 20 * ROWS:  # one very long statement: hand over what is done
                yield self.rows
                self.rows = []

    def properties(self, subject, closer):
        for _ in self.verbs(subject, ("end",), closer):
            pass

    def verbs(self, subject, stops, closer):
        while True:
            kind, text = self.next()
            if kind == "word" and text == "a":
                predicate = RDF + "type"
            elif kind == "iri":
                predicate = self.resolve(text)
            elif kind == "pname":
                predicate = self.expand(text)
            else:
                raise ValueError(f"not a predicate: {text!r}")
            while True:
                value = self.object()
                self.emit(subject, predicate, value)
                yield
                if self.peek() != ("punct", ","):
                    break
                self.next()
            if self.peek() != ("punct", ";"):
                return
            while self.peek() == ("punct", ";"):
                self.next()
            kind, text = self.peek()
            if kind in stops or (kind == "punct" and text == closer):
                return

    def object(self):
        kind, text = self.peek()
        if kind == "punct" and text == "[":
            self.next()
            node = self.new_blank()
            if self.peek() != ("punct", "]"):
                self.properties(node, "]")
            self.take("punct", "]")
            return node
        if kind == "punct" and text == "(":
            self.next()
            return self.collection()
        return self.term()

    def collection(self):
        head = last = None
        while self.peek() != ("punct", ")"):
            item = self.object()
            cell = self.new_blank()
            if last is None:
                head = cell
            else:
                self.emit(last, RDF + "rest", cell)
            self.emit(cell, RDF + "first", item)
            last = cell
        self.next()
        nil = (1, RDF + "nil", "", "")
        if last is None:
            return nil
        self.emit(last, RDF + "rest", nil)
        return head

    def term(self):
        kind, text = self.next()
        if kind == "iri":
            return (1, self.resolve(text), "", "")
        if kind == "pname":
            return (1, self.expand(text), "", "")
        if kind == "blank":
            return (0, self.scope + text[2:], "", "")
        if kind == "num":
            name = "double" if "e" in text.lower() else "decimal" if "." in text else "integer"
            return (2, text, "", XSD + name)
        if kind == "word" and text in ("true", "false"):
            return (2, text, "", XSD + "boolean")
        if kind in ("str", "long"):
            value = unescape(text[1:-1] if kind == "str" else text[3:-3])
            nxt = self.peek()
            if nxt[0] == "at":
                self.next()
                return (2, value, nxt[1][1:].lower(), RDF + "langString")
            if nxt[0] == "dt":
                self.next()
                kind, text = self.next()
                if kind not in ("iri", "pname"):
                    raise ValueError(f"not a datatype: {text!r}")
                return (2, value, "", self.resolve(text) if kind == "iri" else self.expand(text))
            return (2, value, "", XSD + "string")
        raise ValueError(f"not a term: {text!r}")

    def new_blank(self):
        self.n += 1
        return (0, f"{self.fresh}{self.n}", "", "")

    def resolve(self, text):
        iri = unescape(text[1:-1])
        if self.base and not re.match(r"^[a-zA-Z][a-zA-Z0-9+.-]*:", iri):
            return urljoin(self.base, iri) if iri else self.base
        return iri

    def expand(self, text):
        prefix, local = text.split(":", 1)
        if prefix + ":" not in self.prefixes:
            raise ValueError(f"unknown prefix {prefix}:")
        if "\\" in local:
            local = re.sub(r"\\(.)", r"\1", local)
        return self.prefixes[prefix + ":"] + local

    def emit(self, s, p, o):
        self.rows.append((s[1], s[0], p, *o, self.statement_no, None, None, None))


def parse_ranges(batches):
    import pandas as pd

    columns = ["s", "s_kind", "p", "o_kind", "o_value", "o_lang", "o_dt", "statement", "error", "start", "end"]
    for pdf in batches:
        for row in pdf.itertuples():
            for rows in Statements(row).run():
                out = pd.DataFrame(rows, columns=columns, dtype=object)
                yield out.assign(source_idx=row.source_idx, file_idx=row.file_idx, range=row.start)


def reject_texts(batches):
    """The text of every rejected statement, in pieces; a file stays open for all of a run."""
    import pandas as pd

    def frame(rows):
        return pd.DataFrame(rows, columns=["source_idx", "file_idx", "start", "end", "error", "piece", "line"])

    path, stream, rows, size = None, None, [], 0
    try:
        for pdf in batches:
            for row in pdf.itertuples():
                if row.path != path:
                    if stream is not None:
                        stream.close()
                    path, stream = row.path, open_plain(row.path)
                decode = codecs.getincrementaldecoder("utf-8")().decode
                stream.seek(row.start)
                for piece, at in enumerate(range(row.start, row.end, BLOCK)):
                    line = decode(stream.read(min(BLOCK, row.end - at)))
                    rows.append((row.source_idx, row.file_idx, row.start, row.end, row.error, piece, line))
                    size += len(line)
                    if size >= BLOCK or len(rows) >= ROWS:
                        yield frame(rows)
                        rows, size = [], 0
        if rows:
            yield frame(rows)
    finally:
        if stream is not None:
            stream.close()
