"""Secret scan with one deterministic automaton for all rules.

The rule expressions are compiled together: Thompson construction, subset construction over
byte classes, minimisation by partition refinement, and then one flat transition array.  One
pass over the bytes of a text drives all rules at once.  When a state is reached in which a
rule has seen its shortest hit, a small local step finds the bounds of the whole span.

Edge cases: NULL and empty texts have no spans; equal texts have equal spans; offsets are code
points even in texts with multi-byte characters; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, utf8

# The base rules' kinds in their listed order, then the method's own.
BASE_KINDS = ("assign", "access", "hex")
KINDS = BASE_KINDS + ("token", "jwt", "pem")


@dataclass(frozen=True)
class Rule:
    """``hit``: the bytes after which the automaton reports the rule; ``whole``: the span, matched
    at its start; ``back``: the start is so many bytes before the end of the hit (0: the start
    of the run, -1: the keyword before it); ``least``: the least length of group ``group``.

    Hits are short prefixes: counting long runs inside the automaton would multiply its states.
    """

    kind: str
    hit: str
    whole: str
    back: int
    group: int = 0
    least: int = 1


RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]""",
         r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", -1, 2, 6),
    Rule("access", r"AKIA[A-Z0-9]", r"AKIA[A-Z0-9]+", 5, 0, 20),
    Rule("hex", r"[0-9a-f]{24}", r"[0-9a-f]+", 0),
    Rule("token", r"gh[pousr]_[A-Za-z0-9]", r"gh[pousr]_[A-Za-z0-9]{36,}", 5),
    Rule("token", r"xox[abprs]-[A-Za-z0-9]", r"xox[abprs]-[A-Za-z0-9-]{20,}", 6),
    Rule("token", r"sk_live_[A-Za-z0-9]", r"sk_live_[A-Za-z0-9]{24,}", 9),
    Rule("token", r"AIza[A-Za-z0-9_-]", r"AIza[A-Za-z0-9_-]{35}", 5),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", 4),
    Rule("pem", r"-----BEGIN [A-Z]", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----", 12),
)
CASELESS = {"assign"}


# ---- expression -> automaton -------------------------------------------------------------

class _Nfa:
    """Thompson automaton; ``edges[s]`` are (byte set, target), ``free[s]`` empty moves."""

    def __init__(self):
        self.edges, self.free = [], []

    def state(self) -> int:
        self.edges.append([])
        self.free.append([])
        return len(self.edges) - 1

    def add(self, text: str, start: int, caseless: bool) -> int:
        end, rest = self._alternatives(text, 0, start, caseless)
        assert rest == len(text), text
        return end

    def _alternatives(self, x, i, start, caseless):
        out = self.state()
        while True:
            begin = self.state()
            self.free[start].append(begin)
            end, i = self._sequence(x, i, begin, caseless)
            self.free[end].append(out)
            if i >= len(x) or x[i] != "|":
                return out, i
            i += 1

    def _sequence(self, x, i, at, caseless):
        while i < len(x) and x[i] not in "|)":
            begin = i
            i = self._skip(x, i)
            low, high, after = self._times(x, i)
            for _ in range(low):
                at = self._atom(x, begin, at, caseless)
            if high is None:
                loop = self.state()
                self.free[at].append(loop)
                self.free[self._atom(x, begin, loop, caseless)].append(loop)
                at = loop
            else:
                ends = [at]
                for _ in range(high - low):
                    at = self._atom(x, begin, at, caseless)
                    ends.append(at)
                out = self.state()
                for e in ends:
                    self.free[e].append(out)
                at = out
            i = after
        return at, i

    def _times(self, x, i):
        if i < len(x) and x[i] in "?*+":
            return (0, 1, i + 1) if x[i] == "?" else (int(x[i] == "+"), None, i + 1)
        if i < len(x) and x[i] == "{":
            low, comma, high = x[i + 1:x.index("}", i)].partition(",")
            return int(low), (int(high) if high else None) if comma else int(low), x.index("}", i) + 1
        return 1, 1, i

    def _skip(self, x, i):
        if x[i] == "(":
            depth = 0
            while True:
                depth += {"(": 1, ")": -1}.get(x[i], 0)
                if x[i] == "\\":
                    i += 1
                elif x[i] == "[":
                    i = x.index("]", i + 1)
                i += 1
                if not depth:
                    return i
        if x[i] == "[":
            return x.index("]", i + 1) + 1
        return i + (4 if x.startswith("\\x", i) else 2 if x[i] == "\\" else 1)

    def _atom(self, x, i, at, caseless):
        if x[i] == "(":
            return self._alternatives(x, i + 1, at, caseless)[0]
        # the class of a single character or bracket, as Python's own matcher sees it
        one = re.compile(x[i:self._skip(x, i)].encode(), re.S | (re.I if caseless else 0))
        to = self.state()
        self.edges[at].append((frozenset(b for b in range(256) if one.fullmatch(bytes([b]))), to))
        return to


@dataclass
class Automaton:
    """``table[state * width + cls[byte]]`` is the next state times width; a state times width
    of ``first`` or more has hits, listed in ``hits``."""

    table: list[int]
    cls: bytes
    width: int
    first: int
    hits: dict[int, tuple[int, ...]]


def compile_rules(rules=RULES) -> Automaton:
    """Subset construction of all rules after any prefix, then minimisation."""
    nfa = _Nfa()
    root = nfa.state()
    ends = {nfa.add(r.hit, root, r.kind in CASELESS): k for k, r in enumerate(rules)}
    # bytes that no edge tells apart share a class
    sets = sorted({e[0] for edges in nfa.edges for e in edges}, key=sorted)
    code: dict[tuple, int] = {}
    cls = bytes(code.setdefault(tuple(b in s for s in sets), len(code)) for b in range(256))
    samples = {c: b for b, c in reversed(list(enumerate(cls)))}

    def closed(states):
        todo, seen = list(states), set(states)
        while todo:
            for t in nfa.free[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(s for s in seen if nfa.edges[s] or s in ends)

    begin = closed({root})
    number, todo, moves = {begin: 0}, [begin], []
    for state in todo:
        row = []
        for c in range(len(code)):
            b = samples[c]
            to = closed({t for s in state for by, t in nfa.edges[s] if b in by} | {root})
            if to not in number:
                number[to] = len(todo)
                todo.append(to)
            row.append(number[to])
        moves.append(row)
    hit = [tuple(sorted(ends[s] for s in state if s in ends)) for state in todo]
    # refine the partition by (hits, blocks of the successors) until it is stable
    block = {h: i for i, h in enumerate(sorted(set(hit)))}
    part, n = [block[h] for h in hit], len(block)
    while True:
        names: dict[tuple, int] = {}
        part = [names.setdefault((part[s], *[part[t] for t in moves[s]]), len(names))
                for s in range(len(moves))]
        if len(names) == n:
            break
        n = len(names)
    member = {p: s for s, p in reversed(list(enumerate(part)))}
    # states without hits first, so one comparison tells whether a state has any
    order = sorted(range(n), key=lambda p: (bool(hit[member[p]]), p != part[0], p))
    place = {p: i for i, p in enumerate(order)}
    width = len(code)
    table = [place[part[t]] * width for p in order for t in moves[member[p]]]
    hits = {place[p] * width: hit[member[p]] for p in order if hit[member[p]]}
    return Automaton(table, cls, width, min(hits, default=n * width), hits)


# ---- scanning ---------------------------------------------------------------------------

KEYWORDS = (b"token", b"passwd", b"secret", b"apikey", b"api_key", b"password")
_HEX = frozenset(b"0123456789abcdef")
_SEPARATORS = frozenset(b"\"' :=")
_RUN = re.compile(rb"[A-Za-z0-9_-]*")
_WHOLE = [re.compile(r.whole.encode(), re.I if r.kind in CASELESS else 0) for r in RULES]


def _run_start(data: bytes, end: int, alphabet: frozenset) -> int:
    while end and data[end - 1] in alphabet:
        end -= 1
    return end


def _start(rule: Rule, data: bytes, at: int) -> int:
    """Start of the span whose hit ends at byte ``at`` (inclusive)."""
    if rule.back > 0:
        return at + 1 - rule.back
    if rule.back == 0:
        return _run_start(data, at + 1, _HEX)
    end = _run_start(data, at, _SEPARATORS)
    return next(end - n for n in (5, 6, 7, 8) if data[max(0, end - n):end].lower() in KEYWORDS)


def scan(data: bytes, automaton: Automaton) -> list[tuple[int, int, int]]:
    """Spans (start, number of the kind, end) in bytes, in one pass."""
    table, first, hits = automaton.table, automaton.first, automaton.hits
    last, spans, state = [0] * len(RULES), [], 0
    for at, c in enumerate(data.translate(automaton.cls)):
        state = table[state + c]
        if state >= first:
            for k in hits[state]:
                if at < last[k]:
                    continue  # inside a span that was already taken
                rule = RULES[k]
                begin = _start(rule, data, at)
                if begin < last[k]:
                    continue
                m = _WHOLE[k].match(data, begin)
                if m is None:  # then no later start in the same run of characters fits either
                    last[k] = max(at + 1, _RUN.match(data, begin).end())
                    continue
                last[k] = m.end()
                if m.end(rule.group) - m.start(rule.group) >= rule.least:
                    spans.append((begin, KINDS.index(rule.kind), m.end()))
    return sorted(spans)


def to_code_points(data: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    if not spans or data.isascii():
        return spans
    points, at, n = {}, 0, 0
    for p in sorted({p for s in spans for p in (s[0], s[2])}):
        n += len(data[at:p].decode("utf-8", "surrogatepass"))
        at = p
        points[p] = n
    return [(points[a], k, points[b]) for a, k, b in spans]


def find_secrets(docs: DataFrame) -> DataFrame:
    """``doc_id, spans`` with spans an array of (kind, start, end) in code points, for every
    row of ``docs(doc_id, text)``."""
    automaton = compile_rules()
    broadcast = docs.sparkSession.sparkContext.broadcast(automaton)  # fixed by the rules

    def run(batches):
        machine = broadcast.value
        for batch in batches:
            found = [to_code_points(t, scan(t, machine)) for t in batch.column("text").to_pylist()]
            yield {"doc_id": batch.column("doc_id"),
                   "spans": _span_array([[(KINDS[k], a, b) for a, k, b in row] for row in found])}

    return map_arrow(docs.select("doc_id", utf8(F.col("text")).alias("text")), run,
                     "doc_id bigint, spans array<struct<kind:string,start:int,end:int>>")


def _span_array(rows):
    import pyarrow as pa

    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    return pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in row] for row in rows], kind)


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with every span replaced by its kind; overlapping spans become one."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def digest(spans_col: str, base: tuple[str, ...]) -> list:
    """The digest columns shared by span queries: base hash and the joined spans."""
    text = lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])
    is_base = lambda s: s["kind"].isin(*base)
    joined = lambda c: F.array_join(F.transform(c, text), ",")
    return [F.sha2(joined(F.filter(spans_col, is_base)), 256).alias("base_sha256"),
            joined(F.col(spans_col)).alias("spans")]


def secrets_digest(docs: DataFrame) -> DataFrame:
    """The columns of the registered query."""
    found = find_secrets(docs)
    n = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("bigint").alias(f"n_{k}")
    return found.select("doc_id", *[n(k) for k in BASE_KINDS], *digest("spans", BASE_KINDS))
