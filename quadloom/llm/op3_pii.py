"""Personal data by anchor expansion.

An Aho-Corasick automaton finds the places where a span can begin or must contain a fixed
character: at-signs, plus signs, digits, schemes and account cues.  From each anchor a
deterministic parser walks outwards to the bounds of the span and validates it.  Parsers never
look past the previous anchor of their kind, so a text is read a bounded number of times.

Edge cases: NULL and empty texts have no spans; equal texts have equal spans; offsets are code
points; very long texts take time in proportion to their length; an empty table gives no rows.
"""

from __future__ import annotations

import ahocorasick
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_arrow
from .op9_secrets import _span_array, digest, redact

# The base kinds in their listed order, then the method's own.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = BASE_KINDS + ("login_url", "iban", "account")

DIGITS = frozenset("0123456789")
ALNUM = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
LOCAL, LABEL = ALNUM | set("._%+-"), ALNUM | {"-"}
PHONE_BODY = DIGITS | set(" ().-")
ACCOUNT_CUES = ("account number", "account no", "acct no", "bank account", "kontonummer", "numéro de compte",
                "número de cuenta")
SCHEMES = ("http://", "https://", "ftp://")


def build_anchors() -> ahocorasick.Automaton:
    anchors = ahocorasick.Automaton()
    for d in "0123456789":
        anchors.add_word(d, ("digit", 1))
    anchors.add_word("@", ("at", 1))
    anchors.add_word("+", ("plus", 1))
    for s in SCHEMES:
        anchors.add_word(s, ("scheme", len(s)))
    for cue in ACCOUNT_CUES:
        for form in {cue, cue.capitalize(), cue.title(), cue.upper()}:
            anchors.add_word(form, ("cue", len(form)))
    for country in ("DE", "FR", "ES", "GB", "IT", "NL", "AT", "BE", "CH", "PT", "IE", "LU", "PL"):
        anchors.add_word(country, ("country", 2))
    anchors.make_automaton()
    return anchors


def _while(text: str, at: int, allowed: frozenset | set) -> int:
    """First position from ``at`` whose character is not allowed."""
    n = len(text)
    while at < n and text[at] in allowed:
        at += 1
    return at


def _email(text: str, at: int, last: int):
    """Around an at-sign: local part to the left, two labels or more to the right."""
    begin = at
    while begin > last and text[begin - 1] in LOCAL:
        begin -= 1
    end = _while(text, at + 1, LABEL)
    if begin == at or end == at + 1:
        return None
    dots = 0
    while end < len(text) and text[end] == ".":
        after = _while(text, end + 1, LABEL)
        if after == end + 1:
            break
        end, dots = after, dots + 1
    return (begin, end) if dots else None


def _ip(text: str, at: int):
    """From the first digit of a run: (end, valid), or None without four parts."""
    parts, end = [], at
    for k in range(4):
        if k:
            if end >= len(text) or text[end] != ".":
                return None
            end += 1
        after = _while(text, end, DIGITS)
        if after == end:
            return None
        parts.append(text[end:after])
        end = after
    return end, all(len(p.lstrip("0")) <= 3 and int(p[-4:] if len(p) > 4 else p) <= 255 for p in parts)


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _card(text: str, at: int):
    """From a digit: the longest run of digits with single blanks or hyphens between."""
    end, n = at, len(text)
    while end < n:
        if text[end] in DIGITS:
            end += 1
        elif text[end] in " -" and end + 1 < n and text[end + 1] in DIGITS:
            end += 2
        else:
            break
    if end == at + 1:
        return None
    digits = [c for c in text[at:end] if c in DIGITS]
    return end, 14 <= len(digits) <= 19 and _luhn("".join(digits))


def _phone(text: str, at: int):
    """From a plus sign: a digit, then a body whose last digit ends the span."""
    if at + 1 >= len(text) or text[at + 1] not in DIGITS:
        return None
    end = _while(text, at + 2, PHONE_BODY)
    while end > at + 3 and text[end - 1] not in DIGITS:
        end -= 1
    if end <= at + 3:
        return None
    return end, 10 <= sum(c in DIGITS for c in text[at:end]) <= 15


def _iban(text: str, at: int):
    """Two letters, two digits and 11 to 30 characters in groups, passing the mod 97 test."""
    if at and text[at - 1] in ALNUM or not (at + 4 <= len(text) and text[at + 2] in DIGITS and text[at + 3] in DIGITS):
        return None
    end, compact = at, []
    while end < len(text) and len(compact) < 35:
        c = text[end]
        if c in ALNUM and not c.islower():
            compact.append(c)
            end += 1
        elif c == " " and end + 1 < len(text) and text[end + 1] in ALNUM and len(compact) % 4 == 0:
            end += 1
        else:
            break
    while len(compact) >= 15:
        moved = "".join(compact[4:] + compact[:4])
        if (end >= len(text) or text[end] not in ALNUM) and int("".join(str(int(c, 36)) for c in moved)) % 97 == 1:
            return at, end
        while end > at and text[end - 1] != " ":  # try without the last group
            end -= 1
            compact.pop()
        end -= 1
    return None


def _account(text: str, end: int):
    """After an account cue: at most a few separators, then 6 to 17 digits."""
    at = end
    while at < len(text) and at < end + 4 and text[at] in " :#.=":
        at += 1
    after = _while(text, at, DIGITS)
    whole = after >= len(text) or text[after] not in ALNUM
    return (at, after) if 6 <= after - at <= 17 and whole else None


def _login_url(text: str, at: int):
    """A url with user and password before its host."""
    end = at
    while end < len(text) and text[end] not in " \t\n\r\x0b\x0c<>\"'/?#":
        end += 1
    user, sign, host = text[at:end].rpartition("@")
    return end if sign and host and ":" in user and user[0] != ":" else None


def find_spans(text: str, anchors: ahocorasick.Automaton) -> list[tuple[str, int, int]]:
    """All spans (kind, start, end) by start, then kind as listed."""
    spans = []
    last = dict.fromkeys(KINDS, 0)
    previous_at, run = -1, -1

    def take(kind, begin, end, good=True):
        last[kind] = end
        if good:
            spans.append((kind, begin, end))

    for end, (what, size) in anchors.iter(text):
        at = end + 1 - size
        if what == "digit":
            if at != run + 1 or at == 0 or text[at - 1] not in DIGITS:
                new_run = True
            else:
                new_run = False
            run = at
            if at >= last["card"]:
                found = _card(text, at)
                if found:
                    take("card", at, *found)
            if at >= last["ip"] and (new_run or at == last["ip"]):
                found = _ip(text, at)
                if found:
                    take("ip", at, *found)
        elif what == "at":
            found = _email(text, at, max(last["email"], previous_at + 1))
            previous_at = at
            if found:
                take("email", *found)
        elif what == "plus":
            if at >= last["phone"]:
                found = _phone(text, at)
                if found:
                    take("phone", at, *found)
        elif what == "scheme":
            stop = _login_url(text, end + 1)
            if stop and at >= last["login_url"]:
                take("login_url", at, stop)
        elif what == "country":
            found = _iban(text, at) if at >= last["iban"] else None
            if found:
                take("iban", *found)
        else:
            found = _account(text, end + 1)
            if found and found[0] >= last["account"]:
                take("account", *found)
    rank = {k: i for i, k in enumerate(KINDS)}
    return sorted(spans, key=lambda s: (s[1], rank[s[0]], s[2]))


def _text_spans(texts: list) -> list:
    anchors = _anchors()
    return [find_spans(t, anchors) if t else [] for t in texts]


_cache: list = []


def _anchors():
    """One automaton per Python worker; its size is that of the fixed anchor list."""
    if not _cache:
        _cache.append(build_anchors())
    return _cache[0]


def find_pii(docs: DataFrame) -> DataFrame:
    """``doc_id, spans`` (an array of kind, start, end in code points) for every row."""

    def run(batches):
        for batch in batches:
            yield {"doc_id": batch.column("doc_id"),
                   "spans": _span_array(_text_spans(batch.column("text").to_pylist()))}

    return map_arrow(docs.select("doc_id", "text"), run,
                     "doc_id bigint, spans array<struct<kind:string,start:int,end:int>>")


def mask_pii(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every span of ``text`` replaced by ``[kind]``; other columns as they are."""

    @F.pandas_udf("string")
    def masked(texts):
        return texts.map(lambda t: redact(t, find_spans(t, _anchors())) if t else t)

    return docs.withColumn(text, masked(F.col(text)))


def pii_digest(docs: DataFrame) -> DataFrame:
    """The columns of the registered query."""
    def n(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return find_pii(docs).select("doc_id", *[n(k) for k in BASE_KINDS], *digest("spans", BASE_KINDS))
