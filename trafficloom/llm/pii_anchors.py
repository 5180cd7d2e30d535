"""Operator 5: personal data by anchor expansion.

An Aho-Corasick automaton finds anchors in one pass over a text: at-signs, scheme marks, plus signs,
digits, identifier cues in any case, and the prefixes of well-known keys. At each anchor a small
deterministic parser walks left and right over the characters that the kind allows, then validates what
it found. A parser never looks further than the run of allowed characters, and no run is walked again
for another anchor inside it, so the work follows the text's length.

Kinds, in output order: email, ip, card, phone (the base kinds, equal to leftmost non-overlapping
matches of their patterns), then url (credentials in a link), account (IBAN with its check digits,
or digits after a cue) and secret (a long token after a cue, a key with a known prefix, a bearer token,
a private key block). Added kinds skip what a base kind covers.

Defined cases: null and empty texts have no spans; an empty table gives an empty table; every span is
inside its text, in code points, end exclusive; texts of any length are read whole; where spans of one added
kind overlap, the one whose anchor comes first stays; rows are searched one by one, so repeated rows give
repeated results; `report` ignores further columns; `redact` keeps all columns, replaces text (null stays
null) and sets n_chars where it exists.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from functools import lru_cache
from itertools import accumulate

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import batches, by_position, prepare, record_batch

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "url", "account", "secret")
LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
DIGITS = frozenset("0123456789")
LOCAL = frozenset(LETTERS + "0123456789._%+-")
LABEL = frozenset(LETTERS + "0123456789-")
DIALLED = frozenset(" ().0123456789-")
TOKEN = frozenset(LETTERS + "0123456789_-./+=")
ACCOUNT_CUES = ("account", "acct", "iban", "konto", "compte", "cuenta", "ssn", "passport")
SECRET_CUES = ("token", "api_key", "apikey", "api-key", "secret", "password", "passwd")
CUES = {c: "account" for c in ACCOUNT_CUES} | {c: "secret" for c in SECRET_CUES}
# How public services mark their keys, and the least length of what follows the mark.
KEY_PREFIXES = {"AKIA": 16, "ASIA": 16, "ghp_": 30, "gho_": 30, "ghs_": 30, "github_pat_": 30, "glpat-": 20, "sk_live_": 16, "xoxb-": 16, "xoxp-": 16, "AIza": 30}
BEARER, BLOCK = "bearer ", "-----begin "
LOWER = {k: k + 32 for k in range(65, 91)}
ALNUM = frozenset(LETTERS + "0123456789")
BASE64 = ALNUM | frozenset("+/=\r\n \t")
NOT_DIGITS = re.compile(r"[^0-9]+")


@lru_cache(maxsize=1)
def automaton() -> ahocorasick.Automaton:
    """Anchors as they stand in a text whose A-Z are lower case, each with its length."""
    a = ahocorasick.Automaton()
    for mark in ("@", "+", "://", *DIGITS, *CUES, BEARER, BLOCK):
        a.add_word(mark, (mark, len(mark)))
    for prefix in KEY_PREFIXES:
        a.add_word(prefix.lower(), (prefix, len(prefix)))
    a.make_automaton()
    return a


def lowered(text: str) -> str:
    """The text with small letters, code point by code point (no letter gets shorter, so equal lengths are aligned)."""
    small = text.lower()
    return small if len(small) == len(text) else text.translate(LOWER)


def run_end(text: str, at: int, allowed: frozenset) -> int:
    n = len(text)
    while at < n and text[at] in allowed:
        at += 1
    return at


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else (d * 2 if d < 5 else d * 2 - 9)
    return total % 10 == 0


def email_at(text: str, at: int, floor: int) -> tuple[int, int] | None:
    """The address around the at-sign at `at`; its local part may not reach back over `floor`."""
    start = at
    while start > floor and text[start - 1] in LOCAL:
        start -= 1
    if start == at:
        return None
    end = run_end(text, at + 1, LABEL)
    if end == at + 1:
        return None
    labels = 0
    while end < len(text) and text[end] == "." and (nxt := run_end(text, end + 1, LABEL)) > end + 1:
        end, labels = nxt, labels + 1
    return (start, end) if labels else None


def dotted_from(text: str, at: int) -> tuple[list[tuple[int, int, bool]], int]:
    """Fours of digit runs joined by dots from the run at `at`, with their validity; where the chain ends."""
    runs, end = [(at, run_end(text, at, DIGITS))], 0
    end = runs[0][1]
    while end + 1 < len(text) and text[end] == "." and text[end + 1] in DIGITS:
        runs.append((end + 1, run_end(text, end + 1, DIGITS)))
        end = runs[-1][1]
    found = []
    for k in range(0, len(runs) - 3, 4):
        four = runs[k: k + 4]
        valid = all(len(p := text[a:b].lstrip("0")) <= 3 and int(p or "0") <= 255 for a, b in four)
        found.append((four[0][0], four[3][1], valid))
    return found, end


def grouped_from(text: str, at: int) -> tuple[int, str]:
    """End and digits of the chain of digits, each after at most one blank or hyphen, that starts at `at`."""
    n, end = len(text), run_end(text, at, DIGITS)
    while end + 1 < n and text[end] in " -" and text[end + 1] in DIGITS:
        end = run_end(text, end + 1, DIGITS)
    return end, NOT_DIGITS.sub("", text[at:end])


def phone_at(text: str, at: int) -> tuple[int, int, bool] | None:
    """A number after the plus sign at `at`: (start, end, has 9 to 15 digits)."""
    if at + 1 >= len(text) or text[at + 1] not in DIGITS:
        return None
    end = run_end(text, at + 2, DIALLED)
    while end > at + 2 and text[end - 1] not in DIGITS:
        end -= 1
    if end < at + 4:
        return None
    return at, end, 9 <= len(NOT_DIGITS.sub("", text[at:end])) <= 15


def iban_valid(code: str) -> bool:
    moved = code[4:] + code[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def iban_at(text: str, at: int) -> tuple[int, int] | None:
    """An IBAN that starts at `at`: two capitals, two check digits, 11 to 30 further letters and digits, blanks between."""
    head = text[at: at + 4]
    if len(head) < 4 or not head.isascii() or not head[:2].isalpha() or not head[:2].isupper() or not head[2:].isdigit():
        return None
    stop, code = at, ""
    while stop < len(text) and len(code) < 34 and (text[stop] in ALNUM or text[stop] == " " and stop + 1 < len(text) and text[stop + 1] in ALNUM):
        code += text[stop].strip()
        stop += 1
    while len(code) >= 15:
        if code.isupper() and iban_valid(code) and (stop == len(text) or text[stop] not in ALNUM):
            return at, stop
        code = code[:-1]
        stop -= 1
        while stop > at and text[stop - 1] == " ":
            stop -= 1
    return None


def account_after(text: str, end: int) -> tuple[int, int] | None:
    """An IBAN, or 6 to 20 digits with blanks or hyphens, shortly after a cue that ends at `end`."""
    at = end
    while at < len(text) and at - end < 12 and text[at] in " \t:=#.'\"noNOumberUMBER":
        at += 1
    if at < len(text) and at > end and text[at] in DIGITS:
        stop, digits = grouped_from(text, at)
        if 6 <= len(digits) <= 20:
            return at, stop
    return iban_at(text, at)


def value_start(text: str, end: int) -> int | None:
    """Where the value begins that `=` or `:` gives to a cue that ends at `end`."""
    at = end
    while at < len(text) and at - end < 8 and text[at] in " \t'\"":
        at += 1
    if at >= len(text) or text[at] not in "=:":
        return None
    end = at = at + 1
    while at < len(text) and at - end < 8 and text[at] in " \t'\"":
        at += 1
    return at


def is_token(word: str, least: int) -> bool:
    """Of `least` characters or more, letters and digits mixed."""
    return len(word) >= least and any(c in DIGITS for c in word) and any(c in LETTERS for c in word)


def block_from(text: str, low: str, at: int) -> tuple[int, int] | None:
    """A private key block whose opening dashes are at `at`; one without an end line ends with its head line."""
    head = low.find("-----", at + len(BLOCK), at + len(BLOCK) + 40)
    if head < 0 or "private key" not in low[at:head]:
        return None
    at_end = run_end(text, head + 5, BASE64)
    close = low.find("-----", at_end + 9, at_end + 60) if low.startswith("-----end ", at_end) else -1
    return at, close + 5 if close > 0 else at_end


def url_around(text: str, at: int) -> tuple[int, int] | None:
    """A link whose authority carries user:password@, around the scheme mark at `at`."""
    start = at
    while start > 0 and text[start - 1] in LABEL:
        start -= 1
    end = at + 3
    while end < len(text) and not text[end].isspace() and text[end] not in "\"'<>/":
        end += 1
    authority = text[at + 3: end]
    return (start, end) if start < at and ":" in authority.partition("@")[0] and "@" in authority else None


def find(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans of each kind, in order of their starts."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    email_end = dotted_end = grouped_end = phone_end = 0
    cues: list[tuple[int, str]] = []
    low = lowered(text)
    for last, (mark, size) in automaton().iter(low):
        if mark in DIGITS:
            if last >= dotted_end:
                got, dotted_end = dotted_from(text, last)
                out["ip"] += [(a, b) for a, b, valid in got if valid]
            if last >= grouped_end:
                grouped_end, digits = grouped_from(text, last)
                if 13 <= len(digits) <= 19 and luhn(digits):
                    out["card"].append((last, grouped_end))
            if last > 2 and text[last - 1] in DIGITS and text[last - 2] in LETTERS and text[last - 3] in LETTERS and (last == 3 or text[last - 4] not in ALNUM):
                cues.append((last - 3, "iban at"))
        elif mark == "@":
            if got := email_at(text, last, email_end):
                out["email"].append(got)
                email_end = got[1]
        elif mark == "+":
            if last >= phone_end and (hit := phone_at(text, last)):
                phone_end = hit[1]
                if hit[2]:
                    out["phone"].append(hit[:2])
        else:
            cues.append((last + 1 - size, mark))
    if cues:
        expand(text, low, sorted(cues), out)
    return out


def expand(text: str, low: str, cues: list[tuple[int, str]], out: dict[str, list[tuple[int, int]]]) -> None:
    """Add the spans of the added kinds around the cues, given in the order of their places."""
    base = sorted(s for k in BASE_KINDS for s in out[k])
    starts, reach = [a for a, _ in base], [0, *accumulate((b for _, b in base), max)]
    walked = 0  # end of the last run of token characters: a cue inside it can't give a longer or another token
    for at, mark in cues:
        kind = "account" if mark == "iban at" else CUES.get(mark, "url" if mark == "://" else "secret")
        got = None
        if kind == "url":
            got = url_around(text, at)
        elif kind == "account":
            got = iban_at(text, at) if mark == "iban at" else account_after(text, at + len(mark))
        elif mark == BLOCK:
            got = block_from(text, low, at)
        else:
            known = KEY_PREFIXES.get(mark)
            first = at if known else at + len(mark) if mark == BEARER else value_start(text, at + len(mark))
            if first is not None and first >= walked and not (known and (not text.startswith(mark, at) or at and text[at - 1] in ALNUM)):
                walked = run_end(text, first, TOKEN)
                if is_token(text[first:walked], known + len(mark) if known else 20 if mark == BEARER else 12):
                    got = first, walked
        if not got or out[kind] and out[kind][-1][1] > got[0]:
            continue
        if kind == "url" or reach[bisect_left(starts, got[1])] <= got[0]:  # else a base span reaches into it
            out[kind].append(got)


def joined(spans: dict[str, list[tuple[int, int]]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in kinds for a, b in spans[k])


ADDED_KINDS = KINDS[len(BASE_KINDS):]
PERSONAL = pa.schema([
    ("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in BASE_KINDS), ("base_sha256", pa.string()), ("spans", pa.string()),
    *((f"n_{k}", pa.int64()) for k in ADDED_KINDS), ("has_personal_data", pa.bool_()),
])
PERSONAL_SQL = (
    "doc_id long, " + ", ".join(f"n_{k} long" for k in BASE_KINDS) + ", base_sha256 string, spans string, "
    + ", ".join(f"n_{k} long" for k in ADDED_KINDS) + ", has_personal_data boolean"
)


def report(documents: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, digest of the base spans, all spans as kind:start:end, counts of the added kinds, whether there is any span."""
    prepare(documents.sparkSession)

    def run(it):
        for part, texts in batches(it, 1):
            got = [find(t) for t in texts]
            yield record_batch({
                "doc_id": part.column(0), **{f"n_{k}": [len(x[k]) for x in got] for k in KINDS},
                "base_sha256": [hashlib.sha256(joined(x, BASE_KINDS).encode()).hexdigest() for x in got], "spans": [joined(x, KINDS) for x in got],
                "has_personal_data": [any(x.values()) for x in got],
            }, PERSONAL)

    return documents.select("doc_id", "text").mapInArrow(run, PERSONAL_SQL)


def masked(text: str) -> str:
    """The text with each stretch of personal data replaced by its kind; overlapping spans become one."""
    spans = sorted((a, b, k) for k, found in find(text).items() for a, b in found)
    if not spans:
        return text
    out, at, k = [], 0, 0
    while k < len(spans):
        start, end, kind = spans[k]
        while k + 1 < len(spans) and spans[k + 1][0] < end:
            k += 1
            end = max(end, spans[k][1])
        out += [text[at:start], f"<{kind.upper()}>"]
        at, k = end, k + 1
    return "".join(out) + text[at:]


def redact(df: DataFrame) -> DataFrame:
    """df with personal data in `text` replaced, n_chars renewed where it exists; other columns as they were."""
    prepare(df.sparkSession)
    at, names = df.columns.index("text"), df.columns
    sizes = df.schema["n_chars"].dataType if "n_chars" in names else None

    def run(it):
        for part, texts in batches(it, at):
            null = part.column(at).is_null().to_pylist()
            new = [None if gone else masked(t) for t, gone in zip(texts, null)]
            cols = [part.column(i) for i in range(len(names))]
            cols[at] = pa.array(new, pa.string())
            if sizes is not None:
                i = names.index("n_chars")
                cols[i] = pa.array([old if t is None else len(t) for t, old in zip(new, cols[i].to_pylist())], cols[i].type)
            yield pa.RecordBatch.from_arrays(cols, names=part.schema.names)

    plain = by_position(df)
    return plain.mapInArrow(run, plain.schema).toDF(*names)
