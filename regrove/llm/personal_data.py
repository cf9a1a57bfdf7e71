"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, plus signs, digits, URL schemes and
cue words.  From each anchor a deterministic local parser expands left and right to the boundary
of an e-mail address, network address, card, phone number, URL, account or secret and checks it.
Every parser leaves a position behind which it has read, so work is linear in the text.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .words import lean

# The kinds, base ones first, in the order that breaks ties of position.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "url", "account", "secret")
ACCOUNT_CUES = ("account", "acct", "iban", "ssn", "passport", "konto", "compte", "cuenta")
SECRET_CUES = ("token", "secret", "password", "passwd", "api_key", "apikey", "api-key", "access_key")

LOCAL = frozenset(string.ascii_letters + string.digits + "._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
DIGITS = re.compile(r"[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
URL_REST = re.compile(r"[^\s<>\"'`{}|\\^]+")
ACCOUNT_REST = re.compile(r"(?:[\x20_-]?(?:number|no|nr|id))?\.?[\x20\t]{0,3}[:=#]?[\x20\t]{0,3}[\"']?([A-Za-z0-9]{1,34}(?:[\x20-][A-Za-z0-9]{1,34}){0,8})")
SECRET_REST = re.compile(r"(?:[\x20_-]?(?:key|token|id))?[\"']?[\x20\t]{0,3}[:=][\x20\t]{0,3}[\"']?([A-Za-z0-9_./+=~-]{8,})")


def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for c in string.digits:
        a.add_word(c, ("digit", 1))
    a.add_word("@", ("at", 1))
    a.add_word("+", ("plus", 1))
    a.add_word("://", ("scheme", 3))
    for kind, cues in (("account", ACCOUNT_CUES), ("secret", SECRET_CUES)):
        for cue in cues:
            for form in {cue, cue.capitalize(), cue.upper()}:
                a.add_word(form, (kind, len(cue)))
    a.make_automaton()
    return a


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def iban(value: str) -> bool:
    s = value.replace(" ", "").replace("-", "").upper()
    if not re.fullmatch(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}", s):
        return False
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def find_spans(text: str, tree: ahocorasick.Automaton) -> list[tuple[int, int, int]]:
    """(start, index of kind, end), ascending; starts and ends are code points."""
    found: list[tuple[int, int, int]] = []
    done = dict.fromkeys(KINDS, 0)      # each parser has read up to here
    for last, (anchor, size) in tree.iter(text):
        i = last - size + 1
        if anchor == "digit":
            if i >= done["card"]:
                m = CARD.match(text, i)
                done["card"] = m.end() if m else i + 1
                if m:
                    digits = m.group().replace(" ", "").replace("-", "")
                    if 12 <= len(digits) <= 19 and luhn(digits):
                        found.append((i, 2, m.end()))
            if i >= done["ip"]:
                m = IP.match(text, i)
                done["ip"] = m.end() if m else DIGITS.match(text, i).end()
                if m and all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.groups()):
                    found.append((i, 1, m.end()))
        elif anchor == "at":
            m = DOMAIN.match(text, i + 1)
            if m:
                s = i
                while s > done["email"] and text[s - 1] in LOCAL:
                    s -= 1
                if s < i:
                    done["email"] = m.end()
                    found.append((s, 0, m.end()))
        elif anchor == "plus":
            m = PHONE.match(text, i)
            if m and 9 <= sum(c in string.digits for c in m.group()) <= 15:
                found.append((i, 3, m.end()))
        elif anchor == "scheme":
            if i >= done["url"]:
                s = i
                while s > done["url"] and i - s < 12 and text[s - 1].isascii() and (text[s - 1].isalnum() or text[s - 1] in "+-."):
                    s -= 1
                m = URL_REST.match(text, i + 3)
                done["url"] = m.end() if m else i + 3
                end = m and i + 3 + len(m.group().rstrip(".,;:!?)]"))
                if m and s < i and end > i + 3 and text[s].isalpha():
                    found.append((s, 4, end))
        elif i >= done[anchor] and (i == 0 or not text[i - 1].isalnum()):
            rest = ACCOUNT_REST if anchor == "account" else SECRET_REST
            m = rest.match(text, last + 1)
            if m:
                span = account_span(m) if anchor == "account" else m.span(1)
                if span:
                    done[anchor] = span[1]
                    found.append((span[0], KINDS.index(anchor), span[1]))
    found.sort()
    return found


def account_span(m: re.Match) -> tuple[int, int] | None:
    """The longest run of groups that is an IBAN, else the leading groups that hold digits."""
    value, start = m.group(1), m.start(1)
    cuts = [x.end() for x in re.finditer(r"[A-Za-z0-9]+", value)]
    for cut in reversed(cuts):
        if iban(value[:cut]):
            return start, start + cut
    end = 0
    for part in re.finditer(r"[A-Za-z0-9]+", value):
        if not any(c in string.digits for c in part.group()):
            break
        end = part.end()
    return (start, start + end) if sum(c in string.digits for c in value[:end]) >= 5 else None


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """Overlapping spans become one placeholder, named after the first of them."""
    out, upto, i = [], 0, 0
    while i < len(spans):
        start, kind, end = spans[i]
        while i + 1 < len(spans) and spans[i + 1][0] < end:
            i += 1
            end = max(end, spans[i][2])
        out += [text[upto:start], f"<{KINDS[kind].upper()}>"]
        upto, i = end, i + 1
    return "".join(out) + text[upto:]


SPAN_SCHEMA = "spans string, base_spans string, " + ", ".join(f"n_{k} long" for k in KINDS) + ", redacted string"


def personal_spans(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",),
                   redacted: bool = False) -> DataFrame:
    """Spans of personal data of every text beside the columns named in ``keep``.

    ``spans`` and ``base_spans`` are comma-joined ``kind:start:end``; ``n_<kind>`` counts each kind.
    ``redacted`` fills a column with the text whose spans are replaced by placeholders (else null; a
    null text stays null).  A null or empty text has no spans.  Rows are judged one by one in one
    pass without a shuffle; other columns, whatever their names, are not read.
    """
    kinds = dict(docs.select(*keep).dtypes)
    schema = "".join(f"`{c}` {kinds[c]}, " for c in keep) + SPAN_SCHEMA

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = automaton()
        for batch in batches:
            every, base, clean = [], [], []
            counts: list[list[int]] = [[] for _ in KINDS]
            for value in batch.column(len(keep)):
                s = value.as_py()
                spans = find_spans(s, tree) if s else []
                every.append(joined(spans))
                base.append(joined([x for x in spans if x[1] < len(BASE_KINDS)]))
                for k, c in enumerate(counts):
                    c.append(sum(x[1] == k for x in spans))
                clean.append(redact(s, spans) if redacted and s else s if redacted else None)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(len(keep))), pa.array(every, pa.string()), pa.array(base, pa.string()),
                 *(pa.array(c, pa.int64()) for c in counts), pa.array(clean, pa.string())],
                [*keep, "spans", "base_spans", *(f"n_{k}" for k in KINDS), "redacted"])

    return docs.select(*keep, F.col(text).alias("__text")).mapInArrow(lean(find), schema)


def base_digest(spans: str = "base_spans"):
    """SHA-256 of the joined spans."""
    return F.sha2(F.encode(F.col(spans), "UTF-8"), 256)
