"""Personal data by anchor expansion.

An Aho-Corasick automaton runs once over a text and finds anchors: at-signs, plus signs, digits,
URL schemes, account cues and street words. From each anchor a small parser of its kind expands
to the left and right and validates what it found. The parsers look at each character a bounded
number of times, whatever the length of a run.

Kinds email, ip, card and phone are exact; url, account (checked account numbers after a cue),
address (house number and street) and secret (keys and tokens after a cue) come on top. Positions are code points, end exclusive.
Null and empty texts have no spans.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame

from .common import as_text, mapped

KINDS = ("email", "ip", "card", "phone", "url", "account", "address", "secret")
BASE = 4
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DIGITS = "0123456789"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
URL = re.compile(r"[^\s<>\"'|\\^`{}]+")
IBAN = re.compile(r"[ :#.]{0,3}([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30})(?![A-Za-z0-9])")
NUMBER = re.compile(r"(?: (?:no\.?|number|nr\.?))?[ :#.]{1,3}([0-9]{3}-[0-9]{2}-[0-9]{4}|[0-9]{8,12})(?![0-9-])", re.IGNORECASE)
HOUSE = re.compile(r"(?<![0-9A-Za-z])([0-9]{1,5}[A-Za-z]? (?:[A-Z][A-Za-z'-]{0,20} ){1,3})$")
SECRET = re.compile(r"[\"']?[ \t]{0,4}[=:][ \t]{0,4}[\"']?([A-Za-z0-9+/_.=-]{16,})")
#: Fixed cues.
SCHEMES = ("http://", "https://", "ftp://")
ACCOUNT_CUES = ("IBAN", "iban", "SSN", "ssn", "Account", "account", "ACCOUNT", "Acct", "acct", "Passport", "passport")
STREET_CUES = (" Street", " Avenue", " Road", " Boulevard", " Lane", " Drive")
SECRET_CUES = ("token", "secret", "password", "passwd", "api_key", "apikey", "api-key", "access_key", "private_key")
STREET_REACH = 80


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def iban_valid(text: str) -> bool:
    s = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for cue, kind in [("@", "@"), ("+", "+"), *((d, "0") for d in DIGITS), *((s, "s") for s in SCHEMES), *((c, "a") for c in ACCOUNT_CUES), *((c, "w") for c in STREET_CUES), *((form(c), "k") for c in SECRET_CUES for form in (str.lower, str.upper, str.title))]:
        found.add_word(cue, (kind, len(cue)))
    found.make_automaton()
    return found


class Finder:
    def __init__(self) -> None:
        self.anchors = automaton()

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        """(start, kind number, end), sorted; base kinds as by their leftmost, non-overlapping patterns."""
        out: list[tuple[int, int, int]] = []
        email = ip = card = phone = url = account = address = secret = 0  # where the next match of the kind may begin
        for last, (kind, width) in self.anchors.iter(text):
            if kind == "0":
                if last >= card:
                    if m := CARD.match(text, last):
                        card = m.end()
                        digits = m[0].replace(" ", "").replace("-", "")
                        if 12 <= len(digits) <= 19 and luhn(digits):
                            out.append((last, 2, card))
                    else:
                        card = last + 1
                if last >= ip and (last == 0 or text[last - 1] not in DIGITS) and (m := IP.match(text, last)):
                    ip = m.end()
                    if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
                        out.append((last, 1, ip))
            elif kind == "@":
                start = last
                while start > email and text[start - 1] in LOCAL:
                    start -= 1
                if start < last and (m := DOMAIN.match(text, last + 1)):
                    email = m.end()
                    out.append((start, 0, email))
            elif kind == "+":
                if last >= phone and (m := PHONE.match(text, last)):
                    phone = m.end()
                    if 9 <= sum(c in DIGITS for c in m[0]) <= 15:
                        out.append((last, 3, phone))
            elif kind == "s":
                start = last - width + 1
                if start >= url and (m := URL.match(text, last + 1)):
                    url = last + 1 + len(m[0].rstrip(".,;:!?)]"))
                    if url > last + 1:
                        out.append((start, 4, url))
            elif kind == "a":
                if last >= account:
                    m = IBAN.match(text, last + 1)
                    if not (m and len(m[1].replace(" ", "")) <= 34 and iban_valid(m[1])):
                        m = NUMBER.match(text, last + 1)
                    if m:
                        account = m.end(1)
                        out.append((m.start(1), 5, account))
            elif kind == "k":
                if last >= secret and (m := SECRET.match(text, last + 1)) and any(c.isdigit() for c in m[1]) and any(c.isalpha() for c in m[1]):
                    secret = m.end(1)
                    out.append((m.start(1), 7, secret))
            else:
                start = last - width + 2  # the street word itself
                low = max(address, start - STREET_REACH)
                end_ok = last + 1 == len(text) or not text[last + 1].isalpha()
                if end_ok and (m := HOUSE.search(text[low:start])):
                    address = last + 1
                    out.append((low + m.start(), 6, address))
        return sorted(out)

    def redact(self, text: str) -> str:
        """Each stretch of overlapping spans becomes the name of its first kind in angle brackets."""
        out, at, stretch = [], 0, None
        for start, kind, end in self.spans(text):
            if stretch and start < stretch[2]:
                stretch[2] = max(stretch[2], end)
                continue
            if stretch:
                out += [text[at : stretch[0]], f"<{KINDS[stretch[1]].upper()}>"]
                at = stretch[2]
            stretch = [start, kind, end]
        if stretch:
            out += [text[at : stretch[0]], f"<{KINDS[stretch[1]].upper()}>"]
            at = stretch[2]
        return "".join([*out, text[at:]]) if out else text


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def find_pii(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans) of every row, in one narrow pass over whole texts.

    n_spans counts the spans of all kinds. Spans of one kind never overlap; of several kinds that begin at one place the first listed comes first. Repeated rows
    give repeated results, an empty table an empty one; other columns are not read.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        finder = Finder()
        for batch in batches:
            rows = []
            for text in batch["text"]:
                spans = finder.spans(as_text(text))
                base = [s for s in spans if s[1] < BASE]
                rows.append((*(sum(s[1] == k for s in base) for k in range(BASE)), hashlib.sha256(listed(base).encode()).hexdigest(), listed(spans), len(spans)))
            out = pd.DataFrame(rows, columns=["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_spans"])
            out.insert(0, id_col, batch[id_col].to_numpy())
            yield out

    kind = dict(df.dtypes)[id_col]
    return mapped(df.selectExpr(f"`{id_col}`", f"`{text_col}` AS text"), run, f"`{id_col}` {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long")


def redact_pii(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with every span of its texts replaced by the kind's name; n_chars, if there, follows. Null stays null."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        finder = Finder()
        for batch in batches:
            batch[text_col] = [finder.redact(t) if isinstance(t, str) else None for t in batch[text_col]]
            if "n_chars" in batch:
                batch["n_chars"] = [len(t) if isinstance(t, str) else n for t, n in zip(batch[text_col], batch["n_chars"], strict=True)]
            yield batch

    return mapped(df, run, df.schema)
