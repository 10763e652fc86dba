"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors in one pass over a text: at-signs, address schemes and identifier
cues. A local parser grows each anchor to the left and right as far as the grammar of its kind allows and
validates what it has found. Digits have no anchor of their own; addresses of machines, cards and phone numbers
come from three linear patterns. All parsers read a character a bounded number of times, so very long
runs cost no more than their length.
"""

from __future__ import annotations

import hashlib
import re

import ahocorasick
from pyspark.sql import DataFrame

from runledger.llm.common import map_batches

#: Kinds in the order in which spans with the same start are listed; the first four are the base.
KINDS = ("email", "ip", "card", "phone", "url", "account")
BASE = 4

SCHEMES = ("http://", "https://", "ftp://", "mailto:", "ssh://")
CUES = ("account", "acct", "iban", "passport", "ssn", "tax id", "user id", "api key", "secret", "password", "token", "akia")

DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
URL = re.compile(r"[A-Za-z0-9._~%@:-]++(?:/[A-Za-z0-9._~%!$&*+,;=:@/?#-]*+)?")
AFTER_CUE = re.compile(r"(?:[ \t]?(?:no|nr|number|id|key)\b\.?)?[ \t]?[:=#]?[ \t]?[\"']?", re.I)
NUMBER = re.compile(r"[A-Za-z0-9_-]++")
KEY_ID = re.compile(r"AKIA[0-9A-Z]{16}(?![0-9A-Za-z])")
IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]){11,30}")
DIGITS = re.compile(r"[0-9]")


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    found.add_word("@", ("at", 1))
    for scheme in SCHEMES:
        for form in {scheme, scheme.upper(), scheme.capitalize()}:
            found.add_word(form, ("scheme", len(form)))
    for cue in CUES:
        for form in {cue, cue.upper(), cue.capitalize(), cue.title()}:
            found.add_word(form, ("key" if form == "AKIA" else "iban" if cue == "iban" else "cue", len(form)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    even = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (odd + even) % 10 == 0


def email_at(text: str, at: int, after: int) -> tuple[int, int] | None:
    """The address around the at-sign at ``at``, not before ``after``."""
    start = at
    while start > after and text[start - 1] in LOCAL:
        start -= 1
    host = DOMAIN.match(text, at + 1) if start < at else None
    return (start, host.end()) if host else None


def url_at(text: str, start: int, end: int) -> tuple[int, int] | None:
    """The address whose scheme lies at start:end; its host needs a dot, closing punctuation is left out."""
    if start and text[start - 1].isalnum():
        return None
    rest = URL.match(text, end)
    if not rest:
        return None
    stop = rest.end()
    while stop > end and text[stop - 1] in ".,;:!?":
        stop -= 1
    host = re.split("[/?#]", text[end:stop], maxsplit=1)[0]
    return (start, stop) if "." in host.strip(".") else None


def iban_at(text: str, at: int) -> tuple[int, int] | None:
    """A number whose check digits hold, with as many groups as they allow."""
    found = IBAN.match(text, at)
    if not found:
        return None
    ends = [i for i in range(found.end(), at + 14, -1) if text[i - 1] != " " and not text[i:i + 1].isalnum()]
    for end in ends:
        number = text[at:end].replace(" ", "")
        if 15 <= len(number) <= 34 and int("".join(str(int(c, 36)) for c in number[4:] + number[:4])) % 97 == 1:
            return at, end
    return None


def account_at(text: str, kind: str, start: int, end: int) -> tuple[int, int] | None:
    """The identifier that a cue at start:end announces: the value itself, 6 to 64 characters, 4 digits at least."""
    if kind == "key":
        found = None if start and text[start - 1].isalnum() else KEY_ID.match(text, start)
        return found.span() if found else None
    if start and text[start - 1].isalpha() or text[end:end + 1].isalpha():
        return None
    at = AFTER_CUE.match(text, end).end()
    if kind == "iban":
        return iban_at(text, at)
    found = NUMBER.match(text, at) if at > end else None
    if not found or not 6 <= found.end() - at <= 64 or len(DIGITS.findall(found[0])) < 4:
        return None
    return found.span()


def spans(text: str, anchors: ahocorasick.Automaton) -> list[tuple[int, int, int]]:
    """(start, end, kind as a place in KINDS) of all spans, by start and kind."""
    out, after, taken = [], 0, [0, 0]
    for last, (what, size) in anchors.iter(text):
        start, end = last + 1 - size, last + 1
        if what == "at":
            if found := email_at(text, start, after):
                after = found[1]
                out.append((*found, 0))
            continue
        kind = 4 if what == "scheme" else 5
        found = url_at(text, start, end) if kind == 4 else account_at(text, what, start, end)
        if found and found[0] >= taken[kind - 4]:
            taken[kind - 4] = found[1]
            out.append((*found, kind))
    for m in IP.finditer(text):
        if all(int(p[-4:]) <= 255 and not p[:-4].strip("0") for p in m[0].split(".")):
            out.append((*m.span(), 1))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((*m.span(), 2))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(DIGITS.findall(m[0])) <= 15:
                out.append((*m.span(), 3))
    return sorted(out, key=lambda s: (s[0], s[2], s[1]))


def joined(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in found)


def find_pii(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: doc_id, counts of the base kinds, base_sha256, spans.

    Spans are kind:start:end in code points, end exclusive, by start and then kind, joined by commas. Base
    kinds: email, ip, card, phone; added ones: url, account. A null text counts as empty (no spans); a null
    identifier stays null; repeated rows give repeated results; an empty table gives no rows; other columns
    are not returned.
    """
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"

    def make(batch):
        anchors = automaton()
        found = [spans(t or "", anchors) for t in batch.column(1).to_pylist()]
        base = [[s for s in f if s[2] < BASE] for f in found]
        counts = {f"n_{kind}": [sum(s[2] == k for s in f) for f in base] for k, kind in enumerate(KINDS[:BASE])}
        return counts | {
            "doc_id": batch.column(0), "spans": [joined(f) for f in found],
            "base_sha256": [hashlib.sha256(joined(f).encode()).hexdigest() for f in base],
        }

    return map_batches(df.select(id_col, text_col), make, schema)


def redacted(text: str | None, anchors: ahocorasick.Automaton) -> str | None:
    """The text with every span, overlapping ones as one, replaced by the name of its first kind."""
    if not text:
        return text
    out, at, union = [], 0, []
    for a, b, k in spans(text, anchors):
        if union and a < union[-1][1]:
            union[-1][1] = max(union[-1][1], b)
        else:
            union.append([a, b, k])
    for a, b, k in union:
        out += [text[at:a], f"<{KINDS[k]}>"]
        at = b
    return "".join([*out, text[at:]])


def redact_pii(df: DataFrame) -> DataFrame:
    """``documents`` with all personal data replaced in the text, and n_chars counted anew (null: null text)."""
    from pyspark.sql import functions as F

    def run(batches):
        import pyarrow as pa

        anchors = automaton()
        for batch in batches:
            at = batch.schema.get_field_index("text")
            clean = pa.array([redacted(t, anchors) for t in batch.column(at).to_pylist()], batch.schema.field(at).type)
            yield batch.set_column(at, "text", clean)

    return df.mapInArrow(run, df.schema).withColumn("n_chars", F.length("text").cast(df.schema["n_chars"].dataType))
