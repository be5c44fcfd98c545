"""Personal data by anchor expansion.

One Aho-Corasick automaton finds the anchors of a text in one pass: at-signs, schemes, a plus
before a digit, two digits around a point, two digits next to each other or a blank or hyphen
apart, and cues such as ``iban`` or ``account``.  Local parsers expand an anchor to its whole
boundaries and validate it.

Base kinds, each leftmost and non-overlapping; a match that fails its test is used up:

* ``email``  ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``
* ``ip``     four numbers of at most 255 with points between them
* ``card``   14 to 19 digits, a blank or hyphen at most between two, Luhn sum right
* ``phone``  a plus and 10 to 15 digits among blanks, points, hyphens and brackets

Kinds the method adds (base spans stay as they are):

* ``address``  a mail address with letters outside ASCII, whole; a URL's scheme, user and host
  where it names a user (``ftp://anna:secret@host``)
* ``account``  an IBAN (check digits right) after its cue; 6 to 20 digits, two capitals at most
  before them, after a cue for an account, a passport or a social security number

Plain URLs and secrets without an account are no personal data and are left alone.

Defined results: a null or empty text has no spans; equal rows each get theirs; spans are
offsets of code points, end exclusive, sorted by start, kind (in the order above) and end.
"""
from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, col

KINDS = ("email", "ip", "card", "phone", "address", "account")
BASE = KINDS[:4]
CUES = ("iban", "account", "acct", "konto", "cuenta", "compte", "passport", "ssn")
SCHEMES = ("http", "https", "ftp", "ftps", "sftp", "ssh")

_DIGITS = "0123456789"
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LABELS = re.compile(r"(?:[^\W_]|-)++(?:\.(?:[^\W_]|-)++)++")
_CHAIN = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_USER = re.compile(r"[^\x20\x09-\x0D/?#@:]++(?::[^\x20\x09-\x0D/?#@]*+)?@[A-Za-z0-9.-]++")
_IBAN = re.compile(r"[ :=#]{0,3}([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)")
_NUMBER = re.compile(r"(?: (?:[Nn][Uu][Mm][Bb][Ee][Rr]|[Nn][OoRr]))?[ :=#.]{1,3}([A-Z]{0,2}[0-9]+(?:[ -][0-9]+)*)")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def iban_valid(value: str) -> bool:
    v = value.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in v[4:] + v[:4])) % 97 == 1


def octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def anchors():
    """The automaton; a value is (kind number, length)."""
    import ahocorasick
    a = ahocorasick.Automaton()
    a.add_word("@", (0, 1))
    for x in _DIGITS:
        a.add_word("+" + x, (3, 2))
        for y in _DIGITS:
            a.add_word(f"{x}.{y}", (1, 3))
            for between in ("", " ", "-"):
                a.add_word(x + between + y, (2, 2 + len(between)))
    for s in SCHEMES:
        a.add_word(s + "://", (4, len(s) + 3))
    for c in CUES:
        a.add_word(c, (5, len(c)))
    a.make_automaton()
    return a


class Finder:
    """Spans of a text; one automaton for all texts of a worker."""

    def __init__(self):
        self.auto = anchors()

    def spans(self, text: str | None) -> list[tuple[int, int, int]]:
        """(start, kind number, end), sorted."""
        if not text:
            return []
        # only A-Z change, so offsets stay
        low = text if text.islower() and text.isascii() else text.encode("utf-8", "surrogatepass").translate(_LOWER).decode("utf-8", "surrogatepass")
        found: list[tuple[int, int, int]] = []
        ended = [0, 0, 0, 0, 0]                      # where the last expansion of each kind ended
        wide = 0                                     # and that of addresses by at-sign
        cues, schemes = [], []
        for end, (kind, size) in self.auto.iter(low):
            start = end + 1 - size
            if kind == 2:
                if start >= ended[2]:
                    m = _CARD.match(text, start)
                    ended[2] = m.end()
                    n = m.end() - start
                    if n >= 14:
                        digits = m[0].replace(" ", "").replace("-", "")
                        if 14 <= len(digits) <= 19 and luhn(digits):
                            found.append((start, 2, m.end()))
            elif kind == 1:
                if start >= ended[1]:
                    at = start
                    while at > ended[1] and text[at - 1] in _DIGITS:
                        at -= 1
                    m = _CHAIN.match(text, at)
                    ended[1] = m.end()
                    parts = m[0].split(".")
                    for k in range(0, len(parts) - 3, 4):
                        four = parts[k:k + 4]
                        size = sum(map(len, four)) + 3
                        if all(map(octet, four)):
                            found.append((at, 1, at + size))
                        at += size + 1
            elif kind == 0:
                at = start
                while at > ended[0] and text[at - 1] in _LOCAL:
                    at -= 1
                m = _DOMAIN.match(text, start + 1)
                if at < start and m:
                    found.append((at, 0, m.end()))
                    ended[0] = m.end()
                # the same with all letters and digits of Unicode
                far = start
                while far > wide and (text[far - 1] in _LOCAL or text[far - 1].isalnum()):
                    far -= 1
                m = _LABELS.match(text, start + 1)
                if far < start and m:
                    wide = m.end()
                    if not text[far:wide].isascii():
                        found.append((far, 4, wide))
            elif kind == 3:
                if start >= ended[3]:
                    m = _PHONE.match(text, start)
                    if m:
                        ended[3] = m.end()
                        if 10 <= sum(c in _DIGITS for c in m[0]) <= 15:
                            found.append((start, 3, m.end()))
            elif kind == 4:
                schemes.append((start, end + 1))
            else:
                cues.append((start, end + 1))
        last = 0
        for start, after in sorted(schemes):         # the longer scheme of one place begins first
            if start >= last and (m := _USER.match(text, after)):
                found.append((start, 4, m.end()))
                last = m.end()
        used = {True: 0, False: 0}                   # IBANs and numbers each on their own
        for start, after in sorted(cues):
            iban = low.startswith("iban", start)
            if start >= used[iban] and (m := (_IBAN if iban else _NUMBER).match(text, after)):
                used[iban] = m.end()
                if iban_valid(m[1]) if iban else 6 <= sum(c in _DIGITS for c in m[1]) <= 20:
                    found.append((m.start(1), 5, m.end(1)))
        return sorted(found)


_FINDER: list[Finder] = []


def _finder() -> Finder:
    if not _FINDER:
        _FINDER.append(Finder())                     # the anchors are fixed, one automaton a worker
    return _FINDER[0]


SPANS = "array<struct<kind:string,start:int,end:int>>"
_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def find_personal(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document row: doc_id and its spans."""
    bounded_batches(docs.sparkSession)
    src = docs.select(col(id_col).alias("doc_id"), col(text_col).cast("string").alias("text"))

    def run(batches):
        finder = _finder()
        for b in batches:
            offsets, kinds, starts, ends = [0], [], [], []
            for text in b.column(1).to_pylist():
                for s, k, e in finder.spans(text):
                    kinds.append(KINDS[k])
                    starts.append(s)
                    ends.append(e)
                offsets.append(len(kinds))
            structs = pa.StructArray.from_arrays([pa.array(kinds, pa.string()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())],
                                                 fields=list(_SPAN.value_type))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), structs)], names=["doc_id", "spans"])

    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, spans {SPANS}")


def digests(found: DataFrame) -> DataFrame:
    """The findings as counts of the base kinds, the digest of the base spans and all spans
    as ``kind:start:end``."""
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias("n_" + kind)
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return found.select("doc_id", *map(count, BASE),
                        F.sha2(F.encode(text(base), "UTF-8"), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))


def mask_personal(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every span of a text replaced by its kind in angle brackets (overlapping
    spans by the kind of the first); null texts stay null, all other columns as they are."""
    bounded_batches(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches):
        finder = _finder()
        for b in batches:
            out = []
            for text in b.column(at).to_pylist():
                parts, last = [], 0
                for s, k, e in finder.spans(text):
                    if s >= last:
                        parts += [text[last:s], f"<{KINDS[k].upper()}>"]
                    last = max(last, e)
                out.append("".join(parts) + text[last:] if parts else text)
            yield b.set_column(at, b.schema.field(at), pa.array(out, b.schema.field(at).type))

    # positional names, since mapInArrow would read a dot in a name as a field
    return docs.toDF(*[f"c{k}" for k in range(len(docs.columns))]).mapInArrow(run, docs.schema)
