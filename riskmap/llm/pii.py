"""Personal data by anchor expansion.

An Aho-Corasick automaton runs once over each whole text and finds anchors: at-signs,
plus signs, digits, ``://`` and identifier cues (IBAN, SSN, account, password, ...), in
any mix of upper and lower case.  A local parser then expands each anchor to its
boundaries and validates it.  Parsers are deterministic and read every character a
bounded number of times, so very long runs cost linear time: an anchor inside a value
that has been read is not expanded again.

Base kinds (fixed grammar; leftmost, non-overlapping per kind, failing matches are
dropped without a retry): ``email``, ``ip`` (parts at most 255), ``card`` (16 to 19
digits, Luhn), ``phone`` (8 to 15 digits).  The method adds ``account`` (IBANs by
mod 97, social security and account numbers after their cue, credentials in a URL),
``secret`` (a value after password/token/key cues) and ``address`` (the network address
after a scheme: a host name, IPv4 or bracketed IPv6 address, with its port).  An address
by itself is no personal data: ``personal`` says whether a row has any other span.

Spans are (kind, start, end) in code points, end exclusive.  Defined cases: a null
or empty text has no spans; repeated rows give equal rows; a kept column that
shares a name with a result column is dropped.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from riskmap.llm.common import map_text, table

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "account", "secret", "address")
PERSONAL = KINDS[:-1]
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_DIGITS = re.compile(r"[0-9]++")
_IP = re.compile(r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_AFTER_CUE = re.compile(r"(?:\s{0,3}(?:no|nr|number|num|id|is)\b\.?)?\s{0,3}[:=#]?\s{0,3}[\"']?", re.IGNORECASE)
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}")
_SSN = re.compile(r"[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_ACCOUNT = re.compile(r"[0-9](?:[ -]?[0-9]){7,16}(?![0-9])")
_ASSIGN = re.compile(r"\s{0,3}[:=]\s{0,3}[\"']?")
_VALUE = re.compile(r"[^\s\"'&;,]{8,}+")
_CREDENTIALS = re.compile(r"[^\s/:@\"'<>]++:[^\s/:@\"'<>]++@(?=[A-Za-z0-9\[])")
_HOST = re.compile(r"(?:\[[0-9A-Fa-f:.]{2,45}+\]|[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*+)(?::([0-9]{1,5}+)(?![0-9]))?")
_CUES = {"iban": "iban", "ssn": "ssn", "social security": "ssn", "account": "number", "acct": "number",
         "konto": "number", "password": "secret", "passwd": "secret", "secret": "secret", "token": "secret",
         "api_key": "secret", "apikey": "secret", "api-key": "secret"}


def automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for digit in "0123456789":
        found.add_word(digit, ("digit", 1))
    found.add_word("@", ("at", 1))
    found.add_word("+", ("plus", 1))
    found.add_word("://", ("scheme", 3))
    for cue, kind in _CUES.items():
        found.add_word(cue, (kind, len(cue)))
    found.make_automaton()
    return found


def lowered(text: str) -> str:
    """The text with A-Z lower-cased: as many code points, at the same places."""
    return text.lower() if text.isascii() else text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if i % 2:
            n = n * 2 - 9 if n > 4 else n * 2
        total += n
    return total % 10 == 0


def _part_ok(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def _iban_ok(value: str) -> bool:
    value = value.replace(" ", "")
    return 15 <= len(value) <= 34 and int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97 == 1


def _address(text: str, start: int) -> tuple[int, int] | None:
    """Boundaries of the network address at ``start``."""
    match = _HOST.match(text, start)
    if not match or int(match[1] or 0) > 65535:
        return None
    host = match[0].partition(":")[0] if text[start] != "[" else ""
    labels = host.split(".")
    if host and (any(not x or len(x) > 63 or x[0] == "-" or x[-1] == "-" for x in labels)
                 or labels[-1].isdigit() and not (len(labels) == 4 and all(x.isdigit() and _part_ok(x) for x in labels))):
        return None
    return match.span()


def _cued(text: str, kind: str, end: int) -> tuple[str, int, int] | None:
    """The identifier that follows a cue ending at ``end``."""
    at = _AFTER_CUE.match(text, end).end()
    if kind == "iban":
        value = _IBAN.match(text, at)
        while value and not _iban_ok(value[0]):  # the longest prefix, by groups, that checks
            cut = value[0].rstrip().rfind(" ")
            if cut < 15:
                return None
            value = _IBAN.fullmatch(text, at, at + cut)
        return value and ("account", value.start(), value.end())
    value = (_SSN if kind == "ssn" else _ACCOUNT).match(text, at)
    return value and ("account", value.start(), value.end())


def spans(text: str | None, anchors) -> list[tuple[str, int, int]]:
    """All spans of a text: by kind as listed, then by start."""
    if not text:
        return []
    found: dict[str, list] = {k: [] for k in KINDS}
    done = dict.fromkeys(("email", "ip", "run", "card", "value"), 0)
    after_at = 0
    for last, (kind, length) in anchors.iter(lowered(text)):
        start, end = last + 1 - length, last + 1
        if kind == "digit":
            if start >= done["ip"] and start >= done["run"]:
                done["run"] = _DIGITS.match(text, start).end()
                match = _IP.match(text, start)
                if match:
                    done["ip"] = match.end()
                    if all(map(_part_ok, match[0].split("."))):
                        found["ip"].append((start, match.end()))
            if start >= done["card"]:
                match = _CARD.match(text, start)
                if match:
                    done["card"] = match.end()
                    digits = match[0].replace(" ", "").replace("-", "")
                    if 16 <= len(digits) <= 19 and luhn(digits):
                        found["card"].append((start, match.end()))
                else:
                    done["card"] = end
        elif kind == "at":
            low = max(done["email"], after_at)
            after_at = end
            left = low + len(text[low:start].rstrip(_LOCAL))
            match = _DOMAIN.match(text, end) if left < start else None
            if match:
                done["email"] = match.end()
                found["email"].append((left, match.end()))
        elif kind == "plus":
            match = _PHONE.match(text, start)
            if match and 8 <= sum(map(str.isdigit, match[0])) <= 15:
                found["phone"].append((start, match.end()))
        elif kind == "scheme":
            match = _CREDENTIALS.match(text, end)
            if match and (not found["account"] or end >= found["account"][-1][1]):
                found["account"].append((end, match.end() - 1))
            host = _address(text, match.end() if match else end)
            if host:
                found["address"].append(host)
        elif kind == "secret":
            lead = _ASSIGN.match(text, end)
            # a cue inside a value that was read has nothing to add, whether that one passed or not
            value = lead and lead.end() >= done["value"] and _VALUE.match(text, lead.end())
            if value:
                done["value"] = value.end()
                if any(map(str.isdigit, value[0])) and any(map(str.isalpha, value[0])):
                    found["secret"].append(value.span())
        else:
            hit = _cued(text, kind, end)
            if hit and (not found[hit[0]] or hit[1] >= found[hit[0]][-1][1]):
                found[hit[0]].append(hit[1:])
    return [(k, a, b) for k in KINDS for a, b in found[k]]


def _joined(items) -> str:
    return ",".join([f"{k}:{a}:{b}" for k, a, b in items])


def find_pii(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (all by default, but for the text) plus counts and spans."""
    keep = [c for c in docs.columns if c != text_col] if keep is None else keep

    def start():
        anchors = automaton()

        def fn(texts):
            rows = [spans(t, anchors) for t in texts]
            counts = [[sum(1 for s in r if s[0] == k) for r in rows] for k in KINDS]
            base = [hashlib.sha256(_joined(s for s in r if s[0] in BASE).encode()).hexdigest() for r in rows]
            any_ = [any(s[0] in PERSONAL for s in r) for r in rows]
            return [*counts[:4], base, [_joined(r) for r in rows], *counts[4:], any_]
        return fn

    longs = [T.StructField(f"n_{k}", T.LongType()) for k in KINDS]
    texts = [T.StructField(n, T.StringType()) for n in ("base_sha256", "spans")]
    personal = [T.StructField("personal", T.BooleanType())]
    return map_text(docs, text_col, keep, longs[:4] + texts + longs[4:] + personal, start)


def mask_pii(docs: DataFrame, text_col: str = "text", masked_col: str = "masked",
             kinds: tuple[str, ...] = PERSONAL) -> DataFrame:
    """All columns plus the text with every span of ``kinds`` replaced by ``[KIND]``;
    overlapping spans become one mark of the first kind."""
    def start():
        anchors = automaton()

        def masked(text):
            if text is None:
                return None
            out, at = [], 0
            for kind, a, b in sorted((s for s in spans(text, anchors) if s[0] in kinds), key=lambda s: (s[1], -s[2])):
                if a >= at:
                    out += [text[at:a], f"[{kind.upper()}]"]
                at = max(at, b)
            return "".join(out) + text[at:]
        return lambda texts: [[masked(t) for t in texts]]

    return map_text(docs, text_col, docs.columns, [T.StructField(masked_col, T.StringType())], start)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents"), keep=["doc_id"])
