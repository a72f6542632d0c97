"""Personal data by anchor expansion: one Aho-Corasick pass finds at-signs, schemes, plus signs and other identifier
cues; at each anchor a deterministic local parser expands to the left and right and validates what it finds.

Base kinds (leftmost, non-overlapping within a kind; a match that fails its check is dropped and not retried):
  email  [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+
  ip     [0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+), each part at most 255
  card   [0-9]([\\x20-]?[0-9])+, 12 to 19 digits passing Luhn
  phone  \\+[0-9][\\x20().0-9-]+[0-9], 9 to 15 digits
Added by the anchors: url (scheme and authority up to white space or a quote), iban (the length of its country, mod
97), ssn (3-2-4 digits of an area, group and serial that are given out) and secret (the value after a key cue such as
token or password, 16 or more characters of one run; a key that begins as its issuer's do; a private key's header).
Cues are found in any case of A-Z. Spans are code points, end exclusive; null text has none."""

from __future__ import annotations

import string

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimlens.llm.common import documents, given_back

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "url", "iban", "ssn", "secret")
KEY_CUES = ("token", "password", "passwd", "secret", "api_key", "api-key", "apikey", "access_key", "private_key")
# fixed values: how issuers' keys begin, and how many characters of a key follow at least
KEY_STARTS = {"AKIA": 16, "ASIA": 16, "ghp_": 36, "gho_": 36, "github_pat_": 22, "glpat-": 20, "sk-": 20, "sk_live_": 16, "xoxb-": 20, "xoxp-": 20, "AIza": 35}
HEADER = "-----BEGIN "
# fixed values: lengths of account numbers by country (ISO 13616)
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22,
    "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22,
    "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30,
    "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31,
    "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SE": 24,
    "SI": 19, "SK": 24, "SM": 27, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}
_DIGITS = frozenset(string.digits)
_LABEL = frozenset(string.ascii_letters + string.digits + "-")
_LOCAL = frozenset(string.ascii_letters + string.digits + "._%+-")
_PHONE = frozenset(" ().-" + string.digits)
_SCHEME = frozenset(string.ascii_letters + string.digits + "+.-")
_VALUE = frozenset(string.ascii_letters + string.digits + "_-+/=.")
_CODE = frozenset(string.ascii_uppercase + string.digits)
_ASCII = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
_STOP = frozenset(" \t\n\r\x0b\x0c<>\"'`{}|\\^")


def automaton():
    """Anchors, in lower case, and the parser each wakes. Two digits next to each other, or with one separator between,
    begin a card; digit, dot, digit begins an address."""
    import ahocorasick

    a = ahocorasick.Automaton()
    a.add_word("@", ("email", 0))
    a.add_word("://", ("url", 2))
    for d in string.digits:
        a.add_word("+" + d, ("phone", 1))
        for e in string.digits:
            a.add_word(f"{d}.{e}", ("ip", 2))
            for sep in ("", " ", "-"):
                a.add_word(d + sep + e, ("card", len(sep) + 1))
    for cue in KEY_CUES:
        a.add_word(cue, ("secret", -1))
    for start in KEY_STARTS:
        a.add_word(start.lower(), ("key", len(start) - 1))
    a.add_word(HEADER.lower(), ("header", len(HEADER) - 1))
    a.make_automaton()
    return a


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = ord(c) - 48
        total += x if i % 2 == 0 else x * 2 - 9 * (x > 4)
    return total % 10 == 0


def _run(t: str, i: int, kind: frozenset) -> int:
    n = len(t)
    while i < n and t[i] in kind:
        i += 1
    return i


def _email(t: str, at: int, done: int):
    s = at
    while s > done and t[s - 1] in _LOCAL:
        s -= 1
    if s == at:
        return None
    e = _run(t, at + 1, _LABEL)
    if e == at + 1:
        return None
    labels = 1
    while e < len(t) and t[e] == ".":
        f = _run(t, e + 1, _LABEL)
        if f == e + 1:
            break
        e, labels = f, labels + 1
    return (s, e, True) if labels > 1 else None


def _digits_left(t: str, i: int, done: int) -> int:
    while i > done and t[i - 1] in _DIGITS:
        i -= 1
    return i


def _ip(t: str, at: int, done: int):
    s = _digits_left(t, at, done)
    e, parts = _run(t, s, _DIGITS), 1
    ok = _small(t[s:e])
    while parts < 4 and e < len(t) and t[e] == ".":
        f = _run(t, e + 1, _DIGITS)
        if f == e + 1:
            return None
        ok = ok and _small(t[e + 1 : f])
        e, parts = f, parts + 1
    return (s, e, ok) if parts == 4 else None


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def _card(t: str, at: int, done: int):
    e = at + 1
    n = len(t)
    while e < n:
        if t[e] in _DIGITS:
            e += 1
        elif t[e] in " -" and e + 1 < n and t[e + 1] in _DIGITS:
            e += 2
        else:
            break
    digits = t[at:e].replace(" ", "").replace("-", "")
    return at, e, 12 <= len(digits) <= 19 and luhn(digits)


def _phone(t: str, at: int, done: int):
    e = _run(t, at + 2, _PHONE)
    while e > at + 3 and t[e - 1] not in _DIGITS:
        e -= 1
    if e <= at + 3:
        return None
    return at, e, 9 <= sum(c in _DIGITS for c in t[at:e]) <= 15


def _url(t: str, at: int, done: int):
    s = at
    while s > done and t[s - 1] in _SCHEME:
        s -= 1
    e = at + 3
    while e < len(t) and t[e] not in _STOP:
        e += 1
    while e > at + 3 and t[e - 1] in ".,;:!?)]":
        e -= 1
    return (s, e, True) if s < at and t[s].isalpha() and e > at + 3 else None


def _secret(t: str, at: int, done: int):
    i = at
    while i < len(t) and t[i] in " \t":
        i += 1
    if i >= len(t) or t[i] not in "=:":
        return None
    i += 1
    while i < len(t) and t[i] in " \t\"'":
        i += 1
    e = _run(t, i, _VALUE)
    return (i, e, True) if e - i >= 16 else None


def _key(t: str, at: int, done: int):
    """A key whose first characters, at at, are its issuer's, at the start of a run."""
    if at and (t[at - 1].isalnum() or t[at - 1] in "_-"):
        return None
    for start, least in KEY_STARTS.items():
        if t.startswith(start, at):
            e = _run(t, at + len(start), _VALUE)
            if e - at - len(start) >= least:
                return at, e, True
    return None


def _header(t: str, at: int, done: int):
    """A private key from its header up to its footer, or the header alone."""
    e = t.find("-----", at + len(HEADER), at + len(HEADER) + 64)
    if e < 0 or not t[at:e].endswith("PRIVATE KEY"):
        return None
    foot = "-----END " + t[at + len(HEADER) : e] + "-----"
    end = t.find(foot, e)
    return at, end + len(foot) if end >= 0 else e + 5, True


def _iban(t: str, s: int, done: int):
    """At two capitals and two digits: as many capitals and digits as the country has, with single spaces between, that no
    other follows; mod 97 = 1."""
    size = IBAN_LENGTHS.get(t[s : s + 2], 0)
    if not size or s and t[s - 1].isalnum():
        return None
    e, code = s, ""
    while e < len(t) and len(code) < size:
        if t[e] in _CODE:
            code += t[e]
            e += 1
        elif t[e] == " " and e + 1 < len(t) and t[e + 1] in _CODE:
            e += 1
        else:
            return None
    if len(code) < size or e < len(t) and t[e].isalnum():
        return None
    return (s, e, True) if int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1 else None


def _is_ssn(t: str, s: int, e: int) -> bool:
    return e - s == 11 and t[s + 3] == t[s + 6] == "-" and t[s : s + 3] not in ("000", "666") and t[s] != "9" and t[s + 4 : s + 6] != "00" and t[s + 7 : e] != "0000" and sum(c in _DIGITS for c in t[s:e]) == 9


_PARSERS = {"email": _email, "ip": _ip, "card": _card, "phone": _phone, "url": _url, "secret": _secret, "key": _key, "header": _header}
_KIND = {"key": "secret", "header": "secret"}


def find(text: str, anchors) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all spans, by start and then the order of KINDS."""
    done = dict.fromkeys(KINDS, 0)
    out = []
    low = text.lower()
    if len(low) != len(text):  # some letters are two in lower case; cues are A-Z only
        low = text.translate(_ASCII)
    for end, (parser, back) in anchors.iter(low):
        at, kind = end - back, _KIND.get(parser, parser)
        if parser == "card" and 2 <= at and text[at - 2 : at] in IBAN_LENGTHS and at - 2 >= done["iban"]:
            if m := _iban(text, at - 2, 0):
                done["iban"] = m[1]
                out.append((m[0], m[1], "iban"))
        if at < done[kind]:
            continue
        if m := _PARSERS[parser](text, at, done[kind]):
            done[kind] = m[1]
            if m[2]:
                out.append((m[0], m[1], kind))
            elif parser == "card" and _is_ssn(text, m[0], m[1]):
                out.append((m[0], m[1], "ssn"))
    out.sort(key=lambda x: (x[0], KINDS.index(x[2])))
    return out


SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def _found(batches):
    anchors = automaton()
    schema = pa.schema([("doc_id", pa.int64()), ("spans", SPANS)])
    for x in batches:
        for lo in range(0, len(x), 1024):
            spans = [[{"kind": k, "start": s, "end": e} for s, e, k in find(t.as_py() or "", anchors)] for t in x.column(1).slice(lo, 1024)]
            yield pa.record_batch([x.column(0).slice(lo, 1024), pa.array(spans, SPANS)], schema=schema)


def find_pii(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, spans (array of kind, start, end) of every row; null and empty texts have no spans. Other columns
    aren't read."""
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(lambda it: given_back(_found(it)), "doc_id long, spans array<struct<kind: string, start: int, end: int>>")


def _masked(batches):
    anchors = automaton()
    for x in batches:
        out = []
        for t in x.column(1):
            t = t.as_py()
            if t is not None:
                parts, at = [], 0
                for s, e, k in find(t, anchors):
                    if s >= at:
                        parts += [t[at:s], f"<{k}>"]
                        at = e
                    else:
                        at = max(at, e)
                t = "".join(parts) + t[at:]
            out.append(t)
        yield pa.record_batch([x.column(0), pa.array(out, pa.string())], names=["doc_id", "text"])


def mask_pii(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text with every span replaced by its kind in angle brackets; of overlapping spans the first names it."""
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(lambda it: given_back(_masked(it)), "doc_id long, text string")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(documents(spark, sf_dir))
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *map(count, KINDS), F.size("spans").cast("long").alias("n_all"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
