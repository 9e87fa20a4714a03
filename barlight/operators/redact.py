"""Redaction of credentials in free text, flat JSON maps, nested JSON and paths."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

MASK = "[redacted]"

# Names of credentials in text (parts that may be joined, or parted by one of _ and -), exact keys, keys of accounts, and marks within keys.
NAMES = [
    "api key", "api secret", "access token", "auth token", "refresh token", "bearer token", "id token", "session token", "client secret", "secret key", "private key", "app secret",
    "passphrase", "password", "passwd", "authorization", "secret", "token",
]
EXACT = ["api_key", "authorization", "content", "env", "headers", "passphrase", "password", "secret", "token"]
ACCOUNTS = ["account_number", "account_id", "account_no", "account_num", "ssn", "social_security_number", "tax_id", "taxpayer_id", "tin", "routing_number", "bank_account_number"]
MARKS = ["api_key", "authorization", "password", "secret", "token"]
# What well-known tokens begin with, the signs beside letters and digits that follow, how many follow at least and at most, and whether letters are capitals.
SHAPES = [
    (("sk-",), "_-", 20, None, False), (("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), "", 30, None, False), (("xoxb-", "xoxa-", "xoxp-", "xoxr-", "xoxs-"), "-", 10, None, False),
    (("AKIA",), "", 16, 16, True), (("pypi-",), "_-", 16, None, False),
]
SIGNED = ("eyJ", 10, 10, 5)  # three parts with dots between: what the first begins with, and the least that follows there and in the others

CAPITALS, SMALL, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
PLAIN = frozenset(CAPITALS + SMALL + DIGITS)
PIECE = PLAIN | {"_", "-"}
BEARER_SIGNS = PLAIN | set("._~+/-")
ENDS_VALUE = frozenset(",;{}[]()\"'")
SPELLINGS = frozenset(sep.join(name.split()) for name in NAMES for sep in ("", "_", "-"))


def _word(c: str) -> bool:
    return c.isalnum() or c == "_"


def _past(text: str, at: int, fits) -> int:
    """The first place from `at` on whose sign does not fit."""
    while at < len(text) and fits(text[at]):
        at += 1
    return at


def _bearers(text: str) -> str:
    """What follows the word bearer and white space."""
    low, out, at, i = text.lower(), [], 0, 0
    if len(low) != len(text):  # a letter that grows in lower case would shift the places
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    while (i := low.find("bearer", i)) >= 0:
        end = i + len("bearer")
        value = _past(text, end, str.isspace)
        stop = _past(text, value, BEARER_SIGNS.__contains__)
        if value > end and stop > value and (i == 0 or not _word(text[i - 1])):
            out += [text[at:value], MASK] if text[end:value] == " " else [text[at:end], " ", MASK]
            at = end = _past(text, stop, "=".__eq__)
        i = end
    return "".join([*out, text[at:]])


def _named(text: str, stop: int, least: int) -> bool:
    """Whether a credential's name ends before `stop`, plain or in a pair of quotes, and begins at `least` or later."""
    quote = text[stop - 1] if stop > least and text[stop - 1] in "\"'" else ""
    end = stop - len(quote)
    begin = end
    while begin > least and text[begin - 1] in PIECE:
        begin -= 1
    run = text[begin:end].lower()
    for i in range(len(run)):
        clear = run[i - 1] == "-" if i else begin == 0 or not _word(text[begin - 1])
        if clear and run[i:] in SPELLINGS:
            before = begin + i - 1
            if not quote or before >= least and text[before] == quote:
                return True
    return False


def _pairs(text: str) -> str:
    """Values that stand after a credential's name and one of : and =; quotes around them stay, what is masked already and the word bearer too."""
    out, at, used = [], 0, 0
    for p, sign in enumerate(text):
        if sign not in ":=" or p < used:
            continue
        name = p
        while name > used and text[name - 1].isspace():
            name -= 1
        if not _named(text, name, used):
            continue
        value = _past(text, p + 1, str.isspace)
        head = text[value : value + len(MASK) + 1]
        after = text[value + len("bearer") : value + len("bearer") + 1]
        if head.startswith(MASK) or head[:1] in ("'", '"') and head[1:] == MASK or head[: len("bearer")].lower() == "bearer" and not (after and _word(after)):
            continue
        quote = text[value : value + 1] if text[value : value + 1] in ("'", '"') else ""
        if quote:
            line = text.find("\n", value + 1)
            stop = text.find(quote, value + 1, len(text) if line < 0 else line)
            if stop < 0:
                continue
        else:
            stop = _past(text, value, lambda c: not c.isspace() and c not in ENDS_VALUE)
            if stop == value:
                continue
        out += [text[at : value + len(quote)], MASK]
        at, used = stop, stop + len(quote)
    return "".join([*out, text[at:]])


def _known(piece: str) -> bool:
    for heads, signs, least, most, capitals in SHAPES:
        for head in heads:
            rest = piece[len(head) :]
            if piece.startswith(head) and least <= len(rest) <= (most or len(rest)) and all((c in PLAIN and not (capitals and c in SMALL)) or c in signs for c in rest):
                return True
    return False


def _shapes(text: str) -> str:
    """Pieces of letters, digits, _ and - that look like well-known tokens as a whole, and three of them with dots between."""
    pieces, i = [], 0
    while i < len(text):
        if text[i] in PIECE:
            pieces.append((i, i := _past(text, i, PIECE.__contains__)))
        else:
            i += 1
    head, *least = SIGNED
    out, at, k = [], 0, 0
    while k < len(pieces):
        (a, b), three = pieces[k], pieces[k : k + 3]
        signed = len(three) == 3 and text.startswith(head, a) and all(text[x[1] : y[0]] == "." for x, y in zip(three, three[1:])) and all(
            y - x - (len(head) if j == 0 else 0) >= n for j, ((x, y), n) in enumerate(zip(three, least)))
        if signed or _known(text[a:b]):
            stop = three[2][1] if signed else b
            out += [text[at:a], MASK]
            at, k = stop, k + (3 if signed else 1)
        else:
            k += 1
    return "".join([*out, text[at:]])


BEGINNINGS = tuple(h for heads, *_ in SHAPES for h in heads) + (SIGNED[0],)
TRACES = tuple(sorted({name.split()[-1] for name in NAMES}))


def redacted(text: str | None) -> str:
    """Bearer tokens, then named values (quotes kept), then known shapes. Redacted text stays as it is."""
    text = text or ""
    low = text.lower()
    if "bearer" in low:
        text = _bearers(text)
    if any(t in low for t in TRACES):
        text = _pairs(text)
    return _shapes(text) if any(h in text for h in BEGINNINGS) else text


def redact_text(text: Column) -> Column:
    """redacted() of a column: it walks from sign to sign, which no built-in function does, in Arrow batches."""

    @F.pandas_udf("string")
    def run(batch: pd.Series) -> pd.Series:
        return batch.map(redacted)

    return run(text)


def fold(name: str) -> str:
    """Letters and digits alone."""
    return "".join(filter(str.isalnum, name))


def sensitive(key: Column, result: bool = False) -> Column:
    """Whether a key's value is to be masked; in results the wrapper key `content` is not."""
    plain = F.lower(F.trim(key))
    folded = F.regexp_replace(F.lower(key), "[^\\p{L}\\p{N}]", "")
    has = lambda c, marks: F.exists(F.array(*map(F.lit, marks)), lambda m: F.contains(c, m))
    hit = plain.isin(*EXACT, *ACCOUNTS) | has(plain, MARKS) | folded.isin(*map(fold, EXACT + ACCOUNTS)) | has(folded, [fold(m) for m in MARKS])
    return hit & (folded != "content") if result else hit


def hides(key: str, result: bool) -> bool:
    """sensitive() of one key."""
    forms = [(key.strip().lower(), {*EXACT, *ACCOUNTS}, MARKS), (fold(key.lower()), {fold(k) for k in (*EXACT, *ACCOUNTS)}, [fold(m) for m in MARKS])]
    return not (result and forms[1][0] == "content") and any(form in exact or any(m in form for m in marks) for form, exact, marks in forms)


def redact_map(flat: Column, result: bool = False) -> Column:
    """A map of strings: values of sensitive keys masked, the others' text redacted (all values of a map at once)."""

    @F.pandas_udf("array<string>")
    def run(keys: pd.Series, values: pd.Series) -> pd.Series:
        shown = [None if v is None else [MASK if hides(name, result) else redacted(x) for name, x in zip(k, v)] for k, v in zip(keys, values)]
        return pd.Series(shown, index=keys.index)

    return F.map_from_arrays(F.map_keys(flat), run(F.map_keys(flat), F.map_values(flat)))


def redact_paths(text: Column, roots: list[str], mask: str = "<path>") -> Column:
    """Each root, the longest first, where a separator, space, quote or the end follows."""
    import re

    for root in sorted(roots, key=len, reverse=True):
        text = F.regexp_replace(text, re.escape(root.rstrip("/")) + "(?=[/\\\\\\s\"':,;)\\]}]|$)", mask)
    return text


def redact_json(value: Column, result: bool = True) -> Column:
    """JSON of any depth: sensitive keys masked, other strings redacted; text that is no JSON is redacted as text.

    Depth is unknown to the plan, so the walk is an Arrow-batched function; everything else here is built in.
    """
    import json

    def shown(value: object) -> object:
        """A value of an object, or what is outside of all objects; objects within it are done already."""
        if isinstance(value, list):
            return [shown(v) for v in value]
        return redacted(value) if isinstance(value, str) else value

    def as_read(pairs: list[tuple[str, object]]) -> dict:
        """Objects are redacted while they are parsed, the innermost first."""
        return {k: MASK if hides(k, result) else shown(v) for k, v in pairs}

    def one(s: str | None) -> str:
        try:
            return json.dumps(shown(json.loads(s, object_pairs_hook=as_read)), ensure_ascii=False) if s else ""
        except (ValueError, RecursionError):
            return shown(s)

    @F.pandas_udf("string")
    def run(batch: pd.Series) -> pd.Series:
        return batch.map(one)

    return run(value)
