"""Identifiers and wire forms of events: canonical JSON, ids, hex, bech32, Schnorr signatures, varints, addresses.

Plain functions work on Python values; the *_column forms wrap them for columns in Arrow batches. Everything that Spark's own
functions express (hash, hex checks, address parts, time units) is a Column function instead.
"""

from __future__ import annotations

import hashlib
import ipaddress
import json
import re
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

HEX64 = r"^[0-9a-f]{64}$"
MAX_DEPTH = 128


class CodecError(ValueError):
    """Bad input; the message says which rule it breaks."""


# -- strict JSON ------------------------------------------------------------------------------------------------------


def parse_strict(text: str):
    """JSON without duplicate keys, NaN, trailing text or more than MAX_DEPTH levels; integers stay exact."""

    def pairs(items):
        out = dict(items)
        if len(out) != len(items):
            raise CodecError("duplicate key")
        return out

    def constant(name):
        raise CodecError(f"not JSON: {name}")

    depth = deepest = 0
    in_string = escaped = False
    for c in text:
        if in_string:
            escaped, in_string = (not escaped and c == "\\"), escaped or c != '"'
        elif c == '"':
            in_string = True
        elif c in "[{":
            depth += 1
            deepest = max(deepest, depth)
        elif c in "]}":
            depth -= 1
    if deepest > MAX_DEPTH:
        raise CodecError("nested too deeply")
    try:
        return json.loads(text, object_pairs_hook=pairs, parse_constant=constant)
    except (json.JSONDecodeError, RecursionError) as e:
        raise CodecError(f"not JSON: {e}") from None


_SHORT = {"\b": "\\b", "\f": "\\f", "\n": "\\n", "\r": "\\r", "\t": "\\t", '"': '\\"', "\\": "\\\\"}
_ESCAPE = re.compile('[\x00-\x1f\x7f"\\\\]')


def _number(x) -> str:
    if isinstance(x, int) and -(1 << 63) <= x < 1 << 64:
        return str(x)
    x = float(x)
    if x == 0:
        return "-0.0" if str(x)[0] == "-" else "0.0"
    sign, digits, exponent = Decimal(repr(x)).normalize().as_tuple()
    text, point = "".join(map(str, digits)), len(digits) + exponent
    minus = "-" if sign else ""
    if -6 < point < 22:
        if point <= 0:
            return f"{minus}0.{'0' * -point}{text}"
        return f"{minus}{text}{'0' * (point - len(text))}.0" if len(text) <= point else f"{minus}{text[:point]}.{text[point:]}"
    return f"{minus}{text[0]}{'.' + text[1:] if len(text) > 1 else ''}e{point - 1}"


def canonical_json(value) -> str:
    """Compact text: keys sorted, only quotes, backslash, controls and DEL escaped, shortest floats."""
    if value is None or isinstance(value, bool):
        return {None: "null", True: "true", False: "false"}[value]
    if isinstance(value, (int, float)):
        return _number(value)
    if isinstance(value, str):
        return '"' + _ESCAPE.sub(lambda m: _SHORT.get(m[0]) or f"\\u{ord(m[0]):04x}", value) + '"'
    if isinstance(value, dict):
        return "{" + ",".join(f"{canonical_json(k)}:{canonical_json(value[k])}" for k in sorted(value, key=lambda k: k.encode())) + "}"
    return "[" + ",".join(map(canonical_json, value)) + "]"


def event_id(event: dict) -> str:
    """SHA-256 of the canonical array 0, pubkey, created_at, kind, tags, content."""
    fields = ("pubkey", "created_at", "kind", "tags", "content")
    if missing := next((f for f in fields if f not in event), None):
        raise CodecError(f"missing {missing}")
    return hashlib.sha256(canonical_json([0, *(event[f] for f in fields)]).encode()).hexdigest()


def stored_json(event: dict) -> str:
    """The persisted form: the seven fields, sorted, compact."""
    return canonical_json({k: event[k] for k in ("id", "pubkey", "created_at", "kind", "tags", "content", "sig")})


# -- hex, varint, bech32 ----------------------------------------------------------------------------------------------


def from_hex(text: str, uneven: bool = True) -> bytes:
    """Bytes of hex with an optional 0x; an odd length gets a leading zero, or is refused."""
    text = text.removeprefix("0x")
    if len(text) % 2:
        if not uneven:
            raise CodecError("odd length")
        text = "0" + text
    if not re.fullmatch("[0-9a-fA-F]*", text):
        raise CodecError("not hex")
    return bytes.fromhex(text)


def from_lower_hex(text: str) -> bytes:
    if len(text) % 2 or not re.fullmatch("[0-9a-f]*", text):
        raise CodecError("not lower-case hex")
    return bytes.fromhex(text)


def encode_varint(n: int) -> bytes:
    """Big-endian groups of seven bits, the high bit set on all but the last."""
    groups = [n & 127]
    while n := n >> 7:
        groups.append(n & 127 | 128)
    return bytes(reversed(groups))


def decode_varint(data: bytes) -> tuple[int, bytes]:
    n = 0
    for i, b in enumerate(data):
        n = (n << 7 | b & 127) & (1 << 64) - 1
        if b < 128:
            return n, data[i + 1 :]
    raise CodecError("varint ends early")


#: Fixed values of bech32: its alphabet and the checksum's generator.
BECH32 = "qpzry9x8gf2tvdw0s3jn54khce6mua7l"
BECH32_GENERATOR = (0x3B6A57B2, 0x26508E6D, 0x1EA119FA, 0x3D4233DD, 0x2A1462B3)


def _polymod(values) -> int:
    check = 1
    for v in values:
        top = check >> 25
        check = (check & 0x1FFFFFF) << 5 ^ v
        for i, g in enumerate(BECH32_GENERATOR):
            if top >> i & 1:
                check ^= g
    return check


def _expand(prefix: str) -> list[int]:
    return [ord(c) >> 5 for c in prefix] + [0] + [ord(c) & 31 for c in prefix]


def bech32_encode(prefix: str, data: bytes) -> str:
    bits = int.from_bytes(data, "big") << (pad := -len(data) * 8 % 5)
    n = (len(data) * 8 + pad) // 5
    values = [bits >> 5 * (n - 1 - i) & 31 for i in range(n)]
    check = _polymod(_expand(prefix) + values + [0] * 6) ^ 1
    return prefix + "1" + "".join(BECH32[v] for v in values + [check >> 5 * (5 - i) & 31 for i in range(6)])


def bech32_decode(text: str, prefix: str, size: int) -> bytes:
    if text != text.lower() and text != text.upper():
        raise CodecError("mixed case")
    own, sep, body = text.lower().rpartition("1")
    if not sep or own != prefix or len(body) < 6 or any(c not in BECH32 for c in body):
        raise CodecError(f"not a {prefix} text")
    values = [BECH32.index(c) for c in body]
    if _polymod(_expand(own) + values) != 1:
        raise CodecError("bad checksum")
    bits, n = 0, 5 * (len(values) - 6)
    for v in values[:-6]:
        bits = bits << 5 | v
    if n // 8 != size or n % 8 > 4 or bits & ((1 << n % 8) - 1):
        raise CodecError("bad length")
    return (bits >> n % 8).to_bytes(size, "big")


def npub(pubkey: str) -> str:
    return bech32_encode("npub", from_lower_hex(pubkey))


def decode_npub(text: str) -> str:
    return bech32_decode(text, "npub", 32).hex()


# -- Schnorr (BIP-340) ------------------------------------------------------------------------------------------------

#: Fixed values of secp256k1: field prime, group order, generator.
P = 2**256 - 2**32 - 977
N = 0xFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFEBAAEDCE6AF48A03BBFD25E8CD0364141
G = (0x79BE667EF9DCBBAC55A06295CE870B07029BFCDB2DCE28D959F2815B16F81798, 0x483ADA7726A3C4655DA4FBFC0E1108A8FD17B448A68554199C47D08FFB10D4B8)


def _add(a, b):
    if a is None or b is None:
        return a or b
    if a[0] == b[0] and (a[1] + b[1]) % P == 0:
        return None
    slope = 3 * a[0] * a[0] * pow(2 * a[1], -1, P) if a == b else (b[1] - a[1]) * pow(b[0] - a[0], -1, P)
    x = (slope * slope - a[0] - b[0]) % P
    return x, (slope * (a[0] - x) - a[1]) % P


def _times(point, k: int):
    out = None
    while k:
        if k & 1:
            out = _add(out, point)
        point, k = _add(point, point), k >> 1
    return out


def _lift(x: int):
    if x >= P:
        return None
    square = (x**3 + 7) % P
    y = pow(square, (P + 1) // 4, P)
    return None if y * y % P != square else (x, y if y % 2 == 0 else P - y)


def _tagged(tag: str, data: bytes) -> int:
    head = hashlib.sha256(tag.encode()).digest()
    return int.from_bytes(hashlib.sha256(head + head + data).digest(), "big")


def verify_signature(pubkey: str, message: str, sig: str) -> bool:
    """BIP-340: does sig (128 hex digits) sign message (hex) for pubkey (64 hex digits)? Bad hex: no."""
    try:
        key, text, raw = from_lower_hex(pubkey), from_lower_hex(message), from_lower_hex(sig)
    except CodecError:
        return False
    if len(key) != 32 or len(raw) != 64:
        return False
    point, r, s = _lift(int.from_bytes(key, "big")), int.from_bytes(raw[:32], "big"), int.from_bytes(raw[32:], "big")
    if point is None or r >= P or s >= N:
        return False
    e = _tagged("BIP0340/challenge", raw[:32] + key + text) % N
    found = _add(_times(G, s), _times(point, N - e))
    return found is not None and found[1] % 2 == 0 and found[0] == r


def sign(secret: int, message: bytes, extra: bytes = bytes(32)) -> tuple[str, str]:
    """(pubkey, signature) by BIP-340; to make test events."""
    point = _times(G, secret)
    d = secret if point[1] % 2 == 0 else N - secret
    key = point[0].to_bytes(32, "big")
    t = (d ^ _tagged("BIP0340/aux", extra)).to_bytes(32, "big")
    k = _tagged("BIP0340/nonce", t + key + message) % N
    nonce = _times(G, k)
    k = k if nonce[1] % 2 == 0 else N - k
    r = nonce[0].to_bytes(32, "big")
    e = _tagged("BIP0340/challenge", r + key + message) % N
    return key.hex(), (r + ((k + e * d) % N).to_bytes(32, "big")).hex()


# -- addresses, times, hosts ------------------------------------------------------------------------------------------


def parse_address(text: str) -> tuple[int, str, str]:
    """(kind, pubkey, identifier) of ``kind:pubkey:identifier``; the identifier may contain colons."""
    m = re.fullmatch(r"(\d+):([0-9a-f]{64}):(.*)", text, re.DOTALL | re.ASCII)
    if not m or int(m[1]) > 65535:
        raise CodecError("not an address")
    return int(m[1]), m[2], m[3]


#: Seconds of each unit.
UNITS = {"s": 1.0, "m": 60.0, "h": 3600.0, "d": 86400.0, "w": 604800.0, "M": 86400 * 30.5, "Y": 86400 * 365.2425}


def parse_duration(text: str) -> int:
    """Whole seconds of a number with a unit."""
    if not text or text[-1] not in UNITS:
        raise CodecError("unknown time unit")
    try:
        return max(0, int(float(text[:-1]) * UNITS[text[-1]]))
    except (ValueError, OverflowError):
        raise CodecError("invalid time") from None


def parse_range(text: str, now: int) -> dict[str, int]:
    """since and until of ``<ago>-<ago>``; either side may be empty."""
    left, dash, right = text.partition("-")
    if not dash:
        raise CodecError("a range needs a dash")
    out = {k: max(0, now - parse_duration(v)) for k, v in (("since", left), ("until", right)) if v}
    if out.get("since", 0) > out.get("until", now):
        raise CodecError("since can't be after until")
    return out


def canonical_ip(text: str) -> str | None:
    """The address as text; IPv4 inside IPv6 is IPv4; null if it is none."""
    try:
        ip = ipaddress.ip_address(text.strip("[]"))
    except (ValueError, AttributeError):
        return None
    return str(getattr(ip, "ipv4_mapped", None) or ip)


# -- columns ----------------------------------------------------------------------------------------------------------


def _series(function):
    def each(s: pd.Series) -> pd.Series:
        def one(x):
            try:
                return None if x is None else function(x)
            except CodecError:
                return None

        return s.map(one)

    return each


def _text_column(function, column) -> Column:
    """A function of one text over a column; null where it refuses. Made on call: workers import this module without a session."""
    return F.pandas_udf(_series(function), "string")(column)


def canonical_json_column(text) -> Column:
    return _text_column(lambda t: canonical_json(parse_strict(t)), text)


def event_id_column(text) -> Column:
    return _text_column(lambda t: event_id(parse_strict(t)), text)


def stored_json_column(text) -> Column:
    return _text_column(lambda t: stored_json(parse_strict(t)), text)


def npub_column(pubkey) -> Column:
    return _text_column(npub, pubkey)


def decode_npub_column(text) -> Column:
    return _text_column(decode_npub, text)


def canonical_ip_column(text) -> Column:
    return _text_column(canonical_ip, text)


def verify_signature_column(pubkey, message, sig) -> Column:
    """Slow: a few hundred signatures a second for each core, in Python integers."""

    def signed(pubkey: pd.Series, message: pd.Series, sig: pd.Series) -> pd.Series:
        return pd.Series([None not in x and verify_signature(*x) for x in zip(pubkey, message, sig, strict=True)])

    return F.pandas_udf(signed, "boolean")(pubkey, message, sig)


def is_replaceable(kind: Column) -> Column:
    return kind.isin(0, 3, 41) | kind.between(10000, 19999)


def is_addressable(kind: Column) -> Column:
    return kind.between(30000, 39999)


def is_ephemeral(kind: Column) -> Column:
    return kind.between(20000, 29999)


def address_parts(text: Column) -> tuple[Column, Column, Column]:
    """kind, pubkey and identifier columns of an address; null where it is none."""
    pattern = r"(?s)^(\d{1,18}):([0-9a-f]{64}):(.*)$"
    kind = F.expr("null").cast("bigint")
    good = text.rlike(pattern) & (F.coalesce(F.regexp_extract(text, pattern, 1).try_cast("bigint"), F.lit(1 << 20)) <= 65535)
    return tuple(F.when(good, x) for x in (F.coalesce(F.regexp_extract(text, pattern, 1).try_cast("bigint"), kind), F.regexp_extract(text, pattern, 2), F.regexp_extract(text, pattern, 3)))


def leading_zero_bits(hex_id: Column) -> Column:
    """Zero bits before the first one bit of a lower-case hex identifier."""
    zeros = F.length(F.regexp_extract(hex_id, "^0*", 0))
    nibble = F.substring(hex_id, 1, 64).substr(zeros + 1, F.lit(1))
    return zeros * 4 + F.when(nibble == "1", 3).when(nibble.isin("2", "3"), 2).when(nibble.isin("4", "5", "6", "7"), 1).otherwise(0)


def relay_url(url: Column) -> Column:
    """A relay's URL in one form: trimmed, without ws:// or wss:// (in lower case), without trailing slashes, A-Z in lower case."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(url, r"^\s+|\s+$", ""), "^wss?://", ""), "/+$", "")
    return F.translate(bare, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def relay_name(url: str) -> str:
    """The same of one text."""
    bare = url.strip()
    bare = next((bare.removeprefix(p) for p in ("wss://", "ws://") if bare.startswith(p)), bare)
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in bare.rstrip("/"))


def cut_text(text: Column, most_bytes: int = 512, shown: int = 200) -> Column:
    """The first ``shown`` characters of a text of at most ``most_bytes``; longer texts are cut at a character first."""
    return F.when(F.octet_length(text) <= most_bytes, F.substring(text, 1, shown)).otherwise(F.substring(F.substring(text, 1, most_bytes), 1, min(shown, most_bytes // 4)))
