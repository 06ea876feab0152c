"""Ed25519 signatures (RFC 8032) for Arrow UDFs; no compiled library is needed."""

from __future__ import annotations

import base64
import hashlib

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values of the curve
P = 2**255 - 19
L = 2**252 + 27742317777372353535851937790883648493
D = -121665 * pow(121666, -1, P) % P
ROOT = pow(2, (P - 1) // 4, P)

Point = tuple[int, int, int, int]


def _recover(y: int, odd: int) -> int | None:
    if y >= P:
        return None
    x2 = (y * y - 1) * pow(D * y * y + 1, -1, P) % P
    if x2 == 0:
        return None if odd else 0
    x = pow(x2, (P + 3) // 8, P)
    if (x * x - x2) % P:
        x = x * ROOT % P
    if (x * x - x2) % P:
        return None
    return P - x if x & 1 != odd else x


_Y = 4 * pow(5, -1, P) % P
_X = _recover(_Y, 0)
BASE: Point = (_X, _Y, 1, _X * _Y % P)


def _add(a: Point, b: Point) -> Point:
    s, t = (a[1] - a[0]) * (b[1] - b[0]) % P, (a[1] + a[0]) * (b[1] + b[0]) % P
    c, d = 2 * a[3] * b[3] * D % P, 2 * a[2] * b[2] % P
    e, f, g, h = t - s, d - c, d + c, t + s
    return e * f % P, g * h % P, f * g % P, e * h % P


def _windowed(n: int, a: Point) -> Point:
    """n times a, four bits at a time."""
    table = [(0, 1, 1, 0), a]
    while len(table) < 16:
        table.append(_add(table[-1], a))
    out = table[0]
    for digit in f"{n:x}":
        out = _add(out, out)
        out = _add(out, out)
        out = _add(out, out)
        out = _add(out, out)
        if digit != "0":
            out = _add(out, table[int(digit, 16)])
    return out


_comb: list[list[Point]] = []


def _base_times(n: int) -> Point:
    """n times the base point, from its multiples of each hexadecimal place, which are computed once."""
    if not _comb:
        place = BASE
        for _ in range(64):
            row = [(0, 1, 1, 0)]
            while len(row) < 16:
                row.append(_add(row[-1], place))
            _comb.append(row)
            place = _add(row[-1], place)
    out: Point = (0, 1, 1, 0)
    for row in _comb:
        if n & 15:
            out = _add(out, row[n & 15])
        n >>= 4
    return out


def _pack(a: Point) -> bytes:
    z = pow(a[2], -1, P)
    x, y = a[0] * z % P, a[1] * z % P
    return (y | (x & 1) << 255).to_bytes(32, "little")


def _unpack(raw: bytes) -> Point | None:
    y = int.from_bytes(raw, "little")
    x = _recover(y & ((1 << 255) - 1), y >> 255)
    y &= (1 << 255) - 1
    return None if x is None else (x, y, 1, x * y % P)


def _number(*parts: bytes) -> int:
    return int.from_bytes(hashlib.sha512(b"".join(parts)).digest(), "little")


def _secret(seed: bytes) -> tuple[int, bytes]:
    h = hashlib.sha512(seed).digest()
    return (int.from_bytes(h[:32], "little") & ((1 << 254) - 8)) | (1 << 254), h[32:]


def public_key(seed: bytes) -> bytes:
    return _pack(_base_times(_secret(seed)[0]))


def sign(seed: bytes, message: bytes) -> bytes:
    a, prefix = _secret(seed)
    key = _pack(_base_times(a))
    r = _number(prefix, message) % L
    top = _pack(_base_times(r))
    return top + ((r + _number(top, key, message) % L * a) % L).to_bytes(32, "little")


def verify(key: bytes, message: bytes, signature: bytes) -> bool:
    """Whether the signature is the key's over the message; False for anything of the wrong form."""
    if len(key) != 32 or len(signature) != 64:
        return False
    a, r, s = _unpack(key), _unpack(signature[:32]), int.from_bytes(signature[32:], "little")
    if a is None or r is None or s >= L:
        return False
    left, right = _base_times(s), _add(r, _windowed(_number(signature[:32], key, message) % L, a))
    return (left[0] * right[2] - right[0] * left[2]) % P == 0 and (left[1] * right[2] - right[1] * left[2]) % P == 0


def raw_key(text: str) -> bytes:
    """The 32 bytes of a public key given as PEM or base64, bare or in a SubjectPublicKeyInfo."""
    body = "".join(line for line in text.strip().splitlines() if not line.startswith("-----"))
    return base64.b64decode(body, validate=True)[-32:]


@F.pandas_udf(T.BooleanType())
def verified(keys: pd.Series, messages: pd.Series, signatures: pd.Series) -> pd.Series:
    """Whether base64 signatures of text verify under base64 or PEM keys; False for nulls and text that can't be read."""

    def one(key, message, signature) -> bool:
        try:
            return verify(raw_key(key), message.encode(), base64.b64decode(signature, validate=True))
        except (ValueError, AttributeError, TypeError):
            return False

    return pd.Series([one(*x) for x in zip(keys, messages, signatures, strict=True)], dtype=bool)
