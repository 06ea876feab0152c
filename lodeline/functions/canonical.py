"""Canonical JSON, hash tokens and identities.

Closed records are serialised by Column expressions (``obj``/``arr``), which
stay in generated code. Open JSON (row images) is brought into canonical form by
one Arrow UDF, since NFC and recursive key order have no built-in.
"""

from __future__ import annotations

import decimal
import json
import unicodedata

import pandas as pd
from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The namespace of envelope ids, that of anchor ids, and the token before the first row.
ENVELOPE_NAMESPACE = "03d76635-7b81-5e2a-94a4-fd03abda111f"
ANCHOR_NAMESPACE = "2f9d6a1e-7c43-5b08-9e21-3a4b5c6d7e8f"
GENESIS = "sha256:" + "0" * 64

HASH_TOKEN = r"^sha256:[0-9a-f]{64}$"
SAFE_INTEGER = (1 << 53) - 1
EXACT_DECIMAL = r"^-?(0|[1-9]\d*)(\.\d+)?$"

_SHORT = {"\\": "\\\\", '"': '\\"', "\b": "\\b", "\f": "\\f", "\n": "\\n", "\r": "\\r", "\t": "\\t"}


_escapes: dict[int, Column] = {}


def _escape_pairs() -> Column:
    """The constant list of what is escaped to what, built once for each context."""
    context = id(SparkContext._active_spark_context)
    if context not in _escapes:
        controls = {chr(code): f"\\u{code:04x}" for code in range(32) if chr(code) not in _SHORT}
        _escapes[context] = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in {**_SHORT, **controls}.items()])
    return _escapes[context]


def json_string(value: Column) -> Column:
    """A JSON string token: short escapes, lower-case \\u00xx for other controls, the rest as it is. The value must be NFC."""
    # one fold over a constant list keeps the generated code small; it only runs for text that needs it
    escaped = F.aggregate(_escape_pairs(), value, lambda text, p: F.replace(text, p["a"], p["b"]))
    plain = F.when(value.rlike(r'[\x00-\x1f"\\]'), escaped).otherwise(value)
    return F.concat(F.lit('"'), plain, F.lit('"'))


def json_text(value: Column) -> Column:
    """``json_string`` of long text full of quotes, as is JSON in JSON: two passes over it, not one for each character that may need an escape."""
    text = F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.when(value.rlike(r"[\x00-\x1f]"), json_string(value)).otherwise(F.concat(F.lit('"'), text, F.lit('"')))


def token(value: Column, kind: str = "string") -> Column:
    """A JSON token of a column; null becomes ``null``. kind: string, number, boolean or json (already a token)."""
    text = json_string(value) if kind == "string" else value.cast("string")
    return F.coalesce(text, F.lit("null"))


def obj(members: dict[str, Column], optional: frozenset[str] | set[str] = frozenset()) -> Column:
    """A canonical object of tokens. Members named in ``optional`` are left out where their token is a null column."""
    if not members:
        return F.lit("{}")
    parts = []
    for name in sorted(members):
        value = members[name] if name in optional else F.coalesce(members[name], F.lit("null"))
        parts.append(F.concat(F.lit(json.dumps(name, ensure_ascii=False) + ":"), value))
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def arr(tokens: Column) -> Column:
    """A canonical array of an array column of tokens."""
    return F.concat(F.lit("["), F.array_join(tokens, ","), F.lit("]"))


class NotCanonical(ValueError):
    pass


def _refuse(text: str):
    raise NotCanonical(f"not representable: {text}")


def _members(pairs: list[tuple[str, object]]) -> dict:
    # a repeated name replaces the earlier one, as in parsing; names that only normalisation makes equal are an error
    raw = dict(pairs)
    out = {unicodedata.normalize("NFC", k): v for k, v in raw.items()}
    if len(out) != len(raw):
        raise NotCanonical("names are equal after normalisation")
    return out


def _integer(text: str) -> int:
    value = int(text)
    if abs(value) > SAFE_INTEGER:
        raise NotCanonical("unsafe integer")
    return value


def _whole(text: str) -> int:
    value = float(text)
    if abs(value) > SAFE_INTEGER or value != int(value):
        raise NotCanonical("not an integer")
    return int(value)


def _normal(value):
    if isinstance(value, str):
        return unicodedata.normalize("NFC", value)
    if isinstance(value, list):
        return [_normal(x) for x in value]
    if isinstance(value, dict):
        return {k: _normal(v) for k, v in value.items()}
    return value


def _write(value) -> str:
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def canonical_text(text: str) -> str:
    """Canonical form of JSON text; ``NotCanonical`` for floats, unsafe integers, clashing names and invalid text."""
    try:
        return _write(_normal(json.loads(text, parse_int=_integer, parse_float=_whole, parse_constant=_refuse, object_pairs_hook=_members)))
    except (ValueError, RecursionError) as error:
        raise NotCanonical(str(error)) from None


_CANONICAL = T.StructType([T.StructField("text", T.StringType()), T.StructField("members", T.MapType(T.StringType(), T.StringType())), T.StructField("error", T.StringType())])


@F.pandas_udf(_CANONICAL)
def canonical(texts: pd.Series) -> pd.DataFrame:
    """struct(text, members, error) of JSON text.

    text is the canonical form, members the tokens of a top-level object's
    members, error why there is no canonical form. All are null for null text.
    """
    out = []
    for t in texts:
        if t is None:
            out.append((None, None, None))
            continue
        try:
            value = _normal(json.loads(t, parse_int=_integer, parse_float=_whole, parse_constant=_refuse, object_pairs_hook=_members))
            out.append((_write(value), {k: _write(v) for k, v in value.items()} if isinstance(value, dict) else None, None))
        except (ValueError, RecursionError) as error:
            out.append((None, None, str(error)[:200]))
    return pd.DataFrame(out, columns=["text", "members", "error"])


class Literal(str):
    """A JSON number that has no canonical form, written out exactly."""


def _literal(text: str) -> Literal:
    try:
        value = decimal.Decimal(text).normalize(decimal.Context(prec=len(text)))
        return Literal(format(value, "f") if -40 < value.adjusted() < 40 else str(value))
    except ArithmeticError:
        return Literal(text)


def _any_number(text: str) -> int | Literal:
    literal = _literal(text)
    return int(literal) if len(literal) < 18 and literal.lstrip("-").isdigit() and abs(int(literal)) <= SAFE_INTEGER else literal


def _any_members(pairs: list[tuple[str, object]]) -> dict:
    raw = dict(pairs)
    out = {unicodedata.normalize("NFC", k): v for k, v in raw.items()}
    return out if len(out) == len(raw) else raw


def _write_any(value) -> str:
    if isinstance(value, Literal):
        return str(value)
    if isinstance(value, list):
        return "[" + ",".join(map(_write_any, value)) + "]"
    if isinstance(value, dict):
        return "{" + ",".join(f"{_write(k)}:{_write_any(value[k])}" for k in sorted(value)) + "}"
    return _write(_normal(value))


def open_members(text: str) -> dict[str, str] | None:
    """Tokens of an object's members, also where it has no canonical form: equal numbers have equal tokens, names that normalisation would make equal stay apart.

    null has none; ``NotCanonical`` for text that isn't JSON or no object.
    """
    try:
        # most images have a canonical form, whose tokens are the same and cost less
        value = _normal(json.loads(text, parse_int=_integer, parse_float=_whole, parse_constant=_refuse, object_pairs_hook=_members))
        if isinstance(value, dict):
            return {k: _write(v) for k, v in value.items()}
    except (ValueError, RecursionError):
        pass
    try:
        value = json.loads(text, parse_int=_any_number, parse_float=_any_number, parse_constant=_refuse, object_pairs_hook=_any_members)
        if value is not None and not isinstance(value, dict):
            raise NotCanonical("not an object")
        return value and {k: _write_any(v) for k, v in value.items()}
    except (ValueError, RecursionError) as error:
        raise NotCanonical(str(error)) from None


@F.pandas_udf(T.StructType([T.StructField("members", T.MapType(T.StringType(), T.StringType())), T.StructField("error", T.StringType())]))
def opened(texts: pd.Series) -> pd.DataFrame:
    """struct(members, error) of JSON text by ``open_members``; both are null for null text."""
    out = []
    for t in texts:
        try:
            out.append((None if t is None else open_members(t), None))
        except NotCanonical as error:
            out.append((None, str(error)[:200]))
    return pd.DataFrame(out, columns=["members", "error"])


@F.pandas_udf(T.StringType())
def nfc(texts: pd.Series) -> pd.Series:
    """Text in normal form C; null stays null."""
    return texts.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFC", t), na_action="ignore")


def _stable(value):
    if isinstance(value, dict):
        # keys in order of UTF-16 code units
        return {k: _stable(value[k]) for k in sorted(value, key=lambda k: k.encode("utf-16-be", "surrogatepass"))}
    return [_stable(x) for x in value] if isinstance(value, list) else value


def _number(text: str):
    value = float(text)
    return int(value) if value == int(value) and abs(value) < 1e21 else value


def stable_text(text: str) -> str:
    """Key-sorted JSON text, for hashing payloads: strings and text that isn't JSON as they are, floats allowed."""
    try:
        value = json.loads(text, parse_float=_number)
    except (ValueError, RecursionError):
        return text
    return value if isinstance(value, str) else json.dumps(_stable(value), ensure_ascii=False, separators=(",", ":"))


@F.pandas_udf(T.StringType())
def stable(texts: pd.Series) -> pd.Series:
    """``stable_text`` of a column; null is the text ``null``."""
    return texts.map(lambda t: "null" if t is None else stable_text(t))


def image_object(members: Column) -> Column:
    """Canonical object of a map of name -> token; null for null."""
    entries = F.array_sort(F.map_entries(members))
    return F.concat(F.lit("{"), F.array_join(F.transform(entries, lambda e: F.concat(json_string(e["key"]), F.lit(":"), e["value"])), ","), F.lit("}"))


def sha(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


def is_hash_token(value: Column) -> Column:
    return F.coalesce(value.rlike(HASH_TOKEN), F.lit(False))


def row_hash(previous: Column, event_hash: Column) -> Column:
    """Hash of two token strings; a null previous token is the genesis token."""
    return sha(F.concat(F.coalesce(previous, F.lit(GENESIS)), event_hash))


def uuid5(name: Column, namespace: str = ENVELOPE_NAMESPACE) -> Column:
    """Name-based UUID, version 5."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(digest, 17, 1), 16, 10).cast("int").bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8))))
    return F.concat(
        F.substring(digest, 1, 8), F.lit("-"), F.substring(digest, 9, 4), F.lit("-5"), F.substring(digest, 14, 3), F.lit("-"),
        variant, F.substring(digest, 18, 3), F.lit("-"), F.substring(digest, 21, 12),
    )


def envelope_id(db_id: Column, tx_id: Column, server_uuid: Column, part: Column | None = None) -> Column:
    parts = [db_id, tx_id, server_uuid, *([part] if part is not None else [])]
    return uuid5(F.concat(*[x for p in parts for x in (p, F.lit("|"))][:-1]))


def anchor_id(payload_hash: Column, provider_type: Column) -> Column:
    return uuid5(F.concat(payload_hash, F.lit("|"), provider_type), ANCHOR_NAMESPACE)


def snapshot_epoch_id(db_id: Column, server_uuid: Column, file: Column, pos: Column, start_ts: Column) -> Column:
    text = obj({
        "db_id": token(db_id), "server_uuid": token(server_uuid), "snapshot_start_binlog_file": token(file),
        "snapshot_start_binlog_pos": token(pos, "number"), "snapshot_start_ts": token(start_ts),
    })
    return F.concat(F.lit("snap-"), F.substring(F.sha2(text, 256), 1, 16))


def row_key_hash(schema: Column, name: Column, primary_key: Column) -> Column:
    """primary_key: canonical token of the key object; null is the empty object."""
    return F.sha2(obj({"schema": token(schema), "name": token(name), "primary_key": F.coalesce(primary_key, F.lit("{}"))}), 256)


def snapshot_tx_id(epoch: Column, schema: Column, name: Column, primary_key: Column) -> Column:
    return F.concat(F.lit("snapshot:"), epoch, F.lit(":"), row_key_hash(schema, name, primary_key))


def snapshot_offset_key(epoch: Column) -> Column:
    return F.concat(F.lit("snapshot-epoch:"), epoch)


def decimal_compare(a: Column, b: Column) -> Column:
    """-1, 0 or 1 for exact decimals of any length; null if one isn't exact (``-0`` isn't).

    Compared as text: without leading zeros the longer whole part is the greater,
    of equal length the later; fractions without trailing zeros are in text order.
    """
    exact = lambda x: F.when(x.rlike(EXACT_DECIMAL) & ~x.rlike(r"^-0(\.0*)?$"), x)
    sign = lambda x: F.when(x.startswith("-"), -1).otherwise(1)
    whole = lambda x: F.regexp_extract(x, r"^-?(\d+)", 1)
    part = lambda x: F.regexp_extract(x, r"\.(\d*?)0*$", 1)
    key = lambda x: F.struct(F.length(whole(x)).alias("n"), whole(x).alias("w"), part(x).alias("p"))
    x, y = exact(a), exact(b)
    size = F.when(key(x) > key(y), 1).when(key(x) < key(y), -1).otherwise(0)
    return F.when(x.isNotNull() & y.isNotNull(), F.when(sign(x) != sign(y), sign(x)).otherwise(size * sign(x)))


def backoff_ms(attempt: Column, base: int = 1000, most: int = 30_000, factor: float = 2.0) -> Column:
    return F.least(F.lit(float(most)), F.round(F.lit(float(base)) * F.pow(F.lit(factor), attempt))).cast("bigint")


def iso_ms(ts: Column) -> Column:
    """RFC 3339 in UTC with milliseconds; the session's time zone must be UTC."""
    return F.date_format(ts.cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def iso_of_millis(ms: Column) -> Column:
    return iso_ms(F.timestamp_millis(ms))


def object_key(db_id: Column, segment_id: Column, seq: Column, kind: str) -> Column:
    return F.concat(db_id, F.lit("/"), segment_id, F.lit("/"), F.lpad(seq.cast("string"), 6, "0"), F.lit(f".{kind}.json"))


def key_id(public_key_base64: Column, prefix: str = "key-") -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.unbase64(public_key_base64), 256), 1, 16))
