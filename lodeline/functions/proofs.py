"""Tokens of external anchors: signed time stamps and inclusion in a signed log, verified offline.

Both kinds are JSON in base64. What is signed is a tag, a colon and the canonical
text of the statement; tags are parameters with neutral defaults, as a verifier
of other tokens passes theirs. The issuing side is for fixtures and drills.
"""

from __future__ import annotations

import base64
import datetime
import hashlib
import json
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeline.functions import ed25519
from lodeline.functions.canonical import HASH_TOKEN, canonical_text

# The members of tokens and the reason codes below, as issued tokens and reports hold them.
STAMP_TAG, HEAD_TAG = "time-stamp-v1", "signed-tree-head-v1"

_HASH = re.compile(HASH_TOKEN)
_HEX = re.compile(r"^[0-9a-f]{64}$")
_INSTANT = re.compile(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{1,9})?(Z|[+-]\d{2}:\d{2})$")


class Refused(ValueError):
    """Carries the reason code."""


def _instant(value) -> bool:
    if not isinstance(value, str) or not _INSTANT.match(value):
        return False
    try:
        datetime.datetime.fromisoformat(value[:19])
    except ValueError:
        return False
    return True


def _named(value) -> bool:
    return isinstance(value, str) and bool(value)


def _whole(value) -> bool:
    return isinstance(value, int) and not isinstance(value, bool)


def statement(tag: str, body: dict) -> bytes:
    return f"{tag}:{canonical_text(json.dumps(body))}".encode()


def _opened(text: str) -> dict:
    try:
        doc = json.loads(base64.b64decode(text, validate=True))
    except (ValueError, TypeError):
        raise Refused("malformed_token") from None
    if not isinstance(doc, dict):
        raise Refused("malformed_token")
    return doc


def _holds(key: str, message: bytes, signature: str) -> bool:
    try:
        return ed25519.verify(ed25519.raw_key(key), message, base64.b64decode(signature, validate=True))
    except (ValueError, AttributeError, TypeError):
        return False


def check_stamp(token: str, payload_hash: str, ref: str, key: str, tag: str = STAMP_TAG) -> None:
    """Raises ``Refused`` unless the time stamp is of this hash, by this certificate, and its signature holds."""
    doc = _opened(token)
    if doc.get("signature_algorithm") != "ed25519":
        raise Refused("algorithm_mismatch")
    if not _named(doc.get("signature")):
        raise Refused("malformed_token")
    info = doc.get("tst_info")
    imprint = info.get("message_imprint") if isinstance(info, dict) else None
    formed = (
        isinstance(imprint, dict) and info.get("version") == 1 and _named(info.get("policy")) and _named(info.get("serial_number")) and _named(info.get("tsa_cert_ref"))
        and _instant(info.get("gen_time")) and imprint.get("hash_algorithm") == "sha-256" and isinstance(imprint.get("hashed_message"), str) and _HASH.match(imprint["hashed_message"])
    )
    if not formed:
        raise Refused("malformed_tstinfo")
    if imprint["hashed_message"] != payload_hash:
        raise Refused("imprint_mismatch")
    if info["tsa_cert_ref"] != ref:
        raise Refused("cert_mismatch")
    if not _holds(key, statement(tag, info), doc["signature"]):
        raise Refused("signature_invalid")


def _node(left: bytes, right: bytes) -> bytes:
    return hashlib.sha256(b"\x01" + left + right).digest()


def leaf_of(payload_hash: str) -> bytes:
    return hashlib.sha256(b"\x00" + bytes.fromhex(payload_hash[7:])).digest()


def root_of(index: int, size: int, leaf: bytes, path: list[bytes]) -> bytes | None:
    """The root an audit path leads to, from the leaf's place: its node is right of a sibling, left of one, or has none on this level."""
    if not 0 <= index < size:
        return None
    last = size - 1
    for sibling in path:
        # a node at the right edge without sibling rises unchanged
        while index == last and index % 2 == 0 and last:
            index, last = index // 2, last // 2
        if not last:
            return None
        leaf = _node(sibling, leaf) if index % 2 else _node(leaf, sibling)
        index, last = index // 2, last // 2
    while index == last and index % 2 == 0 and last:
        index, last = index // 2, last // 2
    return None if last else leaf


def check_inclusion(proof: str, payload_hash: str, ref: str, key: str, tag: str = HEAD_TAG) -> None:
    """Raises ``Refused`` unless the log's signed head holds and includes this hash. proof: JSON text of log_id, leaf_index, inclusion_proof, signed_tree_head."""
    try:
        doc = json.loads(proof)
    except (ValueError, TypeError):
        raise Refused("malformed_proof") from None
    path = doc.get("inclusion_proof") if isinstance(doc, dict) else None
    if not isinstance(path, list) or not isinstance(doc.get("log_id"), str) or not _whole(doc.get("leaf_index")) or not isinstance(doc.get("signed_tree_head"), str):
        raise Refused("malformed_proof")
    if doc["log_id"] != ref:
        raise Refused("log_mismatch")
    signed = _opened(doc["signed_tree_head"])
    head = signed.get("sth")
    formed = (
        signed.get("signature_algorithm") == "ed25519" and isinstance(signed.get("signature"), str) and isinstance(head, dict) and _named(head.get("log_id"))
        and _whole(head.get("tree_size")) and head["tree_size"] >= 1 and isinstance(head.get("root_hash"), str) and _HEX.match(head["root_hash"]) and _instant(head.get("sth_time"))
    )
    if not formed:
        raise Refused("malformed_sth")
    if head["log_id"] != ref:
        raise Refused("log_mismatch")
    if not _holds(key, statement(tag, head), signed["signature"]):
        raise Refused("sth_signature_invalid")
    if not all(isinstance(h, str) and _HEX.match(h) for h in path):
        raise Refused("malformed_proof")
    root = root_of(doc["leaf_index"], head["tree_size"], leaf_of(payload_hash), [bytes.fromhex(h) for h in path])
    if root is None or root.hex() != head["root_hash"]:
        raise Refused("inclusion_invalid")


CHECKS = {"rfc3161": check_stamp, "transparency_log": check_inclusion}


@F.pandas_udf(T.StringType())
def token_problem(kinds: pd.Series, tokens: pd.Series, hashes: pd.Series, refs: pd.Series, keys: pd.Series, algorithms: pd.Series) -> pd.Series:
    """Why a token doesn't hold, null if it does. refs, keys and algorithms are those of the trusted certificate, null where none is known."""

    def one(kind, token, payload, ref, key, algorithm):
        if kind not in CHECKS:
            return "unsupported_provider"
        if key is None:
            return "missing_certificate"
        if algorithm != "ed25519":
            return "algorithm_mismatch"
        if payload is None or not _HASH.match(payload):
            return "invalid_payload_hash"
        try:
            CHECKS[kind](token, payload, ref, key)
        except Refused as reason:
            return str(reason)
        except (ValueError, TypeError, AttributeError):
            return "malformed_token"
        return None

    return pd.Series([one(*x) for x in zip(kinds, tokens, hashes, refs, keys, algorithms, strict=True)], dtype=object)


# ---- the issuing side, for fixtures and drills


def _enveloped(seed: bytes, tag: str, name: str, body: dict) -> str:
    signature = base64.b64encode(ed25519.sign(seed, statement(tag, body))).decode()
    return base64.b64encode(json.dumps({name: body, "signature_algorithm": "ed25519", "signature": signature}).encode()).decode()


def stamp(seed: bytes, payload_hash: str, ref: str, time: str, serial: str, tag: str = STAMP_TAG) -> str:
    """A signed time stamp of a hash."""
    imprint = {"hash_algorithm": "sha-256", "hashed_message": payload_hash}
    return _enveloped(seed, tag, "tst_info", {"version": 1, "policy": "drill", "serial_number": serial, "gen_time": time, "tsa_cert_ref": ref, "message_imprint": imprint})


def _levels(leaves: list[bytes]) -> list[list[bytes]]:
    """The tree's levels, leaves first; an odd last node rises as it is."""
    out = [leaves]
    while len(out[-1]) > 1:
        low = out[-1]
        out.append([_node(low[i], low[i + 1]) if i + 1 < len(low) else low[i] for i in range(0, len(low), 2)])
    return out


def inclusions(seed: bytes, payload_hashes: list[str], log_id: str, time: str, tag: str = HEAD_TAG) -> list[str]:
    """Proofs of the inclusion of each hash in one log."""
    levels = _levels([leaf_of(h) for h in payload_hashes])
    head = _enveloped(seed, tag, "sth", {"log_id": log_id, "tree_size": len(payload_hashes), "root_hash": levels[-1][0].hex(), "sth_time": time})
    out = []
    for i in range(len(payload_hashes)):
        path = [level[(i >> k) ^ 1].hex() for k, level in enumerate(levels[:-1]) if (i >> k) ^ 1 < len(level)]
        out.append(json.dumps({"log_id": log_id, "leaf_index": i, "inclusion_proof": path, "signed_tree_head": head}))
    return out


def signer(seed: bytes):
    """An Arrow UDF that signs text: base64 of the signature, null for null."""

    @F.pandas_udf(T.StringType())
    def signed(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: base64.b64encode(ed25519.sign(seed, t.encode())).decode(), na_action="ignore")

    return signed


def stamper(seed: bytes, ref: str, time: str):
    """An Arrow UDF that gives time stamps of payload hashes."""

    @F.pandas_udf(T.StringType())
    def stamped(hashes: pd.Series) -> pd.Series:
        return hashes.map(lambda h: stamp(seed, h, ref, time, h[7:23]), na_action="ignore")

    return stamped
