"""Export packages: selection that preserves continuity, package hash, seal and its verification.

A package is one document of one database, rooted at its first segment: without
the segments from there on nothing proves that none is missing. ``packages``
makes small ones as a row each; ``package_hashes`` hashes one of any size as its
text streams by.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lodeline.functions import canonical as C
from lodeline.operators.verify import key_state
from lodeline.session import cut_lineage

#: What is signed is this tag, a colon and the package hash; a verifier of other packages passes their tag.
DOMAIN = "export-package-v1"
VERSION = "export-package-1.0"
#: A package's lists of rows, in the order of its text.
LISTS = ("anchor_records", "object_refs", "segment_manifests")
#: Characters of text that are handed to Python at once; Arrow batches count rows, not bytes.
PIECE = 1024


def selection_problems(selected: DataFrame, manifests: DataFrame, records: DataFrame) -> DataFrame:
    """(db_id, problem, segment_sequence, object_id): why the supplied segments don't carry the selected objects.

    selected: db_id, envelope_id. records: db_id, segment_id. uncovered: an object
    in no supplied segment; duplicate: a number supplied twice; missing: a number
    from 0 to the last that holds a selected object; no_anchor: of these, one
    without an anchor record; beyond: a segment after the last that is needed;
    no_objects: nothing is selected of a database.
    """
    return _problems(_held(selected, manifests), manifests, records)


def _held(selected: DataFrame, manifests: DataFrame) -> DataFrame:
    """The selected objects with each place that holds them; nulls for one that no segment holds."""
    wanted = selected.select("db_id", "envelope_id").distinct()
    objects = manifests.select("db_id", "segment_id", "segment_sequence", F.explode("objects").alias("o")).select("db_id", "segment_id", "segment_sequence", F.col("o.envelope_id").alias("envelope_id"), F.col("o.seq").alias("seq"), F.col("o.event_hash").alias("event_hash"))
    return wanted.join(objects, ["db_id", "envelope_id"], "left")


def _problems(held: DataFrame, manifests: DataFrame, records: DataFrame) -> DataFrame:
    none = F.lit(None).cast("string")
    covered = held.groupBy("db_id", "envelope_id").agg(F.max("segment_sequence").alias("n"))
    uncovered = covered.where("n is null").select("db_id", F.lit("uncovered").alias("problem"), F.col("n").alias("segment_sequence"), F.col("envelope_id").alias("object_id"))
    need = covered.groupBy("db_id").agg(F.max("n").alias("last")).where("last is not null")
    numbers = manifests.groupBy("db_id", "segment_sequence").agg(F.count(F.lit(1)).alias("n"), F.min("segment_id").alias("segment_id"))
    duplicate = numbers.where("n > 1").select("db_id", F.lit("duplicate").alias("problem"), "segment_sequence", none.alias("object_id"))
    beyond = numbers.join(need, "db_id").where("segment_sequence > last").select("db_id", F.lit("beyond").alias("problem"), "segment_sequence", none.alias("object_id"))
    every = need.select("db_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("last"))).alias("segment_sequence"))
    missing = every.join(numbers, ["db_id", "segment_sequence"], "left_anti").select("db_id", F.lit("missing").alias("problem"), "segment_sequence", none.alias("object_id"))
    bare = every.join(numbers, ["db_id", "segment_sequence"]).join(records.select("db_id", "segment_id"), ["db_id", "segment_id"], "left_anti").select("db_id", F.lit("no_anchor").alias("problem"), "segment_sequence", none.alias("object_id"))
    empty = manifests.select("db_id").distinct().join(held, "db_id", "left_anti").select("db_id", F.lit("no_objects").alias("problem"), F.lit(None).cast("bigint").alias("segment_sequence"), none.alias("object_id"))
    return uncovered.unionByName(duplicate).unionByName(missing).unionByName(bare).unionByName(beyond).unionByName(empty)


def record_text() -> Column:
    """A canonical anchor record."""
    number = ("segment_sequence", "head_count")
    names = ("db_id", "segment_id", "segment_sequence", "segment_hash", "last_row_hash", "head_count", "created_at", "signing_key_id", "algorithm", "signature", "provider_type", "token", "cert_ref")
    return C.obj({n: C.token(F.col(n), "number" if n in number else "string") for n in names})


def _lists(held: DataFrame, manifests: DataFrame, records: DataFrame) -> dict[str, DataFrame]:
    """The rows of each of ``LISTS``: db_id, their order (number, name, seq) and text."""
    from lodeline.operators.segments import manifest_text

    no, blank = F.lit(0).cast("bigint"), F.lit("")
    row = lambda df, number, name, seq, text: df.select("db_id", number.cast("bigint").alias("number"), name.alias("name"), seq.cast("bigint").alias("seq"), text.alias("text"))
    ref = C.obj({"object_id": C.token(F.col("envelope_id")), "object_type": F.lit('"cce"'), "worm_object_key": C.token(C.object_key(F.col("db_id"), F.col("segment_id"), F.col("seq"), "cce")), "event_hash": C.token(F.col("event_hash"))})
    return {
        "anchor_records": row(records, F.col("segment_sequence"), blank, no, C.json_text(record_text())),
        "object_refs": row(held.where("segment_sequence is not null"), no, F.col("segment_id"), F.col("seq"), ref),
        "segment_manifests": row(manifests, F.col("segment_sequence"), blank, no, C.json_text(manifest_text())),
    }


def _between(df: DataFrame, keys: DataFrame) -> tuple[DataFrame, list[Column]]:
    """df, of described packages, with ``_keys``; the text before, between and after the lists."""
    public = keys.select(C.obj({"key_id": C.token(F.col("key_id")), "algorithm": C.token(F.col("algorithm")), "public_key": C.token(F.col("public_key"))}).alias("text"), "key_id").agg(F.array_sort(F.collect_list(F.struct("key_id", "text"))).alias("_keys"))
    members = {"package_version": F.lit(f'"{VERSION}"'), **{n: C.token(F.col(n)) for n in ("package_id", "db_id", "purpose", "created_at", "created_by")}, "public_keys": C.arr(F.transform("_keys", lambda x: x["text"]))}
    out, text = [], F.lit("{")
    for i, name in enumerate(sorted([*members, *LISTS])):
        text = F.concat(text, F.lit("," * bool(i) + json.dumps(name) + ":"), members.get(name, F.lit("[")))
        if name in LISTS:
            out.append(text)
            text = F.lit("]")
    return df.join(public), [*out, F.concat(text, F.lit("}"))]


def packages(selected: DataFrame, manifests: DataFrame, records: DataFrame, keys: DataFrame, described: DataFrame) -> DataFrame:
    """One package for each database without a problem of selection: db_id, package_id, created_at, body (canonical, without seal), package_hash.

    manifests hold the segments that are exported; described: db_id, package_id,
    purpose, created_at, created_by. A body is one row's text, gathered in one
    task: for packages of some ten MB. ``package_hashes`` takes larger ones.
    """
    held = _held(selected, manifests)
    df = described.join(_problems(held, manifests, records).select("db_id").distinct(), "db_id", "left_anti")
    for name, rows in _lists(held, manifests, records).items():
        df = df.join(rows.groupBy("db_id").agg(F.array_sort(F.collect_list(F.struct("number", "name", "seq", "text"))).alias(name)), "db_id")
    df, (start, *rest) = _between(df, keys)
    texts = lambda name: F.array_join(F.transform(name, lambda x: x["text"]), ",")
    whole = F.concat(start, *[x for name, text in zip(LISTS, rest, strict=True) for x in (texts(name), text)])
    return df.select("db_id", "package_id", "created_at", whole.alias("body")).withColumn("package_hash", C.sha(F.col("body")))


def package_hashes(selected: DataFrame, manifests: DataFrame, records: DataFrame, keys: DataFrame, described: DataFrame) -> DataFrame:
    """The rows of described that ``packages`` would make a package of, with its package_hash.

    No body is ever whole: the lists' rows pass in order through one task for each
    database, as a hash has one beginning and one end, and are hashed in pieces.
    Several packages of a database are hashed in one pass.
    """
    held = cut_lineage(_held(selected, manifests))
    none, blank = F.lit(None).cast("string"), F.lit("")
    schema = T.StructType([*described.schema.fields, T.StructField("package_hash", T.StringType())])
    df, texts = _between(described.where("db_id is not null"), keys)
    # section 0 is what is described, -1 says that the selection is refused, 1 and on are the lists
    about, between = F.struct(*[F.col(c) for c in described.columns]), F.array(*texts)
    row = lambda df, section, about, between: df.select("db_id", F.lit(section).alias("section"), "number", "name", "seq", "text", about.alias("about"), between.alias("between"))
    first = lambda df: df.select("*", F.lit(0).cast("bigint").alias("number"), blank.alias("name"), F.lit(0).cast("bigint").alias("seq"), none.alias("text"))
    no_about, no_between = F.lit(None).cast(T.StructType(described.schema.fields)), F.lit(None).cast("array<string>")
    rows = row(first(df), 0, about, between).unionByName(row(first(_problems(held, manifests, records).select("db_id").distinct()), -1, no_about, no_between))
    for section, part in enumerate(_lists(held, manifests, records).values(), 1):
        rows = rows.unionByName(row(part, section, no_about, no_between))
    ordered = rows.where("db_id is not null").repartition("db_id").sortWithinPartitions("db_id", "section", "number", "name", "seq", "text")
    pieces = ordered.select("db_id", "section", "about", "between", F.posexplode_outer(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))).alias("nth", "piece"))
    arrow, n = to_arrow_schema(schema), len(LISTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, refused, at, full, made = None, False, 0, 0, []

        def closed() -> list[dict]:
            if refused or full < n:
                return []
            for _, texts, digest in made:
                digest.update(texts[n].encode())
            return [{**about, "package_hash": "sha256:" + digest.hexdigest()} for about, _, digest in made]

        for batch in batches:
            done = []
            for db, section, about, between, nth, piece in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if db != current:
                    done += closed()
                    current, refused, at, full, made = db, False, 0, 0, []
                if section == -1:
                    refused = True
                elif section == 0:
                    made.append((about, between, hashlib.sha256()))
                elif not refused:
                    before = b"," if nth == 0 and at == section else b""
                    for _, texts, digest in made:
                        digest.update("".join(texts[at:section]).encode() or before)
                        digest.update(piece)
                    full += at < section
                    at = section
            yield pa.RecordBatch.from_pylist(done, schema=arrow)
        yield pa.RecordBatch.from_pylist(closed(), schema=arrow)

    return pieces.withColumn("piece", F.col("piece").cast("binary")).mapInArrow(run, schema)


def signing_message(package_hash: Column, domain: str = DOMAIN) -> Column:
    return F.concat(F.lit(domain + ":"), package_hash)


def seal_failures(sealed: DataFrame, keys: DataFrame, domain: str = DOMAIN) -> DataFrame:
    """(package_id, problem) of each package whose seal doesn't hold.

    sealed: package_id, created_at, body, package_hash, signing_key_id,
    algorithm, signature; body_hash in place of body if it was hashed as it
    streamed. keys are those trusted out of band, not the package's own.
    package_hash: not that of the body; the key's state unless active when the
    package was made; algorithm; signature.
    """
    from lodeline.functions.ed25519 import verified

    known = keys.groupBy("key_id").agg(F.min_by(F.struct(F.col("algorithm").alias("a"), F.col("public_key").alias("p")), F.struct("created_ms", "revoked_ms")).alias("k"))
    df = key_state(sealed.withColumn("key_id", F.col("signing_key_id")).withColumn("at_ms", F.unix_millis(F.try_to_timestamp("created_at"))), keys).join(known, "key_id", "left")
    df = df.withColumn("_hash", C.sha(F.col("body")) if "body" in sealed.columns else F.col("body_hash")).withColumn("_ok", verified(F.col("k.p"), signing_message(F.col("_hash"), domain), F.col("signature")))
    problem = (
        F.when(~F.col("package_hash").eqNullSafe(F.col("_hash")), "package_hash").when(F.col("key_state") != "active", F.col("key_state"))
        .when(~F.col("algorithm").eqNullSafe(F.col("k.a")) | (F.col("algorithm") != "ed25519"), "algorithm").when(~F.col("_ok"), "signature")
    )
    return df.select("package_id", problem.alias("problem")).where(F.col("problem").isNotNull())


def package_key(db_id: Column, package_id: Column, prefix: str = "exports") -> Column:
    """Where a package is put; ``sinks.put_new`` keeps it from being overwritten."""
    return F.concat(F.lit(prefix + "/"), db_id, F.lit("/"), package_id, F.lit(".json"))
