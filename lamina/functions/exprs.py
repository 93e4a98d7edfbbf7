"""Column expressions for identity, hashing and vectors. All stay in the JVM."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the namespace of slice ids.
NAMESPACE = uuid.UUID("fabb402a-1e0f-55a8-83cd-2d0a124a3fca")


def marker(text: Column) -> Column:
    """SHA-256 of the exact UTF-8 bytes, lower-case hex."""
    return F.sha2(F.encode(text, "UTF-8"), 256)


def escaped(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|"))


def slice_name(corpus: Column, document_id: Column, size: Column, offset: Column) -> Column:
    """corpus|document|size|offset; a null corpus has no part in it."""
    return F.concat_ws("|", escaped(corpus), escaped(document_id), size.cast("string"), offset.cast("string"))


def uuid5(name: Column) -> Column:
    """Name-based UUID, version 5, in NAMESPACE."""
    h = F.sha1(F.concat(F.lit(NAMESPACE.bytes), F.encode(name, "UTF-8")))
    cut = lambda a, n: F.substring(h, a, n)
    variant = F.substring(F.lit("89ab"), (F.conv(cut(17, 1), 16, 10).cast("int") % 4 + 1), F.lit(1))
    return F.concat_ws("-", cut(1, 8), cut(9, 4), F.concat(F.lit("5"), cut(14, 3)), F.concat(variant, cut(18, 3)), cut(21, 12))


def slice_uuid(corpus: Column, document_id: Column, size: Column, offset: Column) -> Column:
    return uuid5(slice_name(corpus, document_id, size, offset))


def slice_uuid_py(corpus: str | None, document_id: str, size: int, offset: int) -> str:
    esc = lambda s: s.replace("\\", "\\\\").replace("|", "\\|")
    parts = [*([] if corpus is None else [esc(corpus)]), esc(document_id), str(size), str(offset)]
    return str(uuid.uuid5(NAMESPACE, "|".join(parts)))


def marker_py(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def pack_markers(markers: Column) -> Column:
    """Base64 of the digests one after another; a marker that is not 64 lower-case hex digits is an error."""
    bad = F.exists(markers, lambda m: ~F.coalesce(m.rlike("^[0-9a-f]{64}$"), F.lit(False)))
    packed = F.replace(F.base64(F.unhex(F.array_join(markers, ""))), F.lit("\r\n"), F.lit(""))
    return F.when(bad, F.raise_error(F.lit("a marker is 64 lower-case hex digits"))).otherwise(packed)


def unpack_markers(packed: Column) -> Column:
    """The digests again; bad base64 or a length that is no multiple of 32 bytes is an error."""
    raw = F.try_to_binary(packed, F.lit("base64"))
    n = F.octet_length(raw)
    hexed = F.lower(F.hex(raw))
    parts = F.when(n == 0, F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.greatest(n / 32, F.lit(1)).cast("int") - 1), lambda i: F.substring(hexed, i * 64 + 1, F.lit(64)))
    )
    return F.when(raw.isNull() | (n % 32 != 0), F.raise_error(F.lit("not packed markers"))).otherwise(parts)


def dot(a: Column, b: Column) -> Column:
    """Sum of products from left to right."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine; 0 if either vector is zero; vectors of unlike lengths are an error."""
    na, nb = F.sqrt(dot(a, a)), F.sqrt(dot(b, b))
    value = F.when((na == 0) | (nb == 0), F.lit(0.0)).otherwise(dot(a, b) / (na * nb))
    return F.when(F.size(a) != F.size(b), F.raise_error(F.lit("vectors of unlike lengths"))).otherwise(value)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once: a lambda's variable is not copied into each of its uses."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def fake_vector(text: Column, dimension: int) -> Column:
    """Deterministic test embedding: words of seeded SHA-256 blocks mapped to -1..1, at length one."""
    blocks = (dimension + 7) // 8
    seed = F.unhex(marker(text))
    digests = bound(seed, lambda d: F.concat(*(F.sha2(F.concat(d, F.lit(i.to_bytes(4, "big"))), 256) for i in range(blocks))))
    raw = bound(
        digests,
        lambda h: F.transform(
            F.sequence(F.lit(0), F.lit(dimension - 1)),
            lambda i: F.conv(F.substring(h, i * 8 + 1, F.lit(8)), 16, 10).cast("double") / 2147483648.0 - 1.0,
        ),
    )

    def at_length_one(v: Column) -> Column:
        norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
        return bound(norm, lambda m: F.transform(v, lambda x: F.when(m == 0, x).otherwise(x / m)))

    return bound(raw, at_length_one)


def fake_vectors(texts: pa.Array, dimension: int) -> pa.Array:
    """fake_vector() of a batch of texts: the same numbers, bit by bit; null for a null text."""
    blocks = (dimension + 7) // 8
    tails = [i.to_bytes(4, "big") for i in range(blocks)]
    digests = bytearray()
    known = [t for t in texts.to_pylist() if t is not None]
    for t in known:
        seed = hashlib.sha256(t.encode()).digest()
        for tail in tails:
            digests += hashlib.sha256(seed + tail).digest()
    raw = np.frombuffer(bytes(digests), ">u4").reshape(len(known), 8 * blocks)[:, :dimension] / 2147483648.0 - 1.0
    total = np.zeros(len(known))
    for column in np.ascontiguousarray(raw.T):
        total += column * column
    norm = np.sqrt(total)[:, None]
    values = np.where(norm == 0, raw, raw / np.where(norm == 0, 1.0, norm))
    held = np.array([t is not None for t in texts.to_pylist()], dtype=bool) if texts.null_count else np.ones(len(texts), dtype=bool)
    offsets = np.concatenate([[0], np.cumsum(np.where(held, dimension, 0))]).astype(np.int32)
    mask = pa.array(~held) if texts.null_count else None
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values.ravel()), mask=mask)


def fake_vector_batches(text: Column, dimension: int) -> Column:
    """fake_vector() by Arrow batches: faster than the expression where very many texts are embedded."""

    @F.arrow_udf("array<double>")
    def vectors(texts: pa.Array) -> pa.Array:
        return fake_vectors(texts, dimension)

    return vectors(text)
