"""Near-duplicates by SimHash fingerprints and meet-in-the-middle ball hashing.

Fingerprints at r = 3 or fewer differing bits are linked. A fingerprint emits the variants within half the
radius: all at one bit, and, to meet those of the other parity half way, variants at two bits. Of three
differing bits two lie in the same half of the word, and fingerprints three bits apart differ in parity; so two-bit
variants are needed within a half only, and from even fingerprints only. Equal variants meet in a shuffle:
whatever is one bit from a variant is linked to everything that meets there, so each meeting gives a star, not all pairs.
Stars are verified, and components follow from minimum labels with pointer jumping.

Before that, fingerprints that cannot have a partner are set aside: cut into six parts, two fingerprints
within three bits agree in three parts at least, so one that shares no three parts with another is alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import as_bytes, column, map_batches, materialise, release, whole_row

RADIUS, SHINGLE, SEED = 3, 3, 42
#: Shingles whose bits are counted at a time.
PART = 100_000


def shingle_hashes(text: bytes, size: int = SHINGLE) -> list[int]:
    """XXH64 of every run of `size` words of the lower-cased text, repeats included; of the whole sequence if shorter."""
    words = text.lower().split()
    if not words:
        return []
    joined = b" ".join(words)
    h = xxhash.xxh64_intdigest
    if len(words) <= size:
        return [h(joined, SEED)]
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    return [h(joined[a:z], SEED) for a, z in zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)]


def fingerprints(texts: list[bytes], size: int = SHINGLE) -> np.ndarray:
    """Signed 64-bit fingerprints: a bit is 1 if it is set in over half of the hashes; 0 for no words."""
    out = np.zeros(len(texts), dtype=np.uint64)
    held: list[int] = []
    owners: list[tuple[int, int]] = []

    def flush() -> None:
        if not held:
            return
        bits = np.unpackbits(np.array(held, dtype=">u8").view(np.uint8).reshape(-1, 8), axis=1)
        starts = np.cumsum([0, *(n for _, n in owners[:-1])])
        ones = np.add.reduceat(bits, starts, axis=0, dtype=np.int64)
        over = 2 * ones > np.array([n for _, n in owners])[:, None]
        out[[i for i, _ in owners]] = np.packbits(over, axis=1).view(">u8").ravel()
        held.clear()
        owners.clear()

    for i, text in enumerate(texts):
        hashes = shingle_hashes(text, size)
        if len(hashes) > PART:
            ones = np.zeros(64, dtype=np.int64)
            for at in range(0, len(hashes), PART):
                part = np.array(hashes[at : at + PART], dtype=">u8")
                ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
            out[i] = np.packbits(2 * ones > len(hashes)).view(">u8")[0]
        elif hashes:
            held.extend(hashes)
            owners.append((i, len(hashes)))
            if len(held) > PART:
                flush()
    flush()
    return out.view(np.int64)


def with_fingerprints(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, fp, text_hash) of every row; a null text has no words."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in it:
            yield {"doc_id": batch.column("doc_id"), "fp": fingerprints(as_bytes(batch.column("text"))), "text_hash": batch.column("text_hash")}

    own = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_hash"))
    return map_batches(own, run, "doc_id long, fp long, text_hash long")


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def partner_masks(parts: int = 6, radius: int = RADIUS) -> list[int]:
    """Masks of all choices of parts - radius parts of the word."""
    cuts = [64 * i // parts for i in range(parts + 1)]
    part = [((1 << (z - a)) - 1) << a for a, z in zip(cuts, cuts[1:], strict=False)]
    return [signed(sum(c)) for c in combinations(part, parts - radius)]


def one_bit() -> list[int]:
    return [signed(1 << i) for i in range(64)]


def two_bits() -> list[int]:
    """Pairs of bits in the same half of the word."""
    return [signed((1 << i) | (1 << j)) for half in (0, 32) for i, j in combinations(range(half, half + 32), 2)]


def longs(values: list[int]) -> Column:
    return F.array(*(F.lit(v).cast("long") for v in values))


def possible(fps: DataFrame) -> DataFrame:
    """The fingerprints that agree with another one in half the parts."""
    masks = partner_masks()
    keys = fps.select("fp", F.posexplode(longs(masks)).alias("m", "mask")).select("fp", "m", F.col("fp").bitwiseAND(F.col("mask")).alias("key"))
    shared = keys.groupBy("m", "key").agg(F.min("fp").alias("a"), F.max("fp").alias("z")).where("a <> z").select("m", "key")
    return keys.join(shared, ["m", "key"], "left_semi").select("fp").distinct()


def links(fps: DataFrame) -> DataFrame:
    """(a, b) with a < b: stars that connect exactly what chains of links of RADIUS bits connect."""
    even = F.bit_count("fp") % 2 == 0
    near = fps.select("fp", F.explode(longs([0, *one_bit()])).alias("x"), F.lit(1).alias("near"))
    half = fps.where(even).select("fp", F.explode(longs(two_bits())).alias("x"), F.lit(0).alias("near"))
    emitted = near.unionByName(half).select(F.col("fp").bitwiseXOR(F.col("x")).alias("variant"), "fp", "near")
    # At most 1 + 64 + 2016 fingerprints lie within two bits of a variant: no group is larger.
    centre = F.min(F.when(F.col("near") == 1, F.col("fp"))).over(W.partitionBy("variant"))
    met = emitted.withColumn("centre", centre).where(F.col("centre").isNotNull() & (F.col("centre") != F.col("fp")))
    return (
        met.where(F.bit_count(F.col("centre").bitwiseXOR(F.col("fp"))) <= RADIUS)
        .select(F.least("centre", "fp").alias("a"), F.greatest("centre", "fp").alias("b"))
        .distinct()
    )


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node that each node of (a, b) reaches.

    Every round a node takes the least label among itself and its neighbours, then the label of that
    label (pointer jumping); rounds are written to the shared folder, and only the count of changed nodes
    comes to the driver.
    """
    both = materialise(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "links")
    labels = materialise(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), "labels")
    while True:
        pointed = labels.select(F.col("node").alias("p"), F.col("label").alias("jump"))
        seen = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("least"))
        taken = labels.join(seen, labels["node"] == seen["a"]).select("node", F.col("label").alias("old"), F.least("label", "least").alias("now"))
        new = materialise(
            taken.join(pointed, taken["now"] == pointed["p"], "left").select("node", F.least("now", F.coalesce("jump", "now")).alias("label"), (F.least("now", F.coalesce("jump", "now")) != F.col("old")).alias("moved")),
            "labels",
        )
        changed = new.where("moved").limit(1).count()
        release(labels)
        labels = new
        if not changed:
            out = labels.select("node", "label")
            release(both)
            return out


def classed(documents: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(doc_id, fp, text_hash) of every row, and (fp, label, component_id) of every fingerprint."""
    prints = materialise(with_fingerprints(documents, id_col, text_col), "fingerprints")
    fps = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct-fingerprints")
    edges = materialise(links(materialise(possible(fps), "possible")), "stars")
    labels = components(edges)
    named = fps.join(labels, fps["fp"] == labels["node"], "left").select("fp", "first", F.coalesce("label", "fp").alias("label"))
    least = named.groupBy("label").agg(F.min("first").alias("component_id"))
    return prints, named.join(least, "label").select("fp", "label", "component_id")


def near_duplicates(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id reachable): one row a document.

    Defined cases: texts without words, null ones included, have fingerprint zero, linked like any other; null ids are
    kept and are never a component's id unless it has no other; repeated ids are kept; an empty table gives
    no rows; other columns are not looked at. Whole texts are hashed.
    """
    prints, table = classed(documents, id_col, text_col)
    return prints.join(table, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def drop_near_duplicates(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group, all columns as they were: the one with the smallest id, then the smallest hash of its text.

    Defined cases: documents are told apart by id and text, so unlike texts under one id are documents of their own groups; of
    rows that share both one stays; a null id comes after all others; an empty table
    gives no rows; columns of any name pass through.
    """
    prints, table = classed(documents, id_col, text_col)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "text_hash")).alias("first")
    firsts = prints.groupBy("fp").agg(first).select("fp", "first.*").join(table.select("fp", "label"), "fp")
    keep = firsts.groupBy("label").agg(first).select(F.col("first.doc_id").alias("kept_id"), F.col("first.text_hash").alias("kept_hash"))
    rows = documents.select(whole_row(documents), column(id_col).cast("long").alias("id"), F.xxhash64(column(text_col)).alias("hash"))
    found = rows.join(keep, F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("hash") == F.col("kept_hash")), "left_semi")
    # A filter on the first row of a window is applied before its shuffle too, so many equal rows do not meet in a task.
    place = F.row_number().over(W.partitionBy("id", "hash").orderBy(F.xxhash64(F.to_json("row"))))
    return found.withColumn("place", place).where("place = 1").select("row.*")
