"""Language-model scoring with a Brown class-based bigram model.

P(w | v) = mix * P(class w | class v) * P(w | class w) + (1 - mix) * P0(w), where P0 is the add-0.1
unigram model over the training tokens. Classes come from exchange clustering in two parts. To begin with, the commonest
words are moved between classes one by one while that raises the bigram likelihood, and every other word joins the class
that suits its contexts among them. Then come sweeps over the whole vocabulary: each training word, common or rare, moves
to the class that raises the likelihood most, by all its bigrams counted against the classes of all words after the
pass before. Words of a pass move at once, as in distributed exchange, and words alike would all leave for the same class:
so a sweep takes RARE passes, a part of the words in each, and common words, which weigh more, take turns over COMMON
passes. When all have had their turn it goes on until a sweep gains less than TOLERANCE; the best classes met are used.

Texts are cut into chunks of whole documents. A chunk is one row: its documents as numbers into its own word list.
Words are known by 64-bit hashes, and each chunk deals its list over hash buckets; a bucket sees all counts and
contexts of its words, and answers each chunk with counts and classes in the chunk's order. So no vocabulary is ever
broadcast or gathered: what a task holds is one chunk, or one bucket, whose number grows with the input.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, map_batches, materialise, release

#: Gain of a sweep, in nats a training token, below which classes count as settled; contexts of words weighed at a time.
TOLERANCE, WEIGHED = 0.01, 1 << 16
#: Counts of a word with a context whose worth is reckoned once for all words.
SMALL = (1, 2, 3)
#: Stripes that a matrix of bigrams is cut into, and groups of tasks, when it is summed up.
STRIPES, TASK_GROUPS = 64, 64
#: Passes over which words take turns, for rare ones and for those of over a 1,024th of the tokens.
RARE, COMMON = 2, 4
#: Text of a chunk and text per hash bucket, in bytes; words the start is made from, on the driver; classes; weight of the class model.
CHUNK, PER_BUCKET, HEAD, CLASSES, MIX = 16 << 20, 8 << 20, 1024, 48, 0.8
#: The end of a text as a word: no word holds a line feed.
END = b"\n"
ROWS = "kind string, chunk long, bucket int, a binary, b binary, c binary, d binary"


def i8(x) -> bytes:
    return np.ascontiguousarray(x, dtype="<i8").tobytes()


def u4(x) -> bytes:
    return np.ascontiguousarray(x, dtype="<u4").tobytes()


def row(kind: str, chunk: int, bucket: int, *cols: bytes) -> dict:
    return {"kind": kind, "chunk": chunk, "bucket": bucket} | dict(zip("abcd", [*cols, *[b""] * 4], strict=False))


def rows_out(rows: list[dict]) -> dict:
    return {k: [r[k] for r in rows] for k in ("kind", "chunk", "bucket", "a", "b", "c", "d")}


def planes(x: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers, all lowest bytes first, then the next: small numbers leave runs of zeros."""
    return np.ascontiguousarray(np.ascontiguousarray(x, dtype="<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def from_planes(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def chunk_row(chunk: int, docs: list[tuple[int | None, bytes]], buckets: int) -> dict:
    """ids: ids and flags (1 held out, 2 null); lengths and tokens of the documents; hashes and training counts of the words.

    Words are numbered by their frequency in the chunk. places: where each stands in order of bucket and hash.
    """
    place: dict[bytes, int] = {END: 0}
    tokens: list[np.ndarray] = []
    for _, text in docs:
        words = text.lower().split()
        tokens.append(np.array([place.setdefault(w, len(place)) for w in words] + [0], dtype=np.uint32))
    h = xxhash.xxh64_intdigest
    hashes = np.fromiter((h(w) for w in place), np.uint64, len(place))
    lengths = np.array([len(t) for t in tokens], dtype=np.int64)
    flat = np.concatenate(tokens)
    order = np.argsort(-np.bincount(flat, minlength=len(place)), kind="stable")
    rank = np.empty(len(order), dtype=np.uint32)
    rank[order] = np.arange(len(order), dtype=np.uint32)
    hashes, flat = hashes[order], rank[flat]
    held = np.array([zlib.crc32(b"" if d is None else str(d).encode()) % 10 == 0 for d, _ in docs])
    counts = np.bincount(flat[np.repeat(~held, lengths)], minlength=len(hashes))
    flags = held.astype(np.uint8) + 2 * np.array([d is None for d, _ in docs], dtype=np.uint8)
    places = np.empty(len(hashes), dtype=np.int64)
    places[np.lexsort((hashes, hashes % np.uint64(buckets)))] = np.arange(len(hashes))
    return {
        "chunk": chunk, "ids": i8([d or 0 for d, _ in docs]) + flags.tobytes(), "lengths": planes(lengths), "tokens": planes(flat),
        "hashes": hashes.astype("<u8").tobytes(), "counts": planes(counts), "places": planes(places), "ends": int(rank[0]),
    }


def bucket_runs(hashes: np.ndarray, places: np.ndarray, buckets: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """The words in order of bucket and hash, and each bucket's stretch of them."""
    order = np.empty(len(places), dtype=np.int64)
    order[places] = np.arange(len(places))
    return order, list(runs((hashes[order] % np.uint64(buckets)).astype(np.int64)))


def runs(sorted_values: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(value, start, end) of equal neighbours."""
    if len(sorted_values):
        cuts = [0, *(np.flatnonzero(np.diff(sorted_values)) + 1).tolist(), len(sorted_values)]
        for a, z in zip(cuts, cuts[1:], strict=False):
            yield int(sorted_values[a]), a, z


def docs_of(r: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """ids, flags, lengths, tokens."""
    lengths = from_planes(r["lengths"]).astype(np.int64)
    n = len(lengths)
    return np.frombuffer(r["ids"][: 8 * n], "<i8"), np.frombuffer(r["ids"][8 * n :], np.uint8), lengths, from_planes(r["tokens"])


CHUNKS = "chunk long, ids binary, lengths binary, tokens binary, hashes binary, counts binary, places binary, ends long"


def encode(documents: DataFrame, buckets: int, id_col: str, text_col: str, chunk_bytes: int) -> DataFrame:
    """One row a chunk, written once."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        part, made = TaskContext.get().partitionId(), 0
        docs: list = []
        size = 0
        for batch in it:
            for d, t in zip(batch.column("doc_id").to_pylist(), as_bytes(batch.column("text")), strict=True):
                docs.append((d, t))
                size += len(t) + 64
                if size >= chunk_bytes:
                    yield {k: [v] for k, v in chunk_row((part << 24) + made, docs, buckets).items()}
                    docs, size, made = [], 0, made + 1
        if docs:
            yield {k: [v] for k, v in chunk_row((part << 24) + made, docs, buckets).items()}

    own = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return materialise(map_batches(own, run, CHUNKS), "lm-chunks")


def word_rows(chunks: DataFrame, buckets: int) -> DataFrame:
    """`words` rows: each chunk's hashes and training counts, by bucket."""

    def split(it: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in it:
            for r in batch.to_pylist():
                h, c = np.frombuffer(r["hashes"], "<u8"), from_planes(r["counts"])
                order, found = bucket_runs(h, from_planes(r["places"]), buckets)
                h, c = h[order], c[order]
                yield rows_out([row("words", r["chunk"], b, h[a:z].tobytes(), planes(c[a:z])) for b, a, z in found])

    return map_batches(chunks.select("chunk", "hashes", "counts", "places"), split, ROWS)


def totals(words: DataFrame, head: int) -> tuple[int, int, list[tuple[int, int]]]:
    """Training tokens, distinct training words, and the commonest (hash, count), from bucket-wise sums."""

    def merge(table: pa.Table) -> pa.Table:
        h, c = merged(table.to_pylist())[:2]
        h, c = h[c > 0], c[c > 0]
        top = np.lexsort((h, -c))[:head]
        return pa.table({
            "n": pa.array([int(c.sum())], pa.int64()), "v": pa.array([len(h)], pa.int64()),
            "top": pa.array([[{"h": int(a), "c": int(b)} for a, b in zip(h[top].view(np.int64), c[top], strict=True)]], pa.list_(pa.struct([("h", pa.int64()), ("c", pa.int64())]))),
        })

    per = materialise(words.groupBy("bucket").applyInArrow(merge, "n long, v long, top array<struct<h:long,c:long>>"), "lm-totals")
    n, v = per.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    top = per.select(F.explode("top").alias("t")).select("t.h", "t.c").orderBy(F.desc("c"), "h").limit(head).collect()
    release(per)
    return n, v, [(r.h, r.c) for r in top]


def merged(rows: list[dict]) -> tuple[np.ndarray, np.ndarray, dict[int, np.ndarray]]:
    """Distinct hashes of a bucket, their summed counts, and each chunk's places in them."""
    parts = [(r["chunk"], np.frombuffer(r["a"], "<u8"), from_planes(r["b"])) for r in rows if r["kind"] == "words"]
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), {}
    h, inverse = np.unique(np.concatenate([p[1] for p in parts]), return_inverse=True)
    c = np.bincount(inverse, weights=np.concatenate([p[2] for p in parts]), minlength=len(h)).astype(np.int64)
    cuts = np.cumsum([0, *(len(p[1]) for p in parts)])
    return h, c, {p[0]: inverse[a:z] for p, a, z in zip(parts, cuts, cuts[1:], strict=False)}


def neighbours(lengths: np.ndarray, tokens: np.ndarray, end: int, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(previous, token) of all tokens of kept texts; a text's first token follows an end."""
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[0] = end
    mask = np.repeat(keep, lengths)
    return before[mask], tokens[mask]


def local_class(h: np.ndarray, ids: np.ndarray, classes: np.ndarray, missing: int) -> np.ndarray:
    """For each word of a chunk the class of its hash in (sorted ids, classes), or `missing`."""
    if not len(ids):
        return np.full(len(h), missing)
    at = np.minimum(np.searchsorted(ids, h), len(ids) - 1)
    return np.where(ids[at] == h, classes[at], missing)


def head_bigrams(chunks: DataFrame, head: np.ndarray) -> np.ndarray:
    """Training bigram counts among the head words (last row and column: all others). Each task adds up its chunks and cuts the
    matrix into stripes, which are summed by groups of tasks and then over these: a matrix of a fixed size reaches the driver."""
    size = len(head) + 1
    held = chunks.sparkSession.sparkContext.broadcast(head)

    width = -(-size * size // STRIPES)

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        total = np.zeros(size * size, dtype=np.int64)
        ids = held.value
        for batch in it:
            for r in batch.to_pylist():
                _, flags, lengths, tokens = docs_of(r)
                cls = local_class(np.frombuffer(r["hashes"], "<u8"), ids, np.arange(len(ids)), len(ids))
                a, b = neighbours(lengths, tokens, r["ends"], flags % 2 == 0)
                total += np.bincount(cls[a].astype(np.int64) * size + cls[b], minlength=size * size)
        group = TaskContext.get().partitionId() % TASK_GROUPS
        parts = [(s, total[s * width : (s + 1) * width]) for s in range(STRIPES)]
        found = [(s, np.flatnonzero(part), part) for s, part in parts if part.any()]
        yield {"g": [group] * len(found), "s": [s for s, _, _ in found], "k": [u4(k) for _, k, _ in found], "m": [i8_planes(p[k]) for _, k, p in found]}

    def add(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        total = np.zeros(width, dtype=np.int64)
        for r in rows:
            total[np.frombuffer(r["k"], "<u4")] += from_i8_planes(r["m"])
        k = np.flatnonzero(total)
        return pa.table({"g": pa.array([0], pa.int64()), "s": pa.array([rows[0]["s"]], pa.int64()), "k": pa.array([u4(k)], pa.binary()), "m": pa.array([i8_planes(total[k])], pa.binary())})

    schema = "g long, s long, k binary, m binary"
    counted = map_batches(chunks.select("chunk", "ids", "lengths", "tokens", "hashes", "ends"), count, schema)
    added = counted.groupBy("g", "s").applyInArrow(add, schema).groupBy("s").applyInArrow(add, schema)
    out = np.zeros(width * STRIPES, dtype=np.int64)
    for r in added.toLocalIterator():
        out[r["s"] * width : (r["s"] + 1) * width][np.frombuffer(r["k"], "<u4")] += from_i8_planes(r["m"])
    return out[: size * size].reshape(size, size)


def xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange(counts: np.ndarray, classes: int = CLASSES) -> np.ndarray:
    """Classes of words by exchange: each word in turn goes to the class that raises the class-bigram
    likelihood most, until a sweep moves none. counts: words x words, the commonest first; words start in turn."""
    n = len(counts)
    classes = max(1, min(classes, n))
    of = np.arange(n) % classes
    one = np.eye(classes)[of]
    right = counts @ one  # word x class: what follows
    left = counts.T @ one  # word x class: what goes before
    table = one.T @ right
    # What rounding could feign is no gain: so every move raises the likelihood, and the sweeps come to an end.
    least = 1e-9 * (1 + counts.sum())
    moved = n
    while moved:
        moved = 0
        for w in range(n):
            k = of[w]
            r, l, own = right[w].copy(), left[w].copy(), counts[w, w]
            # contexts with w itself taken out of every class
            r[k] -= own
            l[k] -= own
            table[k, :] -= r
            table[:, k] -= l
            table[k, k] -= own
            # bigrams of other words with w count for those words' classes wherever w goes
            rows, cols = table.sum(axis=1) + l, table.sum(axis=0) + r
            nw_r, nw_l = r.sum() + own, l.sum() + own
            gain = (xlogx(table + r[None, :]) - xlogx(table)).sum(axis=1) + (xlogx(table + l[:, None]) - xlogx(table)).sum(axis=0)
            d = np.diag(table)
            rd, ld = r, l
            gain += xlogx(d + rd + ld + own) - xlogx(d + rd) - xlogx(d + ld) + xlogx(d)
            gain -= xlogx(rows + nw_r) - xlogx(rows) + xlogx(cols + nw_l) - xlogx(cols)
            best = int(gain.argmax())
            if gain[best] <= gain[k] + least:
                best = k
            table[best, :] += r
            table[:, best] += l
            table[best, best] += own
            if best != k:
                moved += 1
                of[w] = best
                left[:, k] -= counts[w, :]
                left[:, best] += counts[w, :]
                right[:, k] -= counts[:, w]
                right[:, best] += counts[:, w]
    return of


def context_rows(chunks: DataFrame, ids: np.ndarray, of: np.ndarray, classes: int, buckets: int) -> DataFrame:
    """`contexts` rows: for each chunk and bucket, (word's place, context, count) of words outside the head.

    A context is the class of a head neighbour, before (0..) or after (classes..) the word.
    """
    held = chunks.sparkSession.sparkContext.broadcast((ids, of))

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        wide = 2 * classes
        for batch in it:
            for r in batch.to_pylist():
                _, flags, lengths, tokens = docs_of(r)
                h, places = np.frombuffer(r["hashes"], "<u8"), from_planes(r["places"]).astype(np.int64)
                cls = local_class(h, *held.value, classes)
                a, b = neighbours(lengths, tokens, r["ends"], flags % 2 == 0)
                ca, cb = cls[a], cls[b]
                after, before = (ca < classes) & (cb == classes), (ca == classes) & (cb < classes)
                key, m = np.unique(np.concatenate([places[b[after]] * wide + ca[after], places[a[before]] * wide + classes + cb[before]]), return_counts=True)
                out = []
                for bucket, x, z in bucket_runs(h, places, buckets)[1]:
                    i, j = np.searchsorted(key, [x * wide, z * wide])
                    if j > i:
                        word = key[i:j] // wide - x
                        out.append(row("contexts", r["chunk"], bucket, planes(np.diff(word, prepend=0)), (key[i:j] % wide).astype(np.uint8).tobytes(), planes(m[i:j])))
                if out:
                    yield rows_out(out)

    return map_batches(chunks.select("chunk", "ids", "lengths", "tokens", "hashes", "places", "ends"), count, ROWS)


ARROW = (("kind", pa.string()), ("chunk", pa.int64()), ("bucket", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary()), ("d", pa.binary()))


def assign(words: DataFrame, contexts: DataFrame, head: tuple[np.ndarray, np.ndarray], table: np.ndarray) -> DataFrame:
    """`known` rows for each chunk and bucket: training counts and classes in the order of the chunk's words.

    Words outside the head make one exchange step: the class whose transitions best explain their
    contexts, smoothed; words without a context join the class of the largest share of other words.
    All this is a start for settle().
    """
    classes = len(table)
    rows_, cols = table.sum(axis=1) + 1.0, table.sum(axis=0) + 1.0
    smooth = table + 0.5
    share = cols / cols.sum()
    # log P(k | before) and log P(after | k), against their averages
    lift = np.log(smooth / rows_[:, None]) - np.log(share)[None, :]
    gains = np.concatenate([lift, lift.T], axis=0)  # 2 classes contexts x classes
    held = words.sparkSession.sparkContext.broadcast((*head, gains))
    default = int(share.argmax())

    def step(t: pa.Table) -> pa.Table:
        rows = t.to_pylist()
        ids, of, gain = held.value
        h, c, places = merged(rows)
        cls = np.full(len(h), default, dtype=np.int64)
        keys, ms = [], []
        for r in rows:
            if r["kind"] == "contexts":
                keys.append(places[r["chunk"]][np.cumsum(from_planes(r["a"]).astype(np.int64))].astype(np.int64) * (2 * classes) + np.frombuffer(r["b"], np.uint8))
                ms.append(from_planes(r["c"]).astype(np.float64))
        if keys:
            key, inverse = np.unique(np.concatenate(keys), return_inverse=True)
            m = np.bincount(inverse, weights=np.concatenate(ms))
            cls = best_classes(key, m, gain, classes, cls)
        if len(ids):
            at = np.minimum(np.searchsorted(ids, h), len(ids) - 1)
            cls = np.where(ids[at] == h, of[at], cls)
        out = [row("known", chunk, rows[0]["bucket"], i8_planes(c[p]), cls[p].astype(np.uint8).tobytes()) for chunk, p in places.items()]
        return pa.table({k: pa.array([r[k] for r in out], x) for k, x in ARROW})

    return words.unionByName(contexts).groupBy("bucket").applyInArrow(step, ROWS)


def best_classes(key: np.ndarray, m: np.ndarray, gain: np.ndarray, classes: int, start: np.ndarray) -> np.ndarray:
    """The class of largest summed gain of every word that has contexts; keys are sorted by word."""
    out = start.copy()
    word = key // (2 * classes)
    firsts = np.concatenate([[0], np.flatnonzero(np.diff(word)) + 1])
    for a in range(0, len(firsts), 20_000):
        begin = firsts[a]
        stop = firsts[a + 20_000] if a + 20_000 < len(firsts) else len(key)
        part = gain[key[begin:stop] % (2 * classes)] * m[begin:stop, None]
        total = np.add.reduceat(part, firsts[a : a + 20_000] - begin, axis=0)
        out[word[firsts[a : a + 20_000]]] = total.argmax(axis=1)
    return out


def seen_rows(chunks: DataFrame, known: DataFrame, classes: int) -> DataFrame:
    """`seen` rows: for each chunk and bucket, (word's place, context, count) of all training bigrams of all words, and the
    words' classes; and for each chunk a `bigrams` row, its class bigrams.

    A context is the class of the word before (0..) or after (classes..), or the word itself (2 * classes).
    """
    wide = 2 * classes + 1

    def join(own: pa.Table, dictionary: pa.Table) -> pa.Table:
        r = own.to_pylist()[0]
        parts = sorted(dictionary.to_pylist(), key=lambda x: x["bucket"])
        kind = np.uint32 if (len(r["places"]) // 4 + 1) * wide < 1 << 32 else np.int64
        places = from_planes(r["places"]).astype(kind)
        cls = np.concatenate([np.frombuffer(x["b"], np.uint8) for x in parts])[places].astype(kind)
        _, flags, lengths, tokens = docs_of(r)
        a, b = neighbours(lengths, tokens, r["ends"], flags % 2 == 0)
        out = [row("bigrams", r["chunk"], 0, i8(np.bincount(cls[a] * kind(classes) + cls[b], minlength=classes * classes)))]
        itself = a == b
        x, y = a[~itself], b[~itself]
        at = places * kind(wide)
        key = np.concatenate([at[y] + cls[x], at[x] + cls[y] + kind(classes), at[a[itself]] + kind(2 * classes)])
        del tokens, a, b, x, y, itself
        key.sort()
        starts = np.flatnonzero(np.diff(key, prepend=key[:1] + kind(1)))
        m = np.diff(starts, append=len(key))
        key = key[starts].astype(np.int64)
        first = 0
        for p in parts:
            end = first + len(p["b"])
            i, j = np.searchsorted(key, [first * wide, end * wide])
            word = key[i:j] // wide - first
            out.append(row("seen", r["chunk"], p["bucket"], planes(np.diff(word, prepend=0)), (key[i:j] % wide).astype(np.uint8).tobytes(), planes(m[i:j]), p["b"]))
            first = end
        return pa.table({k: pa.array([o[k] for o in out], x) for k, x in ARROW})

    own = chunks.select("chunk", "ids", "lengths", "tokens", "places", "ends")
    both = own.groupBy("chunk").cogroup(known.select("chunk", "bucket", "b").groupBy("chunk"))
    return both.applyInArrow(join, ROWS)


def move(words: DataFrame, seen: DataFrame, table: np.ndarray, turn: int) -> DataFrame:
    """`known` rows after pass number `turn`: each word whose turn it is in its best class, by all its bigrams."""
    wide = 2 * len(table) + 1
    held = words.sparkSession.sparkContext.broadcast(table)

    def step(t: pa.Table) -> pa.Table:
        rows = t.to_pylist()
        h, c, places = merged(rows)
        of = np.zeros(len(h), dtype=np.int64)
        keys, ms = [], []
        for r in rows:
            if r["kind"] == "seen":
                at = places[r["chunk"]]
                of[at] = np.frombuffer(r["d"], np.uint8)
                keys.append(at[np.cumsum(from_planes(r["a"]).astype(np.int64))].astype(np.int64) * wide + np.frombuffer(r["b"], np.uint8))
                ms.append(from_planes(r["c"]).astype(np.float64))
        key, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        m = np.bincount(inverse, weights=np.concatenate(ms), minlength=len(key))
        parts = np.where(c * 1024 > held.value.sum(), COMMON, RARE)
        mine = ((h >> np.uint64(32)).astype(np.int64) % parts == turn % parts)[key // wide]
        cls = best_moves(key[mine], m[mine], of, held.value)
        out = [row("known", chunk, rows[0]["bucket"], i8_planes(c[p]), cls[p].astype(np.uint8).tobytes()) for chunk, p in places.items()]
        return pa.table({k: pa.array([r[k] for r in out], x) for k, x in ARROW})

    return words.unionByName(seen).groupBy("bucket").applyInArrow(step, ROWS)


def best_moves(key: np.ndarray, m: np.ndarray, of: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Classes after each word with contexts went to the class that raises the likelihood most, all others staying.

    key: word * (2 classes + 1) + context, sorted; m: their counts; of: classes now; table: class bigrams now.

    What a context adds to a cell of the table is worth the same for all words with that context and count, unless it is the word's own
    class: so small counts go through a few matrix products, and only what is left is weighed cell by cell.
    """
    classes, out = len(table), of.copy()
    wide = 2 * classes + 1
    table = table.astype(np.float64)
    both, diagonal = np.concatenate([table, table.T]), np.diag(table)
    worth = {c: xlogx(both + c) - xlogx(both) for c in SMALL}
    word = key // wide
    firsts = np.flatnonzero(np.diff(word, prepend=-1))
    a = 0
    while a < len(firsts):
        z = max(a + 1, int(np.searchsorted(firsts, firsts[a] + WEIGHED)))
        start, stop = firsts[a], firsts[z] if z < len(firsts) else len(key)
        w, n = word[firsts[a:z]], z - a
        i = np.repeat(np.arange(n), np.diff(firsts[a:z], append=stop))
        x, count, k = key[start:stop] % wide, m[start:stop], of[w]
        seen = np.zeros((n, wide))
        seen[i, x] = count
        before, after, own = seen[:, :classes], seen[:, classes:-1], seen[:, -1]
        at = np.arange(n), k
        # Bigrams with other words' classes. The word is taken out of its own class first, so that class is reckoned apart.
        others = x != 2 * classes
        i, x, count = i[others], x[others], count[others]
        home = x % classes == k[i]
        small = ~home & (count <= SMALL[-1])
        gain = np.zeros((n, classes))
        for c in SMALL:
            of_count = np.zeros((n, 2 * classes))
            mine = small & (count == c)
            of_count[i[mine], x[mine]] = 1.0
            gain += of_count @ worth[c]
        rest = np.flatnonzero(~small)
        cell = both[x[rest]]
        near = np.flatnonzero(home[rest])
        cell[near] -= np.where((x[rest][near] < classes)[:, None], after[i[rest][near]], before[i[rest][near]])
        cell[near, k[i[rest][near]]] -= own[i[rest][near]]
        add_by_word(gain, i[rest], xlogx(cell + count[rest][:, None]) - xlogx(cell))
        stay = both[x, k[i]]
        at_home = np.flatnonzero(home)
        stay[at_home] -= np.where(x[at_home] < classes, after[i[at_home], k[i[at_home]]], before[i[at_home], k[i[at_home]]]) + own[i[at_home]]
        gain[at] = np.bincount(i, weights=xlogx(stay) - xlogx(stay - count), minlength=n)
        # The word's bigrams between its own places: only where it has both neighbours of a class, or itself.
        rows, cols = np.nonzero(((before > 0) & (after > 0)) | (own > 0)[:, None])
        d, l, r, o = diagonal[cols], before[rows, cols], after[rows, cols], own[rows]
        d = np.where(cols == k[rows], d - l - r - o, d)
        gain[rows, cols] += xlogx(d + l + r + o) - xlogx(d + l) - xlogx(d + r) + xlogx(d)
        for total, side in ((table.sum(axis=1), after), (table.sum(axis=0), before)):
            tokens = side.sum(axis=1) + own
            sizes, which = np.unique(tokens, return_inverse=True)
            gain[at] += (xlogx(total + sizes[:, None]) - xlogx(total))[which, k] - xlogx(total[k]) + xlogx(total[k] - tokens)
            gain -= (xlogx(total + sizes[:, None]) - xlogx(total))[which]
        best = gain.argmax(axis=1)
        out[w] = np.where(gain[np.arange(n), best] > gain[at] + 1e-5, best, k)
        a = z
    return out


def add_by_word(gain: np.ndarray, i: np.ndarray, x: np.ndarray) -> None:
    """Add rows of x to the rows i (sorted) of gain."""
    if len(i):
        firsts = np.flatnonzero(np.diff(i, prepend=-1))
        gain[i[firsts]] += np.add.reduceat(x, firsts, axis=0)


def likelihood(table: np.ndarray) -> float:
    """Log-likelihood of the training bigrams, but for what does not depend on the classes."""
    t = table.astype(np.float64)
    return float(xlogx(t).sum() - xlogx(t.sum(axis=1)).sum() - xlogx(t.sum(axis=0)).sum())


def settle(chunks: DataFrame, words: DataFrame, known: DataFrame, classes: int) -> DataFrame:
    """`known` rows, written, of the classes after sweeps over all words until one gains less than TOLERANCE."""
    conf = chunks.sparkSession.conf
    cleanup = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = conf.get(cleanup, None)

    def counted(known: DataFrame) -> tuple[DataFrame, DataFrame, np.ndarray]:
        seen = materialise(seen_rows(chunks, known, classes), "lm-seen")
        return known, seen, class_bigrams(seen.where("kind = 'bigrams'").select(F.col("a").alias("bigrams")), classes)

    # What a sweep has shuffled is of no use to the next one.
    conf.set(cleanup, "true")
    try:
        now = best = counted(materialise(known, "lm-known"))
        least, turn, before = TOLERANCE * now[2].sum(), 0, likelihood(now[2])
        while True:
            new = counted(materialise(move(words, now[1].where("kind = 'seen'"), now[2], turn), "lm-known"))
            release(now[1])
            turn += 1
            better = likelihood(new[2]) > likelihood(best[2])
            if better:
                release(best[0])
            if now is not best:
                release(now[0])
            now, best = new, new if better else best
            if turn % RARE == 0:
                level = likelihood(best[2])
                if turn >= COMMON and level - before <= least:
                    break
                before = level
        release(now[1])
        if now is not best:
            release(now[0])
    finally:
        conf.set(cleanup, was) if was is not None else conf.unset(cleanup)
    return best[0]


def i8_planes(x: np.ndarray) -> bytes:
    """Counts as two 32-bit halves in planes."""
    return planes(x & 0xFFFFFFFF) + planes(x >> 32)


def from_i8_planes(b: bytes) -> np.ndarray:
    half = len(b) // 2
    return from_planes(b[:half]).astype(np.int64) + (from_planes(b[half:]).astype(np.int64) << 32)


RESOLVED = "chunk long, ids binary, lengths binary, tokens binary, ends long, counts binary, classes binary, bigrams binary"


def resolve(chunks: DataFrame, known: DataFrame, classes: int) -> DataFrame:
    """Chunks with the training counts and classes of their words, and their class bigrams."""

    def join(own: pa.Table, dictionary: pa.Table) -> pa.Table:
        r = own.to_pylist()[0]
        parts = sorted(dictionary.to_pylist(), key=lambda x: x["bucket"])
        places = from_planes(r["places"])
        c = np.concatenate([from_i8_planes(x["a"]) for x in parts])[places]
        cls = np.concatenate([np.frombuffer(x["b"], np.uint8) for x in parts])[places].astype(np.int64)
        _, flags, lengths, tokens = docs_of(r)
        a, b = neighbours(lengths, tokens, r["ends"], flags % 2 == 0)
        bigrams = np.bincount(cls[a] * classes + cls[b], minlength=classes * classes)
        out = {k: r[k] for k in ("chunk", "ids", "lengths", "tokens", "ends")}
        out |= {"counts": i8_planes(c), "classes": cls.astype(np.uint8).tobytes(), "bigrams": i8(bigrams)}
        return pa.table({k: pa.array([v], pa.int64() if k in ("chunk", "ends") else pa.binary()) for k, v in out.items()})

    own = chunks.select("chunk", "ids", "lengths", "tokens", "places", "ends")
    both = own.groupBy("chunk").cogroup(known.select("chunk", "bucket", "a", "b").groupBy("chunk"))
    return materialise(both.applyInArrow(join, RESOLVED), "lm-resolved")


def class_bigrams(resolved: DataFrame, classes: int) -> np.ndarray:
    """Sums of the chunks' class bigrams, position by position; classes**2 numbers come to the driver."""
    cells = resolved.select("bigrams")

    def add(it: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        total = np.zeros(classes * classes, dtype=np.int64)
        for batch in it:
            for x in batch.column("bigrams").to_pylist():
                total += np.frombuffer(x, "<i8")
        at = np.flatnonzero(total)
        yield {"cell": at, "n": total[at]}

    summed = map_batches(cells, add, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(classes * classes, dtype=np.int64)
    for r in summed:
        out[r.cell] = r.n
    return out.reshape(classes, classes)


def score_chunk(r: dict, table: np.ndarray, n_train: int, n_words: int, mix: float) -> dict:
    """The documents' rows of one resolved chunk."""
    classes = len(table)
    c = from_i8_planes(r["counts"]).astype(np.float64)
    cls = np.frombuffer(r["classes"], np.uint8).astype(np.int64)
    ids, flags, lengths, tokens = docs_of(r)
    before, _ = neighbours(lengths, tokens, r["ends"], np.ones(len(lengths), dtype=bool))
    p0 = (c + 0.1) / (n_train + 0.1 * (n_words + 1))
    sizes = np.maximum(table.sum(axis=0), 1).astype(np.float64)
    within = c / sizes[cls]
    share = sizes / sizes.sum()
    known = c > 0
    move = (table + 5.0 * share[None, :]) / (table.sum(axis=1)[:, None] + 5.0)
    # An unseen word has no class of its own to go by: what follows it is expected as anywhere.
    after = np.where(known[before], cls[before], classes)
    move = np.concatenate([move, share[None, :]])
    p = mix * move[after, cls[tokens]] * within[tokens] + (1 - mix) * p0[tokens]
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
    add = lambda x: np.add.reduceat(x, starts)
    null = flags >= 2
    return {
        "doc_id": pa.array(ids, type=pa.int64(), mask=null), "held_out": flags % 2 == 1, "n_tokens": lengths,
        "n_known": add(known[tokens].astype(np.int64)), "train_tokens": np.full(len(ids), n_train),
        "base_score": add(np.log10(p0)[tokens]), "score": add(np.log10(p)),
    }


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def lm_scores(documents: DataFrame, classes: int = CLASSES, head: int = HEAD, mix: float = MIX, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: log10 probabilities of whole texts.

    Learns from all rows whose crc32(id as text) mod 10 is not 0.

    Defined cases: a null or empty text is its end alone; a null id counts as the empty text in the split;
    repeated ids are kept; an empty table gives no rows; with nothing to learn from, all words are unseen;
    other columns are not looked at.
    """
    size = documents.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()[0]
    buckets = max(8, math.ceil(size / PER_BUCKET))
    rows = encode(documents, buckets, id_col, text_col, chunk_bytes)
    words = word_rows(rows, buckets)
    n, v, top = totals(words, head)
    order = sorted(top, key=lambda x: x[0] & 0xFFFFFFFFFFFFFFFF)
    ids = np.array([x[0] for x in order], dtype=np.int64).view(np.uint64)
    counts = head_bigrams(rows, ids)
    by_count = np.array(sorted(range(len(order)), key=lambda i: (-order[i][1], i)), dtype=np.int64)
    classes = max(1, min(classes, len(order)))
    of = np.zeros(len(order), dtype=np.int64)
    if len(order):
        inner = counts[:-1, :-1][np.ix_(by_count, by_count)].astype(np.float64)
        of[by_count] = exchange(inner, classes)
    one = np.eye(classes)[of] if len(order) else np.zeros((0, classes))
    table = one.T @ counts[:-1, :-1] @ one if len(order) else np.zeros((classes, classes))
    contexts = context_rows(rows, ids, of, classes, buckets)
    known = settle(rows, words, assign(words, contexts, (ids, of), table), classes)
    resolved = resolve(rows, known, classes)
    release(known)
    held = documents.sparkSession.sparkContext.broadcast(class_bigrams(resolved, classes))
    release(rows)

    def score(it: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in it:
            for r in batch.to_pylist():
                yield score_chunk(r, held.value, n, v, mix)

    return map_batches(resolved.drop("bigrams"), score, SCORES)
