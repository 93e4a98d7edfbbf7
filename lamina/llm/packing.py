"""Packing token sequences by non-negative least squares over a histogram of lengths.

Documents give whole windows of their own first; what is left of each (its tail, below one window) goes
into a histogram with one bin a length. Shallow combinations of lengths that fill a window exactly are
enumerated; repeat counts that explain the histogram best are solved for by non-negative least squares,
rounded and held to what is there. Tails beyond the plan are packed greedily: laid end to end and cut
at window borders, the last part at powers of two, so no sequence needs padding.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import map_batches, materialise, small_enough

WINDOW, END = 2048, 1
#: Most parts of a combination, and how many of the commonest lengths are tried for triples.
DEPTH, COMMON = 8, 48
#: Pieces of text that a worker remembers the ids of, and their signs; the largest broadcast table of rank offsets.
REMEMBERED, SIGNS, OFFSETS = 200_000, 64, 250_000

# Fixed value: how the vocabulary's pre-tokenizer cuts text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def default_tokenizer() -> str:
    """Path of the public vocabulary, looked up where it is used."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_of_sign() -> dict[str, int]:
    """The byte behind each sign of a byte-level vocabulary: printable Latin-1 stands for itself, the other
    bytes follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def plain_byte_level(data: dict) -> bool:
    """Whether a tokenizer file says no more than encoder() follows: byte-level pieces cut by PATTERN, and merges in the order
    of their tokens' ids over the 256 bytes."""
    model, pre, added = data["model"], data.get("pre_tokenizer") or {}, data.get("added_tokens") or []
    cut = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
    merges = [m.split(" ", 1) if isinstance(m, str) else m for m in model.get("merges") or []]
    vocab = {t: i for t, i in model["vocab"].items() if t not in {a["content"] for a in added}}
    made = [vocab.get("".join(m), -1) for m in merges]
    return (
        model.get("type", "BPE") == "BPE"
        and not any(data.get(k) for k in ("normalizer", "truncation", "padding"))
        and {k: pre.get(k) for k in cut} == cut
        and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        and not any(a.get(k) for a in added for k in ("single_word", "lstrip", "rstrip", "normalized"))
        and sorted(made) == made
        and set(vocab) == set(byte_of_sign()) | {"".join(m) for m in merges}
        and len(vocab) == 256 + len(merges)
        and max((vocab[s] for s in byte_of_sign()), default=0) < min(made, default=1 << 31)
    )


@lru_cache(maxsize=2)
def encoder(path: str) -> Callable[[str], bytes]:
    """text -> ids as little-endian unsigned 32-bit numbers, equal to the tokenizers library's.

    The vocabulary's merges are applied by rank. A space before a sign that is no white space always
    starts a token, so text is cut there and pieces seen before are looked up. Texts with other
    spacing are encoded whole; texts with a special token's string by the tokenizers library itself, and so are all texts
    if the file is not plain_byte_level().
    """
    import tiktoken
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    if not plain_byte_level(data):
        whole_library = Tokenizer.from_file(path)
        return lambda text: np.array(whole_library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
    special = [t["content"] for t in data["added_tokens"]]
    sign = byte_of_sign()
    ranks = {bytes(sign[c] for c in token): i for token, i in data["model"]["vocab"].items() if token not in special}
    bpe = tiktoken.Encoding("pieces", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    whole = bpe.encode_ordinary
    widths = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
    for token, i in ranks.items():
        widths[i] = len(token)
    known: dict[str, bytes] = {}
    library: list = []
    spaced = re.compile(r" (?=\s|\Z)")

    def pieces(new: list[str], start: str) -> list[bytes]:
        """Ids of each piece, from one call for all of them: pieces start tokens, so their ends are ends of tokens."""
        text = start + " ".join(new)
        got = np.array(whole(text), dtype="<u4")
        widths_ = map(len, new) if text.isascii() else (len(p.encode()) for p in new)
        ends = np.cumsum(np.fromiter(widths_, np.int64, len(new)) + 1) - (1 - len(start))
        cuts = (4 * (np.searchsorted(np.cumsum(widths[got]), ends) + 1)).tolist()
        b = got.tobytes()
        return [b[a:z] for a, z in zip([0, *cuts], cuts, strict=False)]

    def encode(text: str) -> bytes:
        if any(s in text for s in special):
            if not library:
                library.append(Tokenizer.from_file(path))
            return np.array(library[0].encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        if spaced.search(text) or not text:
            return np.array(whole(text), dtype="<u4").tobytes()
        first, *rest = text.split(" ")
        out = list(map(known.get, rest))
        at = [i for i, b in enumerate(out) if b is None]
        new = [rest[i] for i in at]
        if not first:
            head, found = b"", pieces(new, " ") if new else []
        else:
            head, *found = pieces([first, *new], "")
        for i, b in zip(at, found, strict=True):
            out[i] = b
        if len(known) < REMEMBERED:
            known.update((p, b) for p, b in zip(new, found, strict=True) if len(p) <= SIGNS)
        return head + b"".join(out)

    return encode


ENCODED = "doc_id long, part long, rank long, n long, first_sequence long, crcs array<long>, tail int, tail_crc long, tail_ids binary"


def encode_documents(documents: DataFrame, tokenizer: str | None, window: int, id_col: str, text_col: str) -> DataFrame:
    """Documents as ids, written once: whole windows as checksums, the tail with its ids.

    rank numbers the tails of one length within a part (a task of this pass); the written table fixes both.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        encode = encoder(tokenizer or default_tokenizer())
        end = np.array([END], dtype="<u4").tobytes()
        part = TaskContext.get().partitionId()
        seen: Counter = Counter()
        sequences = 0
        for batch in it:
            text = batch.column("text")
            out: dict = {k: [] for k in ("rank", "n", "first_sequence", "crcs", "tail", "tail_crc", "tail_ids")}
            for i in range(batch.num_rows):
                b = encode(text[i].as_py() or "") + end
                n = len(b) // 4
                full = n // window
                view = memoryview(b)
                tail = n - full * window
                out["rank"].append(seen[tail])
                seen[tail] += 1
                out["n"].append(n)
                out["first_sequence"].append(((part + 1) << 40) + sequences)
                sequences += full
                out["crcs"].append([zlib.crc32(view[4 * window * k : 4 * window * (k + 1)]) for k in range(full)])
                out["tail"].append(tail)
                out["tail_crc"].append(zlib.crc32(view[4 * window * full :]))
                out["tail_ids"].append(b[4 * window * full :])
            yield out | {"doc_id": batch.column("doc_id"), "part": [part] * batch.num_rows}

    own = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return materialise(map_batches(own, run, ENCODED), "packing-encoded")


def combinations(histogram: dict[int, int], window: int = WINDOW, depth: int = DEPTH, common: int = COMMON) -> list[tuple[int, ...]]:
    """Shallow multisets of present lengths with the sum `window`."""
    have = {n for n, c in histogram.items() if c > 0 and 0 < n < window}
    out: set[tuple[int, ...]] = set()
    for a in have:
        for m in range(1, min(depth, window // a) + 1):
            b = window - m * a
            if b == 0 and m <= depth:
                out.add((a,) * m)
            elif b in have and m < depth:
                out.add(tuple(sorted((a,) * m + (b,))))
    top = sorted(have, key=lambda n: (-histogram[n], n))[:common]
    for i, a in enumerate(top):
        for b in top[i:]:
            c = window - a - b
            if c in have:
                out.add(tuple(sorted((a, b, c))))
    return sorted(out)


def solve(columns: list[tuple[int, ...]], histogram: dict[int, int], sweeps: int = 40) -> np.ndarray:
    """x >= 0 minimising |A x - h|^2, A's columns the combinations' counts of lengths: coordinate descent."""
    counts = [tuple(Counter(c).items()) for c in columns]
    norm = [sum(m * m for _, m in c) for c in counts]
    rest = {n: float(h) for n, h in histogram.items()}
    x = [0.0] * len(columns)
    for _ in range(sweeps):
        moved = 0.0
        for j, c in enumerate(counts):
            step = sum(m * rest[n] for n, m in c) / norm[j]
            step = max(step, -x[j])
            if step:
                x[j] += step
                moved = max(moved, abs(step))
                for n, m in c:
                    rest[n] -= m * step
        if moved < 0.05:
            break
    return np.array(x)


@dataclass(frozen=True)
class Plan:
    """For each length, slots: ranks from starts[i] on, counts[i] of them, lie at offsets[i] of sequences from
    sequences[i] on. Ranks from used on are laid end to end from the place `line` on."""

    slots: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    used: dict[int, int]
    line: dict[int, int]
    first_line_sequence: int
    line_tokens: int


def make_plan(histogram: dict[int, int], window: int = WINDOW) -> Plan:
    columns = combinations(histogram, window)
    x = solve(columns, histogram)
    used = {n: 0 for n in histogram}
    slots: dict[int, list] = {n: [] for n in histogram}
    sequence = 0
    for j in sorted(range(len(columns)), key=lambda j: (-x[j], columns[j])):
        need = Counter(columns[j])
        times = min(round(x[j]), *((histogram[n] - used[n]) // m for n, m in need.items()))
        if times <= 0:
            continue
        offset = 0
        for n in columns[j]:
            slots[n].append((used[n], times, sequence, offset))
            used[n] += times
            offset += n
        sequence += times
    line, at = {}, 0
    for n in sorted(histogram, reverse=True):
        line[n] = at
        at += n * (histogram[n] - used[n])
    arrays = {n: tuple(np.array(c, dtype=np.int64) for c in zip(*s, strict=True)) for n, s in slots.items() if s}
    return Plan(arrays, used, line, sequence, at)


def line_pieces(plan: Plan, start: int, length: int, window: int) -> Iterator[tuple[int, int, int, int]]:
    """(start in the piece, length, sequence, offset) of tokens start.. of the line of tails.

    Borders are at every window; the last, shorter part is cut into powers of two.
    """
    whole = plan.line_tokens // window * window
    done = 0
    while done < length:
        at = start + done
        if at < whole:
            sequence, offset, room = at // window, at % window, window - at % window
        else:
            rest, sequence, base = plan.line_tokens - whole, whole // window, whole
            size = 1 << (rest.bit_length() - 1)
            while at >= base + size:
                base, rest, sequence = base + size, rest - size, sequence + 1
                size = 1 << (rest.bit_length() - 1)
            offset, room = at - base, base + size - at
        n = min(length - done, room)
        yield done, n, plan.first_line_sequence + sequence, offset
        done += n


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(documents: DataFrame, tokenizer: str | None = None, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: one row a piece.

    tokenizer is the path of a vocabulary file that every executor has; by default the public one.

    Defined cases: a null or empty text is the end id alone; null and repeated ids are kept, each row a
    document of its own; an empty table gives no rows; other columns are not looked at.
    """
    encoded = encode_documents(documents, tokenizer, window, id_col, text_col)
    counts = encoded.where(F.col("tail") > 0).groupBy("part", "tail").agg(F.count("*").alias("n_tails"))
    histogram = {r["tail"]: r["n"] for r in counts.groupBy("tail").agg(F.sum("n_tails").alias("n")).collect()}  # one row a length below the window
    held = documents.sparkSession.sparkContext.broadcast(make_plan(histogram, window))
    before = W.partitionBy("tail").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("part", "tail", F.coalesce(F.sum("n_tails").over(before), F.lit(0)).alias("before"))
    ranked = encoded.join(F.broadcast(offsets) if small_enough(offsets, OFFSETS) else offsets, ["part", "tail"], "left")

    def place(it: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        plan = held.value
        names = [x.strip().split()[0] for x in PIECES.split(",")]
        for batch in it:
            rows: list[tuple] = []
            cols = [batch.column(c).to_pylist() for c in ("doc_id", "n", "first_sequence", "crcs", "tail", "tail_crc", "rank", "before")]
            ids = batch.column("tail_ids")
            for i, (doc, n, first, crcs, tail, tail_crc, rank, base) in enumerate(zip(*cols, strict=True)):
                for k, crc in enumerate(crcs):
                    rows.append((doc, k * window, window, crc, n, first + k, 0))
                if not tail:
                    continue
                start, r = n - tail, rank + base
                if r < plan.used[tail]:
                    starts, _, sequences, places = plan.slots[tail]
                    s = int(np.searchsorted(starts, r, side="right")) - 1
                    rows.append((doc, start, tail, tail_crc, n, int(sequences[s] + r - starts[s]), int(places[s])))
                    continue
                at = plan.line[tail] + (r - plan.used[tail]) * tail
                for done, length, sequence, offset in line_pieces(plan, at, tail, window):
                    crc = tail_crc if length == tail else zlib.crc32(memoryview(ids[i].as_py())[4 * done : 4 * (done + length)])
                    rows.append((doc, start + done, length, crc, n, sequence, offset))
            yield dict(zip(names, ([list(c) for c in zip(*rows, strict=True)] or [[]] * len(names)), strict=True))

    return map_batches(ranked, place, PIECES)
