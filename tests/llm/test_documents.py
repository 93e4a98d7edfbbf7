"""The operators on documents against brute force, round trips and held-out accuracy."""

import heapq
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from lamina.llm import brown, licenses, mixing, packing, quality, sharding, simhash, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, row string, rank int, shard string"
LABELS = "doc_id long, quality int, toxic int"


def docs(spark, rows):
    """(doc_id, text[, source]) with further columns whose names clash with results'."""
    return spark.createDataFrame([(r[0], r[1], "en", r[2] if len(r) > 2 else "s", 1, "x", "y", 3, "z") for r in rows], SCHEMA)


EDGES = [(1, None), (2, ""), (3, " \n\t "), (None, "null id"), (None, "null id"), (4, "same text"), (5, "same text"), (6, "same text"), (7, "word " * 3000), (7, "again id 7"), (8, "ÄÖ ünï 世界 MIT License")]


def words(n, seed, vocabulary=400):
    rng = random.Random(seed)
    return " ".join(f"w{min(rng.randrange(vocabulary), rng.randrange(vocabulary))}" for _ in range(n))


# Sharding


def plain_lpt(sizes, shards):
    """Loads after each size, largest first, went to the least-loaded shard."""
    heap = [(0, s) for s in range(shards)]
    for size in sorted(sizes, reverse=True):
        load, k = heap[0]
        heapq.heapreplace(heap, (load + size, k))
    return sorted(load for load, _ in heap)


def test_schedule_is_longest_first():
    rng = random.Random(4)
    for _ in range(60):
        shards = rng.randrange(1, 9)
        sizes = [rng.choice([8, 9, 40, rng.randrange(8, 400)]) for _ in range(rng.randrange(900))]
        got = sharding.schedule(Counter(sizes).items(), shards)
        assert {k: int(v.sum()) for k, v in got.items()} == Counter(sizes)
        assert sorted(sum(int(v[i]) * k for k, v in got.items()) for i in range(shards)) == plain_lpt(sizes, shards)


def test_levels_do_what_the_heap_does():
    rng = np.random.default_rng(1)
    for _ in range(500):
        loads, size, n = rng.integers(0, 200, rng.integers(1, 9)), int(rng.integers(1, 40)), int(rng.integers(0, 300))
        assert (sharding.by_heap(loads, size, n) == sharding.by_level(loads, size, n)).all()


def test_shards(spark):
    rows = [(i, words(5 + i % 40, i)) for i in range(2000)] + [(10_000 + i, "hot copy") for i in range(700)] + EDGES
    got = sharding.lpt_shards(docs(spark, rows).repartition(5)).collect()
    assert len(got) == len(rows) and {r.law for r in got} == {"bytes"} and all(r.grown_shard is None for r in got)
    load, slots, text_of = Counter(), {}, {}
    for i, t, *_ in rows:
        text_of.setdefault(i, []).append(t)
    for r in got:
        load[r.shard] += r.size
        slots.setdefault(r.shard, []).append(r.slot)
        assert any(r.size == len((t or "").encode()) + 8 and r.text_crc32 == (None if t is None else zlib.crc32(t.encode())) for t in text_of[r.doc_id])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and set(load) <= set(range(24))
    groups = Counter((t, len((t or "").encode()) + 8) for _, t, *_ in rows)
    assert sorted([*load.values(), *[0] * (24 - len(load))]) == plain_lpt([n * size for (_, size), n in groups.items()], 24)
    shard_of = {}
    for r in got:
        assert shard_of.setdefault((r.text_crc32, r.size), r.shard) == r.shard
    assert sharding.lpt_shards(docs(spark, [])).count() == 0


# Licenses


def brute_scan(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    found = []
    for phrase, label in licenses.BASE:
        p = phrase.split()
        found += [(i, label) for i in range(len(w)) if w[i : i + len(p)] == p]
    at = [i for i, _ in found]
    return len(w), len(found), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found}))


def test_base_phrases_against_brute_force(spark):
    rng = random.Random(5)
    bits = ["MIT", "license", "License", "apache", "general", "public", "mit license", "é", "-", "\n", "x1", "ß", "Apache\tLicense", "mit-license", "MITlicense", "[", "{", "世"]
    rows = [(i, rng.choice([" ", "", "_"]).join(rng.choice(bits) for _ in range(rng.randrange(40)))) for i in range(300)] + EDGES
    got = licenses.license_scan(docs(spark, rows)).collect()
    assert sorted(str(x[:6]) for x in ((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got)) == sorted(str((i, *brute_scan(t))) for i, t in rows)


def test_fuzzy_notices_keep_their_promise():
    """Any notice changed in up to the allowed characters is found, wherever it stands."""
    rng = random.Random(9)
    for n in licenses.compiled():
        for edits in range(n.edits + 1):
            b = bytearray(n.text)
            for _ in range(edits):
                at = rng.randrange(1, len(b) - 1)
                kind = rng.randrange(3)
                if kind == 0:
                    b[at] = ord("q")
                elif kind == 1:
                    del b[at]
                else:
                    b.insert(at, ord("z"))
            spans = licenses.fuzzy_spans(b" some words before " + bytes(b) + b" and after ", n)
            assert spans and min(e for *_, e in spans) <= edits, (n, edits, bytes(b))
    assert licenses.scan_text(b"permision is herby granted, free of charge, to any person obtaning a copy")["labels"] == "mit"
    assert licenses.scan_text(b"plain words about a license to drive")["labels"] == ""


def test_a_better_notice_hides_no_earlier_one():
    n = next(n for n in licenses.compiled() if n.label == "lgpl")
    text = b" gnu leser general public license and gnu lesser general public license or gnu lesser genral public license "
    assert [(text[a:z].strip(), e) for a, z, e in licenses.fuzzy_spans(text, n)] == [
        (b"gnu leser general public license", 1), (b"gnu lesser general public license", 0), (b"gnu lesser genral public license", 1),
    ]


def edits_between(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_spans_against_an_edit_distance_scan():
    """Each span is within the edits it names, spans keep apart, and every stretch within the allowed edits meets one."""
    n = next(n for n in licenses.compiled() if n.label == "lgpl")
    rng = random.Random(21)
    for _ in range(12):
        parts = []
        for _ in range(rng.randrange(1, 4)):
            b = bytearray(n.text)
            for _ in range(rng.randrange(5)):
                at = rng.randrange(len(b))
                b[at : at + rng.randrange(2)] = rng.choice([b"", b"q", b" "])
            parts += [bytes(b), rng.choice([b"", b"and", b"gnu lesser", b"public license or"])]
        text = b" " + b" ".join(b" ".join(parts).split()) + b" "
        spans = licenses.fuzzy_spans(text, n)
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False))
        for a, z, e in spans:
            assert edits_between(text[a:z], n.text) <= e <= n.edits
        size, k = len(n.text), n.edits
        for a in range(len(text)):
            for z in range(a + size - k, min(len(text), a + size + k) + 1):
                if not any(x < z and a < y for x, y, _ in spans):
                    assert edits_between(text[a:z], n.text) > k, (text, spans, a, z)


def test_long_texts_take_time_in_proportion():
    import time

    notice = b"relesed under the mit licence and apache license "
    took = []
    for n in (400, 4000):
        began = time.perf_counter()
        got = licenses.scan_text(notice * n)
        took.append(time.perf_counter() - began)
        assert len(got["spans"]) == n == got["n_base"]
    assert took[1] < 40 * took[0]


def test_another_licence_is_not_the_mit_licence():
    for other in ("bsd", "gpl", "isc", "mpl", "zlib"):
        got = licenses.scan_text(f"released under the {other} license".encode())
        assert got["labels"] == "" and got["score"] == 0, other
    assert licenses.scan_text(b"relesed under the mitt license")["labels"] == "mit"
    assert [e for _, _, _, e in licenses.scan_text(b"released under the isc license released under the mit licence")["spans"]] == [1]


def test_scan_of_nothing(spark):
    assert licenses.license_scan(docs(spark, [])).count() == 0


# Packing


def test_ids_equal_the_library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_tokenizer())
    enc = packing.encoder(packing.default_tokenizer())
    rng = random.Random(2)
    signs = "ab 1.'\n\t é 　\x85\x1c日🙂!|sS"
    texts = ["", " ", "  a", "a ", "<|endoftext|> x <|endoftext|>", "it's 'tis", words(300, 1)] + ["".join(rng.choice(signs) for _ in range(rng.randrange(25))) for _ in range(1500)]
    for x in texts:
        assert np.frombuffer(enc(x), "<u4").tolist() == t.encode(x, add_special_tokens=False).ids, x


@pytest.mark.parametrize("window", [64, 2048])
def test_pieces_are_a_round_trip(spark, window):
    rows = [(i, words(3 + (i * 37) % 400, i)) for i in range(300)] + [(900 + i, "same length copy of text") for i in range(150)] + EDGES
    enc = packing.encoder(packing.default_tokenizer())
    got = packing.pack(docs(spark, rows).repartition(6), window=window).collect()
    want = Counter()
    for i, t in rows:
        want[i, len(enc(t or "")) // 4 + 1] += 1
    by_doc, by_seq = {}, {}
    for r in got:
        by_doc.setdefault((r.doc_id, r.doc_tokens), []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(want)
    texts = {}
    for i, t in rows:
        texts.setdefault((i, len(enc(t or "")) // 4 + 1), []).append(enc(t or "") + np.array([1], "<u4").tobytes())
    for k, pieces in by_doc.items():
        assert sum(p.length for p in pieces) == k[1] * want[k]
        if want[k] == 1:
            b, at = texts[k][0], 0
            for p in sorted(pieces, key=lambda p: p.start):
                assert p.start == at and p.ids_crc32 == zlib.crc32(b[4 * at : 4 * (at + p.length)])
                at += p.length
    padding = 0
    for s in by_seq.values():
        at = 0
        for p in sorted(s, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    assert padding == 0


def test_plan_uses_combinations():
    rng = random.Random(4)
    h = Counter(rng.randrange(1, 2048) for _ in range(60_000))
    plan = packing.make_plan(dict(h))
    assert sum(plan.used.values()) > 0.7 * sum(h.values())
    used = {n: sum(int(c) for c in s[1]) for n, s in plan.slots.items()}
    assert all(used.get(n, 0) == u <= h[n] for n, u in plan.used.items())
    assert all(sum(c) in (2048,) or (len(c) == 1 and c[0] & (c[0] - 1) == 0) for c in packing.combinations(dict(h)))
    a = packing.solve([(1, 2), (2, 2), (1,)], {1: 10, 2: 30})
    assert (a >= 0).all() and abs(a[0] + a[2] - 10) < 0.2 and abs(a[0] + 2 * a[1] - 30) < 0.2


def test_powers_of_two_are_packed_too(spark):
    """Copies of a length that is a power of two fill windows, and only the last remainder is cut."""
    got = packing.pack(docs(spark, [(i, None) for i in range(1000)]), window=64).collect()
    full = Counter(r.sequence_id for r in got)
    assert len(got) == 1000 and sum(n == 64 for n in full.values()) == 15 and len(full) <= 18


def test_packing_nothing(spark):
    assert packing.pack(docs(spark, [])).count() == 0


# Mixing


def brute_targets(sizes, weights=(1, 2, 3)):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, free, out = sum(sizes.values()), set(names), {}
    while free:
        level = (total - sum(out.values())) / sum(w[s] for s in free)
        over = [s for s in free if w[s] * level > 3 * sizes[s]]
        if not over:
            return out | {s: w[s] * level for s in free}
        for s in over:
            out[s] = 3 * sizes[s]
            free.discard(s)
    return out


def test_mix_against_brute_force(spark):
    rng = random.Random(8)
    rows = [(i, words(rng.randrange(60), i), rng.choice(["a", "a", "a", "a", "a", "b", "ü", None, "tiny"] if i % 50 else ["tiny"])) for i in range(3000)] + [(9000, None, "none"), (9001, "", "none"), (None, "a b", "b")]
    got = mixing.mix_plan(docs(spark, rows)).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += size(t)
    want = brute_targets(dict(sizes))
    source = {i: s for i, _, s in rows}
    taken, n = Counter(), Counter()
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and math.isclose(r.target, want[s], rel_tol=1e-9, abs_tol=1e-9)
        rate = want[s] / sizes[s] if sizes[s] else 0
        assert r.copies in (math.floor(rate + 1e-9), math.ceil(rate - 1e-9)) and r.taken == r.copies * r.size <= 3 * r.size
        taken[s] += r.taken
        n[s] += 1
    assert len(got) == len(rows) and math.isclose(sum(want.values()), sum(sizes.values()))
    for s, t in want.items():
        assert abs(taken[s] - t) <= 0.15 * t + 60
    again = mixing.mix_plan(docs(spark, rows).repartition(9)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    assert mixing.mix_plan(docs(spark, [])).count() == 0


def test_mix_emits_whole_rows(spark):
    d = docs(spark, [(i, words(9, i), "ab"[i % 2]) for i in range(200)])
    plan = {r.doc_id: r.copies for r in mixing.mix_plan(d).collect()}
    out = mixing.mix(d)
    assert out.columns == d.columns and Counter(r.doc_id for r in out.collect()) == Counter({k: v for k, v in plan.items() if v})


# SimHash


def brute_fingerprint(text, k=3):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    hs = [xxhash.xxh64_intdigest(b" ".join(w[i : i + k]), 42) for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(11)
    rows = []
    for g in range(40):
        base = words(120, g).split()
        for c in range(6):
            w = list(base)
            for _ in range(c % 4):
                w[rng.randrange(len(w))] = "changed"
            rows.append((1000 - len(rows), " ".join(w)))
    rows += EDGES
    got = simhash.near_duplicates(docs(spark, rows).repartition(5)).collect()
    fps = [brute_fingerprint(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                parent[root(i)] = root(j)
    least: dict = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    want = sorted(str((d, f"{fps[i]:016x}", least.get(root(i)))) for i, (d, _) in enumerate(rows))
    assert sorted(str((r.doc_id, r.fingerprint, r.component_id)) for r in got) == want
    assert simhash.near_duplicates(docs(spark, [])).count() == 0


def test_links_connect_exactly_what_three_bits_connect(spark):
    """Planted fingerprints at distances one to four, chains and dense balls."""
    rng = random.Random(12)
    fps = set()
    for _ in range(30):
        x = rng.getrandbits(64)
        fps.add(x)
        for _ in range(8):
            for b in rng.sample(range(64), rng.randrange(1, 5)):
                x ^= 1 << b
            fps.add(x)
    fps |= {rng.getrandbits(64) for _ in range(300)}
    fps = sorted(fps)
    signed = [simhash.signed(x) for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp long").repartition(6)
    labels = {r.node: r.label for r in simhash.components(simhash.links(simhash.possible(df))).collect()}
    parent = {x: x for x in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, x in enumerate(fps):
        for y in fps[:i]:
            if (x ^ y).bit_count() <= 3:
                a, b = root(x), root(y)
                parent[max(a, b)] = min(a, b)
    groups: dict = {}
    for x in fps:
        groups.setdefault(root(x), set()).add(simhash.signed(x))
    got: dict = {}
    for x in signed:
        got.setdefault(labels.get(x, x), set()).add(x)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, groups.values()))


def test_one_of_each_group_stays(spark):
    d = docs(spark, [*EDGES, (20, words(80, 1)), (21, words(80, 1))])
    kept = simhash.drop_near_duplicates(d)
    prints = {r.fingerprint for r in simhash.near_duplicates(d).collect()}
    assert kept.columns == d.columns and len(kept.collect()) == len(prints)  # no two of these texts are near each other
    assert simhash.drop_near_duplicates(docs(spark, [])).count() == 0


def test_groups_without_an_id_keep_a_document_each(spark):
    a, b, c = (words(80, i) for i in (1, 2, 3))
    rows = [(None, a, "p", "q"), (None, a, "p", "q"), (None, b, "p", None), (None, c, None, "q"), (3, c, "p", "q"), (4, None, "p", "q"), (None, "", "p", "q"), (None, None, None, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, kept_id string, place string").repartition(3)
    kept = simhash.drop_near_duplicates(d)
    assert kept.columns == d.columns
    assert sorted(map(str, map(tuple, kept.collect()))) == sorted(map(str, [(None, a, "p", "q"), (None, b, "p", None), (3, c, "p", "q"), (4, None, "p", "q")]))


def test_a_repeated_id_takes_no_other_document_along(spark):
    a, b = (words(80, i) for i in (1, 2))
    kept = simhash.drop_near_duplicates(docs(spark, [(1, a), (1, b), (2, a), (3, b), (4, b), (5, a)])).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == sorted([(1, a), (1, b)])
    kept = simhash.drop_near_duplicates(docs(spark, [(1, a), (1, b), (2, words(80, 3))])).collect()
    assert len(kept) == 3


def test_columns_of_any_name_pass_through(spark):
    d = spark.createDataFrame([(1, words(80, 1), "s", 2, 3), (2, words(80, 1), "s", 2, 3)], "doc_id long, text string, source string, `a`` b` int, `row.x` int")
    labels = spark.createDataFrame([(1, 1, 0)], LABELS)
    for out in (simhash.drop_near_duplicates(d), mixing.mix(d), quality.keep_good(d, labels, path_col="source")):
        assert out.columns == d.columns and {r[3:] for r in out.collect()} <= {(2, 3)}


def test_long_chain_of_labels(spark):
    n = 70
    e = spark.createDataFrame([(i, i + 1) for i in range(n)], "a long, b long").repartition(5)
    assert {(r.node, r.label) for r in simhash.components(e).collect()} == {(i, 0) for i in range(n + 1)}


# Language model


def test_language_model(spark):
    rows = [(i, words(60, i, 60)) for i in range(300)] + EDGES
    got = brown.lm_scores(docs(spark, rows).repartition(4), chunk_bytes=4000).collect()
    tok = lambda t: [*(w for w in (t or "").encode().lower().split()), b"\n"]
    held = lambda d: zlib.crc32(b"" if d is None else str(d).encode()) % 10 == 0
    c = Counter(w for d, t in rows if not held(d) for w in tok(t))
    n, v = sum(c.values()), len(c)
    want = sorted((str(d), held(d), len(tok(t)), sum(c[w] > 0 for w in tok(t)), n, round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tok(t)), 6)) for d, t in rows)
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert brown.lm_scores(docs(spark, [])).count() == 0
    whole = brown.lm_scores(docs(spark, rows).coalesce(1)).collect()
    assert sorted((str(r.doc_id), round(r.score, 6)) for r in whole) == sorted((str(r.doc_id), round(r.score, 6)) for r in got)


def test_scores_by_hand():
    """score_chunk against the formula, word by word; and what it gives is a distribution over the words."""
    texts = [b"a b a", b"b c", b"a zzz c", b""]
    vocabulary = [b"a", b"b", b"c", brown.END]
    count, cls = {b"a": 5, b"b": 3, b"c": 1, brown.END: 4}, {b"a": 0, b"b": 1, b"c": 1, brown.END: 2}
    table = np.array([[1, 3, 1], [2, 0, 2], [2, 1, 1]])
    n, v, mix = 13, 4, 0.8
    chunk = brown.chunk_row(0, list(enumerate(texts, 1)), 1)
    words_ = [w for w in (b"a", b"b", b"c", b"zzz", brown.END)]
    by_hash = {xxhash.xxh64_intdigest(w): w for w in words_}
    order = [by_hash[int(h)] for h in np.frombuffer(chunk["hashes"], "<u8")]
    chunk |= {"counts": brown.i8_planes(np.array([count.get(w, 0) for w in order])), "classes": bytes(cls.get(w, 0) for w in order)}
    share = table.sum(axis=0) / table.sum()

    def p(w, before):
        p0 = (count.get(w, 0) + 0.1) / (n + 0.1 * (v + 1))
        move = (table[cls[before]] + 5 * share) / (table[cls[before]].sum() + 5) if before in cls else share
        within = count[w] / max(1, table[:, cls[w]].sum()) if w in count else 0.0
        return mix * (move[cls[w]] if w in cls else 0.0) * within + (1 - mix) * p0

    got = brown.score_chunk(chunk, table, n, v, mix)
    for i, t in enumerate(texts):
        seq = [*t.split(), brown.END]
        assert math.isclose(got["score"][i], sum(math.log10(p(w, b)) for b, w in zip([brown.END, *seq], seq, strict=False)), rel_tol=1e-9)
    # Where every class' words make up its column of bigrams, all words and one unseen word share the whole.
    table = np.array([[1, 2, 2], [2, 0, 2], [2, 2, 0]])
    share = table.sum(axis=0) / table.sum()
    for before in (*vocabulary, b"zzz"):
        assert math.isclose(sum(p(w, before) for w in (*vocabulary, b"zzz")), 1.0, rel_tol=1e-12), before


def test_class_model_learns_order(spark):
    """Words of alternating kinds: classes tell which kind is next, and the model is a distribution."""
    rng = random.Random(1)
    rows = [(i, " ".join(f"{'ab'[j % 2]}{rng.randrange(30)}" for j in range(80))) for i in range(400)]
    got = brown.lm_scores(docs(spark, rows), classes=4).collect()
    h = [r for r in got if r.held_out]
    assert sum(r.score for r in h) > sum(r.base_score for r in h) + 0.15 * sum(r.n_tokens for r in h)


def test_moves_are_the_best_by_brute_force():
    """Each word's move, the others staying, is the one of largest likelihood."""
    rng = np.random.default_rng(7)
    counts, of, classes = rng.poisson(0.4, (40, 40)), rng.integers(0, 5, 40), 5
    summed = lambda cls: np.array([[counts[np.ix_(cls == a, cls == b)].sum() for b in range(classes)] for a in range(classes)])
    bag: Counter = Counter()
    for a, b in zip(*np.nonzero(counts), strict=True):
        n = int(counts[a, b])
        if a == b:
            bag[a * 11 + 10] += n
        else:
            bag[b * 11 + of[a]] += n
            bag[a * 11 + 5 + of[b]] += n
    key = np.array(sorted(bag))
    got = brown.best_moves(key, np.array([bag[k] for k in key], dtype=float), of, summed(of))
    for w in range(40):
        gain = []
        for c in range(classes):
            cls = of.copy()
            cls[w] = c
            gain.append(brown.likelihood(summed(cls)))
        assert gain[got[w]] > max(gain) - 1e-4


def test_exchange_separates_kinds():
    m = np.zeros((20, 20))
    m[0::2, 1::2] = 5
    m[1::2, 0::2] = 5
    of = brown.exchange(m, 2)
    assert len(set(of[0::2])) == 1 and len(set(of[1::2])) == 1 and of[0] != of[1]


# Toxicity and quality


def test_segments_against_all_pairs():
    """Every maximal segment found greedily: the best one, then the best on either side of it."""

    def greedy(x, base=0):
        best = max(((sum(x[a:z]), -(z - a), -a, a, z) for a in range(len(x)) for z in range(a + 1, len(x) + 1)), default=None)
        if best is None or best[0] <= 0:
            return []
        s, _, _, a, z = best
        return greedy(x[:a], base) + [(base + a, base + z, s)] + greedy(x[z:], base + z)

    rng = random.Random(3)
    for _ in range(300):
        x = [rng.choice([-3, -2, -1, 1, 2, 4]) + rng.random() / 1000 for _ in range(rng.randrange(12))]
        got = toxicity.segments(np.array(x))
        assert [(a, z, round(s, 6)) for a, z, s in got] == [(a, z, round(s, 6)) for a, z, s in greedy(x)]


def corpus(n=700):
    out, labels = [], []
    for i in range(n):
        w = words(80, i).split()
        bad = i % 8 == 0
        if bad:
            w[20:20] = ["vile", "awful", "nasty"]
        t = " ".join(w) if i % 5 else " | ".join(x + "###" for x in w)
        out.append((i, t, "host" + str(i % 7)))
        labels.append((i, int(i % 5 != 0), int(bad)))
    return out, labels


def test_toxicity_held_out(spark):
    rows, labels = corpus()
    got = {r.doc_id: r for r in toxicity.toxicity(docs(spark, rows), spark.createDataFrame(labels, LABELS)).collect()}
    y = {i: t for i, _, t in labels}
    h = [r for r in got.values() if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == int(r.score >= 0.7) for r in got.values())
    assert sum(r.predicted == y[r.doc_id] for r in h) / len(h) > 0.97
    assert any(r.passages for r in got.values() if y[r.doc_id])


def test_every_copy_of_a_passage_counts():
    model = toxicity.Model({b"vile": 3.0, b"awful": 2.0, b"meh": 0.6}, {}, 0.5, 1.0, 0.01, 1.0, 0.0)
    quiet = [b"plain"] * 30
    bad = [b"vile", b"awful", b"vile"]
    text = [*bad, *quiet, *bad, *quiet, *bad, *quiet, *bad, *quiet, *bad]
    got = toxicity.passages(text, model)
    assert [(a, z) for a, z, _ in got] == [(33 * i, 33 * i + 3) for i in range(5)]
    assert all(math.isclose(s, 2.5 + 1.5 + 1.0) for _, _, s in got)
    x = 5.0 - math.log(0.01 * len(text))
    one, five = (toxicity.evidence(got[:n], text, model) for n in (1, 5))
    assert math.isclose(one, x) and math.isclose(five - one, 0.5 * (x - toxicity.SIGNIFICANT) * sum(1 / j for j in range(2, 6)))
    assert toxicity.score_text(b" ".join(text), model)[1] == got
    # Unlike passages count in full, however many.
    many = [w for i in range(9) for w in (*quiet, b"vile", b"awful", b"x%d" % i, b"vile")]
    model.words.update({b"x%d" % i: 1.0 for i in range(9)})
    segs = toxicity.passages(many, model)
    x = [toxicity.surplus(s, len(many), model) for *_, s in segs]
    assert len(segs) == 9 and math.isclose(toxicity.evidence(segs, many, model), x[0] + 8 * 0.5 * (x[0] - toxicity.SIGNIFICANT))
    # A word said over and over is no passage of its own.
    assert max(s for _, _, s in toxicity.passages([b"meh"] * 400, model)) < 0.2


def test_a_text_over_many_batches(spark, tmp_path):
    """A text larger than an Arrow batch goes through every operator whole."""
    from lamina.llm import common

    rows, labels = corpus(80)
    long = " ".join([words(2000, 3)] * 1000)
    assert len(long) > 8 << 20 and common.BATCH == "8m"
    rows.append((500, long + " mit license vile awful nasty", "host1"))
    docs(spark, rows).coalesce(2).write.parquet(str(tmp_path / "d"))
    d, lab = spark.read.parquet(str(tmp_path / "d")), spark.createDataFrame(labels, LABELS)
    one = lambda df: df.where("doc_id = 500").collect()
    r = one(licenses.license_scan(d))[0]
    assert (r.n_words, r.first_word) == (2_000_005, 2_000_000)
    assert one(toxicity.toxicity(d, lab))[0].score >= 0 and one(quality.quality(d, lab))[0].score >= 0
    assert one(simhash.near_duplicates(d))[0].fingerprint == f"{brute_fingerprint(long + ' mit license vile awful nasty'):016x}"
    assert one(brown.lm_scores(d, classes=4))[0].n_tokens == 2_000_006


def test_quality_held_out(spark):
    rows, labels = corpus()
    d, lab = docs(spark, rows), spark.createDataFrame(labels, LABELS)
    got = quality.quality(d, lab).collect()
    y = {i: q for i, q, _ in labels}
    h = [r for r in got if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert sum(r.predicted == y[r.doc_id] for r in h) / len(h) > 0.97
    kept = quality.keep_good(d, lab)
    assert kept.columns == d.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if r.predicted}


def test_quality_by_hand(spark):
    """Posteriors and scores recomputed from the evidence, one document left out at a time."""
    from pyspark.sql import functions as F

    rows, labels = corpus(300)
    d, lab = docs(spark, [(i, t, None if i % 11 == 0 else s) for i, t, s in rows]), spark.createDataFrame(labels, LABELS)
    model = quality.fit(quality.training_rows(d, lab, "quality", rows=quality.SAMPLE_ROWS))
    p = dict(zip([r[0] for r in rows], quality.probability([t.encode() for _, t, _ in rows], model).tolist(), strict=True))
    host = {r.doc_id: r.source for r in d.collect()}
    n, good = Counter(host.values()), Counter()
    for i, h in host.items():
        good[h] += p[i]
    m = min(max(sum(p.values()) / len(p), 1e-3), 1 - 1e-3)
    scored = d.select(quality.site_name(F.col("source")).alias("_host"), quality.site_name(F.col("lang")).alias("_path"), quality.probability_column(spark, model, F.col("text")).alias("_p"))
    _, k_host, k_path = quality.posteriors(scored, model.prior)
    held = lambda x: min(max(x, 1e-4), 1 - 1e-4)
    logit = lambda x: math.log(x / (1 - x))
    for r in quality.quality(d, lab).collect():
        i, h = r.doc_id, host[r.doc_id]
        hp = held((good[h] - p[i] + k_host * m) / (n[h] - 1 + k_host))
        pp = held((good[h] - p[i] + k_path * hp) / (n[h] - 1 + k_path))  # one path a host here
        want = 1 / (1 + math.exp(-(logit(p[i]) - model.prior + logit(pp))))
        assert math.isclose(r.host_posterior, hp, rel_tol=1e-6) and math.isclose(r.path_posterior, pp, rel_tol=1e-6) and math.isclose(r.score, want, rel_tol=1e-6)


def test_edges_of_the_classifiers(spark):
    none = spark.createDataFrame([(None, None, None), (1, None, 1), (1, 1, 0)], LABELS)
    empty = none.limit(0)
    for labels in (none, empty):
        t = toxicity.toxicity(docs(spark, EDGES), labels).collect()
        q = quality.quality(docs(spark, [*EDGES, (30, "t", None)]), labels).collect()
        assert len(t) == len(EDGES) and len(q) == len(EDGES) + 1 and all(0 <= r.score <= 1 for r in [*t, *q])
    assert toxicity.toxicity(docs(spark, []), empty).count() == 0 and quality.quality(docs(spark, []), empty).count() == 0


def test_sites_shrink_to_their_parents(spark):
    from pyspark.sql import functions as F

    rows = [("big", "p", 0.95)] * 300 + [("bad", "p", 0.05)] * 300 + [("new", "p", 0.05)]
    table, k_host, _ = quality.posteriors(spark.createDataFrame(rows, "_host string, _path string, _p double"), 0.0)
    m = {r._host: (r.host_good + k_host * r.global_mean) / (r.host_n + k_host) for r in table.select("*", F.lit(1)).collect()}
    assert m["bad"] < 0.1 and m["big"] > 0.9 and 0.2 < m["new"] < 0.5
