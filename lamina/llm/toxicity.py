"""Toxicity by maximum-scoring segments.

Tokens score by their log-odds of standing in toxic rather than in other text, with informative
Dirichlet priors: a word's prior counts follow its six-letter start, whose prior follows its four-letter
start, whose prior is the whole sample. Scores are shrunk by their standard error and lowered by a drift, so that
ordinary text sinks. A linear-time scan gives every maximal passage; scores of passages are put on one
scale by the extreme-value law of the best passage of an ordinary text of the same length.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ALNUM_TABLE, as_bytes, crc_mod, map_batches, small_batches

#: Bounds of the fit: labelled rows used (those of the smallest hashed ids) and their bytes of text.
SAMPLE_ROWS, SAMPLE_BYTES = 6_000, 32 << 20
#: A passage is significant if ordinary texts of that length have fewer than one in twenty of them: minus log of that number.
SIGNIFICANT = math.log(20)
#: A text is called toxic from this score on.
THRESHOLD = 0.7


def tokens_of(text: bytes) -> list[bytes]:
    return text.translate(ALNUM_TABLE).split()


def starts_of(word: bytes) -> tuple[bytes, bytes]:
    """The word's four- and six-byte starts, marked apart from words; short words stand for themselves."""
    return b"4" + word[:4], b"6" + word[:6]


@dataclass(frozen=True)
class Model:
    words: dict  # word -> score, for words of the sample
    stems: dict  # marked start -> score, for words that are not in the sample
    drift: float
    lam: float
    k: float
    slope: float
    bias: float


def log_odds(toxic: Counter, clean: Counter, prior: float = 20.0) -> tuple[dict, dict]:
    """Shrunk log-odds of words and of starts; each level's Dirichlet prior has the rates of the level above."""
    nt, nc = max(1, sum(toxic.values())), max(1, sum(clean.values()))
    four: tuple[Counter, Counter] = (Counter(), Counter())
    six: tuple[Counter, Counter] = (Counter(), Counter())
    for side, counts in enumerate((toxic, clean)):
        for w, n in counts.items():
            a, b = starts_of(w)
            four[side][a] += n
            six[side][b] += n

    def level(own: tuple[Counter, Counter], above) -> dict:
        """Toxic share of a token, out of toxic and clean counts scaled to equal totals."""
        out = {}
        for w in own[0].keys() | own[1].keys():
            t, c = own[0][w] / nt * (nt + nc) / 2, own[1][w] / nc * (nt + nc) / 2
            p = above(w)
            share = (t + prior * p) / (t + c + prior)
            # standard error of the log-odds with the prior's counts
            out[w] = (share, 1 / (t + prior * p + 0.5) + 1 / (c + prior * (1 - p) + 0.5))
        return out

    l4 = level(four, lambda w: 0.5)
    l6 = level(six, lambda w: l4[b"4" + w[1:5]][0])
    lw = level((toxic, clean), lambda w: l6[b"6" + w[:6]][0])

    def scored(table: dict) -> dict:
        out = {}
        for w, (share, var) in table.items():
            share = min(max(share, 1e-6), 1 - 1e-6)
            d = math.log(share / (1 - share))
            z = d / math.sqrt(var)
            out[w] = d * z * z / (z * z + 4.0)
        return out

    return scored(lw), scored(l6)


def token_scores(words: Sequence[bytes], model: Model) -> np.ndarray:
    """Each token's score less the drift."""
    get, stem = model.words.get, model.stems.get
    raw = [get(w) for w in words]
    out = [stem(b"6" + w[:6], 0.0) if s is None else s for s, w in zip(raw, words, strict=True)]
    return np.array(out, dtype=np.float64) - model.drift


def passages(words: Sequence[bytes], model: Model) -> list[tuple[int, int, float]]:
    """All maximal passages (start, end, score). Repeats of a word within a passage are not independent evidence: the j-th
    counts by a j-th, and the passage is scanned anew with what then is left. Each passage starts counting afresh, so a copy of a
    passage further on scores as much as the first."""
    scores = token_scores(words, model) if words else np.zeros(0)
    out = []
    for a, z, total in segments(scores):
        own, seen = scores[a:z], Counter()
        damped = own
        if len(set(words[a:z])) < z - a:
            damped = own.copy()
            for i in np.flatnonzero(own > 0).tolist():
                seen[words[a + i]] += 1
                damped[i] = (own[i] + model.drift) / seen[words[a + i]] - model.drift
        out += [(a, z, total)] if damped is own else [(a + i, a + j, s) for i, j, s in segments(damped)]
    return out


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) of a sequence, in linear time.

    Runs of tokens with no positive score only lower the running sum; the list of candidates is kept
    so that each holds its left and right cumulative sums, and a new one joins those before it that
    it can extend.
    """
    total = np.cumsum(scores)
    found: list[list] = []  # start, end, left sum, right sum
    for i in np.flatnonzero(scores > 0):
        right = float(total[i])
        new = [int(i), int(i) + 1, right - float(scores[i]), right]
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= new[2]:
                j = new_below(found, j)
            if j < 0 or found[j][3] >= new[3]:
                new.append(j)
                found.append(new)
                break
            new = [found[j][0], new[1], found[j][2], new[3]]
            del found[j:]
    return [(a, z, r - left) for a, z, left, r, _ in found]


def new_below(found: list[list], j: int) -> int:
    """The nearest earlier candidate whose left sum is below that of candidate j: noted when j was added."""
    return found[j][4]


def tail_rate(scores: np.ndarray) -> float:
    """lambda > 0 with mean(exp(lambda * s)) = 1 over ordinary tokens' scores."""
    if not (scores > 0).any() or scores.mean() >= 0:
        return 1.0
    low, high = 1e-6, 1.0
    values, n = np.unique(np.round(scores, 3), return_counts=True)
    p = n / n.sum()
    f = lambda x: float((p * np.exp(np.minimum(x * values, 700))).sum()) - 1
    while f(high) < 0 and high < 64:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) < 0 else (low, mid)
    return high


def surplus(score: float, n: int, model: Model) -> float:
    """Minus log of the expected number of passages of at least this score in an ordinary text of n tokens."""
    return model.lam * score - math.log(max(model.k * max(n, 1), 1e-9))


def evidence(segs: list[tuple[int, int, float]], words: Sequence[bytes], model: Model) -> float:
    """The surplus of the best passage, and half of what each further one has beyond SIGNIFICANT. All of them count; the j-th
    passage with the same words counts by a j-th, as a text that says one thing over and over says it once."""
    if not segs:
        return -2.0
    ordered = sorted(((surplus(s, len(words), model), a, z) for a, z, s in segs), reverse=True)
    out, said = ordered[0][0], Counter()
    for x, a, z in ordered:
        if x <= SIGNIFICANT:
            break
        passage = tuple(words[a:z])
        said[passage] += 1
        if (a, z) != ordered[0][1:]:
            out += 0.5 * (x - SIGNIFICANT) / said[passage]
    return max(-2.0, out)


def fit(rows: Iterable[tuple[bytes, int]]) -> Model:
    """Words, drift, extreme-value law and calibration from labelled texts.

    Two folds: each half's texts are scored with word scores of the other, so that the law and the
    calibration see honest evidence; the words of the final model come from all rows.
    """
    rows = list(rows)

    def parsed(part) -> Iterator[tuple[list[bytes], int]]:
        """Texts are cut into words anew in each pass, so that one text's words are held at a time."""
        return ((tokens_of(t), int(y)) for t, y in part)

    def counts(part) -> tuple[Counter, Counter]:
        t, c = Counter(), Counter()
        for w, y in parsed(part):
            # A text's further uses of a word count by their logarithm: one repetitive text is not evidence of many.
            own = Counter(w)
            (t if y else c).update({k: 1 + math.log(n) for k, n in own.items()})
        return t, c

    def law(words: dict, stems: dict, part) -> Model:
        raw = Model(words, stems, 0.0, 1.0, 1.0, 1.0, 0.0)
        clean = [token_scores(w, raw).astype(np.float32) for w, y in parsed(part) if not y and w]
        all_clean = np.concatenate(clean) if clean else np.zeros(1)
        drift = max(0.5, float(all_clean.mean()) + 0.5)
        shifted = all_clean - drift
        lam = min(3.0, tail_rate(shifted))
        # K from the mean of the best passage of ordinary texts: E(max) = (ln(K n) + 0.5772) / lambda
        lowered = Model(words, stems, drift, lam, 1.0, 1.0, 0.0)
        best = [(max((s[2] for s in passages(w, lowered)), default=0.0), len(w)) for w, y in parsed(part) if not y and w]
        k = math.exp(float(np.mean([lam * m - 0.5772 - math.log(n) for m, n in best]))) if best else 1.0
        return Model(words, stems, drift, lam, max(k, 1e-6), 1.0, 0.0)

    halves = [rows[0::2], rows[1::2]]
    xs, ys, laws = [], [], []
    for own, other in (halves, halves[::-1]):
        m = law(*log_odds(*counts(other)), own)
        laws.append((m.drift, m.lam, math.log(m.k)))
        for w, y in parsed(own):
            xs.append(evidence(passages(w, m), w, m))
            ys.append(y)
    slope, bias = logistic(np.array(xs), np.array(ys, dtype=np.float64))
    words, stems = log_odds(*counts(rows))
    drift, lam, log_k = np.mean(laws, axis=0).tolist()
    return Model(words, stems, drift, lam, math.exp(log_k), slope, bias)


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 100) -> tuple[float, float]:
    """Slope and bias of P(y=1) = 1 / (1 + exp(-(slope x + bias))), by damped Newton steps with a weak prior."""
    if not len(x) or y.min() == y.max():
        return 1.0, -4.0
    a, b = 0.1, math.log(max(y.mean(), 1e-6) / max(1 - y.mean(), 1e-6))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        w = p * (1 - p) + 1e-9
        g = np.array([((y - p) * x).sum() - 1e-2 * a, (y - p).sum() - 1e-3 * b])
        h = np.array([[(w * x * x).sum() + 1e-2, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-3]])
        step = np.linalg.solve(h, g)
        step = step * min(1.0, 1.0 / max(1e-12, float(np.abs(step).max())))
        a, b = a + step[0], b + step[1]
        if np.abs(step).max() < 1e-8:
            break
    return max(float(a), 1e-3), float(b)


def score_text(text: bytes, model: Model) -> tuple[float, list[tuple[int, int, float]]]:
    """Score from 0 to 1 and the significant passages."""
    words = tokens_of(text)
    segs = passages(words, model)
    x = evidence(segs, words, model)
    score = 1 / (1 + math.exp(-max(-30.0, min(30.0, model.slope * x + model.bias))))
    return score, [s for s in segs if surplus(s[2], len(words), model) > SIGNIFICANT]


def training_rows(
    documents: DataFrame, labels: DataFrame, label: str, id_col: str = "doc_id", text_col: str = "text", rows: int = SAMPLE_ROWS, most_bytes: int = SAMPLE_BYTES
) -> Iterator[tuple[bytes, int]]:
    """Labelled texts whose crc32(id) mod 3 is not 1, in order of hashed ids: at most `rows`, and at most `most_bytes` of
    text (a text that would exceed what is left is passed over).

    An id with several labels takes the largest; of several texts the first in order. Ids are picked before texts are read.
    """
    ids = (
        labels.select(F.col("doc_id").cast("long").alias("_id"), F.col(label).cast("int").alias("_y"))
        .where(F.col("_id").isNotNull() & F.col("_y").isNotNull() & (crc_mod(F.col("_id"), 3) != 1))
        .groupBy("_id").agg(F.max("_y").alias("_y"))
        .orderBy(F.xxhash64("_id"), "_id")
        .limit(rows)
    )
    picked = ids.collect()  # at most `rows` pairs of numbers
    small = F.broadcast(documents.sparkSession.createDataFrame([(r[0], r[1]) for r in picked], "_id long, _y int"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    got = (
        documents.select(F.col(id_col).cast("long").alias("_id"), text.alias("_t"))
        .where(F.octet_length(text) <= most_bytes)
        .join(small, "_id")
        .groupBy("_id").agg(F.min("_t").alias("_t"), F.max("_y").alias("_y"))
    )
    left = most_bytes
    for r in got.orderBy(F.xxhash64("_id"), "_id").toLocalIterator():
        text_ = r["_t"].encode()
        if len(text_) <= left:
            left -= len(text_)
            yield text_, r["_y"]


def toxicity_model(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    return fit(training_rows(documents, labels, "toxic", id_col, text_col))


PASSAGES = "array<struct<first_word:long,end_word:long,score:double>>"


def toxicity(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted, passages (significant toxic passages, in words) of every document.

    Trained on at most SAMPLE_ROWS labelled rows whose crc32(id as text) mod 3 is not 1; scores look at
    the text only.
    passages: first_word and end_word (from 0, the end left out) and score of every significant passage.

    Defined cases: a null or empty text has no passage and the score of no evidence; a null id is held
    out as the empty text's crc says; repeated ids are kept; without labelled rows every score is low;
    an empty table gives no rows; other columns are not looked at.
    """
    model = documents.sparkSession.sparkContext.broadcast(toxicity_model(documents, labels, id_col, text_col))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        m = model.value
        for batch in it:
            got = [score_text(t, m) for t in as_bytes(batch.column("text"))]
            yield {
                "doc_id": batch.column("doc_id"),
                "held_out": batch.column("held_out"),
                "score": [s for s, _ in got],
                "predicted": [int(s >= THRESHOLD) for s, _ in got],
                "passages": [[{"first_word": a, "end_word": z, "score": x} for a, z, x in p] for _, p in got],
            }

    own = documents.select(F.col(id_col).cast("long").alias("doc_id"), (crc_mod(F.col(id_col), 3) == 1).alias("held_out"), F.col(text_col).alias("text"))
    return map_batches(own, run, f"doc_id long, held_out boolean, score double, predicted int, passages {PASSAGES}")


def toxicity_column(documents: DataFrame, labels: DataFrame, text: Column) -> Column:
    """The score as a column, for filters that keep all columns of their input.

    Defined cases: a null or empty text has the score of no evidence; without labelled rows every score is low.
    """
    model = documents.sparkSession.sparkContext.broadcast(toxicity_model(documents, labels))
    small_batches(documents.sparkSession)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series([score_text((t or "").encode(), model.value)[0] for t in texts], dtype="float64")

    return score(text)
