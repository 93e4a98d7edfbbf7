import hashlib
import uuid

import pytest
from pyspark.sql import functions as F

from lamina.functions import counters, embedders, exprs
from lamina.errors import EmbedderUnavailable, UnknownTokenizer, ValidationError


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_pinned_markers(spark):
    r = one(spark, *(exprs.marker(F.lit(t)) for t in ("", "abc", "x" * 64)))
    assert list(r) == [
        "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855",
        "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad",
        "7ce100971f64e7001e8fe5a51973ecdfe1ced42befe7ee8d5fd6219506b5393c",
    ]


def test_uuid_is_version_five_with_escapes(spark):
    for corpus, doc, size, at in [("default", "doc-1", 64, 0), ("a|b", "c\\d|", 128, 256), ("世", "🙂", 64, 64)]:
        got = one(spark, exprs.slice_uuid(F.lit(corpus), F.lit(doc), F.lit(size), F.lit(at)))[0]
        assert got == exprs.slice_uuid_py(corpus, doc, size, at) and uuid.UUID(got).version == 5


@pytest.mark.parametrize("size,want", [(64, "e7e09240-3782-55fa-aaa9-327955e17cdc"), (128, "9a5a1a5e-5b61-56cc-9722-8d97e68129a7")])
def test_pinned_uuids(spark, size, want):
    """A slice outside any corpus: its name has no corpus part."""
    assert one(spark, exprs.slice_uuid(F.lit(None).cast("string"), F.lit("doc-1"), F.lit(size), F.lit(0)))[0] == want
    assert exprs.slice_uuid_py(None, "doc-1", size, 0) == want


@pytest.mark.parametrize("n", [0, 1, 2, 3, 5])
def test_marker_codec(spark, n):
    m = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(n)]
    col = F.array(*map(F.lit, m)) if m else F.array().cast("array<string>")
    packed = exprs.pack_markers(col)
    r = one(spark, packed.alias("p"), exprs.unpack_markers(packed).alias("u"))
    assert r.u == m and "\n" not in r.p and (n or r.p == "")


@pytest.mark.parametrize("bad", ["xyz", "A" * 64, "a" * 63])
def test_bad_marker(spark, bad):
    with pytest.raises(Exception, match="64 lower-case hex"):
        one(spark, exprs.pack_markers(F.array(F.lit(bad))))


@pytest.mark.parametrize("bad", ["!!!", "YWJj"])
def test_bad_packed(spark, bad):
    with pytest.raises(Exception, match="not packed markers"):
        spark.createDataFrame([(bad,)], "p string").select(exprs.unpack_markers(F.col("p"))).collect()


def test_fake_vectors_agree(spark):
    e = embedders.FakeEmbedder(13)
    texts = ["", "a", "世界🙂", "x" * 1000]
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "t string")
    got = [r[0] for r in df.where("t is not null").select(e.column(F.col("t"))).collect()]
    assert got == e.embed(texts) == [r[0] for r in df.where("t is not null").select(exprs.fake_vector(F.col("t"), 13)).collect()]
    assert df.where("t is null").select(e.column(F.col("t"))).first()[0] is None
    assert e.fingerprint() == "fake:deterministic-13" and all(abs(sum(x * x for x in v) - 1) < 1e-12 for v in got)


def test_cosine(spark):
    a = lambda *x: F.array(*(F.lit(float(v)) for v in x))
    r = one(spark, exprs.cosine(a(1, 0), a(1, 1)), exprs.cosine(a(0, 0), a(1, 1)))
    assert abs(r[0] - 0.5**0.5) < 1e-15 and r[1] == 0.0
    with pytest.raises(Exception, match="unlike lengths"):
        one(spark, exprs.cosine(a(1), a(1, 1)))


def test_counters(spark):
    with pytest.raises(UnknownTokenizer, match="chars"):
        counters.get("nope")
    counters.register("twice", lambda: lambda t: F.length(t) * 2)
    assert one(spark, counters.get("twice")(F.lit("世🙂")), counters.get("chars")(F.lit("世🙂")))[0] == 4
    assert "twice" in counters.registered()


def test_retries_and_batches():
    waits, calls = [], []

    def call():
        calls.append(1)
        raise embedders.Retryable("busy")

    with pytest.raises(EmbedderUnavailable):
        embedders.with_retries(call, 3, 0.5, waits.append)
    assert len(calls) == 3 and waits == [0.5, 1.0]
    assert embedders.in_batches("abcde", 2, lambda b: [[ord(x)] for x in b]) == [[97], [98], [99], [100], [101]]


def test_http_embedders():
    seen = []

    def old_server(url, body, headers, timeout):
        seen.append(url)
        return (404, {}) if url.endswith("/api/embed") else (200, {"embedding": [1.0, 2.0]})

    o = embedders.OllamaEmbedder("http://h", "m", post=old_server)
    assert o.embed(["a", "b"]) == [[1.0, 2.0]] * 2 and o.embed(["c"]) == [[1.0, 2.0]]
    assert sum(u.endswith("/api/embed") for u in seen) == 1
    p = embedders.OpenAICompatibleEmbedder("http://h", "m", post=lambda *a: (200, {"data": [{"index": 1, "embedding": [2.0]}, {"index": 0, "embedding": [1.0]}]}))
    assert p.embed(["a", "b"]) == [[1.0], [2.0]]
    with pytest.raises(EmbedderUnavailable):
        p.embed(["a"])
    assert p.health()["ok"] is False or p.health()["dimension"] == 1
    registry = embedders.Registry()
    assert registry.providers() == ["fake", "ollama", "openai"]
    registry["own"] = lambda **settings: embedders.FakeEmbedder(settings["dim"])
    assert registry.create("own", dim=5).dimension() == 5
    with pytest.raises(ValidationError):
        registry.create("nope")
    assert callable(embedders.Registry("console_scripts").resolve("pytest")) and "pytest" in embedders.Registry("console_scripts").providers()
    plugged = embedders.Registry("lamina.no_such_group")
    assert plugged.plugins() == {} and plugged.providers() == ["fake", "ollama", "openai"]
    bad = embedders.OpenAICompatibleEmbedder("http://h", "m", post=lambda *a: (500, {}))
    assert not bad.health()["ok"] and bad.health()["dimension"] is None
    with pytest.raises(EmbedderUnavailable):
        bad.dimension()


def test_batches_at_once_keep_their_order():
    import threading
    import time

    under_way, most, lock = 0, 0, threading.Lock()

    def call(batch):
        nonlocal under_way, most
        with lock:
            under_way += 1
            most = max(most, under_way)
        time.sleep(0.02 * (3 - ord(batch[0]) % 3))
        with lock:
            under_way -= 1
        return [[ord(x)] for x in batch]

    assert embedders.in_batches("abcdefghij", 2, call, 3) == [[ord(x)] for x in "abcdefghij"] and 1 < most <= 3
