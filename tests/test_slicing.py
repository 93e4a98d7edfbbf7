import hashlib

import pytest

from lamina.errors import SlicingError
from lamina.grid import DEFAULT_GRID, Grid
from lamina.operators import slicing

MIX = "Hello, world! 世界 こんにちは Привет שלום مرحبا नमस्ते 🙂🌍🚀 "


def frame(spark, *docs):
    return spark.createDataFrame(list(docs), "document_id string, text string")


def expected(doc, text, grid):
    """All slices by an independent rule: hashes of Python substrings."""
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    out = {}
    for s in grid.sizes:
        for o in range(0, len(text), s):
            t = text[o : o + s]
            below = [sha(text[p : min(p + x, o + len(t))]) for x in grid.sizes if x < s for p in range(o, o + len(t), x)]
            out[doc, s, o] = (len(t), len(text[:o].encode()), len(t.encode()), len(text), t, sha(t), below)
    return out


@pytest.mark.parametrize(
    "text,grid",
    [("x" * 1024, DEFAULT_GRID), ("世" * 1024, DEFAULT_GRID), ("🙂" * 1030, DEFAULT_GRID), (MIX * 20, DEFAULT_GRID), ("a𐍈b🙂c世" * 50, Grid((3, 6, 24))), ("hello", DEFAULT_GRID), ("a\nb\r\n", Grid((1, 2)))],
)
def test_slices_against_python(spark, text, grid):
    rows = slicing.slice_documents(frame(spark, ("d", text), ("empty", "")), grid).collect()
    got = {(r.document_id, r.size, r.codepoint_offset): (r.codepoint_length, r.byte_offset, r.byte_length, r.document_codepoint_length, r.text, r.own_marker, r.descendant_markers) for r in rows}
    assert got == expected("d", text, grid)


def test_counts_of_1200(spark):
    from collections import Counter

    rows = slicing.slice_documents(frame(spark, ("d", "".join(chr(0x100 + i) for i in range(1200))))).collect()
    assert Counter(r.size for r in rows) == {64: 19, 128: 10, 256: 5, 512: 3, 1024: 2}
    tails = {r.size: r.codepoint_length for r in rows if r.codepoint_offset + r.codepoint_length == 1200}
    assert tails == {64: 48, 128: 48, 256: 176, 512: 176, 1024: 176}
    assert len(next(r for r in rows if (r.size, r.codepoint_offset) == (1024, 0)).descendant_markers) == 30


def test_guards(spark):
    for bad in ("", None, 7):
        with pytest.raises(SlicingError):
            slicing.check_text(bad, "x")
    with pytest.raises(SlicingError, match="U\\+D800"):
        slicing.check_text("d", "a\ud800b")
    with pytest.raises(Exception, match="non-empty"):
        slicing.slice_documents(frame(spark, ("", "x"))).collect()


def test_rebuild_and_gate(spark):
    s = slicing.slice_documents(frame(spark, ("d", MIX * 9), ("e", "y" * 70)))
    assert {(r.document_id, r.text) for r in slicing.rebuild(s).collect()} == {("d", MIX * 9), ("e", "y" * 70)}
    gate = slicing.spine_gate(s).collect()
    assert len(gate) == 4 and all(r.violations == 0 and r.documents == 2 for r in gate)
    from pyspark.sql import functions as F

    broken = s.withColumn("descendant_markers", F.array().cast("array<string>"))
    assert all(r.violations == 2 for r in slicing.spine_gate(broken).collect())


def test_partitions_do_not_matter(spark):
    d = frame(spark, *((str(i), MIX[i:] * (i + 1)) for i in range(8)))
    a = slicing.slice_documents(d).orderBy(*slicing.KEY).collect()
    b = slicing.slice_documents(d.repartition(3, "text")).orderBy(*slicing.KEY).collect()
    assert a == b


def test_other_ways_to_the_same_slices(spark):
    """Tiles exploded at once, and slices cut by place, are those of the whole pass."""
    d = frame(spark, ("a", MIX * 30), ("b", "世🙂" * 100), ("c", ""), ("d|e", "x" * 64)).repartition(3)
    whole = slicing.slice_documents(d, counter=None)
    plain = slicing.slice_documents(d, with_descendants=False, with_bytes=False)
    cols = [c for c in plain.columns if c in whole.columns]
    assert "byte_offset" not in plain.columns and sorted(map(tuple, plain.select(*cols).collect())) == sorted(map(tuple, whole.select(*cols).collect()))
    places = [("a", 128, 256), ("a", 1024, 0), ("a", 1024, 1024), ("a", 64, 64), ("b", 64, 192), ("b", 64, 6400), ("c", 64, 0), ("d|e", 512, 0), ("none", 64, 0), ("a", 64, 7), ("a", 77, 0)]
    keys = spark.createDataFrame([*places, places[0]], "document_id string, size int, codepoint_offset int")
    cut = slicing.slices_at(d, keys)
    assert set(cut.columns) == set(whole.columns)
    want = whole.join(keys.distinct(), slicing.KEY, "left_semi")
    assert sorted(map(str, cut.select(*whole.columns).collect())) == sorted(map(str, want.select(*whole.columns).collect())) and cut.count() == 6
    assert [r.codepoint_offset for r in slicing.of_size(whole.where("document_id = 'b'"), 64).collect()] == [0, 64, 128, 192]
    assert sorted(r.document_id for r in slicing.slice_at(whole, 128, 128).collect()) == ["a", "b"]
