import pytest

from lamina.errors import InvalidGrid
from lamina.grid import DEFAULT_GRID, Grid


@pytest.mark.parametrize("sizes", [(), (0,), (-64,), (64, 64), (128, 64), (64, 100), (True, 2), (64.0,), ("64",)])
def test_bad_grids(sizes):
    with pytest.raises(InvalidGrid) as e:
        Grid(sizes)
    assert e.value.code == "INVALID_GRID"


def test_ladder():
    g = Grid((3, 6, 24))
    assert (g.smallest, g.largest, 6 in g, 7 in g) == (3, 24, True, False)
    assert g.above(3) == (6, 24) and g.above(24) == () and g.below(24) == (3, 6)
    assert g.ancestors(3, 27) == [(6, 24), (24, 24)] and g.parent(24, 0) is None
    with pytest.raises(InvalidGrid):
        g.above(5)


def test_fingerprint():
    import hashlib

    assert DEFAULT_GRID.fingerprint() == hashlib.sha256(b"sizes=64,128,256,512,1024").hexdigest()


def test_column_forms(spark):
    from pyspark.sql import functions as F

    r = spark.range(1).select(
        DEFAULT_GRID.above_column(F.lit(256)).alias("a"), DEFAULT_GRID.below_column(F.lit(256)).alias("b"),
        DEFAULT_GRID.ancestors_column(F.lit(128), F.lit(384)).alias("c"),
    ).first()
    assert (r.a, r.b) == ([512, 1024], [64, 128])
    assert [tuple(x) for x in r.c] == DEFAULT_GRID.ancestors(128, 384)
