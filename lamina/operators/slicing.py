"""Slicing documents on the grid, with bytes, markers and ids: one narrow pass, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import SlicingError
from ..functions.counters import Counter
from ..functions.exprs import marker, slice_uuid
from ..grid import DEFAULT_GRID, Grid
from ..sources.shared import few

KEY = ["document_id", "size", "codepoint_offset"]
#: Documents whose places are broadcast at most.
BROADCAST_DOCUMENTS = 50_000


def check_text(document_id: object, text: object) -> None:
    """For texts that come from Python: Spark would rewrite a lone surrogate silently."""
    if not isinstance(document_id, str) or not document_id:
        raise SlicingError("a document id is a non-empty string")
    if not isinstance(text, str):
        raise SlicingError("a text is a string")
    try:
        text.encode("utf-8")
    except UnicodeEncodeError as e:
        raise SlicingError(f"lone surrogate U+{ord(text[e.start]):04X} at code point {e.start}") from e


def checked(documents: DataFrame) -> DataFrame:
    """(document_id, text), where an empty or null id or text that is no valid UTF-8 raises."""
    bad_id = F.col("document_id").isNull() | (F.col("document_id") == "")
    return documents.select(
        F.when(bad_id, F.raise_error(F.lit("a document id is a non-empty string"))).otherwise(F.col("document_id")).alias("document_id"),
        F.when(~F.is_valid_utf8("text"), F.raise_error(F.lit("text is not valid UTF-8"))).otherwise(F.coalesce("text", F.lit(""))).alias("text"),
    )


def tiles(text: Column, size: int) -> Column:
    """The text cut every `size` code points, in time linear in its length."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))


def slice_documents(
    documents: DataFrame,
    grid: Grid = DEFAULT_GRID,
    *,
    corpus: str = "default",
    counter: Counter | None = None,
    with_descendants: bool = True,
    with_ids: bool = True,
    with_bytes: bool = True,
    only: tuple[int, ...] | None = None,
) -> DataFrame:
    """All slices of (document_id, text) at every size, or at some of them only; an empty text has none.

    Each size is tiled once and each tile hashed once; a slice's descendants are runs of the smaller
    sizes' marker arrays, and its byte offset is a look-up in the running byte lengths of the
    smallest size. All of this is in the document's own row, which is exploded last. Without descendants and byte offsets
    nothing ties slices together: tiles are exploded at once, and what no one asks for of them is never computed.
    """
    sizes = grid.sizes
    d = checked(documents).where(F.length("text") > 0).withColumn("n", F.length("text"))
    if not with_descendants and not with_bytes:
        each = d.select("document_id", "n", "text", F.explode(grid.array() if only is None else F.array(*map(F.lit, only)).cast("array<int>")).alias("size"))
        cut = F.regexp_extract_all("text", F.concat(F.lit("(?s).{1,"), F.col("size"), F.lit("}")), F.lit(0))
        tile = each.select("document_id", "n", "size", F.posexplode(cut).alias("i", "text"))
        plain = tile.select(
            F.lit(corpus).alias("corpus"), "document_id", "size", (F.col("i") * F.col("size")).alias("codepoint_offset"), F.length("text").alias("codepoint_length"),
            F.octet_length("text").alias("byte_length"), F.col("n").alias("document_codepoint_length"), "text", marker(F.col("text")).alias("own_marker"),
        )
        return finished(plain, corpus, counter, with_ids)
    d = d.withColumns({f"t{s}": tiles(F.col("text"), s) for s in sizes})
    d = d.withColumns({f"m{s}": F.transform(f"t{s}", marker) for s in sizes})
    smallest = sizes[0]
    d = d.withColumn(
        "bytes",
        F.aggregate(
            f"t{smallest}",
            F.array(F.lit(0)),
            lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + F.octet_length(x))),
        ),
    )

    def of(size: int) -> Column:
        def one(x: Column, i: Column) -> Column:
            length = F.length(x)
            below = [
                F.slice(F.col(f"m{s}"), i * (size // s) + 1, F.ceil(length / F.lit(s)).cast("int")) for s in grid.below(size)
            ]
            return F.struct(
                F.lit(size).alias("size"),
                (i * size).alias("codepoint_offset"),
                length.alias("codepoint_length"),
                F.element_at("bytes", i * (size // smallest) + 1).alias("byte_offset"),
                F.octet_length(x).alias("byte_length"),
                x.alias("text"),
                F.get(F.col(f"m{size}"), i).alias("own_marker"),
                (F.concat(*below) if below and with_descendants else F.array().cast("array<string>")).alias("descendant_markers"),
            )

        return F.transform(f"t{size}", one)

    out = d.select("document_id", F.col("n").alias("document_codepoint_length"), F.explode(F.concat(*(of(s) for s in (sizes if only is None else only)))).alias("s"))
    cols = ["size", "codepoint_offset", "codepoint_length", "byte_offset", "byte_length"]
    out = out.select(
        F.lit(corpus).alias("corpus"), "document_id", *(F.col(f"s.{c}") for c in cols), "document_codepoint_length",
        "s.text", "s.own_marker", *(["s.descendant_markers"] if with_descendants else []),
    )
    return finished(out, corpus, counter, with_ids)


def finished(slices: DataFrame, corpus: str, counter: Counter | None, with_ids: bool) -> DataFrame:
    """Slices with their token counts and, if asked for, their ids."""
    out = slices.withColumn("token_count", counter(F.col("text")) if counter else F.lit(None).cast("int"))
    return out.withColumn("point_id", slice_uuid(F.lit(corpus), F.col("document_id"), F.col("size"), F.col("codepoint_offset"))) if with_ids else out


def slices_at(documents: DataFrame, keys: DataFrame, grid: Grid = DEFAULT_GRID, *, corpus: str = "default", counter: Counter | None = None) -> DataFrame:
    """The slices of (document_id, text) at the keys' places, each once, as slice_documents() gives them; places behind a text's end
    are left out. Only what is asked for is cut and hashed, and only documents that are asked for are read on."""
    asked = keys.select(*KEY).where(F.col("size").isin(*grid.sizes) & (F.col("codepoint_offset") % F.col("size") == 0)).distinct()
    places = asked.groupBy("document_id").agg(F.collect_list(F.struct("size", "codepoint_offset")).alias("places"))
    # A few documents' places go to the documents, which then are not moved.
    places = F.broadcast(places) if few(places, BROADCAST_DOCUMENTS) else places
    d = checked(documents).join(places, "document_id").withColumn("n", F.length("text"))
    at = d.select("document_id", F.col("text").alias("whole"), "n", F.explode("places").alias("p")).where("p.codepoint_offset < n")
    size, offset = F.col("p.size"), F.col("p.codepoint_offset")
    cut = at.withColumn("text", F.substring("whole", offset + 1, size))
    below = [F.when(size > s, F.transform(tiles(F.col("text"), s), marker)).otherwise(F.array().cast("array<string>")) for s in grid.sizes[:-1]]
    return cut.select(
        F.lit(corpus).alias("corpus"), "document_id", size.alias("size"), offset.alias("codepoint_offset"), F.length("text").alias("codepoint_length"),
        F.octet_length(F.substring("whole", F.lit(1), offset)).alias("byte_offset"), F.octet_length("text").alias("byte_length"), F.col("n").alias("document_codepoint_length"),
        "text", marker(F.col("text")).alias("own_marker"), (F.concat(*below) if below else F.array().cast("array<string>")).alias("descendant_markers"),
        (counter(F.col("text")) if counter else F.lit(None).cast("int")).alias("token_count"),
        slice_uuid(F.lit(corpus), F.col("document_id"), size, offset).alias("point_id"),
    )


def of_size(slices: DataFrame, size: int) -> DataFrame:
    """One size's slices, in order of document and place."""
    return slices.where(F.col("size") == size).orderBy("document_id", "codepoint_offset")


def slice_at(slices: DataFrame, size: int, offset: int) -> DataFrame:
    """Each document's slice at a place, where it has one."""
    return slices.where((F.col("size") == size) & (F.col("codepoint_offset") == offset))


def spine(slices: DataFrame) -> DataFrame:
    """The slices at offset zero."""
    return slices.where(F.col("codepoint_offset") == 0)


def rebuild(slices: DataFrame) -> DataFrame:
    """document_id, size, text: each size's slices put together again. A document is one row, as it was."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("codepoint_offset", "text"))), lambda x: x["text"])
    return slices.groupBy("document_id", "size").agg(F.concat_ws("", parts).alias("text"))


def spine_gate(slices: DataFrame, grid: Grid = DEFAULT_GRID) -> DataFrame:
    """size, documents, violations: each spine slice must start the next one up, whose descendants hold its marker."""
    s = spine(slices)
    upper = s.select("document_id", F.col("size").alias("upper"), F.col("text").alias("upper_text"), "descendant_markers")
    step = {low: high for low, high in zip(grid.sizes, grid.sizes[1:], strict=False)}
    lower = s.withColumn("upper", F.create_map(*(F.lit(x) for pair in step.items() for x in pair))[F.col("size")]) if step else s.limit(0).withColumn("upper", F.lit(0))
    good = F.startswith("upper_text", F.col("text")) & F.array_contains("descendant_markers", F.col("own_marker"))
    return (
        lower.where(F.col("upper").isNotNull())
        .select("document_id", "size", "upper", "text", "own_marker")
        .join(upper, ["document_id", "upper"], "left")
        .groupBy("size")
        .agg(F.count("*").alias("documents"), F.count_if(~F.coalesce(good, F.lit(False))).alias("violations"))
    )


def ancestors(slices: DataFrame, grid: Grid = DEFAULT_GRID) -> DataFrame:
    """(document_id, size, codepoint_offset, ancestor_size, ancestor_offset) of every slice."""
    return slices.select(*KEY, F.explode(grid.ancestors_column(F.col("size"), F.col("codepoint_offset"))).alias("a")).select(
        *KEY, F.col("a.size").alias("ancestor_size"), F.col("a.codepoint_offset").alias("ancestor_offset")
    )
