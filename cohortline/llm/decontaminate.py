"""Benchmark decontamination: containment of short items in long documents, with built-in functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Words of a shingle and the share of an item's shingles that a document must have.
WIDTH, SHARE = 5, 0.8
#: Rows of the items' sketches, and characters of their shingles, that are broadcast at most; beyond, they are joined by a shuffle.
MOST_ROWS, MOST_CHARS = 500_000, 64_000_000
#: Candidates that are broadcast at most to verify them, and contaminated rows to take them away.
MOST_LEAKS = 500_000


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once: a lambda's variable is not put back in place of its uses, as a column of a projection may be."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.array_remove(F.split(F.lower(text.cast("string")), r"[^\p{L}\p{N}]+"), "")


def starts(w: Column, width: int) -> Column:
    """Where shingles start: a text of fewer words has its whole sequence as its only one, a text without words none."""
    return F.when(F.size(w) > 0, F.sequence(F.lit(0), F.greatest(F.size(w) - width, F.lit(0)))).otherwise(F.array().cast("array<int>"))


def hashes(text: Column, width: int) -> Column:
    """Distinct hashes of a text's shingles."""
    return let(words(text), lambda w: F.array_distinct(F.transform(starts(w, width), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(width)]))))


def shingles(text: Column, width: int) -> Column:
    """Distinct shingles of a text."""
    return let(words(text), lambda w: F.array_distinct(F.transform(starts(w, width), lambda i: F.concat_ws(" ", F.slice(w, i + 1, width)))))


def sketches(items: DataFrame, share: float, width: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """``(item, grams, n)`` of the items, and the rows ``(size_class, h, item, need)`` of their bottom-k MinHash sketches.

    An item of ``n`` distinct shingles is contained if a document has ``need = ceil(share * n)`` of
    them, so at most ``n - need`` are missing, and of its ``n - need + 1`` shingles of the smallest hashes
    at least one is there.  These are its sketch: no contained item can be missed, however long the
    document is.  Its size class is the power of two below ``n``.
    """
    text = F.col(text_col)
    base = items.select(F.col(id_col).cast("long").alias("item"), shingles(text, width).alias("grams"), F.array_sort(hashes(text, width)).alias("h"))
    n = F.size("grams")
    need = F.ceil(n * share - 1e-9).cast("int")
    kept = cut(base.where(n > 0).select("item", "grams", n.alias("n"), need.alias("need"), F.slice("h", F.lit(1), n - need + 1).alias("h"), F.floor(F.log2(n)).cast("int").alias("size_class")))
    return kept.select("item", "grams", "n"), kept.select("size_class", F.explode("h").alias("h"), "item", "need")


def candidates(base: DataFrame, sketch: DataFrame, width: int, most_rows: int) -> DataFrame:
    """``(doc, same, item)``, once each: documents that have a shingle of an item's sketch.

    Every size class is searched by itself.  A document's sketch for a class are its shingles whose hash is not
    above the largest one in the class's sketches, and it has none for a class whose items need more shingles than
    it has.  Documents and items meet by class and hash; texts are not carried along.
    """
    classes = sketch.groupBy("size_class").agg(F.max("h").alias("top"), F.min("need").alias("need"), F.count(F.lit(1)).alias("n")).orderBy("size_class").collect()  # 31 rows at most
    each = [F.struct(F.lit(c.size_class).alias("size_class"), F.lit(c.top).cast("long").alias("top"), F.lit(c.need).alias("need")) for c in classes]
    if not each:
        return base.select("doc", "same", F.lit(0).cast("long").alias("item")).limit(0)

    def low(h: Column) -> Column:
        return F.flatten(F.transform(F.filter(F.array(*each), lambda c: c["need"] <= F.size(h)), lambda c: F.transform(F.filter(h, lambda x: x <= c["top"]), lambda x: F.struct(c["size_class"].alias("size_class"), x.alias("h")))))

    keys = base.select("doc", "same", F.explode(let(hashes(F.col("text"), width), low)).alias("key")).select("doc", "same", "key.size_class", "key.h")
    small = sum(c.n for c in classes) <= most_rows
    own = sketch.select("size_class", "h", "item")
    return keys.join(F.broadcast(own) if small else own, ["size_class", "h"]).select("doc", "same", "item").distinct()


def contaminated(docs: DataFrame, items: DataFrame, share: float = SHARE, width: int = WIDTH, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text", most_rows: int = MOST_ROWS, most_leaks: int = MOST_LEAKS) -> DataFrame:
    """``(id_col, same, item_col, shared, shingles)``: the documents that contain an item, row by row (``same``: hash of the text).

    Sketches give the candidates; each of them is verified once, by the intersection of the document's
    shingles with the item's, in time linear in both.  Sketches, candidates and items are broadcast while
    they are few, so that texts are not shuffled, and joined by a shuffle beyond.
    """
    item, sketch = sketches(items, share, width, item_col, text_col)
    base = docs.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(F.col(text_col).cast("string")).alias("same"), F.col(text_col).cast("string").alias("text"))
    pairs = cut(candidates(base, sketch, width, most_rows)).withColumnsRenamed({"doc": "d", "same": "s"})
    chars = item.agg(F.sum(F.length(F.array_join("grams", " ")))).first()[0] or 0
    few = pairs.count() <= most_leaks
    met = base.join(F.broadcast(pairs) if few else pairs, F.col("doc").eqNullSafe(F.col("d")) & (F.col("same") == F.col("s"))).drop("d", "s")
    hit = met.join(F.broadcast(item) if chars <= MOST_CHARS else item, "item")
    shared = F.size(F.array_intersect(shingles(F.col("text"), width), F.col("grams")))
    found = hit.select("doc", "same", "item", "n", shared.cast("long").alias("shared"))
    kept = found.where(F.col("shared") >= F.ceil(F.col("n") * share - 1e-9))
    return kept.groupBy(F.col("doc").alias(id_col), "same", F.col("item").alias(item_col)).agg(F.max("shared").alias("shared"), F.max("n").cast("long").alias("shingles"))


def report(docs: DataFrame, items: DataFrame, share: float = SHARE, width: int = WIDTH, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text", most_rows: int = MOST_ROWS, most_leaks: int = MOST_LEAKS) -> DataFrame:
    """One row per document and item that it contains: ``shared`` of the item's ``shingles``, and the ``containment``.

    Shingles are ``width`` words (lower-cased runs of letters and digits); those of an item count once
    each.  Fewer words are one shingle, which only a document of the same words has; items and documents
    without words (null, empty) match nothing.  Rows with the same id are one document, with its best match;
    null ids are an id of their own; repeated items all match, under their ids; empty tables give no
    rows; other columns are not looked at.
    """
    found = contaminated(docs, items, share, width, id_col, item_col, text_col, most_rows, most_leaks)
    best = found.groupBy(id_col, item_col).agg(F.max(F.struct("shared", "shingles")).alias("best"))
    return best.select(id_col, item_col, "best.shared", "best.shingles", (F.col("best.shared") / F.col("best.shingles")).alias("containment"))


def keep_clean(docs: DataFrame, items: DataFrame, share: float = SHARE, width: int = WIDTH, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that contain no item, unchanged.

    A row goes if its own text contains an item: other rows of its id stay, repeated rows go or stay
    together.  Null and empty texts stay, as do all rows where there are no items; a null id is an id like any
    other; an empty table gives no rows.
    """
    found = contaminated(docs, items, share, width, id_col, item_col, text_col)
    leaks = cut(found.select(F.col(id_col).alias("leak"), "same").distinct())
    side = F.broadcast(leaks) if leaks.count() <= MOST_LEAKS else leaks
    same = docs[id_col].cast("long").eqNullSafe(leaks["leak"]) & (F.xxhash64(docs[text_col].cast("string")) == leaks["same"])
    return docs.join(side, same, "left_anti")  # columns by frame: docs may have any names
