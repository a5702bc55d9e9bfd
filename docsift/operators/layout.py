"""From recognised boxes (doc_id, seq, text, confidence, bbox) to lines and text. A document's boxes are gathered in one array (doc_id, boxes), and worked on
there: no task sorts or groups boxes beyond one document at a time, so its memory goes by texts, not by boxes."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsift.functions.text import clean_line

Y_THRESHOLD = 10


def gathered(boxes: DataFrame) -> DataFrame:
    """(doc_id, boxes): a row for each document, with its boxes in an array, in any order."""
    return boxes.groupBy("doc_id").agg(F.collect_list(F.struct("seq", "text", "confidence", "bbox")).alias("boxes"))


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is worked out once, however often f names it."""
    return F.transform(F.array(value), f)[0]


def lines_of(boxes: Column, y_threshold: int = Y_THRESHOLD) -> Column:
    """The lines of an array of boxes, each an array of its boxes. Boxes in order of (y1, x1, seq) share a line while each lies within the
    threshold of the one before; a box without bbox sorts at (0, 0) and is a line of its own."""
    keyed = F.transform(boxes, lambda b: F.struct(F.coalesce(b["bbox"]["y1"], F.lit(0)).alias("y"), F.coalesce(b["bbox"]["x1"], F.lit(0)).alias("x"), b["seq"].alias("seq"), b["text"].alias("text"), b["confidence"].alias("confidence"), b["bbox"].alias("bbox")))
    near = lambda own, b, i: F.abs(b["bbox"]["y1"] - F.get(own, i - 1)["bbox"]["y1"]) <= y_threshold
    starts = lambda own: F.filter(F.transform(own, lambda b, i: F.when(near(own, b, i), None).otherwise(i)), lambda i: i.isNotNull())
    cut = lambda own, at: F.transform(at, lambda i, k: F.slice(own, i + 1, F.coalesce(F.get(at, k + 1), F.size(own)) - i))
    return bound(F.sort_array(keyed), lambda own: bound(starts(own), lambda at: cut(own, at)))


def line_text(line: Column) -> Column:
    """A line's texts by x1, joined by blanks."""
    return F.array_join(F.sort_array(F.transform(line, lambda b, i: F.struct(b["x"].alias("x"), i.alias("at"), b["text"].alias("text"))))["text"], " ")


def mean_confidence(line: Column) -> Column:
    known = F.filter(line["confidence"], lambda c: c.isNotNull())
    return bound(known, lambda k: F.when(F.size(k) > 0, F.aggregate(k, F.lit(0.0), lambda a, c: a + c.cast("double")) / F.size(k)))


def union_box(line: Column) -> Column:
    """The box around those of a line; null if none has a place."""
    every = line["bbox"]
    return F.when(F.array_min(every["x1"]).isNotNull(), F.struct(*(f(every[c]).alias(c) for c, f in (("x1", F.array_min), ("y1", F.array_min), ("x2", F.array_max), ("y2", F.array_max)))))


def not_blank(pages: DataFrame, text: Column) -> DataFrame:
    """(doc_id, text) where it isn't empty. By a generator: a filter would have the text worked out twice."""
    return pages.select("doc_id", F.explode_outer(F.filter(F.array(text), lambda t: t != "")).alias("text")).where("text is not null")


def page_lines(pages: DataFrame, y_threshold: int = Y_THRESHOLD) -> DataFrame:
    """(doc_id, line_no, text, confidence, bbox) of gathered boxes."""
    line = F.col("line")
    each = pages.select("doc_id", F.posexplode_outer(lines_of(F.col("boxes"), y_threshold)).alias("at", "line")).where("at is not null")
    return each.select("doc_id", (F.col("at") + 1).alias("line_no"), line_text(line).alias("text"), mean_confidence(line).alias("confidence"), union_box(line).alias("bbox"))


def page_order(pages: DataFrame) -> DataFrame:
    """(doc_id, text) of gathered boxes: their texts by y1, one a line, without blank ones."""
    kept = F.filter("boxes", lambda b: F.trim(b["text"]) != "")
    word = lambda b: F.struct(F.coalesce(b["bbox"]["y1"], F.lit(0)).alias("y"), b["seq"].alias("seq"), b["text"].alias("text"))
    return not_blank(pages, F.array_join(F.sort_array(F.transform(kept, word))["text"], "\n"))


def page_text(pages: DataFrame, y_threshold: int = Y_THRESHOLD) -> DataFrame:
    """(doc_id, text) of gathered boxes: merged lines, cleaned, without blank ones."""
    cleaned = F.transform(lines_of(F.col("boxes"), y_threshold), lambda line: clean_line(line_text(line)))
    return not_blank(pages, F.array_join(F.filter(cleaned, lambda t: t != ""), "\n"))


def merge_lines(boxes: DataFrame, y_threshold: int = Y_THRESHOLD) -> DataFrame:
    """(doc_id, line_no, text, confidence, bbox)."""
    return page_lines(gathered(boxes), y_threshold)


def reading_order(boxes: DataFrame) -> DataFrame:
    """(doc_id, text): the boxes' texts by y1, one a line, without blank ones."""
    return page_order(gathered(boxes.where(F.trim("text") != "")))


def document_text(boxes: DataFrame, y_threshold: int = Y_THRESHOLD) -> DataFrame:
    """(doc_id, text): merged lines, cleaned, without blank ones."""
    return page_text(gathered(boxes), y_threshold)


def usable_tokens(words: DataFrame) -> DataFrame:
    """Without blank words and words of negative confidence."""
    return words.where((F.trim(F.coalesce("text", F.lit(""))) != "") & (F.col("confidence") >= 0))
