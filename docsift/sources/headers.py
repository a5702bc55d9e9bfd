"""Width and height of images from the first bytes of their files, as Column expressions: nothing is decoded, and no Python runs."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docsift.functions.arrays import let
from docsift.functions.text import stem

#: Segments of a JPEG file that are looked through at once; where there are more, the search goes on from there.
SEGMENTS = 64


def number(content: Column, first: int | Column, size: int, little: bool = False) -> Column:
    """The unsigned number in size bytes, counted from 0; null beyond the end."""
    at = F.lit(first) if isinstance(first, int) else first
    digits = F.hex(F.substring(content, at + 1, F.lit(size)))
    if little:
        digits = F.concat(*(F.substring(digits, 2 * i + 1, 2) for i in range(size - 1, -1, -1)))
    return F.when(F.length(digits) == 2 * size, F.conv(digits, 16, 10).cast("long"))


def begins(content: Column, digits: str) -> Column:
    return F.hex(F.substring(content, 1, len(digits) // 2)) == digits


def jpeg_size(content: Column) -> Column:
    """struct(at, width, height): segments are passed over by their lengths up to the first that begins a frame. Null sizes: there is none, or the file ends before it."""
    end = F.octet_length(content)

    def step(state: Column, _: Column) -> Column:
        marker = number(content, state["at"], 2)

        def by(m: Column) -> Column:
            # frames are C0-CF but for C4, C8 and CC; D0-D8 and 01 stand alone; FF may be repeated as filling
            frame = m.between(0xFFC0, 0xFFCF) & ~m.isin(0xFFC4, 0xFFC8, 0xFFCC)
            alone = m.between(0xFFD0, 0xFFD8) | (m == 0xFF01)
            next_ = F.when(m == 0xFFFF, state["at"] + 1).when(alone, state["at"] + 2).when((m >= 0xFF00) & ~m.isin(0xFFD9, 0xFFDA), state["at"] + 2 + F.coalesce(F.greatest(number(content, state["at"] + 2, 2), F.lit(2)), end)).otherwise(end)
            found = F.struct(end.cast("long").alias("at"), number(content, state["at"] + 7, 2).alias("width"), number(content, state["at"] + 5, 2).alias("height"))
            on = F.struct(F.least(F.coalesce(next_, end), end).cast("long").alias("at"), state["width"].alias("width"), state["height"].alias("height"))
            return F.when(frame, found).otherwise(on)

        return F.when(state["at"] >= end, state).otherwise(let(marker, by))

    none = F.lit(None).cast("long")
    first = F.struct(F.lit(2).cast("long").alias("at"), none.alias("width"), none.alias("height"))
    turn = lambda state, _: F.when(state["at"] >= end, state).otherwise(F.aggregate(F.sequence(F.lit(1), F.lit(SEGMENTS)), state, step))
    # every segment has four bytes or more, so this many turns see all of any file
    turns = F.sequence(F.lit(1), F.greatest(F.lit(1), F.ceil(end / (2 * SEGMENTS))).cast("int"))
    return F.aggregate(turns, first, turn)


def image_size(content: Column) -> Column:
    """struct(kind, width, height, error) of a PNG, JPEG or BMP file. What can't be read has an error and null sizes."""
    none = F.lit(None).cast("long")
    of = lambda kind, w, h: F.struct(F.lit(kind).cast("string").alias("kind"), w.cast("int").alias("width"), h.cast("int").alias("height"))
    signed = lambda v: F.when(v >= 1 << 31, (1 << 32) - v).otherwise(v)  # noqa: E731  BMP: lines from the top down have a negative height
    jpeg = let(jpeg_size(content), lambda s: of("jpeg", s["width"], s["height"]))
    found = (
        F.when(begins(content, "89504E470D0A1A0A") & (F.hex(F.substring(content, 13, 4)) == "49484452"), of("png", number(content, 16, 4), number(content, 20, 4)))
        .when(begins(content, "424D") & (number(content, 14, 4, True) == 12), of("bmp", number(content, 18, 2, True), number(content, 20, 2, True)))
        .when(begins(content, "424D"), of("bmp", number(content, 18, 4, True), signed(number(content, 22, 4, True))))
        .when(begins(content, "FFD8FF"), jpeg)
        .otherwise(of(None, none, none))
    )
    error = lambda f: F.when(content.isNull() | (F.octet_length(content) == 0), "the file is empty").when(f["kind"].isNull(), "no image of a known kind").when(f["width"].isNull() | f["height"].isNull() | (f["width"] == 0) | (f["height"] == 0), "the header has no size")
    return let(found, lambda f: F.struct(f["kind"].alias("kind"), F.when(error(f).isNull(), f["width"]).alias("width"), F.when(error(f).isNull(), f["height"]).alias("height"), error(f).alias("error")))


def image_sizes(spark: SparkSession, path: str) -> DataFrame:
    """(stem, path, bytes, kind, width, height, error) of every image file below path; unreadable ones are rows with an error. Spark's reader passes over files without a byte."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{png,jpg,jpeg,bmp}").option("recursiveFileLookup", "true").load(path)
    return files.select(stem(F.col("path")).alias("stem"), "path", F.col("length").alias("bytes"), image_size(F.col("content")).alias("s")).select("stem", "path", "bytes", "s.*")
