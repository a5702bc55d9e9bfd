"""Text clean-up as Column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters that stand for digits in numeric tokens, and the digits.
LOOKALIKES, DIGITS = "OolISBZ", "0011582"
LINE_BREAKS = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\u0085  ]"

#: White space as (?U)\s has it.
BLANKS = "\t\n\x0b\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.btrim(c, F.lit(BLANKS))


def tokens(c: Column) -> Column:
    """The runs of anything but white space; an empty text has none."""
    return F.filter(F.split(c, r"(?U)\s+"), lambda t: t != "")


def correct_numeric(c: Column) -> Column:
    """In tokens that hold a digit, or only lookalikes, dots and commas, lookalikes become digits. Tokens are joined by blanks."""
    numeric = lambda t: t.rlike(r"(?U)\d") | t.rlike(rf"^[.,{LOOKALIKES}]+$")
    return F.array_join(F.transform(tokens(c), lambda t: F.when(numeric(t), F.translate(t, LOOKALIKES, DIGITS)).otherwise(t)), " ")


def lines(c: Column) -> Column:
    """The stripped lines that aren't empty."""
    return F.filter(F.transform(F.split(c, LINE_BREAKS), strip), lambda x: x != "")


def normalize_whitespace(c: Column) -> Column:
    """Blanks and tabs become one blank, lines are stripped, empty lines go."""
    return F.array_join(lines(F.regexp_replace(c, "[ \t]+", " ")), "\n")


def clean_line(c: Column) -> Column:
    """Numeric correction, then white space: the order of the extraction pipeline."""
    return normalize_whitespace(correct_numeric(c))


def clean_box(c: Column) -> Column:
    """White space, then numeric correction: the order of stand-alone post-processing."""
    return correct_numeric(normalize_whitespace(c))


def price_key(c: Column) -> Column:
    """A price without separators, for comparing."""
    return F.translate(c, ",.", "")


def stem(path: Column) -> Column:
    """The file name without its folder and extension."""
    return F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)


def zero_padded(i: Column, width: int = 4) -> Column:
    return F.when(F.length(i.cast("string")) >= width, i.cast("string")).otherwise(F.lpad(i.cast("string"), width, "0"))
