"""JSON without a fixed shape, as variants: keys that are there but null, values of any kind as text, and what is wrong with an answer, path by path."""

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StringType, StructField, StructType

from docsift.functions.arrays import let
from docsift.functions.receipts import RECEIPT_DDL, repaired

#: The fields whose completeness is reported. Those of items count items, the others receipts.
FIELDS = (
    "menu", "sub_total", "total", "menu.nm", "menu.cnt", "menu.price", "menu.unitprice", "sub_total.subtotal_price", "sub_total.tax_price", "sub_total.service_price",
    "total.total_price", "total.cashprice", "total.changeprice",
)


def parsed(text: Column) -> Column:
    """A variant; null if the text isn't JSON even without its trailing commas."""
    return F.coalesce(F.try_parse_json(text), F.try_parse_json(repaired(text)))


def at(v: Column, key: str) -> Column:
    """The value of a key, a variant null if it is null; null if there is no such key or v isn't an object."""
    return F.try_variant_get(v, f"$['{key}']", "variant")


def has(v: Column, key: str) -> Column:
    return at(v, key).isNotNull()


def kind(v: Column) -> Column:
    """OBJECT, ARRAY, STRING, BOOLEAN, BIGINT, DECIMAL, DOUBLE, or VOID for a variant null. Objects and lists are told by a cast that copies nothing of them; only a scalar's schema is asked for."""
    is_a = lambda x, ddl: F.try_variant_get(x, "$", ddl).isNotNull()
    scalar = lambda x: F.regexp_extract(F.schema_of_variant(x), "^[A-Z]+", 0)
    return let(v, lambda x: F.when(F.is_variant_null(x), "VOID").when(is_a(x, "struct<none:boolean>"), "OBJECT").when(is_a(x, "array<struct<none:boolean>>"), "ARRAY").otherwise(scalar(x)))


def elements(v: Column) -> Column:
    """An array's elements; an object is a list of one; an empty list for anything else."""
    none = F.array().cast("array<variant>")
    return let(v, lambda x: F.coalesce(F.when(kind(x) == "OBJECT", F.array(x)).otherwise(F.try_variant_get(x, "$", "array<variant>")), none))


def float_text(x: Column) -> Column:
    """A double as the shortest text with a decimal point: 12.0, 94.51, and 12345678.5 rather than an exponent below 1e16."""
    plain = F.regexp_replace(x.cast("decimal(38,9)").cast("string"), r"(\.\d+?)0+$", "$1")
    return F.when((F.abs(x) >= 1e7) & (F.abs(x) < 1e16), plain).otherwise(x.cast("string"))


def text_of(v: Column) -> Column:
    """A scalar as text: True and False, whole numbers as they are, others with a decimal point. Null for a null, an object or an array."""

    def text(x: Column) -> Column:
        whole = F.try_variant_get(x, "$", "string")

        def by(k: Column) -> Column:
            long = k.startswith("DECIMAL") & (F.regexp_extract(k, r"\((\d+),0\)", 1).try_cast("int") >= 19)  # a whole number beyond a long
            return (
                F.when(k.isin("STRING", "BIGINT") | long, whole)
                .when(k == "BOOLEAN", F.initcap(whole))
                .when(k.startswith("DECIMAL") | k.isin("DOUBLE", "FLOAT"), float_text(F.try_variant_get(x, "$", "double")))
            )

        return F.when(~kind(x).isin("VOID", "OBJECT", "ARRAY"), let(F.schema_of_variant(x), by))

    return let(v, lambda x: F.when(x.isNotNull(), text(x)))


# --- completeness ---------------------------------------------------------------------------------------------------


def having(key: str):
    return lambda x: has(x, key)


def having_null(key: str):
    return lambda x: F.coalesce(F.is_variant_null(at(x, key)), F.lit(False))


def presence(v: Column, fields: tuple[str, ...] = FIELDS, items: str = "menu") -> Column:
    """struct(n_items, and for each field how often it is there and how often it is null) of one receipt. Each value is taken out of the answer once."""
    tops = list(dict.fromkeys([items, *(f.partition(".")[0] for f in fields)]))

    def counted(taken: Column, own: Column) -> Column:
        parts = [F.size(own).alias("n_items")]
        for i, f in enumerate(fields):
            outer, _, inner = f.partition(".")
            if inner and outer == items:
                there, null = F.size(F.filter(own, having(inner))), F.size(F.filter(own, having_null(inner)))
            else:
                value = at(taken[outer], inner) if inner else taken[outer]
                there, null = value.isNotNull().cast("int"), F.coalesce(F.is_variant_null(value), F.lit(False)).cast("int")
            parts += [there.alias(f"there_{i}"), null.alias(f"null_{i}")]
        return F.struct(*parts)

    each = lambda taken: F.filter(elements(taken[items]), lambda i: kind(i) == "OBJECT")
    return let(F.struct(*(at(v, k).alias(k) for k in tops)), lambda taken: let(each(taken), lambda own: counted(taken, own)))


# --- answers of a known shape ---------------------------------------------------------------------------------------


def typed(v: Column, shape: DataType) -> Column:
    """A variant as a value of this shape, whose scalars are texts. What doesn't fit is null; a single object counts as a list of one, a missing list as an empty one."""
    below = lambda kind: lambda x: typed(x, kind)
    if isinstance(shape, StructType):
        parts = F.struct(*(let(at(v, f.name), below(f.dataType)).alias(f.name) for f in shape))
        return F.when(v.isNotNull() & (kind(v) == "OBJECT"), parts)
    if isinstance(shape, ArrayType):
        none = F.array().cast(ArrayType(as_texts(shape.elementType)))
        return F.when(v.isNull(), none).when(kind(v).isin("OBJECT", "ARRAY"), F.transform(elements(v), below(shape.elementType)))
    return text_of(v)


def problems(v: Column, shape: DataType, path: Column | None = None, required: tuple[str, ...] = (), never_null: tuple[str, ...] = ()) -> Column:
    """An array of texts like "sub_total.tax_price: text expected": one for each path whose value doesn't fit, in the shape's order. Missing keys fit, unless required, and nulls, unless never_null.

    Each value is taken out of the answer once, and a key that isn't there is looked at no further.
    """
    none = F.array().cast("array<string>")
    name = F.lit("answer") if path is None else path
    wrong = lambda what: F.array(F.concat(name, F.lit(f": {what} expected")))
    below = lambda key: F.lit(key) if path is None else F.concat(path, F.lit(f".{key}"))

    def of(f: StructField):
        def found(x: Column) -> Column:
            own = F.when(x.isNull(), none).otherwise(problems(x, f.dataType, below(f.name)))
            if f.name in required:
                own = F.when(x.isNull() | F.coalesce(F.is_variant_null(x), F.lit(False)), F.array(F.concat(below(f.name), F.lit(": missing")))).otherwise(own)
            if f.name in never_null:
                own = F.when(F.coalesce(F.is_variant_null(x), F.lit(False)), F.array(F.concat(below(f.name), F.lit(": null")))).otherwise(own)
            return own

        return found

    def by(k: Column) -> Column:
        absent = F.coalesce(k == "VOID", F.lit(True))
        if isinstance(shape, StructType):
            found = F.when(k == "OBJECT", F.concat(*(let(at(v, f.name), of(f)) for f in shape))).otherwise(wrong("object"))
            return found if path is None else F.when(absent, none).otherwise(found)
        if isinstance(shape, ArrayType):
            place = lambda i: F.concat(name, F.lit("["), i.cast("string"), F.lit("]"))
            each = F.flatten(F.transform(elements(v), lambda x, i: F.when(F.coalesce(F.is_variant_null(x), F.lit(True)), F.array(F.concat(place(i), F.lit(": object expected")))).otherwise(problems(x, shape.elementType, place(i)))))
            return F.when(absent, none).when(k.isin("OBJECT", "ARRAY"), each).otherwise(wrong("list"))
        return F.when(absent | ~k.isin("OBJECT", "ARRAY"), none).otherwise(wrong("text"))

    return let(kind(v), by)


def as_texts(shape: DataType) -> DataType:
    """The shape with texts for all scalars."""
    if isinstance(shape, StructType):
        return StructType([StructField(f.name, as_texts(f.dataType)) for f in shape])
    return ArrayType(as_texts(shape.elementType)) if isinstance(shape, ArrayType) else StringType()


def validated(text: Column, ddl: str = RECEIPT_DDL, required: tuple[str, ...] = ("total",), never_null: tuple[str, ...] = ("menu",)) -> Column:
    """struct(value, errors) of a model's answer. errors is empty if it fits; value has all that does. No JSON at all: a null value and one error."""
    shape = StructType.fromDDL(ddl)

    def both(v: Column) -> Column:
        errors = F.when(v.isNull(), F.array(F.lit("answer: JSON expected"))).otherwise(problems(v, shape, required=required, never_null=never_null))
        return F.struct(typed(v, shape).alias("value"), errors.alias("errors"))

    return let(parsed(F.coalesce(text, F.lit(""))), both)
