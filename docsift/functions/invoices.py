"""Brazilian invoices from a model: the prompt, and the answer as a struct whose values are all text, with what is wrong with it."""

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from docsift.functions.openjson import validated
from docsift.functions.receipts import INVOICE_DDL

INSTRUCTION = "Leia o cupom fiscal abaixo e devolva somente JSON válido. Todo valor é texto entre aspas, como está impresso; o que não aparece é null. Chaves:"


def keys(shape: StructType) -> str:
    """The shape's keys in one line, nested ones in brackets."""
    inner = lambda kind: kind if isinstance(kind, StructType) else getattr(kind, "elementType", None)
    return ", ".join(f.name + (f" ({keys(inner(f.dataType))})" if isinstance(inner(f.dataType), StructType) else "") for f in shape)


def invoice_prompt(text: Column, instruction: str = INSTRUCTION) -> Column:
    return F.concat(F.lit(f"{instruction} {keys(StructType.fromDDL(INVOICE_DDL))}.\n\nTexto:\n"), F.coalesce(text, F.lit("")), F.lit("\n\nJSON:"))


def parse_invoice(answer: Column) -> Column:
    """struct(value, errors). Numbers and booleans become texts; no items are an empty list; errors name each path that doesn't fit."""
    return validated(answer, INVOICE_DDL, required=(), never_null=("itens",))
