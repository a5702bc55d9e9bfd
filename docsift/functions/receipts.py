"""Rule-based receipt parsing: one Column from text to a nested receipt, without a shuffle. The lines of a batch of texts are matched together, by Arrow's regular expressions, whose cost doesn't grow with the number of keywords."""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StringType, StructField, StructType

from docsift.functions.arrays import let
from docsift.functions.text import BLANKS, strip

# Keywords and patterns of the receipt grammar.
SKIP = [
    "total", "subtotal", "sub total", "tax", "service", "change", "cash", "credit", "disc", "discount", "ppn", "pbr", "charge", "payment", "member", "date", "time", "table", "cashier",
    "receipt", "invoice", "order", "bill", "thank", "terima",
    "valor", "troco", "dinheiro", "cartao", "cartão", "debito", "débito", "credito", "crédito", "cpf", "cnpj", "nf-e", "nfce", "cupom", "fiscal", "icms", "pis", "cofins", "operador", "caixa",
    "obrigado", "volte", "sempre", "consumidor", "emissao", "emissão", "chave", "acesso", "protocolo", "serie", "série", "numero", "número",
]
KEYWORDS = {
    "subtotal_price": ["subtotal", "sub total", "sub-total", "valor produtos"],
    "tax_price": ["tax", "ppn", "pajak", "vat", "icms", "imposto", "tributos"],
    "service_price": ["service", "servis", "svc", "taxa", "servico", "serviço"],
    "discount_price": ["discount", "disc", "diskon", "desconto", "desc"],
    "total_price": ["total", "grand total", "jumlah", "valor total", "vlr total"],
    "cashprice": ["cash", "tunai", "bayar", "dinheiro", "especie", "espécie"],
    "changeprice": ["change", "kembalian", "kembali", "troco"],
}
ITEM = r"^(.+?)\s+(?:(\d+)\s*x\s+)?(?:@?\s*[\d.,]+\s+)?([\d.,]+)\s*$"
PRICE = r"\d+[.,\d]*\d+"
SUB_TOTAL = ("subtotal_price", "tax_price", "service_price", "discount_price")
TOTAL = ("total_price", "cashprice", "changeprice")

LINE_ITEM_DDL = "struct<nm:string,cnt:string,unitprice:string,price:string,sub:string,num:string,discountprice:string>"
RECEIPT_DDL = (
    f"menu array<{LINE_ITEM_DDL}>, sub_total struct<subtotal_price:string,tax_price:string,service_price:string,discount_price:string,etc:string>, "
    "total struct<total_price:string,cashprice:string,changeprice:string,creditcardprice:string,menutype_cnt:string,menuqty_cnt:string,total_etc:string>"
)
#: The Brazilian invoice: every value is text.
INVOICE_DDL = (
    "cnpj string, razao_social string, endereco string, itens array<struct<descricao:string,quantidade:string,unidade:string,valor_unitario:string,valor_total:string>>, subtotal string, "
    "desconto string, valor_total string, forma_pagamento string, valor_pago string, troco string, impostos struct<icms:string,pis:string,cofins:string,valor_aproximado_tributos:string>, "
    "cpf_consumidor string, numero_nf string, serie string, data_emissao string, chave_acesso string"
)


def wide(pattern: str) -> str:
    """A pattern of Java under (?Ud), for Arrow: digits and white space are those of Unicode."""
    return pattern.replace(r"[\d.,\s]", rf"[\p{{Nd}}.,{BLANKS}]").replace(r"\d", r"\p{Nd}").replace(r"\s", f"[{BLANKS}]")


ITEM_PARTS = wide(ITEM).replace("x", "[xX]").replace("(.+?)", "(?P<nm>.+?)").replace(r"(\p{Nd}+)", r"(?P<n>\p{Nd}+)").replace(r"([\p{Nd}.,]+)", r"(?P<price>[\p{Nd}.,]+)")
NO_NAME = wide(r"^[\d.,\s]+$")
#: The last match of PRICE in a line: from the first to the last digit of a run of digits, dots and commas.
LAST_PRICE = wide(r"^(?:.*[^\d.,])?[.,]*(?P<price>\d[\d.,]*\d)")


def _has_any(lines: pa.Array, words: list[str]) -> pa.Array:
    """Whether lower-cased lines hold any of the words, anywhere."""
    return pc.match_substring_regex(lines, "|".join(words))


def _first(values: pa.Array, of: np.ndarray, n: int) -> pa.Array:
    """The first value of each of n texts; of: each value's text, ascending."""
    at = np.full(n, -1)
    own, place = np.unique(of, return_index=True)
    at[own] = place
    return values.take(pa.array(at, mask=at < 0))


def keyword_prices(lows: pa.Array, of: np.ndarray, n: int) -> dict[str, pa.Array]:
    """For each kind of price the last price of the first line that holds a keyword and a price; null if none does."""
    some = _has_any(lows, [w for ws in KEYWORDS.values() for w in ws])
    lows, of = lows.filter(some), of[some.to_numpy(zero_copy_only=False)]
    price = pc.struct_field(pc.extract_regex(lows, LAST_PRICE), "price")
    there = price.is_valid()
    lows, price, of = lows.filter(there), price.filter(there), of[there.to_numpy(zero_copy_only=False)]
    out = {}
    for kind, words in KEYWORDS.items():
        own = _has_any(lows, words)
        out[kind] = _first(price.filter(own), of[own.to_numpy(zero_copy_only=False)], n)
    return out


def menu_items(lines: pa.Array, lows: pa.Array, of: np.ndarray, n: int) -> pa.Array:
    """For each text the lines that read as items, in order, as structs with nm, cnt ("2 x") and price."""
    open_ = pc.invert(_has_any(lows, SKIP))
    parts = pc.extract_regex(pc.utf8_trim(lines.filter(open_), characters=BLANKS), ITEM_PARTS)
    nm = pc.struct_field(parts, "nm")
    named = pc.fill_null(pc.and_(pc.greater_equal(pc.utf8_length(nm), 2), pc.invert(pc.match_substring_regex(nm, NO_NAME))), False)
    of = of[open_.to_numpy(zero_copy_only=False)][named.to_numpy(zero_copy_only=False)]
    nm, count, price = (pc.struct_field(parts, k).filter(named) for k in ("nm", "n", "price"))
    cnt = pc.if_else(pc.fill_null(pc.not_equal(count, ""), False), pc.binary_join_element_wise(count, "x", " "), None)
    null = pa.nulls(len(nm), pa.string())
    kinds = {"nm": nm, "cnt": cnt, "unitprice": null, "price": price, "sub": null, "num": null, "discountprice": null}
    items = pa.StructArray.from_arrays([v.cast(pa.string()) for v in kinds.values()], list(kinds))
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(n + 1)), pa.int32()), items)


def _texts(*names: str) -> StructType:
    return StructType([StructField(n, StringType()) for n in names])


REST = ("creditcardprice", "menutype_cnt", "menuqty_cnt", "total_etc")
#: As RECEIPT_DDL has it, without a session.
RECEIPT = StructType([
    StructField("menu", ArrayType(_texts("nm", "cnt", "unitprice", "price", "sub", "num", "discountprice"))),
    StructField("sub_total", _texts(*SUB_TOTAL, "etc")), StructField("total", _texts(*TOTAL, *REST)),
])


def found(text: pa.Array, low: pa.Array) -> tuple[dict[str, pa.Array], pa.Array]:
    """The prices and the menus of texts."""
    lists = pc.split_pattern(text, "\n")
    of = pc.list_parent_indices(lists).to_numpy()
    lines, lows = pc.list_flatten(lists), pc.list_flatten(pc.split_pattern(low, "\n"))
    return {k: v.cast(pa.string()) for k, v in keyword_prices(lows, of, len(text)).items()}, menu_items(lines, lows, of, len(text))


@F.arrow_udf(RECEIPT)
def parsed(text: pa.Array, low: pa.Array) -> pa.Array:
    null = pa.nulls(len(text), pa.string())
    prices, menu = found(text, low)
    sub = [prices[k] for k in SUB_TOTAL]
    none = np.logical_and.reduce([v.is_null().to_numpy(zero_copy_only=False) for v in sub])
    sub_total = pa.StructArray.from_arrays([*sub, null], [*SUB_TOTAL, "etc"], mask=pa.array(none))
    total = pa.StructArray.from_arrays([*(prices[k] for k in TOTAL), *(null for _ in REST)], [*TOTAL, *REST])
    return pa.StructArray.from_arrays([menu, sub_total, total], ["menu", "sub_total", "total"])


@F.arrow_udf(MapType(StringType(), StringType()))
def parsed_fields(text: pa.Array, low: pa.Array) -> pa.Array:
    """fields(parse_receipt(text)) without the receipt between; null for null."""
    n, parts = len(text), ("nm", "cnt", "price")
    prices, menu = found(pc.fill_null(text, ""), pc.fill_null(low, ""))
    fixed = [(f"{a}.{k}", prices[k]) for a, ks in (("total", TOTAL), ("sub_total", SUB_TOTAL)) for k in ks]
    items, sizes = menu.flatten(), np.diff(menu.offsets.to_numpy())
    t = len(items)
    place = np.arange(t) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    names = pa.array([k for k, _ in fixed] + [f"menu.{i}.{k}" for i in range(int(sizes.max(initial=0))) for k in parts], pa.string())
    values = pa.concat_arrays([v for _, v in fixed] + [pc.struct_field(items, k) for k in parts])
    key = np.concatenate([np.repeat(np.arange(len(fixed)), n), *(len(fixed) + len(parts) * place + i for i in range(len(parts)))])
    row = np.concatenate([np.tile(np.arange(n), len(fixed)), np.tile(np.repeat(np.arange(n), sizes), len(parts))])
    there = np.flatnonzero(pc.not_equal(pc.fill_null(values, ""), "").to_numpy(zero_copy_only=False) & text.is_valid().to_numpy(zero_copy_only=False)[row])
    there = there[np.lexsort((key[there], row[there]))]
    offsets = np.searchsorted(row[there], np.arange(n + 1)).astype(np.int32)
    return pa.MapArray.from_arrays(pa.array(offsets, mask=np.append(text.is_null().to_numpy(zero_copy_only=False), False)), names.take(pa.array(key[there])), values.take(pa.array(there)))


def parse_receipt(text: Column) -> Column:
    """struct(menu, sub_total, total); sub_total is null if it has no value, total never is."""
    whole = F.coalesce(text, F.lit(""))
    return parsed(whole, F.lower(whole))


def field_entries(receipt: Column) -> Column:
    """The receipt's values as an array of (field, value), in order: total, sub_total, menu by position. Empty values are left out."""
    entry = lambda name, value: F.struct(name.alias("field"), value.alias("value"))

    def entries(r: Column) -> Column:
        fixed = [entry(F.lit(f"total.{k}"), r["total"][k]) for k in TOTAL] + [entry(F.lit(f"sub_total.{k}"), r["sub_total"][k]) for k in SUB_TOTAL]
        items = F.flatten(F.transform(r["menu"], lambda m, i: F.array(*(entry(F.concat(F.lit("menu."), i.cast("string"), F.lit(f".{k}")), m[k]) for k in ("nm", "cnt", "price")))))
        every = F.concat(F.array(*fixed), F.coalesce(items, F.array().cast("array<struct<field:string,value:string>>")))
        return F.filter(every, lambda e: F.coalesce(e["value"], F.lit("")) != "")

    return let(receipt, entries)


def simple_items(receipt: Column) -> Column:
    """The items as an array of (nm, price): names in lower case, both trimmed, null counting as empty."""
    clean = lambda c: strip(F.coalesce(c, F.lit("")))
    return F.transform(receipt["menu"], lambda m: F.struct(F.lower(clean(m["nm"])).alias("nm"), clean(m["price"]).alias("price")))


def fields(receipt: Column) -> Column:
    return F.map_from_entries(field_entries(receipt))


def text_fields(text: Column) -> Column:
    """fields(parse_receipt(text)) of a text that isn't null, else null."""
    return parsed_fields(text, F.lower(text))


def repaired(text: Column) -> Column:
    """JSON without trailing commas."""
    return F.regexp_replace(text, r",(\s*[}\]])", "$1")


def is_object(text: Column) -> Column:
    """Whether a model's answer is a JSON object at all; false for null."""
    return F.from_json(repaired(F.coalesce(text, F.lit(""))), "map<string,string>").isNotNull()


def from_model_json(text: Column, ddl: str = RECEIPT_DDL, menu: str | None = "menu") -> Column:
    """A model's answer as a struct: trailing commas are repaired, a single item is a list of one, and a missing total is an empty one."""
    text = repaired(text)
    if menu is None:
        return F.from_json(text, ddl)
    none = F.from_json(F.lit("{}"), RECEIPT_DDL.split(", total ")[1][len("struct<") : -1].replace(":", " "))

    def whole(r: Column) -> Column:
        single = let(F.from_json(text, f"{menu} {LINE_ITEM_DDL}")[menu], lambda x: F.when(x.isNotNull(), F.array(x)))
        return r.withField(menu, F.coalesce(r[menu], single)).withField("total", F.coalesce(r["total"], none))

    return let(F.from_json(text, ddl), whole)


def prompt(text: Column, few_shot: tuple[str, str] | None = None, instruction: str = "Return the receipt below as JSON with menu, sub_total and total. Keep prices as they are printed.") -> Column:
    parts = [F.lit(instruction)]
    if few_shot:
        parts += [F.lit(f"Receipt:\n{few_shot[0]}\nJSON:\n{few_shot[1]}")]
    return F.concat_ws("\n\n", *parts, F.concat(F.lit("Receipt:\n"), text, F.lit("\nJSON:")))
