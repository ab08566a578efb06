"""Facet JSON: parsing (F1), brand from facets (F2), size values (N5 input),
facet identity (F6).

Facets stay a JSON string column until after any DISTINCT; these builders read
it with ``from_json`` twice: as ``map<string,string>`` for Python-like value
text (``1.0`` stays ``1.0``) and as ``map<string,variant>`` for value types.
Both keep document order, which is Python's dict order.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import pyregex as rx

# Fixed values (must equal the reference): null-like facet values.
NULL_WORDS = ["n/a", "null", "none", ""]
# Facet keys whose values are removed from labels.
SIZE_WEIGHT_KEYS = ["netWeight", "netVolume", "packetSize", "productWeight",
                    "productVolume", "servingSize"]
# Property markers stripped from facet values.
MARK_PREFIX = "^[❌✅]"

_NUMERIC = ("BIGINT", "INT", "SMALLINT", "TINYINT", "DOUBLE", "FLOAT", "DECIMAL")


def text_map(facets: Column) -> Column:
    """facet object as ``map<string,string>``; invalid / non-object -> null."""
    return F.from_json(facets, "map<string,string>")


def variant_map(facets: Column) -> Column:
    return F.from_json(facets, "map<string,variant>")


def json_kind(facets: Column) -> Column:
    """Type name of the top-level JSON value (null when absent or invalid)."""
    return F.schema_of_variant(F.try_parse_json(facets))


def _is_number(t: Column) -> Column:
    return F.regexp_extract(t, r"^([A-Z]+)", 1).isin(*_NUMERIC)


def py_truthy(text: Column, typ: Column) -> Column:
    """Python truthiness of a JSON value given its text and variant type."""
    return (F.when(typ == "STRING", text != "")
            .when(typ == "BOOLEAN", text == "true")
            .when(_is_number(typ), F.coalesce(text.cast("double") != 0, F.lit(True)))
            .when(typ.startswith("ARRAY"), text != "[]")
            .when(typ.startswith("OBJECT"), text != "{}")
            .otherwise(F.lit(False)))


def py_str(text: Column, typ: Column) -> Column:
    """Python ``str(value)`` for a JSON value (lists as Python's list repr)."""
    elems = F.from_json(text, "array<string>")
    list_repr = F.concat(
        F.lit("["),
        F.array_join(F.transform(elems, lambda e: F.concat(F.lit("'"), F.coalesce(e, F.lit("None")), F.lit("'"))), ", "),
        F.lit("]"))
    return (F.when(typ == "BOOLEAN", F.when(text == "true", "True").otherwise("False"))
            .when(typ.startswith("ARRAY"), list_repr)
            .otherwise(text))


def facets_usable(fm: Column, kind: Column, facets: Column) -> Column:
    """False when the reference's row processing would raise on these facets.

    A valid JSON document that is not an object and is truthy fails on ``.get``;
    null, numbers and booleans fail the ``key in facets`` test. Empty strings and
    empty arrays pass as empty facets. Invalid JSON is treated as ``{}``.
    """
    non_object = fm.isNull() & facets.isNotNull() & kind.isNotNull()
    bad = (kind.isin("VOID", "BOOLEAN") | _is_number(kind)
           | (kind.startswith("ARRAY") & (F.regexp_replace(facets, f"{rx.SPACE}", "") != "[]"))
           | ((kind == "STRING") & (F.try_variant_get(F.try_parse_json(facets), "$", "string") != "")))
    return ~(non_object & F.coalesce(bad, F.lit(False)))


def brand_from_facets(fm: Column, brand: Column) -> Column:
    """``facets.get('brandName', brand)``."""
    return F.coalesce(F.element_at(fm, F.lit("brandName")), brand)


def size_values(fm: Column, vm: Column) -> Column:
    """N5 input: distinct removal strings from the size/weight facets.

    For each key present and truthy: v = str(value).strip(); skip null-like;
    cleaned = v.lower() without [^\\w\\s]; if len(cleaned) > 2 keep cleaned and
    v.lower(). The reference iterates a set; the order is fixed here as length
    descending, then alphabetical. Only the keys a row actually has are
    examined (one lambda over the present keys, not six copies).
    """
    keys = F.array(*[F.lit(k) for k in SIZE_WEIGHT_KEYS])
    present = F.filter(keys, lambda k: F.element_at(fm, k).isNotNull())
    typed = F.transform(present, lambda k: F.struct(
        F.element_at(fm, k).alias("t"), F.schema_of_variant(F.element_at(vm, k)).alias("y")))
    valued = F.transform(F.filter(typed, lambda e: py_truthy(e["t"], e["y"])),
                         lambda e: F.lower(rx.strip(py_str(e["t"], e["y"]))))
    kept = F.filter(valued, lambda low: (low != "") & ~low.isin(*NULL_WORDS)
                    & (F.length(F.regexp_replace(low, rx.SPECIAL, "")) > 2))
    vals = F.array_distinct(F.flatten(F.transform(
        kept, lambda low: F.array(F.regexp_replace(low, rx.SPECIAL, ""), low))))
    return F.array_sort(vals, lambda a, b: (
        F.when(F.length(a) > F.length(b), -1).when(F.length(a) < F.length(b), 1)
        .when(a < b, -1).when(a > b, 1).otherwise(0)))


def _strip_mark(c: Column) -> Column:
    return F.regexp_replace(c, f"{MARK_PREFIX}{rx.SPACE}*", "")


def facet_part(key: Column, text: Column, typ: Column) -> Column:
    """One ``key:value`` part of the facet identity, or null when skipped."""
    # strings
    sv = rx.strip(text)
    s_ok = (sv != "") & ~F.lower(sv).isin(*(NULL_WORDS + ["❌ ", "✅ "]))
    s_clean = _strip_mark(sv)
    s_part = F.when(s_ok & (s_clean != ""), F.concat(key, F.lit(":"), s_clean))
    # lists
    etext = F.from_json(text, "array<string>")
    etype = F.transform(F.from_json(text, "array<variant>"), lambda v: F.schema_of_variant(v))
    cleaned = F.transform(
        F.arrays_zip(etext.alias("t"), etype.alias("k")),
        lambda e: F.when(py_truthy(e["t"], e["k"]) & (rx.strip(py_str(e["t"], e["k"])) != ""),
                         _strip_mark(rx.strip(py_str(e["t"], e["k"])))))
    kept = F.filter(cleaned, lambda c: c.isNotNull() & (c != "") & ~F.lower(c).isin(*NULL_WORDS))
    l_part = F.when(F.size(kept) > 0, F.concat(key, F.lit(":"), F.array_join(kept, " ")))
    return (F.when(typ == "STRING", s_part)
            .when(typ.startswith("ARRAY"), l_part)
            .when(typ == "BOOLEAN", F.concat(key, F.lit(":"), py_str(text, typ)))
            .when(_is_number(typ), F.concat(key, F.lit(":"), text)))


def facets_identity_raw(fm: Column, vm: Column, category: Column, categories: Column) -> Column:
    """F6 before phonetics/lowering: ``category:<cats> | key:value | ...``."""
    keys = F.map_keys(fm)
    parts = F.transform(keys, lambda k: facet_part(
        k, F.element_at(fm, k), F.schema_of_variant(F.element_at(vm, k))))
    cat_part = F.when(F.coalesce(category, F.lit("")) != "",
                      F.concat(F.lit("category:"), F.array_join(categories, " ")))
    return F.array_join(F.concat(F.array(cat_part), parts), " | ")
