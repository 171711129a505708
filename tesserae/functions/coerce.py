"""Coercions of free-form JSON values, as columns over VARIANT.

The rules are those of dynamic typing: a missing key takes the default, an explicit null is
coerced itself (text "None", false for flags, an error for numbers), and a flag
is the truth of any value, so that the text "false" is true.

Numbers become text the way VARIANT spells them (1.0 as "1"). ``strict`` raises on
values that cannot be coerced; otherwise they are null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def child(value: Column, key: str) -> Column:
    """The member ``key`` as VARIANT; null if it is missing."""
    return F.variant_get(value, f"$.{key}", "variant")


def _is(value: Column, scalar: str) -> Column:
    """Whether a value is of this scalar type. What kind of value it is, is told by Spark's own name of its type, which for scalars costs next to nothing."""
    return F.schema_of_variant(value) == scalar


def is_object(value: Column) -> Column:
    return F.try_variant_get(value, "$", "map<string,variant>").isNotNull()


def is_array(value: Column) -> Column:
    return F.try_variant_get(value, "$", "array<variant>").isNotNull()


def _fail(strict: bool, message: str, type_: str) -> Column:
    return F.raise_error(F.lit(message)).cast(type_) if strict else F.lit(None).cast(type_)


def text(value: Column, default: str | None = "") -> Column:
    plain = F.try_variant_get(value, "$", "string")
    flag = F.when(F.try_variant_get(value, "$", "boolean"), "True").otherwise("False")
    return F.when(value.isNull(), F.lit(default)).when(F.is_variant_null(value), "None").when(_is(value, "BOOLEAN"), flag).otherwise(plain)


def optional_text(value: Column) -> Column:
    """Null if missing or null, else as ``text``."""
    return F.when(value.isNull() | F.is_variant_null(value), F.lit(None)).otherwise(text(value))


def integer(value: Column, default: int = 0, strict: bool = False, type_: str = "int") -> Column:
    """Towards zero; texts only if they spell an integer."""
    spelt = F.trim(F.try_variant_get(value, "$", "string"))
    number = F.when(
        _is(value, "STRING"),
        F.when(spelt.rlike(r"^[+-]?[0-9]+$"), F.try_variant_get(F.try_parse_json(F.regexp_replace(spelt, r"^\+?(-?)0*(?=[0-9])", "$1")), "$", type_)),
    ).when(_is(value, "BOOLEAN"), F.try_variant_get(value, "$", "boolean").cast(type_)).otherwise(F.try_variant_get(value, "$", type_))
    return F.when(value.isNull(), F.lit(default).cast(type_)).otherwise(F.coalesce(number, _fail(strict, "not an integer", type_)))


def real(value: Column, default: float = 0.0, strict: bool = False) -> Column:
    number = F.try_variant_get(value, "$", "double")
    return F.when(value.isNull(), F.lit(default)).otherwise(F.coalesce(number, _fail(strict, "not a number", "double")))


def flag(value: Column, default: bool = False) -> Column:
    """The truth of any value."""
    text_, items_, members = F.try_variant_get(value, "$", "string"), F.try_variant_get(value, "$", "array<variant>"), F.try_variant_get(value, "$", "map<string,variant>")
    number = F.try_variant_get(value, "$", "double")
    return (
        F.when(value.isNull(), F.lit(default))
        .when(F.is_variant_null(value), F.lit(False))
        .when(items_.isNotNull(), F.size(items_) > 0)
        .when(members.isNotNull(), F.size(members) > 0)
        .when(_is(value, "BOOLEAN"), F.try_variant_get(value, "$", "boolean"))
        .when(_is(value, "STRING"), text_ != "")
        .otherwise(F.coalesce(number != 0, F.lit(True)))
    )


def items(value: Column, strict: bool = False, message: str = "expected a list") -> Column:
    """The elements of a list as VARIANTs; a missing list is empty, anything else an error (empty if not strict)."""
    empty = F.array().cast("array<variant>")
    found = F.try_variant_get(value, "$", "array<variant>")
    return F.when(value.isNull(), empty).otherwise(F.coalesce(found, _fail(True, message, "array<variant>") if strict else empty))


def objects(value: Column, strict: bool = False) -> Column:
    """The elements of a list that are objects; the others are dropped."""
    return F.filter(items(value, strict), is_object)


def texts(value: Column, strict: bool = False) -> Column:
    """A list of texts: nulls are dropped, everything else is spelt."""
    return F.transform(F.filter(items(value, strict), lambda x: ~F.is_variant_null(x)), lambda x: text(x))


def reals(value: Column) -> Column:
    """A vector: nulls are dropped; what is no list is empty."""
    return F.transform(F.filter(items(value), lambda x: ~F.is_variant_null(x)), lambda x: F.try_variant_get(x, "$", "double"))


def settings(value: Column) -> Column:
    """A free-form object as JSON text; anything else is empty."""
    return F.when(is_object(value), F.to_json(value)).otherwise("{}")
