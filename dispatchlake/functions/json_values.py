"""Reading single values out of a VARIANT record, without coercing one type to another."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dispatchlake.functions.guards import finite_only

# Fixed value: largest integer a double holds exactly.
MAX_SAFE = 2**53 - 1
NUMBER = r"^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL)"
# A JSON string; after it, when it is a key, the beginning of its value.
STRING = r'"(?:[^"\\]++|\\.)*+"'
KEY_AND_VALUE = r'"((?:[^"\\]++|\\.)*+)"(?:\s*:(?=\s*(\[|\{|"|[^\s,}\]]+)))?'
DUPLICATES_CONF = "spark.sql.variant.allowDuplicateKeys"
# Methods beyond this many bytes of code are never compiled by the JVM, only interpreted.
METHOD_CONF, METHOD_LIMIT = "spark.sql.codegen.hugeMethodLimit", "8000"


def allow_repeated_keys(spark: SparkSession) -> None:
    """Let the last of repeated keys win, as JSON readers commonly do.

    The strict profile finds repeated keys on its own (see ``sources.strict``). Typing reads
    dozens of members in one stage; generated as one method it would stay interpreted, so such
    stages are generated in small methods.
    """
    for name, value in ((DUPLICATES_CONF, "true"), (METHOD_CONF, METHOD_LIMIT)):
        if spark.conf.get(name) != value:
            spark.conf.set(name, value)


def whole_document(text: Column) -> Column:
    """Parse ``text`` as exactly one JSON value, NULL otherwise.

    The parser stops after the first value. Wrapping the text in a list and in an
    object exposes anything behind it: what closes one wrapper early is an error
    in the other, and a second list element is visible. A text without a closing
    bracket cannot close the list, so the object is parsed for the others alone.
    """
    # Both uses are evaluated always, so that the list is parsed once.
    listed = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))), "$", "array<variant>")
    wrapped = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))
    closed_last = ~F.contains(text, F.lit("]")) | wrapped.isNotNull()
    return F.get(listed, F.when((F.size(listed) == 1) & closed_last, F.lit(0)))


def field(raw: Column, name: str) -> Column:
    """A member as VARIANT: SQL NULL when absent, a VOID variant for JSON null."""
    return F.try_variant_get(raw, f"$.{name}", "variant")


def member(found: Column, name: str) -> Column:
    """``field`` out of a map of members."""
    return F.element_at(found, F.lit(name))


def first_present(found: Column, names: Sequence[str]) -> Column:
    """The first of a map of members that is there at all, even if its value is of no use."""
    return F.coalesce(*[member(found, n) for n in names])


def any_present(found: Column, names: Sequence[str]) -> Column:
    return first_present(found, names).isNotNull()


def is_number(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value).rlike(NUMBER), F.lit(False))


def is_type(value: Column, prefix: str) -> Column:
    """Told by how the value is written where that settles it, as naming the type of a value takes longer."""
    written = F.to_json(value)
    named = F.schema_of_variant(value).startswith(prefix)
    # Numbers beyond all bounds are written like texts.
    told = {"STRING": written.startswith('"') & (~written.isin('"Infinity"', '"-Infinity"', '"NaN"') | named), "OBJECT": written.startswith("{"), "BOOLEAN": written.isin("true", "false"), "VOID": written == "null"}
    return F.coalesce(told.get(prefix, named), F.lit(False))


def number(value: Column) -> Column:
    """A JSON number as DOUBLE; texts and booleans are not numbers."""
    return F.when(is_number(value), F.try_variant_get(value, "$", "double"))


def finite_number(value: Column) -> Column:
    return finite_only(number(value))


def non_negative(value: Column) -> Column:
    found = finite_number(value)
    return F.when(found >= 0, found)


def text(value: Column) -> Column:
    """A JSON text that is not empty."""
    return F.nullif(F.when(is_type(value, "STRING"), F.try_variant_get(value, "$", "string")), F.lit(""))


def boolean(value: Column) -> Column:
    return F.when(is_type(value, "BOOLEAN"), F.try_variant_get(value, "$", "boolean"))


def safe_integer(value: Column, plain: Column | None = None) -> Column:
    """An integer written as such, within the exactly representable range.

    ``plain`` tells that the record has nothing but integers that could be read as one (see ``sources.strict``);
    else the type of the value decides, which takes longer to name.
    """
    found = F.try_variant_get(value, "$", "bigint")
    integer = is_type(value, "BIGINT")
    return F.when((integer if plain is None else plain | integer) & (F.abs(found) <= MAX_SAFE), found)


def members(value: Column) -> Column:
    """The object as a map from key to VARIANT; NULL for anything else.

    ``field`` walks the whole record for every name, and most names that a report asks
    for are not in it. Where many are asked for, take the members once and use ``member``.
    """
    return F.try_variant_get(value, "$", "map<string,variant>")
