"""Text fields: rating messages, id lists, ids given as text."""

from pyspark.sql import Column, functions as F

# Accepted user name length, in characters.
NAME_MIN, NAME_MAX = 3, 25


def message_field(value, position: int) -> Column:
    """Field ``position`` (from 1) of a comma-separated message, without quotes."""
    field = F.try_element_at(F.split(value, ",", -1), F.lit(position))
    return F.replace(field, F.lit('"'), F.lit(""))


def to_int(text: Column) -> Column:
    """Strict integer: sign and digits only, null for everything else."""
    return F.when(text.rlike(r"^[+-]?[0-9]+$"), text.try_cast("int"))


def to_double(text: Column) -> Column:
    """Decimal or scientific number, blanks around it allowed; null otherwise."""
    return text.try_cast("double")


def ids_to_text(ids) -> Column:
    """``[3, 1]`` as ``"3,1"``."""
    return F.array_join(ids, ",")


def digits_to_id(text: Column) -> Column:
    """A key given as digits only; null for anything else or out of range."""
    return F.when(text.rlike(r"^[0-9]+$"), text.try_cast("int"))


def name_length_ok(name: Column) -> Column:
    return F.length(name).between(NAME_MIN, NAME_MAX)
