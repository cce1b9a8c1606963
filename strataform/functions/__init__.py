"""Scalar functions by name: ``functions.get("tidbDivide")(a, b)`` builds a Column."""

from strataform.functions import conversion, datetime, nested, numeric, text  # noqa: F401
from strataform.functions.core import CATALOGUE, Function


def get(name: str) -> Function:
    return CATALOGUE[name]
