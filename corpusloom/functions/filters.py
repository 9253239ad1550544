"""Metadata filters as columns, and as tests of whole batches when every request has its own."""

from __future__ import annotations

import json
import operator
import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable
from functools import reduce
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F

# The operator names of the public filter dialects.
COMPARISONS: dict[str, Callable[[Column, Any], Column]] = {
    "$eq": lambda field, value: field == F.lit(value),
    "$ne": lambda field, value: ~field.eqNullSafe(F.lit(value)),
    "$gt": lambda field, value: field > F.lit(value),
    "$gte": lambda field, value: field >= F.lit(value),
    "$lt": lambda field, value: field < F.lit(value),
    "$lte": lambda field, value: field <= F.lit(value),
}

Lookup = Callable[[str, Any], Column]


def map_lookup(metadata: Column | str) -> Lookup:
    """Fields of a string map, read as the type of the value they are compared with; text of another form is no match."""
    column = F.col(metadata) if isinstance(metadata, str) else metadata

    def lookup(key: str, value: Any) -> Column:
        field = F.try_element_at(column, F.lit(key))
        kind = _kind(value)
        if kind == "boolean":
            return F.when(field.isin("true", "false"), field == "true")
        # Doubles hold whole numbers up to 2**53.
        exact = isinstance(value, int) and abs(value) > 1 << 53
        return field.try_cast("decimal(38,9)" if exact else "double") if kind == "number" else field

    return lookup


def column_lookup(columns: dict[str, str]) -> Lookup:
    """Fields that are promoted to table columns, so that the filter reaches the Parquet scan."""
    return lambda key, value: F.col(columns[key])


def variant_lookup(variant: Column | str) -> Lookup:
    """Typed fields of a VARIANT column: a number is compared with numbers, a string with strings, a boolean with booleans.

    A key is one field name, whatever characters it has.
    """
    column = F.col(variant) if isinstance(variant, str) else variant

    def lookup(key: str, value: Any) -> Column:
        quote = "'" if "'" not in key else '"'
        if quote in key:
            raise ValueError(f"a key with both kinds of quotes: {key!r}")
        path, kind = f"$[{quote}{key}{quote}]", _kind(value)
        stored = F.schema_of_variant(F.try_variant_get(column, path, "variant"))
        if kind == "number":
            return F.when(stored.rlike("^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL)"), F.try_variant_get(column, path, "double"))
        return F.when(stored == kind.upper(), F.try_variant_get(column, path, kind))

    return lookup


def equals_all(filters: dict[str, Any], lookup: Lookup) -> Column:
    """Every key equals its value. A missing key is no match, not even for a null value."""
    return _all(lookup(key, value) == F.lit(value) for key, value in filters.items())


def equals_all_null_safe(filters: dict[str, Any], lookup: Lookup) -> Column:
    """Every key equals its value, and a missing key equals null."""
    return _all(lookup(key, value).eqNullSafe(F.lit(value)) for key, value in filters.items())


def translate(filters: dict[str, Any], lookup: Lookup) -> Column:
    """A filter dictionary with comparison and logical operators, as one boolean column."""
    terms = []
    for key, value in filters.items():
        if key == "$and":
            terms.append(_all(translate(part, lookup) for part in value))
        elif key == "$or":
            terms.append(_any(translate(part, lookup) for part in value))
        elif key.startswith("$"):
            raise ValueError(f"unknown logical operator {key!r}")
        elif isinstance(value, dict):
            terms.extend(_comparison(key, name, operand, lookup) for name, operand in value.items())
        else:
            terms.append(_comparison(key, "$eq", value, lookup))
    return _all(terms)


class Matcher:
    """Filters with operators of many requests (JSON objects, null or empty for none), tested against batches of string maps.

    The meaning is that of ``translate`` over ``map_lookup``. Filters that differ in their numbers and strings only are tested together: a value of a field is
    looked up once among the sorted operands of a condition, and its place there is compared with that of each filter's own operand. A condition
    without an order is tested once for each different value of its field.
    """

    NUMBER = re.compile(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?")

    def __init__(self, filters: list[str | None]):
        different = sorted({f for f in filters if f})
        place = {f: i for i, f in enumerate(different)}
        #: Place of each request's filter among the masks, -1 for none.
        self.place = np.array([place[f] if f else -1 for f in filters], np.int64)
        alike: dict[tuple, tuple[list[int], list[list]]] = {}
        for i, f in enumerate(different):
            operands: list = []
            members, rows = alike.setdefault(self._shape(json.loads(f), operands), ([], []))
            members.append(i)
            rows.append(operands)
        #: Filters of one shape: the shape, their places, and of each condition the different operands in order and each filter's place among them.
        self.shapes = [(shape, np.array(members), [self._ordered(column) for column in zip(*rows, strict=True)]) for shape, (members, rows) in alike.items()]
        self.n_different = len(different)

    @staticmethod
    def _ordered(operands: tuple) -> tuple[list, np.ndarray]:
        known = sorted(set(operands))
        place = {operand: i for i, operand in enumerate(known)}
        return known, np.array([place[operand] for operand in operands], np.int32)[:, None]

    def _shape(self, filters: dict[str, Any], operands: list) -> tuple:
        terms = []
        for key, value in filters.items():
            if key in ("$and", "$or"):
                terms.append((key, *(self._shape(part, operands) for part in value)))
            elif key.startswith("$"):
                raise ValueError(f"unknown logical operator {key!r}")
            else:
                for name, operand in (value.items() if isinstance(value, dict) else [("$eq", value)]):
                    if name not in COMPARISONS and name not in ("$in", "$nin"):
                        raise ValueError(f"unknown comparison operator {name!r}")
                    if name in COMPARISONS and operand == operand and not isinstance(operand, bool) and isinstance(operand, (int, float, str)):
                        terms.append(("place", key, name, _kind(operand), len(operands)))
                        operands.append(operand)
                    else:
                        terms.append(("value", key, name, json.dumps(operand)))
        return ("$and", *terms)

    def masks(self, metadata: pa.Array) -> np.ndarray:
        """One row for each different filter, one column for each map."""
        self.bind(metadata)
        return self.rows(0, len(metadata))

    def bind(self, metadata: pa.Array) -> None:
        """Looks up the fields of a batch, of which ``rows`` then tests stretches."""
        self.metadata = metadata
        self.fields: dict[str, tuple[list[str | None], np.ndarray]] = {}
        self.found: dict[tuple, Any] = {}

    def rows(self, start: int, stop: int) -> np.ndarray:
        """The masks of the maps from ``start`` to ``stop``."""
        out = np.empty((self.n_different, stop - start), bool)
        for i, (shape, members, _) in enumerate(self.shapes):
            out[members] = self._test(shape, i, slice(start, stop))
        return out

    def _test(self, shape: tuple, i: int, part: slice) -> np.ndarray:
        kind, *terms = shape
        if kind == "place":
            return self._compare(i, *terms, part)
        if kind == "value":
            return self._compare_values(*terms)[None, part]
        each = [self._test(term, i, part) for term in terms]
        width = part.stop - part.start
        return reduce(np.logical_and, each, np.ones((1, width), bool)) if kind == "$and" else reduce(np.logical_or, each, np.zeros((1, width), bool))

    def _compare(self, i: int, key: str, name: str, kind: str, slot: int, part: slice) -> np.ndarray:
        known, own = self.shapes[i][2][slot]
        if (i, slot) not in self.found:
            values, codes = self._field(key)
            typed = [v if kind == "string" or v is None else self._number(v) for v in values]
            self.found[i, slot] = [np.array(x)[codes] for x in (
                [v is not None for v in typed], [0 if v is None else bisect_left(known, v) for v in typed], [0 if v is None else bisect_right(known, v) for v in typed])]
        # Operands from ``left`` to before ``right`` equal the value.
        given, left, right = (x[None, part] for x in self.found[i, slot])
        if name in ("$eq", "$ne"):
            equal = given & (left <= own) & (own < right)
            return equal if name == "$eq" else ~equal
        holds = {"$gt": lambda: left > own, "$gte": lambda: right > own, "$lt": lambda: right <= own, "$lte": lambda: left <= own}[name]()
        return given & holds

    def _compare_values(self, key: str, name: str, operand: str) -> np.ndarray:
        if (key, name, operand) not in self.found:
            values, codes = self._field(key)
            given = json.loads(operand)
            self.found[key, name, operand] = np.array([self._holds(v, name, given) for v in values], bool)[codes]
        return self.found[key, name, operand]

    def _field(self, key: str) -> tuple[list[str | None], np.ndarray]:
        if key not in self.fields:
            field = pc.map_lookup(self.metadata, pa.scalar(key), "first").dictionary_encode()
            # The last value stands for a missing key.
            self.fields[key] = [*field.dictionary.to_pylist(), None], field.indices.fill_null(len(field.dictionary)).to_numpy()
        return self.fields[key]

    def _holds(self, text: str | None, name: str, operand: Any) -> bool:
        if name in ("$in", "$nin"):
            return any(self._holds(text, "$eq", one) for one in operand) == (name == "$in")
        if operand is None:
            return name == "$ne" and text is not None
        kind = _kind(operand)
        value = text if kind == "string" or text is None else {"true": True, "false": False}.get(text) if kind == "boolean" else self._number(text)
        if name in ("$eq", "$ne"):
            return (value is not None and value == operand) == (name == "$eq")
        return value is not None and {"$gt": operator.gt, "$gte": operator.ge, "$lt": operator.lt, "$lte": operator.le}[name](value, operand)

    def _number(self, text: str) -> int | float | None:
        text = text.strip()
        if not self.NUMBER.fullmatch(text):
            return None
        return int(text) if text.lstrip("+-").isdigit() else float(text)


def translate_json(filters: dict[str, Any], json: str, columns: dict[str, str]) -> Column:
    """A filter dictionary over a JSON column and promoted columns.

    The JSON is parsed once per row, however many conditions look into it. Conditions on promoted
    columns stay outside, where they reach the scan.
    """
    in_table = column_lookup(columns)

    def inside(doc: Column) -> Column:
        in_doc = variant_lookup(doc)
        return translate(rest, lambda key, value: (in_table if key in columns else in_doc)(key, value))

    plain = {key: value for key, value in filters.items() if key in columns}
    rest = {key: value for key, value in filters.items() if key not in columns}
    parsed = F.array(F.try_parse_json(json))
    return translate(plain, in_table) & (F.exists(parsed, inside) if rest else F.lit(True))


def _comparison(key: str, name: str, operand: Any, lookup: Lookup) -> Column:
    if name in ("$in", "$nin"):
        # Each element is compared as its own type.
        found = _any(F.coalesce(lookup(key, value) == F.lit(value), F.lit(False)) for value in operand)
        return found if name == "$in" else ~found
    if name not in COMPARISONS:
        raise ValueError(f"unknown comparison operator {name!r}")
    return COMPARISONS[name](lookup(key, operand), operand)


def _kind(value: Any) -> str:
    if isinstance(value, bool):
        return "boolean"
    return "number" if isinstance(value, (int, float)) else "string"


def _all(terms) -> Column:
    return reduce(lambda a, b: a & b, terms, F.lit(True))


def _any(terms) -> Column:
    return reduce(lambda a, b: a | b, terms, F.lit(False))
