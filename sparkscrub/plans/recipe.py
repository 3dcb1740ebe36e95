"""Recipes: ordered lists of operations that can be saved, edited and replayed on any table."""

from __future__ import annotations

import inspect
import json
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass
from functools import cached_property, reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T

from ..functions.numbers import is_number_type
from ..operators import arithmetic, cells, columns, duplicates, groups, validate
from ..operators.common import dtype_of, text_of
from ..sources.tables import read_domain_list
from .slices import PREVIEW_ROWS, slice_rows

Operation = Mapping[str, Any]
_KIND = "column_operation"


# Arguments that are no part of a saved operation.
_NOT_IN_RECIPES = {"flags", "hot_rows", "rules", "order_by", "cuts"}
# Options that are lists of texts, or the path of a file with one text per line.
_LISTS = {"allowed", "blocked", "suffixes", "suffix_rules"}


@dataclass(frozen=True)
class _Step:
    """How an operation object is turned into a call: which entries become which arguments."""

    run: Callable[..., DataFrame]
    needed: tuple[tuple[str, str], ...] = ()
    optional: tuple[tuple[str, str], ...] = ()
    takes_flags: bool = False
    on_column: str | None = "col"

    @cached_property
    def options(self) -> frozenset[str]:
        """Keyword arguments that an operation object may name as they are."""
        mapped = {name for _, name in (*self.needed, *self.optional)}
        return frozenset(
            p.name
            for p in inspect.signature(self.run).parameters.values()
            if p.kind is p.KEYWORD_ONLY and p.name not in mapped | _NOT_IN_RECIPES
        )


def _cell(run, *needed, optional=()) -> _Step:
    return _Step(run, needed, tuple(optional), takes_flags=True)


# The operation keys and the names of their entries are the interface of saved recipes.
STEPS: dict[str, _Step] = {
    "op_mask": _cell(cells.mask),
    "op_mask_email": _cell(cells.mask_email),
    "op_mask_words": _cell(cells.mask_words),
    "op_trim": _cell(cells.trim),
    "op_split_delimiter": _Step(columns.split_delimiter, (("delimiter", "delimiter"),), (("n_parts", "n_parts"),)),
    "op_split_surname": _Step(columns.split_surname),
    "op_upper": _cell(cells.upper),
    "op_lower": _cell(cells.lower),
    "op_title": _cell(cells.title),
    "op_find_replace": _cell(
        cells.find_replace, ("find_text", "find"), optional=(("replace_text", "replacement"),)
    ),
    "op_remove_specific": _cell(cells.remove_specific, ("chars_to_remove", "characters")),
    "op_remove_non_numeric": _cell(cells.remove_non_numeric),
    "op_remove_non_alpha": _cell(cells.remove_non_alpha),
    "op_concatenate": _Step(
        columns.concatenate,
        (("cols_to_concat", "cols"), ("new_col_name", "new")),
        (("separator", "separator"),),
        on_column=None,
    ),
    "op_extract_pattern": _Step(
        columns.extract_pattern, (("pattern", "pattern"), ("new_col_name", "new")), (("group", "group"),)
    ),
    "op_fill_missing": _cell(cells.fill_missing, ("fill_value", "value")),
    "op_mark_duplicates": _Step(duplicates.mark_duplicates, optional=(("selected_columns", "cols"),), on_column="cols"),
    "op_remove_duplicates": _Step(duplicates.remove_duplicates, (("order_by", "order_by"),), on_column="cols"),
    "op_merge_columns": _Step(
        columns.merge_columns,
        (("cols_to_merge", "cols"), ("new_col_name", "new")),
        (("separator", "separator"), ("fill_missing", "fill_missing")),
        on_column=None,
    ),
    "op_rename_column": _Step(columns.rename_column, (("new_col_name", "new"),), on_column="old"),
    "op_round_numbers": _Step(arithmetic.round_numbers, optional=(("decimals", "decimals"),)),
    "op_calculate_column_constant": _Step(
        arithmetic.calculate_constant, (("operation", "operation"), ("constant_value", "value"))
    ),
    "op_create_calculated_column": _Step(
        arithmetic.calculated_column,
        (("col2_name", "col2"), ("operation", "operation"), ("new_col_name", "new")),
        (("col1_name", "col1"), ("decimals", "decimals")),
        on_column="col1",
    ),
    **{f"op_validate_{kind}": _Step(run) for kind, run in validate.VALIDATORS.items()},
    "op_distinct_group": _Step(groups.distinct_group),
}
_COMMON = {"type", "key", "column"}


def run_operation(
    df: DataFrame, operation: Operation, *, order_by: str | Sequence[str] | None = None, flags: bool = False
) -> DataFrame:
    """Apply one operation object, e.g. ``{"key": "op_trim", "column": "name"}``.

    Further entries are the operator's own options: ``{"key": "op_validate_email", "column": "email",
    "suffixes": ["co.uk"], "blocked": "blocked.txt"}``. A list of domains is a JSON list, or the path of a
    text file with one per line.
    """
    step, arguments = _call(df, operation, order_by, flags)
    return step.run(df, **arguments)


def _call(
    df: DataFrame, operation: Operation, order_by: str | Sequence[str] | None, flags: bool
) -> tuple[_Step, dict[str, Any]]:
    """The operator of an operation object and its arguments."""
    step, given = _checked(operation), dict(operation)
    if order_by is not None and any(entry == "order_by" for entry, _ in step.needed):
        given.setdefault("order_by", order_by)
    arguments: dict[str, Any] = {}
    if step.on_column and given.get("column") is not None:
        arguments[step.on_column] = given["column"]
    for entry, name in step.needed:
        if entry not in given:
            raise ValueError(f"{given['key']} needs {entry!r}")
        arguments[name] = given[entry]
    for entry, name in step.optional:
        if given.get(entry) is not None:
            arguments[name] = given[entry]
    for option in step.options & set(given):
        value = given[option]
        if option in _LISTS and isinstance(value, str):
            value = read_domain_list(df.sparkSession, value)
        if value is not None:
            arguments[option] = value
    if step.on_column and step.on_column not in arguments:
        raise ValueError(f"{given['key']} needs 'column'")
    if step.takes_flags:
        arguments["flags"] = flags
    return step, arguments


# Entries of operation objects that name columns.
_NAMES_COLUMNS = ("column", "selected_columns", "cols_to_concat", "cols_to_merge", "new_col_name", "col1_name", "col2_name")
# Operations that leave every cell of the table as it is: they add columns only.
_ONLY_ADD = {
    "op_create_calculated_column", "op_mark_duplicates", "op_distinct_group",
    *(f"op_validate_{kind}" for kind in validate.VALIDATORS),
}


@dataclass(frozen=True)
class _Need:
    """Aggregates that an operation takes of the whole table, and how its arguments change once they are known."""

    aggregates: dict[str, Column]
    use: Callable[[dict[str, Any], dict[str, Any]], None]
    at_once: bool


def _need(df: DataFrame, key: str, arguments: Mapping[str, Any]) -> tuple[list[str], _Need] | None:
    """The columns that the operation's statistics are about, and the statistics; None if it has none."""
    checked = bool(arguments.get("check"))
    if key == "op_split_delimiter":
        if (arguments.get("n_parts") is not None and not checked) or not arguments.get("delimiter"):
            return None
        cuts = columns.most_cuts(text_of(df, arguments["col"]), arguments["delimiter"])
        return [arguments["col"]], _Need({"cuts": cuts}, lambda given, found: given.update(cuts=found["cuts"] or 0), True)
    if key in ("op_round_numbers", "op_calculate_column_constant"):
        cols = [arguments["col"]]
    elif key == "op_create_calculated_column":
        cols = [arguments["col1"], arguments["col2"]]
    else:
        return None
    if not all(is_number_type(t) or isinstance(t, T.StringType) for t in (dtype_of(df, c) for c in cols)):
        return None
    aggregates = arithmetic.number_counts(df, *cols) if checked else {}
    places = len(cols) == 2 and arguments.get("decimals", "auto") == "auto"
    places = places and arithmetic.measures_places(*(dtype_of(df, c) for c in cols))
    if places:
        aggregates["places"] = arithmetic.places_shown(df, *cols)

    def use(given: dict[str, Any], found: dict[str, Any]) -> None:
        if checked:
            arithmetic.require_numbers(found, *cols)
            given["check"] = False
        if places:
            given["decimals"] = found["places"] or None

    return (cols, _Need(aggregates, use, checked)) if aggregates else None


def _measured(
    df: DataFrame, operations: Sequence[Operation], order_by: str | Sequence[str] | None
) -> dict[int, Callable[[dict[str, Any]], None]]:
    """By place of the operation: what puts the statistics of ``df`` into its arguments.

    Taken are statistics of columns that no earlier operation changes, up to the first one that removes rows, by
    one aggregate for all. It is left out where a single operation needs one, or none runs an aggregate at once.
    """
    if df.isStreaming:
        return {}
    there, changed, needs = {c.lower() for c in df.columns}, set(), {}
    for place, operation in enumerate(operations):
        if operation["key"] == "op_remove_duplicates":
            break
        named = [v for e in _NAMES_COLUMNS for v in _as_list(operation.get(e))]
        own = [v for e in ("column", "col1_name", "col2_name") for v in _as_list(operation.get(e))]
        if all(isinstance(c, str) and c.lower() in there and c.lower() not in changed for c in own):
            try:
                _, arguments = _call(df, operation, order_by, False)
                found = _need(df, operation["key"], arguments)
            except (KeyError, TypeError, ValueError):
                found = None  # the operation itself says what is wrong with it
            if found is not None:
                needs[place] = found[1]
        if operation["key"] not in _ONLY_ADD:
            changed |= {str(c).lower() for c in named}
    if len(needs) < 2 or not any(n.at_once for n in needs.values()):
        return {}
    wanted = [a.alias(f"{place}.{name}") for place, n in needs.items() for name, a in n.aggregates.items()]
    row = df.agg(*wanted).first().asDict()

    def user(place: int, need: _Need) -> Callable[[dict[str, Any]], None]:
        found = {name: row[f"{place}.{name}"] for name in need.aggregates}
        return lambda arguments: need.use(arguments, found)

    return {place: user(place, need) for place, need in needs.items()}


def _as_list(value: Any) -> list:
    return [] if value is None else list(value) if isinstance(value, (list, tuple)) else [value]


def _checked(operation: Operation) -> _Step:
    if operation.get("type", _KIND) != _KIND:
        raise ValueError(f"unknown operation type {operation['type']!r}")
    key = operation.get("key")
    if key not in STEPS:
        raise ValueError(f"unknown operation {key!r}")
    step = STEPS[key]
    known = _COMMON | step.options | {entry for entry, _ in (*step.needed, *step.optional)}
    unknown = set(operation) - known
    if unknown:
        raise ValueError(f"{key} does not take {', '.join(sorted(unknown))}")
    return step


@dataclass(frozen=True)
class Recipe:
    """An immutable list of operations. ``apply`` stays lazy where its operations do."""

    operations: tuple[Operation, ...] = ()

    def __init__(self, operations: Iterable[Operation] = ()):
        steps = tuple({"type": _KIND, **op} for op in operations)
        for step in steps:
            _checked(step)
        object.__setattr__(self, "operations", steps)

    def append(self, operation: Operation) -> Recipe:
        return Recipe((*self.operations, operation))

    def without_last(self) -> Recipe:
        return Recipe(self.operations[:-1])

    def clear(self) -> Recipe:
        return Recipe()

    def __len__(self) -> int:
        return len(self.operations)

    def to_json(self) -> str:
        return json.dumps(list(self.operations), ensure_ascii=False, indent=2)

    @staticmethod
    def from_json(text: str) -> Recipe:
        return Recipe(json.loads(text))

    def apply(
        self, df: DataFrame, *, order_by: str | Sequence[str] | None = None, flags: bool = False
    ) -> DataFrame:
        """Replay on ``df``. ``order_by`` says which row is first for operations that need it and do
        not name it themselves; ``flags`` marks changed cells.

        Statistics that several operations need of columns as they are in ``df`` (the most delimiters in a cell,
        whether a column holds numbers, decimals shown) are taken by one aggregate before the first operation.
        """
        measured = _measured(df, self.operations, order_by)

        def step(table: DataFrame, numbered: tuple[int, Operation]) -> DataFrame:
            place, operation = numbered
            try:
                run, arguments = _call(table, operation, order_by, flags)
                if place in measured:
                    measured[place](arguments)
                return run.run(table, **arguments)
            except (TypeError, ValueError) as problem:
                raise ValueError(f"operation {place} ({operation['key']}): {problem}") from problem

        return reduce(step, enumerate(self.operations), df)


def preview(
    df: DataFrame,
    operation: Operation,
    n: int = PREVIEW_ROWS,
    *,
    order_by: str | Sequence[str],
    position: str = "head",
    flags: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """(``n`` rows at the ``head``, ``middle`` or ``tail``, the same rows after ``operation``)."""
    before = slice_rows(df, position, n, order_by=order_by)
    return before, run_operation(before, operation, order_by=order_by, flags=flags)
