"""Validators: they mark cells (``{col}__invalid``) and say why (``{col}__reason``)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import checks
from ..functions.domains import DomainRules, any_in, has_label_before, known_by_rules, suffix_keys, suffix_probes
from ..functions.numbers import is_number_type
from ..functions.text import col_ref, strip
from ..plans.lookup import Lookup, attach_known, broadcast_limit, materialize, refuse_streams, row_bytes
from .common import (
    INVALID,
    REASON,
    dtype_of,
    has_column,
    has_mark,
    mark_column,
    mark_metadata,
    require,
    text_of,
)

_BARE, _VERDICT = "__bare", "__verdict"
_HITS = ("__suffix", "__allowed", "__blocked")
KINDS = ("email", "phone", "date", "numeric", "alphanumeric", "url")


class _TextList:
    """A list given as a DataFrame: written once, every text once (``probe``), and measured."""

    def __init__(self, values: DataFrame):
        texts = values.select(F.lower(F.trim(col_ref(values.columns[0]))).alias("probe")).where("probe is not null")
        self.table = materialize(texts.distinct())
        held = self.table.agg(F.sum(row_bytes(self.table, ["probe"]))).first()[0] or 0
        self.fits = held <= broadcast_limit(values.sparkSession)


def _listed(df: DataFrame, keys: list[Column], values, label: str) -> DataFrame:
    """``df`` with the truth column ``label``: is any of ``keys`` in ``values``?

    Collections become a literal set; a :class:`_TextList` is broadcast if it fits, else shuffled.
    """
    if not isinstance(values, _TextList):
        return df.withColumn(label, any_in(keys, values))
    hits = []
    for i, key in enumerate(keys):
        probe, hit = f"{label}probe{i}", f"{label}{i}"
        listed = values.table.select(F.col("probe").alias(probe), F.lit(True).alias(hit))
        df = df.join(F.broadcast(listed) if values.fits else listed, key == F.col(probe), "left").drop(probe)
        hits.append(F.coalesce(F.col(hit), F.lit(False)))
    return df.withColumn(label, reduce(lambda a, b: a | b, hits)).drop(*[f"{label}{i}" for i in range(len(keys))])


def _known_by_table(domains: DataFrame, rules: _TextList, label: str) -> DataFrame:
    """Distinct ``domains`` (``domain``, ...) with the truth column ``label``: known by a table of suffix rules?

    Every rule that could fit a domain is a row; all of them meet the rules in one join, in which rules that many
    domains ask for (``com``) are spread.
    """
    probes = domains.select("domain", F.inline(suffix_probes(F.col("domain"))))
    asked = probes.groupBy("probe").agg(F.count(F.lit(1)).alias("rows")).join(rules.table, "probe")
    lookup = Lookup(materialize(asked.withColumn("__fits", F.lit(True))), "probe", "rows")
    fits = lookup.attach(probes, F.col("probe"), {"__fits": False}).where("__fits")
    best = fits.groupBy("domain").agg(F.max(F.struct("exception", "labels")).alias("__best"))
    joined = domains.join(best, "domain", "left")
    return joined.withColumn(label, has_label_before(F.col("domain"), F.col("__best"))).drop("__best")


def _domain_hits(df: DataFrame, rules: DomainRules, strict_compat: bool) -> DataFrame:
    """``df`` with the truth columns ``_HITS`` for its ``__domain``.

    A list given as a DataFrame is measured first. If all lists can be broadcast, the rows are joined as
    they are and nothing is computed from them beforehand. A larger list is compared with the distinct
    domains, which the rows then look up; so is a table of suffix rules.
    """
    by_rules = rules.suffix_rules is not None
    lists = [rules.suffix_rules if by_rules else rules.suffixes, rules.allowed, rules.blocked]
    if any(isinstance(values, DataFrame) for values in lists):
        refuse_streams(df, "a list given as a DataFrame")
    lists = [_TextList(v) if isinstance(v, DataFrame) else v for v in lists]

    def with_hits(table: DataFrame, domain: Column) -> DataFrame:
        for label, values in zip(_HITS, lists):
            if by_rules and label == _HITS[0]:
                if isinstance(values, _TextList):
                    table = _known_by_table(table, values, label)
                else:
                    table = table.withColumn(label, known_by_rules(domain, values))
                continue
            keys = suffix_keys(domain, strict_compat) if label == _HITS[0] else [domain]
            table = _listed(table, keys, values, label)
        return table

    in_table = by_rules and isinstance(lists[0], _TextList)
    if not in_table and all(values.fits for values in lists if isinstance(values, _TextList)):
        return with_hits(df, F.col("__domain"))
    domains = df.groupBy(F.col("__domain").alias("domain")).agg(F.count(F.lit(1)).alias("rows"))
    marked = materialize(with_hits(domains, F.col("domain")))
    return attach_known(df, F.col("__domain"), marked, "domain", list(_HITS))


def validate_email(
    df: DataFrame,
    col: str,
    *,
    rules: DomainRules | None = None,
    allowed=None,
    blocked=None,
    suffixes=None,
    suffix_rules=None,
    strict_compat: bool = False,
    as_text: bool = True,
    skip_header_cells: bool = True,
) -> DataFrame:
    """Address format, then the domain: common, blocked, allowed, known suffix.

    ``suffix_rules`` takes rules of any depth (see :class:`DomainRules`) in place of ``suffixes``.
    """
    require(df, col)
    rules = _rules(rules, allowed, blocked, suffixes, suffix_rules)

    def verdict(staged: DataFrame, bare: Column) -> tuple[DataFrame, Column]:
        return _email_verdict(staged, bare, rules, strict_compat, "Invalid Format")

    return _validated(df, col, verdict, as_text, skip_header_cells)


def check_email_address(
    df: DataFrame,
    col: str,
    *,
    rules: DomainRules | None = None,
    allowed=None,
    blocked=None,
    suffixes=None,
    suffix_rules=None,
    strict_compat: bool = False,
) -> DataFrame:
    """The address check alone: missing, blank and header cells are addresses of a bad format."""
    require(df, col)
    rules, columns = _rules(rules, allowed, blocked, suffixes, suffix_rules), df.columns
    staged = df.withColumn(_BARE, F.coalesce(strip(text_of(df, col)), F.lit("")))
    staged, reason = _email_verdict(staged, F.col(_BARE), rules, strict_compat, "Invalid Email Format")
    return _with_verdict(staged, columns, col, reason, as_text=False)


def _rules(rules: DomainRules | None, allowed, blocked, suffixes, suffix_rules) -> DomainRules:
    rules = rules or DomainRules()
    return DomainRules(
        rules.allowed if allowed is None else allowed,
        rules.blocked if blocked is None else blocked,
        rules.suffixes if suffixes is None else suffixes,
        rules.suffix_rules if suffix_rules is None else suffix_rules,
    )


def _email_verdict(
    df: DataFrame, bare: Column, rules: DomainRules, strict_compat: bool, bad_format: str
) -> tuple[DataFrame, Column]:
    df = df.withColumn("__domain", checks.email_domain(bare))
    df = _domain_hits(df, rules, strict_compat)
    generic = rules.suffix_rules is None
    return df, checks.email_reason(bare, F.col("__domain"), [F.col(h) for h in _HITS], bad_format, generic=generic)


def _validated(df: DataFrame, col: str, verdict, as_text: bool, skip_header_cells: bool) -> DataFrame:
    """Mark ``col`` by ``verdict(table, bare text) -> (table, reason)``.

    Text that a check reads several times is a column of an earlier projection, computed once.
    """
    require(df, col)
    columns = df.columns
    staged = df.withColumn(_BARE, strip(text_of(df, col)))
    staged, reason = verdict(staged, F.col(_BARE))
    header = col if skip_header_cells else None
    return _with_verdict(
        staged, columns, col, checks.checked(text_of(df, col), F.col(_BARE), header, reason), as_text
    )


def _with_verdict(staged: DataFrame, columns: list[str], col: str, verdict: Column, as_text: bool) -> DataFrame:
    """``columns`` of the staged table plus the marks that follow from ``verdict``."""
    label, mark, fresh = col + REASON, col + INVALID, F.col(_VERDICT)
    judged = staged.withColumn(_VERDICT, verdict)
    marked = has_mark(staged, col, REASON) and has_mark(staged, col, INVALID)
    if not marked and has_column(staged, label):
        raise ValueError(f"column {label!r} already exists and is no mark; rename it first")
    reason = fresh
    if marked:
        # The first failure of a cell keeps its reason when a later check passes.
        reason = F.when(col_ref(mark) & checks.is_good_reason(fresh), col_ref(label)).otherwise(fresh)
    _, invalid = mark_column(judged.select(*map(col_ref, columns)), col, INVALID, ~checks.is_good_reason(fresh))
    out = {c: col_ref(c) for c in columns}
    if as_text:
        out[col] = F.coalesce(text_of(judged, col), F.lit(""))
    out |= {mark: invalid, label: reason.alias(label, metadata=mark_metadata(col, REASON))}
    return judged.select(*[c.alias(name) for name, c in out.items()])


def validate_phone(df: DataFrame, col: str, *, as_text: bool = True, skip_header_cells: bool = True) -> DataFrame:
    return _validated(df, col, lambda t, bare: (t, checks.phone_reason(bare)), as_text, skip_header_cells)


def validate_date(
    df: DataFrame,
    col: str,
    *,
    formats: Sequence[str] | None = None,
    as_text: bool = True,
    skip_header_cells: bool = True,
) -> DataFrame:
    """Text that one of the layouts parses completely; ``formats`` replaces the usual layouts."""

    def verdict(staged: DataFrame, bare: Column) -> tuple[DataFrame, Column]:
        if formats:
            return staged, checks.date_reason(bare, formats)
        staged = staged.withColumn("__day", checks.day_part(bare))
        return staged, checks.date_reason(F.col("__day"), checks.DATE_FORMATS)

    return _validated(df, col, verdict, as_text, skip_header_cells)


def validate_numeric(
    df: DataFrame, col: str, *, as_text: bool = True, skip_header_cells: bool = True
) -> DataFrame:
    require(df, col)
    typed = is_number_type(dtype_of(df, col))

    def verdict(staged: DataFrame, bare: Column) -> tuple[DataFrame, Column]:
        return staged, F.lit("Valid") if typed else checks.numeric_reason(bare)

    return _validated(df, col, verdict, as_text, skip_header_cells)


def validate_alphanumeric(
    df: DataFrame, col: str, *, allow_digits: bool = False, as_text: bool = True, skip_header_cells: bool = True
) -> DataFrame:
    """Letters of any script and white space; digits only on request."""
    return _validated(
        df, col, lambda t, bare: (t, checks.letters_reason(bare, allow_digits)), as_text, skip_header_cells
    )


def validate_url(df: DataFrame, col: str, *, as_text: bool = True, skip_header_cells: bool = True) -> DataFrame:
    return _validated(df, col, lambda t, bare: (t, checks.url_reason(bare)), as_text, skip_header_cells)


VALIDATORS = {
    "email": validate_email,
    "phone": validate_phone,
    "date": validate_date,
    "numeric": validate_numeric,
    "alphanumeric": validate_alphanumeric,
    "url": validate_url,
}


def validate(df: DataFrame, col: str, kind: str, **options) -> DataFrame:
    if kind not in VALIDATORS:
        raise ValueError(f"unknown kind of validation {kind!r}; expected one of {', '.join(KINDS)}")
    return VALIDATORS[kind](df, col, **options)
