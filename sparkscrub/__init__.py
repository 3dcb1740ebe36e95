"""Cleaning, masking, validating and de-duplicating tables with Spark."""

from .functions.domains import DomainRules
from .operators.arithmetic import calculate_constant, calculated_column, round_numbers
from .operators.cells import (
    fill_missing,
    find_replace,
    lower,
    mask,
    mask_email,
    mask_words,
    remove_non_alpha,
    remove_non_numeric,
    remove_specific,
    title,
    trim,
    upper,
)
from .operators.columns import (
    concatenate,
    extract_pattern,
    merge_columns,
    rename_column,
    split_delimiter,
    split_surname,
)
from .operators.common import unique_name
from .operators.duplicates import mark_duplicates, remove_duplicates
from .operators.groups import distinct_codes, distinct_group
from .operators.validate import (
    check_email_address,
    validate,
    validate_alphanumeric,
    validate_date,
    validate_email,
    validate_numeric,
    validate_phone,
    validate_url,
)
from .plans.lookup import release_tables
from .plans.recipe import Recipe, preview, run_operation
from .plans.report import (
    cell_diff,
    changed_cells,
    count_rows,
    diff_summary,
    issue_report,
    merged_profile,
    profile,
    profile_state,
    reason_counts,
    validation_summary,
)
from .plans.slices import slice_rows
from .sources.tables import bad_lines, infer_types, read_domain_list, read_table, write_table

__all__ = [
    "DomainRules",
    "Recipe",
    "bad_lines",
    "calculate_constant",
    "calculated_column",
    "cell_diff",
    "changed_cells",
    "check_email_address",
    "concatenate",
    "count_rows",
    "diff_summary",
    "distinct_codes",
    "distinct_group",
    "extract_pattern",
    "fill_missing",
    "find_replace",
    "infer_types",
    "issue_report",
    "lower",
    "mark_duplicates",
    "mask",
    "mask_email",
    "mask_words",
    "merge_columns",
    "merged_profile",
    "preview",
    "profile",
    "profile_state",
    "read_domain_list",
    "read_table",
    "reason_counts",
    "release_tables",
    "remove_duplicates",
    "remove_non_alpha",
    "remove_non_numeric",
    "remove_specific",
    "rename_column",
    "round_numbers",
    "run_operation",
    "slice_rows",
    "split_delimiter",
    "split_surname",
    "title",
    "trim",
    "unique_name",
    "upper",
    "validate",
    "validate_alphanumeric",
    "validate_date",
    "validate_email",
    "validate_numeric",
    "validate_phone",
    "validate_url",
    "validation_summary",
    "write_table",
]
