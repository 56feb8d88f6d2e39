"""Panel operators; each takes DataFrames and returns a lazy DataFrame."""

from panelweave.operators.balance import balance_check, balance_panel, balanced_entities, retention
from panelweave.operators.cells import panel_cells
from panelweave.operators.columns import (
    across,
    drop_suffix,
    first_activity,
    ordinal_from_labels,
    recode,
    split_labels,
    upper_case_names,
    zero_fill,
)
from panelweave.operators.joins import grid_join, grid_slices, key_salts, keyed_join
from panelweave.operators.link import Dim, Fact, Link, assemble_panel, join_dims, join_facts, link_coverage
from panelweave.operators.quality import (
    attribute_conflict_profile,
    consistent_entities,
    distinct_rows,
    drop_conflicting_entities,
    keep_singleton_keys,
    key_multiplicity_profile,
)
from panelweave.operators.report import (
    Variable,
    composition_table,
    distinct_entity_row,
    group_difference_table,
    present,
    stack_report,
)

__all__ = [
    "Dim",
    "Fact",
    "Link",
    "Variable",
    "across",
    "assemble_panel",
    "attribute_conflict_profile",
    "balance_check",
    "balance_panel",
    "balanced_entities",
    "composition_table",
    "consistent_entities",
    "distinct_entity_row",
    "distinct_rows",
    "drop_conflicting_entities",
    "drop_suffix",
    "first_activity",
    "grid_join",
    "grid_slices",
    "group_difference_table",
    "join_dims",
    "join_facts",
    "keep_singleton_keys",
    "key_multiplicity_profile",
    "key_salts",
    "keyed_join",
    "link_coverage",
    "ordinal_from_labels",
    "panel_cells",
    "present",
    "recode",
    "retention",
    "split_labels",
    "stack_report",
    "upper_case_names",
    "zero_fill",
]
