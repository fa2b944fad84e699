"""Boundary merge: the left equi-join of boundaries with indicator rows.

Semantics (per group): every boundary row is kept; each indicator row whose
cleaned code equals the boundary's ``ISO_A3`` is attached (duplicates on either
side multiply); boundaries without a match get NULL indicator columns.  Both key
columns are kept.  Indicator codes are cleaned first (P2-P4).

Plan at scale.  The boundary table is the small, preserved side.  Spark cannot
broadcast the preserved side of a left outer join, so a plain left join would
shuffle the large indicator table by country code -- and a few codes can hold a
large share of all rows, which makes that shuffle badly skewed.  The merge is
therefore written as

    matched   = indicator INNER JOIN broadcast(boundary)           -- large side streams, no shuffle
    unmatched = boundary-per-group LEFT ANTI distinct(group, code)  -- small sides only
    result    = matched UNION ALL unmatched

which gives exactly the left-join rows.  When the boundary fails the size check
the same decomposition runs with a shuffled inner join instead of a broadcast:
for an inner join AQE can split a skewed partition of either side, whereas a
plain left join lets it split only the preserved (boundary) side -- not the
indicator side, where the hot codes are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.clean import clean_code, is_valid_code
from .broadcast import DEFAULT_MAX_BROADCAST_ROWS, fits_broadcast

# The guard messages of the merge.
MISSING_ISO_MESSAGE = "world doesn't have 'ISO_A3'"
MISSING_CODE_MESSAGE = "df doesn't have 'Code' (ISO-3)"


def require_columns(boundary: DataFrame, indicator: DataFrame, code_col: str = "Code") -> None:
    """Plan-time guards with the fixed messages."""
    if "ISO_A3" not in boundary.columns:
        raise ValueError(MISSING_ISO_MESSAGE)
    if code_col not in indicator.columns:
        raise ValueError(MISSING_CODE_MESSAGE)


def clean_indicator_codes(
    indicator: DataFrame, code_col: str = "Code", already_stripped: bool | None = None
) -> DataFrame:
    """Strip the code and keep only three-letter, non-aggregate codes.

    The long table's ``code`` is stripped already (``already_stripped``
    defaults to True for a column named ``code``)."""
    if already_stripped is None:
        already_stripped = code_col == "code"
    out = indicator if already_stripped else indicator.withColumn(code_col, clean_code(F.col(code_col)))
    return out.where(is_valid_code(F.col(code_col)))


def boundary_per_group(boundary: DataFrame, groups: DataFrame, small_boundary: bool = True) -> DataFrame:
    """Every boundary row once per group row.

    The bounded side is gathered by an uncorrelated scalar subquery -- computed
    once, shipped with the plan like a literal -- and unrolled for each row of
    the other with ``inline``; no join is planned.  That side is the boundary
    table (``small_boundary``: it has passed the size check), so any number of
    groups stays distributed; a boundary beyond the check needs few groups (one
    per map to draw).
    """
    if small_boundary:
        gathered = boundary.select(F.collect_list(F.struct(*boundary.columns))).scalar()
        return groups.select("*", F.inline(gathered)).select(*boundary.columns, *groups.columns)
    gathered = groups.select(F.collect_list(F.struct(*groups.columns))).scalar()
    return boundary.select("*", F.inline(gathered))


def merge_boundaries(
    boundary: DataFrame,
    indicator: DataFrame,
    code_col: str = "Code",
    group_cols: Sequence[str] = (),
    groups: DataFrame | None = None,
    max_broadcast_rows: int = DEFAULT_MAX_BROADCAST_ROWS,
) -> DataFrame:
    """``boundary LEFT JOIN indicator ON ISO_A3 = code``, optionally per group.

    With ``group_cols`` (e.g. ``("dataset",)``) it is one merge per group: every
    boundary row appears in every group.  The groups are the rows of ``groups``
    (a small DataFrame of exactly ``group_cols``); by default the distinct group
    values of ``indicator`` before code cleaning.  Output: group columns, then
    boundary columns, then the remaining indicator columns.
    """
    require_columns(boundary, indicator, code_col)
    group_cols = list(group_cols)
    ind = clean_indicator_codes(indicator, code_col)
    # One distinct-keys aggregate serves both the default groups and the codes
    # present per group (Spark reuses its exchange), so the large input is
    # scanned once for keys and once for the matched rows.
    code = F.col(code_col) if code_col == "code" else clean_code(F.col(code_col))
    keys = indicator.select(*group_cols, code.alias("__code")).distinct()
    if group_cols:
        if groups is None:
            groups = keys.select(*group_cols).distinct()
        else:
            ind = ind.join(groups, group_cols, "left_semi")
            keys = keys.join(groups, group_cols, "left_semi")
    overlap = (set(boundary.columns) & set(ind.columns)) - set(group_cols)
    if overlap:
        raise ValueError(f"boundary and indicator share columns {sorted(overlap)}; rename first")
    ind_cols = [c for c in ind.columns if c not in group_cols]
    out_cols = group_cols + boundary.columns + ind_cols

    small = fits_broadcast(boundary, max_broadcast_rows)
    left = boundary_per_group(boundary, groups, small) if group_cols else boundary

    b = F.broadcast(boundary) if small else boundary
    matched = ind.join(b, ind[code_col] == b["ISO_A3"], "inner")
    matched = matched.select(*out_cols)
    present = keys.where(is_valid_code(F.col("__code")))
    anti_keys = [left[c] == present[c] for c in group_cols] + [left["ISO_A3"] == present["__code"]]
    unmatched = left.join(present, anti_keys, "left_anti")
    unmatched = unmatched.select(
        *group_cols,
        *boundary.columns,
        *[F.lit(None).cast(ind.schema[c].dataType).alias(c) for c in ind_cols],
    )
    return matched.unionByName(unmatched)
