"""Code and number cleaning as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's ``str.strip()`` removes (``str.isspace``),
# as code points.  ``F.trim`` only removes spaces.
WHITESPACE_CODE_POINTS = (
    [0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x1C, 0x1D, 0x1E, 0x1F, 0x20, 0x85, 0xA0, 0x1680]
    + list(range(0x2000, 0x200B))
    + [0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
)
WHITESPACE_CHARS = "".join(chr(c) for c in WHITESPACE_CODE_POINTS)

# Prefix of aggregate (non-country) codes dropped by the merge.
AGGREGATE_CODE_PREFIX = "OWID_"

# The length of an ISO 3166-1 alpha-3 code.
ISO3_LENGTH = 3



def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_text(c) -> Column:
    """Strip leading and trailing whitespace (Python ``str.strip`` semantics).

    ``btrim`` with a character set (no regular expression), run only when the
    first or last character is whitespace -- most values need no trimming, and
    the two one-character tests are much cheaper than the trim itself."""
    text = _col(c).cast("string")
    ws = list(WHITESPACE_CHARS)
    at_edge = F.substring(text, 1, 1).isin(ws) | F.substring(text, -1, 1).isin(ws)
    return F.when(at_edge, F.btrim(text, F.lit(WHITESPACE_CHARS))).otherwise(text)


def clean_code(c) -> Column:
    """A country code as text with surrounding whitespace removed (NULL stays NULL)."""
    return strip_text(c)


def is_valid_code(code) -> Column:
    """P3 + P4: a cleaned code of length 3 that is not an aggregate ``OWID_`` code.

    P4 is implied by P3 (a five-character prefix cannot fit in three characters);
    it is kept as the documented intent.  NULL codes are not valid.
    """
    code = _col(code)
    # ``length(NULL) = 3`` is NULL, so NULL codes fail without a third reference.
    return (F.length(code) == ISO3_LENGTH) & ~code.startswith(AGGREGATE_CODE_PREFIX)


# The number grammar pandas accepts -- optional sign, digits with an
# optional decimal point, optional exponent, or inf / infinity / nan (any case),
# with white space around it; any other text matches without the group.
_SPACE = "[" + "".join(f"\\u{c:04x}" for c in WHITESPACE_CODE_POINTS) + "]*+"
NUMBER_PATTERN = rf"(?is)\A(?:{_SPACE}([+-]?(?:(?:\d++\.?+\d*+|\.\d++)(?:e[+-]?\d++)?+|infinity|inf|nan)){_SPACE}\z|.*+)"


def to_number(c) -> Column:
    """P5: text -> double, anything unparsable -> NULL (``pd.to_numeric(errors="coerce")``).

    Accepts surrounding whitespace, exponents and ``inf``; rejects thousands
    separators and the Java-only forms Spark's cast would take (``5d``, ``1.5f``,
    hex floats).  NaN is missing, as in pandas (``nanvl``).

    The input is referenced once: the optimizer inlines this expression
    wherever a derived column is used (filters pushed below projections
    included), so every extra reference multiplies the per-row cost and the
    size of the generated code.
    """
    number = F.regexp_replace(_col(c).cast("string"), NUMBER_PATTERN, "$1")  # empty, so NULL, if it is none
    return F.nanvl(number.try_cast("double"), F.lit(None).cast("double"))


def integral_year(year_number) -> Column:
    """Canonical integer year: only integral, finite, int-sized numbers."""
    y = _col(year_number)  # referenced twice: see ``to_number``
    return F.when(y % 1 == 0, y.try_cast("int"))


def truncated_year(year_number) -> Column:
    """``int(x)`` of a coerced year -- truncation toward zero; infinities
    and out-of-range values are NULL."""
    return _col(year_number).try_cast("int")
