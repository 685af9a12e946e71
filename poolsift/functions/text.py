"""String column functions: run paths, strategy names, report cells, tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word tokens: maximal runs of letters or digits (Unicode classes).
TOKEN_SPLIT = r"[^\p{L}\p{N}]+"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def experiment_group(path) -> Column:
    """Group of a run path: segments 3-4 joined by '-' for ablation/additional runs,
    else segment 3 (as in ``../outputs/<group>/...``)."""
    p = _col(path)
    parts = F.split(p, "/")
    nested = p.contains("ablations") | p.contains("additional")
    return F.trim(F.when(nested, F.array_join(F.slice(parts, 3, 2), "-")).otherwise(F.get(parts, 2)))


def fix_strategy_name(name) -> Column:
    """Prefix single-stage names with ``noop_``."""
    c = _col(name)
    return F.when(c.contains("_"), c).otherwise(F.concat(F.lit("noop_"), c))


def name_part(name, sep: str, index: int) -> Column:
    """1-based part of a delimited name; '' when missing (``split_part`` semantics)."""
    return F.split_part(_col(name), F.lit(sep), F.lit(index))


def name_part_or_null(name, sep: str, index0: int) -> Column:
    """0-based part; NULL when missing (pandas ``str.split(expand=True)`` semantics)."""
    return F.get(F.split(_col(name), sep), index0)


def parent_dir(path, levels: int = 1) -> Column:
    """Parent directory, ``levels`` times."""
    p = _col(path)
    for _ in range(levels):
        p = F.regexp_extract(p, r"^(.*)/[^/]*$", 1)
    return p


def hundredths(x) -> Column:
    """Value in hundredths, rounded half-up after normalising to 6 places, so
    float noise below 1e-6 can never flip the second decimal."""
    return F.round(F.round(_col(x), 6) * F.lit(100.0), 0).cast("long")


def two_decimals(x) -> Column:
    """Non-negative value as text with exactly two decimals (integer formatting)."""
    h = hundredths(x)
    return F.concat(F.floor(h / 100).cast("string"), F.lit("."), F.lpad(F.pmod(h, F.lit(100)).cast("string"), 2, "0"))


def format_median_iqr(median, iqr) -> Column:
    """``m ± iqr`` with two decimals; empty when the median is NULL."""
    return F.coalesce(F.concat(two_decimals(median), F.lit(" ± "), two_decimals(iqr)), F.lit(""))


def format_thousands(c) -> Column:
    """Integer text below 1000, else thousands with one decimal and a ``k``."""
    x = _col(c)
    return F.when(x < 1000, x.cast("long").cast("string")).otherwise(
        F.concat(F.format_string("%.1f", F.round(x / 1000.0, 1)), F.lit("k")))


def tokens(text) -> Column:
    """Lower-cased word tokens of the whole text."""
    return F.filter(F.split(F.lower(_col(text)), TOKEN_SPLIT), lambda t: t != "")


def truncate_tokens(toks, max_length: int) -> Column:
    return F.slice(_col(toks), 1, max_length)
