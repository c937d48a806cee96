"""Name, code and period-text expressions.

All are native expressions (regex, higher-order ``transform``), so name
cleaning never leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weekpanel.schemas import DISTRICT_ALIASES, KEEP_UPPER, PERIOD_PATTERN

# Leading/trailing whitespace in the broad sense (Unicode White_Space plus the
# ASCII information separators), unlike ``trim`` which only removes spaces.
_WS = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_ws(c: Column | str) -> Column:
    return F.regexp_replace(_c(c), _WS, "")


def title_case(c: Column | str) -> Column:
    """Title case that restarts after every non-letter: ``RUKUM (EAST)`` -> ``Rukum (East)``.

    Splits the text into runs of letters and runs of non-letters, upper-cases
    the first character of each run and lower-cases the rest (a no-op on
    non-letter runs).  ``initcap`` differs: it restarts only after spaces.
    """
    runs = F.regexp_extract_all(_c(c), F.lit(r"(\p{L}+|[^\p{L}]+)"), 1)

    def title_run(t):
        # upper-case form of the first character may be longer ('ß' -> 'SS'):
        # keep its first letter upper and the rest lower, as Python's title does
        first = F.upper(F.substring(t, 1, 1))
        return F.concat(F.substring(first, 1, 1), F.lower(F.substring(first, 2, 1 << 30)), F.lower(F.substring(t, 2, 1 << 30)))

    return F.array_join(F.transform(runs, title_run), "")


def alias_lookup(key: Column, aliases: dict[str, str] | None) -> Column:
    """``aliases[key]`` or NULL, as a literal map (no join, no broadcast)."""
    aliases = DISTRICT_ALIASES if aliases is None else aliases
    if not aliases:
        return F.lit(None).cast("string")
    m = F.create_map(*[F.lit(x) for kv in sorted(aliases.items()) for x in kv])
    return F.try_element_at(m, key)


def standardize_name(
    c: Column | str,
    aliases: dict[str, str] | None = None,
    strip_code: bool = True,
    keep_upper: list[str] | None = None,
) -> Column:
    """District name cleaning.

    1. ``strip_code``: when the text before the first space is all digits,
       keep only what follows it (``101 TAPLEJUNG`` -> ``TAPLEJUNG``).
    2. strip and upper-case;
    3. an alias wins; otherwise title case, except names in ``keep_upper``
       which stay upper-case.
    NULL stays NULL.
    """
    col = _c(c)
    keep_upper = KEEP_UPPER if keep_upper is None else keep_upper
    if strip_code:
        rest = F.when(col.rlike(r"^[0-9]+ "), F.regexp_extract(col, r"(?s)^[0-9]+ (.*)$", 1)).otherwise(col)
    else:
        rest = col
    clean = F.upper(strip_ws(rest))
    default = title_case(clean)
    if keep_upper:
        default = F.when(clean.isin(keep_upper), clean).otherwise(default)
    return F.coalesce(alias_lookup(clean, aliases), default)


def standardize_mapping_name(c: Column | str, aliases: dict[str, str] | None = None) -> Column:
    """Mapping-side cleaning: alias of the upper/stripped name, else stripped title case;
    then strip + title once more.  Codes are not removed here."""
    col = _c(c)
    first = F.coalesce(alias_lookup(F.upper(strip_ws(col)), aliases), title_case(strip_ws(col)))
    return title_case(strip_ws(first))


def normalize_code(c: Column | str) -> Column:
    """District code as stripped text."""
    return strip_ws(_c(c).cast("string"))


def extract_period_week(c: Column | str, pattern: str = PERIOD_PATTERN) -> Column:
    """Week number of the first ``W<week> <year>`` match in period text, else NULL."""
    return F.regexp_extract(_c(c).cast("string"), pattern, 1).try_cast("int")


def extract_period_year(c: Column | str, pattern: str = PERIOD_PATTERN) -> Column:
    return F.regexp_extract(_c(c).cast("string"), pattern, 2).try_cast("int")
