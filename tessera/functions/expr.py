"""Column-expression builders (all JVM-side, codegen friendly).

Nothing here is a UDF: each helper returns a ``Column`` built from
``pyspark.sql.functions`` so it stays inside whole-stage codegen.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the source pipeline for identical results.
MISSING_SENTINEL = -9999
REFLECT_SCALE = 0.0001
REFLECT_MIN = -0.063
REFLECT_MAX = 0.3
BANDS = ["B02", "B03", "B04"]
FILL_BANDS = ["B02", "B03", "B04", "B05", "NDVI"]
CLOUD_FLAGS = ["cloud", "adj_cloud", "cloud_shadow"]
SCENE_COLUMNS = ["B02", "B03", "B04", "B05", "NDVI", "cloud", "adj_cloud", "cloud_shadow",
                 "X", "Y", "DOY", "PID"]
TRAIN_COLUMNS = ["B02", "B03", "B04", "B05", "NDVI", "X", "Y", "DOY", "PID"]
DEFAULT_DOYS = [171, 179, 187, 195, 203, 211, 219]

# Portable 32-bit mixer: the same integer formula runs in Spark and DuckDB, so
# hash-driven choices can be oracle-checked.  Every product stays below 2^63.
MIX_W = 1 << 32
MIX_M = 73244475
MIX_STREAM = 2654435769
MIX_HIGH = 1540483477


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def any_of(cols) -> Column:
    cols = [col_(c) for c in cols]
    return reduce(lambda a, b: a | b, cols) if cols else F.lit(False)


def all_of(cols) -> Column:
    cols = [col_(c) for c in cols]
    return reduce(lambda a, b: a & b, cols) if cols else F.lit(True)


def any_null(cols) -> Column:
    return any_of([col_(c).isNull() for c in cols])


def mix(x, seed=0, stream: int = 0) -> Column:
    """Portable hash in [0, 2^32) of all 64 bits of ``x``.

    ``seed`` may be a column below 2^32; choices that must be independent
    (columns, bands, rounds) take a ``stream`` number each.
    """
    x = col_(x).cast("long")
    low = F.pmod(x, F.lit(MIX_W))
    high = F.pmod(F.shiftright(x, 32), F.lit(MIX_W))
    seed = F.lit(seed % MIX_W).cast("long") if isinstance(seed, int) else seed
    h = F.pmod(low + F.pmod(high * F.lit(MIX_HIGH), F.lit(MIX_W)) + seed
               + F.lit(stream * MIX_STREAM % MIX_W), F.lit(MIX_W))
    for _ in range(2):
        h = F.pmod(h.bitwiseXOR(F.shiftright(h, 16)) * F.lit(MIX_M), F.lit(MIX_W))
    return h.bitwiseXOR(F.shiftright(h, 16))


def mix_sql(expr: str, seed: int | str = 0, stream: int = 0) -> str:
    """DuckDB text of :func:`mix`."""
    w = MIX_W
    x = f"CAST({expr} AS BIGINT)"
    seed = str(seed % w) if isinstance(seed, int) else f"({seed})"
    low, high = f"(({x} % {w} + {w}) % {w})", f"((({x} >> 32) % {w} + {w}) % {w})"
    h = f"(({low} + ({high} * {MIX_HIGH}) % {w} + {seed} + {stream * MIX_STREAM % w}) % {w})"
    for _ in range(2):
        h = f"((xor({h}, {h} >> 16) * {MIX_M}) % {w})"
    return f"xor({h}, {h} >> 16)"


def mix_keys(cols, seed: int = 0, stream: int = 0) -> Column:
    """Hash of several key columns, mixed one by one."""
    h = mix(cols[0], seed, stream)
    for c in cols[1:]:
        h = mix(c, h, stream)
    return h


def mix_keys_sql(cols, seed: int = 0, stream: int = 0) -> str:
    h = mix_sql(cols[0], seed, stream)
    for c in cols[1:]:
        h = mix_sql(c, h, stream)
    return h


def pick(x, n, seed=0, stream: int = 0) -> Column:
    """Even choice in [0, n) by the high bits of the hash (n below 2^31)."""
    return F.shiftright(mix(x, seed, stream) * n, 32)


def pick_sql(expr: str, n, seed: int = 0, stream: int = 0) -> str:
    return f"(({mix_sql(expr, seed, stream)} * {n}) >> 32)"


def uniform(x, seed=0, stream: int = 0) -> Column:
    """Double in [0, 1) of 53 hash bits."""
    bits = F.shiftright(mix(x, seed, 2 * stream), 5) * F.lit(1 << 26) + F.shiftright(
        mix(x, seed, 2 * stream + 1), 6)
    return bits.cast("double") / F.lit(float(1 << 53))


def uniform_sql(expr: str, seed: int = 0, stream: int = 0) -> str:
    return (f"(CAST(({mix_sql(expr, seed, 2 * stream)} >> 5) * {1 << 26} + "
            f"({mix_sql(expr, seed, 2 * stream + 1)} >> 6) AS DOUBLE) / CAST({1 << 53} AS DOUBLE))")


def sentinel_null(c, sentinel: int = MISSING_SENTINEL) -> Column:
    """Sentinel to null (never NaN)."""
    c = col_(c)
    return F.when(c == F.lit(sentinel), F.lit(None)).otherwise(c)


def ndvi(b05="B05", b04="B04") -> Column:
    """(B05-B04)/(B05+B04) on doubles; zero denominator gives null."""
    n = col_(b05).cast("double") - col_(b04).cast("double")
    d = col_(b05).cast("double") + col_(b04).cast("double")
    return F.try_divide(n, F.when(d != 0, d))


def _capped_reflectance(c) -> Column:
    v = col_(c).cast("double") * F.lit(REFLECT_SCALE)
    # null stays null: a least()-style cap would turn missing into 0.3
    v = F.when(v > F.lit(REFLECT_MAX), F.lit(REFLECT_MAX)).otherwise(v)
    return (v - F.lit(REFLECT_MIN)) / F.lit(REFLECT_MAX - REFLECT_MIN)


def reflectance(c, digits: int = 4, as_int: bool = False) -> Column:
    """x*1e-4, capped above at 0.3, rescaled, rounded half-even."""
    v = F.bround(_capped_reflectance(c), digits)
    if as_int:
        v = (v * F.lit(10 ** digits)).cast("int")
    return v


def quantize(c, digits: int = 4) -> Column:
    """Reflectance rounded half-even, times 255, kept as a double."""
    return F.bround(_capped_reflectance(c), digits) * F.lit(255)


def stretch8(c, fill: int = 0) -> Column:
    """8-bit display stretch of a raw band; null -> fill value."""
    v = (_capped_reflectance(c) * F.lit(255)).cast("int")
    return F.coalesce(F.pmod(v, F.lit(256)), F.lit(fill))


def ndvi8(c="NDVI", fill: int = 255) -> Column:
    """NDVI in [0, 1] to 8 bits, wrapping like an unsigned byte."""
    v = (col_(c).cast("double") * F.lit(255)).cast("int")
    return F.coalesce(F.pmod(v, F.lit(256)), F.lit(fill))


def ws_trim(c) -> Column:
    """Strip all leading/trailing whitespace (F.trim strips spaces only)."""
    return F.regexp_replace(col_(c), r"^\s+|\s+$", "")


NUMERIC_TEXT = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def coerce_numeric(c) -> Column:
    """Text to double; anything that is not a plain number becomes null.

    The regex guard rejects forms such as ``12d`` that ``try_cast`` accepts.
    """
    c = col_(c)
    return F.when(c.rlike(NUMERIC_TEXT), ws_trim(c).try_cast("double"))


def float_text(c) -> Column:
    """Doubles as Python prints them: positional from 1e-4 to below 1e16, else ``d.de-05``."""
    c = col_(c).cast("double")
    t = c.cast("string")
    sign = F.when(t.startswith("-"), "-").otherwise("")
    mantissa = F.regexp_extract(t, r"^-?(\d)\.(\d+)E", 1)
    rest = F.regexp_replace(F.regexp_extract(t, r"^-?\d\.(\d+)E", 1), "^0$", "")
    e = F.regexp_extract(t, r"E(-?\d+)$", 1).try_cast("int")
    digits = F.concat(mantissa, rest)
    small = F.concat(sign, F.lit("0."), F.repeat(F.lit("0"), -e - 1), digits)
    padded = F.rpad(digits, F.greatest(F.length(digits), e + 1), "0")
    fraction = F.substring(padded, e + 2, F.lit(400))
    large = F.concat(sign, F.substring(padded, F.lit(1), e + 1), F.lit("."),
                     F.when(fraction == "", "0").otherwise(fraction))
    science = F.concat(sign, mantissa, F.when(rest == "", "").otherwise(F.concat(F.lit("."), rest)),
                       F.when(e < 0, "e-").otherwise("e+"), F.when(F.abs(e) < 10, "0").otherwise(""), F.abs(e).cast("string"))
    return (F.when(F.isnan(c), "nan").when(c == float("inf"), "inf").when(c == float("-inf"), "-inf")
            .when(e.isNull(), t).when((e < 0) & (e >= -4), small).when((e >= 0) & (e < 16), large)
            .otherwise(science))


def value_text(c) -> Column:
    """Render a cell for the row text: null prints ``None``, doubles as Python prints them."""
    kind = F.typeof(col_(c))
    plain = ws_trim(col_(c).cast("string"))
    text = F.when(kind.isin("double", "float"), float_text(col_(c).try_cast("double"))).otherwise(plain)
    return F.coalesce(text, F.lit("None"))
