"""md5-based hashing shared by feature hashing, folds and seeded samples.

Every rule here is a pure column expression, so DuckDB can evaluate the same rule
(``md5``, ``substr``, hex to integer) and the two engines agree bit for bit.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MISSING_TOKEN = "__missing__"


def md5_prefix_int(s: Column, start: int = 1, width: int = 8) -> Column:
    """Hex digits [start, start+width) of md5(s) read as a non-negative integer."""
    return F.conv(F.substring(F.md5(s.cast("string")), start, width), 16, 10).cast("long")


def hash_bucket(token: Column, n: int) -> Column:
    return F.pmod(md5_prefix_int(token, 1, 8), F.lit(n)).cast("int")


def hash_sign(token: Column) -> Column:
    """+1 / -1 from the parity of md5 hex digit 9, giving signed (collision-cancelling) hashing."""
    return F.when(F.pmod(md5_prefix_int(token, 9, 1), F.lit(2)) == 0, F.lit(1.0)).otherwise(F.lit(-1.0))


def seeded_key(seed: int | str, key: Column) -> Column:
    """md5('<seed>:<key>'): a reproducible shuffle order independent of physical layout."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def token(name: str, value: Column) -> Column:
    """``name=value`` with missing values spelled ``__missing__``."""
    return F.concat_ws("=", F.lit(name), F.coalesce(value.cast("string"), F.lit(MISSING_TOKEN)))
