"""Column functions on text shared by the others."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from itertools import chain

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: The white space that Python's str.split() knows.
SPACE = r"[\s\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def words(c: Column | str) -> Column:
    """White-space separated words; none for an empty text."""
    return F.filter(F.split(c, f"{SPACE}+"), lambda w: w != "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value worked out once a row however often the body names it: the optimizer can't inline it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column | str) -> Column:
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def literal_map(values: Mapping[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(values.items())])


def literal_array(values: Iterable[str]) -> Column:
    return F.array(*[F.lit(x) for x in values])


def compact(*flags: Column) -> Column:
    """The flags that are set, in order; never null."""
    return F.coalesce(F.array_compact(F.array(*flags)), F.array().cast("array<string>"))


@F.pandas_udf(StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    import unicodedata

    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def nfkc(c: Column) -> Column:
    """Compatibility normal form. Spark has no function for it; plain ASCII texts never reach Python's normaliser."""
    other = F.when(c.rlike(r"[^\x00-\x7F]"), c)
    return F.coalesce(_nfkc(other), c)


def percent(ratio: Column) -> Column:
    """A ratio as a whole percentage."""
    return F.concat(F.bround(ratio * 100, 0).cast("int").cast("string"), F.lit("%"))
