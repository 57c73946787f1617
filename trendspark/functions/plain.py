"""Texts in plain ASCII with every named and numeric entity and every compatible character, by Arrow batches.

`normalize.normalize_text` is built of SQL functions and knows the signs and letters it lists; this is for texts that hold
others, at the edge where payloads come in.
"""

from __future__ import annotations

import html
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from trendspark.functions import normalize as N

#: Signs whose plain form is not that of their decomposition.
_SIGNS = str.maketrans({s: p for s, p in N.SIGNS if len(s) == 1})


@F.pandas_udf(StringType())
def plain_text(text: pd.Series) -> pd.Series:
    """Entities replaced once, signs as in normalize.SIGNS, other characters by their compatible ASCII ones or dropped."""

    def one(t: str | None) -> str:
        t = html.unescape(t or "").translate(_SIGNS)
        return t if t.isascii() else unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode("ascii")

    return text.map(one)


def normalized(text: Column) -> Column:
    """plain_text on one line, as normalize.normalize_text leaves it; a null text gives an empty one."""
    return N.cleaned(plain_text(text))
