"""Block joins: every row of one side against every row of the other, a block of each at a time.

Each pair of blocks is one group of bounded size, worked on with dense NumPy arithmetic, so no side is broadcast and no
pair is shuffled; a row travels once for each block of the other side.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 2048


def block_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, run: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str, block: int = BLOCK) -> DataFrame:
    """Union of run(block of left, block of right) over all pairs of blocks. Rows are dealt to blocks by their keys' hash."""
    n, m = max(1, -(-left.count() // block)), max(1, -(-right.count() // block))
    upto = lambda k: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(k - 1).cast("bigint")))
    own = lambda key, k: F.pmod(F.xxhash64(key), F.lit(k)).cast("bigint")
    a = left.select(F.lit(0).alias("side"), own(left_key, n).alias("i"), upto(m).alias("j"), *[F.col(c).alias(f"l_{c}") for c in left.columns])
    b = right.select(F.lit(1).alias("side"), upto(n).alias("i"), own(right_key, m).alias("j"), *[F.col(c).alias(f"r_{c}") for c in right.columns])
    both = a.unionByName(b, allowMissingColumns=True)
    left_cols, right_cols = left.columns, right.columns
    left_kinds, right_kinds = ([t for _, t in x.dtypes] for x in (left, right))

    def part(pdf: pd.DataFrame, side: int, cols: list[str], kinds: list[str]) -> pd.DataFrame:
        out = pdf.loc[pdf.side == side, [f"{'lr'[side]}_{c}" for c in cols]].reset_index(drop=True)
        out.columns = cols
        whole = {c: "int64" for c, t in zip(cols, kinds) if t in ("int", "bigint")}  # nulls of the other side made them floats
        return out.astype(whole)

    def group(pdf: pd.DataFrame) -> pd.DataFrame:
        return run(part(pdf, 0, left_cols, left_kinds), part(pdf, 1, right_cols, right_kinds))

    return both.groupBy("i", "j").applyInPandas(group, schema)
