"""Table functions over partitioned tables, for SQL."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, IntegralType, LongType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult


@udtf
class Pack:
    """pack(TABLE(t) PARTITION BY run ORDER BY (place), budget): of each run, in the order given, what fits into the budget of tokens.

    t has the columns run, id and tokens, the first two of any type, and may have others. Gives run, id, place from 1
    on, and used, the tokens so far. A row too large for what is left is passed over, not an end; a null
    or negative number of tokens never fits. Rows stream through, none are held. Wrong columns or a budget
    that isn't a whole number known beforehand are errors of the query, not of its run.
    """

    def __init__(self) -> None:
        self.place, self.used = 0, 0

    @staticmethod
    def analyze(rows: AnalyzeArgument, budget: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable:
            raise ValueError("pack: the first argument must be a TABLE")
        kinds = {f.name.lower(): f.dataType for f in rows.dataType.fields}
        if lacking := {"run", "id", "tokens"} - kinds.keys():
            raise ValueError(f"pack: the table has no column {', '.join(sorted(lacking))}")
        if not isinstance(kinds["tokens"], IntegralType) or not isinstance(budget.dataType, IntegralType) or not budget.isConstantExpression:
            raise ValueError("pack: tokens and the budget must be whole numbers, the budget a constant")
        return AnalyzeResult(StructType([StructField("run", kinds["run"]), StructField("id", kinds["id"]), StructField("place", IntegerType()), StructField("used", LongType())]))

    def eval(self, row: Row, budget: int) -> Iterator[tuple]:
        tokens = row["tokens"]
        if budget is not None and tokens is not None and 0 <= tokens <= budget - self.used:
            self.place, self.used = self.place + 1, self.used + tokens
            yield row["run"], row["id"], self.place, self.used
