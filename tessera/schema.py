"""Tables declared by column role: one timestamp (int64), metrics (float32) and categories (int32)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROLE_TYPES = {"timestamp": T.LongType(), "metric": T.FloatType(), "category": T.IntegerType()}


@dataclass(frozen=True)
class TableSpec:
    """Columns without a role are projected away; rows of a chunk are ordered by order_by (the timestamp, if not given), then by sequence."""

    name: str
    timestamp: str
    metrics: tuple[str, ...] = ()
    categories: tuple[str, ...] = ()
    order_by: tuple[str, ...] = ()

    def __post_init__(self):
        if not self.timestamp:
            raise ValueError(f"table {self.name} needs exactly one timestamp column")
        if len(set(self.columns)) != len(self.columns):
            raise ValueError(f"table {self.name} gives a column two roles")
        if unknown := set(self.order_by) - set(self.columns):
            raise ValueError(f"table {self.name} is ordered by columns without a role: {sorted(unknown)}")

    @property
    def columns(self) -> tuple[str, ...]:
        return (self.timestamp, *self.metrics, *self.categories)

    @property
    def sort_keys(self) -> tuple[str, ...]:
        return self.order_by or (self.timestamp,)

    def role(self, column: str) -> str:
        if column == self.timestamp:
            return "timestamp"
        if column in self.metrics:
            return "metric"
        if column in self.categories:
            return "category"
        raise ValueError(f"{column} has no role in table {self.name}")

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(c, ROLE_TYPES[self.role(c)], False, {"role": self.role(c)}) for c in self.columns])

    @classmethod
    def from_schema(cls, name: str, schema: T.StructType) -> TableSpec:
        """The spec that a schema's role metadata declares; two timestamps are an error."""
        by = {role: [f.name for f in schema if f.metadata.get("role") == role] for role in ROLE_TYPES}
        if len(by["timestamp"]) != 1:
            raise ValueError(f"table {name} needs exactly one timestamp column")
        return cls(name, by["timestamp"][0], tuple(by["metric"]), tuple(by["category"]))

    def project(self, df: DataFrame, **mapping: Column) -> DataFrame:
        """df cast to the table's columns, by name or by the expressions given. A null in any of them fails the job when it is read."""
        out = []
        for c in self.columns:
            value = mapping.get(c, F.col(c)).cast(ROLE_TYPES[self.role(c)])
            out.append(F.coalesce(value, F.raise_error(F.lit(f"null in column {c}")).cast(ROLE_TYPES[self.role(c)])).alias(c, metadata={"role": self.role(c)}))
        return df.select(*[x for x in ("seq",) if x in df.columns], *out)


#: The built-in telemetry table.
TELEMETRY = TableSpec("telemetry", "timestamp", ("cpu_usage", "mem_usage"), ("entity_id",))
