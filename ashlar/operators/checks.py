"""Declarative checks: named conditions gathered in a table, raised together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .quantiles import kept


class CheckFailed(RuntimeError):
    pass


class Checks:
    """Ordered (check, passed, detail) entries; ``require`` raises if any failed."""

    def __init__(self) -> None:
        self.rows: list[tuple[str, bool, str]] = []

    def add(self, name: str, passed: bool, detail: object = "") -> Checks:
        if any(n == name for n, _, _ in self.rows):
            raise ValueError(f"check {name} is there already")
        self.rows.append((name, bool(passed), str(detail)))
        return self

    def over(self, df: DataFrame, conditions: dict[str, Column]) -> Checks:
        """Aggregate conditions of one table, all in one pass."""
        row = df.agg(*(c.alias(n) for n, c in conditions.items())).first()
        for n in conditions:
            self.add(n, bool(row[n]), row[n])
        return self

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, "check string, passed boolean, detail string")

    def require(self) -> Checks:
        failed = [n for n, ok, _ in self.rows if not ok]
        if failed:
            raise CheckFailed("failed: " + ", ".join(failed))
        return self


def key_sets(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """How two key sets relate: sizes, common keys, differences, and whether they are equal, disjoint or nested."""
    x, y = a.select(key).distinct().withColumn("a", F.lit(1)), b.select(key).distinct().withColumn("b", F.lit(1))
    n = x.join(y, key, "full_outer").agg(F.count("a").alias("a_n"), F.count("b").alias("b_n"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("common_n"), F.count_if(F.col("b").isNull()).alias("only_a_n"), F.count_if(F.col("a").isNull()).alias("only_b_n"))
    return n.withColumns({"disjoint": F.col("common_n") == 0, "equal": (F.col("only_a_n") == 0) & (F.col("only_b_n") == 0), "a_in_b": F.col("only_a_n") == 0})


def join_one_to_one(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """A left join that raises if the key repeats on either side; one aggregate looks at both."""
    both = a.select(key, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(b.select(key, F.lit(0).alias("l"), F.lit(1).alias("r")))
    most = both.groupBy(key).agg(F.sum("l").alias("l"), F.sum("r").alias("r")).agg(F.max("l").alias("left"), F.max("r").alias("right")).first()
    for side in ("left", "right"):
        if (most[side] or 0) > 1:
            raise CheckFailed(f"{key} repeats on the {side} side")
    return a.join(b, key, "left")


def join_counts(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Two aggregates of the same key side by side; what one lacks is 0."""
    numbers = [c for c in (*a.columns, *b.columns) if c != key]
    return a.join(b, key, "full_outer").na.fill(0, numbers)


def side_by_side(key: str, *tables: DataFrame) -> DataFrame:
    """Tables with the same keys joined column by column; raises if the keys differ or repeat."""
    out = tables[0]
    for t in tables[1:]:
        if not key_sets(out, t, key).first()["equal"]:
            raise CheckFailed(f"the tables' {key} differ")
        out = join_one_to_one(out, t, key)
    return out


def gathered(df: DataFrame, key: str, wanted: DataFrame, position: str = "position") -> DataFrame:
    """The rows of the wanted keys (key, position) in the order of their positions, with the position."""
    return df.join(wanted.select(key, position), key).orderBy(position)


def with_position(df: DataFrame, *order: str, name: str = "position") -> DataFrame:
    """``df`` plus its row's place from 0 in a total order, by range partitions and their counts, so no task sorts everything."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # the partition's number and the place in it are read off the sorted ranges, in one scan of what is kept
    placed = kept(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumns({"__part": F.spark_partition_id(), "__at": F.monotonically_increasing_id() % F.lit(1 << 33)}))
    counts = sorted(placed.groupBy("__part").agg(F.count("*")).collect())
    base, total = [], 0
    for part, c in counts:
        base.append((part, total))
        total += c
    bases = df.sparkSession.createDataFrame(base, "__part int, __base long")
    return placed.join(F.broadcast(bases), "__part").withColumn(name, F.col("__base") + F.col("__at")).select(*df.columns, name)


def monotone(df: DataFrame, order: str, value: str) -> DataFrame:
    """Rows, and how many have a value below the one before them; meant for small tables of parameters."""
    step = F.col(value) - F.lag(value).over(Window.orderBy(order))
    return df.withColumn("__step", step).agg(F.count("*").alias("n"), F.count_if(F.col("__step") < 0).alias("decreasing_n"))


def valid_assignment(df: DataFrame, columns: tuple[str, ...] = ("record", "target", "partition", "position")) -> Checks:
    """Checks of a split assignment: column order, unique keys, positions without a gap, known sides."""
    key, _, side, position = columns
    checks = Checks().add("column_order", tuple(df.columns) == columns, ",".join(df.columns))
    if not set(columns) <= set(df.columns):
        return checks
    keys = df.groupBy(key).agg(F.count("*").alias("n")).agg(F.count("*").alias("keys"), F.max("n").alias("most")).first()
    row = df.agg(F.count("*").alias("n"), F.min(position).alias("lo"), F.max(position).alias("hi"), F.count_distinct(position).alias("places"), F.count_if(~F.coalesce(F.col(side).isin("train", "test"), F.lit(False))).alias("unknown")).first()
    checks.add("unique_key", (keys["most"] or 0) <= 1, keys["keys"])
    checks.add("contiguous_position", row["n"] == 0 or (row["hi"] - row["lo"] + 1 == row["n"] == row["places"]), row["places"])
    return checks.add("known_sides", row["unknown"] == 0, row["unknown"])
