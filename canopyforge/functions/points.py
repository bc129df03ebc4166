"""Point views and grid arithmetic.

Points are rows (x, y, z, ...); missing values are NULL, and NaN or infinite ones become NULL where points enter. A grid is
given by its origin, cell size and, where a rule clips to it, its shape; cells are integer pairs. Origins are global by default, so
that results do not depend on tiling.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A point cloud made from the order lines of the test tables: dyadic coordinates, a tilted plane and heights over it.
POINTS_SQL = """
select cast(l_orderkey*8+l_linenumber as bigint) as point_id, x, y, 100.0e0 + 0.125e0*x + 0.0625e0*y + h as z, h,
       cls as classification, cast(1 + l_linenumber % 3 as int) as return_number, cast(3 as int) as number_of_returns,
       cast(year(l_shipdate) as int) as epoch
from (select *,
        cast(case when l_quantity<=15 then 2 else 1 end as int) as cls,
        (l_partkey % 200)*0.25e0 + (l_suppkey % 4)*0.0625e0 as x,
        (l_orderkey % 192)*0.25e0 + (l_linenumber % 4)*0.0625e0 as y,
        case when l_quantity<=15
             then ((l_orderkey*7+l_partkey*13+l_linenumber*3) % 4)*0.03125e0
             else ((l_orderkey*7+l_partkey*13+l_linenumber*3) % 480)*0.0625e0 end as h
      from lineitem) t
"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The point cloud of the test tables."""
    return spark.sql(POINTS_SQL.replace("from lineitem)", "from {lines})"), lines=spark.read.parquet(f"{sf_dir}/lineitem.parquet"))


def finite(df: DataFrame, *columns: str) -> DataFrame:
    """df with NaN and infinite values of the columns as NULL."""
    for c in columns:
        df = df.withColumn(c, F.when(~F.isnan(c) & (F.abs(F.col(c)) < float("inf")), F.col(c)))
    return df


def cell(v: Column | str, cell_m: float, origin: float = 0.0) -> Column:
    """Index of the cell that a coordinate lies in, counted from origin."""
    v = F.col(v) if isinstance(v, str) else v
    return F.floor((v - F.lit(origin)) / F.lit(cell_m)).cast("int")


def with_cells(df: DataFrame, cell_m: float, x0: float = 0.0, y0: float = 0.0) -> DataFrame:
    """Adds ix, iy of a grid with its origin at the lower left."""
    return df.withColumns({"ix": cell("x", cell_m, x0), "iy": cell("y", cell_m, y0)})


@dataclass(frozen=True)
class Grid:
    """A north-up grid. rule: how bounds become a shape — `arange` and `ceil` cover them, `floor1` has one cell more at an
    exact edge; clip: are points beyond it put into its last cells, or dropped?"""

    xmin: float
    ymax: float
    res: float
    nx: int
    ny: int
    clip: bool = True

    @staticmethod
    def of(bounds: tuple[float, float, float, float], res: float, rule: str = "arange") -> Grid:
        from math import ceil, floor

        xmin, ymin, xmax, ymax = bounds
        w, h = (xmax - xmin) / res, (ymax - ymin) / res
        if rule == "arange":
            return Grid(xmin, ymax, res, max(1, ceil(w - 0.5)), max(1, ceil(h - 0.5)))
        if rule == "floor1":
            return Grid(xmin, ymax, res, floor(w) + 1, floor(h) + 1)
        if rule == "ceil":
            return Grid(xmin, ymax, res, max(1, ceil(w)), max(1, ceil(h)), clip=False)
        raise ValueError(f"unknown grid rule {rule!r}")

    def index(self, df: DataFrame) -> DataFrame:
        """Adds col, row, counted from the upper left."""
        col, row = F.floor((F.col("x") - self.xmin) / self.res).cast("int"), F.floor((F.lit(self.ymax) - F.col("y")) / self.res).cast("int")
        if self.clip:
            return df.withColumns({"col": F.greatest(F.lit(0), F.least(F.lit(self.nx - 1), col)), "row": F.greatest(F.lit(0), F.least(F.lit(self.ny - 1), row))})
        return df.withColumns({"col": col, "row": row}).where(F.col("col").between(0, self.nx - 1) & F.col("row").between(0, self.ny - 1))

    def centres(self, df: DataFrame) -> DataFrame:
        """Adds the centre x, y of col, row."""
        return df.withColumns({"x": self.xmin + (F.col("col") + 0.5) * self.res, "y": F.lit(self.ymax) - (F.col("row") + 0.5) * self.res})


def bounds_of(df: DataFrame) -> DataFrame:
    return df.agg(F.min("x").alias("xmin"), F.min("y").alias("ymin"), F.max("x").alias("xmax"), F.max("y").alias("ymax"))


#: Most different values that are gathered to find a percentile among them.
MOST_VALUES = 100_000


def exact_percentile(df: DataFrame, column: Column | str, q: float, weight: Column | str | None = None) -> float | None:
    """The linear percentile of a column's values over a whole table, NULL and NaN left out; None if there are none. weight: how often
    a row's value counts, a whole number.

    An exact aggregate would hold every different value in one task. Here approximate percentiles bracket the two ranks, the rows
    outside are counted, and the bracket shrinks until it has few different values; those are gathered with their counts.
    """
    w = F.lit(1) if weight is None else F.col(weight) if isinstance(weight, str) else weight
    v = df.select((F.col(column) if isinstance(column, str) else column).cast("double").alias("v"), w.cast("long").alias("w")).where("v is not null and not isnan(v) and w > 0")

    def many(*holds: Column) -> list[int]:
        return [x or 0 for x in v.agg(*[F.sum(F.when(h, F.col("w"))) for h in holds]).first()]

    n, lo, hi = v.agg(F.sum("w"), F.min("v"), F.max("v")).first()
    if not n:
        return None
    rank = q * (n - 1)
    first, below, inside = int(rank), 0, n
    last = min(first + 1, n - 1)
    while lo < hi:
        rows = v.where(F.col("v").between(lo, hi))
        if inside <= MOST_VALUES or rows.agg(F.approx_count_distinct("v", 0.02)).first()[0] <= MOST_VALUES:
            seen, ends = below, []
            for r in sorted(rows.groupBy("v").agg(F.sum("w").alias("w")).collect()):
                ends += [r.v] * ((seen <= first < seen + r.w) + (seen <= last < seen + r.w))
                seen += r.w
            lo, hi = ends
            break
        at = [max(0.0, (first - below) / inside - 0.002), min(1.0, (last - below) / inside + 0.002)]
        a, b = rows.agg(F.percentile_approx("v", at, 10_000)).first()[0]
        under, upto = many(F.col("v") < a, F.col("v") <= b)
        a, under = (a, under) if under <= first else (lo, below)
        b, upto = (b, upto) if upto > last else (hi, below + inside)
        if (a, b) == (lo, hi):  # halve it instead
            mid = lo + (hi - lo) / 2
            upto = many(F.col("v") <= mid)[0]
            if upto > last:
                b = mid
            elif upto <= first:
                a, under, upto = mid, upto, below + inside
            else:  # the ranks lie on both sides: the greatest below and the least above
                lo, hi = (x for x in v.agg(F.max(F.when(F.col("v") <= mid, F.col("v"))), F.min(F.when(F.col("v") > mid, F.col("v")))).first())
                break
        lo, hi, below, inside = a, b, under, upto - under
    return lo + (rank - first) * (hi - lo) if hi > lo else lo


def numbered(df: DataFrame, by: str, name: str) -> DataFrame:
    """df with 1, 2, ... in order of a column whose values differ, counted by ranges side by side; a window over all rows would put
    them into one task. What is gathered is one count a range."""
    from .storage import written

    rows = written(df.repartitionByRange(by).sortWithinPartitions(by).withColumn("_at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_at", 33)
    counts = sorted(rows.groupBy(part.alias("part")).count().collect())
    before, offsets = 0, []
    for r in counts:
        offsets.append((r.part, before))
        before += r["count"]
    starts = F.broadcast(df.sparkSession.createDataFrame(offsets, "_part long, _before long"))
    return rows.withColumn("_part", part).join(starts, "_part").withColumn(name, (F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1).cast("int")).drop("_at", "_part", "_before")
