"""A report of checks in which a broken check is a row like any other.

Each check is a plan of its own: what fails while its plan is made or run becomes an
ERROR row and stops nothing else. Checks of single rows of one table are counted
together, in one pass over it, as observed metrics.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: From a Boolean, None (for information) or a status of its own.
Outcome = tuple[bool | str | None, str]
SCHEMA = "section string, check_name string, status string, failures bigint, detail string"


def _said(x: Exception) -> str:
    return f"{type(x).__name__}: {str(x).strip().splitlines()[0] if str(x).strip() else ''}"[:300]


class Report:
    """Rows of (section, check_name, status, failures, detail), in the order of the checks."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.rows: list[tuple[str, str, str, int | None, str]] = []

    def add(self, section: str, name: str, status: str, failures: int | None = None, detail: str = "") -> None:
        self.rows.append((section, name, status, failures, detail))

    def run(self, section: str, name: str, check: Callable[[], Outcome]) -> None:
        """One check of any kind; it answers with its outcome and a detail."""
        try:
            ok, detail = check()
            self.add(section, name, ok if isinstance(ok, str) else "INFO" if ok is None else "PASS" if ok else "FAIL", None, str(detail))
        except Exception as x:  # noqa: BLE001  a broken check must not hide the others
            self.add(section, name, "ERROR", None, _said(x))

    def none_of(self, section: str, name: str, failing: Callable[[], DataFrame], detail: str = "") -> None:
        """PASS if the plan has no rows; else their number."""
        try:
            n = failing().count()
            self.add(section, name, "FAIL" if n else "PASS", n, detail)
        except Exception as x:  # noqa: BLE001
            self.add(section, name, "ERROR", None, _said(x))

    def each_row(self, section: str, table: Callable[[], DataFrame], failing: dict[str, Callable[[], Column]]) -> None:
        """Of each check, how many rows of one table fail it (a null answer is no failure): one pass for all of them.

        A check whose column can't be resolved is left out of the pass. If the pass
        breaks off on some row, every check gets a pass of its own.
        """
        found: dict[str, int | Exception] = {}
        columns: dict[str, Column] = {}
        try:
            rows = table()
        except Exception as x:  # noqa: BLE001
            rows, found = None, dict.fromkeys(failing, x)
        for name, make in failing.items() if rows is not None else ():
            try:
                column = F.count_if(make())
                _ = rows.agg(column).schema
                columns[name] = column
            except Exception as x:  # noqa: BLE001
                found[name] = x
        try:
            found |= observed(rows, columns) if columns else {}
        except Exception:  # noqa: BLE001  one of them fails on some row
            for name, column in columns.items():
                try:
                    found |= observed(rows, {name: column})
                except Exception as x:  # noqa: BLE001
                    found[name] = x
        for name in failing:
            n = found[name]
            if isinstance(n, Exception):
                self.add(section, name, "ERROR", None, _said(n))
            else:
                self.add(section, name, "FAIL" if n else "PASS", n)

    @property
    def passed(self) -> bool:
        return all(status not in ("FAIL", "ERROR") for _, _, status, _, _ in self.rows)

    def table(self) -> DataFrame:
        return self.spark.createDataFrame([(n, *r) for n, r in enumerate(self.rows, 1)], f"place int, {SCHEMA}")


def observed(rows: DataFrame, metrics: dict[str, Column]) -> dict[str, int]:
    """The metrics of one pass over `rows`, of which only the columns that they use are read."""
    seen = Observation()
    named = [m.alias(f"m{i}") for i, m in enumerate(metrics.values())]
    rows.observe(seen, *named).select(F.lit(1).alias("x")).write.format("noop").mode("overwrite").save()
    got = seen.get
    return {name: got[f"m{i}"] for i, name in enumerate(metrics)}


def repeated(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def spread(rows: DataFrame, group: str, part: str) -> DataFrame:
    """Groups that stand in several parts."""
    return rows.where(F.col(group).isNotNull()).groupBy(group).agg(F.min(part).alias("a"), F.max(part).alias("b")).where("a <> b")
