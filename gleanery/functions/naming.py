"""Names of wide columns and of converted units."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATOR = "__"
#: Unit of pixels -> suffix after conversion, power of the scale.
CONVERTED = {"px": ("mm", 1), "px2": ("mm2", 2)}


def wide_name(run_name: str, part: str, metric_name: str, key: str | None = None) -> str:
    return SEPARATOR.join(str(x) for x in (run_name, part, metric_name, key) if x is not None)


def wide_name_column(run_name: Column, part: Column, metric_name: Column, key: Column) -> Column:
    return F.concat_ws(SEPARATOR, run_name, part, metric_name, key)


def converted_name(column: str, unit: str | None) -> str:
    """Name after conversion to millimetres; columns of other units keep theirs."""
    return f"{column}_{CONVERTED[unit][0]}" if unit in CONVERTED else column


def repeated_labels(names: list[str]) -> list[str]:
    """Labels of operations: the name, then name_2, name_3 for repeats."""
    seen: dict[str, int] = {}
    out = []
    for name in names:
        seen[name] = seen.get(name, 0) + 1
        out.append(name if seen[name] == 1 else f"{name}_{seen[name]}")
    return out
