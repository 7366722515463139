"""Exact functional dependencies between columns, their lookup tables and their cost."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relweave.operators.affine import _reject_nulls


@dataclass(frozen=True)
class Dependency:
    z: str
    sources: tuple[str, ...]
    n_entries: int

    def cost_bits(self, value_bits: int, key_bits: list[int]) -> int:
        return mapping_cost_bits(self.n_entries, value_bits, key_bits)


def mapping_cost_bits(n_entries: int, value_bits: int, key_bits: list[int]) -> int:
    """A count of 32 bits, then a key and a value an entry; nothing is shared."""
    return 32 + n_entries * (sum(key_bits) + value_bits)


def grouped_by(df: DataFrame, sources: list[str], targets: list[str]) -> tuple[int, dict[str, bool]]:
    """Distinct source tuples, and whether each target is a function of them: one aggregate, combined before its shuffle.

    A null in any of the columns raises, as in every search for relations; it is counted in the same aggregate.
    """
    missing = lambda names: sum((F.col(c).isNull().cast("int") for c in names), F.lit(0))
    groups = df.groupBy(*sources).agg(F.sum(missing([*sources, *targets])).alias("missing"), *[F.min(z).alias(f"lo{i}") for i, z in enumerate(targets)], *[F.max(z).alias(f"hi{i}") for i, z in enumerate(targets)])
    got = groups.agg(F.count("*").alias("n"), F.sum("missing").alias("missing"), *[F.bool_and(F.col(f"lo{i}") == F.col(f"hi{i}")).alias(f"ok{i}") for i in range(len(targets))]).first()
    if got["missing"]:
        raise ValueError("dependencies need columns without nulls; drop such rows first")
    return got["n"], {z: got[f"ok{i}"] is not False for i, z in enumerate(targets)}


def is_function_of(df: DataFrame, z: str, sources: list[str]) -> bool:
    return grouped_by(df, sources, [z])[1][z]


def lookup_table(df: DataFrame, z: str, sources: list[str]) -> DataFrame | None:
    """The distinct (sources, z) rows; None if z is no function of the sources."""
    return df.select(*sources, z).dropDuplicates() if is_function_of(df, z, sources) else None


def discover_maps(df: DataFrame, columns: list[str], max_sources: int = 2, max_entries: int | None = None) -> list[Dependency]:
    """From left to right: a column goes if one, else two, earlier independent columns map to it with few enough entries."""
    _reject_nulls(df, columns)
    if max_entries is None:
        max_entries = max(1, df.count() // 2)
    known: dict[tuple[str, ...], tuple[int, dict[str, bool]]] = {}

    def entries(z: str, sources: tuple[str, ...]) -> int | None:
        if sources not in known:
            last = max(columns.index(s) for s in sources)
            known[sources] = grouped_by(df, list(sources), columns[last + 1 :])
        n, ok = known[sources]
        return n if ok[z] and n <= max_entries else None

    independent: list[str] = []
    found: list[Dependency] = []
    for z in columns:
        tries = [(s,) for s in independent] + (list(combinations(independent, 2)) if max_sources >= 2 else [])
        hit = next((Dependency(z, s, n) for s in tries if (n := entries(z, s)) is not None), None)
        found.append(hit) if hit else independent.append(z)
    return found
