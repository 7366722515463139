"""Exact integer-affine relations z = a x + b y + c between LONG columns.

Three passes whatever the number of rows: extreme points of every pair of source columns; of each pair the point that
is furthest from the line through them; then one count of violations for all candidates together. The points determine
each candidate uniquely, so the order of rows does not matter. Coefficients are solved on the driver in whole numbers.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: More columns than this would make more pairs than one aggregate should hold.
MOST_COLUMNS = 24
_BIG = "decimal(38,0)"


@dataclass(frozen=True)
class AffineRelation:
    z: str
    x: str
    y: str | None
    a: int
    b: int
    c: int

    def expression(self) -> Column:
        """The value as DECIMAL(38, 0), or null where it does not fit."""
        terms = [F.lit(str(self.c)).cast(_BIG)]
        for name, k in ((self.x, self.a), (self.y, self.b)):
            if name is not None and k:
                terms.append(F.try_multiply(F.col(name).cast(_BIG), F.lit(str(k)).cast(_BIG)))
        out = terms[0]
        for t in terms[1:]:
            out = F.try_add(out, t)
        return out.cast(_BIG)

    def as_row(self) -> dict:
        return {"z_col": self.z, "x_col": self.x, "y_col": self.y, "a": self.a, "b": self.b, "c": self.c}


def _reject_nulls(df: DataFrame, columns: list[str]) -> None:
    if df.where(" or ".join(f"`{c}` is null" for c in columns)).limit(1).count():
        raise ValueError("relation discovery needs columns without nulls; drop such rows first")


class AffineSearch:
    """Which relations hold, from three passes over ``df``."""

    def __init__(self, df: DataFrame, columns: list[str]):
        if len(columns) > MOST_COLUMNS:
            raise ValueError(f"at most {MOST_COLUMNS} columns at once")
        self.columns = columns
        self.df = df.select(*[F.col(c).cast("long").alias(c) for c in columns])
        _reject_nulls(self.df, columns)
        self._points()
        self._verify()

    def _points(self) -> None:
        cols = self.columns
        point = lambda *first: F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(first)], *cols)
        self.pairs = list(combinations(cols, 2))
        keys = [(c,) for c in cols] + self.pairs
        got = self.df.agg(F.count("*").alias("n"), *[f(point(*k)).alias(f"{n}_{i}") for i, k in enumerate(keys) for n, f in (("lo", F.min), ("hi", F.max))]).first()
        self.n_rows = got["n"]
        take = lambda r: {c: int(r[c]) for c in cols}
        self.ends = {k: (take(got[f"lo_{i}"]), take(got[f"hi_{i}"])) for i, k in enumerate(keys)} if self.n_rows else {}
        if not self.n_rows:
            return
        third = []
        for i, (x, y) in enumerate(self.pairs):
            p, q = self.ends[x, y]
            num = lambda v: F.lit(str(v)).cast(_BIG)
            dx, dy = F.col(x).cast(_BIG) - num(p[x]), F.col(y).cast(_BIG) - num(p[y])
            cross = F.try_add(F.try_multiply(dx, num(q[y] - p[y])), -F.try_multiply(dy, num(q[x] - p[x])))
            # a product that does not fit is far from the line
            far = F.coalesce(F.abs(cross.cast("double")), F.lit(1e300))
            third.append(F.max_by(F.struct(*cols), far).alias(f"p{i}"))
            third.append(F.count_if(~(((F.col(x) == p[x]) & (F.col(y) == p[y])) | ((F.col(x) == q[x]) & (F.col(y) == q[y])))).alias(f"n{i}"))
        got = self.df.agg(*third).first() if third else {}
        self.third = {k: (take(got[f"p{i}"]), got[f"n{i}"]) for i, k in enumerate(self.pairs)}

    def _univariate(self, z: str, x: str) -> AffineRelation | None:
        p, q = self.ends[x,]
        if p[x] == q[x]:
            lo, hi = self.ends[z,]
            return AffineRelation(z, x, None, 0, 0, lo[z]) if lo[z] == hi[z] else None
        dz, dx = q[z] - p[z], q[x] - p[x]
        if dz % dx:
            return None
        return AffineRelation(z, x, None, dz // dx, 0, p[z] - dz // dx * p[x])

    def _bivariate(self, z: str, x: str, y: str) -> AffineRelation | None:
        """Through three points that are not on a line; None where all points of the pair are."""
        x, y = (x, y) if (x, y) in self.third else (y, x)
        p, q = self.ends[x, y]
        if (p[x], p[y]) == (q[x], q[y]):
            return AffineRelation(z, x, y, 0, 0, p[z])
        r, others = self.third[x, y]
        if not others:
            return None  # two distinct points: left to the univariate forms
        ax, ay, az = q[x] - p[x], q[y] - p[y], q[z] - p[z]
        bx, by, bz = r[x] - p[x], r[y] - p[y], r[z] - p[z]
        det = ax * by - ay * bx
        if not det or (az * by - bz * ay) % det or (ax * bz - bx * az) % det:
            return None
        a, b = (az * by - bz * ay) // det, (ax * bz - bx * az) // det
        return AffineRelation(z, x, y, a, b, p[z] - a * p[x] - b * p[y])

    def _verify(self) -> None:
        if not self.n_rows:
            self.uni, self.bi = {}, {}
            return
        cols = self.columns
        uni = {(z, x): r for z in cols for x in cols if x != z and (r := self._univariate(z, x))}
        bi = {(z, *p): r for z in cols for p in self.pairs if z not in p and (r := self._bivariate(z, *p))}
        bad = count_violations(self.df, [*uni.values(), *bi.values()])
        self.uni = {k: r for k, r in uni.items() if not bad[r]}
        self.bi = {k: r for k, r in bi.items() if not bad[r]}

    def bivariate(self, z: str, x: str, y: str) -> AffineRelation | None:
        """The pair's relation; with only two distinct points the relation in x, else in y."""
        key = (z, x, y) if (x, y) in self.third else (z, y, x)
        if key in self.bi:
            r = self.bi[key]
            return r if (r.x, r.y) == (x, y) else AffineRelation(z, x, y, r.b, r.a, r.c)
        p, q = self.ends[key[1:]]
        if (p[x], p[y]) != (q[x], q[y]) and not self.third[key[1:]][1]:
            if (z, x) in self.uni:
                u = self.uni[z, x]
                return AffineRelation(z, x, y, u.a, 0, u.c)
            return self.uni.get((z, y))
        return None

    def greedy(self) -> tuple[list[str], list[AffineRelation]]:
        """Independent columns and relations: the rightmost column that others express goes, until none does."""
        left, found = list(self.columns), []
        while True:
            for z in reversed(left):
                others = [c for c in left if c != z]
                r = next((self.uni[z, x] for x in others if (z, x) in self.uni), None) or next((b for x, y in combinations(others, 2) if (b := self.bivariate(z, x, y))), None)
                if r:
                    break
            else:
                order = {c: i for i, c in enumerate(self.columns)}
                return left, sorted(found, key=lambda r: order[r.z])
            left.remove(z)
            found.append(r)


def count_violations(df: DataFrame, relations: list[AffineRelation]) -> dict[AffineRelation, int]:
    """Rows on which each relation fails, in one pass. A value that no DECIMAL(38, 0) holds cannot equal a LONG unless its parts cancel; such rows are counted in whole Python numbers."""
    if not relations:
        return {}
    aggs = []
    for i, r in enumerate(relations):
        value = r.expression()
        aggs += [F.count_if(value.isNotNull() & (value != F.col(r.z).cast(_BIG))).alias(f"v{i}"), F.count_if(value.isNull()).alias(f"u{i}")]
    got = df.agg(*aggs).first()
    out = {}
    for i, r in enumerate(relations):
        out[r] = got[f"v{i}"] + (_exact_violations(df, r) if got[f"u{i}"] else 0)
    return out


def _exact_violations(df: DataFrame, r: AffineRelation) -> int:
    names = [c for c in dict.fromkeys([r.z, r.x, r.y]) if c]

    def run(batches):
        import pandas as pd

        for b in batches:
            x = b[r.x].astype(object)
            value = x * r.a + r.c + (b[r.y].astype(object) * r.b if r.y is not None else 0)
            yield pd.DataFrame({"bad": [int((value != b[r.z].astype(object)).sum())]})

    return df.where(r.expression().isNull()).select(*names).mapInPandas(run, "bad long").agg(F.coalesce(F.sum("bad"), F.lit(0))).first()[0]


def discover_affine(df: DataFrame, columns: list[str]) -> tuple[list[str], list[AffineRelation]]:
    return AffineSearch(df, columns).greedy()


_RELATIONS = "z_col string, x_col string, y_col string, a string, b string, c string"


def relations_frame(df: DataFrame, relations: list[AffineRelation]) -> DataFrame:
    """Relations as rows; coefficients as BIGINT where all fit, else DECIMAL(38, 0)."""
    rows = [(r.z, r.x, r.y, str(r.a), str(r.b), str(r.c)) for r in relations]
    kind = "bigint" if all(abs(k) < 1 << 63 for r in relations for k in (r.a, r.b, r.c)) else _BIG
    return df.sparkSession.createDataFrame(rows, _RELATIONS).select("z_col", "x_col", "y_col", *[F.col(k).cast(kind).alias(k) for k in "abc"])


def apply_relations(df: DataFrame, relations: list[AffineRelation]) -> DataFrame:
    """``df`` with the dependent columns added, in an order that their sources allow."""
    todo = list(relations)
    while todo:
        ready = [r for r in todo if r.x in df.columns and (r.y is None or r.y in df.columns)]
        if not ready:
            raise ValueError("the relations are cyclic or lack a source")
        df = df.withColumns({r.z: r.expression().cast("long") for r in ready})
        todo = [r for r in todo if r not in ready]
    return df
