"""Family counts: the one aggregation that everything else is arithmetic on.

The table is collapsed once to its distinct rows with weights, which loses nothing for any count. ``CountStore`` answers
requests for families (a node and its parents), and counts all families of a request in one job. If the collapsed table has
at most ``local_rows`` rows it is brought to the driver, and further families are counted there; otherwise it stays in Spark.

A family of at most ``DENSE_CELLS`` possible cells is an array (parent configurations by values). A larger one, of any size, is
never laid out: only its observed cells are counted, in a table of code columns (``Cells``) or, for a local store, by numbering
the combinations that occur. Scores of both kinds are the same, since cells without rows add nothing but a number of
parameters; far from the driver, cells are scored in Spark, and one row a family comes back.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import flat_index, lgamma

Family = tuple[str, tuple[str, ...]]
#: Families counted in one job; more would widen the plan beyond use.
CHUNK = 100
#: Numbers of a collapsed table that are brought to the driver.
LOCAL_NUMBERS = 10_000_000
#: Possible cells up to which a family is an array, and numbers that a store remembers of all arrays.
DENSE_CELLS = 200_000
HELD_NUMBERS = 10_000_000
#: Parent configurations up to which a flat index fits into a long.
INDEXED = 1 << 62


def collapse(codes: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Distinct rows of the columns with their number ``w``."""
    columns = columns or codes.columns
    return codes.groupBy(*[F.col(f"`{c}`") for c in columns]).agg(F.count(F.lit(1)).alias("w"))


def cardinalities(codes: DataFrame, columns: list[str] | None = None) -> dict[str, int]:
    """Largest code plus one of each column."""
    columns = columns or [c for c in codes.columns if c != "w"]
    row = codes.agg(*[F.max(F.col(f"`{c}`")).alias(str(i)) for i, c in enumerate(columns)]).first()
    return {c: int(row[i]) + 1 if row[i] is not None else 0 for i, c in enumerate(columns)}


def _cell(families: list[Family], cards: dict[str, int]) -> Column:
    """One struct (family, parent index, value) for each family of a row."""
    long = lambda p: F.col(f"`{p}`").cast("long")
    return F.explode(F.array(*[F.struct(F.lit(i).alias("f"), flat_index([long(p) for p in parents], [cards[p] for p in parents]).cast("long").alias("q"), F.col(f"`{node}`").cast("int").alias("v")) for i, (node, parents) in enumerate(families)]))


def observed_counts(collapsed: DataFrame, families: list[Family], cards: dict[str, int]) -> DataFrame:
    """f, q, v, n: counts of the cells that occur."""
    cells = collapsed.select(_cell(families, cards).alias("x"), "w").groupBy("x.f", "x.q", "x.v").agg(F.sum("w").alias("n"))
    return cells.where(F.col("v").isNotNull() & F.col("q").isNotNull())


def configurations(family: Family, cards: dict[str, int]) -> int:
    """Parent configurations, as an integer of any size."""
    return math.prod(cards[p] for p in family[1])


def cell_scores(cells: DataFrame, shapes: list[tuple[int, int]], ess: float) -> DataFrame:
    """f, like, total, bdeu from the observed cells (f, q, v, n) of families of so many configurations and values.

    Zero cells and configurations without rows add nothing to either sum, so nothing is laid out."""
    a = F.element_at(F.lit([ess / (q * r) for q, r in shapes]), F.col("f") + 1)
    a_row = F.element_at(F.lit([ess / q for q, _ in shapes]), F.col("f") + 1)
    rows = cells.where("n > 0").groupBy("f", "q").agg(F.sum("n").alias("row"), F.sum(F.col("n") * F.log("n")).alias("own"), F.sum(lgamma(a + F.col("n")) - lgamma(a)).alias("cells"))
    return rows.groupBy("f").agg(F.sum(F.col("own") - F.col("row") * F.log("row")).alias("like"), F.sum("row").alias("total"), F.sum(F.col("cells") + lgamma(a_row) - lgamma(a_row + F.col("row"))).alias("bdeu"))


def family_scores(collapsed: DataFrame, families: list[Family], cards: dict[str, int], kind: str = "bic", ess: float = 10.0) -> list[float]:
    """Scores of families of any size, in a job for every ``CHUNK`` of them; those whose configurations outnumber a long take
    a job each, grouped by the code columns themselves."""
    out = [0.0] * len(families)
    shapes = [(configurations(f, cards), cards[f[0]]) for f in families]
    plain = [i for i, (q, _) in enumerate(shapes) if q < INDEXED]
    parts = [plain[k : k + CHUNK] for k in range(0, len(plain), CHUNK)] + [[i] for i, (q, _) in enumerate(shapes) if q >= INDEXED]
    for part in parts:
        own, sizes = [families[i] for i in part], [shapes[i] for i in part]
        if sizes[0][0] < INDEXED:
            cells = observed_counts(collapsed, own, cards)
        else:
            node, parents = own[0]
            key = F.struct(*[F.col(f"`{p}`") for p in parents])
            cells = collapsed.select(F.lit(0).alias("f"), key.alias("q"), F.col(f"`{node}`").alias("v"), "w").groupBy("f", "q", "v").agg(F.sum("w").alias("n"))
        for row in cell_scores(cells, sizes, ess).collect():  # one row a family
            q, r = sizes[row["f"]]
            out[part[row["f"]]] = row["bdeu"] if kind == "bdeu" else row["like"] - 0.5 * q * (r - 1) * math.log(max(row["total"], 1.0))
    return out


@dataclass(frozen=True)
class Cells:
    """A family's observed cells: a code column for each parent and the node, under their own names, and ``n``. With ``total``
    they stand for joint probabilities among so many rows, else for those of the node given its parents."""

    family: Family
    table: DataFrame
    cards: dict[str, int]
    total: float | None = None

    @property
    def size(self) -> int:
        return configurations(self.family, self.cards) * self.cards[self.family[0]]


def complete_counts(collapsed: DataFrame, families: list[Family], cards: dict[str, int]) -> DataFrame:
    """As observed_counts, with the cells that don't occur as 0."""
    spark = collapsed.sparkSession
    shape = [(i, int(np.prod([cards[p] for p in parents], dtype=np.int64)), cards[node]) for i, (node, parents) in enumerate(families)]
    grid = spark.createDataFrame(shape, "f int, nq long, nv int").select("f", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nq") - 1)).alias("q"), "nv").select("f", "q", F.explode(F.sequence(F.lit(0), F.col("nv") - 1)).alias("v"))
    return grid.join(observed_counts(collapsed, families, cards), ["f", "q", "v"], "left").select("f", "q", "v", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


class CountStore:
    def __init__(self, codes: DataFrame, local_rows: int = 200_000, cards: dict[str, int] | None = None):
        self.columns = [c for c in codes.columns if c != "w"]
        self.collapsed = (codes if "w" in codes.columns else collapse(codes)).persist()
        self.cards = cards or cardinalities(self.collapsed, self.columns)
        self.counts: dict[Family, np.ndarray] = {}
        self.local: dict[str, np.ndarray] | None = None
        local_rows = min(local_rows, LOCAL_NUMBERS // (len(self.columns) + 1))
        got = self.collapsed.limit(local_rows + 1).toPandas()
        if len(got) <= local_rows:
            self.local = {c: got[c].to_numpy(np.int64) for c in self.columns}
            self.weight = got["w"].to_numpy(np.float64)
            self.rows = float(self.weight.sum())
        else:
            self.rows = float(self.collapsed.agg(F.sum("w")).first()[0])

    def shape(self, family: Family) -> tuple[int, int]:
        return configurations(family, self.cards), self.cards[family[0]]

    def dense(self, family: Family) -> bool:
        q, r = self.shape(family)
        return q * r <= DENSE_CELLS

    def cells(self, family: Family) -> Cells:
        """The family's observed cells, as a table."""
        node, parents = family
        keys = [F.col(f"`{c}`") for c in (*parents, node)]
        return Cells(family, self.collapsed.where(" AND ".join(f"`{c}` IS NOT NULL" for c in (*parents, node))).groupBy(*keys).agg(F.sum("w").alias("n")), self.cards)

    def counts_or_cells(self, family: Family) -> np.ndarray | Cells:
        return self.get(*family) if self.dense(family) else self.cells(family)

    def index(self, parents: tuple[str, ...], override: dict[str, int] | None = None) -> np.ndarray:
        """Parent configuration of each local row, with some columns held at a value."""
        out = np.zeros(len(self.weight), np.int64)
        for p in parents:
            out = out * self.cards[p] + (override[p] if override and p in override else self.local[p])
        return out

    def numbered(self, columns: tuple[str, ...], overrides: list[dict[str, int]] = ()) -> np.ndarray:
        """Numbers of the combinations that occur: of the local rows as they are, then with each override."""
        n = len(self.weight)
        at, bound = np.zeros(n * (len(overrides) + 1), np.int64), 1
        for c in columns:
            own = np.concatenate([self.local[c], *(np.full(n, o[c]) if c in o else self.local[c] for o in overrides)])
            if bound * self.cards[c] >= INDEXED:
                at = np.unique(at, return_inverse=True)[1]
                bound = int(at.max()) + 1
            at, bound = at * self.cards[c] + own, bound * self.cards[c]
        return np.unique(at, return_inverse=True)[1].reshape(len(overrides) + 1, n)

    def looked_up(self, columns: tuple[str, ...], overrides: list[dict[str, int]]) -> np.ndarray:
        """For each override and local row, the rows that have its combination."""
        ids = self.numbered(columns, overrides)
        return np.bincount(ids[0], self.weight, int(ids.max(initial=0)) + 1)[ids[1:]]

    def local_cells(self, family: Family) -> tuple[np.ndarray, np.ndarray]:
        """Counts of the observed cells, and the number of each one's configuration."""
        rows, cells = self.numbered(family[1])[0], self.numbered((*family[1], family[0]))[0]
        _, first = np.unique(cells, return_index=True)
        return np.bincount(cells, self.weight), rows[first]

    def parts(self, families: list[Family]):
        """The families that are arrays, in lists that the store can remember together."""
        own, held = [], 0
        for f in families:
            size = math.prod(self.shape(f))
            if own and held + size > HELD_NUMBERS:
                yield own
                own, held = [], 0
            own.append(f)
            held += size
        if own:
            yield own

    def ensure(self, families) -> None:
        """Count those of the families that are arrays and not known yet."""
        new = [f for f in dict.fromkeys(families) if f not in self.counts and self.dense(f)]
        while self.counts and sum(c.size for c in self.counts.values()) + sum(math.prod(self.shape(f)) for f in new) > HELD_NUMBERS:
            del self.counts[next(iter(self.counts))]  # the oldest are counted again if asked for
        if self.local is not None:
            for node, parents in new:
                q, r = self.shape((node, parents))
                at = self.index(parents) * r + self.local[node]
                self.counts[node, parents] = np.bincount(at, self.weight, q * r).reshape(q, r)
            return
        for a in range(0, len(new), CHUNK):
            part = new[a : a + CHUNK]
            got = observed_counts(self.collapsed, part, self.cards).toPandas()  # at most DENSE_CELLS rows a family
            for i, f in enumerate(part):
                own = got[got["f"] == i]
                self.counts[f] = np.zeros(self.shape(f))
                self.counts[f][own["q"].to_numpy(), own["v"].to_numpy()] = own["n"].to_numpy()

    def get(self, node: str, parents: tuple[str, ...]) -> np.ndarray:
        """Counts, parent configurations by values, of a family that is an array."""
        f = (node, tuple(parents))
        if f not in self.counts:
            if not self.dense(f):
                raise ValueError(f"{node} given {', '.join(f[1])} has more than {DENSE_CELLS} cells: use cells()")
            self.ensure([f])
        return self.counts[f]

    def release(self) -> None:
        self.collapsed.unpersist()
