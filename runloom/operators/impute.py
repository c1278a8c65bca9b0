"""Filling missing values from similar records with a Chow-Liu dependency tree.

Numeric fields are discretised at quantiles, categorical ones into their most frequent values plus hash buckets, and
what the other rows of the same group (job, commit, test) say are fields of their own, for every group, frequent or not. The tree that keeps most of the pairwise
mutual information over all rows is found from contingency tables; for a row with missing cells, messages along the
tree give the posterior of each missing field given what the row has. It is decoded to its median, which has the least
expected distance in bins, and there to a group's own value where a group has one in that bin, else to the bin's median.

The model is bounded whatever the data: ``bins`` per numeric field, ``top + buckets`` per categorical one of few values; columns
of many values take part through their groups. Counts, quantiles and tables cover all rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runloom.session import stored

Aliases = Callable[[DataFrame], DataFrame]
SMALL = 1_000_000
GROUP = "of_"
SLICE = 16_384  # rows whose codes stay in the cache while their pairs are counted

@dataclass
class Bins:
    """Cuts between bins and the median of each."""

    cuts: list[float]
    medians: list[float]

    @property
    def size(self) -> int:
        return len(self.medians)

    @staticmethod
    def of(points: Sequence[float] | None) -> Bins:
        """From quantiles at even steps: every second one is a cut, bins that ties make empty are merged."""
        if not points:
            return Bins([], [])
        q = np.asarray(points, dtype=float)
        cuts = np.unique(q[1::2])
        cuts = cuts[cuts > q[0]]
        at = np.searchsorted(cuts, q, side="right")
        return Bins(cuts.tolist(), [float(np.median(q[at == b])) if (at == b).any() else float(cuts[b - 1]) for b in range(len(cuts) + 1)])


def codes_of(values: np.ndarray, cuts: Sequence[float]) -> np.ndarray:
    """The number of cuts <= value, -1 for NaN."""
    return np.where(np.isnan(values), -1, np.searchsorted(cuts, values, side="right"))


@dataclass
class Tree:
    """The dependency tree: per field its log marginal, per edge log P(a, b) / (P(a) P(b)) in both directions."""

    names: list[str]
    edges: list[tuple[int, int]]
    marginal: list[np.ndarray]
    link: dict[tuple[int, int], np.ndarray]
    near: list[list[int]] = field(default_factory=list)

    @staticmethod
    def learn(names: list[str], sizes: list[int], tables: dict[tuple[int, int], np.ndarray]) -> Tree:
        """``tables``: for each pair a < b the counts of rows that have both. The tree of greatest mutual information."""
        gain, joint = {}, {}
        for (a, b), n in tables.items():
            p = (n + 0.5 / n.size) / (n.sum() + 0.5)
            pa, pb = p.sum(1), p.sum(0)
            joint[a, b] = p
            ratio = np.log(p) - np.log(pa)[:, None] - np.log(pb)[None, :]
            gain[a, b] = float((p * ratio).sum()) if n.sum() else 0.0
        inside, edges = {0}, []
        while len(inside) < len(names):
            a, b = max((e for e in gain if (e[0] in inside) != (e[1] in inside)), key=lambda e: (gain[e], -e[0], -e[1]))
            edges.append((a, b))
            inside |= {a, b}
        marginal = []
        for k, s in enumerate(sizes):
            n = sum((t.sum(1 if a == k else 0) for (a, b), t in tables.items() if k in (a, b)), np.zeros(s))
            marginal.append(np.log((n + 0.5 / s) / (n.sum() + 0.5)))
        link, near = {}, [[] for _ in names]
        for a, b in edges:
            p = joint[a, b]
            ratio = np.log(p) - np.log(p.sum(1))[:, None] - np.log(p.sum(0))[None, :]
            link[a, b], link[b, a] = ratio, ratio.T
            near[a].append(b)
            near[b].append(a)
        return Tree(names, edges, marginal, link, near)

    def posterior(self, target: int, codes: np.ndarray, pattern: tuple[bool, ...]) -> np.ndarray:
        """log P(target | what is observed) up to a constant, for rows of one pattern of missing fields. codes: rows x fields."""

        def message(source: int, to: int) -> np.ndarray:
            if not pattern[source]:  # observed: what lies behind it does not matter
                return self.link[source, to][codes[:, source]]
            own = belief(source, to)
            own = np.exp(own - own.max(1, keepdims=True))
            return np.log(own @ np.exp(self.link[source, to]) + 1e-300)

        def belief(node: int, but: int) -> np.ndarray:
            total = np.broadcast_to(self.marginal[node], (len(codes), len(self.marginal[node]))).copy()
            for other in self.near[node]:
                if other != but:
                    total += message(other, node)
            return total

        return belief(target, -1)

    def told_by(self, target: int, pattern: tuple[bool, ...]) -> list[int]:
        """The observed fields that the posterior of ``target`` depends on: those met first on each way from it."""
        met, ways = [], [(target, -1)]
        while ways:
            node, but = ways.pop()
            for other in self.near[node]:
                if other != but:
                    ways.append((other, node)) if pattern[other] else met.append(other)
        return sorted(met)

    def decoded(self, target: int, codes: np.ndarray, pattern: tuple[bool, ...]) -> np.ndarray:
        """The median bin of each row's posterior, which is worked out once for all rows that observe the same."""
        first, same = distinct(codes, self.told_by(target, pattern), [len(m) for m in self.marginal])
        return middle(self.posterior(target, codes[first], pattern))[same]


def distinct(codes: np.ndarray, fields: Sequence[int], sizes: Sequence[int]) -> tuple[np.ndarray, np.ndarray]:
    """Of the rows' combinations of ``fields``: a row that has each, and for every row which one it has."""
    first, same = np.zeros(min(1, len(codes)), dtype=np.int64), np.zeros(len(codes), dtype=np.int64)
    for k in fields:
        _, first, same = np.unique(same * sizes[k] + codes[:, k], return_index=True, return_inverse=True)
    return first, same


def middle(log_posterior: np.ndarray) -> np.ndarray:
    """The median bin of each row's posterior."""
    p = np.exp(log_posterior - log_posterior.max(1, keepdims=True)).cumsum(1)
    return (p >= 0.5 * p[:, -1:]).argmax(1)


def frequent(rows: DataFrame, column: str, top: int) -> tuple[DataFrame, int]:
    """(column, code): the ``top`` most frequent values; at most that many rows, and how many."""
    counts = rows.where(F.col(column).isNotNull()).groupBy(column).count().orderBy(F.desc("count"), column).limit(top)
    got = [(r[0], k) for k, r in enumerate(counts.collect())]
    return rows.sparkSession.createDataFrame(got, f"{column} string, code int"), len(got)


def log_units(f: str) -> Column:
    """A value that is not negative, on a logarithmic scale in millionths: whole numbers, whose sums do not depend on the order of rows."""
    return F.rint(F.log1p(F.greatest(F.col(f).cast("double"), F.lit(0.0))) * 1e6).cast("bigint")  # round() would make a BigDecimal of each


def joined(rows: DataFrame, stats: DataFrame, group: str, *spread_by: str) -> DataFrame:
    """``rows`` left-joined with ``stats`` on ``group``; rows without a group, which find nothing, are spread over the tasks."""
    salt = F.when(F.col(group).isNull(), F.pmod(F.xxhash64(*spread_by), F.lit(4096))).otherwise(0).cast("int")
    return rows.withColumn("_salt", salt).join(stats.withColumn("_salt", F.lit(0)), [group, "_salt"], "left").drop("_salt")


@dataclass
class Groups:
    """Which groups say what: ``least`` and ``means`` by way of the combinations of groups, ``own_means`` each for itself; per group its fields."""

    least: dict[str, Sequence[str]]
    means: dict[str, Sequence[str]]
    own_means: dict[str, Sequence[str]]

    def __post_init__(self) -> None:
        self.combined = list(dict.fromkeys([*self.least, *self.means]))
        self.all = list(dict.fromkeys([*self.combined, *self.own_means]))
        kinds = (("least", self.least), ("mean", self.means), ("mean", self.own_means))
        self.said = {f"{kind}_{g}_{f}": (kind, g, f) for kind, of in kinds for g, fields in of.items() for f in fields}


def combined_evidence(rows: DataFrame, key: str, groups: Groups, aliases: Mapping[str, DataFrame]) -> DataFrame:
    """``rows``, without the groups, with what the other rows of the ``least`` and ``means`` groups say.

    The rows of each combination of groups are combined first; groups are added up from these combinations, and each
    row meets its combination, and so all of its groups, in one join. A value that only the row itself has says nothing.
    A combination goes by one 64-bit hash: the rows are sorted by a single number. Rows without any group, which find
    nothing, are spread by their keys.
    """
    by = groups.combined
    none = F.lit(True)
    for g in by:
        none &= F.col(g).isNull()
    rows = rows.withColumn("_cell", F.when(none, F.xxhash64(key)).otherwise(F.xxhash64(*by, *[F.col(g).isNull() for g in by])))
    fields = sorted({f for of in (groups.least, groups.means) for own in of.values() for f in own})
    ends = [x for f in fields for x in (F.min(f).alias(f"_lo_{f}"), F.max(f).alias(f"_hi_{f}"), F.sum(log_units(f)).alias(f"_sum_{f}"), F.count(f).alias(f"_n_{f}"))]
    cells = stored(rows.where(~none).groupBy("_cell").agg(*[F.min(g).alias(g) for g in by], *ends), "cells", tidy=True)
    out = cells.select("_cell", *by)
    for k, g in enumerate(by):
        made = [x for f in groups.least.get(g, ()) for x in (F.min(f"_lo_{f}").alias(f"_lo_{k}_{f}"), F.max(f"_hi_{f}").alias(f"_hi_{k}_{f}"))]
        made += [F.sum(f"_sum_{f}").alias(f"_sum_{k}_{f}") for f in groups.means.get(g, ())]
        made += [F.sum(f"_n_{f}").alias(f"_n_{k}_{f}") for f in dict.fromkeys([*groups.least.get(g, ()), *groups.means.get(g, ())])]
        of = lambda df: (joined(df, aliases[g], g, *by) if g in aliases else df.withColumn("_of", F.lit(None).cast("bigint"))).withColumn("_of", F.coalesce("_of", g))  # noqa: B023, E731
        sums = of(cells).where(F.col("_of").isNotNull()).groupBy("_of").agg(*made)
        out = joined(of(out), sums, "_of", *by).drop("_of")
    met = out.drop(*by)
    rows = rows.drop(*by).join(met, "_cell", "left")
    columns = {}
    for name, (kind, g, f) in groups.said.items():
        if g in by and f in (groups.least if kind == "least" else groups.means).get(g, ()):
            k = by.index(g)
            others = F.col(f"_n_{k}_{f}") - F.col(f).isNotNull().cast("int")
            lo, hi = F.col(f"_lo_{k}_{f}"), F.col(f"_hi_{k}_{f}")
            columns[name] = F.when(others > 0, F.when((F.col(f) == lo) & (others == 1), hi).otherwise(lo)) if kind == "least" else mean_of_others(f, F.col(f"_sum_{k}_{f}"), others)
    return rows.withColumns(columns).drop(*met.columns)


def mean_of_others(f: str, total: Column, others: Column) -> Column:
    return F.when(others > 0, F.expm1((total - F.coalesce(log_units(f), F.lit(0))) / others / 1e6)).cast("float")


def own_evidence(rows: DataFrame, key: str, groups: Groups, small: int = SMALL) -> DataFrame:
    """``rows`` with the mean, on a logarithmic scale, of each field over the other rows of each of the ``own_means`` groups.

    The groups' sums are stored and counted: up to ``small`` of them (some 100 MB) are broadcast, more are joined by a shuffle of the rows.
    """
    source = rows
    for g, fields in groups.own_means.items():
        made = [x for f in fields for x in (F.sum(log_units(f)).alias(f"_sum_{f}"), F.count(f).alias(f"_n_{f}"))]
        sums = stored(source.where(F.col(g).isNotNull()).groupBy(g).agg(*made), "sums", tidy=True)
        rows = rows.join(F.broadcast(sums), g, "left") if sums.count() <= small else joined(rows, sums, g, key)
        rows = rows.withColumns({f"mean_{g}_{f}": mean_of_others(f, F.col(f"_sum_{f}"), F.col(f"_n_{f}") - F.col(f).isNotNull().cast("int")) for f in fields})
        rows = rows.drop(*[f"_sum_{f}" for f in fields], *[f"_n_{f}" for f in fields])
    return rows


def gathered(batches: Iterator[pd.DataFrame], least: int = 50_000) -> Iterator[pd.DataFrame]:
    """The batches, put together to at least so many rows where there are enough."""
    held, n = [], 0
    for pdf in batches:
        held.append(pdf)
        n += len(pdf)
        if n >= least:
            yield pd.concat(held, ignore_index=True)
            held, n = [], 0
    if n:
        yield pd.concat(held, ignore_index=True)


@dataclass
class Coding:
    """How the columns of the rows become codes: numeric ones by cuts, then categorical ones that are codes already."""

    numeric: list[str]
    cuts: list[list[float]]
    categorical: list[str]

    @property
    def names(self) -> list[str]:
        return [*self.numeric, *self.categorical]

    def encode(self, pdf: pd.DataFrame) -> np.ndarray:
        own = [codes_of(pdf[c].to_numpy(dtype=float, na_value=np.nan), cuts) for c, cuts in zip(self.numeric, self.cuts)]
        return np.stack([*own, *[pdf[c].fillna(-1).to_numpy(dtype=np.int64) for c in self.categorical]]).T


def contingency(rows: DataFrame, coding: Coding, sizes: list[int]) -> dict[tuple[int, int], np.ndarray]:
    """Counts of each pair of fields over all rows that have both: added up within tasks, a few per core whatever the rows, then over tasks."""
    pairs = list(combinations(range(len(sizes)), 2))
    wide = [n + 1 for n in sizes]  # the first is for missing values

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tables = [np.zeros(wide[a] * wide[b], dtype=np.int64) for a, b in pairs]
        for pdf in gathered(batches):
            all_codes = coding.encode(pdf).T + 1
            for lo in range(0, all_codes.shape[1], SLICE):
                codes = np.ascontiguousarray(all_codes[:, lo : lo + SLICE])
                for table, (a, b) in zip(tables, pairs):
                    table += np.bincount(codes[a] * wide[b] + codes[b], minlength=len(table))
        for k, (a, b) in enumerate(pairs):
            table = tables[k].reshape(wide[a], wide[b])[1:, 1:].ravel()
            at = np.flatnonzero(table)
            yield pd.DataFrame({"pair": np.full(len(at), k, dtype=np.int32), "cell": at.astype(np.int32), "n": table[at]})

    few = 4 * rows.sparkSession.sparkContext.defaultParallelism
    cells = rows.select(*coding.names).coalesce(few).mapInPandas(count, "pair int, cell int, n bigint").groupBy("pair", "cell").agg(F.sum("n").alias("n")).toPandas()
    out = {}
    for k, (a, b) in enumerate(pairs):
        part = cells[cells["pair"] == k]
        table = np.zeros(sizes[a] * sizes[b])
        table[part["cell"].to_numpy(dtype=np.int64)] = part["n"].to_numpy(dtype=float)
        out[a, b] = table.reshape(sizes[a], sizes[b])
    return out


def fill_missing(
    rows: DataFrame,
    key: str,
    targets: Sequence[str],
    numeric: Sequence[str] = (),
    categorical: Sequence[str] = (),
    least: Mapping[str, Sequence[str]] | None = None,
    means: Mapping[str, Sequence[str]] | None = None,
    own_means: Mapping[str, Sequence[str]] | None = None,
    aliases: Mapping[str, tuple[str, Aliases]] | None = None,
    bins: int = 48,
    top: int = 512,
    buckets: int = 256,
) -> DataFrame:
    """(key, targets..., <target>_filled...): every row, missing cells of the numeric ``targets`` filled and marked.

    numeric, categorical: further fields that help; categorical ones are meant to have few values. A column of many values
    (a job, a test, a repo) is given as a group instead, and what its other rows say becomes a field, for every
    value it has: least: groups, each with the targets of which the least value counts (a value that only the row itself has
    says nothing); means: groups with the targets of which the mean of logarithms counts; own_means: the same for groups that
    would cut the combinations of the others into single rows. aliases: for a group that goes by
    several names, the column that has those of a row's names of the group which may stand for another one (else null), and a function
    from (group) of these, repeated ones among them, to (group, _of). Groups are told apart by 64-bit hashes.

    A null is a missing value; NaN must have been made null. A target without any value in the whole table stays null
    and unmarked. Repeated rows are filled alike; other columns are not carried. A group may hold any share of the
    rows and there may be any number of them: each is aggregated before it meets its rows.
    """
    spark = rows.sparkSession
    fields = [*targets, *numeric]
    groups = Groups(dict(least or {}), dict(means or {}), dict(own_means or {}))
    aliases = dict(aliases or {})
    told = [F.when(F.col(g).isNotNull(), F.xxhash64(g)).alias(f"{GROUP}{g}") for g in groups.all] + [F.col(name).alias(f"_name_{g}") for g, (name, _) in aliases.items()]
    rows = stored(rows.select(*told, *dict.fromkeys([key, *fields, *categorical])), "rows", plain=True)  # read column by column below
    points = [k / (2 * bins) for k in range(2 * bins + 1)]
    found = rows.agg(*[F.percentile_approx(F.col(f).cast("double"), points, 1000).alias(f) for f in fields]).first()
    cut = {f: Bins.of(found[f]) for f in fields}

    slim, kinds = rows, []
    for c in categorical:
        values, many = frequent(slim.select(F.col(c).cast("string").alias(c)), c, top)
        kinds.append(top + buckets if many == top else max(1, many))  # fewer than ``top``: all values have codes of their own
        codes = F.broadcast(values).withColumnsRenamed({"code": f"_{c}_code", c: f"_{c}"})  # at most ``top`` rows
        code = F.when(F.col(c).isNotNull(), F.coalesce(f"_{c}_code", top + F.pmod(F.xxhash64(F.col(c).cast("string")), F.lit(buckets)))).cast("smallint")
        slim = slim.join(codes, F.col(c).cast("string") == F.col(f"_{c}"), "left").withColumn(f"_code_{c}", code).drop(f"_{c}_code", f"_{c}", c)
    slim = slim.drop(*[f"_name_{g}" for g in aliases])
    named = Groups(*[{f"{GROUP}{g}": f for g, f in of.items()} for of in (groups.least, groups.means, groups.own_means)])
    slim = own_evidence(slim, key, named).drop(*[g for g in named.own_means if g not in named.combined])
    if named.combined:
        of = {}
        for g, (_, find) in aliases.items():
            names = stored(find(rows.select(F.col(f"_name_{g}").alias(g)).where(F.col(g).isNotNull())), "aliases", tidy=True)
            of[f"{GROUP}{g}"] = names.select(F.xxhash64(g).alias(f"{GROUP}{g}"), F.xxhash64("_of").alias("_of"))
        slim = combined_evidence(slim, key, named, of)
    said = {name: f for name, (_, _, f) in named.said.items()}
    kept = [*fields, *said]
    coding = Coding(kept, [cut[f].cuts for f in fields] + [cut[f].cuts for f in said.values()], [f"_code_{c}" for c in categorical])
    sizes = [max(1, cut[f].size) for f in [*fields, *said.values()]] + kinds
    known = stored(slim.select(key, *kept, *coding.categorical), "known", tidy=True, plain=True).withColumns({t: F.col(t).cast("double") for t in targets})

    tree = Tree.learn(coding.names, sizes, contingency(known, coding, sizes))
    fillable = [t for t in targets if cut[t].size]
    medians = {t: np.asarray(cut[t].medians) for t in fillable}
    model = spark.sparkContext.broadcast(tree)

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree = model.value
        for pdf in gathered(batches):
            codes = coding.encode(pdf)
            missing = codes < 0
            mask = missing @ (1 << np.arange(codes.shape[1]))
            out = {t: pdf[t].to_numpy(dtype=float, na_value=np.nan).copy() for t in targets}
            own = {name: pdf[name].to_numpy(dtype=float, na_value=np.nan) for name in said}
            for m in np.unique(mask):
                at = np.flatnonzero(mask == m)
                pattern = tuple(bool(m >> k & 1) for k in range(codes.shape[1]))
                for k, t in enumerate(targets):
                    if not pattern[k] or t not in medians:
                        continue
                    best = tree.decoded(k, codes[at], pattern)
                    value = medians[t][best]
                    for name in reversed([name for name, f in said.items() if f == t]):  # the first group that has one counts
                        same = codes[at, coding.names.index(name)] == best
                        value = np.where(same, own[name][at], value)
                    out[t][at] = value
            filled = {f"{t}_filled": missing[:, k] & (t in medians) for k, t in enumerate(targets)}
            yield pd.DataFrame({key: pdf[key], **{t: pd.Series(v).where(~np.isnan(v), None) if np.isnan(v).any() else v for t, v in out.items()}, **filled})

    any_missing = F.lit(False)
    for t in targets:
        any_missing |= F.col(t).isNull()
    flags = [F.lit(False).alias(f"{t}_filled") for t in targets]
    whole = known.where(~any_missing).select(key, *targets, *flags)
    kind = rows.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, " + ", ".join(f"{t} double" for t in targets) + ", " + ", ".join(f"{t}_filled boolean" for t in targets)
    return whole.unionByName(known.where(any_missing).mapInPandas(fill, schema))
