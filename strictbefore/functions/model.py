"""Probability models in closed form, as Column expressions: one row in, one row out, no shuffle.

A score grid needs no rows: with independent Poisson goals each market is a sum over two arrays of eleven, and the
low-score correction changes four cells, which are added on top.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the models.
RHO, MAX_GOALS, HOME_FACTOR, AWAY_FACTOR = -0.13, 10, 1.12, 0.88
K_FACTOR, HOME_RATING, START_RATING, ELO_WEIGHT = 20.0, 60.0, 1500.0, 0.15
SEASON_WEIGHT, FORM_WEIGHT, MEETING_WEIGHT = 0.40, 0.45, 0.15
MARGIN_SD, TOTAL_SD, POINTS_LINE, HOME_POINTS = 12.0, 15.0, 224.5, 3.0


def poisson(k: int, mean: Column) -> Column:
    return F.pow(mean, F.lit(float(k))) * F.exp(-mean) / F.lit(float(math.factorial(k)))


def tau(x: int, y: int, home: Column, away: Column, rho: float = RHO) -> Column:
    """The factor of a low score; 1 elsewhere."""
    return {(0, 0): 1 - home * away * rho, (0, 1): 1 + home * rho, (1, 0): 1 + away * rho, (1, 1): F.lit(1 - rho)}.get((x, y), F.lit(1.0))


def expected_goals(attack: Column, defence: Column, league_avg: Column, at_home: bool) -> Column:
    return attack * defence * league_avg * (HOME_FACTOR if at_home else AWAY_FACTOR)


#: Columns that with_grid() adds: terms of the home side's goals, and running sums of the away side's, from none to all.
TERMS, SUMS = "_home_terms", "_away_sums"


def with_grid(rows: DataFrame, home: Column, away: Column, max_goals: int = MAX_GOALS) -> DataFrame:
    """``rows`` with the arrays that markets are summed from, so that a row's Poisson terms are computed once for all of them."""
    terms = lambda mean: F.array(*[poisson(k, mean) for k in range(max_goals + 1)])
    sums = [F.lit(0.0)]
    for k in range(max_goals + 1):
        sums.append(sums[-1] + F.get("_away_terms", F.lit(k)))
    return rows.withColumns({TERMS: terms(home), "_away_terms": terms(away)}).withColumn(SUMS, F.array(*sums)).drop("_away_terms")


class Grid:
    """Sums over the cells (x, y) of a normalised score grid; x and y are the goals of home and away. ``bound``: the rows went through with_grid()."""

    def __init__(self, home: Column, away: Column, rho: float = RHO, max_goals: int = MAX_GOALS, bound: bool = False):
        self.n = max_goals + 1
        if bound:
            self.home, self.upto = [F.get(TERMS, F.lit(k)) for k in range(self.n)], [F.get(SUMS, F.lit(k)) for k in range(self.n + 1)]
        else:
            self.home, self.upto = [poisson(k, home) for k in range(self.n)], [F.lit(0.0)]
            for k in range(self.n):
                self.upto.append(self.upto[-1] + poisson(k, away))
        zero, one = self.upto[1] - self.upto[0], self.upto[2] - self.upto[1]
        self.extra = {(x, y): self.home[x] * (zero, one)[y] * (tau(x, y, home, away, rho) - 1) for x in (0, 1) for y in (0, 1)} if rho else {}
        self.all = sum(self.home[1:], self.home[0]) * self.upto[self.n] + sum(self.extra.values(), F.lit(0.0))

    def raw(self, wanted) -> Column:
        """The sum over the cells that ``wanted(x, y)`` names, before normalisation: per x the running sums at the ends of its stretches of y."""
        out = F.lit(0.0)
        for x in range(self.n):
            ys = [y for y in range(self.n) if wanted(x, y)]
            ends = [y for y in ys if y + 1 not in ys]
            starts = [y for y in ys if y - 1 not in ys]
            for low, high in zip(starts, ends, strict=True):
                out = out + self.home[x] * (self.upto[high + 1] - self.upto[low])
        return out + sum((e for cell, e in self.extra.items() if wanted(*cell)), F.lit(0.0))

    def p(self, wanted) -> Column:
        return self.raw(wanted) / self.all

    def cell(self, x: int, y: int) -> Column:
        return self.p(lambda a, b: (a, b) == (x, y))


def markets(home: Column, away: Column, shift_home: int = 0, shift_away: int = 0, rho: float = RHO, bound: bool = False) -> dict[str, Column]:
    """Probabilities by market and outcome, of final scores where the grid counts goals still to come."""
    grid = Grid(home, away, rho, bound=bound)
    at = lambda x, y: (x + shift_home, y + shift_away)
    p = lambda f: grid.p(lambda x, y: f(*at(x, y)))
    out = {"home_win": p(lambda h, a: h > a), "draw": p(lambda h, a: h == a), "away_win": p(lambda h, a: h < a), "btts": p(lambda h, a: h > 0 and a > 0)}
    out |= {"home_or_draw": out["home_win"] + out["draw"], "away_or_draw": out["away_win"] + out["draw"], "home_or_away": out["home_win"] + out["away_win"]}
    for line in (1.5, 2.5, 3.5, 4.5, 5.5):
        out[f"over_{line}".replace(".", "_")] = p(lambda h, a, line=line: h + a > line)
    for line in (0.5, 1.5, 2.5):
        out[f"home_over_{line}".replace(".", "_")] = p(lambda h, a, line=line: h > line)
        out[f"away_over_{line}".replace(".", "_")] = p(lambda h, a, line=line: a > line)
    return out


#: Columns that with_outlook() adds: chances that the goals still to come differ by k or more, k from -MAX_GOALS, and that they are k or more in all.
MARGINS, TOTALS = "_margins", "_totals"


def with_outlook(rows: DataFrame, home: Column, away: Column, max_goals: int = MAX_GOALS) -> DataFrame:
    """``rows`` with what the markets of a match under way need, whatever its score: tails of the margin and of the total of goals still to come."""
    bound = with_grid(rows, home, away, max_goals)
    grid = Grid(home, away, bound=True)

    def tails(chances: list[Column]) -> Column:
        sums = [F.lit(0.0)]
        for p in reversed(chances):
            sums.append(sums[-1] + p)
        return F.array(*reversed(sums))

    parts = {
        "_margin": F.array(*[grid.p(lambda x, y, k=k: x - y == k) for k in range(-max_goals, max_goals + 1)]),
        "_total": F.array(*[grid.p(lambda x, y, k=k: x + y == k) for k in range(2 * max_goals + 1)]),
    }
    each = lambda name: [F.get(name, F.lit(k)) for k in range(2 * max_goals + 1)]
    out = bound.withColumns(parts).withColumns({MARGINS: tails(each("_margin")), TOTALS: tails(each("_total"))})
    return out.drop("_margin", "_total", TERMS, SUMS)


def live_markets(home: Column, away: Column, home_goals: Column, away_goals: Column, max_goals: int = MAX_GOALS) -> dict[str, Column]:
    """Probabilities of final scores of rows that went through with_outlook(), ``home`` and ``away`` being the goals still expected."""
    at = lambda tails, k: F.get(tails, F.greatest(F.lit(0), F.least(F.lit(2 * max_goals + 1), k)).cast("int"))
    lead, scored = home_goals - away_goals, home_goals + away_goals
    win, not_lost = at(MARGINS, max_goals + 1 - lead), at(MARGINS, max_goals - lead)
    out = {"home_win": win, "draw": not_lost - win, "away_win": 1 - not_lost}
    out |= {"home_or_draw": out["home_win"] + out["draw"], "away_or_draw": out["away_win"] + out["draw"], "home_or_away": out["home_win"] + out["away_win"]}
    for line in (1.5, 2.5, 3.5):
        over = at(TOTALS, math.ceil(line) - scored)
        out |= {f"over_{line}".replace(".", "_"): over, f"under_{line}".replace(".", "_"): 1 - over}
    some = lambda goals, mean: F.when(goals >= 1, 1.0).otherwise(1 - F.exp(-mean))
    out["btts"] = some(home_goals, home) * some(away_goals, away)
    return out | {"btts_no": 1 - out["btts"]}


def cards_over(home: Column, away: Column, line: float, most: int = 20) -> Column:
    """P(total cards > line), Poisson with the two means' sum, cut at ``most``."""
    mean = home + away
    return sum((poisson(k, mean) for k in range(int(math.floor(line)) + 1, most + 1)), F.lit(0.0))


def elo_expected(own: Column, other: Column) -> Column:
    return 1 / (1 + F.pow(F.lit(10.0), (other - own) / 400.0))


def elo_outcomes(home: Column, away: Column) -> tuple[Column, Column, Column]:
    """home, draw and away from two ratings; the draw shrinks with the gap, within bounds."""
    own = home + HOME_RATING
    draw = F.least(F.greatest(0.28 * F.greatest(F.lit(0.0), 1 - F.abs(own - away) / 400.0), F.lit(0.05)), F.lit(0.28))
    win = (1 - draw) * elo_expected(own, away)
    return win, draw, 1 - draw - win


def blend(poisson_p: list[Column], elo_p: list[Column], weight: float = ELO_WEIGHT) -> list[Column]:
    """A weighted mean of two distributions, summing to one."""
    mixed = [(1 - weight) * a + weight * b for a, b in zip(poisson_p, elo_p, strict=True)]
    total = sum(mixed[1:], mixed[0])
    return [m / total for m in mixed]


def blended_ratio(season: Column, form: Column, meetings: Column) -> Column:
    return SEASON_WEIGHT * season + FORM_WEIGHT * form + MEETING_WEIGHT * F.coalesce(meetings, F.lit(1.0))


def erf(x: Column) -> Column:
    """The error function by its series of positive terms, x times 2 x^2 / (2 n + 1) in turn; beyond six it is one to a double's last place."""
    start = F.struct(x.cast("double").alias("term"), x.cast("double").alias("sum"))

    def add(acc: Column, n: Column) -> Column:
        term = acc["term"] * (2 * x * x / (2 * n + 1))
        return F.struct(term.alias("term"), (acc["sum"] + term).alias("sum"))

    series = F.aggregate(F.sequence(F.lit(1), F.lit(120)), start, add, lambda acc: acc["sum"])
    return F.when(F.abs(x) > 6, F.signum(x)).otherwise(F.lit(2 / math.sqrt(math.pi)) * F.exp(-x * x) * series)


def normal_cdf(x: Column) -> Column:
    return 0.5 * (1 + erf(x / math.sqrt(2.0)))


def platt(p: Column, a: Column, b: Column) -> Column:
    """A probability through a fitted logistic of its log odds."""
    safe = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return 1 / (1 + F.exp(-(a * F.ln(safe / (1 - safe)) + b)))


def power_terms(means: pa.Array, max_goals: int = MAX_GOALS) -> np.ndarray:
    """Rows of a mean's powers from none to ``max_goals``, then exp(-mean), by the C library as in the SQL: the JVM's differ from it in the last place. Nulls count as NaN."""

    def safe(f, *args: float) -> float:
        try:
            return f(*args)
        except OverflowError:
            return math.inf

    values = means.to_numpy(zero_copy_only=False).astype("float64").tolist()
    return np.array([[*(safe(math.pow, v, k) for k in range(max_goals + 1)), safe(math.exp, -v)] for v in values], dtype="float64").reshape(len(values), max_goals + 2)


def scorelines(home: Column, away: Column, n: int, rho: float = RHO, max_goals: int = MAX_GOALS) -> Column:
    """array<struct<home, away, p>> of the n most probable scores, the lower one first of equal ones.

    Scores such as 1-3 and 2-2 can be equal but for rounding, which then says which is first. So each cell is multiplied out in the SQL's order: the home side's
    power, exp and factorial, the away side's, the factor, and then the division by the sum. An Arrow function over whole batches, as the C library's powers are needed.
    """
    each = range(max_goals + 1)

    @F.arrow_udf("array<struct<home: int, away: int, p: double>>")
    def best(h: pa.Array, a: pa.Array) -> pa.Array:
        x, y = power_terms(h, max_goals), power_terms(a, max_goals)
        m, o = x[:, 1], y[:, 1]
        factor = {(0, 0): 1 - rho * m * o, (0, 1): 1 + rho * m, (1, 0): 1 + rho * o, (1, 1): 1 - rho}
        with np.errstate(invalid="ignore", over="ignore"):
            cells = np.stack([x[:, i] * x[:, -1] / math.factorial(i) * y[:, j] * y[:, -1] / math.factorial(j) * factor.get((i, j), 1.0) for i in each for j in each], axis=1)
            p = cells / np.add.accumulate(cells, axis=1)[:, -1:]
        first = np.argsort(-p, axis=1, kind="stable")[:, :n]
        chosen = np.take_along_axis(p, first, axis=1).ravel()
        void = np.asarray(h.is_null()) | np.asarray(a.is_null())
        parts = [pa.array((first.ravel() // len(each)).astype("int32")), pa.array((first.ravel() % len(each)).astype("int32")), pa.array(chosen, mask=np.repeat(void, first.shape[1]))]
        return pa.ListArray.from_arrays(pa.array(np.arange(len(first) + 1, dtype="int32") * first.shape[1]), pa.StructArray.from_arrays(parts, ["home", "away", "p"]))

    return best(home.cast("double"), away.cast("double"))
