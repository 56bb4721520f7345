"""Sequential team states as scans: decayed averages in columns, coupled ratings as composed affine maps.

A state before a date is a fold over everything earlier. Two kinds of state allow that fold to be cut into pieces
that run in parallel:

* A decayed average holds a sum and a weight, both shrinking by `decay` a game. Inside a chunk of a few half-lives
  these are windowed sums; across chunks one row a chunk is combined. A team's average carries over from season to
  season by a rule on the season's first value, folded over the (few) seasons of a team.
* Offence and defence ratings and the home edge are one vector that every date maps affinely, since what is
  expected of a game is linear in it. Blocks of dates compose their maps in parallel, one matrix a block is scanned,
  and the blocks replay from their starting vectors.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slatemill.operators.running import running_total
from slatemill.session import cut_lineage

BOX_RATES = ["pace", "ortg", "drtg", "efg", "efg_allowed", "tpar", "tpar_allowed", "ftr", "ftr_allowed", "orb", "orb_allowed", "tov", "tov_forced"]
STATE_COLUMNS = ("league", "date", "team", "season", "asof", "off", "dfn", "games", "line_tend", "ou_trend", "pts_for", "pts_against", "lg_total", "lg_line", "home_adv")
REACH = 30          # half-lives of a chunk; older chunks than the last eight weigh less than 2^-180
BEFORE = 8


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Fixed partition count for groups that are small in bytes but heavy in work: adaptive
    coalescing looks at bytes only and would put them all into one task."""
    n = df.sparkSession.sparkContext.defaultParallelism * 4
    return df.repartition(n, *keys)


def schema_text(games: DataFrame, columns: tuple[str, ...], like: dict[str, str]) -> str:
    """Schema text: key columns have the type they have in `games` (numbers or texts), dates are dates, the rest doubles."""
    kind = {f.name: f.dataType.simpleString() for f in games.schema.fields}
    of = {c: kind[like.get(c, c)] for c in columns if like.get(c, c) in ("league", "season", "home")}
    fixed = {"date": "date", "asof": "date", "neutral": "boolean"}
    return ", ".join(f"{c} {of.get(c, fixed.get(c, 'double'))}" for c in columns)


# ------------------------------------------------------------------ decayed averages
def decayed_before(df: DataFrame, keys: list[str], order: list[str], n: str, upto: str, totals: dict[str, Column], half_life: float) -> DataFrame:
    """Adds `before` (games earlier in the order) and, for every total, `d_<name>`: its sum over the earlier rows, each
    faded by 0.5^(games since / half_life). `n` is a row's number of games, `upto` their inclusive running count."""
    span, decay = REACH * half_life, F.lit(0.5 ** (1 / half_life))
    d = df.withColumns({"before": F.col(upto) - F.col(n), **{f"_x_{k}": v for k, v in totals.items()}})
    d = d.withColumn("_chunk", F.floor(F.col("before") / span))
    start = F.col("_chunk") * span
    inside = Window.partitionBy(*keys, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys, "_chunk")
    # no later row of the chunk sees one that ends beyond it, so its growth may be cut
    grow = F.pow(decay, -F.least(F.col(upto) - start, F.lit(2 * span)))
    d = d.withColumn("_grow", grow).withColumn("_end", F.max(upto).over(whole))
    d = d.withColumns({f"d_{k}": F.coalesce(F.sum(F.col(f"_x_{k}") * F.col("_grow")).over(inside), F.lit(0.0)) * F.pow(decay, F.col("before") - start) for k in totals})
    parts = d.groupBy(*keys, "_chunk").agg(F.min("before").alias("_first"), F.max("_end").alias("_end"),
                                           *[F.sum(F.col(f"_x_{k}") * F.pow(decay, F.col("_end") - F.col(upto))).alias(k) for k in totals])
    earlier = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(-BEFORE, -1)
    parts = parts.withColumn("_past", F.collect_list(F.struct("_end", *totals)).over(earlier))
    fade = lambda k: F.aggregate("_past", F.lit(0.0), lambda s, x: s + x[k] * F.pow(decay, F.col("_first") - x["_end"]))
    base = parts.select(*keys, "_chunk", "_first", *[fade(k).alias(f"_b_{k}") for k in totals])
    out = d.join(base, keys + ["_chunk"]).withColumns({f"d_{k}": F.col(f"d_{k}") + F.col(f"_b_{k}") * F.pow(decay, F.col("before") - F.col("_first")) for k in totals})
    return out.drop("_chunk", "_grow", "_end", "_first", *[f"_x_{k}" for k in totals], *[f"_b_{k}" for k in totals])


def level_before(rows: DataFrame, keys: list[str], order: list[str], n: str, totals: dict[str, Column], half_life: float, value: float | None, weight: float) -> DataFrame:
    """Decayed averages before each row of a key's whole history, from a prior `value` of the given weight (None: no
    average before the first row), as `l_<name>`, with their common weight `l_weight` and the row's `before`."""
    r = running_total(rows, keys, F.col("date"), order, n, "_upto")
    r = decayed_before(r, keys, order, n, "_upto", {**totals, "_w": F.col(n).cast("double")}, half_life).drop("_upto")
    prior = F.lit(weight) * F.pow(F.lit(0.5 ** (1 / half_life)), F.col("before"))
    r = r.withColumn("l_weight", prior + F.col("d__w"))
    some = F.when(F.col("l_weight") > 0, F.col("l_weight"))
    return r.withColumns({f"l_{k}": (prior * (value or 0.0) + F.col(f"d_{k}")) / some for k in totals}).drop("d__w", *[f"d_{k}" for k in totals])


def season_runs(sides: DataFrame) -> DataFrame:
    """(league, team, date, season, run, new): a run is a stretch of a team's dates in one season; `new` marks its first
    date, if there was a season before."""
    order = Window.partitionBy("league", "team").orderBy("date", "season")
    t = sides.select("league", "team", "date", "season").distinct().withColumn("_last", F.lag("season").over(order))
    t = t.withColumn("new", F.coalesce(F.col("_last") != F.col("season"), F.lit(False)))
    return t.withColumn("run", F.sum(F.col("new").cast("long")).over(order)).drop("_last")


def carried_averages(sides: DataFrame, names: list[str], n: str, half_life: float, prior: float, keep: list[float], first_weight: float = 0.0,
                     towards: list[str] | None = None, first: list[str] | None = None) -> DataFrame:
    """Decayed averages of a team before each of its dates, through seasons: (league, team, date, run, games, known, a_<name>).

    sides: one row per game day and side with league, team, date, run, home, away, side, the number of games `n` and, for
    every name, the total `x_<name>`. Within a run averages fade by the game. A new run starts from the last value, kept
    to the share `keep` and for the rest drawn `towards` a column (0 where there is none; all of it is kept where that
    is null), with the last weight, `prior` at most. The first run with games starts with `first_weight` at the column
    `first`. `games` counts the run's games and `known` says whether the team had any before."""
    order = ["date", "home", "away", "side"]
    keys = ["league", "team", "run"]
    decay = F.lit(0.5 ** (1 / half_life))
    upto = F.sum(n).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))      # a team's season
    d = decayed_before(sides.withColumn("_upto", upto), keys, order, n, "_upto", {**{k: F.col(f"x_{k}") for k in names}, "_w": F.col(n).cast("double")}, half_life)
    after = lambda k, x: F.col(f"d_{k}") * F.pow(decay, F.col(n)) + x
    zeros = F.array(*[F.lit(0.0)] * len(names))
    place = F.struct(*order)
    played = F.col(n) > 0
    ends = d.groupBy(*keys).agg(
        F.max("_upto").cast("double").alias("n"), F.max_by(after("_w", F.col(n)), place).alias("w"),
        F.max_by(F.array(*[after(k, F.col(f"x_{k}")) for k in names]), place).alias("s"),
        F.min_by(F.array(*towards) if towards else zeros, place).alias("to"),
        F.coalesce(F.min_by(F.when(played, F.array(*first)), F.when(played, place)) if first else zeros, zeros).alias("f"))
    # fold over a team's runs
    start_of = "array<struct<run:bigint,w0:double,s0:array<double>,had:boolean>>"
    begin = F.struct(F.array().cast(start_of).alias("out"), F.lit(0.0).alias("w"), zeros.alias("s"))
    kept = F.array(*[F.lit(float(k)) for k in keep])

    def step(acc: Column, x: Column) -> Column:
        had = acc["w"] > 0
        w0 = F.when(had, F.least(acc["w"], F.lit(float(prior)))).otherwise(F.when(x["n"] > 0, F.lit(float(first_weight))).otherwise(0.0))
        value = F.zip_with(F.transform(acc["s"], lambda s: s / acc["w"]), F.arrays_zip(kept.alias("k"), x["to"].alias("t")),
                           lambda v, y: F.coalesce(v * y["k"] + (1 - y["k"]) * y["t"], v))
        s0 = F.transform(F.when(had, value).otherwise(x["f"]), lambda v: v * w0)
        fade = F.pow(decay, x["n"])
        s = F.zip_with(s0, x["s"], lambda a, b: a * fade + b)
        out = F.concat(acc["out"], F.array(F.struct(x["run"].alias("run"), w0.alias("w0"), s0.alias("s0"), had.alias("had"))))
        return F.struct(out.alias("out"), (w0 * fade + x["w"]).alias("w"), s.alias("s"))

    runs = ends.groupBy("league", "team").agg(F.sort_array(F.collect_list(F.struct("run", "n", "w", "s", "to", "f"))).alias("r"))
    starts = runs.select("league", "team", F.explode(F.aggregate("r", begin, step)["out"]).alias("x")).select("league", "team", "x.*")
    at = d.groupBy(*keys, "date").agg(F.min_by(F.struct("before", *[f"d_{k}" for k in names], "d__w"), place).alias("x")).select(*keys, "date", "x.*")
    j = at.join(starts, keys)
    fade = F.pow(decay, F.col("before"))
    w = F.col("w0") * fade + F.col("d__w")
    return j.select(*keys, "date", F.col("before").cast("double").alias("games"), (F.col("had") | (F.col("before") > 0)).alias("known"),
                    *[((F.col("s0")[i] * fade + F.col(f"d_{k}")) / F.when(w > 0, w)).alias(f"a_{k}") for i, k in enumerate(names)])


# ------------------------------------------------------------------ box rates
def box_rates(box: DataFrame) -> DataFrame:
    """(game_key, side, rates): 13 pace, efficiency and four-factor rates of a box row, in the order of BOX_RATES. A
    `minutes` column scales the pace of games with overtime."""
    poss = F.col("poss")
    minutes = F.greatest(F.coalesce(F.col("minutes") if "minutes" in box.columns else F.lit(None), F.lit(48.0)), F.lit(48.0))
    own, other = F.greatest(F.col("fga"), F.lit(1)), F.greatest(F.col("fga_opp"), F.lit(1))
    per = lambda x: F.try_divide(x, poss)
    rates = [poss * 48.0 / minutes, per(100.0 * F.col("pts")), per(100.0 * F.col("pts_opp")),
             (F.col("fgm") + 0.5 * F.col("fg3m")) / own, (F.col("fgm_opp") + 0.5 * F.col("fg3m_opp")) / other, F.col("fg3a") / own, F.col("fg3a_opp") / other,
             F.col("fta") / own, F.col("fta_opp") / other, F.col("oreb") / F.greatest(F.col("oreb") + F.col("dreb_opp"), F.lit(1)),
             F.col("oreb_opp") / F.greatest(F.col("oreb_opp") + F.col("dreb"), F.lit(1)), per(F.col("tov")), per(F.col("tov_opp"))]
    return box.select("game_key", "side", F.array(*[r.cast("double") for r in rates]).alias("rates"))


def with_box_rates(games: DataFrame, box: DataFrame) -> DataFrame:
    """Games with `box_home` and `box_away` rates, null without a box row."""
    both = box_rates(box).groupBy("game_key").agg(F.max(F.when(F.col("side") == "home", F.col("rates"))).alias("box_home"),
                                                  F.max(F.when(F.col("side") == "away", F.col("rates"))).alias("box_away"))
    return games.join(both, "game_key", "left")


# ------------------------------------------------------------------ coupled ratings
def _day_rows(d: pd.DataFrame) -> tuple[list, list[tuple]]:
    """Teams of a block in order, and its dates: (date, home and away places, n, home and away points, expected base,
    weight after the row, places of teams that begin a season)."""
    d = d.sort_values(["date", "home", "away", "season"])
    teams = sorted(set(d.home) | set(d.away))
    at = {t: i for i, t in enumerate(teams)}
    home, away = d.home.map(at).to_numpy(), d.away.map(at).to_numpy()
    columns = [d[c].to_numpy(float) for c in ("n", "hp", "ap", "lg_total", "edge_weight")]
    new = [d[c].to_numpy(bool) for c in ("home_new", "away_new")]
    dates = d.date.to_numpy()
    cuts = [0, *(np.flatnonzero(dates[1:] != dates[:-1]) + 1), len(d)]
    out = []
    for i, j in zip(cuts[:-1], cuts[1:]):
        h, a = home[i:j], away[i:j]
        n, hp, ap, level, weight = (c[i:j] for c in columns)
        out.append((dates[i], h, a, n, hp, ap, level / 2, weight, np.unique(np.concatenate([h[new[0][i:j]], a[new[1][i:j]]]))))
    return teams, out


def _advance(m: np.ndarray, day: tuple, teams: int, k: float) -> None:
    """One date's results on `m`, whose rows are offences, defences and the home edge and whose columns are anything these
    are linear in, the last one constant: a state (one column) or a composed map."""
    _, h, a, n, hp, ap, base, weight, _ = day
    edge, n1 = m[2 * teams] / 2, n[:, None]
    eh, ea = -n1 * (m[h] + m[teams + a] + edge), -n1 * (m[a] + m[teams + h] - edge)
    eh[:, -1] += hp - n * base
    ea[:, -1] += ap - n * base
    np.add.at(m, h, k * eh)
    np.add.at(m, teams + a, k * eh)
    np.add.at(m, a, k * ea)
    np.add.at(m, teams + h, k * ea)
    m[2 * teams] += ((eh - ea) / weight[:, None]).sum(axis=0)


def coupled_ratings(rows: DataFrame, k: float, regress: float, block_rows: int) -> DataFrame:
    """(league, date, team, off, dfn, home_adv) before each date. rows: league, date, season, home, away, n, hp, ap, lg_total
    (at the date's start), edge_weight (weight of the home edge after the row), home_new and away_new (the team begins
    a season). A league's dates are cut into blocks of about `block_rows` rows."""
    kind = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    days = rows.groupBy("league", "date").agg(F.count("*").alias("r"))
    order = Window.partitionBy("league").orderBy("date").rowsBetween(Window.unboundedPreceding, -1)     # a row a date
    blocks = days.select("league", "date", F.floor(F.coalesce(F.sum("r").over(order), F.lit(0)) / block_rows).alias("block"))
    rows = cut_lineage(rows.join(blocks, ["league", "date"]))

    def compose(key: tuple, d: pd.DataFrame) -> pd.DataFrame:
        teams, dates = _day_rows(d)
        t = len(teams)
        m = np.eye(2 * t + 1, 2 * t + 2)
        for day in dates:
            m[np.concatenate([day[-1], t + day[-1]])] *= 1 - regress
            _advance(m, day, t, k)
        return pd.DataFrame({"league": [key[0]], "block": [key[1]], "teams": [teams], "map": [m.tobytes()]})

    def scan(key: tuple, d: pd.DataFrame) -> pd.DataFrame:
        off: dict = {}
        edge, out = 0.0, []
        for r in d.sort_values("block").itertuples(index=False):
            t = len(r.teams)
            x = np.array([*[off.get(z, (0.0, 0.0))[0] for z in r.teams], *[off.get(z, (0.0, 0.0))[1] for z in r.teams], edge])
            out.append((key[0], r.block, x.tolist()))
            x = np.frombuffer(r.map).reshape(2 * t + 1, 2 * t + 2) @ np.append(x, 1.0)
            off.update({z: (x[i], x[t + i]) for i, z in enumerate(r.teams)})
            edge = x[2 * t]
        return pd.DataFrame(out, columns=["league", "block", "start"])

    def replay(key: tuple, d: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
        teams, dates = _day_rows(d)
        t, out = len(teams), []
        # one column, the state itself
        m = np.array(start["start"].iloc[0], dtype=float)[:, None]
        for day in dates:
            m[np.concatenate([day[-1], t + day[-1]])] *= 1 - regress
            here = np.unique(np.concatenate([day[1], day[2]]))
            out.append((np.repeat(day[0], len(here)), here, m[here, 0], m[t + here, 0], np.full(len(here), m[2 * t, 0])))
            _advance(m, day, t, k)
        date, place, off, dfn, edge = (np.concatenate(x) for x in zip(*out))
        return pd.DataFrame({"league": key[0], "date": date, "team": [teams[i] for i in place], "off": off, "dfn": dfn, "home_adv": edge})

    team = kind["home"]
    maps = spread(rows, "league", "block").groupBy("league", "block").applyInPandas(compose, f"league {kind['league']}, block long, teams array<{team}>, map binary")
    starts = spread(maps, "league").groupBy("league").applyInPandas(scan, f"league {kind['league']}, block long, start array<double>")
    by = lambda x: spread(x, "league", "block").groupBy("league", "block")
    return by(rows).cogroup(by(cut_lineage(starts))).applyInPandas(replay, f"league {kind['league']}, date date, team {team}, off double, dfn double, home_adv double")


def team_states(games: DataFrame, k: float = 0.08, halflife: float = 10.0, prior: float = 5.0, regress: float = 0.4,
                league_games: float = 150.0, edge_games: float = 500.0, block_rows: int = 16_384) -> DataFrame:
    """State of both teams before each of their dates: coupled offence/defence ratings, market and scoring tendencies
    with a prior weight, league level and home advantage. Every date is emitted before any of its results counts, and
    results of a date meet the ratings of its start.

    games: league, season, date, home, away, home_pts, away_pts, line. With `box_home` and `box_away` (see
    `with_box_rates`) the 13 rates follow: `b_<rate>` of the team, `lb_<rate>` of the league, `box_games` of the season.
    A team's rates start at the league's with half the prior weight and are drawn to it between seasons."""
    has_box = "box_home" in games.columns
    sums = [F.count("*").cast("double").alias("n"), F.sum("home_pts").cast("double").alias("hp"), F.sum("away_pts").cast("double").alias("ap"), F.sum("line").alias("ln")]
    if has_box:
        both = F.col("box_home").isNotNull() & F.col("box_away").isNotNull()
        sums.append(F.coalesce(F.count_if(both), F.lit(0)).cast("double").alias("nb"))
        sums += [F.array(*[F.coalesce(F.sum(F.when(both, F.col(c)[i])), F.lit(0.0)) for i in range(len(BOX_RATES))]).alias(c) for c in ("box_home", "box_away")]
    p = cut_lineage(games.groupBy("league", "season", "date", "home", "away").agg(*sums))
    order = ["date", "home", "away", "season"]

    # league level and the weight of the home edge before each row; the level at the start of each date
    lv = level_before(p, ["league"], order, "n", {"total": F.col("hp") + F.col("ap"), "line": F.col("ln")}, league_games, 200.0, 1.0)
    at = lv.groupBy("league", "date").agg(F.min_by(F.struct("l_total", "l_line"), F.struct(*order)).alias("x"))
    days = cut_lineage(at.select("league", "date", F.col("x.l_total").alias("lg_total"), F.col("x.l_line").alias("lg_line"),
                                 F.lag("date").over(Window.partitionBy("league").orderBy("date")).alias("asof")))
    edge = level_before(p.drop("ln"), ["league"], order, "n", {}, edge_games, None, 50.0)
    edge_weight = F.col("l_weight") * F.pow(F.lit(0.5 ** (1 / edge_games)), F.col("n")) + F.col("n")

    line0 = F.col("lg_line")
    side = lambda s, pf, pa: p.join(days.select("league", "date", "lg_line"), ["league", "date"]).select(
        "league", "season", "date", "home", "away", F.lit(int(s == "away")).alias("side"), F.col(s).alias("team"), "n", (F.col("ln") - F.col("n") * line0).alias("x_lt"),
        (F.col("hp") + F.col("ap") - F.col("ln")).alias("x_ou"), F.col(pf).alias("x_pf"), F.col(pa).alias("x_pa"), *(["nb", F.col(f"box_{s}").alias("rates")] if has_box else []))
    sides = side("home", "hp", "ap").unionByName(side("away", "ap", "hp"))
    runs = cut_lineage(season_runs(sides))
    sides = cut_lineage(sides.join(runs.select("league", "team", "date", "season", "run"), ["league", "team", "date", "season"]))
    tend = carried_averages(sides, ["lt", "ou", "pf", "pa"], "n", halflife, prior, [1 - regress, 1 - regress, 1.0, 1.0])

    fresh = runs.groupBy("league", "team", "date").agg(F.max("new").alias("new"))
    flag = lambda s: fresh.select("league", "date", F.col("team").alias(s), F.col("new").alias(f"{s}_new"))
    rows = (edge.withColumn("edge_weight", edge_weight).join(days.select("league", "date", "lg_total"), ["league", "date"])
            .join(flag("home"), ["league", "date", "home"]).join(flag("away"), ["league", "date", "away"]))
    rated = coupled_ratings(rows.select("league", "season", "date", "home", "away", "n", "hp", "ap", "lg_total", "edge_weight", "home_new", "away_new"), k, regress, block_rows)

    out = (runs.drop("new").join(tend, ["league", "team", "date", "run"]).join(rated, ["league", "team", "date"]).join(days, ["league", "date"])
           .withColumns({"line_tend": F.coalesce("a_lt", F.lit(0.0)), "ou_trend": F.coalesce("a_ou", F.lit(0.0)), "pts_for": F.col("a_pf"), "pts_against": F.col("a_pa")}))
    if not has_box:
        return out.select(*STATE_COLUMNS)

    rates = {r: F.col("rates")[i] for i, r in enumerate(BOX_RATES)}
    lb = level_before(sides.select(*order, "league", "side", "team", "run", "nb", "rates"), ["league"], [*order, "side"], "nb", rates, league_games, None, 0.0)
    lb = lb.groupBy("league", "date").agg(F.min_by(F.struct(*[f"l_{r}" for r in BOX_RATES]), F.struct(*order, "side")).alias("x"))
    lb = cut_lineage(lb.select("league", "date", *[F.col(f"x.l_{r}").alias(f"lb_{r}") for r in BOX_RATES]))
    b = sides.join(lb, ["league", "date"]).withColumns({**{f"x_{r}": c for r, c in rates.items()}, **{f"f_{r}": F.coalesce(F.col(f"lb_{r}"), F.try_divide(rates[r], F.col("nb"))) for r in BOX_RATES}})
    box = carried_averages(b, BOX_RATES, "nb", halflife, prior, [1 - regress] * len(BOX_RATES), prior / 2, [f"lb_{r}" for r in BOX_RATES], [f"f_{r}" for r in BOX_RATES])
    box = box.select("league", "team", "date", "run", F.col("games").alias("box_games"), *[F.when(F.col("known"), F.col(f"a_{r}")).alias(f"b_{r}") for r in BOX_RATES])
    return out.join(box, ["league", "team", "date", "run"]).join(lb, ["league", "date"]).select(*STATE_COLUMNS, "box_games", *[f"b_{r}" for r in BOX_RATES], *[f"lb_{r}" for r in BOX_RATES])


def expected_points(games: DataFrame, states: DataFrame) -> DataFrame:
    """Attach both states and the rating-based expectation to every game; with box rates also the pace and the
    possessions-times-efficiency total they imply, null until both teams and the league have some."""
    g, box = games, "b_pace" in states.columns
    own = ["off", "dfn", "games", "line_tend", "ou_trend", "pts_for", "pts_against", *(["box_games", *[f"b_{r}" for r in BOX_RATES]] if box else [])]
    for s in ("home", "away"):
        cols = [F.col(c).alias(f"{s}_{c.removeprefix('b_')}") for c in own]
        shared = ["asof", "lg_total", "lg_line", "home_adv", *([f"lb_{r}" for r in BOX_RATES] if box else [])] if s == "home" else []
        g = g.join(states.select("league", "date", F.col("team").alias(s), *cols, *shared), ["league", "date", s])
    half, adv = F.col("lg_total") / 2, F.col("home_adv") / 2
    naive = (F.col("home_pts_for") + F.col("away_pts_for") + F.col("home_pts_against") + F.col("away_pts_against")) / 2
    g = g.withColumns({"exp_home": half + adv + F.col("home_off") + F.col("away_dfn"), "exp_away": half - adv + F.col("away_off") + F.col("home_dfn"),
                       "naive_total": naive, "lg_gap": F.col("lg_total") - F.col("lg_line")})
    if not box:
        return g
    pace = F.col("home_pace") * F.col("away_pace") / F.col("lb_pace")
    points = (F.col("home_ortg") * F.col("away_drtg") + F.col("away_ortg") * F.col("home_drtg")) / F.col("lb_ortg")
    return g.withColumns({"box_exp_pace": pace, "box_exp_total": pace * points / 100.0, "box_min_games": F.least("home_box_games", "away_box_games")})
