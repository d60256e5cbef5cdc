"""A league made up from planted truths, as responses and as panels: something to test the whole chain on.

``League`` plays games between teams of planted offence and defence ratings and answers requests for them in the
feeds' own formats, so parsers, lineups, gate and ratings can be held against what was planted.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession

FIRST_PLAYER, FIRST_TEAM = 1001, 11
PERIOD_S = 720


@dataclass
class League:
    n_teams: int = 4
    per_team: int = 8
    n_games: int = 30
    season: str = "2025-26"
    noise: float = 0.0  # seconds that the box score of every second game is off for one player
    seed: int = 0
    offense: dict[int, float] = field(default_factory=dict)
    defense: dict[int, float] = field(default_factory=dict)

    def __post_init__(self) -> None:
        rng = np.random.default_rng(self.seed)
        self.teams = {FIRST_TEAM + t: [FIRST_PLAYER + t * self.per_team + i for i in range(self.per_team)] for t in range(self.n_teams)}
        for p in (p for roster in self.teams.values() for p in roster):
            self.offense.setdefault(p, float(rng.normal(0, 6)))
            self.defense.setdefault(p, float(rng.normal(0, 6)))
        ids = list(self.teams)
        self.games = {f"00225{g:05d}": tuple(int(x) for x in rng.permutation(ids)[:2]) for g in range(self.n_games)}

    @staticmethod
    def name(player: int) -> str:
        return f"Given{player} Family{player}"

    def _play(self, game: str) -> tuple[list[dict], dict[int, int]]:
        """Actions of a game and the seconds of each player. Both teams send in one player at three times a quarter."""
        rng = np.random.default_rng([self.seed, int(game)])
        actions: list[dict] = []
        seconds: dict[int, int] = dict.fromkeys((p for t in self.games[game] for p in self.teams[t]), 0)

        def act(period, left, kind, team, player, text="", sub=""):
            actions.append({"actionNumber": len(actions) + 1, "clock": f"PT{left // 60:02d}M{left % 60:02d}.00S", "period": period, "teamId": team, "personId": player, "playerName": f"Family{player}", "playerNameI": f"G. Family{player}", "description": text, "actionType": kind, "subType": sub, "scoreHome": "", "scoreAway": ""})

        for period in range(1, 5):
            on = {t: [int(x) for x in rng.permutation(self.teams[t])[:5]] for t in self.games[game]}
            for t, five in on.items():  # everyone on the floor is seen once
                for p in five:
                    act(period, PERIOD_S, "Rebound", t, p, sub="Defensive")
            last = 0
            for until in (180, 360, 540, PERIOD_S):
                for at in range(last + 6, until, 6):
                    t = self.games[game][at // 6 % 2]
                    other = next(x for x in on if x != t)
                    edge = sum(self.offense[p] for p in on[t]) - sum(self.defense[p] for p in on[other])
                    made = rng.random() < np.clip(0.55 + edge / 200, 0.02, 0.98)  # two points a shot: 110 a hundred on average
                    act(period, PERIOD_S - at, "Made Shot" if made else "Missed Shot", t, on[t][at // 6 % 5], "layup")
                for five in on.values():
                    for p in five:
                        seconds[p] += until - last
                if until < PERIOD_S:
                    for t, five in on.items():
                        out, into = five[0], int(rng.choice([p for p in self.teams[t] if p not in five]))
                        act(period, PERIOD_S - until, "Substitution", t, out, f"SUB: Family{into} FOR Family{out}")
                        on[t] = [*five[1:], into]
                last = until
        return actions, seconds

    # the endpoints

    def player_index(self) -> dict:
        rows = [[str(p), self.name(p), "2020", "2025", "1"] for roster in self.teams.values() for p in roster]
        return {"resultSets": [{"name": "CommonAllPlayers", "headers": ["PERSON_ID", "DISPLAY_FIRST_LAST", "FROM_YEAR", "TO_YEAR", "ROSTERSTATUS"], "rowSet": rows}]}

    def game_index(self, season: str, season_type: str) -> dict:
        rows = []
        if (season, season_type) == (self.season, "Regular Season"):
            for i, (g, (home, away)) in enumerate(self.games.items()):
                rows += [[g, f"2025-11-{i % 28 + 1:02d}", "A vs. B", str(home), "100"], [g, f"2025-11-{i % 28 + 1:02d}", "B @ A", str(away), "99"]]
        return {"resultSets": [{"name": "LeagueGameFinderResults", "headers": ["GAME_ID", "GAME_DATE", "MATCHUP", "TEAM_ID", "PTS"], "rowSet": rows}]}

    def play_by_play(self, game_id: str) -> dict:
        return {"game": {"gameId": game_id, "actions": self._play(game_id)[0]}}

    def box_score(self, game_id: str) -> dict:
        seconds = self._play(game_id)[1]
        if self.noise and int(game_id) % 2:
            seconds[max(seconds, key=seconds.get)] += int(self.noise)

        def side(team: int) -> dict:
            own = [p for p in self.teams[team] if seconds[p]]
            return {"teamId": team, "players": [{"personId": p, "position": "G" if i < 5 else "", "statistics": {"minutes": f"{seconds[p] // 60}:{seconds[p] % 60:02d}", "points": 0, "reboundsTotal": 0, "assists": 0}} for i, p in enumerate(own)]}

        home, away = self.games[game_id]
        return {"boxScoreTraditional": {"gameId": game_id, "homeTeam": side(home), "awayTeam": side(away)}}


def aging_panel(spark: SparkSession, deltas: dict[str, float], n_players: int = 40, ages: range = range(21, 31), anchor: int = 25, noise: float = 0.5, level_of_box: float = 0.0, drop: float = 0.0, seed: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(seasons, true curves, box scores) of players whose yearly change is their position's, ``drop`` of the seasons missing.

    A player's level at the anchor is ``level_of_box`` times their box score plus noise of their own.
    """
    rng = np.random.default_rng(seed)
    seasons, truth, box = [], [], []
    for p in range(n_players):
        group = sorted(deltas)[p % len(deltas)]
        score = float(rng.normal())
        level = level_of_box * score + float(rng.normal(0, 0.3))
        box.append((p, score))
        for age in ages:
            value = level + deltas[group] * (age - anchor)
            truth.append((p, age, value))
            if rng.random() >= drop:
                seasons.append((p, str(2000 + age), group, age, value + float(rng.normal(0, noise)), 2000.0))
    return (
        spark.createDataFrame(seasons, "player_id long, season string, position_group string, age int, rating double, weight double"),
        spark.createDataFrame(truth, "player_id long, age int, value double"), spark.createDataFrame(box, "player_id long, score double"),
    )
