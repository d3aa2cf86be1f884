"""Defaults that a deployment sets: which teams and competitions, how many games, how fast to fetch."""

from __future__ import annotations

import os
from dataclasses import dataclass, field


def _list(name: str, default: str) -> list[str]:
    return [x.strip() for x in os.environ.get(name, default).split(",") if x.strip()]


@dataclass(frozen=True)
class Config:
    teams: list[str] = field(default_factory=lambda: _list("COURTSIDE_TEAMS", ""))
    competitions: list[str] = field(default_factory=lambda: _list("COURTSIDE_COMPETITIONS", "euroleague,acb,copa-del-rey,supercopa"))
    season: int = field(default_factory=lambda: int(os.environ.get("COURTSIDE_SEASON", "2025")))
    last_n_games: int = field(default_factory=lambda: int(os.environ.get("COURTSIDE_LAST_N", "5")))
    fetch_delay_seconds: int = field(default_factory=lambda: int(os.environ.get("COURTSIDE_FETCH_DELAY", "20")))
