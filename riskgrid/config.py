"""Constants of the scoring model. They must be these for scores to be comparable."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields

DIMS = 14
#: Features of the cheap first pass, and those that complete the distance.
BLOCK_A = (0, 6, 7, 9, 10, 12)
BLOCK_B = (1, 2, 3, 4, 5, 8, 11, 13)
K = 5
PRUNE = 100
#: A transaction is approved if fewer of its neighbours are fraudulent.
DENY_AT = 3
DEFAULT_RISK = 0.5
MOST_MCC = 9999
BOUNDS = (-1.0, 1.0)


@dataclass(frozen=True)
class Normalization:
    max_amount: float = 10000.0
    max_installments: float = 12.0
    amount_vs_avg_ratio: float = 10.0
    max_minutes: float = 1440.0
    max_km: float = 1000.0
    max_tx_count_24h: float = 20.0
    max_merchant_avg_amount: float = 10000.0

    @classmethod
    def from_json(cls, text: str) -> Normalization:
        """Known keys of a JSON object; others keep their defaults. ``sources.corpus.read_text`` reads the file."""
        got = json.loads(text)
        return cls(**{f.name: float(got[f.name]) for f in fields(cls) if f.name in got})


@dataclass(frozen=True)
class RiskTable:
    """Risks by merchant category code; a parameter, as corpora differ in it."""

    risks: dict[int, float] = field(default_factory=lambda: {5411: 0.5, 5812: 0.8, 6011: 1.2})

    @classmethod
    def from_json(cls, text: str) -> RiskTable:
        """Risks by code; codes out of range are left out. ``sources.corpus.read_text`` reads the file."""
        return cls({int(k): float(v) for k, v in json.loads(text).items() if 0 <= int(k) <= MOST_MCC})
