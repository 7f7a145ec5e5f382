"""One place for every constant the operators share."""

from __future__ import annotations

from dataclasses import dataclass

MICROS_PER_SECOND = 1_000_000
MICROS_PER_MINUTE = 60 * MICROS_PER_SECOND
MICROS_PER_DAY = 24 * 60 * MICROS_PER_MINUTE

# The trailing windows, in minutes, and the names of their columns.
TRAILING_MINUTES = {
    "songs_total_40min": 40,
    "songs_total_1h": 60,
    "songs_total_6h": 360,
    "songs_total_12h": 720,
    "songs_total_24h": 1440,
}
# The discrete bin, its parity column (open towards the future) and
# its documented column (plays of the same bin only).
BIN_MINUTES = 20
BIN_SUFFIX_COLUMN = "songs_total_20min"
BIN_COLUMN = "songs_bin_20min"

ORDER_COLUMN = "track_order_in_day"
RATE_COLUMN = "per_user_skip_rate"


@dataclass(frozen=True)
class Settings:
    """Column names and thresholds; the defaults fit the play-event table."""

    user: str = "username"
    ts: str = "ts"
    obs_id: str = "obs_id"
    label: str = "fwdbtn"
    seed: int = 420
    train_frac: float = 0.8
    rare_cut: float = 0.01

    @property
    def fold_column(self) -> str:
        return "split"
