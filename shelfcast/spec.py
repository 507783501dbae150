"""The dates, windows and limits that the operators share."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass


@dataclass(frozen=True)
class PanelSpec:
    """Everything about a panel that is not in its rows.

    ``chunk_days`` bounds a window group: a series is cut into chunks of that many
    days (plus the rows its frames reach), so no store is ever one task's work.
    ``money_scale`` divides RMSE, for facts that hold sales in cents.
    """

    valid_start: dt.date = dt.date(2015, 4, 27)
    test_start: dt.date = dt.date(2015, 6, 14)
    serve_to: dt.date = dt.date(2015, 9, 17)
    horizon: int = 48
    lags: tuple[int, ...] = (49, 56, 63, 70, 77, 91)
    roll_windows: tuple[int, ...] = (7, 14, 28, 91)
    level_window: int = 28
    trend_window: int = 91
    weekday_weeks: int = 4
    chunk_days: int = 728
    money_scale: int = 1

    @property
    def serve_from(self) -> dt.date:
        return self.test_start

    @property
    def weekday_lags(self) -> tuple[int, ...]:
        """The first same-weekday lags that lie wholly outside the horizon."""
        first = -(-(self.horizon + 1) // 7) * 7
        return tuple(first + 7 * k for k in range(self.weekday_weeks))

    @property
    def look_back(self) -> int:
        """Days of history that the deepest frame reads."""
        frames = [self.horizon + w - 1 for w in (*self.roll_windows, self.level_window)]
        return max(frames + list(self.lags) + list(self.weekday_lags))

    @property
    def look_ahead(self) -> int:
        """Days of published calendar read after a row (tomorrow's promotion)."""
        return 1

    @staticmethod
    def min_count(window: int) -> int:
        return max(2, window // 3)

    def cutoff(self, split: str) -> dt.date:
        return {"valid": self.valid_start, "test": self.test_start}[split]
