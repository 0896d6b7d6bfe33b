"""Choices a user makes on the dashboard."""

from __future__ import annotations

from dataclasses import dataclass

# Normal quantiles used for the three service levels on offer.
Z_SCORES = {"90%": 1.28, "95%": 1.65, "99%": 2.33}
PROMOTION_MODES = ("all", "yes", "no")
OVERSTOCK_RATIO_RANGE = (0.20, 0.80)
LEAD_TIME_RANGE = (1, 30)

# The stops of the three sliders.
OVERSTOCK_RATIOS = tuple(step / 100 for step in range(20, 81, 5))
LEAD_TIMES = tuple(range(LEAD_TIME_RANGE[0], LEAD_TIME_RANGE[1] + 1))
SERVICE_LEVELS = tuple(Z_SCORES)


@dataclass(frozen=True)
class Params:
    """Filters and assumptions. ``categories=None`` means every category; an empty tuple means none."""

    categories: tuple[str, ...] | None = None
    promo: str = "all"
    sku: str = ""
    overstock_ratio: float = 0.50
    lead_time_days: int = 7
    service_level: str = "95%"

    def __post_init__(self) -> None:
        if self.categories is not None:
            object.__setattr__(self, "categories", tuple(self.categories))
        if self.promo not in PROMOTION_MODES:
            raise ValueError(f"promo must be one of {PROMOTION_MODES}, not {self.promo!r}")
        if self.service_level not in Z_SCORES:
            raise ValueError(f"service_level must be one of {tuple(Z_SCORES)}, not {self.service_level!r}")
        low, high = OVERSTOCK_RATIO_RANGE
        if not low <= self.overstock_ratio <= high:
            raise ValueError(f"overstock_ratio must lie in {low}..{high}")
        low, high = LEAD_TIME_RANGE
        if not low <= self.lead_time_days <= high:
            raise ValueError(f"lead_time_days must lie in {low}..{high}")

    @property
    def z(self) -> float:
        return Z_SCORES[self.service_level]

    @property
    def sku_id(self) -> int | None:
        """Product id typed by the user; None (no filter) when blank or not a whole number."""
        try:
            return int(self.sku.strip())
        except ValueError:
            return None

    @property
    def sku_warning(self) -> str | None:
        """Message for text that cannot be used as a product id."""
        if self.sku.strip() and self.sku_id is None:
            return "Product ID must be numeric."  # fixed value: the text of the message
        return None
