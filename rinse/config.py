"""Fixed values and run-time settings.

The block below holds values that must equal the behaviour being rebuilt for
results to match.  They are stated once, here, and imported everywhere else.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

# ---------------------------------------------------------------------------
# FIXED VALUES (must not change; results depend on them)
# ---------------------------------------------------------------------------
DEFAULT_COMMISSION_PCT = 30
LOYALTY_EVERY_N = 13
PROMO_DAILY_DRAW = "DAILY_DRAW"
PROMO_FEATURED = "FEATURED_VEHICLE"
PROMO_LOYALTY = "LOYALTY_13TH"
PROMO_RANDOM = "FREE_WASH"
WINNER_STATUSES = ("PENDING", "APPROVED", "REVOKED")
REVOCATION_PREFIX = "\n[REVOCATION] "
RECEIPT_PREFIX = "SH"
PLATE_PATTERN = r"^[A-Z]{3}\d{3}[A-Z]$"
PLATE_PATTERN_STRICT = r"^K[A-Z]{2}\d{3}[A-Z]$"
FULL_SERVICE_WORDS = ("full", "complete")
SEED_PRICE_BY_CAR_TYPE = {"Salon/Small": 600, "SUV": 800, "Van/Bus": 1000, "Truck": 1500}
SEED_PRICE_OTHER = 0
TOP_VEHICLES_LIMIT = (5, 1, 50)      # (default, min, max)
ELIGIBLES_LIMIT = (50, 1, 200)       # (default, min, max)
ELIGIBLES_MIN_WASHES = 12
VALIDATION_MESSAGES = {
    "plate": "vehicle_reg is required.",
    "plate_format": "vehicle_reg must match Kenyan format e.g. KDP547Z.",
    "service": "service_id is required.",
    "staff": "staff_id is required.",
    "car_type": "car_type is required.",
}
MONTH_PATTERN = r"^\d{4}-\d{2}$"
DAY_PATTERN = r"^\d{4}-\d{2}-\d{2}$"
MSG_NO_PRICE = "Price not configured for service & car type."
# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class PromoSettings:
    """The promotion part of the business settings row, passed to operators."""

    random_enabled: bool = True
    random_prob: float = 0.2
    random_min_visits: int = 3
    random_daily_cap: int = 25
    featured_once_per_month: bool = True
    seed: str = "rinse"
    # promotion codes that exist and are active; a step whose code is missing
    # is skipped (loyalty is the exception: it is granted without a promo row)
    active_codes: tuple = field(default=(PROMO_DAILY_DRAW, PROMO_FEATURED,
                                         PROMO_LOYALTY, PROMO_RANDOM))
    winner_status: str | None = "APPROVED"


def as_date(value) -> dt.date:
    if isinstance(value, dt.datetime):
        return value.date()
    if isinstance(value, dt.date):
        return value
    return dt.date.fromisoformat(str(value)[:10])
