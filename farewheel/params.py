"""Business parameters shared by the operators.

Every "today" in the engine is the explicit ``as_of`` date, so a run can be
repeated and gives the same rows.
"""

from __future__ import annotations

from calendar import monthrange
from dataclasses import dataclass, field
from datetime import date, timedelta

# Category codes of the domain.
CASUAL = "Casual Member"
MEMBER = "Annual Member"
EBIKE = "EFIT"
CLASSIC = "ICONIC"

CTA_SHOWN = "cta_shown"
CTA_CLICKED = "cta_clicked"
SIGNUP_STARTED = "signup_started"
STEP_COMPLETED = "signup_step_completed"
SIGNUP_ABANDONED = "signup_abandoned"
SIGNUP_COMPLETED = "signup_completed"
APP_UNINSTALL = "app_uninstall"

WEEKEND_EXPLORER = "Weekend Explorer"
RELUCTANT_COMMUTER = "Reluctant Commuter"
EBIKE_ADOPTER = "E-bike Adopter"
SEASONAL_VISITOR = "Seasonal Visitor"


@dataclass(frozen=True)
class Pricing:
    annual_fee: float = 105.0
    unlock: float = 1.00
    classic_per_min: float = 0.12
    ebike_per_min: float = 0.20
    member_ebike_per_min: float = 0.10
    # share of the annual price asked for the weekend tier
    weekend_tier_share: float = 0.6


@dataclass(frozen=True)
class Params:
    as_of: date = date(2023, 12, 31)
    pricing: Pricing = field(default_factory=Pricing)
    # casual rides per month used to project channel revenue
    monthly_base: int = 133_000

    def days_ago(self, days: int) -> date:
        return self.as_of - timedelta(days=days)

    def months_ago(self, months: int) -> date:
        """The same day of an earlier month, or that month's last day."""
        year, month = divmod(self.as_of.year * 12 + self.as_of.month - 1 - months, 12)
        return date(year, month + 1, min(self.as_of.day, monthrange(year, month + 1)[1]))

    @property
    def month_start(self) -> date:
        return self.as_of.replace(day=1)

    @property
    def year_start(self) -> date:
        return self.as_of.replace(month=1, day=1)


DEFAULTS = Params()
