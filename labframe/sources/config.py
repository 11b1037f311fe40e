"""Typed settings, checked when they are made."""

from __future__ import annotations

import dataclasses
from collections.abc import Mapping

# What may be set.
ORDERS = ["MDY", "DMY"]
ENVIRONMENTS = ["development", "production"]
SECRET_LENGTH = 32


@dataclasses.dataclass(frozen=True)
class Settings:
    environment: str = "development"
    date_order: str = "MDY"
    auto_accept: float = 0.9
    high_confidence: float = 0.9
    low_confidence: float = 0.7
    page_cap: int = 50
    claim_minutes: int = 60
    retention_days: int = 0
    provider: str = "rule_based"
    fallback: bool = False
    external_consent: bool = False
    secret: str = ""
    storage_key: str = ""

    def __post_init__(self):
        if found := self.problems():
            raise ValueError("; ".join(found))

    def problems(self) -> list[str]:
        """All that is wrong, in the order of the settings."""
        shares = 0 < self.low_confidence <= self.high_confidence <= 1
        production = self.environment == "production"
        checks = [
            (self.environment in ENVIRONMENTS, f"environment must be one of {', '.join(ENVIRONMENTS)}"), (self.date_order in ORDERS, f"date_order must be one of {', '.join(ORDERS)}"),
            (0.5 <= self.auto_accept <= 1, "auto_accept must be between 0.5 and 1.0"), (shares, "require 0 < low_confidence <= high_confidence <= 1"),
            (self.page_cap > 0, "page_cap must be positive"), (self.claim_minutes > 0, "claim_minutes must be positive"), (self.retention_days >= 0, "retention_days must not be negative"),
            (self.provider == "rule_based" or self.external_consent, "an external provider needs external_consent"),
            (not production or len(self.secret) >= SECRET_LENGTH, f"production needs a secret of {SECRET_LENGTH} characters or more"), (not production or bool(self.storage_key), "production needs a storage_key"),
        ]
        return [text for good, text in checks if not good]

    @classmethod
    def read(cls, *layers: Mapping[str, str]) -> Settings:
        """From texts, later layers over earlier ones; names in any case, unknown ones are left out, blanks count as not set."""
        given: dict = {}
        for layer in layers:
            given |= {k.lower(): v for k, v in layer.items() if str(v).strip()}
        values = {f.name: _typed(f.name, type(f.default), given[f.name]) for f in dataclasses.fields(cls) if f.name in given}
        return cls(**values)


def _typed(name: str, kind: type, text: str):
    if kind is bool:
        if str(text).strip().lower() not in ("true", "false", "1", "0", "yes", "no"):
            raise ValueError(f"{name} must be true or false")
        return str(text).strip().lower() in ("true", "1", "yes")
    try:
        return kind(str(text).strip())
    except ValueError as e:
        raise ValueError(f"{name} must be of type {kind.__name__}") from e
