"""Driver-side settings: thresholds, rate card, and where they come from."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, field, replace
from pathlib import Path

CONFIG_FILE = "spanloom.yml"
CONFIG_ENV = "SPANLOOM_CONFIG"


@dataclass(frozen=True)
class Thresholds:
    """When a run counts as misbehaving."""

    loop_count: int = 5
    failure_count: int = 3
    cost_limit_usd: float = 1.00


# USD per 1,000 tokens as (input, output), and the region
# prefixes a model id may carry.
DEFAULT_RATE = (0.001, 0.005)
KNOWN_RATES = {"anthropic.claude-haiku-4-5-20251001-v1:0": (0.001, 0.005)}
REGION_PREFIXES = ("us.", "eu.", "apac.")


@dataclass(frozen=True)
class RateCard:
    """Model prices. Unknown and missing models get ``default``, never zero."""

    default: tuple[float, float] = DEFAULT_RATE
    rates: Mapping[str, tuple[float, float]] = field(default_factory=lambda: dict(KNOWN_RATES))


@dataclass(frozen=True)
class Settings:
    """Everything a deployment may tune, resolved defaults < file < environment."""

    service_name: str | None = None
    backend: str | None = None
    model: str | None = None
    region: str = "us-east-1"
    thresholds: Thresholds = Thresholds()
    source: Path | None = None

    @classmethod
    def resolve(
        cls,
        path: str | os.PathLike | None = None,
        env: Mapping[str, str] | None = None,
    ) -> "Settings":
        env = os.environ if env is None else env
        settings = cls._from_file(_locate(path, env))
        base = settings.thresholds

        def override(name, kind, fallback):
            raw = env.get(f"SPANLOOM_{name}")
            return fallback if raw in (None, "") else kind(raw)

        return replace(
            settings,
            thresholds=Thresholds(
                override("LOOP_COUNT", int, base.loop_count),
                override("FAILURE_COUNT", int, base.failure_count),
                override("COST_LIMIT_USD", float, base.cost_limit_usd),
            ),
        )

    @classmethod
    def _from_file(cls, path: Path | None) -> "Settings":
        if path is None:
            return cls()
        import yaml

        body = yaml.safe_load(path.read_text(encoding="utf-8")) or {}
        if not isinstance(body, dict):
            raise ValueError(f"{path}: expected a mapping of settings, found {type(body).__name__}")
        limits = body.get("detection") or {}
        if not isinstance(limits, dict):
            raise ValueError(f"{path}: 'detection' must map threshold names to numbers")
        std = Thresholds()
        return cls(
            service_name=body.get("service_name") or None,
            backend=body.get("backend") or None,
            model=body.get("bedrock_model") or None,
            region=body.get("aws_region") or cls.region,
            thresholds=Thresholds(
                int(limits.get("loop_count", std.loop_count)),
                int(limits.get("failure_count", std.failure_count)),
                float(limits.get("cost_limit_usd", std.cost_limit_usd)),
            ),
            source=path,
        )


def _locate(path, env: Mapping[str, str]) -> Path | None:
    """An explicit path, else the environment's, else the nearest file upwards."""

    named = path or env.get(CONFIG_ENV)
    if named:
        found = Path(named).expanduser()
        return found if found.is_file() else None
    cwd = Path.cwd()
    return next((d / CONFIG_FILE for d in (cwd, *cwd.parents) if (d / CONFIG_FILE).is_file()), None)
