"""Settings: normalisation constants, category risks and search parameters."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from pathlib import Path

import numpy as np

# The constants of the standard normalisation.
STANDARD_NORM = {
    "max_amount": 10000.0,
    "max_installments": 12.0,
    "amount_vs_avg_ratio": 10.0,
    "max_minutes": 1440.0,
    "max_km": 1000.0,
    "max_tx_count_24h": 20.0,
    "max_merchant_avg_amount": 10000.0,
}
# Risk by merchant category; any other has DEFAULT_RISK.
STANDARD_RISK = {
    "5411": 0.15,
    "5812": 0.30,
    "5912": 0.20,
    "5944": 0.45,
    "7801": 0.80,
    "7802": 0.75,
    "7995": 0.85,
    "4511": 0.35,
    "5311": 0.25,
    "5999": 0.50,
}
DEFAULT_RISK = 0.5
#: Of a customer's known merchants, so many count.
MAX_KNOWN = 32


def read_flat(path: str) -> dict[str, float]:
    """The numbers of a flat JSON object, the first of a repeated key; {} if the file is missing, empty or no object."""
    try:
        pairs = json.loads(Path(path).read_text(), object_pairs_hook=list)
    except (OSError, ValueError):
        return {}
    out: dict[str, float] = {}
    for k, v in pairs if isinstance(pairs, list) else []:
        if isinstance(v, (int, float)) and not isinstance(v, bool):
            out.setdefault(k, float(np.float32(v)))
    return out


@dataclass(frozen=True)
class NormConfig:
    """A constant that is missing counts as 1."""

    norm: dict[str, float] = field(default_factory=lambda: dict(STANDARD_NORM))
    risk: dict[str, float] = field(default_factory=lambda: dict(STANDARD_RISK))

    @classmethod
    def load(cls, norm_path: str, risk_path: str) -> NormConfig:
        return cls(read_flat(norm_path), read_flat(risk_path))

    def inverse(self, key: str) -> float:
        """1 / constant, as float32."""
        return float(np.float32(1) / np.float32(self.norm.get(key, 1.0)))


@dataclass(frozen=True)
class SearchConfig:
    """nprobe clusters are searched, nprobe_border for borderline queries if above 0; counts within repair_min and
    repair_max are repaired."""

    nprobe: int = 4
    nprobe_border: int = 0
    repair_min: int = 2
    repair_max: int = 3
    k: int = 5

    def check(self, clusters: int) -> SearchConfig:
        for name, n in (("nprobe", self.nprobe), ("nprobe_border", self.nprobe_border or self.nprobe)):
            if not 1 <= n <= clusters:
                raise ValueError(f"{name} must be from 1 to {clusters}, not {n}")
        return self

    @classmethod
    def from_env(cls, env: dict[str, str], prefix: str = "API_") -> SearchConfig:
        names = {"nprobe": "NPROBE", "nprobe_border": "NPROBE_BORDER", "repair_min": "REPAIR_MIN", "repair_max": "REPAIR_MAX"}
        return cls(**{k: int(env[prefix + v]) for k, v in names.items() if prefix + v in env})


def _required(env: dict[str, str], *names: str) -> list[str]:
    missing = [n for n in names if not env.get(n)]
    if missing:
        raise ValueError(f"these must be set: {', '.join(missing)}")
    return [env[n] for n in names]


@dataclass(frozen=True)
class ServiceConfig:
    """A scoring service: paths, search, and how it polls. Where it takes requests from (control), the references, the
    normalisation and the category risks must be given."""

    control: str
    references: str
    normalization: str
    mcc_risk: str
    search: SearchConfig = field(default_factory=SearchConfig)
    metrics_port: int = 0
    warmup_ms: int = 0
    busy_poll_us: int = 0
    busy_poll_budget: int = 0
    prefer_busy_poll: int = 0
    poll_timeout_ms: int = 1

    @classmethod
    def from_env(cls, env: dict[str, str], prefix: str = "API_") -> ServiceConfig:
        paths = _required(env, *(prefix + n for n in ("CTRL", "REFERENCES", "NORMALIZATION", "MCC_RISK")))
        names = {
            "metrics_port": "METRICS_PORT", "warmup_ms": "WARMUP_MS", "busy_poll_us": "BUSY_POLL_US", "busy_poll_budget": "BUSY_POLL_BUDGET",
            "prefer_busy_poll": "PREFER_BUSY_POLL", "poll_timeout_ms": "EPOLL_TIMEOUT_MS",
        }
        return cls(*paths, search=SearchConfig.from_env(env, prefix), **{k: int(env[prefix + v]) for k, v in names.items() if prefix + v in env})

    def norm(self) -> NormConfig:
        return NormConfig.load(self.normalization, self.mcc_risk)

    @property
    def trigger(self) -> str:
        """The interval of a stream that stands for the poll's timeout."""
        return f"{max(1, self.poll_timeout_ms)} milliseconds"


@dataclass(frozen=True)
class BalancerConfig:
    """A balancer: its port and the backends, which must be given."""

    backends: tuple[str, ...]
    port: int = 9999
    metrics_port: int = 0

    @classmethod
    def from_env(cls, env: dict[str, str], prefix: str = "LB_") -> BalancerConfig:
        backends = tuple(x for x in _required(env, prefix + "BACKENDS")[0].split(",") if x)
        if not backends:
            raise ValueError(f"{prefix}BACKENDS names no backend")
        return cls(backends, int(env.get(prefix + "PORT", 9999)), int(env.get(prefix + "METRICS_PORT", 0)))
