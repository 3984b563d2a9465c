"""Settings of the engine, checked when they are made, and the names that tag stored results."""

from __future__ import annotations

import hashlib
import json
import math
from dataclasses import asdict, dataclass, field, replace

# The canonical budget profiles.
# B, eps_start, eps_count, eps_bucket, eps_event by bucket
PROFILES = {
    "B0p5": (0.5, 0.050, 0.100, 0.0025, (0.0050, 0.0125, 0.0250)),
    "B1p0": (1.0, 0.100, 0.200, 0.0050, (0.0100, 0.0250, 0.0500)),
    "B1p5": (1.5, 0.150, 0.300, 0.0075, (0.0150, 0.0375, 0.0750)),
}
RECOVERY_MODE = "context_bucket_mixture"


@dataclass(frozen=True)
class RiskConfig:
    """Weights and scales of the risk score, and the thresholds of its buckets, strictly falling."""

    lambda_e: float = 0.3333333333
    lambda_s: float = 0.3333333333
    lambda_d: float = 0.3333333334
    sigma_e: float = 3.0
    sigma_st: float = 3.0
    stay_seconds: float = 300.0
    thresholds: tuple[float, ...] = (0.67, 0.34)

    def __post_init__(self):
        if abs(self.lambda_e + self.lambda_s + self.lambda_d - 1) > 1e-6:
            raise ValueError("the weights must sum to 1")
        if min(self.lambda_e, self.lambda_s, self.lambda_d) < 0:
            raise ValueError("weights must not be negative")
        if self.sigma_e <= 0 or self.sigma_st <= 0:
            raise ValueError("scales must be positive")
        if not self.thresholds or any(a <= b for a, b in zip(self.thresholds, self.thresholds[1:], strict=False)):
            raise ValueError("thresholds must fall strictly, and there must be one at least")

    @property
    def buckets(self) -> int:
        return len(self.thresholds) + 1


@dataclass(frozen=True)
class PrivacyConfig:
    """A reporting budget for each sub-trajectory; bucket 1 is the most protected."""

    budget: float = 1.0
    eps_start: float = 0.100
    eps_count: float = 0.200
    eps_bucket: float = 0.0050
    eps_event: tuple[float, ...] = (0.0100, 0.0250, 0.0500)
    max_segments: int = 30
    eps_uniform: float | None = None

    def __post_init__(self):
        if min(self.eps_start, self.eps_count, self.eps_bucket, *self.eps_event) <= 0:
            raise ValueError("every epsilon must be positive")
        if any(a >= b for a, b in zip(self.eps_event, self.eps_event[1:], strict=False)):
            raise ValueError("event epsilons must rise with the bucket")
        if self.max_segments < 2:
            raise ValueError("a sub-trajectory needs two segments")
        if self.required > self.budget + 1e-12:
            raise ValueError(f"the budget {self.budget} is below the least spend {self.required}")

    @classmethod
    def profile(cls, name: str, **more) -> PrivacyConfig:
        budget, start, count, bucket, event = PROFILES[name]
        return cls(budget, start, count, bucket, event, **more)

    @property
    def costs(self) -> tuple[float, ...]:
        return tuple(e + self.eps_bucket for e in self.eps_event)

    @property
    def for_transitions(self) -> float:
        return self.budget - self.eps_start - self.eps_count

    @property
    def required(self) -> float:
        return self.eps_start + self.eps_count + (self.max_segments - 1) * (min(self.eps_event) + self.eps_bucket)

    @property
    def uniform(self) -> float:
        """The event epsilon that spends the budget evenly."""
        eps = self.eps_uniform if self.eps_uniform is not None else self.for_transitions / (self.max_segments - 1) - self.eps_bucket
        if eps <= 0 or self.eps_start + self.eps_count + (self.max_segments - 1) * (eps + self.eps_bucket) > self.budget + 1e-9:
            raise ValueError("no positive uniform epsilon fits the budget")
        return eps

    @property
    def uniform_bucket(self) -> int:
        """The bucket whose epsilon is nearest the uniform one, the lower on a tie."""
        return min(range(1, len(self.eps_event) + 1), key=lambda k: (abs(self.eps_event[k - 1] - self.uniform), k))


@dataclass(frozen=True)
class RecoveryConfig:
    mode: str = RECOVERY_MODE
    tau: float = 20.0
    ridge: float = 1e-8
    joint_min_reports: int = 20
    mass_weight: float = 10.0

    def __post_init__(self):
        if self.mode != RECOVERY_MODE:
            raise ValueError(f"mode must be {RECOVERY_MODE}")
        if self.tau < 0 or self.ridge < 0:
            raise ValueError("tau and ridge must not be negative")


@dataclass(frozen=True)
class DatasetConfig:
    name: str = "walks"
    sample_size: int | None = None
    seed: int = 42
    interval_seconds: int = 15
    matching: str = "nearest_node_shortest_path"
    ratios: tuple[float, float, float] = (0.8, 0.1, 0.1)
    min_points: int = 10
    max_points: int | None = None
    downsample_to: int | None = None
    drop_missing: bool = True

    def __post_init__(self):
        if abs(sum(self.ratios) - 1) > 1e-9:
            raise ValueError("split ratios must sum to 1")

    @property
    def variant(self) -> str:
        size = "all" if self.sample_size is None else number_tag(self.sample_size)
        return f"{safe_tag(self.name)}_s{size}_seed{self.seed}_dt{number_tag(self.interval_seconds)}_mm{safe_tag(self.matching)}_{digest(asdict(self))}"


@dataclass(frozen=True)
class ExperimentConfig:
    dataset: DatasetConfig = field(default_factory=DatasetConfig)
    risk: RiskConfig = field(default_factory=RiskConfig)
    privacy: PrivacyConfig = field(default_factory=PrivacyConfig)
    recovery: RecoveryConfig = field(default_factory=RecoveryConfig)
    profile: str = "B1p0"
    seed: int = 42
    synthesis_splits: tuple[str, ...] = ("train", "valid")

    def __post_init__(self):
        if "test" in self.synthesis_splits:
            raise ValueError("synthesis must not see the test split")
        if self.risk.buckets != len(self.privacy.eps_event):
            raise ValueError("a risk bucket needs an event epsilon each")

    @property
    def tag(self) -> str:
        p = self.privacy
        return f"Lm{p.max_segments}_K{self.risk.buckets}_{self.profile}_B{number_tag(p.budget)}_rec{safe_tag(self.recovery.mode)}_seed{self.seed}_{digest(asdict(self))}"

    def grid(self, profiles, seeds) -> list[ExperimentConfig]:
        """One configuration for each profile and seed."""
        return [replace(self, privacy=PrivacyConfig.profile(p, max_segments=self.privacy.max_segments), profile=p, seed=s) for p in profiles for s in seeds]

    def ablations(self) -> dict[str, ExperimentConfig]:
        return {name: replace(self, risk=replace(self.risk, lambda_e=w[0], lambda_s=w[1], lambda_d=w[2])) for name, w in ablation_weights(self.risk).items()}


def ablation_weights(risk: RiskConfig) -> dict[str, tuple[float, float, float]]:
    """The weights with each component left out in turn, the rest scaled to sum to 1."""
    full = (risk.lambda_e, risk.lambda_s, risk.lambda_d)
    out = {"full": full}
    for k, name in enumerate(("endpoint", "stay", "degree")):
        rest = [0.0 if j == k else w for j, w in enumerate(full)]
        out[f"without_{name}"] = tuple(w / sum(rest) for w in rest)
    return out


def digest(values: dict) -> str:
    """Eight hex digits of the SHA-256 of the sorted compact JSON."""
    return hashlib.sha256(json.dumps(values, sort_keys=True, separators=(",", ":"), default=str).encode()).hexdigest()[:8]


def number_tag(x: float) -> str:
    """1.0 gives 1 and 0.005 gives 0p005."""
    text = f"{x:.12f}".rstrip("0").rstrip(".") if isinstance(x, float) else str(x)
    return text.replace(".", "p").replace("-", "m")


def safe_tag(text: str) -> str:
    return "".join(c if c.isalnum() or c == "-" else "-" for c in str(text)).strip("-") or "none"


def positive_or_none(x) -> int | None:
    """None, and what is not above 0, mean no limit."""
    return None if x is None or int(x) <= 0 else int(x)


def grr_parameters(eps: float, d: int) -> tuple[float, float]:
    """Chance to keep the value, and that of each other value, in a domain of d."""
    if d <= 0:
        raise ValueError("the domain is empty")
    if d == 1:
        return 1.0, 0.0
    e = math.exp(eps)
    return e / (e + d - 1), 1 / (e + d - 1)
