"""Versioned settings, crop taxonomy and ranking profiles, with their invariants."""

from __future__ import annotations

from dataclasses import dataclass, field

# Crop taxonomy, config version 1.0.0.
TAXONOMY_VERSION = "1.0.0"
CROPS = [
    dict(crop_id=1, canonical_name="soja", nome_ptbr="Soja", categoria="graos",
         temporaria_permanente="temporaria", cycle_days_min=100, cycle_days_max=160,
         active=True, implementation_status="pilot",
         aliases={"common": ["soja", "soja em grao", "soja em grãos"],
                  "ibge": ["Soja (em grão)"], "conab": ["SOJA"], "zarc": ["soja"]}),
    dict(crop_id=2, canonical_name="milho", nome_ptbr="Milho", categoria="graos",
         temporaria_permanente="temporaria", cycle_days_min=90, cycle_days_max=180,
         active=False, implementation_status="planned",
         aliases={"common": ["milho", "milho em grao", "milho em grãos"],
                  "ibge": ["Milho (em grão)"], "conab": ["MILHO"], "zarc": ["milho"]}),
    dict(crop_id=3, canonical_name="feijao", nome_ptbr="Feijão", categoria="graos",
         temporaria_permanente="temporaria", cycle_days_min=70, cycle_days_max=120,
         active=False, implementation_status="planned",
         aliases={"common": ["feijao", "feijão"], "ibge": ["Feijão (em grão)"],
                  "conab": ["FEIJAO", "FEIJÃO"], "zarc": ["feijao", "feijão"]}),
    dict(crop_id=4, canonical_name="arroz", nome_ptbr="Arroz", categoria="graos",
         temporaria_permanente="temporaria", cycle_days_min=100, cycle_days_max=150,
         active=False, implementation_status="planned",
         aliases={"common": ["arroz", "arroz em casca"], "ibge": ["Arroz (em casca)"],
                  "conab": ["ARROZ"], "zarc": ["arroz"]}),
    dict(crop_id=5, canonical_name="trigo", nome_ptbr="Trigo", categoria="graos",
         temporaria_permanente="temporaria", cycle_days_min=100, cycle_days_max=150,
         active=False, implementation_status="planned",
         aliases={"common": ["trigo", "trigo em grao", "trigo em grãos"],
                  "ibge": ["Trigo (em grão)"], "conab": ["TRIGO"], "zarc": ["trigo"]}),
    dict(crop_id=6, canonical_name="algodao", nome_ptbr="Algodão", categoria="fibras",
         temporaria_permanente="temporaria", cycle_days_min=150, cycle_days_max=220,
         active=False, implementation_status="planned",
         aliases={"common": ["algodao", "algodão", "algodao herbaceo", "algodão herbáceo"],
                  "ibge": ["Algodão herbáceo (em caroço)"],
                  "conab": ["ALGODAO", "ALGODÃO"], "zarc": ["algodao", "algodão"]}),
]

# Ranking profiles, config version 1.0.0.
RANKING_VERSION = "1.0.0"
RANKING_PROFILES = {
    "balanced": {"return": 0.45, "risk": 0.25, "agronomic": 0.15, "speed": 0.10, "confidence": 0.05},
    "max_return": {"return": 0.65, "risk": 0.10, "agronomic": 0.10, "speed": 0.10, "confidence": 0.05},
    "low_risk": {"return": 0.20, "risk": 0.50, "agronomic": 0.15, "speed": 0.05, "confidence": 0.10},
    "fast_return": {"return": 0.25, "risk": 0.15, "agronomic": 0.10, "speed": 0.45, "confidence": 0.05},
}
COMPONENTS = ("return", "risk", "agronomic", "speed", "confidence")


def checked_profiles(profiles: dict[str, dict[str, float]] = RANKING_PROFILES):
    """Profiles whose weights lie in 0..1 and sum to one."""
    for name, weights in profiles.items():
        if set(weights) != set(COMPONENTS):
            raise ValueError(f"profile {name} must weigh exactly {COMPONENTS}")
        if any(not 0 <= w <= 1 for w in weights.values()):
            raise ValueError(f"profile {name} has a weight outside 0..1")
        if abs(sum(weights.values()) - 1.0) > 1e-9:
            raise ValueError(f"weights of profile {name} sum to {sum(weights.values())}, not 1")
    return profiles


@dataclass(frozen=True)
class ClimateSettings:
    start_year: int = 2017
    end_year: int = 2025
    max_station_distance_km: float = 250.0
    minimum_season_coverage: float = 0.70

    def __post_init__(self):
        if not 2000 <= self.start_year <= self.end_year <= 2200:
            raise ValueError("climate years must satisfy 2000 <= start <= end <= 2200")
        if not 0 < self.max_station_distance_km <= 1000:
            raise ValueError("max_station_distance_km must be in (0, 1000]")
        if not 0 <= self.minimum_season_coverage <= 1:
            raise ValueError("minimum_season_coverage must be in [0, 1]")


@dataclass(frozen=True)
class ModelSettings:
    training_start_year: int = 2019
    training_end_year: int = 2024
    temporal_test_start_year: int = 2023
    geographic_holdout_fraction: float = 0.20
    random_seed: int = 20_260_820
    prediction_interval_coverage: float = 0.80

    def __post_init__(self):
        if self.training_end_year < self.training_start_year:
            raise ValueError("training_end_year must not precede training_start_year")
        if not self.training_start_year < self.temporal_test_start_year <= self.training_end_year:
            raise ValueError("temporal_test_start_year must fall inside the training years")
        if not 0 < self.geographic_holdout_fraction < 0.5:
            raise ValueError("geographic_holdout_fraction must be in (0, 0.5)")
        if not 0.5 < self.prediction_interval_coverage < 1:
            raise ValueError("prediction_interval_coverage must be in (0.5, 1)")


@dataclass(frozen=True)
class RiskSettings:
    simulations: int = 10_000
    seed: int = 20_260_820

    def __post_init__(self):
        if self.simulations < 100:
            raise ValueError("simulations must be at least 100")


@dataclass(frozen=True)
class Settings:
    config_version: str = "1.0.0"
    pipeline_version: str = "0.1.0"
    climate: ClimateSettings = field(default_factory=ClimateSettings)
    model: ModelSettings = field(default_factory=ModelSettings)
    risk: RiskSettings = field(default_factory=RiskSettings)
