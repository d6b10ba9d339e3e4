"""Settings of a study, passed explicitly to every pipeline."""

from __future__ import annotations

import json
import hashlib
from dataclasses import asdict, dataclass, field


@dataclass(frozen=True)
class StudyConfig:
    """Defaults of the published method; ``fingerprint`` names results that one setting gave."""

    target: str = "onset_age"
    covariates: tuple[str, ...] = ("sex",)
    exposures: tuple[str, ...] = ()
    sample_id: str = "id"
    match_k: int = 3
    min_treated: int = 5
    min_sample: int = 10
    max_smd: float = 0.25
    use_pca: bool = True
    components: int = 5
    n_perm: int = 500
    n_perm_high: int = 10_000
    seed: int = 42
    min_obs_coef: float = 2.0
    p_threshold: float = 0.05
    check_every: int = 100
    futility_p: float = 0.5
    standardize: bool = True
    min_group: int = 5
    low_power: int = 10
    n_boot: int = 2000
    most_missing: float = 0.30
    least_maf: float = 0.001
    ld_window: int = 50
    ld_step: int = 5
    ld_r2: float = 0.8
    taus: tuple[float, ...] = field(default=(0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45))
    scan_reps: int = 200
    candidate_p: float = 1e-5
    candidate_top: int = 0
    alpha: float = 0.05
    top_loci: int = 10

    def fingerprint(self, *parts: str) -> str:
        return hashlib.md5(json.dumps([asdict(self), parts], sort_keys=True).encode()).hexdigest()[:16]
