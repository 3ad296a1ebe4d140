"""Settings of the agent."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, fields, replace

STRATEGIES = ("none", "open", "infogain", "hybrid")


@dataclass(frozen=True)
class Config:
    """Every switch and weight; an unknown strategy is refused when the object is made."""

    use_category_lock: bool = True
    use_state_tracking: bool = True
    use_constraint_scoring: bool = True
    use_override_erasure: bool = True
    use_profile_prior: bool = True
    use_popularity_prior: bool = True
    use_mmr_diversity: bool = False
    pad_to_top_k: bool = True
    use_confidence_gate: bool = True
    gate_min_constraints: int = 4
    gate_list_size: int = 1
    gate_max_turn: int = 3
    use_observed_fallback: bool = True
    clarify_strategy: str = "hybrid"
    use_dense_rerank: bool = False
    dense_cold_start_only: bool = False
    w_bm25: float = 1.0
    w_constraint: float = 2.6
    w_dense: float = 0.6
    w_popularity: float = 1.2
    w_profile: float = 1.0
    profile_cold_start_only: bool = True
    constraint_term_boost: float = 2.2
    category_term_boost: float = 1.0
    decoy_term_penalty: float = 0.35
    override_decay: float = 0.5
    observed_term_boost: float = 0.55
    min_candidates: int = 40
    global_fallback_limit: int = 400
    mmr_lambda: float = 0.82
    min_infogain: float = 0.08

    def __post_init__(self) -> None:
        if self.clarify_strategy not in STRATEGIES:
            raise ValueError(f"clarify_strategy must be one of {', '.join(STRATEGIES)}")


#: Named changes to the default, for ablations and sweeps.
ABLATIONS: dict[str, dict] = {
    "default": {},
    "no_clarification": {"clarify_strategy": "none"},
    "no_category_lock": {"use_category_lock": False},
    "no_constraint_scoring": {"use_constraint_scoring": False},
    "no_state_tracking": {"use_state_tracking": False},
    "no_override_erasure": {"use_override_erasure": False},
    "no_observed_fallback": {"use_observed_fallback": False},
    "no_confidence_gate": {"use_confidence_gate": False},
    "no_padding": {"pad_to_top_k": False},
    "no_popularity_prior": {"use_popularity_prior": False},
    "no_profile_prior": {"use_profile_prior": False},
}


def from_environment(name: str = "PARLANCE_CONFIG") -> Config:
    """Settings from a JSON object in the environment. Unknown keys are dropped; bad JSON gives the default."""
    try:
        given = json.loads(os.environ.get(name, "") or "{}")
        known = {f.name for f in fields(Config)}
        return replace(Config(), **{k: v for k, v in given.items() if k in known})
    except (json.JSONDecodeError, AttributeError, TypeError):
        return Config()
