"""Settings of a run, with environment overrides."""

from __future__ import annotations

import os
from dataclasses import dataclass, field, fields

from ..operators.blocking import DEFAULT_K


@dataclass
class Config:
    """All knobs of the plan (``method`` "tune" picks the decision on ``tune_sample`` entities); ``from_env`` reads ``KINWEAVE_<FIELD>`` for the plain ones."""

    k_passes: dict[str, int] = field(default_factory=lambda: dict(DEFAULT_K))
    max_df_word: int = 3000
    max_df_char: int = 20_000
    key_cap: int = 30
    sibling_top: int = 5
    sibling_min: float = 0.5
    sibling_k: int = 0
    folds: int = 5
    seed: int = 42
    train_sample: int = 600_000
    tune_sample: int = 200_000
    method: str = "threshold"
    threshold: float = 0.8
    alpha: float = 1.0
    transliterate: bool = True
    work_dir: str = ""

    def passes(self, own: dict[str, int] | None = None) -> dict[str, int]:
        """Configured Ks over the defaults: what a file leaves out keeps its default."""
        return DEFAULT_K | self.k_passes | (own or {})

    @classmethod
    def from_env(cls, **given) -> Config:
        out = cls(**given)
        for f in fields(cls):
            text = os.environ.get(f"KINWEAVE_{f.name.upper()}")
            if text is not None and f.name not in given and f.name != "k_passes":
                kind = type(getattr(out, f.name))
                setattr(out, f.name, text.lower() in ("1", "true", "yes") if kind is bool else kind(text))
        return out
