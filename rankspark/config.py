"""Settings, read from the environment once and passed on explicitly."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields

# What counts as true and false in an environment variable.
TRUE = {"y", "yes", "t", "true", "on", "1"}
FALSE = {"n", "no", "f", "false", "off", "0"}


def strtobool(text: str) -> bool:
    word = text.strip().lower()
    if word in TRUE | FALSE:
        return word in TRUE
    raise ValueError(f"not a truth value: {text!r}")


@dataclass(frozen=True)
class Config:
    database_url: str = ""
    logging_config: str = "logging.conf"
    excellent_weight: float = 3.0
    half_life_evergreen: float = 120.0
    half_life_urgent: float = 10.0
    validation_size: int = 0
    relevance_model_name: str = "cobble-64"
    relevance_max_length: int = 2048
    relevance_text_prep_mode: str = "title_head"
    relevance_prep_version: int = 2
    relevance_encoder_batch_size: int = 4
    relevance_linear_c: float = 5.0
    urgency_linear_c: float = 1.0
    lookback_days: int = 40
    max_lookback_days: int = 365
    sampling: int = 1500
    allow_training_wo_gpu: bool = False
    allow_inference_wo_gpu: bool = False

    def __post_init__(self) -> None:
        if not 0 < self.half_life_urgent <= self.half_life_evergreen:
            raise ValueError("half-lives must satisfy 0 < urgent <= evergreen")
        if self.relevance_text_prep_mode not in ("title_head", "single_blob"):
            raise ValueError(f"unknown text preparation: {self.relevance_text_prep_mode!r}")

    @classmethod
    def from_env(cls, env: Mapping[str, str] = os.environ) -> Config:
        """Each field from the variable of its name in capitals, if set."""
        made = {}
        for f in fields(cls):
            text = env.get(f.name.upper())
            if text is not None:
                kind = type(f.default)
                made[f.name] = strtobool(text) if kind is bool else kind(text)
        return cls(**made)

    @property
    def cache_key(self) -> dict[str, str | int]:
        """The settings that define an embedding."""
        return {"model_name": self.relevance_model_name, "max_length": self.relevance_max_length, "text_prep_mode": self.relevance_text_prep_mode, "prep_version": self.relevance_prep_version}

    # The names under which the models of a configuration are stored.
    def _family(self, c: float) -> str:
        return f"{self.relevance_model_name.replace('/', '-')}_{self.relevance_max_length}_{self.relevance_text_prep_mode}_embedding_linear_c{c}"

    @property
    def relevance_family(self) -> str:
        return self._family(self.relevance_linear_c)

    @property
    def urgency_family(self) -> str:
        return "urgency_" + self._family(self.urgency_linear_c)

    @property
    def urgency_model_key(self) -> str:
        # Fixed value: the format of the key under which scores of a configuration are stored.
        c = self
        return "::".join(["urgency-embedding_linear", c.relevance_model_name, str(c.relevance_max_length), c.relevance_text_prep_mode, str(c.relevance_prep_version), f"c={c.urgency_linear_c}"])
