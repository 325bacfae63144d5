"""Options of a run, from arguments, the environment (``VOXWEAVE_`` and the name in capitals) or a .env file."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields

#: Fixed values.
MODEL_SIZES = ("tiny", "base", "small", "medium", "large-v2", "large-v3")
COMPUTE_TYPES = ("int8", "int8_float16", "float16", "float32")


@dataclass(frozen=True)
class Options:
    model_size: str = "large-v3"
    compute_type: str = "int8"
    language: str = "es"
    device: str = "cpu"
    beam_size: int = 5
    vad_filter: bool = True
    vad_min_speech_duration_ms: int = 250
    output_dir: str = "output"

    def __post_init__(self) -> None:
        object.__setattr__(self, "language", self.language.lower())
        checks = {
            "model_size": self.model_size in MODEL_SIZES,
            "compute_type": self.compute_type in COMPUTE_TYPES,
            "language": len(self.language) >= 2,
            "device": self.device in ("cpu", "cuda"),
            "beam_size": 1 <= self.beam_size <= 10,
            "vad_min_speech_duration_ms": self.vad_min_speech_duration_ms >= 0,
        }
        for name, right in checks.items():
            if not right:
                raise ValueError(f"{name} can't be {getattr(self, name)!r}")

    @classmethod
    def read(cls, dotenv: str = ".env", **given) -> Options:
        found = {}
        if os.path.isfile(dotenv):
            with open(dotenv, encoding="utf-8") as f:
                found = dict(line.strip().split("=", 1) for line in f if "=" in line and not line.lstrip().startswith("#"))
        found |= os.environ
        values = {}
        for field in fields(cls):
            text = found.get(f"VOXWEAVE_{field.name.upper()}")
            if text is not None:
                kind = type(field.default)
                values[field.name] = text.strip().lower() in ("1", "true", "yes", "on") if kind is bool else kind(text.strip())
        return cls(**values | given)
