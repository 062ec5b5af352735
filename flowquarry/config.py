"""Settings of an analysis, given as values and never changed in place."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field, replace

BENIGN = "BENIGN"

# Flow columns a model is trained on, as the flow tables spell them.
FEATURE_COLUMNS = (
    "Src IP", "Dst IP", "Src Port", "Dst Port",
    "FIN Flag Count", "Flow IAT Max", "Flow IAT Std", "Fwd IAT Std", "Fwd IAT Max", "Flow IAT Mean",
    "Bwd Packet Length Min", "Bwd IAT Total", "Fwd IAT Mean", "Bwd IAT Max", "Bwd IAT Std",
    "Total Length of Fwd Packet", "Total Fwd Packet", "RST Flag Count",
    "Protocol", "Flow Duration", "Total Bwd packets", "Flow Bytes/s", "Flow Packets/s", "Flow IAT Min",
    "Fwd Header Length", "Bwd Header Length", "Average Packet Size", "Fwd Segment Size Avg", "Bwd Segment Size Avg",
)
IP_COLUMNS = ("Src IP", "Dst IP")
LABEL_COLUMN = "Label"
TIMESTAMP_COLUMN = "Timestamp"

# Row-count windows that stand for a time resolution, (size, step).
WINDOW_PRESETS = {"5s": (10, 5), "1m": (10, 10), "5m": (50, 10)}
TIME_RESOLUTIONS = {"5s": "5 seconds", "1m": "1 minute", "5m": "5 minutes"}

# Training defaults, common ones first, then per model type.
COMMON_HYPERPARAMETERS = {"batch_size": 64, "learning_rate": 0.001}
MODEL_HYPERPARAMETERS = {
    "dense": {"hidden": (128, 64)},
    "mlp_4_layer": {"hidden": (256, 128, 64, 32)},
    "logistic": {"reg_param": 0.0},
    "forest": {"num_trees": 20, "max_depth": 8},
}


@dataclass(frozen=True)
class StudyConfig:
    """Everything that decides the rows of a model-ready table."""

    seed: int = 79
    sample_size: int | None = 10000  # None: all rows
    benign_ratio: float = 0.5
    k_folds: int = 5
    test_share: float = 0.2
    window_size: int = 10
    window_step: int = 5
    use_windows: bool = True
    anonymize: bool = False
    feature_mode: str = "octets"
    features: tuple[str, ...] = field(default=FEATURE_COLUMNS)

    def fingerprint(self, *inputs: str) -> str:
        """Digest of all settings and input names; any change gives another cache folder."""
        text = json.dumps({"config": asdict(self), "inputs": sorted(inputs)}, sort_keys=True)
        return hashlib.sha256(text.encode()).hexdigest()

    def with_changes(self, **changes) -> StudyConfig:
        return replace(self, **changes)


def hyperparameters(model_type: str, overrides: dict | None = None) -> dict:
    """Common settings, overlaid by those of the model type, overlaid by the caller's."""
    if model_type not in MODEL_HYPERPARAMETERS:
        raise ValueError(f"unknown model type {model_type!r}; known: {sorted(MODEL_HYPERPARAMETERS)}")
    return {**COMMON_HYPERPARAMETERS, **MODEL_HYPERPARAMETERS[model_type], **(overrides or {})}
