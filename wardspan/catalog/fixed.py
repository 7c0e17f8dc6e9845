"""Fixed parameters and code lists shared by the queries and their SQL."""

from __future__ import annotations

from wardspan.specs import DEVICE_FLOW_LEVELS, DEVICE_O2_LEVELS, DEVICE_TEXT_LEVELS, ETHNICITY_CODES, level_map

LR_W = [2.0, 0.5, -0.25, 0.1, -0.1, 0.3, 3.0, 0.2, -3.2]
LR_W_TUNED = [2.4, 0.4, -0.3, 0.2, -0.2, 0.5, 3.3, 0.1, -3.4]
HIDDEN = 2
NN_W = [
    1.5, 0.2, -0.1, 0.1, 0.0, 0.4, 2.0, 0.1, -1.0,
    -1.0, 0.1, 0.2, -0.3, 0.1, 0.2, -2.0, 0.3, 1.2,
    2.0, -1.5, -0.8,
]
NN_W_TUNED = [1.1 * v for v in NN_W]
ROUNDS = [1, 2, 3]

ETHNIC_TEXTS = [*ETHNICITY_CODES, "Prefer not to say"]
DEVICE_TEXTS = [*level_map(DEVICE_TEXT_LEVELS), "96", "unknown", "2"]
DEVICE_O2_TEXTS = [*level_map(DEVICE_O2_LEVELS), "ROOM"]
DEVICE_FLOW_TEXTS = [*level_map(DEVICE_FLOW_LEVELS), "20", "n/a"]
ASSAY_TEXTS = ["NOT Detected", "**DETECTED**", "***DETECTED***", "Requested"]


def round_weights(model: str, round_no: int, tuned: bool = False) -> list[float]:
    """Parameters that move to their final values over the rounds."""
    final = {"LR": LR_W_TUNED if tuned else LR_W, "NN": NN_W_TUNED if tuned else NN_W}[model]
    share = round_no / len(ROUNDS)
    return [v * share for v in final]
