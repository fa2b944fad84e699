"""Model configuration and the dataset catalogue."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class ModelConfig:
    """The two models of the risk workflow.  Values become literal columns on
    each log row (K2); a YAML file is not needed -- pass a different instance."""

    image_model: str
    image_prompt: str
    text_model: str
    text_prompt: str
    image_temperature: float = 0.3
    image_max_tokens: int = 512
    text_temperature: float = 0.2
    text_max_tokens: int = 256


# Default model names and prompts (folded YAML text, one line each).
DEFAULT_MODEL_CONFIG = ModelConfig(
    image_model="llava:7b",
    image_prompt=(
        "Describe this satellite image in detail. Focus on land cover, "
        "vegetation, water bodies, urban areas, deforestation, and any "
        "visible signs of environmental change.\n"
    ),
    text_model="mistral:7b",
    text_prompt=(
        "You are an environmental analyst. Given the following satellite "
        "image description, determine whether the area is at environmental "
        "risk. Consider deforestation, soil erosion, water pollution, "
        "urban sprawl, loss of biodiversity, and any other factors. "
        "Answer with a JSON object containing exactly two keys:\n"
        '  "danger" – either "Y" or "N"\n'
        '  "justification" – a short explanation (1-3 sentences).\n'
        "Return ONLY the JSON object, no extra text.\n"
    ),
)


# The dataset catalogue -- display name, file name, source slug.
DATASETS = [
    ("Annual Change in Forest Area", "annual_change_forest_area.csv", "annual-change-forest-area"),
    ("Annual Deforestation", "annual_deforestation.csv", "annual-deforestation"),
    ("Share of Protected Land", "share_protected_land.csv", "terrestrial-protected-areas"),
    ("Share of Degraded Land", "share_degraded_land.csv", "share-degraded-land"),
    ("Share of Forest-Covered Land", "share_covered_forest_land.csv", "forest-area-as-share-of-land-area"),
]

# Indicator URL pattern (by slug) and the boundary archive.
INDICATOR_URL_FORMAT = "https://ourworldindata.org/grapher/%s.csv?v=1"
BOUNDARY_FILE = "ne_110m_admin_0_countries.zip"
BOUNDARY_URL = "https://naciscdn.org/naturalearth/110m/cultural/ne_110m_admin_0_countries.zip"


def dataset_id(file_name: str) -> str:
    """The dataset id used in the long table: the file name without ``.csv``."""
    return file_name[:-4] if file_name.endswith(".csv") else file_name


DATASET_IDS = [dataset_id(f) for _, f, _ in DATASETS]
