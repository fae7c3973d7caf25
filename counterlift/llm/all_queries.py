"""Imports every operator so that its query registers."""

from counterlift.llm import (  # noqa: F401
    alignment,
    cap_filters,
    centroids,
    decontamination,
    jaccard_join,
    language_id,
    packing,
    pii,
    token_files,
    toxicity,
    url_lists,
    warc,
    window_packing,
)
from counterlift.llm.registry import ORACLES, QUERIES  # noqa: F401
