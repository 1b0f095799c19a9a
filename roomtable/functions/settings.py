"""Thresholds of the measurement operators.

Fixed values: the defaults are the published settings; every operator takes a
Settings, so a replay or a small test frame passes its own.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass


@dataclass(frozen=True)
class Settings:
    experimental_floor: bool = False
    experimental_floor_candidate: str = "oneformer"
    experimental_floor_min_confidence: float = 0.55
    min_long_side: int = 640
    max_aspect_ratio: float = 3.0
    blur_working_side: int = 1024
    blur_method: str = "reblur_ratio"
    blur_sharp_min: float = 120.0
    blur_reblur_sharp_max: float = 0.3583
    blur_reblur_blurry_min: float = 0.4778
    blur_edge_width_sharp_max: float = 9.0
    blur_edge_width_blurry_min: float = 12.0
    blur_min_strong_gradient_ratio: float = 0.005
    dark_luma_max: float = 0.06
    bright_luma_min: float = 0.98
    dark_ratio_max: float = 0.35
    bright_ratio_max: float = 0.12
    luma_mean_min: float = 0.12
    luma_mean_max: float = 0.85
    contrast_min: float = 0.05
    contrast_ratio_min: float = 0.10
    clipped_high_ratio_max: float = 0.02
    clipped_low_ratio_max: float = 0.05
    lens_sagitta_suspect_px: float = 3.0
    lens_reference_width: int = 1600
    lens_max_fit_rms_px: float = 2.0
    lens_min_track_points: int = 40
    lens_min_track_height_ratio: float = 0.25
    lens_min_usable_edges: int = 2
    lens_method: str = "k1_fit"
    lens_min_sign_agreement: float = 0.8
    lens_k1_search_min: float = -0.45
    lens_k1_search_max: float = 0.45
    lens_k1_search_steps: int = 181
    lens_k1_suspect_min: float = 0.03
    lens_k1_min_residual_gain: float = 0.25

    def snapshot(self) -> dict[str, float | int | str]:
        """The settings that decide a result, with their types; not those of the experimental floor."""
        return {name: value for name, value in asdict(self).items() if not name.startswith("experimental_")}


DEFAULTS = Settings()
