"""Closed vocabularies of the corpus.

Fixed values: they are the wire format of manifests, annotations and reports,
so they have to be spelled exactly like this.
"""

DIFFICULTIES = ("easy", "medium", "hard", "rejected")
SPLITS = ("pilot_development", "golden_holdout")
GOLDEN_CASES = (
    "wall_floor_hard",
    "rug",
    "thin_occluders",
    "massive_furniture",
    "strong_perspective",
    "opening",
    "wood_on_wood",
)
USAGES = ("local_evaluation_only", "redistributable")
STATUSES = ("draft", "reviewed", "approved")
BOUNDARY_KINDS = (
    "wall_floor",
    "baseboard",
    "door_threshold",
    "frame_cut",
    "object_contact",
    "other",
)
EXCLUSION_ROLES = ("occluder", "floor_covering", "structural", "opening", "other", "unknown")
UNCERTAIN_REASONS = (
    "hidden_corner",
    "strong_shadow",
    "furniture_against_wall",
    "low_contrast",
    "cut_by_frame",
    "reflection",
    "motion_blur",
    "other",
)
SCENE_TRAITS = (
    "empty_room", "furnished", "rug", "thin_furniture_legs", "thin_occluders",
    "massive_furniture", "radiator", "doors", "second_room_visible", "threshold",
    "existing_parquet", "tiles", "uniform_floor", "dark_floor", "reflective_floor",
    "curved_architecture", "exterior_visible", "low_wall_floor_contrast",
    "wood_confusion", "backlight", "strong_shadow", "hidden_corners", "cropped",
    "wide_angle", "easy_perspective", "hard_perspective", "blurry", "corridor",
    "small_room", "large_room", "not_a_room",
)
SCORED_CODES = (
    "image_too_small",
    "image_blurry",
    "image_too_dark",
    "image_overexposed",
    "image_low_contrast",
    "image_extreme_aspect_ratio",
    "image_clipped",
    "image_low_texture",
    "lens_distortion_suspected",
)
INFORMATIONAL_CODES = ("stage_not_implemented", "lens_analysis_undetermined")
BLOCKING_CODES = ("image_too_small",)
UNSET_LICENSES = ("", "?", "tbd", "à vérifier")
CANDIDATE_MEASURES = (
    # measure, higher value means blurrier
    ("laplacian_variance", False),
    ("reblur_ratio", True),
    ("edge_width_px", True),
)
STAGES = ("load_image_ms", "quality_analysis_ms", "lens_analysis_ms", "total_ms")
PATTERNS = ("lames", "point-de-hongrie", "baton-rompu")
TONES = ("clair", "naturel", "chaud", "fonce")
FLOOR_CLASS = 3
COVERING_CLASSES = (28,)
RUG_CLASS = 28
