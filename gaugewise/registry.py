"""Features, reason codes, parameters and errors: what all operators agree on."""

from __future__ import annotations

from dataclasses import dataclass, field

#: Score of a failed yes-or-no feature.
Z_ON_BAD = 4.0
#: Added before the logarithm of a log feature.
LOG_EPS = 1e-3
#: From a median absolute deviation to a standard deviation.
MAD_SCALE = 1.4826

REASONS = ("EVIDENCE_WEAK", "POSITION_MISMATCH", "SEQUENCE_JUMP", "GEOMETRY_ODD", "FOCUS_BLUR")


@dataclass(frozen=True)
class Feature:
    """kind: z (robust z), bool (False is bad), match (differing from the cohort's mode is bad), physical or rollup (not scored)."""

    name: str
    level: str
    kind: str
    worse_when: str = "-"
    reason: str = ""
    enabled: bool = True
    runtime: bool = False


#: Name, level, kind, direction, reason; enabled: in the default arg-max; runtime: made by the caller.
FEATURES: tuple[Feature, ...] = (
    Feature("delta_s", "l3", "z", "both", "POSITION_MISMATCH"),
    Feature("delta_e", "l3", "z", "both", "POSITION_MISMATCH"),
    Feature("cnr_s", "l3", "z", "low", "EVIDENCE_WEAK"),
    Feature("cnr_e", "l3", "z", "low", "EVIDENCE_WEAK"),
    Feature("rise_s", "l3", "z", "high", "FOCUS_BLUR"),
    Feature("rise_e", "l3", "z", "high", "FOCUS_BLUR"),
    Feature("margin_s", "l3", "z", "low", "EVIDENCE_WEAK"),
    Feature("margin_e", "l3", "z", "low", "EVIDENCE_WEAK"),
    Feature("npk_s", "l3", "z", "high", "EVIDENCE_WEAK"),
    Feature("npk_e", "l3", "z", "high", "EVIDENCE_WEAK"),
    Feature("overshoot_s", "l3", "z", "high", "FOCUS_BLUR"),
    Feature("overshoot_e", "l3", "z", "high", "FOCUS_BLUR"),
    Feature("plateau_cv", "l3", "z", "high", "EVIDENCE_WEAK"),
    Feature("pol_s", "l3", "match", "-", "EVIDENCE_WEAK"),
    Feature("pol_e", "l3", "match", "-", "EVIDENCE_WEAK"),
    Feature("edge_valid_s", "l3", "bool", "-", "EVIDENCE_WEAK"),
    Feature("edge_valid_e", "l3", "bool", "-", "EVIDENCE_WEAK"),
    Feature("cd_nm", "l3", "z", "both", "GEOMETRY_ODD"),
    Feature("cd_resid", "l3", "z", "both", "SEQUENCE_JUMP"),
    Feature("s_resid", "l3", "z", "both", "SEQUENCE_JUMP"),
    Feature("e_resid", "l3", "z", "both", "SEQUENCE_JUMP"),
    Feature("dstep_s", "l3", "z", "high", "SEQUENCE_JUMP"),
    Feature("dstep_e", "l3", "z", "high", "SEQUENCE_JUMP"),
    Feature("obliquity", "l3", "z", "high", "GEOMETRY_ODD"),
    Feature("curv_s", "l3", "z", "high", "SEQUENCE_JUMP", enabled=False),
    Feature("curv_e", "l3", "z", "high", "SEQUENCE_JUMP", enabled=False),
    Feature("angle", "l3", "z", "both", "GEOMETRY_ODD"),
    Feature("value_mismatch_nm", "l3", "z", "both", "GEOMETRY_ODD"),
    Feature("mdist_s", "l3", "z", "high", "POSITION_MISMATCH"),
    Feature("mdist_e", "l3", "z", "high", "POSITION_MISMATCH"),
    Feature("mgrad_s", "l3", "z", "low", "POSITION_MISMATCH"),
    Feature("mgrad_e", "l3", "z", "low", "POSITION_MISMATCH"),
    Feature("minside", "l3", "bool", "-", "GEOMETRY_ODD"),
    Feature("n_cd", "l2", "z", "both"),
    Feature("frac_flagged", "l2", "z", "high", runtime=True),
    Feature("max_run", "l2", "rollup", runtime=True),
    Feature("cd_median", "l2", "z", "both"),
    Feature("cd_mad", "l2", "z", "high"),
    Feature("delta_median_s", "l2", "z", "both"),
    Feature("delta_median_e", "l2", "z", "both"),
    Feature("traj_rms_s", "l2", "z", "high"),
    Feature("traj_rms_e", "l2", "z", "high"),
    Feature("angle_median", "l2", "z", "both"),
    Feature("angle_spread", "l2", "z", "high"),
    Feature("pitch_median", "l2", "z", "both"),
    Feature("span_nm", "l2", "z", "both"),
    Feature("impact_nm", "l2", "physical", "high", runtime=True),
    Feature("noise_sigma", "l1", "z", "high"),
    Feature("sat_lo", "l1", "z", "high"),
    Feature("sat_hi", "l1", "z", "high"),
    Feature("dyn_range", "l1", "z", "low"),
    Feature("hist_emd", "l1", "z", "high", runtime=True),
    Feature("struct_energy", "l1", "z", "low"),
    Feature("tile_energy_cv", "l1", "z", "high"),
    Feature("n_bad_categories", "l1", "rollup", runtime=True),
    Feature("mask_grad_agree", "lm", "z", "low"),
    Feature("mask_n_components", "lm", "z", "both"),
    Feature("mask_hole_frac", "lm", "z", "high"),
    Feature("mask_boundary_rough", "lm", "z", "high"),
    Feature("mask_area_frac", "lm", "z", "both"),
)
BY_NAME: dict[str, Feature] = {f.name: f for f in FEATURES}


def features_of(level: str | None = None, kind: str | None = None) -> list[Feature]:
    return [f for f in FEATURES if level in (None, f.level) and kind in (None, f.kind)]


#: Least median absolute deviation that a score divides by, for features where it is not the default.
MAD_FLOORS = {
    "npk_s": 0.5, "npk_e": 0.5, "n_cd": 0.5, "sat_lo": 0.002, "sat_hi": 0.002, "hist_emd": 0.5, "frac_flagged": 0.05,
    "overshoot_s": 0.02, "overshoot_e": 0.02, "max_run": 0.5, "noise_sigma": 0.05, "dyn_range": 1.0,
    "delta_median_s": 0.05, "delta_median_e": 0.05, "value_mismatch_nm": 0.02, "mdist_s": 0.05, "mdist_e": 0.05,
    "mask_n_components": 0.5, "mask_hole_frac": 0.002, "mask_area_frac": 0.002, "angle_spread": 0.05,
}


@dataclass(frozen=True)
class Params:
    ribbon_half_w: int = 2
    win_frac: float = 0.4
    win_min_px: float = 8.0
    win_max_px: float = 64.0
    margin_px: float = 6.0
    grad_sigma_px: float = 1.0
    noise_patch_px: int = 15
    peak_suppress: int = 6
    npk_ratio: float = 0.3
    local_window: int = 9
    method: str = "robust_linear"
    min_seq_len: int = 5
    trim_frac: float = 0.05
    mad_floor_default: float = 1e-6
    mad_floors: dict[str, float] = field(default_factory=lambda: dict(MAD_FLOORS))
    log_features: tuple[str, ...] = ("rise_s", "rise_e", "margin_s", "margin_e", "dstep_s", "dstep_e", "cd_mad")
    direction_overrides: dict[str, str] = field(default_factory=dict)

    def floor(self, name: str) -> float:
        return self.mad_floors.get(name, self.mad_floor_default)

    def worse_when(self, name: str) -> str:
        return self.direction_overrides.get(name, BY_NAME[name].worse_when)


ERROR_CODES = {
    "E-ARG-01": "shapes or lengths differ",
    "E-ARG-02": "not a two-dimensional 8-bit image",
    "E-ARG-03": "unknown unit",
    "E-ARG-04": "no rows to compute from",
    "E-ARG-05": "unknown feature name",
    "E-ARG-06": "argument out of range",
    "E-ARG-07": "mask and image differ in shape",
}


class MetrologyError(ValueError):
    """An argument error with one of ERROR_CODES."""

    def __init__(self, code: str, detail: str = ""):
        self.code, self.detail = code, detail
        super().__init__(f"{code}: {ERROR_CODES[code]}" + f" ({detail})" * bool(detail))
