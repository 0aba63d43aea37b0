"""Default thresholds.

Fixed values: the numbers below are part of the definition of the results.  Every operator takes a
``Settings`` object, so a job overrides them with ``replace(DEFAULTS, hampel_k=3.0)``.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

BBL_PER_M3 = 6.289810770432105
FT_PER_M = 3.280839895013123
PSI_PER_KPA = 0.14503773773020923
SCF_PER_M3 = 35.31466672148859
DAYS_PER_MONTH = 30.436875


@dataclass(frozen=True)
class Settings:
    # fluid constants (formation volume factors, gas in solution, gas factor)
    bo: float = 1.25
    bw: float = 1.02
    rs: float = 0.0
    bg: float = 0.0
    # gates
    od_min: float = 6.0
    od_regression_floor: float = 3.0
    points_per_param_min: float = 4.0
    points_per_param_floor: float = 2.0
    inj_cv_min: float = 0.15
    tau_over_dt_min: float = 3.0
    sum_f_aquifer: float = 1.15
    injector_sum_f_max: float = 1.15
    flank_sum_f_min: float = 1.15
    flank_over_median_min: float = 1.3
    events_per_well_crossflow: float = 4.0
    history_long_min: int = 120
    water_cut_mature: float = 0.5
    min_steps: int = 36
    min_steps_hard: int = 8
    # split
    blind_fraction: float = 0.2
    min_blind_steps: int = 6
    # cleaning
    hampel_window: int = 7
    hampel_k: float = 5.0
    hampel_min_rel_dev: float = 0.25
    long_shutin_steps: int = 6
    # events
    break_types: tuple = ("WORKOVER", "CONVERSION", "INFILL", "RECOMPLETION")
    lift_types: tuple = ("CHOKE", "ESP_FREQ", "ESP", "LIFT", "PUMP", "FREQUENCY")
    min_window_steps: int = 24
    # sectors
    sector_cutoff_factor: float = 2.5
    # pressure
    esp_hampel_window: int = 5
    whp_variation_min: float = 0.15
    gradient_water_psi_ft: float = 0.433
    gradient_oil_psi_ft: float = 0.35
    datum_gradient_psi_ft: float = 0.433
    # fit
    tau_max_days: float = 3650.0
    tau_grid_points: int = 16
    shut_in_max_multiplier: float = 3.0
    sum_f_bound: float = 1.0
    keep_within: float = 0.05
    spread_warn: float = 0.30
    # verification and ranking
    autocorr_warn: float = 0.5
    blind_mape_poor: float = 15.0
    weights: tuple = (
        ("blind_r2", 0.35), ("mape", 0.15), ("aicc", 0.20),
        ("stability", 0.15), ("plausibility", 0.10), ("runtime", 0.05),
    )
    ensemble_top_n: int = 3
    ensemble_gap: float = 0.03
    high_r2: float = 0.85
    high_spread: float = 0.15
    medium_r2: float = 0.70
    medium_max_warnings: int = 1
    # aquifer starts
    we0_fractions: tuple = (0.1, 0.3)
    k_per_day: tuple = (5.0e-5, 5.0e-4, 5.0e-3)
    # rolling and shifts
    rolling_length: int = 36
    rolling_step: int = 6
    rolling_min: int = 24
    shift_multiple: float = 2.0
    shift_persist: int = 2
    min_spread_rel: float = 0.05
    # plans
    horizon_months: int = 24
    injector_max_multiple: float = 2.0
    idle_lookback: int = 3
    anchor_cut_months: int = 3
    oil_cut_fit_months: int = 24
    balanced_k: float = 0.5
    # economics
    oil_price: float = 70.0
    water_cost: float = 1.5
    injection_cost: float = 0.8
    discount_rate: float = 0.10
    # ramping
    step_frac_high: float = 0.15
    step_frac_other: float = 0.08
    min_change_frac: float = 0.05
    meter_resolution_bbl_d: float = 10.0
    revert_water_cut_jump: float = 0.05
    # follow-up
    evaluation_months: tuple = (3, 6)
    quarterly_days: int = 90


DEFAULTS = Settings()

__all__ = ["DEFAULTS", "Settings", "replace", "BBL_PER_M3", "FT_PER_M", "PSI_PER_KPA", "SCF_PER_M3", "DAYS_PER_MONTH"]
