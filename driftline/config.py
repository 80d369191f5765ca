"""Thresholds of the momentum model."""

#: Fixed values.
COHORT_MIN = 8
SIMMERING, ACCELERATING, BREAKOUT = 0.60, 0.80, 0.95
FADE = 0.40
PROMOTE_DAYS, DEMOTE_DAYS, FADE_DAYS = 2, 7, 14
ACTIVE_DAYS, FADE_INACTIVE_DAYS = 14, 30
BREADTH_MIN = 2
#: The highest tier (1: simmering) that a provisional cohort's members are told to be in.
PROVISIONAL_CAP = 1
LAG_DAYS, BREADTH_WINDOW, PROMOTION_WINDOW = 7, 30, 30
GATE_BASE = {"breakout": 1.0, "accelerating": 0.7}
GATE_FLOORS = (0.5, 0.4, 0.4)
REBRIEF_DAYS, NOVELTY_DAYS, BRIEFS_PER_WEEK = 60, 180, 5
WAVE_WINDOW, WAVE_AGE, WAVE_MEMBERS, EDGE_CONFIDENCE, CONTINUITY = 30, 180, 4, 0.5, 0.5
FLAT_BAND, HORIZON_DAYS = 0.05, 90
TRIAGE = {"stars": 500, "hf_downloads": 50_000, "pypi_downloads": 50_000}
HYPE_ATTENTION, HYPE_GAP, HYPE_BREADTH = 0.95, 0.5, 2
SURVIVAL_DAYS, REACCEL_DAYS, NEW_ENTITY_DAYS = 90, 60, 7
