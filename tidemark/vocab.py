"""Fixed vocabularies and numeric constants that results depend on."""

# Frequency codes by priority when unifying series (exploration).
EXPLORE_PRIORITY = {"Daily": 1.0, "Weekly": 2.0, "Ten_Day": 2.5,
                    "Monthly": 3.0, "Quarterly": 4.0, "Annual": 5.0}

# Median gap in whole days accepted for each label, inclusive.
GAP_BANDS = {"Daily": (0.8, 1.2), "Weekly": (5, 7.9), "Ten_Day": (8, 24),
             "Monthly": (25, 35), "Quarterly": (85, 100), "Annual": (350, 380)}

# Preparation levels; dekads rank above weeks here.
PREP_LEVEL = {"D": 1.0, "K": 1.5, "W": 2.0, "M": 3.0, "Q": 4.0, "Y": 5.0}

# Nominal days per observation for missing-ratio statistics.
NOMINAL_DAYS = {"D": 1, "W": 7, "K": 10, "M": 30, "Q": 90, "Y": 365}

# Rows in one year for year-on-year differences.
YEAR_ROWS = {"D": 365, "W-FRI": 52, "W-MON": 52, "MS": 12, "QS": 4, "AS": 1}

# Text that names a frequency, first match wins.
FREQ_WORDS = [("日", "D"), ("周", "W"), ("旬", "K"), ("月", "M"), ("季", "Q"), ("年", "Y")]
FREQ_WORDS_EN = [("daily", "D"), ("weekly", "W"), ("dekad", "K"),
                 ("monthly", "M"), ("quarterly", "Q"), ("yearly", "Y")]

# Minimum share of parseable cells when a sheet is scanned.
MIN_DATE_RATIO = 0.5
MIN_TARGET_RATIO = 0.5
MIN_PREDICTOR_RATIO = 0.3

# Default label of an indicator without industry or type.
UNCLASSIFIED = "未分类"

# Recommended operation chain by the nature of a variable.
NATURE_OPS = {"流量": ["log", "diff_yoy"], "存量": ["log", "diff_yoy"],
              "率": ["none", "none"], "同比": ["none", "none"]}

# Growth is a difference for this unit unless of this type.
PERCENT_UNIT = "%"
OPERATING_RATE = "开工率"

KL_SMOOTHING = 1e-9
NEAR_ZERO = 1e-9
DIVISION_FLOOR = 1e-15
CONTRIBUTION_TOLERANCE = 0.5
MIN_CORRELATION_SAMPLES = 2
