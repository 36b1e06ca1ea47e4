"""They must match the published contract for results to agree."""

# Stock codes that are not merchandise, and the shape of ordinary product codes.
OPERATIONAL_CODES = (
    "POST", "DOT", "M", "m", "C2", "D", "S", "BANK CHARGES",
    "ADJUST", "ADJUST2", "AMAZONFEE", "CRUK",
)
TEST_CODES = ("TEST001", "TEST002")
UNCLEAR_CODES = ("C3", "GIFT")
GIFT_VOUCHER_PREFIX = "gift_0001_"
STANDARD_CODE_PATTERN = r"^\d{5}[A-Za-z]{0,2}$"
EXCLUDED_CODES = OPERATIONAL_CODES + TEST_CODES + UNCLEAR_CODES
WHITESPACE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0"
EXCLUDED_CATEGORIES = ("operational_fee", "test_dummy", "unclear")

# Snapshot policy.
HISTORY_DAYS = 180
HORIZON_DAYS = 90
FEATURE_WINDOWS = (30, 60, 90, 180)
HORIZONS = (30, 60, 90, 120, 180)
HISTORY_WINDOWS = (90, 180, 270, 360)
ONE_DAY_STAGE = "One purchase day"
REPEAT_STAGE = "Repeat purchase days"

HORIZON_NOTES = {
    30: "Fast intervention, but likely flags normal customers too early",
    60: "Responsive, still strict for slower purchasers",
    90: "Balanced candidate for quarterly inactivity",
    120: "More conservative, intervention happens later",
    180: "High confidence inactivity, but limited time to recover customers",
}

# Bins: (upper bound inclusive, label); the last bin is open.
CADENCE_BINS = (
    (30, "Within 30 days"), (60, "31–60 days"), (90, "61–90 days"),
    (180, "91–180 days"), (None, "More than 180 days"),
)
RECENCY_BINS = (
    (30, "0–30 days"), (60, "31–60 days"), (90, "61–90 days"),
    (120, "91–120 days"), (180, "121–180 days"),
)

# Columns that describe the future and may never become model inputs.
FUTURE_COLUMNS = ("next_purchase_date", "days_to_next_purchase", "label_end_date", "returned_within_horizon")

# Decision policy.
PROBABILITY_THRESHOLD = 0.40
SELECTED_C = 0.01
MODEL_VERSION = "churn-logistic-1.0.0"
CAPACITIES = (0.05, 0.10, 0.20, 0.30, 0.50)
C_GRID = (0.001, 0.01, 0.1, 1.0, 10.0)
PROBABILITY_GRID = (0.25, 0.30, 0.35, 0.40, 0.45, 0.50, 0.55, 0.60, 0.65, 0.70, 0.75)
TREE_CANDIDATES = {
    "RF — flexible": ("forest", {"numTrees": 150, "minInstancesPerNode": 5}),
    "RF — regularized": ("forest", {"numTrees": 150, "minInstancesPerNode": 15}),
    "HGB — regularized": ("boosting", {"maxIter": 120, "stepSize": 0.07, "maxLeaves": 31, "minInstancesPerNode": 50, "l2": 2.0}),
    "HGB — shallow": ("boosting", {"maxIter": 120, "stepSize": 0.07, "maxLeaves": 15, "minInstancesPerNode": 50, "l2": 5.0}),
}
RISK_QUANTILES = {"Medium": 0.50, "High": 0.80, "Very High": 0.90}
RISK_BANDS = ("Low", "Medium", "High", "Very High")
PRIORITY_SHARES = (
    (0.10, "Priority 1 - Immediate"), (0.20, "Priority 2 - Targeted"), (0.50, "Priority 3 - Nurture"),
    (None, "Standard monitoring"),
)
CAMPAIGN_ACTIONS = {
    "Priority 1 - Immediate": "Personalized outreach for the highest-ranked 10%; use segment and value",
    "Priority 2 - Targeted": "Targeted retention message for the next-ranked 10%",
    "Priority 3 - Nurture": "Automated email nurture or product reminder",
    "Standard monitoring": "Normal low-cost engagement; no paid retention incentive",
}
VALUE_ACTIONS = {
    "Priority 1 - Immediate": "Account-manager outreach; prioritize the highest exposed customer value",
    "Priority 2 - Targeted": "Personalized retention offer for a high-value account",
    "Priority 3 - Nurture": "Low-cost relationship nurture for value protection",
    "Standard monitoring": "Monitor customer value and churn risk; no paid intervention",
}

# Segmentation policy.
SEGMENT_COUNT = 4
OUTLIER_EPS = (0.40, 0.45, 0.50)
MIN_SAMPLES = 10
STABILITY_SEEDS = (0, 1, 2, 3, 4, 42, 99, 123)
SEGMENT_CHAMPIONS = "Champions"
SEGMENT_RECENT = "Recent developing"
SEGMENT_AT_RISK = "At-risk established"
SEGMENT_LAPSED = "Lapsed low-value"
SEGMENT_OUTLIER = "Exceptional high-value"
