"""Fixed values defined by the league rules and the dashboard's formulas.

FIXED VALUES — these must equal the reference's numbers and labels for results
to match; they are stated here in their natural order and nowhere else.
"""

# Position names, in display order (also the custom sort order of the elite squad).
POSITION_ORDER = ["Goalkeeper", "Defender", "Midfielder", "Forward"]

# Elite squad quotas per position.
SQUAD_QUOTAS = {"Goalkeeper": 2, "Defender": 5, "Midfielder": 5, "Forward": 3}

# Feature position multiplier (features table); any other position -> 1.0.
FEATURE_POSITION_MULTIPLIER = {"Forward": 1.3, "Midfielder": 1.1, "Defender": 1.0, "Goalkeeper": 0.8}

# Prediction position adjustment; any other position -> 1.0.
PREDICT_POSITION_ADJUSTMENT = {"Forward": 1.05, "Midfielder": 1.00, "Defender": 0.90, "Goalkeeper": 0.85}

# Prediction fixture-difficulty multiplier; any other difficulty -> 1.0.
DIFFICULTY_MULTIPLIER = {1: 1.25, 2: 1.10, 3: 1.00, 4: 0.85, 5: 0.70}

# Difficulty labels 1..5 (sweep chart and prediction card).
DIFFICULTY_LABELS = ["Very Easy", "Easy", "Average", "Hard", "Very Hard"]

# Prediction: base = form * 0.6 + points_per_game * 0.4, clipped to [1, 12],
# band = +/- 0.3 around the clipped value.
PREDICT_FORM_WEIGHT = 0.6
PREDICT_PPG_WEIGHT = 0.4
PREDICT_MIN = 1.0
PREDICT_MAX = 12.0
PREDICT_NOISE = 0.3
DEFAULT_MANUAL_DIFFICULTY = 3

# Dashboard thresholds.
ACTIVE_MIN_MINUTES_V2 = 100
ACTIVE_MIN_MINUTES_V1 = 500
TOP_VALUE_N_V2 = 20
TOP_VALUE_N_V1 = 10
TOP_TEAMS_N = 10
FEATURE_LEADERS_N = 20

# Feature formulas.
FORM_WEIGHT_FACTOR = 1.5
FORM_WEIGHT_CAP = 10.0
HIGH_PERFORMER_QUANTILE = 0.75

# Local explanation: feature -> weight, in the reference's order.
CONTRIBUTION_WEIGHTS = [
    ("momentum", 2.0),
    ("efficiency", 1.5),
    ("form_weight", 0.8),
    ("points_per_90", 1.2),
    ("goals_per_90", 3.0),
    ("influence_score", 5.0),
    ("creativity_score", 4.0),
]

# Decision path steps: (step name, explanation), in order.
DECISION_STEPS = [
    ("Base Prediction", "Average points across all players"),
    ("Add Momentum Effect", "Player's recent momentum adds to prediction"),
    ("Add Efficiency Factor", "Cost-efficiency factor increases confidence"),
    ("Add Form Weight", "Current form weight applied"),
    ("Position Adjustment", "Position-specific multiplier applied"),
    ("Final Prediction", "Actual total points for reference"),
]
DECISION_WEIGHTS = {"momentum": 2.0, "efficiency": 1.5, "form_weight": 0.8}

# Classification score: weighted sum / 10, clipped to [0.1, 0.9]; label High when > 0.5.
CLASSIFY_WEIGHTS = [("momentum", 0.3), ("efficiency", 0.3), ("form_weight", 0.2), ("points_per_90", 0.2)]
CLASSIFY_DIVISOR = 10.0
CLASSIFY_MIN = 0.1
CLASSIFY_MAX = 0.9
CLASSIFY_THRESHOLD = 0.5
# Confidence tiers on |score - 0.5|: model -> (High above, Medium above or None).
CONFIDENCE_TIERS = [("SVM", 0.3, 0.15), ("Random Forest", 0.25, 0.1), ("XGBoost", 0.35, None)]

# Correlation features, in the reference's order.
CORRELATION_FEATURES = [
    "goals_per_90", "assists_per_90", "points_per_90", "momentum", "efficiency",
    "consistency_score", "influence_score", "creativity_score", "threat_score",
]
HISTOGRAM_BINS = 30
BOX_WHISKER_IQR = 1.5

# Rolling form windows.
ROLLING_SHORT = 3
ROLLING_LONG = 5
# The last week a spine may reach; a row beyond it is an error in the data (two centuries of weekly rounds).
MAX_WEEK = 10_000

# Radar (v2): (metric label, column); each is divided by the table max and * 100,
# except Form, which is form / 10 * 100.
RADAR_V2 = [("Goals", "goals_scored"), ("Assists", "assists"), ("Clean Sheets", "clean_sheets"),
            ("Total Points", "total_points"), ("Minutes", "minutes")]
# Radar (v1): raw stats, only minutes scaled by the table max * 100.
RADAR_V1 = [("Goals", "goals_scored"), ("Assists", "assists"), ("Clean Sheets", "clean_sheets"),
            ("Minutes", "minutes"), ("Total Points", "total_points")]
RADAR_V1_AXIS_FACTOR = 1.1

# Comparison stats: (label, column, divisor).
COMPARE_V2 = [("Goals", "goals_scored", 1.0), ("Assists", "assists", 1.0),
              ("Clean Sheets", "clean_sheets", 1.0), ("Total Points", "total_points", 1.0),
              ("Minutes/100", "minutes", 100.0), ("Form", "form_numeric", 1.0)]
COMPARE_V1 = [("Goals", "goals_scored", 1.0), ("Assists", "assists", 1.0),
              ("Clean Sheets", "clean_sheets", 1.0), ("Total Points", "total_points", 1.0),
              ("Minutes", "minutes", 1.0)]

UNKNOWN = "Unknown"
CURRENCY = "£"
