"""Column lists and settings of the loan-risk workflow.

Fixed values: these names must equal the workflow's own lists for results to
line up (cleaning configuration, rename map, counterfactual settings).
"""

from __future__ import annotations

# Cleaning configuration of the reference workflow.
NUMERIC_COLS = ["term", "credit_score", "ltv", "dtir1", "loan_amount", "income", "property_value"]
CATEGORICAL_COLS = ["loan_limit", "gender", "approv_in_adv", "loan_type", "loan_purpose",
                    "credit_worthiness", "open_credit", "business_or_commercial", "neg_ammortization",
                    "interest_only", "lump_sum_payment", "construction_type", "occupancy_type",
                    "secured_by", "total_units", "credit_type", "co-applicant_credit_type",
                    "age", "submission_of_application", "region", "security_type"]
LOG_TRANSFORM_COLS = ["loan_amount", "income", "property_value"]
DROP_COLS = ["rate_of_interest", "interest_rate_spread", "upfront_charges"]
RENAME_MAP = {"ID": "id", "Gender": "gender", "Credit_Worthiness": "credit_worthiness",
              "Interest_rate_spread": "interest_rate_spread", "Upfront_charges": "upfront_charges",
              "Neg_ammortization": "neg_ammortization", "Secured_by": "secured_by",
              "Credit_Score": "credit_score", "LTV": "ltv", "Region": "region",
              "Security_Type": "security_type", "Status": "status"}
TARGET_COL = "status"
ID_COL = "id"

# Counterfactual settings.
MUTABLE_FEATURES = ["loan_amount", "income", "dtir1", "credit_score", "ltv", "property_value", "term"]
HIGH_RISK_THRESHOLD = 0.7
N_CASES = 3
TOTAL_CFS = 3
DESIRED_CLASS = 0
DECISION_THRESHOLD = 0.5

# Clip bound of the odds ratio and focal-loss defaults.
ODDS_CLIP = 50.0
FOCAL_ALPHA = 0.25
FOCAL_GAMMA = 2.0
BCE_CLAMP = 100.0

# Categorical columns present in the fixture view over the driver tables.
FIXTURE_CATEGORICALS = ["gender", "loan_type", "credit_type", "region", "age"]

# Split bounds (80/10/10) and the salt of the split hash.
SPLIT_BOUNDS = (0.8, 0.9)
SPLIT_SALT = 21

# Fixed scoring coefficients on standardised features (fixture contract).
SCORE_INTERCEPT = -1.1
SCORE_COEFFICIENTS = {"loan_amount": 0.9, "ltv": 0.6, "dtir1": 0.8, "credit_score": -0.7,
                      "income": -0.5, "property_value": -0.3, "term": 0.2}

# Counterfactual random search: candidates per case and hash salts.
CF_CANDIDATES = 200
CF_CHANGE_SALT = 30
CF_VALUE_SALT = 40

# Columns the standardiser scales (numeric measures plus year).
SCALED_COLS = NUMERIC_COLS + ["year"]
