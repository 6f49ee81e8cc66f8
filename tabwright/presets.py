"""Fixed values of the medical-insurance use case; every operator takes them as arguments."""

from __future__ import annotations

# The figures below must stay as they are for results to agree.

NETWORK_SCORES = {
    "gold": 3, "silver": 2, "bronze": 1,
    "tier1": 3, "tier 1": 3, "tier2": 2, "tier 2": 2, "tier3": 1, "tier 3": 1,
}
PLAN_SCORES = {"ppo": 3, "epo": 2, "hmo": 1, "premium": 3, "standard": 2, "basic": 1}
DEFAULT_SCORE = 2.0
QUALITY_WEIGHTS = {"plan": 0.35, "network": 0.30, "deductible": 0.20, "premium": 0.15}

COST_COLUMNS = ["annual_medical_cost", "charges", "total_claims_paid"]

NUMERIC_COLUMNS = [
    "age", "income", "household_size", "dependents", "bmi", "medication_count", "systolic_bp",
    "diastolic_bp", "ldl", "hba1c", "deductible", "copay", "policy_term_years",
    "policy_changes_last_2yrs", "provider_quality", "risk_score", "annual_medical_cost",
    "annual_premium", "monthly_premium", "claims_count", "avg_claim_amount", "total_claims_paid",
    "chronic_count",
]
CATEGORICAL_COLUMNS = [
    "sex", "region", "urban_rural", "education", "marital_status", "employment_status", "smoker",
    "alcohol_freq", "plan_type", "network_tier",
]
BINARY_COLUMNS = [
    "hypertension", "diabetes", "asthma", "copd", "cardiovascular_disease", "cancer_history",
    "kidney_disease", "liver_disease", "arthritis", "mental_health", "is_high_risk",
    "had_major_procedure",
]
PROCEDURE_COLUMNS = [
    "proc_imaging_count", "proc_surgery_count", "proc_physio_count", "proc_consult_count",
    "proc_lab_count",
]
KEY_FEATURES = [
    "age", "sex", "income", "bmi", "smoker", "chronic_count", "systolic_bp", "diastolic_bp",
    "hba1c", "ldl", "claims_count", "annual_medical_cost", "deductible", "medication_count",
    "hypertension", "diabetes", "cardiovascular_disease", "cancer_history",
]
PROFILE_NUMERIC_COLUMNS = [
    "age", "income", "bmi", "systolic_bp", "diastolic_bp", "ldl", "hba1c", "deductible", "copay",
    "annual_medical_cost", "annual_premium", "monthly_premium", "claims_count",
    "total_claims_paid", "chronic_count",
]
PROFILE_CATEGORICAL_COLUMNS = [
    "sex", "region", "urban_rural", "education", "employment_status", "smoker", "plan_type",
    "network_tier",
]

CLASSIFIER_GRIDS = {
    "logreg_l2": {"C": [0.1, 1.0, 10.0], "class_weight": [None, "balanced"]},
    "logreg_l1": {"C": [0.1, 1.0, 10.0], "class_weight": [None, "balanced"]},
    "rf": {"n_estimators": [400], "max_depth": [None, 12]},
    "gbr": {"n_estimators": [300], "learning_rate": [0.05, 0.1], "max_depth": [2, 3]},
}
REGRESSOR_GRIDS = {
    "linear": {},
    "ridge": {"alpha": [0.1, 1.0, 10.0, 100.0]},
    "lasso": {"alpha": [0.01, 0.1, 1.0, 10.0]},
    "elasticnet": {"alpha": [0.01, 0.1, 1.0], "l1_ratio": [0.2, 0.5, 0.8]},
    "rf": {"n_estimators": [300], "max_depth": [None, 12], "min_samples_split": [2, 10]},
    "gbr": {"n_estimators": [300], "learning_rate": [0.05, 0.1], "max_depth": [2, 3]},
}
CURVE_FRACTIONS = [0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]
CURVE_ROWS = 20_000
CURVE_MODELS = {
    "gbr": {"n_estimators": 100, "max_depth": 3, "learning_rate": 0.1},
    "rf": {"n_estimators": 100},
    "logreg_l1": {"C": 10.0},
    "logreg_l2": {"C": 10.0},
}

MODEL_LABELS = {
    "gbr": "Gradient Boosting",
    "rf": "Random Forest",
    "logreg_l1": "Logistic Reg (L1)",
    "logreg_l2": "Logistic Reg (L2)",
    "ridge": "Ridge Regression",
    "linear": "Linear Regression",
}
PROBABILITY_FLOOR = 0.005
PROBABILITY_CEILING = 0.995
ERROR_BANDS = ((500.0, "good"), (1000.0, "warn"))
WORST_BAND = "bad"
