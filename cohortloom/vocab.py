"""Concept codes, question names, answer labels and their report orders.

They are data, not logic, and must be spelled exactly as the survey warehouse spells them.
"""

# --- questions: concept id, short name, wording searched for in the long question text ---
LIFETIME = 1586198
FREQUENCY = 1586201
QUANTITY = 1586207
BINGE = 1586213
RACE = 1586140
SUBGROUP = 1586151

ALCOHOL_QUESTIONS = [LIFETIME, FREQUENCY, QUANTITY, BINGE]
COHORT_QUESTIONS = [RACE, SUBGROUP, *ALCOHOL_QUESTIONS]

QUESTION_NAMES = {
    LIFETIME: "Alcohol: Alcohol Participant",
    FREQUENCY: "Alcohol: Drink Frequency Past Year",
    QUANTITY: "Alcohol: Average Daily Drink Count",
    BINGE: "Alcohol: 6 or More Drinks Occurrence",
}

PREFIX_BY_ID = {
    LIFETIME: "Lifetime Use:",
    FREQUENCY: "Frequency:",
    QUANTITY: "Quantity:",
    BINGE: "Binge (6+):",
}

PREFIX_BY_WORDING = {
    "In your entire life": "Lifetime Use:",
    "How often do you have a drink": "Frequency:",
    "how many drinks do you have": "Quantity:",
    "six or more drinks": "Binge (6+):",
}

# --- answers ---
REFUSALS = ["PMI: Prefer Not To Answer", "PMI: Skip"]
REFUSALS_AND_BLANKS = [*REFUSALS, "", "NA"]
NA_TOKENS = ["", "NA"]
INVALID_PATTERN = "PMI|Skip|Prefer Not To Answer"

ANSWER_PREFIXES = [
    "Drink Frequency Past Year: ",
    "Average Daily Drink Count: ",
    "6 or More Drinks Occurrence: ",
    "Alcohol Participant: ",
]

FREQUENCY_LEVELS = [
    "Drink Frequency Past Year: Never",
    "Drink Frequency Past Year: Monthly Or Less",
    "Drink Frequency Past Year: 2 to 4 Per Month",
    "Drink Frequency Past Year: 2 to 3 Per Week",
    "Drink Frequency Past Year: 4 or More Per Week",
]

QUANTITY_LEVELS = [
    "Average Daily Drink Count: 1 or 2",
    "Average Daily Drink Count: 3 or 4",
    "Average Daily Drink Count: 5 or 6",
    "Average Daily Drink Count: 7 to 9",
    "Average Daily Drink Count: 10 or More",
]

FEW_DRINKS = "1–2 drinks"
MANY_DRINKS = "3+ drinks"
COLLAPSED_LEVELS = [FEW_DRINKS, MANY_DRINKS]
COLLAPSE_QUANTITY = {
    FEW_DRINKS: QUANTITY_LEVELS[:1],
    MANY_DRINKS: QUANTITY_LEVELS[1:],
}

SUBGROUP_MARK = "Asian Specific:"
SUBGROUP_PREFIX = "Asian Specific: "
SUBGROUPS = [
    "Asian Specific: Chinese",
    "Asian Specific: Japanese",
    "Asian Specific: Korean",
    "Asian Specific: Filipino",
    "Asian Specific: Vietnamese",
]

# --- labels made from concept codes ---
HISPANIC_CODE = 38003563
ASIAN_CODE = 8515
HISPANIC = "Hispanic or Latino"
RACE_LABELS = {
    8527: "White",
    8516: "Black or African American",
    8515: "Asian",
    8522: "American Indian or Alaska Native",
    8657: "Native Hawaiian or Other Pacific Islander",
    2000000001: "More than one race",
}
UNKNOWN_RACE = "Other/Unknown"
ALL_RACES = sorted([HISPANIC, *RACE_LABELS.values(), UNKNOWN_RACE])
REPORTED_RACES = ["White", "Asian", "Black or African American", "Hispanic or Latino"]

AGE_BANDS = [
    (18, 29, "18-29"),
    (30, 39, "30-39"),
    (40, 49, "40-49"),
    (50, 59, "50-59"),
    (60, 69, "60-69"),
    (70, 79, "70-79"),
    (80, 89, "80-89"),
    (90, None, "90+"),
]
AGE_LEVELS = [label for _, _, label in AGE_BANDS]
SEX_KEPT = ["Male", "Female"]

DATA_FLAGS = [
    "has_whole_genome_variant",
    "has_lr_whole_genome_variant",
    "has_array_data",
    "has_structural_variant_data",
]

# --- crosstab row order, with and without the answer prefix ---
CATEGORY_ORDER = [
    "Lifetime Use: Alcohol Participant: Yes",
    "Frequency: Drink Frequency Past Year: Monthly Or Less",
    "Frequency: 2 to 4 times a month",
    "Frequency: 2 to 3 times a week",
    "Frequency: 4 or more times a week",
    "Quantity: Average Daily Drink Count: 1 or 2",
    "Quantity: Average Daily Drink Count: 3 or 4",
    "Quantity: Average Daily Drink Count: 5 or 6",
    "Quantity: Average Daily Drink Count: 7 to 9",
    "Quantity: Average Daily Drink Count: 10 or More",
    "Binge (6+): 6 or More Drinks Occurrence: Never In Last Year",
    "Binge (6+): 6 or More Drinks Occurrence: Less Than Monthly",
    "Binge (6+): 6 or More Drinks Occurrence: Monthly",
]
CLEAN_CATEGORY_ORDER = [
    "Lifetime Use: Yes",
    "Frequency: Monthly Or Less",
    "Frequency: 2 to 4 times a month",
    "Frequency: 2 to 3 times a week",
    "Frequency: 4 or more times a week",
    "Quantity: 1 or 2",
    "Quantity: 3 or 4",
    "Quantity: 5 or 6",
    "Quantity: 7 to 9",
    "Quantity: 10 or More",
    "Binge (6+): Never In Last Year",
    "Binge (6+): Less Than Monthly",
    "Binge (6+): Monthly",
]
TOTAL_ROW = "Total Participants"
TOTAL_COLUMN = "Total (All Groups)"

# --- regression outcome ---
NONDRINKER = "Nondrinker"
LIFETIME_NO = "No"
PAST_YEAR_NEVER = "Never in past year"
