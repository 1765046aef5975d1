"""Column lists, feature blocks and constants shared by all operators."""

from __future__ import annotations

from datetime import date

# --- fixed values: raw column names ------------------------------------------------

DATE_COLUMNS = {
    "ACCOUNT_CREATE_DATE": "account_create_date",
    "EARLIEST_LOGIN_DATE": "earliest_login_date",
    "EARLIEST_NAME_CONTRIBUTOR_DATE": "earliest_name_date",
    "EARLIEST_SOURCE_CONTRIBUTOR_DATE": "earliest_source_date",
    "EARLIEST_MEMORY_CONTRIBUTOR_DATE": "earliest_memory_date",
    "EARLIEST_GET_INVOLVED_USAGE_DATE": "earliest_get_involved_date",
    "EARLIEST_RECORD_EDIT_DATE": "earliest_record_edit_date",
    "EARLIEST_TREE_EDIT_DATE": "earliest_tree_edit_date",
}
ACTIVITY_COLUMNS = [
    "DAYS_LOGGING_IN",
    "SOURCES_ADDED",
    "DAYS_ADDING_SOURCES",
    "MEMORIES_ADDED",
    "DAYS_ADDING_MEMORIES",
    "GET_INVOLVED_ITEMS_REVIEWED",
    "DAYS_REVIEWING_GET_INVOLVED_ITEMS",
    "RECORD_EDITS",
    "DAYS_EDITING_RECORDS",
    "TREE_EDITS",
    "DAYS_EDITING_TREES",
]
NAME_COLUMNS = [
    "DAYS_ADDING_NAMES",
    "TOTAL_NAMES_ADDED",
    "DECEASED_NAMES_ADDED",
    "LIVING_NAMES_ADDED",
    "NOVEL_NAMES_ADDED",
    "QUALIFIED_NAMES_ADDED",
]
GEO_COLUMNS = ["COUNTRY", "PROVINCE", "CITY", "USER_WORLD_REGION", "USER_AREA_NAME"]
SENTINELS = ["Unknown", "Redacted", "-", ""]

# activity flag -> count column (the login flag first)
FLAGS = {
    "has_login": "DAYS_LOGGING_IN",
    "has_tree_edits": "TREE_EDITS",
    "has_names": "TOTAL_NAMES_ADDED",
    "has_sources": "SOURCES_ADDED",
    "has_memories": "MEMORIES_ADDED",
    "has_record_edits": "RECORD_EDITS",
    "has_get_involved": "GET_INVOLVED_ITEMS_REVIEWED",
}
# milestone code -> date column
MILESTONES = {
    "L": "earliest_login_date",
    "T": "earliest_tree_edit_date",
    "N": "earliest_name_date",
    "S": "earliest_source_date",
    "M": "earliest_memory_date",
    "R": "earliest_record_edit_date",
    "G": "earliest_get_involved_date",
}
# the four milestones that enter the persistence scores
CORE_MILESTONES = ["L", "T", "N", "S"]
NO_MILESTONE_DATE = date(2099, 12, 31)

# feature stem -> (count column, stem of the log of the raw count)
RATES = {
    "logins": ("DAYS_LOGGING_IN", "log_days_logging_in"),
    "tree_edits": ("TREE_EDITS", "log_tree_edits"),
    "names": ("TOTAL_NAMES_ADDED", "log_names_added"),
    "sources": ("SOURCES_ADDED", "log_sources_added"),
}
WIDE_RATES = {
    "LOGINS_PER_WEEK": "DAYS_LOGGING_IN",
    "TREE_EDITS_PER_WEEK": "TREE_EDITS",
    "SOURCES_PER_WEEK": "SOURCES_ADDED",
    "MEMORIES_PER_WEEK": "MEMORIES_ADDED",
    "NAMES_PER_WEEK": "TOTAL_NAMES_ADDED",
    "GET_INVOLVED_PER_WEEK": "GET_INVOLVED_ITEMS_REVIEWED",
    "RECORD_EDITS_PER_WEEK": "RECORD_EDITS",
}
AGE_BOUNDS = [19, 29, 39, 49, 59, 69, 79]
AGE_LABELS = ["8-19", "20-29", "30-39", "40-49", "50-59", "60-69", "70-79", "80+"]

# --- fixed values: country clusters -------------------------------------------------

HOME_COUNTRY = "United States"
HOME_CORE_AREA = "Utah Area"
CLUSTER_HOME_CORE = "High-LDS-US-Utah"
CLUSTER_HOME_OTHER = "Mod-Eng-US-Other"
CLUSTER_OTHER = "Micro-Other"
CLUSTER_COUNTRIES = {
    "High-LDS-International": [
        "Mexico", "Brazil", "Chile", "Peru", "Argentina", "Philippines", "Colombia",
        "Ecuador", "Bolivia", "Guatemala", "Honduras", "El Salvador", "Nicaragua",
        "Costa Rica", "Panama", "Dominican Republic", "Paraguay", "Uruguay", "Venezuela",
    ],
    "Mod-Eng-Low-LDS": [
        "United Kingdom", "Germany", "France", "Australia", "Canada", "Italy", "Spain",
        "Portugal", "Ireland", "New Zealand", "Sweden", "Norway", "Denmark", "Finland",
        "Netherlands", "Belgium", "Switzerland", "Austria",
    ],
    "Low-Eng-High-Dev": ["Japan", "South Korea", "Taiwan", "Singapore"],
    "Low-Eng-Developing": [
        "Egypt", "India", "Nigeria", "Indonesia", "Pakistan", "Bangladesh", "Ghana",
        "Kenya", "South Africa",
    ],
}

# --- fixed values: country names that need a manual code ----------------------------

MANUAL_ISO3 = {
    "D.R. Congo": "COD", "DR Congo": "COD", "Congo (Kinshasa)": "COD",
    "Congo (Brazzaville)": "COG", "Republic of the Congo": "COG", "Ivory Coast": "CIV",
    "Cote d'Ivoire": "CIV", "Côte d'Ivoire": "CIV", "South Korea": "KOR",
    "North Korea": "PRK", "Russia": "RUS", "Taiwan": "TWN", "Vietnam": "VNM",
    "Viet Nam": "VNM", "Bolivia": "BOL", "Venezuela": "VEN", "Iran": "IRN",
    "Syria": "SYR", "Laos": "LAO", "Moldova": "MDA", "Tanzania": "TZA",
    "Palestine": "PSE", "Palestinian Territories": "PSE", "Macau": "MAC", "Macao": "MAC",
    "Hong Kong": "HKG", "Brunei": "BRN", "Burma": "MMR", "Myanmar": "MMR",
    "Czech Republic": "CZE", "Czechia": "CZE", "Macedonia": "MKD",
    "North Macedonia": "MKD", "Swaziland": "SWZ", "Eswatini": "SWZ", "Cape Verde": "CPV",
    "Cabo Verde": "CPV", "Timor-Leste": "TLS", "East Timor": "TLS",
    "Vatican City": "VAT", "Holy See": "VAT", "Micronesia": "FSM",
    "Federated States of Micronesia": "FSM", "Reunion": "REU", "Réunion": "REU",
    "Curacao": "CUW", "Curaçao": "CUW", "Sint Maarten": "SXM", "Saint Martin": "MAF",
    "St. Martin": "MAF", "U.S. Virgin Islands": "VIR", "US Virgin Islands": "VIR",
    "British Virgin Islands": "VGB", "Turks and Caicos": "TCA",
    "Turks and Caicos Islands": "TCA", "Cayman Islands": "CYM",
    "Falkland Islands": "FLK", "Faroe Islands": "FRO", "French Guiana": "GUF",
    "French Polynesia": "PYF", "New Caledonia": "NCL", "Martinique": "MTQ",
    "Guadeloupe": "GLP", "Mayotte": "MYT", "Saint Barthelemy": "BLM",
    "Saint Barthélemy": "BLM", "Wallis and Futuna": "WLF",
    "Saint Pierre and Miquelon": "SPM", "Bermuda": "BMU", "Aruba": "ABW", "Guam": "GUM",
    "American Samoa": "ASM", "Northern Mariana Islands": "MNP", "Puerto Rico": "PRI",
    "Kosovo": "XKX", "Bonaire": "BES", "Caribbean Netherlands": "BES",
    "Channel Islands": "GBR", "St. Helena": "SHN", "St. Kitts and Nevis": "KNA",
    "St. Lucia": "LCA", "St. Pierre and Miquelon": "SPM",
    "St. Vincent and the Grenadines": "VCT", "Turkey": "TUR",
    "U.S. Minor Outlying Islands": "UMI", "Christmas Island": "CXR",
    "Cocos Islands": "CCK", "Cook Islands": "COK", "Norfolk Island": "NFK",
    "Niue": "NIU", "Tokelau": "TKL", "Pitcairn": "PCN", "Svalbard": "SJM",
    "Unknown": None, "-": None,
}

# --- fixed values: country-level inputs ---------------------------------------------

INDICATORS = {
    "NY.GDP.PCAP.PP.CD": "gdp_per_capita_ppp",
    "IT.NET.USER.ZS": "internet_pct",
    "IT.CEL.SETS.P2": "mobile_per_100",
    "SE.TER.ENRR": "tertiary_enrollment",
    "SP.POP.TOTL": "population",
}
COLUMN_CANDIDATES = {
    "iso3": ["iso3", "ISO3", "iso_code", "country_code"],
    "date": ["date", "Date", "snapshot_date", "scrape_date", "timestamp"],
    "country": ["country", "Country", "country_name"],
    "membership": ["membership", "Membership", "members", "Members", "total_membership",
                   "Total Church Membership"],
    "congregations": ["congregations", "Congregations", "wards_branches"],
    "temples": ["temples", "Temples", "operating_temples"],
    "stakes": ["stakes", "Stakes"],
    "population": ["population", "Population"],
}
COMPOSITE_COMPONENTS = ["gdp_per_capita_ppp", "internet_pct", "hdi",
                        "lds_members_per_capita"]
COMPOSITE_MIN_COMPONENTS = 3

# --- fixed values: feature blocks ----------------------------------------------------

VELOCITY = ["days_to_first_login", "days_login_to_tree_edit", "days_login_to_name",
            "days_to_first_tree_edit", "days_to_first_name", "activation_speed"]
VOLUME = ["log_logins_pw", "log_tree_edits_pw", "log_names_pw", "log_sources_pw",
          "logins_90d", "tree_edits_90d", "names_90d", "sources_90d"]
SEQUENCING = ["activity_breadth", "funnel_stage", "has_login", "has_tree_edits",
              "has_names", "has_sources", "has_memories", "has_record_edits",
              "has_get_involved"]
CONTEXTUAL = ["user_age", "gdp_per_capita_ppp", "hdi", "internet_pct", "pct_christian",
              "govt_restrictions_index", "social_hostilities_index",
              "lds_members_per_capita", "religious_diversity_index"]
CONTEXTUAL_CATEGORICAL = ["country_cluster", "age_group"]
TRANSITIONS = ["days_to_first_login", "days_login_to_tree_edit", "days_login_to_name"]
# without columns that are constant once a user has logged in, edited and added names
SEQUENCING_CONTRIBUTORS = ["activity_breadth", "funnel_stage", "has_sources",
                           "has_memories", "has_record_edits", "has_get_involved"]
# velocity_score is the composite of the three transitions
VELOCITY_DECOLLINEARED = TRANSITIONS + ["velocity_score", "activation_speed"]
ENRICHMENT_FEATURES = ["gdp_per_capita_ppp", "hdi", "pct_christian",
                       "govt_restrictions_index", "social_hostilities_index",
                       "lds_members_per_capita", "religious_diversity_index"]
VELOCITY_CLUSTER = TRANSITIONS + ["activation_speed"]
PCA_FEATURES = (VELOCITY_CLUSTER + VOLUME + ["activity_breadth", "funnel_stage",
                "login_consistency"] + ENRICHMENT_FEATURES + ["gepi", "user_age"])
CLUSTER_FEATURES = ["logins_90d", "log_logins_pw", "activity_breadth", "funnel_stage",
                    "log_sources_pw", "sources_90d", "log_tree_edits_pw",
                    "tree_edits_90d", "names_90d", "log_names_pw", "has_sources",
                    "has_memories", "days_to_first_login", "activation_speed",
                    "user_age"]
FEATURE_SETS = {
    "behavioral_only": VELOCITY_CLUSTER + VOLUME + SEQUENCING_CONTRIBUTORS,
    "behavioral_no_flags": VELOCITY_CLUSTER + VOLUME
    + ["activity_breadth", "funnel_stage"],
    "combined_full": VELOCITY_CLUSTER + VOLUME + SEQUENCING_CONTRIBUTORS
    + ENRICHMENT_FEATURES + ["user_age"],
    "combined_no_flags": VELOCITY_CLUSTER + VOLUME
    + ["activity_breadth", "funnel_stage"] + ENRICHMENT_FEATURES + ["user_age"],
    "volume_reduced": ["log_logins_pw", "logins_90d", "log_tree_edits_pw"]
    + VELOCITY_CLUSTER + SEQUENCING_CONTRIBUTORS,
    "biplot_features": PCA_FEATURES,
}
PARTIAL_CONTROLS = ["log_logins_pw", "logins_90d", "log_tree_edits_pw", "tree_edits_90d"]
PROFILE_FEATURES = ["logins_90d", "tree_edits_90d", "names_90d", "sources_90d",
                    "activity_breadth", "funnel_stage", "days_to_first_login",
                    "activation_speed", "user_age"]
WEIGHTINGS = ["uniform", "equal_construct", "downweight_volume", "sqrt_volume",
              "velocity_boost"]
WEIGHT_BY_CONSTRUCT = {
    "uniform": {},
    "downweight_volume": {"Volume": 0.5, "Velocity": 2.0, "Sequencing": 1.5},
    "sqrt_volume": {"Volume": 0.7},
    "velocity_boost": {"Velocity": 3.0, "Volume": 0.5},
}

# --- fixed values: sampling and modelling constants ----------------------------------

SUBSAMPLES = 10
SUBSAMPLE_ROWS = 5000
STRATUM_FLOOR = 15
TRIM_SLACK = 100
BASE_SEED = 42
TRAIN_SHARE = 0.7
MIN_TENURE_DAYS = 31
TERTILE_CUTS = (0.333, 0.667)
CLUSTER_K = range(3, 9)
TIER_K = 5
FOREST_TREES = 300
BOOTSTRAPS = 10
STABLE_JACCARD = 0.75
BORDERLINE_JACCARD = 0.60
DEGENERATE_CLUSTER = 20


def construct_of(feature: str) -> str:
    """Construct a feature belongs to; one-hot columns count as contextual."""
    if feature in VELOCITY or feature == "velocity_score":
        return "Velocity"
    if feature in VOLUME:
        return "Volume"
    if feature in SEQUENCING:
        return "Sequencing"
    return "Contextual"
