"""Fixed values the results depend on: names, factors, price and power constants."""

# Key columns.
SCENARIO = ["workload_type", "dataset_size_mb"]
CONFIG = ["cloud", "region", "machine_type", "nodes"]
GROUP = ["cloud", "region", "dataset_size_mb", "workload_type", "machine_type", "nodes"]

# Feature and target columns of the runtime and cost models.
FEATURES = [
    "cloud", "region", "electricity_zone", "dataset_size_mb", "workload_type",
    "machine_type", "nodes", "carbon_intensity_mean", "renewable_percentage_mean",
]
CATEGORICAL = ["cloud", "region", "electricity_zone", "workload_type", "machine_type"]
NUMERIC = ["dataset_size_mb", "nodes", "carbon_intensity_mean", "renewable_percentage_mean"]
TARGETS = ["runtime_minutes", "cost_usd"]

# Accepted labels when cleaning runs.
VALID_WORKLOADS = ["cpu-heavy", "memory-heavy", "io-heavy", "cpu_heavy", "memory_heavy", "io_heavy"]
VALID_MACHINES = [
    "c5.xlarge", "c5a.xlarge", "c6i.xlarge", "m5a.xlarge", "m6i.xlarge", "r5.xlarge", "m5.xlarge",
]
SHORT_WORKLOADS = ["cpu", "memory", "io"]
MAX_RUNTIME_MINUTES = 1440

# Region names and electricity zones.
REGION_NAMES = {"centralindia": "Central India", "southeastasia": "Southeast Asia"}
REGION_ABBREVIATIONS = {"centralindia": "cin", "southeastasia": "sea"}
RUN_ZONES = {"ap-south-1": "IN", "ap-southeast-1": "SG"}
COARSE_ZONES = {"IN": "IN-WE"}
REGION_ZONES = [
    ("AWS", "ap-south-1", "IN-WE"),
    ("AWS", "ap-southeast-1", "SG"),
    ("Azure", "Central India", "IN-WE"),
    ("Azure", "Southeast Asia", "SG"),
]

# Emissions factors.
PUE = {"aws": 1.15, "azure": 1.18}
DEFAULT_PUE = 1.20
WATTS_PER_VCPU = 12.0
DEFAULT_POWER_W = 60.0
SIZE_SUFFIX_VCPUS = {"large": 2.0, "xlarge": 4.0, "2xlarge": 8.0, "4xlarge": 16.0, "8xlarge": 32.0}
AZURE_SIZE_PATTERN = r"_?d(\d+)[a-z]*_?v\d"
ESTIMATED_SOURCE = "ESTIMATED from vCPU count"
PLACEHOLDER_SOURCE = "PLACEHOLDER - replace with Boavizta or Cloud Carbon Footprint figure"

# Minimum and maximum watts per vCPU by provider and microarchitecture
# (published Cloud Carbon Footprint coefficients).
WATT_COEFFICIENTS = [
    ("AWS", "Sky Lake", 0.6446044454253452, 4.193436438541878),
    ("AWS", "Cascade Lake", 0.6389493581523519, 3.9673047343937564),
    ("AWS", "EPYC 1st Gen", 0.82265625, 2.553125),
    ("AWS", "EPYC 2nd Gen", 0.4742621527777778, 1.6929615162037037),
    ("Azure", "Haswell", 1.9005681818181814, 6.012910353535353),
    ("Azure", "Broadwell", 0.7128342245989304, 3.6853275401069516),
    ("Azure", "Skylake", 0.6446044454253452, 4.193436438541878),
    ("Azure", "Cascade Lake", 0.6389493581523519, 3.9673047343937564),
    ("Azure", "EPYC 2nd Gen", 0.4742621527777778, 1.6929615162037037),
]

# Goal names and their aliases.
GOALS = ["cost", "runtime", "carbon", "balanced"]
GOAL_ALIASES = {
    "cost": "cost", "lowest_cost": "cost", "lowest cost": "cost",
    "runtime": "runtime", "fastest": "runtime", "fastest_runtime": "runtime", "fastest runtime": "runtime",
    "carbon": "carbon", "lowest_carbon": "carbon", "lowest carbon": "carbon",
    "balanced": "balanced", "balance": "balanced",
}
BALANCED_WEIGHTS = {"runtime": 0.35, "cost": 0.35, "emissions": 0.20, "renewable": 0.10}
RENEWABLE_WEIGHT = 0.25
REASONS = {
    "cost": "ranked by lowest predicted cost",
    "runtime": "ranked by fastest predicted runtime",
    "carbon": "ranked by lowest predicted emissions for this job and higher renewable percentage",
    "balanced": "ranked by best trade-off between runtime, cost, carbon, and renewable energy",
}
NO_SLA_PREFIX = "No configuration satisfied the SLA; "

# Report headings of a ranked recommendation.
REPORT_HEADINGS = {
    "rank": "Rank", "cloud": "Cloud", "region": "Region", "machine_type": "Machine Type", "nodes": "Nodes",
    "predicted_runtime_minutes": "Predicted Runtime (minutes)", "predicted_cost_usd": "Predicted Cost (USD)",
    "predicted_emissions_gco2eq": "Predicted Emissions (gCO2eq)", "carbon_intensity_mean": "Carbon Intensity",
    "renewable_percentage_mean": "Renewable Percentage", "optimization_score": "Optimization Score",
    "recommendation_reason": "Recommendation Reason",
}

# Evaluation levels, methods and guards.
SLA_LEVELS = {"tight": 0.25, "medium": 0.50, "loose": 0.75}
BASELINE_METHODS = ["historical_mean", "nearest_size", "largest_cluster", "random"]
MIN_RUNTIME = 0.01
MIN_CANDIDATES = 2
MIN_TRAINING_ROWS = 10
MIN_MODEL_ROWS = 6

# Pricing model spellings and instance categories by workload.
ON_DEMAND_NAMES = ["on-demand", "ondemand", "consumption"]
SPOT_NAMES = ["spot", "low priority", "low-priority"]
CATEGORIES_BY_WORKLOAD = {
    "cpu-heavy": ["general", "compute"],
    "memory-heavy": ["general", "memory"],
    "io-heavy": ["general", "storage"],
}

# VM sizes of the study as (size, vCPU, RAM GB, quota family).
VM_SIZES = [
    ("Standard_D2s_v3", 2, 8, "DSv3"), ("Standard_D4s_v3", 4, 16, "DSv3"),
    ("Standard_D2as_v4", 2, 8, "DASv4"), ("Standard_D4as_v4", 4, 16, "DASv4"),
    ("Standard_D2ds_v4", 2, 8, "DDSv4"), ("Standard_D4ds_v4", 4, 16, "DDSv4"),
    ("Standard_D2s_v5", 2, 8, "DSv5"), ("Standard_D4s_v5", 4, 16, "DSv5"),
    ("Standard_D2as_v5", 2, 8, "DASv5"), ("Standard_D4as_v5", 4, 16, "DASv5"),
]

# Run states of the job services.
FINISHED_STATES = ["TERMINATED", "SKIPPED", "INTERNAL_ERROR"]
MAX_REASON_LENGTH = 1500
WORKLOAD_SCRIPTS = {"cpu-heavy": "cpu_heavy.py", "memory-heavy": "memory_heavy.py", "io-heavy": "io_heavy.py"}

# Domains and distributions of generated events.
EVENT_REGIONS = ["us-east", "us-west", "eu-central", "ap-south", "ap-southeast"]
EVENT_TYPES = ["login", "search", "purchase", "logout", "error", "view"]
DEVICE_TYPES = ["web", "ios", "android", "api"]
EVENT_START = "2026-01-01 00:00:00"
EVENT_DAYS = 30
