"""Fixed values.

Everything in this module is data that results depend on: change a value and the output changes.
Nothing here is code, and every list can be replaced by the caller.
"""

# --- feed contract -------------------------------------------------------------------------------

# A listing without a truthy value in each of these is skipped.
REQUIRED_FIELDS = ("id", "company_name", "title", "url")

# --- company names -------------------------------------------------------------------------------

# Legal-form suffixes, tried once each, in this order.
COMPANY_SUFFIXES = (
    ", inc.", ", inc", " inc.", " inc", ", llc", " llc",
    ", ltd.", " ltd.", ", ltd", " ltd", " corporation", " corp.",
)

# --- applicant-tracking hosts ---------------------------------------------------------------------

# (provider, host match, host, where the tenant token is)
#   exact / suffix : how the lowercase host is compared
#   path           : first path segment     label : first host label     none : never known
ATS_HOSTS = (
    ("greenhouse", "exact", "boards.greenhouse.io", "path"),
    ("greenhouse", "exact", "job-boards.greenhouse.io", "path"),
    ("lever", "exact", "jobs.lever.co", "path"),
    ("ashby", "exact", "jobs.ashbyhq.com", "path"),
    ("workday", "suffix", ".myworkdayjobs.com", "label"),
    ("icims", "suffix", ".icims.com", "label"),
    ("smartrecruiters", "suffix", ".smartrecruiters.com", "path"),
    ("taleo", "suffix", ".taleo.net", "label"),
    ("brassring", "exact", "sjobs.brassring.com", "none"),
    ("jobvite", "exact", "jobs.jobvite.com", "path"),
    ("recruitee", "suffix", ".recruitee.com", "label"),
    ("workable", "exact", "apply.workable.com", "path"),
)

# Removed, wherever it occurs, from the host label of this provider.
ATS_LABEL_NOISE = {"icims": "careers-"}

# --- tier rules ----------------------------------------------------------------------------------

TIER_NAMED, TIER_KEYWORD, TIER_SKIP = "named_target", "keyword", "skip"

# Preset name -> tiers that are scored.
TIER_PRESETS = {
    "tier1": (TIER_NAMED,),
    "tier2": (TIER_KEYWORD,),
    "all": (TIER_NAMED, TIER_KEYWORD),
}

# Companies always scored; whole words, any case.
NAMED_COMPANIES = (
    "scale ai", "shield ai", "anthropic", "databricks", "ramp", "applied intuition", "sierra",
    "booz allen", "saic", "leidos", "rebellion defense",
    "stripe", "plaid", "mercury", "brex", "modern treasury",
    "fivetran", "retool", "vercel", "hex",
    "glean", "harvey", "hebbia", "decagon",
    "suno", "apollo graphql", "flock safety", "channel3", "luma ai", "lightmatter", "mashgin",
    "parabola", "lm studio", "logrocket", "cloudzero", "smartcat", "hubspot", "zendesk",
)

# Searched in company and title together.
KEYWORD_PATTERNS = (
    r"\bforward deployed\b", r"\bfde\b", r"\bapplied ai\b", r"\bai engineer\b",
    r"\bsolutions engineer\b", r"\bsolutions architect\b", r"\bsolutions consultant\b",
    r"\bimplementation\b", r"\bcustomer engineer\b", r"\bsales engineer\b",
    r"\bbusiness operations\b", r"\bstrategy\b", r"\bstrategy and operations\b", r"\bbizops\b",
    r"\brevenue operations\b", r"\brevops\b", r"\bgo.to.market\b", r"\bgtm\b",
    r"\bproduct analyst\b", r"\bproduct analytics\b", r"\bbusiness analyst\b",
    r"\boperations analyst\b",
    r"\bdefense\b", r"\bnational security\b", r"\bintelligence\b",
    r"\bassociate product manager\b", r"\bapm\b", r"\bprogram manager\b", r"\btechnical program\b",
)

# Searched in the title only.
SKIP_PATTERNS = (
    r"\bsoftware engineer\b", r"\bswe\b", r"\bmachine learning engineer\b", r"\bml engineer\b",
    r"\bdata scientist\b", r"\bquant\b", r"\bquantitative\b", r"\bdata engineer\b",
    r"\bbackend\b", r"\bfrontend\b", r"\bfull stack\b", r"\bembedded\b", r"\bfirmware\b",
)

# --- candidate selection -------------------------------------------------------------------------

CYCLE_YEAR = "2027"
OPEN_SEASONS = ("Summer", "N/A")
# The single-candidate lookup does not take "N/A".
LATEST_OPEN_SEASONS = ("Summer",)

QUEUE_PREVIEW_ROWS = 20

# --- scoring -------------------------------------------------------------------------------------

# Fields of an answer.
MANDATORY = (
    "qualification_score", "fit_score", "class_year_eligible", "top_matches", "top_gaps",
)
OPTIONAL = ("fit_reasoning", "summary")

UNSPECIFIED = "unspecified"
CONFIG_VERSION_HEX = 12
FINGERPRINT_HEX = 16

# Lowest score of each band, highest band first.
SCORE_BANDS = (
    (85, "85-100"), (65, "65-84"), (45, "45-64"), (25, "25-44"), (5, "5-24"), (0, "0-4"),
)

# Role family -> qualification range expected of a candidate without the background it asks for.
ROLE_RANGES = (
    ("quant_research", 5, 20),
    ("software_engineer", 15, 35),
    ("forward_deployed_or_strategy", 60, 85),
    ("ml_research", 5, 20),
    ("hardware", 5, 15),
    ("defense_software", 25, 45),
    ("data_analytics", 20, 40),
)

# Titles of each role family.
FAMILY_TITLES = {
    "quant_research": r"\bquant(itative)? research",
    "software_engineer": r"\b(software engineer|swe)\b",
    "forward_deployed_or_strategy": r"\b(forward deployed|bizops|strategy|investment analyst)\b",
    "ml_research": r"\b(applied scientist|research engineer|(ml|ai) research)",
    "hardware": r"\b(hardware|fpga|embedded)\b",
    "defense_software": r"\bdefense\b.*\b(software|swe)\b",
    "data_analytics": r"\b(data scientist|data analyst|analytics engineer|insights)\b",
}

# Range in which an undecided scorer clusters.
CLUSTER_RANGE = (70, 75)

# --- review --------------------------------------------------------------------------------------

NO_LOCATION = "—"
UNKNOWN_PROVIDER = "unknown"
TARGETS_MIN_QUALIFICATION, TARGETS_ROWS = 40, 30
TOP_ROWS = 20
WINNERS_MIN_QUALIFICATION, WINNERS_MIN_FIT, WINNERS_ROWS = 50, 40, 50
MOST_COMMON_ROWS = 10
HISTOGRAM_BUCKETS = tuple(range(0, 100, 10))
# (characters kept, column width) for the company and the title in the text report.
REPORT_COMPANY, REPORT_TITLE, REPORT_SCORE_WIDTH = (24, 25), (44, 45), 3
COVERAGE_PHRASES = (
    "forward deployed", "solutions engineer", "applied ai", "ai engineer",
    "business operations", "solutions architect", "data scientist",
)
