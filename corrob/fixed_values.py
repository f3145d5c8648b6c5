"""Fixed values of the data model.

These lists, tables and constants define results (which words count as a
death toll, which weight a term has), so they are stated plainly here and
nowhere else.
"""

# --- fixed values: URL parameters that never change which story a URL names ---
TRACKING_PARAMS = [
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "utm_id",
    "utm_name", "utm_reader", "gclid", "fbclid", "igshid", "mc_cid", "mc_eid", "ref",
    "ref_src", "ref_url", "source", "cmpid", "ocid", "ns_campaign", "ns_mchannel",
    "ns_source", "at_medium", "at_campaign", "spm", "yclid",
]

# --- fixed values: entry validation bounds ---
MAX_TITLE_LENGTH = 1000
MAX_DESCRIPTION_LENGTH = 20000
MAX_FUTURE_SKEW_SECONDS = 3600

# --- fixed values: event type keywords, first matching type wins ---
EVENT_TYPE_KEYWORDS = [
    ("earthquake", ["earthquake", "quake", "seismic", "magnitude", "tremor", "aftershock"]),
    ("tsunami", ["tsunami", "tidal wave"]),
    ("volcano", ["volcano", "volcanic", "eruption", "lava"]),
    ("wildfire", ["wildfire", "bushfire", "forest fire", "blaze"]),
    ("flood", ["flood", "flooding", "monsoon", "deluge"]),
    ("storm", ["hurricane", "typhoon", "cyclone", "tornado", "storm"]),
    ("drought", ["drought", "famine"]),
    ("conflict", ["war", "strike", "missile", "airstrike", "shelling", "offensive", "combat"]),
    ("terrorism", ["terror", "bombing", "bomb blast", "explosion", "suicide attack"]),
    ("protest", ["protest", "demonstration", "rally", "riot", "unrest"]),
    ("election", ["election", "vote", "ballot", "referendum", "poll"]),
    ("politics", ["parliament", "minister", "president", "government", "senate", "bill"]),
    ("economy", ["economy", "inflation", "gdp", "recession", "market", "stocks", "trade"]),
    ("health", ["outbreak", "virus", "pandemic", "epidemic", "disease", "hospital", "vaccine"]),
    ("accident", ["crash", "collision", "derail", "accident", "capsiz"]),
    ("crime", ["murder", "arrest", "police", "shooting", "kidnap", "fraud"]),
    ("sports", ["match", "tournament", "championship", "olympic", "league", "goal"]),
    ("science", ["nasa", "spacecraft", "satellite", "launch", "rocket", "telescope"]),
]

# --- fixed values: words that name a measured quantity ---
MEASURE_WORDS = {
    "kill": "deaths", "kills": "deaths", "killed": "deaths", "killing": "deaths", "dead": "deaths", "death": "deaths",
    "deaths": "deaths", "died": "deaths", "fatalities": "deaths", "fatal": "deaths", "toll": "deaths",
    "injured": "injured", "injury": "injured", "injuries": "injured", "wounded": "injured", "hurt": "injured",
    "missing": "missing",
    "evacuated": "evacuated", "evacuations": "evacuated",
    "displaced": "displaced", "homeless": "displaced",
    "magnitude": "magnitude", "quake": "magnitude",
    "arrested": "arrested", "detained": "arrested",
    "infected": "infected",
    "cases": "cases",
    "rescued": "rescued",
    "affected": "affected",
}

# --- fixed values: cardinal number words ---
NUMBER_WORDS = {
    "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8,
    "nine": 9, "ten": 10, "eleven": 11, "twelve": 12, "thirteen": 13, "fourteen": 14,
    "fifteen": 15, "sixteen": 16, "seventeen": 17, "eighteen": 18, "nineteen": 19,
    "twenty": 20, "thirty": 30, "forty": 40, "fifty": 50, "sixty": 60, "seventy": 70,
    "eighty": 80, "ninety": 90, "hundred": 100, "thousand": 1000,
}

# --- fixed values: month abbreviations ---
MONTHS = {
    "jan": 1, "feb": 2, "mar": 3, "apr": 4, "may": 5, "jun": 6, "jul": 7, "aug": 8,
    "sep": 9, "sept": 9, "oct": 10, "nov": 11, "dec": 12,
}

# --- fixed values: patterns of facts ---
NUMBER_PATTERN = r"\b(\d{1,3}(?:,\d{3})+|\d+(?:\.\d+)?|" + "|".join(NUMBER_WORDS) + r")\b"
DATE_LIKE_PATTERN = (
    r"\b(?:\d{4}|\d{1,2}:\d{2}(?::\d{2})?|"
    r"\d{1,2}\s+(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec))\b"
)
MONTH_NAMES_PATTERN = "jan|feb|mar|apr|may|jun|jul|aug|sep|sept|oct|nov|dec"
DAY_MONTH_YEAR_PATTERN = rf"\b(\d{{1,2}})\s+({MONTH_NAMES_PATTERN})[a-z]*\.?\s+(\d{{4}})\b"
MONTH_DAY_YEAR_PATTERN = rf"\b({MONTH_NAMES_PATTERN})[a-z]*\.?\s+(\d{{1,2}}),?\s+(\d{{4}})\b"
CAPITALISED_RUN_PATTERN = r"\b([A-Z][a-z]{2,}(?:\s+[A-Z][a-z]{2,})+)\b"
ORGANISATION_PATTERN = (
    r"\b([A-Z][a-zA-Z]*(?:\s+[A-Z][a-zA-Z]*)*\s+"
    r"(?:Agency|Ministry|Government|University|Organization|Organisation|Committee|"
    r"Association|Police|Army|Navy|Council|Department|Authority|Bank|Party|Union|"
    r"Court|Institute|Foundation))\b"
)

# --- fixed values: one-word places ---
PLACES = """
    afghanistan albania algeria angola argentina armenia australia austria azerbaijan
    bahrain bangladesh belarus belgium bolivia bosnia botswana brazil bulgaria cambodia
    cameroon canada chad chile china colombia congo croatia cuba cyprus czechia denmark
    ecuador egypt eritrea estonia ethiopia finland france gabon georgia germany ghana
    greece guatemala guinea haiti honduras hungary iceland india indonesia iran iraq
    ireland israel italy ivorycoast jamaica japan jordan kazakhstan kenya kuwait
    kyrgyzstan laos latvia lebanon liberia libya lithuania madagascar malawi malaysia
    mali malta mauritania mexico moldova mongolia montenegro morocco mozambique myanmar
    namibia nepal netherlands newzealand nicaragua niger nigeria norway oman pakistan
    panama paraguay peru philippines poland portugal qatar romania russia rwanda saudi
    senegal serbia singapore slovakia slovenia somalia spain srilanka sudan sweden
    switzerland syria taiwan tajikistan tanzania thailand togo tunisia turkey
    turkmenistan uganda ukraine uruguay uzbekistan venezuela vietnam yemen zambia
    zimbabwe california texas florida hawaii alaska nevada arizona
""".split()

# --- fixed values: embedding vocabulary rules ---
STOPWORDS = """
    a an and are as at be by for from has have in is it its of on or that the this to was
    were will with after before over under into during amid say says said new news report
    reports force forces forced prompt prompts prompted leave leaves left
""".split()
SYNONYMS = {
    "quake": "earthquake", "tremor": "earthquake", "aftershock": "earthquake",
    "seismic": "earthquake", "temblor": "earthquake",
    "bushfire": "wildfire", "forestfire": "wildfire", "blaze": "wildfire",
    "flooding": "flood", "floods": "flood", "deluge": "flood",
    "kill": "death", "kills": "death", "killed": "death", "killing": "death",
    "deaths": "death", "dead": "death", "died": "death", "fatalities": "death",
    "fatal": "death", "toll": "death",
    "injuries": "injury", "wounded": "injury",
    "hits": "hit", "struck": "hit", "strike": "hit", "strikes": "hit", "striking": "hit",
    "evacuations": "evacuation", "evacuated": "evacuation",
    "displaced": "displacement", "displaces": "displacement",
    "thousands": "thousand",
}
STEM_SUFFIXES = ["ings", "ing", "ies", "ied", "es", "ed", "s"]
EMBEDDING_DIM = 1536

# --- fixed values: clustering ---
WEIGHT_SEMANTIC = 0.80
WEIGHT_ENTITY = 0.15
WEIGHT_NUMBER = 0.05
TYPE_MISMATCH_PENALTY = 0.90
CLUSTER_THRESHOLD = 0.70
EVENT_WINDOW_HOURS = 72
NEAR_DUPLICATE_COSINE = 0.92
MAX_CANDIDATES = 300

# --- fixed values: verification ---
OFFICIAL_WORDS = ["agency", "ministry", "government", "meteorological", "department",
                  "authority", "official", "institute", "organization", "organisation",
                  "university"]
CONFLICT_TOLERANCE = 0.05
SOLID_SUPPORT = 2

# --- fixed values: confidence ---
CONFIDENCE_WEIGHTS = {"independent": 0.45, "reliability": 0.20, "agreement": 0.20, "official": 0.15}
INDEPENDENT_MISS = 0.6
INDEPENDENT_TARGET = 5
STALE_GRACE_HOURS = 24.0
STALE_LOSS_PER_DAY = 0.06
CONFLICT_FACTOR = 0.85
CONFIDENCE_CAP = 99.0
CONFIDENCE_BANDS = [(95, "HIGHLY_CONFIRMED"), (85, "STRONGLY_SUPPORTED"),
                    (70, "REASONABLY_SUPPORTED"), (50, "UNCERTAIN")]
CONFIDENCE_LOWEST_BAND = "DO_NOT_PUBLISH"
CONFIDENCE_FLOOR = 70.0
UNVERIFIED_BELOW = 50

# --- fixed values: importance ---
TYPE_SEVERITY = {
    "earthquake": 78.0, "tsunami": 82.0, "flood": 72.0, "wildfire": 70.0, "storm": 62.0,
    "disaster": 75.0, "conflict": 74.0, "war": 80.0, "attack": 76.0, "explosion": 74.0,
    "shooting": 76.0, "crime": 45.0, "protest": 48.0, "epidemic": 72.0, "disease": 60.0,
    "accident": 55.0, "economy": 52.0, "politics": 55.0, "election": 58.0, "science": 40.0,
    "health": 50.0, "sports": 25.0, "entertainment": 22.0, "technology": 40.0,
    "education": 35.0, "environment": 55.0,
}
DEFAULT_SEVERITY = 40.0
IMPORTANCE_WEIGHTS = {"severity": 0.34, "harm": 0.24, "scale": 0.14, "scope": 0.14,
                      "developing": 0.14}
HARM_MEASURES = {
    "deaths": 1.0, "killed": 1.0, "fatalities": 1.0, "injured": 0.55, "wounded": 0.55,
    "missing": 0.5, "displaced": 0.45, "affected": 0.4, "evacuated": 0.4, "homeless": 0.45,
    "infected": 0.5,
}
SCALE_MEASURES = ["magnitude", "richter", "intensity"]
HARM_CEILING = 1000.0
SCALE_CEILING = 10.0
DEVELOPING_HOURS = 6.0
IMPORTANCE_BANDS = [(80, "major"), (60, "significant"), (40, "moderate")]
IMPORTANCE_LOWEST_BAND = "minor"
IMPORTANCE_FLOOR = 30.0

# --- fixed values: event states ---
PUBLIC_STATUSES = ["VERIFIED", "EDITORIAL_REVIEW", "PUBLISHED", "UPDATING", "ARCHIVED"]
ACTIVE_STATUSES = ["DETECTED", "CLUSTERING", "VERIFYING", "VERIFIED", "PUBLISHED", "UPDATING"]
MAINTAINED_STATUSES = ["DETECTED", "CLUSTERING", "VERIFYING", "VERIFIED", "EDITORIAL_REVIEW",
                       "PUBLISHED", "UPDATING"]
OPEN_STATUSES = ["DETECTED", "CLUSTERING", "VERIFYING"]

# --- fixed values: ranking ---
RANK_WEIGHTS = {"importance": 0.55, "confidence": 0.30, "recency": 0.15}
RECENCY_HALF_LIFE_HOURS = 18.0
LOCAL_BONUS = 1.10
FEED_LIMIT = 20

# --- fixed values: drafts ---
COPY_NGRAM = 8
MAX_COPY_OVERLAP = 0.30
MIN_NAME_LENGTH = 4
MIN_PARAGRAPH_CHARS = 40
SHORT_BODY_CHARS = 200
MIN_BODY_CHANGE = 0.02
SLUG_LENGTH = 180

# --- fixed values: source health and operations ---
DOWN_AFTER = 6
SLOW_LATENCY_MS = 10000.0
LATENCY_SMOOTHING = 0.3
MAX_BACKOFF_MULTIPLIER = 8
STALE_EVENT_HOURS = 168
JOB_RETENTION_DAYS = 7
HOURLY_BUDGET = 500
REQUESTS_PER_MINUTE = 120
ADMIN_REQUESTS_PER_MINUTE = 30
RETRY_BASE_SECONDS = 30
RETRY_CAP_SECONDS = 3600
GLOBAL_COUNTRY = "XX"
INTERNATIONAL_SOURCES = 30
MIN_POLL_SECONDS = 30
IMAGE_PROMPT = (
    "A neutral, factual editorial illustration for a news article about: %s. "
    "Setting: %s. Category: %s. "
    "Documentary style, no text, no logos, no identifiable real people, no gore."
)
