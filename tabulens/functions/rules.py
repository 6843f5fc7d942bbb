"""Keyword tables. Results depend on these exact words and on their order."""

# Name hints of time columns held as text.
TIME_NAME_HINTS = ("date", "time", "year", "month", "quarter", "period")

# Name hints of key indicators.
KEY_INDICATOR_HINTS = ("gdp", "growth", "rate", "index", "price", "revenue", "sales", "profit")

# Analyses a table allows.
TIME_ANALYSES = ("temporal_trends", "seasonality", "cyclical_patterns", "volatility_analysis")
NUMERIC_ANALYSES = ("correlation_analysis", "comparative_analysis")
CATEGORICAL_ANALYSES = ("segmentation_analysis", "distribution_analysis")

# Value ranges by column name.
RANGE_RULES = {"age": (0, 120), "salary": (0, 1_000_000), "rating": (1, 5)}

# Column-name hints for text case.
TITLE_CASE_HINTS = ("name", "title", "description")
UPPER_CASE_HINTS = ("code", "id", "abbreviation")

# Domain of a text, first match wins.
TEXT_DOMAINS_FIRST = (
    ("Technology/AI/ML", ("machine learning", "algorithm", "software", "data science")),
    ("Academic/Research", ("research", "study", "methodology", "findings")),
    ("Business/Finance", ("business", "market", "revenue", "sales", "finance")),
    ("Healthcare/Medical", ("health", "medical", "patient", "treatment", "clinical")),
)

# Domain of a text by number of keywords found.
TEXT_DOMAINS_SCORED = (
    ("Technology/AI/ML", (
        "machine learning", "automl", "predictive analytics", "algorithm", "neural", "artificial intelligence",
        "deep learning", "data science", "programming", "software", "computer", "technology", "automation",
        "digital")),
    ("Academic/Research", (
        "research", "study", "analysis", "methodology", "findings", "conclusion", "hypothesis", "experiment",
        "academic", "scholar", "publication", "literature review", "theoretical", "empirical")),
    ("Business/Finance", (
        "business", "market", "strategy", "revenue", "customer", "sales", "profit", "finance", "investment",
        "economy", "commercial", "corporate", "management", "leadership", "marketing")),
    ("Healthcare/Medical", (
        "health", "medical", "patient", "treatment", "clinical", "diagnosis", "therapy", "medicine", "hospital",
        "doctor", "nurse", "disease", "symptoms", "healthcare", "pharmaceutical")),
    ("Education/Learning", (
        "education", "learning", "student", "course", "university", "academic", "teaching", "curriculum",
        "school", "training", "pedagogy", "educational", "instructor")),
    ("Legal/Law", (
        "legal", "law", "court", "judge", "attorney", "regulation", "compliance", "legislation", "contract",
        "litigation", "judicial", "statute")),
    ("Science/Engineering", (
        "science", "engineering", "physics", "chemistry", "biology", "mathematics", "scientific", "technical",
        "laboratory", "experiment", "innovation")),
    ("Arts/Culture", (
        "art", "culture", "creative", "design", "music", "literature", "history", "cultural", "artistic",
        "aesthetic", "humanities")),
    ("Sports/Recreation", (
        "sports", "game", "player", "team", "competition", "athletic", "fitness", "recreation", "exercise",
        "training", "performance")),
    ("Travel/Tourism", (
        "travel", "tourism", "destination", "hotel", "vacation", "journey", "tourist", "hospitality",
        "adventure", "exploration")),
    ("Food/Nutrition", (
        "food", "nutrition", "recipe", "cooking", "diet", "meal", "restaurant", "culinary", "ingredient",
        "health food")),
    ("Environment/Sustainability", (
        "environment", "sustainability", "climate", "ecology", "green", "renewable", "conservation",
        "pollution", "carbon", "ecosystem")),
    ("Government/Policy", (
        "government", "policy", "politics", "public", "administration", "governance", "political", "municipal",
        "federal", "regulation")),
)
TEXT_DOMAIN_MIN_SCORE = 2

# Domain of a table by its column names, first match wins. Short, long and dataset-type lists.
TABLE_DOMAINS_SHORT = (
    ("Sleep/Health", ("sleep", "duration", "quality", "bedtime")),
    ("Healthcare/Medical", ("patient", "diagnosis", "treatment", "medical")),
    ("Business/Finance", ("price", "cost", "revenue", "sales")),
)
TABLE_DOMAINS_LONG = (
    ("Sleep/Health", ("sleep", "duration", "quality", "bedtime", "wake", "rest", "dream")),
    ("Healthcare/Medical", (
        "patient", "diagnosis", "treatment", "medical", "health", "symptom", "disease", "stress level", "bmi",
        "blood pressure", "heart rate")),
    ("Business/Finance", ("price", "cost", "revenue", "sales", "profit", "budget", "income")),
    ("Retail/E-commerce", ("customer", "product", "order", "purchase", "item", "cart", "shipping")),
    ("Education", ("student", "grade", "course", "school", "exam", "score", "teacher")),
    ("Sports", ("team", "player", "game", "score", "match", "season", "league", "sport")),
    ("Weather/Climate", ("temperature", "weather", "humidity", "precipitation", "wind", "climate")),
    ("Social Media", ("user", "post", "like", "comment", "share", "follow", "tweet", "social")),
    ("Manufacturing", ("machine", "production", "quality", "defect", "manufacturing", "factory")),
    ("Transportation", ("vehicle", "route", "distance", "speed", "transport", "travel", "trip")),
)
TABLE_TYPES = (
    ("Economic/Macroeconomic time series data", (
        "gdp", "gross domestic product", "expenditure", "consumption", "investment", "exports", "imports")),
    ("Business/Commercial data", ("revenue", "sales", "profit", "customer", "product", "order")),
    ("Healthcare/Medical data", ("patient", "medical", "health", "treatment", "diagnosis")),
)

# Intent of a question, first match wins.
INTENTS_ORDERED = (
    ("statistical", ("calculate", "compute", "average", "sum", "count", "total", "min", "max")),
    ("comparative", ("compare", "top", "best", "worst", "rank", "versus", "vs")),
    ("analytical", ("analyze", "why", "how", "relationship", "correlation", "insight")),
    ("predictive", ("predict", "forecast", "future", "will", "trend")),
    ("exploratory", ("explore", "discover", "find", "pattern", "hidden")),
)

# Which side answers an intent: numbers or prose.
INTENT_ROUTES = {
    "statistical": "calculation", "comparative": "calculation", "descriptive": "narrative",
    "analytical": "narrative", "predictive": "narrative", "exploratory": "narrative",
}

# Intent of a question by number of keywords found.
INTENTS_SCORED = (
    ("statistical", (
        "calculate", "compute", "sum", "total", "average", "mean", "median", "minimum", "maximum", "min", "max",
        "count", "how many", "top", "bottom", "highest", "lowest", "rank", "compare", "percentage", "percent",
        "ratio", "correlation")),
    ("analytical", (
        "analyze", "analysis", "trend", "pattern", "relationship", "correlation", "impact", "influence", "affect",
        "insight", "why", "how does", "what causes", "factor", "predict")),
    ("descriptive", (
        "what is", "what are", "who", "where", "describe", "explain", "tell me about", "show me", "list",
        "summary", "overview")),
)

# Kind of a question, first match wins; the order in which kinds take turns.
QUESTION_BUCKETS = (
    ("comparative", ("compare", "versus", "vs", "rank", "top", "bottom", "highest", "lowest")),
    ("correlation", ("correlation", "relationship", "associate", "relate")),
    ("distribution", ("distribution", "spread", "range", "histogram", "variance", "std")),
    ("trend", ("trend", "over time", "season", "change over", "evolve")),
    ("predictive", ("predict", "forecast", "future")),
    ("statistical", ("mean", "average", "median", "sum", "total", "count")),
)
BUCKET_TURNS = ("comparative", "correlation", "distribution", "trend", "statistical", "analytical", "predictive")

# Words that call for a calculation.
CALCULATION_WORDS = (
    "calculate", "compute", "growth rate", "percentage", "percent", "%", "correlation", "average", "mean",
    "median", "sum", "total", "difference", "change", "increase", "decrease", "ratio", "from", "to", "between",
    "during", "standard deviation", "volatility", "variance", "compare", "vs", "versus",
)

# Which context a question needs, first match wins.
CONTEXT_KINDS = (
    ("comparison", ("compare", "difference", "between", "vs", "versus", "similar")),
    ("temporal", ("pattern", "trend", "over time", "seasonal", "temporal")),
    ("correlation", ("correlation", "relationship", "impact", "affect", "influence")),
    ("distribution", ("distribution", "frequency", "most common", "least common")),
    ("specific_value", ("which", "what", "highest", "lowest", "best", "worst", "top", "bottom")),
)

# Columns a question is about when it names none.
QUESTION_COLUMN_RULES = (
    ("compare", ("compare", "versus", "difference", "between", "across")),
    ("correlation", ("correlation", "relationship", "associated")),
    ("distribution", ("distribution", "spread", "range")),
    ("aggregate", ("average", "mean", "total", "sum")),
)

# Whether and which chart a question calls for.
NO_CHART_WORDS = ("how many columns", "data types", "shape", "info about dataset")
PATTERN_WORDS = ("trend", "pattern", "distribution", "relationship", "over time")
LINE_WORDS = ("over time", "trend", "seasonal")
RANKING_WORDS = ("compare", "versus", "top", "bottom", "rank")
RELATION_WORDS = ("relationship", "correlation")

# What a substantial answer mentions, and what an evasive one says.
ANALYSIS_INDICATORS = (
    "calculation", "analysis", "result", "average", "mean", "total", "growth", "change", "rate", "%",
    "correlation", "trend", "compare", "difference", "ratio", "statistic",
)
DATA_INDICATORS = (
    "shows", "data reveals", "records indicate", "analysis shows", "found", "observed", "identified",
    "discovered", "%", "percent", "average", "mean", "total", "count", "highest", "lowest", "most", "least",
    "top", "bottom",
)
GENERIC_PHRASES = (
    "no data provided", "not sufficient", "cannot determine", "would need", "not available",
    "not enough information", "does not contain", "lacks information", "insufficient data",
)
INSIGHT_INDICATORS = (
    "based on the data", "the dataset shows", "analysis reveals", "data indicates", "correlation", "trend",
    "pattern", "growth", "increase", "decrease", "volatility", "mean", "average", "median",
    "standard deviation", "range", "percentage", "gdp", "expenditure", "consumption", "investment", "exports",
    "imports", "comparison", "relationship", "significant", "period", "component",
)
EVASIVE_PHRASES = (
    "unfortunately", "lacks the necessary", "insufficient data", "cannot determine", "not enough information",
    "would need", "does not contain", "missing data",
)

# Frequent function words of four languages: stop words, and votes for the language of a text.
STOPWORDS = {
    "de": ("der", "die", "das", "und", "ist", "nicht", "von", "zu", "den", "mit", "sich", "des", "auf", "für",
           "im", "dem", "ein", "eine", "auch", "es"),
    "en": ("the", "of", "and", "to", "in", "is", "that", "it", "for", "was", "on", "are", "with", "as", "by",
           "this", "be", "at", "from", "an"),
    "es": ("el", "la", "los", "las", "de", "y", "que", "en", "un", "una", "por", "con", "para", "no", "se",
           "del", "al", "lo", "como", "su"),
    "fr": ("le", "la", "les", "de", "des", "du", "et", "un", "une", "est", "que", "qui", "dans", "pour", "par",
           "pas", "au", "avec", "sur", "en"),
}

# A small opinion lexicon; pass a larger one to the operator where needed.
SENTIMENT_LEXICON = {
    "positive": ("good", "great", "excellent", "best", "love", "happy", "valuable", "useful", "wonderful"),
    "negative": ("bad", "worst", "poor", "terrible", "hate", "sad", "worthless", "useless", "awful"),
}
