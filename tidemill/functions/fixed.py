"""Spellings, names, limits and formats that results must agree on."""

# Ordinal scales, the five strict spellings each.
STRICT_MONETARY = {
    "very_dovish": 1,
    "dovish": 2,
    "neutral": 3,
    "hawkish": 4,
    "very_hawkish": 5,
}
STRICT_TRADE = {
    "very_protectionist": 1,
    "protectionist": 2,
    "neutral": 3,
    "globalist": 4,
    "very_globalist": 5,
}
STRICT_OUTLOOK = {
    "very_negative": 1,
    "negative": 2,
    "neutral": 3,
    "positive": 4,
    "very_positive": 5,
}

# The lenient scales add the "somewhat_" spellings.
LENIENT_MONETARY = {**STRICT_MONETARY, "somewhat_dovish": 2, "somewhat_hawkish": 4}
LENIENT_TRADE = {**STRICT_TRADE, "somewhat_protectionist": 2, "somewhat_globalist": 4}
LENIENT_OUTLOOK = {**STRICT_OUTLOOK, "somewhat_negative": 2, "somewhat_positive": 4}

LABEL_FIELDS = ["monetary_stance", "trade_stance", "tariff_mention", "economic_outlook"]
LABEL_FALLBACK = {
    "monetary_stance": 3,
    "trade_stance": 3,
    "tariff_mention": 0,
    "economic_outlook": 3,
}

# Dead-letter columns and what they are called in the product.
STATUS_COLUMNS = ["_llm_status", "_llm_error", "_llm_attempts", "_llm_fallback_used"]
CLASS_NAMES = {
    "_llm_status": "_llm_status_class",
    "_llm_error": "_llm_error_class",
    "_llm_attempts": "_llm_attempts_class",
    "_llm_fallback_used": "_llm_fallback_class",
}
SUMMARY_NAMES = {
    "_llm_status": "_llm_status_summary",
    "_llm_error": "_llm_error_summary",
    "_llm_attempts": "_llm_attempts_summary",
    "_llm_fallback_used": "_llm_fallback_summary",
}

# Error classes.
VALIDATION = "ValidationError"
TIMEOUT = "LLMTimeoutError"
RATE_LIMIT = "LLMRateLimitError"
SERVER = "LLMServerError"
RETRYABLE = "RetryableError"
UNAVAILABLE = "ServiceUnavailable"
UNEXPECTED = "unexpected_error"
BREAKDOWN_CLASSES = [VALIDATION, TIMEOUT, RATE_LIMIT, SERVER, UNEXPECTED]

# Reply control tokens and channels.
CONTROL_TOKEN = r"<\|[a-zA-Z_]+\|>"

# Text limits in characters.
MIN_TEXT_CHARS = 100
LABEL_TEXT_CHARS = 4000
SUMMARY_TEXT_CHARS = 10000
INDEX_TEXT_CHARS = 10000
EMBED_TEXT_CHARS = 1500
TWIN_INDEX_CHARS = 2000
EMBEDDER_INPUT_CHARS = 8192
SUMMARY_MIN_CHARS = 50
SUMMARY_KEEP_CHARS = 1500
SUMMARY_OBJECT_CHARS = 2000

# Vectors.
EMBEDDING_DIM = 1024
EMBED_BATCH = 32

# Columns.
REQUIRED_FOR_TWIN = [
    "reference",
    "summary",
    "monetary_stance",
    "trade_stance",
    "economic_outlook",
]
TWIN_COLUMNS = [
    "reference",
    "date",
    "country",
    "author",
    "title",
    "monetary_stance",
    "trade_stance",
    "economic_outlook",
    "tariff_mention",
    "is_gov",
    "summary",
]

# Prompt formats; {name} stands for a column.
LABEL_PROMPT = "Analyze this central bank speech:\n\n{text}"
SUMMARY_PROMPT = (
    "Summarize this central bank speech in a few bullet points.\n\n"
    "Speech: {title}\n"
    "Speaker: {speaker} ({central_bank})\n\n"
    "Text excerpt:\n{text}\n\n"
    "Provide your reasoning first, then a bullet-point summary of the key points.\n"
    "The summary should be a single text string with bullet points (using • or -), "
    "not a JSON array."
)
PROFILE_PROMPT = (
    "Generate a brief customer profile (1 sentence) for:\n"
    "- Age: {age}, Region: {region}, Category: {category}, Tier: {tier}\n"
    "Be concise."
)
