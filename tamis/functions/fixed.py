"""Fixed values that must equal the reference behaviour (kept together, in natural order)."""

# Text read as missing at CSV load.
NA_STRINGS = ["", "NA", "N/A", "NaN", "nan", "null", "NULL", "None"]

# CSV encodings and delimiters accepted on session restore.
CSV_ENCODINGS = ["utf-8", "latin-1", "cp1252", "iso-8859-1"]
CSV_DELIMITERS = [",", ";", "\t", "|"]

# PII patterns (name, pattern, replacement). Applied to masking in the
# order url, email, credit card, ip address, ssn, phone, since the unanchored phone
# pattern would otherwise eat card digits.
PII_PATTERNS = {
    "email": (r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", "[EMAIL_MASKED]"),
    "phone": (r"(\+?1[-.\s]?)?\(?[0-9]{3}\)?[-.\s]?[0-9]{3}[-.\s]?[0-9]{4}", "[PHONE_MASKED]"),
    "credit_card": (r"\b(?:\d{4}[-\s]?){3}\d{4}\b", "[CARD_MASKED]"),
    "ssn": (r"\b\d{3}-?\d{2}-?\d{4}\b", "[SSN_MASKED]"),
    "ip_address": (r"\b(?:\d{1,3}\.){3}\d{1,3}\b", "[IP_MASKED]"),
    "url": (r"https?://[^\s<>\"{}|\\^`\[\]]+", "[URL_MASKED]"),
}
PII_MASK_ORDER = ["url", "email", "credit_card", "ip_address", "ssn", "phone"]

# PII detection patterns of the dashboard/export scan (type, pattern).
PII_DETECT_PATTERNS = {
    "email": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",
    "phone": r"\b(\+\d{1,3}[- ]?)?\(?\d{3}\)?[- ]?\d{3}[- ]?\d{4}\b",
    "ssn": r"\b\d{3}-?\d{2}-?\d{4}\b",
    "credit_card": r"\b(?:\d{4}[ -]?){3}\d{4}\b",
}

# English stop words used by clean_text and TF-IDF (the classic NLTK list).
ENGLISH_STOP_WORDS = [
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you", "you're", "you've",
    "you'll", "you'd", "your", "yours", "yourself", "yourselves", "he", "him", "his", "himself",
    "she", "she's", "her", "hers", "herself", "it", "it's", "its", "itself", "they", "them",
    "their", "theirs", "themselves", "what", "which", "who", "whom", "this", "that", "that'll",
    "these", "those", "am", "is", "are", "was", "were", "be", "been", "being", "have", "has",
    "had", "having", "do", "does", "did", "doing", "a", "an", "the", "and", "but", "if", "or",
    "because", "as", "until", "while", "of", "at", "by", "for", "with", "about", "against",
    "between", "into", "through", "during", "before", "after", "above", "below", "to", "from",
    "up", "down", "in", "out", "on", "off", "over", "under", "again", "further", "then", "once",
    "here", "there", "when", "where", "why", "how", "all", "any", "both", "each", "few", "more",
    "most", "other", "some", "such", "no", "nor", "not", "only", "own", "same", "so", "than",
    "too", "very", "s", "t", "can", "will", "just", "don", "don't", "should", "should've", "now",
    "d", "ll", "m", "o", "re", "ve", "y", "ain", "aren", "aren't", "couldn", "couldn't", "didn",
    "didn't", "doesn", "doesn't", "hadn", "hadn't", "hasn", "hasn't", "haven", "haven't", "isn",
    "isn't", "ma", "mightn", "mightn't", "mustn", "mustn't", "needn", "needn't", "shan", "shan't",
    "shouldn", "shouldn't", "wasn", "wasn't", "weren", "weren't", "won", "won't", "wouldn",
    "wouldn't",
]

# Names that mark an identifier column (rule id_leakage).
ID_NAMES = ["id", "key", "uuid", "guid"]

# Datetime parts offered by extract_datetime_features.
DATETIME_PARTS = ["year", "month", "day", "hour", "minute", "second", "dayofweek", "quarter"]

# Functions allowed in expression columns and row filters.
EXPRESSION_FUNCTIONS = ["log", "log10", "log1p", "exp", "sin", "cos", "tan", "sqrt", "abs", "round", "floor", "ceil"]

# Further functions allowed in SQL over the table and in row filters, and the
# words of SQL that may stand before a parenthesis.
SQL_FUNCTIONS = [
    "abs", "add_months", "any_value", "approx_count_distinct", "avg", "bool_and", "bool_or", "cast", "ceiling", "char_length",
    "coalesce", "concat", "concat_ws", "contains", "corr", "count", "count_if", "covar_pop", "covar_samp", "cume_dist", "date",
    "date_add", "date_diff", "date_format", "date_sub", "date_trunc", "datediff", "day", "dayofweek", "dayofyear", "dense_rank",
    "endswith", "first", "first_value", "greatest", "grouping", "hour", "if", "ifnull", "initcap", "instr", "isnan", "isnotnull",
    "isnull", "kurtosis", "lag", "last", "last_value", "lead", "least", "left", "length", "ln", "lower", "lpad", "ltrim", "max",
    "max_by", "mean", "median", "min", "min_by", "minute", "mod", "mode", "month", "months_between", "ntile", "nullif", "nvl",
    "percent_rank", "percentile", "percentile_approx", "pow", "power", "quarter", "rank", "regexp_extract", "regexp_like",
    "regexp_replace", "replace", "right", "rlike", "row_number", "rpad", "rtrim", "second", "sign", "skewness", "split",
    "startswith", "std", "stddev", "stddev_pop", "stddev_samp", "substr", "substring", "sum", "timestamp", "to_date",
    "to_timestamp", "trim", "trunc", "try_cast", "try_divide", "try_sum", "upper", "var_pop", "var_samp", "variance",
    "weekofyear", "year",
]
SQL_WORDS = [
    "all", "and", "any", "as", "between", "by", "case", "decimal", "distinct", "else", "end", "except", "exists", "filter", "from",
    "group", "having", "in", "intersect", "interval", "into", "join", "like", "not", "on", "or", "order", "over", "partition",
    "rollup", "cube", "sets", "select", "some", "then", "union", "using", "values", "varchar", "char", "when", "where", "with",
]

# Resample aggregation functions.
RESAMPLE_FUNCS = ["mean", "sum", "min", "max", "count", "std"]

# Token pattern for text cleaning: runs of letters/digits/underscore/apostrophe, or one
# other visible character (punctuation becomes its own token).
TOKEN_PATTERN = r"[\p{L}\p{N}_']+|[^\s\p{L}\p{N}_']"
# TF-IDF tokens: two or more word characters.
TFIDF_TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}"
