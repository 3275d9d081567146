"""Label set, column names and the schema check."""

# The six labels in report order and their display names.
LABELS = (
    "stereotype",
    "vilification",
    "dehumanization",
    "extreme_language",
    "lack_of_empathy",
    "invalidation",
)
DISPLAY_NAMES = {
    "stereotype": "Stereotype",
    "vilification": "Vilification",
    "dehumanization": "Dehumanization",
    "extreme_language": "Extreme Language",
    "lack_of_empathy": "Lack of Empathy",
    "invalidation": "Invalidation",
}

# The columns of raw labelled sentences and what they become.
SENTENCE_COLUMNS = {"Sentences": "text", "Label": "label"}


def require_columns(df, columns):
    """Raise when ``df`` lacks one of ``columns``; looks at the schema only, runs no job."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df
