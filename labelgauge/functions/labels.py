"""Label columns: coercion, encoding, formatting."""

from pyspark.sql import functions as F

from labelgauge.functions.text import strip

_WHOLE = r"^\s*[+-]?\d+\s*$"
_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def coerce_label(col):
    """Any value to an integer label: true is 1, not a number or null is 0, fractions are cut off.

    Numbers beyond 64 bits are 0.
    """
    text = col.cast("string")
    whole = F.when(text.rlike(_WHOLE), F.trim(text).try_cast("bigint"))  # exact beyond 2**53
    number = F.when(text.rlike(_NUMBER), F.trim(text).try_cast("double"))
    truth = F.when(F.trim(text).isin("True", "TRUE", "true"), F.lit(1).cast("bigint"))
    return F.coalesce(truth, whole, number.try_cast("bigint"), F.lit(0).cast("bigint"))


def class_label(col, positive="Positive", negative="Negative"):
    """1 for the positive class, 0 for the negative one, null for anything else."""
    return F.when(col == positive, 1).when(col == negative, 0)


def membership_label(col, positive_values):
    """1 when the value, read as text, is one of ``positive_values``, else 0."""
    wanted = [str(v) for v in positive_values]
    return F.coalesce(col.cast("string").isin(wanted), F.lit(False)).cast("int")


def yes_value(col, trim=True):
    """A free-form scalar to 1 or 0; ``trim=False`` takes the value as it stands."""
    value = strip(col) if trim else col
    return F.coalesce(value.isin("1", "True", "true"), F.lit(False)).cast("int")


def label_sum(columns):
    return F.expr(" + ".join(f"`{c}`" for c in columns))


def answer_string(columns):
    """``{label: column name}`` to ``label=value, label=value, ...``."""
    parts = ", ".join(f"concat('{name}=', `{c}`)" for name, c in columns.items())
    return F.expr(f"concat_ws(', ', {parts})")
