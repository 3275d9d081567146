"""Lining truth up with predictions or stored replies, by id."""

from pyspark.sql import functions as F

from labelgauge.schema import LABELS


def align(truth, predictions, id_col="id", missing="default", columns=None):
    """Truth rows with their predictions.

    ``missing='default'`` keeps rows without a prediction and gives them 0; ``'null'`` keeps
    them with nulls; ``'skip'`` leaves them out.
    """
    if missing == "skip":
        return truth.join(predictions, id_col)
    df = truth.join(predictions, id_col, "left")
    if missing == "null":
        return df
    columns = columns or [f"pred_{name}" for name in LABELS]
    return df.withColumns({c: F.expr(f"coalesce(`{c}`, 0)") for c in columns})


def score_stored_replies(truth, replies, decode, id_col="id", raw_col="raw_response"):
    """Predictions from a table of stored replies; a row without a reply has what null decodes to.

    Replies are decoded where they are stored, so that bits and not texts meet the truth; the text of
    a reply is carried along only where a result asks for it.
    """
    decoded = decode(replies.select(id_col, raw_col), raw_col)
    df = truth.join(decoded, id_col, "left")
    new = {c: kind for c, kind in decoded.dtypes if c not in (id_col, raw_col)}
    # fields read from null are empty, and the bits of an unreadable object are 0; others stay null
    absent = {c: F.lit("") for c, kind in new.items() if kind == "string"}
    if "parse_ok" in new:
        absent |= {c: F.lit(0).cast(kind) for c, kind in new.items() if c not in absent}
    return df.withColumns({c: F.coalesce(c, value) for c, value in absent.items()})
