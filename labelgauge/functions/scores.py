"""Row scores and the ratios behind the quality metrics."""

from pyspark.sql import functions as F

# Weights of the composite score and the length that earns its full bonus.
ACCURACY_WEIGHT = 0.4
LENGTH_WEIGHT = 0.6
FULL_LENGTH = 8000


def row_accuracy(pairs):
    """Share of equal labels; ``pairs`` holds (truth, prediction) column names."""
    hits = " + ".join(f"int(`{t}` = `{p}`)" for t, p in pairs)
    return F.expr(f"({hits}) / {len(pairs)}")


def row_macro_f1(pairs):
    """Macro F1 of one row: over a single row only a label with both at 1 scores."""
    hits = " + ".join(f"int(`{t}` = 1 AND `{p}` = 1)" for t, p in pairs)
    return F.expr(f"({hits}) / {len(pairs)}")


def composite(accuracy, text_length):
    bonus = F.least(F.sqrt(text_length / FULL_LENGTH), F.lit(1.0))
    return accuracy * ACCURACY_WEIGHT + bonus * LENGTH_WEIGHT


def answer_contained(answer, reply):
    """1.0 when the whole answer stands in the reply."""
    return F.coalesce(reply.contains(answer), F.lit(False)).cast("double")


def feedback(answer, reply):
    return F.concat(F.lit("Expected: "), answer, F.lit("\nGot: "), reply)


def ratio(a, b):
    """SQL for ``a / b``, 0 where b is 0."""
    return f"coalesce(try_divide(double({a}), {b}), 0D)"


def cell_metrics(at=""):
    """SQL per quality metric over the cells tp, fp, tn, fn, each named after the prefix ``at``."""
    tp, fp, tn, fn = (at + cell for cell in ("tp", "fp", "tn", "fn"))
    f1 = ratio(f"2 * {tp}", f"2 * {tp} + {fp} + {fn}")
    f1_negative = ratio(f"2 * {tn}", f"2 * {tn} + {fp} + {fn}")
    n = f"{tp} + {fp} + {tn} + {fn}"
    return {
        "accuracy": ratio(f"{tp} + {tn}", n),
        "precision": ratio(tp, f"{tp} + {fp}"),
        "recall": ratio(tp, f"{tp} + {fn}"),
        "f1": f1,
        "weighted_f1": ratio(f"{f1} * ({tp} + {fn}) + {f1_negative} * ({tn} + {fp})", n),
    }


def round4(sql):
    """To four decimals, ties to the even neighbour."""
    return f"rint({sql} * 10000) / 10000"
