"""CSV readers for labelled text.

Columns are strings, named by the header, and typed by us; types are never inferred. Labelled
sentences are lined up by column name, file by file; elsewhere files read together must have the
same header, else the read fails rather than mix columns up.
``multi_line`` is on by default since quoted fields may span lines; turn it off for files whose
records do not, so that large files are split among tasks.
"""

from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelgauge.functions.labels import coerce_label, membership_label
from labelgauge.operators.select import numbered
from labelgauge.schema import LABELS, SENTENCE_COLUMNS, require_columns

# Cells read as null.
NULL_CELLS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

#: Files whose headers are read at a time.
HEADERS_AT_ONCE = 16


def _csv(spark, paths, schema=None, multi_line=True):
    reader = (
        spark.read.option("header", True)
        .option("enforceSchema", False)
        .option("escape", '"')
        .option("multiLine", multi_line)
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
    )
    return (reader.schema(schema) if schema else reader).csv(paths)


def null_cells(df, columns=None):
    """Null markers in string columns to null."""
    names = columns or [f.name for f in df.schema.fields if f.dataType == T.StringType()]
    return df.withColumns({c: F.when(~F.col(c).isin(*NULL_CELLS), F.col(c)) for c in names})


def _files_by_header(spark, paths, multi_line=True):
    """The matching files as lists of files with the same header.

    Spark lists the files, and its CSV reader takes the header from the first record of each, quotes and
    line breaks within it included. It reads no further than that record, some files at a time.
    """
    files = [unquote(file) for file in spark.read.text(paths).inputFiles()]
    with ThreadPoolExecutor(HEADERS_AT_ONCE) as pool:
        headers = list(pool.map(lambda file: tuple(_csv(spark, file, None, multi_line).columns), files))
    groups = {}
    for header, file in sorted(zip(headers, files)):
        groups.setdefault(header, []).append(file)
    return list(groups.values())


def read_labelled_csv(spark, paths, multi_line=True):
    """All matching files as ``text, label, source``; ``Sentences`` and ``Label`` are renamed.

    Files may order their columns differently and have further ones. A path without any match raises
    an error, as Spark does on its own.
    """
    parts = []
    for files in _files_by_header(spark, paths, multi_line) or [paths]:
        df = _csv(spark, files, None, multi_line).withColumnsRenamed(SENTENCE_COLUMNS)
        df = require_columns(df, ["text", "label"])
        parts.append(df.select("text", "label", F.col("_metadata.file_path").alias("source")))
    return null_cells(reduce(lambda a, b: a.unionByName(b), parts), ["text", "label"])


def with_id(df, columns=None, name="id"):
    """``df`` with an id made from the row's own content, the same whenever the row is read again.

    It is the md5 of ``columns`` (all by default) and a number that tells equal rows apart. Only rows that
    have an equal are numbered, in two levels and without their texts, so a row that makes up a third of
    the table is spread over many tasks.
    """
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("\x1e")) for c in columns or df.columns]
    df = numbered(df.withColumn("_key", F.md5(F.concat_ws("\x1f", *cells))), "_key", "_number")
    return df.withColumn(name, F.concat_ws("-", "_key", F.col("_number").cast("string"))).drop("_key", "_number")


def read_multilabel(spark, paths, text_col="translated_te", labels=LABELS, multi_line=True):
    """Multi-label rows with the text kept when present and every label as 0 or 1.

    All columns of the file are kept; a missing text or label column raises an error.
    """
    df = require_columns(_csv(spark, paths, None, multi_line), [text_col, *labels])
    df = null_cells(df, [text_col]).dropna(subset=[text_col])
    return df.withColumns({c: coerce_label(F.col(c)) for c in labels})


def first_existing(spark, paths):
    """The first of ``paths`` that exists, as in a list of usual places."""
    for path in paths:
        try:
            spark.read.text(path)
            return path
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
    raise FileNotFoundError(f"none of {list(paths)} exists")


def read_first_column(spark, paths, multi_line=True):
    """The first existing file of ``paths``; its first column, whatever its name, is ``text``."""
    df = _csv(spark, first_existing(spark, paths), None, multi_line)
    df = df.withColumnRenamed(df.columns[0], "text")
    return null_cells(df, ["text"]).dropna(subset=["text"])


def read_configured(spark, config, multi_line=True):
    """A further dataset by its ``path, text_col, label_col, positive_val`` entry."""
    df = _csv(spark, config["path"], None, multi_line)
    require_columns(df, [config["text_col"], config["label_col"]])
    df = df.select(
        F.col(config["text_col"]).alias("text"),
        membership_label(F.col(config["label_col"]), config["positive_val"]).alias("label"),
        F.col("_metadata.file_name").alias("source"),
    )
    return null_cells(df, ["text"]).dropna(subset=["text"])


def read_class_files(spark, positive_path, negative_path, multi_line=True):
    """One file per class, the label being the file's class."""
    positive = read_first_column(spark, [positive_path], multi_line)
    negative = read_first_column(spark, [negative_path], multi_line)
    return positive.select("text", F.lit(1).alias("label")).unionByName(
        negative.select("text", F.lit(0).alias("label"))
    )
