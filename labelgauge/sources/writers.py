"""Writers. Parquet is the sink between steps; CSV, JSON and text are for handing results on."""


def write_table(df, path):
    df.write.mode("errorifexists").parquet(path)
    return path


def stored(df, path=None):
    """``df`` written to ``path`` and read back, so that it is computed once; as it is without one."""
    if path is None:
        return df
    return df.sparkSession.read.schema(df.schema).parquet(write_table(df, path))


def write_csv(df, path, partition_by=()):
    """CSV that reads back unchanged: header, doubled quotes, outer blanks kept."""
    (
        df.write.mode("errorifexists")
        .option("header", True)
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .partitionBy(*partition_by)
        .csv(path)
    )
    return path


def write_json(df, path):
    """One JSON object per row, nested columns as nested objects."""
    df.write.mode("errorifexists").option("ignoreNullFields", False).json(path)
    return path


def write_lines(df, path, order, line="line"):
    """Text lines in the order of ``order``: the part files, read by name, give the whole text."""
    df.orderBy(*order).select(line).write.mode("errorifexists").text(path)
    return path
